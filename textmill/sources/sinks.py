"""Writers of records, shards, manifests and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textmill.operators.retrieval import upsert


def write_jsonl(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite", records_per_file: int = 1_000_000) -> None:
    """JSON lines, one folder for each value of ``by`` if given; files are bounded in records."""
    w = df.write.mode(mode).option("maxRecordsPerFile", records_per_file)
    (w.partitionBy(by) if by else w).json(path)


def write_counted(df: DataFrame, path: str, by: str | None = None) -> int:
    """Write JSON lines and return the number of rows, counted while they are written."""
    seen = Observation()
    write_jsonl(df.observe(seen, F.count(F.lit(1)).alias("n")), path, by)
    return int(seen.get["n"])


def write_shards(df: DataFrame, path: str, text: str = "text", shard: str = "shard") -> None:
    """One folder of text for each shard; newlines within a record become spaces."""
    df.select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value"), shard).repartition(shard).write.mode("overwrite").partitionBy(shard).text(path)


def write_manifest(spark: SparkSession, path: str, new: DataFrame, key: str = "name") -> DataFrame:
    """Upsert rows into a manifest table; one that is missing or holds no readable rows is made anew, any other error is raised."""
    try:
        old = spark.read.schema(new.schema).option("mode", "DROPMALFORMED").json(path)
        old = spark.createDataFrame(old.collect(), new.schema)  # a row for each dataset
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], new.schema)
    out = upsert(old, new, key)
    rows = out.collect()
    out = spark.createDataFrame(rows, new.schema)
    out.coalesce(1).write.mode("overwrite").json(path)
    return out


def sse(event: Column, payload: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n"))


def parse_sse(stream: Column) -> Column:
    """The JSON payloads of a stream of events; what isn't JSON is ignored."""
    frames = F.filter(F.flatten(F.transform(F.split(stream, "\n\n"), lambda f: F.split(f, "\n"))), lambda x: x.startswith("data: "))
    return F.filter(F.transform(frames, lambda x: F.substring(x, 7, 2**31 - 1)), lambda x: F.get_json_object(x, "$").isNotNull() & x.startswith("{"))


def report(df: DataFrame, folder: str) -> tuple[Path, Path]:
    """A JSON and a Markdown report of (name, metrics); a row for each benchmark."""
    rows = df.orderBy("name").collect()
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "report.json").write_text(json.dumps([{"name": r["name"], "metrics": dict(r["metrics"])} for r in rows], ensure_ascii=False, indent=2))
    lines = ["# Report", ""]
    for r in rows:
        lines += [f"## {r['name']}", "", *[f"- {k}: {v:.4f}" for k, v in sorted(r["metrics"].items())], ""]
    (out / "report.md").write_text("\n".join(lines))
    return out / "report.json", out / "report.md"


def stage_result(folder: str, stage: str, result: dict) -> Path:
    path = Path(folder) / f"{stage}_stage_result.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(result, ensure_ascii=False, indent=2, default=str))
    return path


def tokenizer_metadata(folder: str, vocabulary: str, special: list[tuple[str, int]], size: int) -> Path:
    """What a tokenizer is made of, as a JSON file: its vocabulary, its size and its special tokens."""
    path = Path(folder) / "tokenizer_metadata.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"vocabulary": vocabulary, "vocab_size": size, "special_tokens": dict(special)}, ensure_ascii=False, indent=2))
    return path


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    write_jsonl(df, path, mode="append")
