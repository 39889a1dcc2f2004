"""Readers of record files and the resolver of dataset names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text as X

CORPUS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("language", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("timestamp", T.StringType())])),
])
BAD = "_bad"
# Name, source, subset, split, language, licence, estimated tokens, kind.
CATALOG = (
    ("wikipedia_ar", "wikimedia/wikipedia", "20231101.ar", "train", "ar", "CC-BY-SA-3.0", 3_200_000_000, "encyclopedia"),
    ("wikipedia_en", "wikimedia/wikipedia", "20231101.en", "train", "en", "CC-BY-SA-3.0", 25_000_000_000, "encyclopedia"),
    ("oscar_ar", "oscar-corpus/OSCAR-2301", "ar", "train", "ar", "ODC-BY", 12_500_000_000, "web_crawl"),
    ("oscar_en", "oscar-corpus/OSCAR-2301", "en", "train", "en", "ODC-BY", 150_000_000_000, "web_crawl"),
    ("c4_en", "allenai/c4", "en", "train", "en", "ODC-BY", 156_000_000_000, "web_crawl"),
    ("mc4_ar", "mc4", "ar", "train", "ar", "ODC-BY", 8_200_000_000, "web_crawl"),
)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "name string, source string, subset string, split string, language string, license string, estimated_tokens bigint, kind string")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Records of JSON lines. Blank lines are skipped; lines that aren't objects are skipped too, or an error if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.length(X.strip(F.col("value"))) > 0)
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.where(F.col("value").rlike(r"^\s*\{") & F.expr("try_parse_json(value) is not null")).select(row.alias("r"), F.col("_metadata.file_name").alias("file_name")).select("r.*", "file_name")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, kind) of the lines that a tolerant reader leaves out: malformed ones, and JSON that is no object."""
    lines = spark.read.text(path).where(F.length(X.strip(F.col("value"))) > 0)
    fine = F.expr("try_parse_json(value) is not null")
    return lines.where(~(F.col("value").rlike(r"^\s*\{") & fine)).select("value", F.when(fine, "no object").otherwise("malformed").alias("kind"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the lines of text files in (file, line) order, blank ones left out.

    Lines are counted by part of a file; what stands before a part is added up over one row
    for each part.
    """
    from pyspark.sql import Window

    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at")).where(F.length(X.strip(F.col("value"))) > 0)
    sizes = rows.groupBy("file", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of a file
    starts = sizes.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    w = Window.partitionBy("file", "part").orderBy("at")
    return rows.withColumn("k", F.row_number().over(w) - 1).join(starts, ["file", "part"]).select((F.col("start") + F.col("k")).alias("line_no"), "value")


def lines_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The lines with the numbers in ``wanted`` (line_no)."""
    return numbered_lines(spark, path).join(wanted.select("line_no").distinct(), "line_no").select("line_no", "value")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a ``.json`` file (a list, an object with ``data``, or one object) or of a ``.jsonl`` file; other suffixes have none."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema).drop("file_name")
    if not path.endswith(".json"):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    v = F.expr("try_parse_json(value)")
    items = F.coalesce(F.expr("try_variant_get(try_parse_json(value), '$.data', 'array<variant>')"), F.expr("try_variant_get(try_parse_json(value), '$', 'array<variant>')"), F.array(v))
    one = text.select(F.explode(items).alias("v")).select(F.to_json("v").alias("j")).where("j like '{%'")
    return one.select(F.from_json("j", schema).alias("r")).select("r.*")


def with_order(df: DataFrame) -> DataFrame:
    """Add the place of each row in (file, line) order for keep-first operators; read files whole for it."""
    return df.withColumn("line_no", F.monotonically_increasing_id())


def corpus_stats(spark: SparkSession, paths: str) -> DataFrame:
    """Lines (bad ones too, blank ones not), bytes, token estimate and languages by file, with a total row."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file")).where(F.length(X.strip(F.col("value"))) > 0)
    row = lines.select("file", F.octet_length("value").alias("bytes"), F.get_json_object("value", "$.text").alias("text"), F.coalesce(F.get_json_object("value", "$.language"), F.lit("unknown")).alias("language"))
    by = row.groupBy("file", "language").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum(X.token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"))
    return by.rollup("file", "language").agg(F.sum("n").alias("lines"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))


def route(file_name: Column) -> Column:
    """The converter for a file, by its name; the first that fits."""
    n = F.lower(file_name)
    ok = n.endswith(".json") | n.endswith(".jsonl")
    return F.when(ok & n.contains("dolly"), "dolly").when(ok & (n.contains("oasst") | n.contains("openassistant")), "oasst").when(ok & n.contains("alpaca") & n.contains("arab"), "alpaca")


def first_available(spark: SparkSession, candidates: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The first of several paths that can be read; the last error if none can."""
    error: Exception | None = None
    for c in candidates:
        try:
            return spark.read.format(fmt).load(c)
        except Exception as e:  # noqa: BLE001
            error = e
    raise FileNotFoundError(f"none of {list(candidates)} can be read") from error


def load_all(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Datasets of the catalog under ``root``; a failing one is reported and doesn't stop the rest."""
    out, status = {}, []
    for name in names or [c[0] for c in CATALOG]:
        try:
            out[name] = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
            status.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001
            status.append((name, "error", str(e).split("\n")[0]))
    return out, spark.createDataFrame(status, "name string, status string, error string")


def normalize_record(df: DataFrame, dataset: str) -> DataFrame:
    """One schema for heterogeneous records; rows without text are dropped, but counted in generated ids."""
    has = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    text = X.falsy_or(has("text"), has("content"), has("document"))
    rows = df.withColumn("_i", F.monotonically_increasing_id())
    auto = F.concat(F.lit(dataset + "-"), F.col("_i").cast("string"))
    known = dataset.startswith(("wikipedia", "oscar", "c4", "mc4"))
    ident = X.falsy_or(has("id"), has("url"), auto) if known else X.falsy_or(has("id"), auto)
    meta = F.struct(has("title").alias("title"), has("url").alias("url"), has("timestamp").alias("timestamp"))
    return rows.select(ident.alias("id"), F.lit(dataset).alias("source"), X.falsy_or(has("language"), F.lit("unknown")).alias("language"), text.alias("text"), meta.alias("metadata")).where("text is not null")


def eval_text(df: DataFrame) -> DataFrame:
    """Texts for evaluation: the ``text`` column, else the first; empty ones dropped."""
    c = "text" if "text" in df.columns else df.columns[0]
    return df.select(F.col(c).cast("string").alias("text")).where("text is not null and text <> ''")


def choice_items(df: DataFrame) -> DataFrame:
    """(ctx, endings, label) of multiple-choice records in several spellings."""
    has = lambda *cs: [F.col(c) for c in cs if c in df.columns]
    return df.select(X.falsy_or(*[c.cast("string") for c in has("ctx", "context", "prompt")]).alias("ctx"), F.coalesce(*has("endings", "choices", "options")).alias("endings"), F.expr("try_cast(label as int)").alias("label"))


def qa_items(df: DataFrame) -> DataFrame:
    """Arabic question-answer records, by language or else by id."""
    lang = F.lower(X.falsy_or(*[F.col(c).cast("string") for c in ("language", "id") if c in df.columns]))
    return df.where(lang.contains("arabic") | lang.startswith("ar")).select("context", "question", F.col("answers.text").alias("answers"))


def parallel_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("source_text"), F.col(b).alias("target_text")).where("source_text <> '' and target_text <> ''")


def read_table_url(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store, by JDBC.

    Without ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` one task
    reads it all; a column without the rest gets its bounds from the store.
    """
    reader = spark.read.format("jdbc").option("url", url)
    column = options.get("partitionColumn")
    if column and "lowerBound" not in options:
        low, high = reader.options(**{k: v for k, v in options.items() if k != "partitionColumn"}).option("query", f"select min({column}) as low, max({column}) as high from {table}").load().first()
        options |= {"lowerBound": str(low or 0), "upperBound": str((high or 0) + 1)}
        options.setdefault("numPartitions", str(2 * spark.sparkContext.defaultParallelism))
    return reader.options(dbtable=table, **options).load()


def hub_dataset(spark: SparkSession, root: str, source: str, subset: str | None = None, split: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A data set kept under ``root`` as source/subset/split, each part of the path if it is given."""
    path = "/".join([root.rstrip("/"), *[p for p in (source, subset, split) if p]])
    return spark.read.format(fmt).option("recursiveFileLookup", "true").load(path)


def load_config(path: str) -> dict:
    """Settings from a YAML file (JSON is YAML too); what isn't a mapping is an error."""
    import json
    from pathlib import Path

    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:  # without the library, JSON only
        out = json.loads(text)
    else:
        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise TypeError("a configuration must be a mapping")
    return out


def merge_config(shared: dict, stage: dict) -> dict:
    """Settings of a stage over the shared ones; both must be mappings."""
    if not isinstance(shared, dict) or not isinstance(stage, dict):
        raise TypeError("a configuration must be a mapping")
    return {**shared, **stage}
