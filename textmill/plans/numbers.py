"""Queries over vectors, events and ranges: sampling, losses, schedules, metrics and request limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import numeric as N
from textmill.operators import sequence
from textmill.plans import sqltext as S
from textmill.session import ship


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def topk_logits(spark, sf):
    return N.top_k(N.long_form(_vectors(spark, sf), "vec_id", "v"), "vec_id", 5)


def topp_nucleus(spark, sf):
    return N.top_p(N.long_form(_vectors(spark, sf), "vec_id", "v"), "vec_id", 0.5).select("vec_id", "pos")


def softmax_nll(spark, sf):
    v = _vectors(spark, sf)
    return v.groupBy("label").agg(F.sum(N.log_sum_exp(F.col("v")) - F.element_at("v", (F.pmod("label", F.size("v")) + 1).cast("int"))).alias("nll"), F.count("*").alias("tokens")).withColumn("perplexity", F.exp(F.col("nll") / F.col("tokens")))


def repetition_penalty(spark, sf):
    v = _vectors(spark, sf)
    seen = v.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(7))).alias("pos"))
    return N.repetition_penalty(N.long_form(v, "vec_id", "v"), seen, "vec_id", 1.2)


def rmsnorm(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(N.rms_norm(F.col("v"))).alias("pos", "y"))


def cosine_to_first(spark, sf):
    v = _vectors(spark, sf)
    first = v.agg(F.min_by("v", "vec_id").alias("w"))
    return v.crossJoin(F.broadcast(first)).select("vec_id", N.cosine(F.col("v"), F.col("w")).alias("cosine"))  # one row


def temperature_scale(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(N.temperature(F.col("v"), 0.7)).alias("pos", "x"))


def argmax_accuracy(spark, sf):
    v = _vectors(spark, sf).withColumn("best", F.array_position("v", F.array_max("v")) - 1)
    return v.groupBy("label").agg(F.avg((F.col("best") % 10 == F.col("label") % 10).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def next_token_draw(spark, sf):
    u = (X.hash32(F.col("vec_id").cast("string")) + 0.5) / float(2**32)
    return _vectors(spark, sf).select("vec_id", N.draw(F.col("v"), u).alias("token"))


def lr_schedule(spark, sf):
    s = spark.range(0, 2001).select(F.col("id").alias("step"))
    return s.select("step", N.learning_rate(F.col("step"), 100, 2000).alias("cosine"), N.learning_rate(F.col("step"), 100, 2000, "linear").alias("linear"), N.round_up(F.col("step"), 64).cast("bigint").alias("rounded"))


def _pairs(spark, sf):
    """The first half of each vector against the second, element by element."""
    half = lambda i: F.slice("v", F.lit(1) + i * F.floor(F.size("v") / 2).cast("int"), F.floor(F.size("v") / 2).cast("int"))
    return _vectors(spark, sf).select("vec_id", "label", F.arrays_zip(half(0).alias("a"), half(1).alias("b")).alias("z"))


def preference_loss(spark, sf):
    v = _pairs(spark, sf).select("label", F.explode("z").alias("z"))
    return v.groupBy("label").agg(F.avg(N.preference_loss(F.col("z.a") - F.col("z.b"))).alias("loss"), F.avg((F.col("z.a") > F.col("z.b")).cast("double")).alias("accuracy"))


def kl_reward(spark, sf):
    """KL of old against reference log-probabilities, reward, advantage over the last value, and return, of each rollout."""
    v = _pairs(spark, sf)
    kl = F.aggregate("z", F.lit(0.0), lambda s, x: s + (x["a"] - x["b"]))
    reward, value = F.lit(1.0) - 0.02 * kl, F.element_at("z", -1)["b"]
    return v.select("vec_id", kl.alias("kl"), reward.alias("reward"), (reward - value).alias("advantage"), (reward - value + value).alias("returns"))


def ppo_loss(spark, sf):
    """Clipped surrogate, entropy and total loss of each rollout, over all its elements."""
    v = _pairs(spark, sf).withColumn("adv", F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(-0.5))
    n = F.size("z")
    clipped = F.aggregate("z", F.lit(0.0), lambda s, x: s + N.clipped_surrogate(x["a"], x["b"], F.col("adv"))) / n
    p = N.softmax(F.transform("z", lambda x: x["a"]))
    entropy = F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log(x + 1e-9))
    return v.select("vec_id", clipped.alias("policy"), entropy.alias("entropy"), (clipped - 0.01 * entropy).alias("total"))


def last_token_pooling(spark, sf):
    """The element at the last unmasked place; masks are as long as the vector's number tells."""
    mask = F.col("vec_id") % (F.size("v") + 1)
    return _vectors(spark, sf).select("vec_id", N.last_token("v", mask).alias("pooled"))


def _events(spark, sf):
    return _t(spark, sf, "events").where("user_id is not null and ts is not null")


def rate_limit_arrivals(spark, sf):
    return sequence.in_window(_events(spark, sf).select("event_id", "user_id", "ts"), "user_id", "ts", 3600).select("event_id", "in_window")


def rate_limit_accepted(spark, sf):
    return sequence.accepted_requests(_events(spark, sf).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 3600).select("event_id", "accepted")


def loss_spikes(spark, sf):
    """Values above three times the median of the 50 before them of their type that were no spikes."""
    e = _events(spark, sf).select("event_id", "event_type", "value")
    return sequence.loss_spikes(e, "event_type", "event_id", "value").select("event_id", "spike")


def early_stopping(spark, sf):
    d = _events(spark, sf).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"))
    w = Window.partitionBy("event_type").orderBy("day")  # one row a day
    d = d.withColumn("best", F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("better", F.col("best").isNull() | (F.col("loss") < F.col("best") - 0.01))
    d = d.withColumn("run", F.sum(F.col("better").cast("int")).over(w))
    return d.withColumn("waited", F.row_number().over(Window.partitionBy("event_type", "run").orderBy("day")) - 1).select("event_type", "day", "better", "waited")


def throughput(spark, sf):
    d = _events(spark, sf).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("event_id").alias("step"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"))
    w = Window.partitionBy("event_type").orderBy("day")
    return d.select("event_type", "day", (512 * (F.col("step") - F.lag("step").over(w)) / ((F.col("us") - F.lag("us").over(w)) / 1e6)).alias("tokens_per_s"))


def _answered(spark, sf):
    """Questions with an answer to judge and the set of answers the table has for the question, up to case and spaces."""
    m = _t(spark, sf, "memory_items").distinct().where("question is not null and answer is not null").select("id", "question", "answer", _norm(F.col("question")).alias("q"))
    known = m.select("q", _norm(F.col("answer")).alias("a")).distinct()
    return m, known


def _norm(c):
    return X.collapse(F.lower(c))


def exact_match(spark, sf):
    """Answers of even items that another item of the question also gives, keywords of the question in the answer, and the default rubric."""
    m, _ = _answered(spark, sf)
    gold = m.where("id % 2 = 1").select("q", _norm(F.col("answer")).alias("a")).distinct().withColumn("hit", F.lit(1.0))
    even = m.where("id % 2 = 0").withColumn("a", _norm(F.col("answer"))).join(gold, ["q", "a"], "left")
    first = F.get(X.lower_words(F.col("question")), F.lit(0))
    keyword = F.when(first.isNull(), F.lit(0.0)).otherwise(F.lower("answer").contains(first).cast("double"))
    rubric = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.2 * (F.length("answer") > 80).cast("double") + 0.2 * F.col("answer").contains(".").cast("double") - 0.3 * F.lower("answer").contains("sorry").cast("double")))
    return even.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("exact"), F.avg(keyword).alias("keyword"), F.avg(rubric).alias("rubric"))


def _translations(spark, sf):
    """Answers of one question beside its smallest answer, as hypothesis and reference."""
    m, _ = _answered(spark, sf)
    best = m.groupBy("q").agg(F.min("answer").alias("reference"))
    return m.join(best, "q").select("answer", "reference")


def answer_bleu(spark, sf):
    return N.bleu(_translations(spark, sf), "answer", "reference")


def answer_chrf(spark, sf):
    return N.chrf(_translations(spark, sf), "answer", "reference")


def events_by_window(spark, sf):
    return _events(spark, sf).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def order_pages(spark, sf):
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return o.select("o_custkey", F.greatest(F.lit(1), F.ceil(F.col("n") / 20)).cast("bigint").alias("pages"))


QUERIES = {f.__name__: f for f in (
    topk_logits, topp_nucleus, softmax_nll, repetition_penalty, rmsnorm, cosine_to_first, temperature_scale, argmax_accuracy, next_token_draw, lr_schedule, preference_loss, kl_reward, ppo_loss, last_token_pooling,
    rate_limit_arrivals, rate_limit_accepted, loss_spikes, early_stopping, throughput, exact_match, answer_bleu, answer_chrf, events_by_window, order_pages,
)}

_V = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_L = f"(SELECT vec_id, i - 1 AS pos, v[i] AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM {_V}))"
_EV = "(SELECT * FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
_SM = "list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))"
_N = lambda x: S.collapse(f"lower({x})")
SQL = {
    "topk_logits": f"SELECT vec_id, pos::INT AS pos, x FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM {_L}) WHERE r <= 5",
    "topp_nucleus": f"WITH q AS (SELECT vec_id, pos, x, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM {_L}), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM q) SELECT vec_id, pos::INT AS pos FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) WHERE b <= 0.5",
    "softmax_nll": f"SELECT *, exp(nll / tokens) AS perplexity FROM (SELECT label, sum(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) - v[label % len(v) + 1]) AS nll, count(*) AS tokens FROM {_V} GROUP BY label)",
    "repetition_penalty": f"SELECT vec_id, pos::INT AS pos, CASE WHEN pos % 7 <> 0 OR pos > 60 THEN x WHEN x < 0 THEN x * 1.2::DOUBLE ELSE x / 1.2::DOUBLE END AS x FROM {_L}",
    "rmsnorm": f"SELECT vec_id, pos::INT AS pos, x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-6) AS y FROM {_L}",
    "cosine_to_first": f"SELECT a.vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) AS cosine FROM {_V} a, (SELECT v FROM {_V} ORDER BY vec_id LIMIT 1) b",
    "temperature_scale": f"SELECT vec_id, pos::INT AS pos, x / 0.7::DOUBLE AS x FROM {_L}",
    "argmax_accuracy": f"SELECT label, avg(((list_position(v, list_max(v)) - 1) % 10 = label % 10)::INT::DOUBLE) AS accuracy, count(*) AS n FROM {_V} GROUP BY label",
    "next_token_draw": f"WITH p AS (SELECT vec_id, {_SM} AS p, (CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM {_V}) SELECT vec_id, least(len(list_filter(range(1, len(p) + 1), lambda i: list_sum(p[:i]) < u)), len(p) - 1)::INT AS token FROM p",
    "lr_schedule": "SELECT step, CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least(1.0, (step - 100) / 1900.0::DOUBLE))) END AS cosine, CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * (1 - least(1.0, (step - 100) / 1900.0::DOUBLE)) END AS linear, CAST(ceil(step / 64.0) * 64 AS BIGINT) AS rounded FROM range(0, 2001) t(step)",
    "preference_loss": f"SELECT label, avg(greatest(-d, 0.0) + ln(1 + exp(-abs(d)))) AS loss, avg((d > 0)::INT::DOUBLE) AS accuracy FROM (SELECT label, unnest(list_transform(range(1, len(v) // 2 + 1), lambda i: v[i] - v[i + len(v) // 2])) AS d FROM {_V}) GROUP BY label",
    "kl_reward": f"SELECT vec_id, kl, 1.0 - 0.02::DOUBLE * kl AS reward, 1.0 - 0.02::DOUBLE * kl - last AS advantage, 1.0 - 0.02::DOUBLE * kl AS returns FROM (SELECT vec_id, list_sum(list_transform(range(1, len(v) // 2 + 1), lambda i: v[i] - v[i + len(v) // 2])) AS kl, v[len(v) // 2 * 2] AS last FROM {_V})",
    "ppo_loss": f"""WITH z AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS adv, v[:len(v) // 2] AS v, list_transform(range(1, len(v) // 2 + 1), lambda i: exp(v[i] - v[i + len(v) // 2])) AS r FROM {_V}),
s AS (SELECT vec_id, list_avg(list_transform(r, lambda x: -least(x * adv, greatest(least(x, 1.2::DOUBLE), 0.8::DOUBLE) * adv))) AS policy, {_SM} AS p FROM z), t AS (SELECT vec_id, policy, list_sum(list_transform(p, lambda x: -x * ln(x + 1e-9))) AS entropy FROM s)
SELECT vec_id, policy, entropy, policy - 0.01::DOUBLE * entropy AS total FROM t""",
    "last_token_pooling": f"SELECT vec_id, v[greatest(vec_id % (len(v) + 1), 1)] AS pooled FROM {_V}",
    "rate_limit_arrivals": f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM {_EV}",
    "loss_spikes": f"""WITH RECURSIVE v AS (SELECT event_type, list(event_id ORDER BY event_id) AS ids, list(value ORDER BY event_id) AS xs FROM {_EV} GROUP BY 1),
r AS (SELECT event_type, 0 AS k, CAST([] AS DOUBLE[]) AS h, CAST(NULL AS BIGINT) AS event_id, FALSE AS spike FROM v
UNION ALL SELECT event_type, k, CASE WHEN spike OR x IS NULL THEN h ELSE list_append(h, x)[-50:] END, id, spike FROM (
  SELECT *, coalesce(len(h) >= 3 AND m > 0 AND x > 3 * m, FALSE) AS spike FROM (
    SELECT r.event_type, r.k + 1 AS k, r.h, v.ids[r.k + 1] AS id, v.xs[r.k + 1] AS x, list_aggregate(r.h, 'median') AS m FROM r JOIN v USING (event_type) WHERE r.k < len(v.ids))))
SELECT event_id, spike FROM r WHERE k > 0""",
    "rate_limit_accepted": f"""WITH RECURSIVE v AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(epoch_us(ts) ORDER BY ts, event_id) AS ts FROM {_EV} GROUP BY 1),
r AS (SELECT user_id, 0 AS k, CAST([] AS BIGINT[]) AS h, CAST(NULL AS BIGINT) AS event_id, FALSE AS accepted FROM v
UNION ALL SELECT user_id, k, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END, id, len(h) < 3 FROM (
  SELECT r.user_id, r.k + 1 AS k, list_filter(r.h, lambda x: x >= v.ts[r.k + 1] - 3600000000) AS h, v.ids[r.k + 1] AS id, v.ts[r.k + 1] AS t FROM r JOIN v USING (user_id) WHERE r.k < len(v.ids)))
SELECT event_id, accepted FROM r WHERE k > 0""",
    "early_stopping": f"WITH d AS (SELECT event_type, ts::DATE AS day, avg(value) AS loss FROM {_EV} GROUP BY 1, 2), b AS (SELECT *, min(loss) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d), c AS (SELECT *, best IS NULL OR loss < best - 0.01 AS better FROM b), r AS (SELECT *, sum(better::INT) OVER (PARTITION BY event_type ORDER BY day) AS run FROM c) SELECT event_type, day, better, (row_number() OVER (PARTITION BY event_type, run ORDER BY day) - 1)::INT AS waited FROM r",
    "throughput": f"WITH d AS (SELECT event_type, ts::DATE AS day, max(event_id) AS step, max(epoch_us(ts)) AS us FROM {_EV} GROUP BY 1, 2) SELECT event_type, day, 512 * (step - lag(step) OVER w) / ((us - lag(us) OVER w) / 1e6) AS tokens_per_s FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)",
    "exact_match": f"""WITH m AS (SELECT DISTINCT * FROM memory_items WHERE question IS NOT NULL AND answer IS NOT NULL), n AS (SELECT *, {_N('question')} AS q, {_N('answer')} AS a FROM m),
g AS (SELECT DISTINCT q, a FROM n WHERE id % 2 = 1)
SELECT avg((g.q IS NOT NULL)::INT::DOUBLE) AS exact, avg(CASE WHEN len({S.words('lower(question)')}) = 0 THEN 0.0 ELSE contains(lower(answer), {S.words('lower(question)')}[1])::INT::DOUBLE END) AS keyword,
  avg(greatest(0.0, least(1.0, 0.5::DOUBLE + 0.2::DOUBLE * (length(answer) > 80)::INT + 0.2::DOUBLE * contains(answer, '.')::INT - 0.3::DOUBLE * contains(lower(answer), 'sorry')::INT))) AS rubric FROM n LEFT JOIN g ON g.q = n.q AND g.a = n.a WHERE n.id % 2 = 0""",
    "answer_bleu": f"""WITH m AS (SELECT DISTINCT * FROM memory_items WHERE question IS NOT NULL AND answer IS NOT NULL), n AS (SELECT *, {_N('question')} AS q FROM m),
t AS (SELECT row_number() OVER () AS r, answer AS h, min(answer) OVER (PARTITION BY q) AS f FROM n),
w AS (SELECT r, {S.tokens('h')} AS h, {S.tokens('f')} AS f FROM t),
g AS (SELECT r, k, s, unnest(list_transform(range(1, len(x) - k + 2), lambda i: array_to_string(x[i:i + k - 1], chr(1)))) AS gram FROM (SELECT r, 'h' AS s, h AS x FROM w UNION ALL SELECT r, 'f', f FROM w), range(1, 5) o(k) WHERE len(x) >= k),
c AS (SELECT r, k, gram, count_if(s = 'h') AS h, count_if(s = 'f') AS f FROM g GROUP BY 1, 2, 3),
p AS (SELECT k, sum(least(h, f)) AS hit, sum(h) AS n FROM c GROUP BY k),
z AS (SELECT sum(len(h)) AS a, sum(len(f)) AS b FROM w)
SELECT 100 * CASE WHEN a < b THEN exp(1 - b / greatest(a, 1)) ELSE 1.0 END * exp((SELECT sum(ln(greatest(coalesce(hit, 0), 1e-9) / greatest(coalesce(n, 0), 1))) FROM range(1, 5) o(k) LEFT JOIN p USING (k)) / 4) AS bleu, a::BIGINT AS hypothesis_tokens, b::BIGINT AS reference_tokens FROM z""",
    "events_by_window": f"SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM {_EV} GROUP BY 1, 2",
    "order_pages": "SELECT o_custkey, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM orders GROUP BY o_custkey",
}
