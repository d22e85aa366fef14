"""Confidence calibration and run dashboards: bins, expected calibration error, Brier score, drift, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.hashing import fnv1a32
from galley.operators.cases import case_rows, case_sql
from galley.sources.tables import read

#: Outcome words and the label each stands for.
RIGHT = ("1", "true", "correct", "accepted", "tp", "pass", "yes")
WRONG = ("0", "false", "incorrect", "rejected", "fp", "fail", "no")


def normalise_confidence(c: Column) -> Column:
    """(1, 100] are percents; the rest is clamped to [0, 1]."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((c > 1) & (c <= 100), c / 100).otherwise(c))))


def outcome_label(c: Column) -> Column:
    """1 right, 0 wrong, null unlabelled."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*RIGHT), 1).when(word.isin(*WRONG), 0)


def _round4(c: Column) -> Column:
    return F.floor(c * 10000 + 0.5) / 10000


def calibration_bins(records: DataFrame, n: int = 10) -> DataFrame:
    """bin, count, labelled, mean_confidence (of all rows), precision (of labelled rows), error; every bin has a row."""
    n = min(20, max(2, n))
    place = F.least(F.lit(n - 1), F.floor(F.col("confidence") * n)).cast("int")
    bins = records.where("confidence is not null").groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.count("label").alias("labelled"), F.avg("confidence").alias("mean"), F.avg("label").alias("rate"))
    every = records.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(bins, "bin", "left")
    return joined.select("bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("labelled", F.lit(0)).alias("labelled"), _round4(F.col("mean")).alias("mean_confidence"), _round4(F.col("rate")).alias("precision"), _round4(F.abs(F.col("mean") - F.col("rate"))).alias("error"))


def calibration_error(records: DataFrame, n: int = 10) -> DataFrame:
    """ece (bin errors weighted by labelled rows), brier, labelled; null without labels."""
    place = F.least(F.lit(n - 1), F.floor(F.col("confidence") * n)).cast("int")
    bins = records.where("confidence is not null").groupBy(place.alias("bin")).agg(F.count("label").alias("k"), F.avg("confidence").alias("mean"), F.avg("label").alias("rate"), F.sum(F.pow(F.col("confidence") - F.col("label"), 2)).alias("square"))
    total = F.sum("k")
    return bins.agg(total.alias("labelled"), F.when(total > 0, _round4(F.sum(F.abs(F.col("mean") - F.col("rate")) * F.col("k")) / total)).alias("ece"), F.when(total > 0, _round4(F.sum("square") / total)).alias("brier"))


def calibration_by(records: DataFrame, columns: list[str]) -> DataFrame:
    """Labelled rows, mean confidence and precision for each value of each column, in one pass by grouping sets."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    long = records.where("label is not null and confidence is not null").select("confidence", "label", pairs.alias("p"))
    return long.groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("labelled"), _round4(F.avg("confidence")).alias("mean_confidence"), _round4(F.avg("label")).alias("precision"))


def run_dashboard(runs: DataFrame, budget: int) -> DataFrame:
    """One row over runs (id, semantic_calls, retries, elapsed_ms, packets, done, candidates, suppressed, holdout)."""
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        _round4(F.sum("done") / F.nullif(F.sum("packets"), F.lit(0))).alias("completion"),
        _round4(F.sum("candidates") / F.count(F.lit(1))).alias("burden"),
        _round4(F.sum("suppressed") / F.nullif(F.sum("candidates"), F.lit(0))).alias("suppression"),
        F.sum("semantic_calls").alias("calls"),
        F.sum("retries").alias("retries"),
        _round4(F.avg("elapsed_ms")).alias("mean_ms"),
        F.size(ids(F.col("semantic_calls") > budget)).cast("long").alias("over_budget"),
        F.size(ids(F.col("holdout"))).cast("long").alias("holdout_runs"),
    )


def drift(current: DataFrame, baseline: DataFrame, limit: float = 0.2) -> DataFrame:
    """Metrics that moved: two-sided for completion and suppression, upward only for burden and mean_ms. Both sides need three runs."""
    metrics = (("completion", True), ("suppression", True), ("burden", False), ("mean_ms", False))
    both = current.select(F.lit(1).alias("k"), F.struct("*").alias("now")).join(baseline.select(F.lit(1).alias("k"), F.struct("*").alias("was")), "k")
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"now.{m}").cast("double").alias("now"), F.col(f"was.{m}").cast("double").alias("was"), F.lit(two).alias("two")) for m, two in metrics)))
    long = both.where("now.runs >= 3 AND was.runs >= 3").select(rows.alias("r")).select("r.*").where("was <> 0")
    change = (F.col("now") - F.col("was")) / F.col("was")
    return long.withColumn("change", change).where(F.when(F.col("two"), F.abs("change") >= limit).otherwise(F.col("change") > limit)).select("metric", "now", "was", _round4(F.col("change")).alias("change"))


def suppressed_sample(rows: DataFrame, seed: str, limit: int = 200) -> DataFrame:
    """At most 200 rows (id) in the order of the FNV-1a hash of `seed|id`, ties by id: the same rows for the same seed."""
    return rows.select("id", fnv1a32(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))).alias("rank")).orderBy("rank", "id").limit(min(200, limit))


# Line items stand for labelled findings, orders for runs.


def _records(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    word = F.when(F.col("l_returnflag") == "A", "Accepted ").when(F.col("l_returnflag") == "R", "FP").otherwise("open")
    confidence = normalise_confidence(F.when(F.col("l_quantity") > 40, F.col("l_quantity") * 2).otherwise(F.col("l_discount") * 10))
    return li.select(confidence.alias("confidence"), outcome_label(word).alias("label"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias("prompt"), (F.col("l_tax") > 0.05).alias("holdout"))


def _runs(spark: SparkSession, d: str, where: str) -> DataFrame:
    li = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.expr("if(l_linestatus = 'F', 1, 0)")).alias("done"), F.sum(F.expr("if(l_discount > 0.02, 1, 0)")).alias("candidates"), F.sum(F.expr("if(l_discount > 0.08, 1, 0)")).alias("suppressed"), F.max("l_linenumber").alias("semantic_calls"))
    o = read(spark, d, "orders").where(where)
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_orderkey").alias("id"), "packets", "done", "candidates", "suppressed", "semantic_calls", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("retries"), F.col("o_totalprice").alias("elapsed_ms"), (F.col("o_orderstatus") == "O").alias("holdout"))


OPEN, CLOSED = "o_orderdate >= DATE '1996-01-01'", "o_orderdate < DATE '1996-01-01'"


def a04_calibration_bins(spark, d):
    return calibration_bins(_records(spark, d))


def a05_calibration_error(spark, d):
    return calibration_error(_records(spark, d))


def a06_calibration_by(spark, d):
    return calibration_by(_records(spark, d), ["category", "prompt", "holdout"])


def a07_run_dashboard(spark, d):
    return run_dashboard(_runs(spark, d, "true"), 4)


def a08_drift(spark, d):
    return drift(run_dashboard(_runs(spark, d, OPEN), 4), run_dashboard(_runs(spark, d, CLOSED), 4), 0.0)


def t01_suppressed_sample(spark, d):
    return suppressed_sample(read(spark, d, "lineitem").where("l_discount > 0.08").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")).distinct(), "audit")


def x26_confidence(spark, d):
    return _records(spark, d).groupBy(F.round("confidence", 2).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


OUTCOMES = (("tp", 1), (" Pass", 1), ("YES", 1), ("1", 1), ("true", 1), ("correct", 1), ("accepted", 1), ("fp", 0), ("fail", 0), ("no", 0), ("0", 0), ("False", 0), ("incorrect", 0), ("rejected", 0), ("dismissed", None), ("confirmed", None), ("", None), (None, None), ("2", None))


def x27_outcome(spark, d):
    return case_rows(spark, d, [c[:1] for c in OUTCOMES], "word string").select("id", outcome_label(F.col("word")).alias("label"))


_R = """
WITH r AS (SELECT CASE WHEN l_quantity > 40 THEN (CASE WHEN l_quantity * 2 > 1 AND l_quantity * 2 <= 100 THEN l_quantity * 2 / 100 ELSE least(1.0, l_quantity * 2) END) ELSE greatest(0.0, least(1.0, l_discount * 10)) END AS confidence,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END AS label, l_linestatus AS category, l_linenumber AS prompt, l_tax > 0.05 AS holdout FROM lineitem)
"""
_D = """
SELECT count(*) AS runs, floor(sum(done) / sum(packets) * 10000 + 0.5) / 10000 AS completion, floor(sum(candidates) / count(*) * 10000 + 0.5) / 10000 AS burden,
  floor(sum(suppressed) / sum(candidates) * 10000 + 0.5) / 10000 AS suppression, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(retries) AS BIGINT) AS retries, floor(avg(ms) * 10000 + 0.5) / 10000 AS mean_ms,
  count(*) FILTER (WHERE calls > 4) AS over_budget, count(*) FILTER (WHERE holdout) AS holdout_runs
FROM (SELECT o_orderkey, o_orderdate, count(*)::DOUBLE AS packets, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS done, sum(CASE WHEN l_discount > 0.02 THEN 1 ELSE 0 END)::DOUBLE AS candidates,
  sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END)::DOUBLE AS suppressed, max(l_linenumber) AS calls, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS retries, o_totalprice AS ms, o_orderstatus = 'O' AS holdout
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate, o_orderpriority, o_totalprice, o_orderstatus)
"""

QUERIES = {f.__name__: f for f in (a04_calibration_bins, a05_calibration_error, a06_calibration_by, a07_run_dashboard, a08_drift, t01_suppressed_sample, x26_confidence, x27_outcome)}

ORACLE_SQL = {
    "a04_calibration_bins": _R + """
SELECT CAST(b.i AS INT) AS bin, coalesce(n, 0) AS count, coalesce(k, 0) AS labelled, floor(mean * 10000 + 0.5) / 10000 AS mean_confidence, floor(rate * 10000 + 0.5) / 10000 AS precision, floor(abs(mean - rate) * 10000 + 0.5) / 10000 AS error
FROM (SELECT unnest(range(10)) AS i) b LEFT JOIN (SELECT least(9, floor(confidence * 10)) AS i, count(*) AS n, count(label) AS k, avg(confidence) AS mean, avg(label) AS rate FROM r GROUP BY 1) g USING (i)
""",
    "a05_calibration_error": _R + """
SELECT CAST(sum(k) AS BIGINT) AS labelled, floor(sum(abs(mean - rate) * k) / sum(k) * 10000 + 0.5) / 10000 AS ece, floor(sum(square) / sum(k) * 10000 + 0.5) / 10000 AS brier
FROM (SELECT least(9, floor(confidence * 10)) AS i, count(label) AS k, avg(confidence) AS mean, avg(label) AS rate, sum(pow(confidence - label, 2)) AS square FROM r GROUP BY 1)
""",
    "a06_calibration_by": _R + """
SELECT field, value, count(*) AS labelled, floor(avg(confidence) * 10000 + 0.5) / 10000 AS mean_confidence, floor(avg(label) * 10000 + 0.5) / 10000 AS precision FROM (
SELECT 'category' AS field, category AS value, confidence, label FROM r UNION ALL SELECT 'prompt', CAST(prompt AS VARCHAR), confidence, label FROM r UNION ALL SELECT 'holdout', CAST(holdout AS VARCHAR), confidence, label FROM r)
WHERE label IS NOT NULL GROUP BY field, value
""",
    "a07_run_dashboard": _D,
    "a08_drift": f"""
WITH n AS ({_D} WHERE o_orderdate >= DATE '1996-01-01'), w AS ({_D} WHERE o_orderdate < DATE '1996-01-01')
SELECT metric, now, was, floor((now - was) / was * 10000 + 0.5) / 10000 AS change FROM (
SELECT 'completion' AS metric, n.completion AS now, w.completion AS was, true AS two FROM n, w UNION ALL SELECT 'suppression', n.suppression, w.suppression, true FROM n, w
UNION ALL SELECT 'burden', n.burden, w.burden, false FROM n, w UNION ALL SELECT 'mean_ms', n.mean_ms, w.mean_ms, false FROM n, w)
WHERE was <> 0 AND CASE WHEN two THEN abs((now - was) / was) >= 0 ELSE (now - was) / was > 0 END
""",
    "x26_confidence": _R + "SELECT round(confidence, 2) AS confidence, count(*) AS n FROM r GROUP BY 1",
    "x27_outcome": case_sql([c[1] for c in OUTCOMES], "label"),
}
