"""Review state: coverage, page checks, status roll-ups, latest-wins merges, recovery chains, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.sources.tables import read

#: Statuses of a packet that will not change any more, and decisions of a finding.
TERMINAL = ("done", "warning", "error", "cancelled")
DECISIONS = ("accepted", "rejected", "deferred", "review_pending")


def decision_state(c: Column) -> Column:
    """A known decision, else review_pending."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(word.isin(*DECISIONS), word).otherwise("review_pending")


def missing_pages(target: str, checked: str) -> Column:
    return F.array_sort(F.array_except(F.coalesce(F.col(target), F.array().cast("array<int>")), F.coalesce(F.col(checked), F.array().cast("array<int>"))))


def packet_verification(packets: DataFrame) -> DataFrame:
    """packets (packet_id, status, explicit, read_error, coverage) with their verification state; the first that applies counts."""
    state = F.when(F.col("explicit").isin("page_complete", "needs_review", "incomplete", "invalid"), F.col("explicit"))
    state = state.when(F.col("status").isin("error", "invalid") | (F.trim(F.coalesce(F.col("packet_id").cast("string"), F.lit(""))) == ""), "invalid")
    state = state.when(F.coalesce("read_error", F.lit(False)), "needs_review").when(F.coalesce("coverage", F.lit(0.0)) < 1, "incomplete").otherwise("page_complete")
    return packets.withColumn("verification", state)


def job_overview(packets: DataFrame) -> DataFrame:
    """One row per job (job_id) over packets (target, checked: page arrays; status): pages, coverage and state."""
    pages = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    bad = F.bool_or(F.col("status").isin("warning", "error"))
    g = packets.groupBy("job_id").agg(pages("target").alias("target_pages"), pages(F.array_intersect("target", "checked")).alias("checked_pages"), bad.alias("bad"), F.bool_and(F.col("status").isin(*TERMINAL)).alias("ended"), F.bool_or(F.col("status") == "running").alias("running"))
    coverage = F.when(F.col("target_pages") > 0, F.least(F.lit(1.0), F.col("checked_pages") / F.col("target_pages"))).otherwise(0.0)
    g = g.withColumn("coverage", coverage)
    state = F.when(F.col("bad"), "needs_review").when(F.col("ended") & (F.col("coverage") >= 1), "page_complete").when(F.col("running"), "incomplete").otherwise("invalid")
    return g.select("job_id", "target_pages", "checked_pages", F.floor(F.col("coverage") * 10000 + 0.5).cast("long").alias("coverage_bp"), state.alias("state"))


def status_rollup(packets: DataFrame) -> DataFrame:
    """A job's status by precedence: all done, then error, cancelled, running, else queued."""
    has = lambda s: F.bool_or(F.col("status") == s)
    g = packets.groupBy("job_id").agg(F.bool_and(F.col("status").isin("done", "warning")).alias("done"), has("warning").alias("warned"), has("error").alias("error"), has("cancelled").alias("cancelled"), has("running").alias("running"))
    status = F.when(F.col("done") & F.col("warned"), "warning").when(F.col("done"), "done").when(F.col("error"), "error").when(F.col("cancelled"), "cancelled").when(F.col("running"), "running").otherwise("queued")
    return g.select("job_id", status.alias("status"))


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """Candidates by state, and their total; unknown states are review_pending."""
    return candidates.select(decision_state(F.col("state")).alias("state")).rollup("state").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("state", F.lit("total")).alias("state"), "n")


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. Aggregation, so a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def overlay(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new win over those of old with the same key."""
    rest = [c for c in old.columns if c != key]
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    return o.join(n, key, "full").select(key, *(F.when(F.col("__n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest))


def page_ranges(pages: DataFrame, key: str, page: str) -> DataFrame:
    """`1-3,7` per key: runs of consecutive pages, joined in order."""
    w = Window.partitionBy(key).orderBy(page)
    runs = pages.select(key, page).where(F.col(page).isNotNull()).distinct().withColumn("run", F.col(page) - F.row_number().over(w))
    spans = runs.groupBy(key, "run").agg(F.min(page).alias("lo"), F.max(page).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))), lambda s: s["t"])
    return spans.groupBy(key).agg(F.array_join(listed, ",").alias("pages"))


def merge_split_results(parts: DataFrame) -> DataFrame:
    """Results of split packets (packet_id, target, checked, elapsed_ms, findings) merged: union of pages, sums, missing pages."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    g = parts.groupBy("packet_id").agg(union("target").alias("target"), union("checked").alias("checked"), F.sum("elapsed_ms").alias("elapsed_ms"), F.sum("findings").alias("findings"))
    return g.withColumn("missing", missing_pages("target", "checked"))


def chain_summary(results: DataFrame) -> DataFrame:
    """Last result of each packet along a recovery chain; vetoed where its jobs disagree on the source hash."""
    return results.groupBy("chain_id").agg(F.count(F.lit(1)).alias("results"), F.max_by("status", "order").alias("status"), (F.count_distinct("source_hash") == 1).alias("consistent"))


def health(events: DataFrame, unit: str = "day") -> DataFrame:
    """Per day or hour: good, bad, stalls, refusals, missing answers, active hours, stall rate (half even, one decimal), verdict."""
    n = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    g = events.groupBy(F.date_trunc(unit, "ts").alias("at")).agg(n("ok").alias("ok"), n("ng").alias("ng"), n("stall").alias("stalls"), n("refusal").alias("refusals"), n("no_json").alias("no_json"), F.count_distinct(F.date_trunc("hour", "ts")).alias("hours"))
    g = g.withColumn("rate", F.bround(F.col("stalls") / F.greatest(F.col("hours"), F.lit(1)), 1))
    verdict = F.when((F.col("ng") > 0) | (F.col("rate") > 5) | ((F.col("ok") == 0) & (F.col("refusals") + F.col("no_json") > 2)), "bad").when(F.col("rate") > 2.5, "unstable").otherwise("good")
    return g.withColumn("verdict", verdict)


def page_coverage(answers: DataFrame) -> DataFrame:
    """Share of an answer's target pages that were checked; complete only when all were and nothing went wrong."""
    n = F.size("target")
    share = F.when(n > 0, F.size(F.array_intersect("target", "checked")) / n).otherwise(0.0)
    return answers.withColumn("coverage", share).withColumn("complete", (F.col("coverage") >= 1) & ~F.coalesce("read_error", F.lit(False)))


# Orders stand for jobs and their line items for packets: target pages are the line number and the next one.


def _packets(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "warning").otherwise("error")).otherwise(F.when(F.col("l_linestatus") == "O", "done").otherwise("running"))
    target = F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1)
    checked = F.when(F.col("l_discount") >= 0.05, target).when(F.col("l_discount") >= 0.02, F.array("l_linenumber")).otherwise(F.array().cast("array<int>"))
    return li.select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("packet_id"), status.alias("status"), target.alias("target"), checked.alias("checked"), F.col("l_linenumber").alias("page"), (F.col("l_tax") > 0.07).alias("read_error"), F.col("l_quantity").cast("long").alias("elapsed_ms"), F.lit(1).alias("findings"), F.lit(None).cast("string").alias("explicit"), "l_suppkey", "l_shipdate", "l_linenumber", "l_extendedprice")


def a09_job_overview(spark, d):
    return job_overview(_packets(spark, d))


def a10_candidate_counts(spark, d):
    return candidate_counts(read(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", " Accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("new").alias("state")))


def a11_status_rollup(spark, d):
    return status_rollup(_packets(spark, d))


def a12_missing_pages(spark, d):
    p = _packets(spark, d)
    return p.select("job_id", F.explode(missing_pages("target", "checked")).alias("page")).groupBy("job_id").agg(F.count_distinct("page").alias("missing"), F.min("page").alias("first_missing"))


def a13_page_coverage(spark, d):
    return page_coverage(_packets(spark, d)).groupBy("coverage", "complete").agg(F.count(F.lit(1)).alias("n"))


def x34_packet_verification(spark, d):
    return packet_verification(page_coverage(_packets(spark, d))).groupBy("verification").agg(F.count(F.lit(1)).alias("n"))


def x35_decision_state(spark, d):
    return read(spark, d, "events").select(decision_state(F.when(F.col("value") > 50, F.upper(F.lit("accepted"))).otherwise(F.col("event_type"))).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def j16_overlay(spark, d):
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    new = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))
    return overlay(old, new, "k")


def t08_last_answer(spark, d):
    rows = _packets(spark, d).select(F.col("packet_id"), F.col("l_shipdate").alias("at"), F.col("job_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"))
    return latest_per_key(rows, "packet_id", ["at", "job_id", "line", "price"])


def w07_page_ranges(spark, d):
    return page_ranges(_packets(spark, d).where("size(checked) > 0"), "job_id", "page")


def u02_missing(spark, d):
    return _packets(spark, d).select(F.size(missing_pages("target", "checked")).cast("long").alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


def a21_merge_split_results(spark, d):
    return merge_split_results(_packets(spark, d)).select("packet_id", F.size("target").cast("long").alias("targets"), F.size("checked").cast("long").alias("checked"), F.size("missing").cast("long").alias("missing"), "elapsed_ms", "findings")


def a22_chain_summary(spark, d):
    p = _packets(spark, d)
    return chain_summary(p.select(F.col("job_id").alias("chain_id"), "status", F.struct("l_shipdate", "l_linenumber", "packet_id").alias("order"), F.col("l_suppkey").alias("source_hash")))


def a16_health(spark, d):
    kind = F.when(F.col("value") > 80, "stall").when(F.col("value") > 75, "ng").when(F.col("value") > 70, "refusal").when(F.col("value") > 65, "no_json").otherwise("ok")
    return health(read(spark, d, "events").select("ts", kind.alias("kind")))


_P = """
WITH p AS (SELECT l_orderkey AS job_id, l_partkey AS packet_id, CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'warning' ELSE 'error' END ELSE CASE WHEN l_linestatus = 'O' THEN 'done' ELSE 'running' END END AS status,
  [l_linenumber, l_linenumber + 1] AS target, CASE WHEN l_discount >= 0.05 THEN [l_linenumber, l_linenumber + 1] WHEN l_discount >= 0.02 THEN [l_linenumber] ELSE [] END AS checked,
  l_linenumber AS page, l_tax > 0.07 AS read_error, CAST(trunc(l_quantity) AS BIGINT) AS elapsed_ms, l_suppkey, l_shipdate, l_linenumber, l_extendedprice, l_orderkey FROM lineitem)
"""

QUERIES = {f.__name__: f for f in (a09_job_overview, a10_candidate_counts, a11_status_rollup, a12_missing_pages, a13_page_coverage, a16_health, a21_merge_split_results, a22_chain_summary, j16_overlay, t08_last_answer, u02_missing, w07_page_ranges, x34_packet_verification, x35_decision_state)}

ORACLE_SQL = {
    "a09_job_overview": _P + """
SELECT job_id, target_pages, checked_pages, CAST(floor(least(1.0, checked_pages / target_pages::DOUBLE) * 10000 + 0.5) AS BIGINT) AS coverage_bp,
  CASE WHEN bad THEN 'needs_review' WHEN ended AND checked_pages >= target_pages THEN 'page_complete' WHEN running THEN 'incomplete' ELSE 'invalid' END AS state
FROM (SELECT job_id, CAST(len(list_distinct(flatten(list(target)))) AS INT) AS target_pages, CAST(len(list_distinct(flatten(list(checked)))) AS INT) AS checked_pages, bool_or(status IN ('warning', 'error')) AS bad,
  bool_and(status IN ('done', 'warning', 'error', 'cancelled')) AS ended, bool_or(status = 'running') AS running FROM p GROUP BY job_id)
""",
    "a10_candidate_counts": "SELECT coalesce(state, 'total') AS state, n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'review_pending' END AS state, count(*) AS n FROM lineitem GROUP BY ROLLUP (1))",
    "a11_status_rollup": _P + "SELECT job_id, CASE WHEN d AND w THEN 'warning' WHEN d THEN 'done' WHEN e THEN 'error' WHEN r THEN 'running' ELSE 'queued' END AS status FROM (SELECT job_id, bool_and(status IN ('done', 'warning')) AS d, bool_or(status = 'warning') AS w, bool_or(status = 'error') AS e, bool_or(status = 'running') AS r FROM p GROUP BY job_id)",
    "a12_missing_pages": _P + "SELECT job_id, count(DISTINCT page) AS missing, min(page) AS first_missing FROM (SELECT job_id, unnest(list_filter(target, lambda x: NOT list_contains(checked, x))) AS page FROM p) GROUP BY job_id",
    "a13_page_coverage": _P + "SELECT len(checked) / 2.0::DOUBLE AS coverage, len(checked) = 2 AND NOT read_error AS complete, count(*) AS n FROM p GROUP BY 1, 2",
    "a16_health": """
SELECT *, CASE WHEN ng > 0 OR rate > 5 OR (ok = 0 AND refusals + no_json > 2) THEN 'bad' WHEN rate > 2.5 THEN 'unstable' ELSE 'good' END AS verdict FROM (
SELECT *, round_even(stalls / greatest(hours, 1)::DOUBLE, 1) AS rate FROM (
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS at, count(*) FILTER (WHERE value <= 65) AS ok, count(*) FILTER (WHERE value > 75 AND value <= 80) AS ng, count(*) FILTER (WHERE value > 80) AS stalls, count(*) FILTER (WHERE value > 70 AND value <= 75) AS refusals,
  count(*) FILTER (WHERE value > 65 AND value <= 70) AS no_json, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY 1))
""",
    "a21_merge_split_results": _P + """
SELECT packet_id, len(t) AS targets, len(c) AS checked, len(list_filter(t, lambda x: NOT list_contains(c, x))) AS missing, elapsed_ms, findings
FROM (SELECT packet_id, list_distinct(flatten(list(target))) AS t, list_distinct(flatten(list(checked))) AS c, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms, count(*) AS findings FROM p GROUP BY packet_id)
""",
    "a22_chain_summary": _P + "SELECT job_id AS chain_id, count(*) AS results, arg_max(status, (l_shipdate, l_linenumber, packet_id)) AS status, count(DISTINCT l_suppkey) = 1 AS consistent FROM p GROUP BY job_id",
    "j16_overlay": "SELECT coalesce(c_custkey, s_suppkey) AS k, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS name, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS value FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "t08_last_answer": _P + "SELECT packet_id, l_shipdate AS at, job_id, l_linenumber AS line, l_extendedprice AS price FROM p QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY l_shipdate DESC, job_id DESC, l_linenumber DESC, l_extendedprice DESC) = 1",
    "u02_missing": _P + "SELECT 2 - len(checked) AS missing, count(*) AS n FROM p GROUP BY 1",
    "w07_page_ranges": _P + """
SELECT job_id, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ',' ORDER BY lo) AS pages FROM (
SELECT job_id, min(page) AS lo, max(page) AS hi FROM (SELECT job_id, page, page - row_number() OVER (PARTITION BY job_id ORDER BY page) AS run FROM (SELECT DISTINCT job_id, page FROM p WHERE len(checked) > 0)) GROUP BY job_id, run) GROUP BY job_id
""",
    "x34_packet_verification": _P + "SELECT CASE WHEN status = 'error' THEN 'invalid' WHEN read_error THEN 'needs_review' WHEN len(checked) < 2 THEN 'incomplete' ELSE 'page_complete' END AS verification, count(*) AS n FROM p GROUP BY 1",
    "x35_decision_state": "SELECT CASE WHEN value > 50 THEN 'accepted' ELSE 'review_pending' END AS state, count(*) AS n FROM events GROUP BY 1",
}
