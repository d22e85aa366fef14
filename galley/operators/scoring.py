"""Detection quality of a run against planted errors: packet joins, page-window quote matches, recall, precision, burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.unicode import nfkc
from galley.sources.tables import read


def normalise_quote(c: Column) -> Column:
    """Compatibility forms folded (NFKC), lower case, without white space, commas and the marks * ※ †."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), r"[\s\x{3000}\x{00A0},*※†]", "")


def quotes_match(a: Column, b: Column) -> Column:
    """Either non-empty quote contains the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def with_targets(planted: DataFrame) -> DataFrame:
    """One row per target of a planted item: itself and each alternative (alt: array of page, quote)."""
    own = F.array(F.struct(F.col("page").alias("page"), F.col("quote").alias("quote")))
    every = F.concat(own, F.coalesce(F.col("alt"), F.array().cast("array<struct<page:int,quote:string>>"))) if "alt" in planted.columns else own
    return planted.select("packet_id", "id", F.explode(every).alias("t")).select("packet_id", "id", "t.page", normalise_quote(F.col("t.quote")).alias("quote"))


def _hits(targets: DataFrame, candidates: DataFrame, window: int) -> Column:
    far = F.abs(F.coalesce(targets["page"], F.lit(999)) - F.coalesce(candidates["page"], F.lit(-999)))
    return (targets["packet_id"] == candidates["packet_id"]) & (far <= window) & quotes_match(targets["quote"], candidates["quote"])


def detected(planted: DataFrame, candidates: DataFrame, window: int = 0) -> DataFrame:
    """(packet_id, id) of the planted items that a candidate matches."""
    targets = with_targets(planted).alias("p")
    cand = candidates.select("packet_id", "page", normalise_quote(F.col("quote")).alias("quote")).distinct().alias("c")
    return targets.join(cand, _hits(targets, cand, window), "left_semi").select("packet_id", "id").distinct()


def valid_candidates(candidates: DataFrame, planted: DataFrame, window: int = 0) -> DataFrame:
    """The candidates (with their own columns) that match a planted item or an alternative."""
    targets = with_targets(planted).drop("id").distinct()
    cand = candidates.withColumn("__quote", normalise_quote(F.col("quote")))
    far = F.abs(F.coalesce(targets["page"], F.lit(999)) - F.coalesce(cand["page"], F.lit(-999)))
    hit = (targets["packet_id"] == cand["packet_id"]) & (far <= window) & quotes_match(targets["quote"], cand["__quote"])
    return cand.join(targets, hit, "left_semi").drop("__quote")


def without_ignored(candidates: DataFrame, ignored: DataFrame, window: int = 0) -> DataFrame:
    """Candidates that match no ignored entry."""
    drop = ignored.select("packet_id", "page", normalise_quote(F.col("quote")).alias("quote")).distinct()
    cand = candidates.withColumn("__quote", normalise_quote(F.col("quote")))
    far = F.abs(F.coalesce(drop["page"], F.lit(999)) - F.coalesce(cand["page"], F.lit(-999)))
    hit = (drop["packet_id"] == cand["packet_id"]) & (far <= window) & quotes_match(drop["quote"], cand["__quote"])
    return cand.join(drop, hit, "left_anti").drop("__quote")


def percent(n: Column, d: Column) -> Column:
    """Tenths of a percent, rounded half up; null for an empty denominator."""
    return F.when(d > 0, F.floor(1000.0 * n / d + 0.5) / 10)


def recall_by(planted: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """Planted and detected items by group (all together without a group)."""
    flag = found.withColumn("__hit", F.lit(1))
    joined = planted.join(flag, ["packet_id", "id"], "left")
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("planted"), F.count("__hit").alias("found")).withColumn("recall", percent(F.col("found"), F.col("planted")))


def burden(candidates: DataFrame, packets: DataFrame) -> DataFrame:
    """Candidates per packet: mean, nearest-rank 90th percentile and maximum, with 0 for packets without any."""
    n = packets.select("packet_id").distinct().join(candidates.groupBy("packet_id").agg(F.count(F.lit(1)).alias("n")), "packet_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)"), F.lit(0)).cast("long").alias("p90"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def sections_with_both(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """Pairs (id, anchor_page, page) that one section (doc_id, start_page, end_page) holds together."""
    hit = (pairs["doc_id"] == sections["doc_id"]) & sections["start_page"].__le__(F.least(pairs["anchor_page"], pairs["page"])) & sections["end_page"].__ge__(F.greatest(pairs["anchor_page"], pairs["page"]))
    return pairs.join(sections, hit, "left_semi")


def numeric_aware(c: str) -> list[Column]:
    """Sort keys: numbers first by value, then the rest as text."""
    return [F.expr(f"try_cast(`{c}` AS BIGINT)").asc_nulls_last(), F.col(c)]


# Line items stand for a review: planted are the returned ones, findings those with a discount of 5 % or more.


def _planted(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").where("l_returnflag = 'R'")
    return li.select(F.col("l_orderkey").alias("packet_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_linenumber").alias("page"), F.col("l_linestatus").alias("lens"), F.concat(F.lit("Ｐart "), F.translate(F.col("l_partkey").cast("string"), "0123456789", "０１２３４５６７８９")).alias("quote")).distinct()


def _candidates(spark: SparkSession, d: str, where: str) -> DataFrame:
    li = read(spark, d, "lineitem").where(where)
    return li.select(F.col("l_orderkey").alias("packet_id"), F.expr("l_linenumber + if(l_tax > 0.04, 1, 0)").alias("page"), F.concat(F.lit("the part, "), F.col("l_partkey").cast("string"), F.lit(" *late*")).alias("quote"))


FINDINGS, UNCERTAIN, IGNORED = "l_discount >= 0.05", "l_discount < 0.05 AND l_quantity > 25", "l_tax = 0.08"


def _ignored(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, IGNORED)


def a01_recall_precision(spark: SparkSession, d: str) -> DataFrame:
    planted, findings = _planted(spark, d), _candidates(spark, d, FINDINGS)
    combined = findings.unionByName(_candidates(spark, d, UNCERTAIN))
    strict, assisted = recall_by(planted, detected(planted, findings, 1)), recall_by(planted, detected(planted, combined, 1))
    counted = without_ignored(findings, _ignored(spark, d), 1)
    right = valid_candidates(counted, planted, 1).agg(F.count(F.lit(1)).alias("right"))
    out = strict.select("planted", F.col("found").alias("strict_found"), F.col("recall").alias("strict_recall"), F.lit(1).alias("k"))
    out = out.join(assisted.select(F.col("found").alias("assisted_found"), F.col("recall").alias("assisted_recall"), F.lit(1).alias("k")), "k")
    out = out.join(counted.agg(F.count(F.lit(1)).alias("counted")).withColumn("k", F.lit(1)), "k").join(right.withColumn("k", F.lit(1)), "k")
    return out.select("planted", "strict_found", "strict_recall", "assisted_found", "assisted_recall", "counted", "right", percent(F.col("right"), F.col("counted")).alias("precision"))


_SQL = r"""
WITH norm AS (SELECT l_orderkey AS packet_id, l_linenumber AS page, l_linestatus AS lens, l_partkey, l_suppkey, l_tax, l_discount, l_quantity, l_returnflag, l_linenumber + CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS cpage FROM lineitem),
planted AS (SELECT DISTINCT packet_id, page || '-' || l_partkey || '-' || l_suppkey AS id, page, lens, 'part' || l_partkey AS q FROM norm WHERE l_returnflag = 'R'),
findings AS (SELECT packet_id, cpage AS page, 'thepart' || l_partkey || 'late' AS q FROM norm WHERE l_discount >= 0.05),
uncertain AS (SELECT packet_id, cpage AS page, 'thepart' || l_partkey || 'late' AS q FROM norm WHERE l_discount < 0.05 AND l_quantity > 25),
ignored AS (SELECT DISTINCT packet_id, cpage AS page, 'thepart' || l_partkey || 'late' AS q FROM norm WHERE l_tax = 0.08),
strict AS (SELECT p.* FROM planted p WHERE EXISTS (SELECT 1 FROM findings c WHERE c.packet_id = p.packet_id AND abs(c.page - p.page) <= 1 AND (contains(c.q, p.q) OR contains(p.q, c.q)))),
assisted AS (SELECT p.* FROM planted p WHERE EXISTS (SELECT 1 FROM (SELECT * FROM findings UNION ALL SELECT * FROM uncertain) c WHERE c.packet_id = p.packet_id AND abs(c.page - p.page) <= 1 AND (contains(c.q, p.q) OR contains(p.q, c.q)))),
counted AS (SELECT f.* FROM findings f WHERE NOT EXISTS (SELECT 1 FROM ignored c WHERE c.packet_id = f.packet_id AND abs(c.page - f.page) <= 1 AND (contains(c.q, f.q) OR contains(f.q, c.q)))),
right_ones AS (SELECT f.* FROM counted f WHERE EXISTS (SELECT 1 FROM planted p WHERE p.packet_id = f.packet_id AND abs(p.page - f.page) <= 1 AND (contains(f.q, p.q) OR contains(p.q, f.q))))
"""


def a02_recall_by_lens(spark: SparkSession, d: str) -> DataFrame:
    planted = _planted(spark, d)
    return recall_by(planted, detected(planted, _candidates(spark, d, FINDINGS), 1), "lens")


def a03_burden(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("packet_id"))
    return burden(_candidates(spark, d, FINDINGS).unionByName(_candidates(spark, d, UNCERTAIN)), orders)


def j01_gold_left_join_run(spark: SparkSession, d: str) -> DataFrame:
    gold = read(spark, d, "orders").select(F.col("o_orderkey").alias("packet_id"))
    run = _candidates(spark, d, FINDINGS).groupBy("packet_id").agg(F.count(F.lit(1)).alias("findings"))
    return gold.join(run, "packet_id", "left").select("packet_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.col("findings").isNotNull().alias("has_run"))


def j02_detected(spark: SparkSession, d: str) -> DataFrame:
    return detected(_planted(spark, d), _candidates(spark, d, FINDINGS), 1)


def j03_valid_candidates(spark: SparkSession, d: str) -> DataFrame:
    return valid_candidates(_candidates(spark, d, FINDINGS), _planted(spark, d), 1).groupBy("packet_id").agg(F.count(F.lit(1)).alias("n"))


def j04_without_ignored(spark: SparkSession, d: str) -> DataFrame:
    return without_ignored(_candidates(spark, d, FINDINGS), _ignored(spark, d), 1).groupBy("packet_id").agg(F.count(F.lit(1)).alias("n"))


def j05_reachable_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    pairs = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("anchor_page"), F.expr("l_linenumber + CAST(l_quantity / 10 AS INT)").alias("page")).distinct()
    sections = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start_page"), (F.col("l_linenumber") + 3).alias("end_page")).distinct()
    return sections_with_both(pairs, sections)


def t02_numeric_aware_sort(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "documents").select(F.col("source").alias("k")).distinct().union(read(spark, d, "nation").select(F.col("n_nationkey").cast("string")))
    from pyspark.sql import Window

    return keys.select("k", F.row_number().over(Window.orderBy(*numeric_aware("k"))).cast("long").alias("place"))


def u01_union_candidates(spark: SparkSession, d: str) -> DataFrame:
    tagged = _candidates(spark, d, FINDINGS).withColumn("kind", F.lit("finding")).unionByName(_candidates(spark, d, UNCERTAIN).withColumn("kind", F.lit("uncertain")))
    return tagged.groupBy("kind", "page").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "a01_recall_precision": a01_recall_precision,
    "a02_recall_by_lens": a02_recall_by_lens,
    "a03_burden": a03_burden,
    "j01_gold_left_join_run": j01_gold_left_join_run,
    "j02_detected": j02_detected,
    "j03_valid_candidates": j03_valid_candidates,
    "j04_without_ignored": j04_without_ignored,
    "j05_reachable_pairs": j05_reachable_pairs,
    "t02_numeric_aware_sort": t02_numeric_aware_sort,
    "u01_union_candidates": u01_union_candidates,
}

ORACLE_SQL = {
    "a01_recall_precision": _SQL + """
SELECT *, CASE WHEN counted > 0 THEN floor(1000.0 * "right" / counted + 0.5) / 10 END AS precision FROM (
SELECT planted, strict_found, floor(1000.0 * strict_found / planted + 0.5) / 10 AS strict_recall, assisted_found, floor(1000.0 * assisted_found / planted + 0.5) / 10 AS assisted_recall, counted, "right"
FROM (SELECT count(*) AS planted FROM planted), (SELECT count(*) AS strict_found FROM strict), (SELECT count(*) AS assisted_found FROM assisted), (SELECT count(*) AS counted FROM counted), (SELECT count(*) AS "right" FROM right_ones))
""",
    "a02_recall_by_lens": _SQL + """
SELECT lens, count(*) AS planted, count(s.id) AS found, floor(1000.0 * count(s.id) / count(*) + 0.5) / 10 AS recall
FROM planted p LEFT JOIN (SELECT packet_id, id FROM strict) s USING (packet_id, id) GROUP BY lens
""",
    "a03_burden": _SQL + """
SELECT avg(n) AS mean, CAST(quantile_disc(n, 0.9) AS BIGINT) AS p90, max(n) AS most FROM (
SELECT o_orderkey, count(c.packet_id) AS n FROM orders LEFT JOIN (SELECT * FROM findings UNION ALL SELECT * FROM uncertain) c ON c.packet_id = o_orderkey GROUP BY o_orderkey)
""",
    "j01_gold_left_join_run": _SQL + "SELECT o_orderkey AS packet_id, count(c.packet_id) AS findings, count(c.packet_id) > 0 AS has_run FROM orders LEFT JOIN findings c ON c.packet_id = o_orderkey GROUP BY o_orderkey",
    "j02_detected": _SQL + "SELECT packet_id, id FROM strict",
    "j03_valid_candidates": _SQL + "SELECT packet_id, count(*) AS n FROM findings f WHERE EXISTS (SELECT 1 FROM planted p WHERE p.packet_id = f.packet_id AND abs(p.page - f.page) <= 1 AND (contains(f.q, p.q) OR contains(p.q, f.q))) GROUP BY packet_id",
    "j04_without_ignored": _SQL + "SELECT packet_id, count(*) AS n FROM counted GROUP BY packet_id",
    "j05_reachable_pairs": """
WITH pairs AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS anchor_page, l_linenumber + CAST(trunc(l_quantity / 10) AS INT) AS page FROM lineitem),
s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS start_page, l_linenumber + 3 AS end_page FROM lineitem)
SELECT p.* FROM pairs p WHERE EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND s.start_page <= least(p.anchor_page, p.page) AND s.end_page >= greatest(p.anchor_page, p.page))
""",
    "t02_numeric_aware_sort": """
SELECT k, row_number() OVER (ORDER BY try_cast(k AS BIGINT) NULLS LAST, k) AS place
FROM (SELECT DISTINCT source AS k FROM documents UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation)
""",
    "u01_union_candidates": _SQL + "SELECT kind, page, count(*) AS n FROM (SELECT 'finding' AS kind, page FROM findings UNION ALL SELECT 'uncertain', page FROM uncertain) GROUP BY kind, page",
}
