"""Similarity alignment of two documents, and the candidate ledger.

Candidates come from an equi-join on shared tokens (within the group, e.g. a page), never from a cross join: two texts
without a common token have similarity 0, below any bar that is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.sources.tables import cut, read

#: Fixed values.
MIN_SCORE, NEAR_BEST, MOST, UNSURE = 0.55, 0.15, 3, 0.72
CONTAINED, PREFIX = 0.82, 0.15
#: Different texts of a document's smaller side up to which each is compared with all of the other side.
FEW = 16
#: Weight of roles in the score of two pages, and the distance up to which their nearness counts.
ROLE_SHARE, ROLE_REACH = 0.18, 5


def normal_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def tokens(norm: Column) -> Column:
    return F.filter(F.array_distinct(F.split(norm, " ")), lambda t: t != "")


def similarity_of(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Of normalised texts a and b with token sets ta and tb."""
    na, nb, common = F.size(ta), F.size(tb), F.size(F.array_intersect(ta, tb))
    jac = common / F.greatest(na + nb - common, F.lit(1))
    least = F.least(na, nb)
    prefix = F.when(F.startswith(a, b) | F.startswith(b, a), PREFIX).otherwise(0.0)
    long = F.least(F.lit(1.0), F.greatest(jac, CONTAINED * common / F.greatest(least, F.lit(1))) + prefix)
    return F.when(least == 0, 0.0).when(least <= 2, F.when(a == b, 1.0).otherwise(jac)).otherwise(long)


def similarity(a: Column, b: Column) -> Column:
    na, nb = normal_text(a), normal_text(b)
    return similarity_of(na, nb, tokens(na), tokens(nb))


def role_signature(roles: Column) -> Column:
    return F.concat_ws(">", roles)


def align_items(targets: DataFrame, references: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Edges (doc_id, target, references, relation, score, ambiguous) between items (doc_id, idx, text) of two documents.

    Per target, the references within 0.15 of the best and at or over the bar, three at most; items left over are edges
    of their own (unmatched_target, unmatched_reference). Items of one normalised text score alike, so only different texts
    are compared, and of a reference text only the first three items can be kept. Where a side of a document has few texts,
    each is compared with all of the other side, beside the document; elsewhere two texts at the bar share a known part of
    the smaller one's tokens, so one of its rarer ones: only these are joined with all tokens of the other side, and common
    words make no pairs. No side is broadcast: sizes are told from packed files, which are much smaller than their texts.
    """
    doc = Window.partitionBy("doc_id")

    def prep(df: DataFrame, i: str, p: str) -> DataFrame:
        """Items with the number of their text in the document (k), their place among the items of that text and the number of these."""
        same = Window.partitionBy("doc_id", p)
        items = df.select("doc_id", F.col("idx").alias(i), normal_text(F.col("text")).alias(p)).repartition("doc_id")
        return items.withColumn("nth", F.row_number().over(same.orderBy(i))).withColumn("size", F.count(F.lit(1)).over(same)).withColumn("k", F.dense_rank().over(doc.orderBy(p)))

    t, r = prep(targets, "t", "a"), prep(references, "r", "b")
    first = [F.min(F.when(F.col("nth") == n, F.col("r"))).over(Window.partitionBy("doc_id", "b")) for n in range(1, MOST + 1)]
    texts = t.where("nth = 1").select("doc_id", F.col("k").alias("t"), "a", F.col("size").alias("copies"), tokens(F.col("a")).alias("a_tokens"), F.count(F.lit(1)).over(doc).alias("n_a"))
    others = r.withColumn("firsts", F.array_compact(F.array(*first))).where("nth = 1").select("doc_id", F.col("k").alias("r"), "b", "firsts", tokens(F.col("b")).alias("b_tokens"), F.count(F.lit(1)).over(doc).alias("n_b"))
    score = similarity_of(F.col("a"), F.col("b"), F.col("a_tokens"), F.col("b_tokens")).alias("score")
    beside = texts.join(others.hint("merge"), "doc_id").where(F.least("n_a", "n_b") <= FEW).select("doc_id", "t", "copies", "firsts", score).where(F.col("score") >= least)
    # documents with many texts on either side
    many_t, many_r = texts.where(F.col("n_a") > FEW), others.where(F.col("n_b") > FEW)
    te, re = (df.select("doc_id", i, F.explode(f"{p}_tokens").alias("token"), F.size(f"{p}_tokens").alias("size")) for df, i, p in ((many_t, "t", "a"), (many_r, "r", "b")))
    often = te.select("doc_id", "token").union(re.select("doc_id", "token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("often"))
    part = max(0.0, (least - PREFIX) / CONTAINED)  # of a set of three tokens or more; smaller ones need not be contained

    def rare(df: DataFrame, i: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("doc_id", i).orderBy("often", "token"))
        kept = F.when(F.col("size") <= 2, F.col("size")).otherwise(F.col("size") - F.ceil(F.col("size") * part - 1e-9) + 1)
        return df.join(often.hint("merge"), ["doc_id", "token"]).withColumn("place", place).where(F.col("place") <= kept).select("doc_id", i, "token")

    key = ["doc_id", "token"]
    shared = rare(te, "t").join(re.select("doc_id", "r", "token").hint("merge"), key).select("doc_id", "t", "r").union(te.select("doc_id", "t", "token").join(rare(re, "r").hint("merge"), key).select("doc_id", "t", "r")).distinct()
    apart = shared.join(many_t.hint("merge"), ["doc_id", "t"]).join(many_r.hint("merge"), ["doc_id", "r"]).select("doc_id", "t", "copies", "firsts", score).where(F.col("score") >= least)

    def best_of(scored: DataFrame) -> DataFrame:
        w = Window.partitionBy("doc_id", "t")
        near = scored.withColumn("best", F.max("score").over(w)).where(F.col("score") >= F.greatest(F.lit(least), F.col("best") - NEAR_BEST))
        ranked = near.select("doc_id", "t", "copies", "score", F.explode("firsts").alias("r")).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "r"))).where(F.col("rank") <= MOST)
        return ranked.withColumn("shared", F.sum("copies").over(Window.partitionBy("doc_id", "r")))

    kept = best_of(beside).union(best_of(apart))
    g = kept.groupBy("doc_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "r"))), lambda x: x["r"]).alias("references"), (F.floor(F.avg("score") * 10000 + 0.5) / 10000).alias("score"), F.count(F.lit(1)).alias("n"), F.max("shared").alias("shared"))
    relation = F.when(F.col("n").isNull(), "unmatched_target").when(F.col("n") > 1, "1:n").when(F.col("shared") > 1, "n:1").otherwise("1:1")
    none = F.array().cast("array<bigint>")
    edges = t.select("doc_id", F.col("t").alias("target"), F.col("k").alias("t")).join(g.hint("merge"), ["doc_id", "t"], "left")
    edges = edges.select("doc_id", "target", F.coalesce(F.col("references").cast("array<bigint>"), none).alias("references"), relation.alias("relation"), F.coalesce("score", F.lit(0.0)).alias("score"))
    lone_r = references.select("doc_id", F.col("idx").alias("r")).join(kept.select("doc_id", "r").hint("merge"), ["doc_id", "r"], "left_anti").select("doc_id", F.lit(None).cast("bigint").alias("target"), F.array(F.col("r").cast("bigint")).alias("references"), F.lit("unmatched_reference").alias("relation"), F.lit(0.0).alias("score"))
    every = edges.union(lone_r)
    return every.withColumn("ambiguous", F.col("relation").isin("1:n", "n:1") | ((F.col("score") > 0) & (F.col("score") < UNSURE)))


def page_bias(distance: Column) -> Column:
    return F.when(distance == 0, 0.18).when(distance == 1, 0.10).otherwise(F.greatest(F.lit(0.0), 0.06 - 0.01 * distance))


def _bias(distance: int) -> float:
    return {0: 0.18, 1: 0.10}.get(distance, max(0.0, 0.06 - 0.01 * distance))


def align_pages(targets: DataFrame, references: DataFrame, least: float = 0.28) -> DataFrame:
    """One edge per kept reference page: pages (doc_id, page, text, roles) scored by content, roles and distance.

    Texts are normalised once a page. Without a common word in their texts, two pages reach the bar by roles and distance
    alone, so only as near neighbours. A document is joined by words and neighbours where that makes fewer pairs than
    comparing all its pages.
    """
    def prep(df: DataFrame, i: str, p: str) -> DataFrame:
        made = df.select("doc_id", F.col("page").alias(i), normal_text(F.col("text")).alias(p), normal_text(F.col("roles")).alias(f"r{p}"))
        return cut(made.select(F.monotonically_increasing_id().alias(f"{i}_row"), "*", tokens(F.col(p)).alias(f"{p}_tokens"), tokens(F.col(f"r{p}")).alias(f"r{p}_tokens")))

    t, r = prep(targets, "t", "a"), prep(references, "r", "b")
    words = lambda df, i, p: df.select("doc_id", f"{i}_row", F.explode(f"{p}_tokens").alias("token"))
    te, re = words(t, "t", "a"), words(r, "r", "b")
    counted = lambda df, keys, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    met = counted(te, ["doc_id", "token"], "n").join(counted(re, ["doc_id", "token"], "m"), ["doc_id", "token"]).groupBy("doc_id").agg(F.sum(F.col("n") * F.col("m")).alias("met"))
    sizes = counted(t, ["doc_id"], "n").join(counted(r, ["doc_id"], "m"), "doc_id").join(met, "doc_id", "left")
    reach = [k for k in range(ROLE_REACH + 1) if ROLE_SHARE + _bias(k) >= least - 1e-9]
    sparse = (F.coalesce("met", F.lit(0)) < F.col("n") * F.col("m")) if least > ROLE_SHARE else F.lit(False)
    sizes = cut(sizes.select("doc_id", sparse.alias("sparse")))
    few, all_ = sizes.where("sparse").select("doc_id"), sizes.where("not sparse").select("doc_id")
    near = t.select("doc_id", "t_row", F.explode(F.array(*(F.col("t") + s * k for k in reach for s in ((1, -1) if k else (1,)))) if reach else F.expr("CAST(array() AS array<bigint>)")).alias("r"))
    linked = te.join(few, "doc_id", "left_semi").join(re.hint("merge"), ["doc_id", "token"]).select("t_row", "r_row")
    linked = linked.union(near.join(few, "doc_id", "left_semi").join(r.select("doc_id", "r", "r_row").hint("merge"), ["doc_id", "r"]).select("t_row", "r_row")).distinct()
    pairs = linked.join(t.hint("merge"), "t_row").join(r.drop("doc_id").hint("merge"), "r_row").drop("t_row", "r_row").select("doc_id", *t.columns[2:], *r.columns[2:])
    pairs = pairs.union(t.join(all_, "doc_id", "left_semi").drop("t_row").join(r.drop("r_row").hint("merge"), "doc_id").select(pairs.columns))
    raw = 0.70 * similarity_of(F.col("a"), F.col("b"), F.col("a_tokens"), F.col("b_tokens")) + ROLE_SHARE * similarity_of(F.col("ra"), F.col("rb"), F.col("ra_tokens"), F.col("rb_tokens")) + page_bias(F.abs(F.col("t") - F.col("r")))
    scored = pairs.select("doc_id", "t", "r", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("doc_id", "t")
    s = scored.withColumn("best", F.max("score").over(w))
    s = s.withColumn("ties", F.sum((F.col("best") - F.col("score") <= 1e-9).cast("int")).over(w)).withColumn("near", F.sum((F.col("best") - F.col("score") <= 0.10).cast("int")).over(w))
    s = s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "r")))
    tied = (F.col("ties") > 1) & (F.col("best") - F.col("score") <= 1e-9) & (F.col("rank") <= MOST)
    close = (F.col("ties") <= 1) & (F.col("best") < 0.62) & (F.col("near") > 1) & (F.col("best") - F.col("score") <= 0.10) & (F.col("rank") <= MOST)
    return s.where(tied | close | (F.col("rank") == 1)).select("doc_id", F.col("t").alias("target"), F.col("r").alias("reference"), (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


def stable_identity(*columns: Column) -> Column:
    """Parts in lower case, joined by |, nulls as empty."""
    return F.lower(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def merge_ledger(candidates: DataFrame) -> DataFrame:
    """candidates (fingerprint, arrival, severity, state, ...) merged: the first arrival gives the identity, a high severity sticks, the first decision wins."""
    first = lambda c: F.min_by(c, "arrival")
    decided = F.min_by(F.when(F.col("state") != "review_pending", F.col("state")), F.when(F.col("state") != "review_pending", F.col("arrival")))
    severity = F.when(F.bool_or(F.col("severity") == "high"), "high").otherwise(first("severity"))
    return candidates.groupBy("fingerprint").agg(first("arrival").alias("arrival"), severity.alias("severity"), F.coalesce(decided, F.lit("review_pending")).alias("state"), F.count(F.lit(1)).alias("merged"))


def suppress(candidates: DataFrame, suppressions: DataFrame, most: int = 200) -> DataFrame:
    """candidates (id, ...) with the reason of their suppression: the first one given; at most `most` distinct reasons are listed."""
    once = suppressions.groupBy("id").agg(F.min_by("reason", "arrival").alias("reason"), F.slice(F.array_sort(F.collect_set("reason")), 1, most).alias("reasons"))
    return candidates.join(once, "id", "left").withColumn("suppressed", F.col("reason").isNotNull())


def _parts(spark, d):
    words = F.concat_ws(" ", F.split("p_name", " ")[0], "p_type", "p_brand")
    return read(spark, d, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("idx"), words.alias("text"))


def x15_similarity(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", (F.floor(similarity(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(", ", "p_type", "p_brand")) * 10000 + 0.5) / 10000).alias("score"))


def j07_align_items(spark, d):
    p = _parts(spark, d)
    edges = align_items(p.where(F.col("text").contains("STEEL") | F.col("text").contains("BRASS") | (F.col("idx") < 0)), p)
    return edges.select("doc_id", "target", F.array_join(F.col("references").cast("array<string>"), ",").alias("references"), "relation", "score", "ambiguous")


def l12_edge_flags(spark, d):
    p = _parts(spark, d)
    edges = align_items(p, p.where(~F.col("text").contains("STEEL")))
    return edges.groupBy("doc_id").agg(F.bool_or(F.col("relation").startswith("unmatched")).alias("gap"), F.bool_or("ambiguous").alias("ambiguous"), F.count(F.lit(1)).alias("edges"))


def j06_align_pages(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("page"), F.col("s_name").alias("text"), F.lit("heading paragraph").alias("roles"))
    n = read(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("page"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("roles"))
    return align_pages(s, n, 0.2)


def u06_merge_ledger(spark, d):
    li = read(spark, d, "lineitem")
    c = li.select(stable_identity(F.col("l_partkey"), F.col("l_returnflag")).alias("fingerprint"), (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("arrival"), F.when(F.col("l_discount") > 0.09, "high").otherwise("medium").alias("severity"), F.when(F.col("l_tax") > 0.07, F.when(F.col("l_linestatus") == "O", "accepted").otherwise("rejected")).otherwise("review_pending").alias("state"))
    return merge_ledger(c)


def u07_suppress(spark, d):
    li = read(spark, d, "lineitem")
    c = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    s = li.where("l_discount > 0.09").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("reason"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("arrival"))
    return suppress(c, s).select("id", "reason", F.array_join("reasons", ",").alias("reasons"), "suppressed")


_SIM = """
WITH p AS (SELECT p_size AS doc_id, p_partkey AS idx, trim(regexp_replace(lower(string_split(p_name, ' ')[1] || ' ' || p_type || ' ' || p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS a FROM part),
k AS (SELECT doc_id, idx, a, list_distinct(string_split(a, ' ')) AS w, contains(upper(a), 'STEEL') AS steel, contains(upper(a), 'BRASS') AS brass FROM p),
s AS (SELECT t.doc_id, t.idx AS t, r.idx AS r, t.steel AS ts, t.brass AS tb, r.steel AS rs, CASE WHEN least(len(t.w), len(r.w)) <= 2 THEN CASE WHEN t.a = r.a THEN 1 ELSE len(list_intersect(t.w, r.w)) / (len(t.w) + len(r.w) - len(list_intersect(t.w, r.w)))::DOUBLE END
  ELSE least(1.0, greatest(len(list_intersect(t.w, r.w)) / (len(t.w) + len(r.w) - len(list_intersect(t.w, r.w)))::DOUBLE, 0.82 * len(list_intersect(t.w, r.w)) / least(len(t.w), len(r.w))::DOUBLE) + CASE WHEN starts_with(t.a, r.a) OR starts_with(r.a, t.a) THEN 0.15 ELSE 0 END) END AS score
  FROM k t JOIN k r ON t.doc_id = r.doc_id)
"""


def _edges_sql(t: str, r: str, s: str) -> str:
    return f""",
q AS (SELECT *, max(score) OVER (PARTITION BY doc_id, t) AS best FROM s WHERE score >= 0.55 AND {s}),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY score DESC, r) AS rank FROM q WHERE score >= greatest(0.55, best - 0.15)) WHERE rank <= 3),
x AS (SELECT *, count(*) OVER (PARTITION BY doc_id, r) AS shared FROM v),
e AS (SELECT doc_id, t AS target, string_agg(CAST(r AS VARCHAR), ',' ORDER BY rank) AS "references", CASE WHEN count(*) > 1 THEN '1:n' WHEN max(shared) > 1 THEN 'n:1' ELSE '1:1' END AS relation, floor(avg(score) * 10000 + 0.5) / 10000 AS score FROM x GROUP BY doc_id, t
  UNION ALL SELECT doc_id, idx, '', 'unmatched_target', 0 FROM k WHERE {t} AND NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = k.doc_id AND v.t = k.idx)
  UNION ALL SELECT doc_id, NULL, CAST(idx AS VARCHAR), 'unmatched_reference', 0 FROM k WHERE {r} AND NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = k.doc_id AND v.r = k.idx)),
f AS (SELECT *, relation IN ('1:n', 'n:1') OR (score > 0 AND score < 0.72) AS ambiguous FROM e)
"""


QUERIES = {f.__name__: f for f in (x15_similarity, j06_align_pages, j07_align_items, l12_edge_flags, u06_merge_ledger, u07_suppress)}

ORACLE_SQL = {
    "x15_similarity": """
WITH k AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS a, trim(regexp_replace(lower(p_type || ', ' || p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS b FROM part),
w AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM k), n AS (SELECT *, len(list_intersect(x, y)) AS c FROM w)
SELECT p_partkey, floor(CASE WHEN least(len(x), len(y)) <= 2 THEN CASE WHEN a = b THEN 1 ELSE c / (len(x) + len(y) - c)::DOUBLE END ELSE least(1.0, greatest(c / (len(x) + len(y) - c)::DOUBLE, 0.82 * c / least(len(x), len(y))::DOUBLE) + CASE WHEN starts_with(a, b) OR starts_with(b, a) THEN 0.15 ELSE 0 END) END * 10000 + 0.5) / 10000 AS score FROM n
""",
    "j07_align_items": _SIM + _edges_sql("(steel OR brass)", "true", "(ts OR tb)") + "SELECT * FROM f",
    "l12_edge_flags": _SIM + _edges_sql("true", "NOT steel", "NOT rs") + "SELECT doc_id, bool_or(relation LIKE 'unmatched%') AS gap, bool_or(ambiguous) AS ambiguous, count(*) AS edges FROM f GROUP BY doc_id",
    "u06_merge_ledger": """
WITH c AS (SELECT lower(l_partkey || '|' || l_returnflag) AS fingerprint, l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey AS arrival, CASE WHEN l_discount > 0.09 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN l_tax > 0.07 THEN CASE WHEN l_linestatus = 'O' THEN 'accepted' ELSE 'rejected' END ELSE 'review_pending' END AS state FROM lineitem)
SELECT fingerprint, min(arrival) AS arrival, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE arg_min(severity, arrival) END AS severity, coalesce(arg_min(state, arrival) FILTER (WHERE state <> 'review_pending'), 'review_pending') AS state, count(*) AS merged FROM c GROUP BY fingerprint
""",
    "u07_suppress": """
SELECT o_orderkey AS id, reason, reasons, reason IS NOT NULL AS suppressed FROM orders LEFT JOIN (
SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) AS reason, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS reasons FROM lineitem WHERE l_discount > 0.09 GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""",
}
