"""Plans of a review and structural checks: passes to run, execution states, claims of missing items, omissions between aligned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions.unicode import nfkc
from galley.operators.alignment import align_items
from galley.sources.tables import cut, read

#: Least share of prose for the grammar pass, passes for candidates, budget of all passes.
PROSE, CANDIDATE_PASSES, BUDGET = 0.45, 2, 4


def review_plan(packets: DataFrame, budget: int = BUDGET) -> DataFrame:
    """packets (packet_id, prose_ratio, has_ref, gap, structure, high, ambiguous) with the passes to run and those that the budget skips.

    Prose asks for grammar, a gap against a reference for omissions, structure without that for layout; two of these at
    most. High severity asks for an independent review, ambiguity for adjudication.
    """
    omission = F.col("has_ref") & F.col("gap")
    first = F.filter(F.array(F.when(F.col("prose_ratio") >= PROSE, "grammar_prose"), F.when(omission, "translation_omission"), F.when(F.col("structure") & ~omission, "structure_layout")), lambda x: x.isNotNull())
    later = F.filter(F.array(F.when(F.col("high"), "independent_review"), F.when(F.col("ambiguous"), "adjudication")), lambda x: x.isNotNull())
    wanted = F.concat(F.slice(first, 1, CANDIDATE_PASSES), later)
    return packets.withColumn("wanted", wanted).select("packet_id", F.slice("wanted", 1, budget).alias("passes"), F.slice("wanted", budget + 1, 10).alias("skipped"))


def execution_state(target: Column, checked: Column, failed: Column) -> Column:
    """complete, partial, failed or not_run, from arrays of pages."""
    done = F.size(F.array_intersect(target, checked))
    return F.when((F.size(target) > 0) & (done == F.size(target)), "complete").when(F.size(failed) > 0, "failed").when(done > 0, "partial").otherwise("not_run")


# Ways to say that a number is missing, quotation marks, a numbered line, shortest text that identifies an item.
SAYS_MISSING = (
    r"(?i)(?:項番|見出し番号|番号)\s*(?:が|の|は)?\s*([0-9]{1,3})\s*(?:を|が|は)?\s*(?:欠|抜|欠落|存在しな|見当たら|ない|ありません|無い|飛ん)",
    r"(?i)(?:missing|omitted|skipped|absent)\s+(?:item|section|number|no\.?\s*)?\s*([0-9]{1,3})",
    r"(?i)(?:item|section|number|no\.?)\s*([0-9]{1,3})\s+(?:is\s+)?(?:missing|omitted|skipped|absent)",
)
QUOTED = ("「([^」]{6,240})」", "『([^』]{6,240})』", "“([^”]{6,240})”", '"([^"\r\n]{6,240})"')
NUMBERED_LINE, LEAST_BODY = r"^\s*[(\[]?\s*([0-9]{1,3})\s*[)\].:：]\s*(.+)$", 12


def _body(c: Column) -> Column:
    """What of an item's text identifies it: letters and digits without bullets and the item's own number."""
    text = F.regexp_replace(F.lower(nfkc(c)), r"^[\s\-‐‑‒–—―•・*]+", "")
    return F.regexp_replace(F.regexp_replace(text, r"^[\s(\[]*[0-9]{1,3}\s*[)\].．:：-]\s*", ""), "[^a-z0-9ぁ-んァ-ヶー一-龠々〆〇]+", "")


def contradicted_missing(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Ids of findings (id, doc_id, page, quote, issue, reason, suggestion) that say item N is missing although their page has that very item.

    An unrelated line N does not do: its body and one that the finding quotes must be equal or contain one another, and
    each be 12 letters or more. A finding that quotes no such body stays. Nulls are empty.
    """
    full = lambda *names: nfkc(F.concat_ws(" ", *(F.coalesce(n, F.lit("")) for n in names)))
    told = findings.withColumn("told", full("issue", "reason"))
    numbers = F.array_distinct(F.concat(*(F.transform(F.regexp_extract_all("told", F.lit(p), F.lit(1)), lambda x: x.cast("int")) for p in SAYS_MISSING)))
    quotes = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)) for c in ("issue", "reason", "suggestion") for p in QUOTED]
    said = told.select("id", "doc_id", "page", numbers.alias("numbers"), F.concat(F.array(F.coalesce("quote", F.lit(""))), *quotes).alias("texts")).where(F.size("numbers") > 0)
    bodies = said.withColumn("text", F.explode("texts")).withColumn("quoted", _body(F.col("text"))).where(F.length("quoted") >= LEAST_BODY)
    claims = bodies.select("id", "doc_id", "page", "quoted", F.explode("numbers").alias("number")).distinct()
    line = nfkc(F.coalesce("line", F.lit("")))
    real = lines.withColumn("folded", line).where(F.col("folded").rlike(NUMBERED_LINE))
    real = real.select("doc_id", "page", F.regexp_extract("folded", NUMBERED_LINE, 1).cast("int").alias("number"), _body(F.regexp_extract("folded", NUMBERED_LINE, 2)).alias("body")).where(F.length("body") >= LEAST_BODY).distinct()
    meet = claims.join(real, ["doc_id", "page", "number"]).where(F.contains("body", "quoted") | F.contains("quoted", "body"))
    return meet.select("id").distinct()


# Scores from which blocks count as a pair and items as the same, roles whose items are compared.
PAIRED, SAME_ITEM, ITEMISED = 0.65, 0.8, ("list", "list-item", "table", "table-row")


def item_omissions(pairs: DataFrame, targets: DataFrame, target_items: DataFrame, reference_items: DataFrame) -> DataFrame:
    """(doc_id, target, reference, idx, text): items of a reference list or table that its paired target block lacks.

    pairs are (doc_id, target, reference, score) of blocks, targets (doc_id, id, role), items (doc_id, block, idx, text).
    Items are aligned within their pair; what of the reference is left over is missing. Where no item at all has a
    counterpart, as between two languages, only the items beyond the target's number are. Blocks without items say nothing.
    """
    role = targets.where(F.col("role").isin(*ITEMISED)).select("doc_id", F.col("id").alias("target"))
    met = pairs.where(F.col("score") >= PAIRED).join(role, ["doc_id", "target"], "left_semi").select("doc_id", "target", "reference").distinct()
    key = F.to_json(F.struct("doc_id", "target", "reference"))
    side = lambda items, name: met.join(items.withColumnRenamed("block", name), ["doc_id", name]).select("doc_id", "target", "reference", key.alias("pair"), "idx", "text")
    t, r = side(target_items, "target"), side(reference_items, "reference")
    counted = t.groupBy("pair").agg(F.count(F.lit(1)).alias("there"))
    r = cut(r.join(counted, "pair").withColumn("nth", F.row_number().over(Window.partitionBy("pair").orderBy("idx"))))
    in_pair = lambda df: df.select(F.col("pair").alias("doc_id"), "idx", "text")
    edges = cut(align_items(in_pair(t.join(r.select("pair").distinct(), "pair", "left_semi")), in_pair(r), SAME_ITEM).withColumnRenamed("doc_id", "pair"))
    some = edges.where(~F.col("relation").isin("unmatched_target", "unmatched_reference")).select("pair").distinct().withColumn("some", F.lit(True))
    lone = edges.where("relation = 'unmatched_reference'").select("pair", F.get("references", F.lit(0)).alias("idx")).withColumn("lone", F.lit(True))
    judged = r.join(some, "pair", "left").join(lone, ["pair", "idx"], "left")
    return judged.where(F.when(F.col("some"), F.coalesce("lone", F.lit(False))).otherwise(F.col("nth") > F.col("there"))).select("doc_id", "target", "reference", "idx", "text")


def footnote_omissions(targets: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, reference, text): footnotes of a reference without a counterpart, in documents whose target has no footnote at all (one may stand on another page). Blocks are (doc_id, id, role, text)."""
    block = lambda df: df.select("doc_id", F.col("id").alias("idx"), "text")
    bare = references.join(targets.where("role = 'footnote'").select("doc_id").distinct(), "doc_id", "left_anti")
    notes = bare.where("role = 'footnote'")
    near = targets.join(notes.select("doc_id").distinct(), "doc_id", "left_semi")
    lone = align_items(block(near), block(notes)).where("relation = 'unmatched_reference'").select("doc_id", F.get("references", F.lit(0)).alias("id"))
    return notes.join(lone, ["doc_id", "id"]).select("doc_id", F.col("id").alias("reference"), "text")


def t07_review_plan(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    p = li.select(F.col("l_orderkey").alias("packet_id"), (F.col("l_discount") * 10).alias("prose_ratio"), (F.col("l_returnflag") == "A").alias("has_ref"), (F.col("l_tax") > 0.04).alias("gap"), (F.col("l_tax") > 0.02).alias("structure"), (F.col("l_linestatus") == "F").alias("high"), (F.col("l_quantity") > 25).alias("ambiguous"))
    plan = review_plan(p, 3)
    return plan.select(F.array_join("passes", ",").alias("passes"), F.array_join("skipped", ",").alias("skipped")).groupBy("passes", "skipped").agg(F.count(F.lit(1)).alias("n"))


def a14_execution_state(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<int>")
    one = F.array("l_linenumber")
    state = execution_state(F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1), F.when(F.col("l_tax") > 0.05, F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1)).when(F.col("l_tax") > 0.03, one).otherwise(none), F.when(F.col("l_discount") > 0.07, one).otherwise(none))
    return read(spark, d, "lineitem").select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def f21_contradicted_missing(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    n, part = F.col("l_quantity").cast("int").cast("string"), (F.col("l_partkey") % 4).cast("string")
    body = F.concat(F.lit("terms of delivery "), part)
    issue = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Missing item "), n)).when(F.col("l_tax") > 0.04, F.concat(F.lit("項番"), n, F.lit("が欠落"))).otherwise(F.concat(F.lit("no. "), n, F.lit(" differs")))
    quoted = F.when(F.col("l_discount") > 0.03, body)
    reason = F.when(F.col("l_discount") <= 0.01, F.concat(F.lit("It says 「（"), n, F.lit("）Terms of Delivery, "), part, F.lit("」.")))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    f = li.where("l_returnflag = 'R'").select(key.alias("id"), F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), quoted.alias("quote"), issue.alias("issue"), reason.alias("reason"), F.lit(None).cast("string").alias("suggestion"))
    lines = li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat(F.lit(" ("), n, F.lit(") The "), body, F.lit(" and more")).alias("line"))
    return contradicted_missing(f, lines)


def _order_items(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.max("l_tax").alias("tax"))
    text = F.concat(F.lit("line"), "l_linenumber", F.lit(" part"), "part", F.lit(" ship"), "supp")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("block"), F.col("l_linenumber").cast("long").alias("idx"), text.alias("text"), "tax")


def l11_item_omissions(spark: SparkSession, d: str) -> DataFrame:
    """Orders are pairs of blocks and their lines items; some lines are not in the target, a quarter of the targets are in another language."""
    items, o = _order_items(spark, d), read(spark, d, "orders")
    blocks = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("id"), F.when(F.col("o_orderstatus") == "P", "paragraph").when(F.col("o_orderstatus") == "F", "list").otherwise("table").alias("role"))
    pairs = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("target"), F.lit(1).alias("reference"), F.when(F.col("o_orderpriority") == "1-URGENT", 0.6).otherwise(0.9).alias("score"))
    target = items.where("tax <= 0.05").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("zeile"), F.col("idx"), F.lit(" teil qq"), F.col("idx"))).otherwise(F.col("text")))
    return item_omissions(pairs, blocks, target, items).select("doc_id", "idx", "text")


def l11_footnote_omissions(spark: SparkSession, d: str) -> DataFrame:
    items = _order_items(spark, d).withColumnRenamed("idx", "id")
    kind = lambda flag: F.when(flag, "footnote").otherwise("paragraph").alias("role")
    target = items.where("tax <= 0.05").select("doc_id", "id", kind((F.col("doc_id") % 3 == 0) & (F.col("tax") > 0.03)), "text")
    return footnote_omissions(target, items.select("doc_id", "id", kind(F.col("tax") > 0.02), "text")).withColumnRenamed("reference", "idx")


QUERIES = {f.__name__: f for f in (t07_review_plan, a14_execution_state, f21_contradicted_missing, l11_item_omissions, l11_footnote_omissions)}

ORACLE_SQL = {
    "t07_review_plan": """
WITH w AS (SELECT list_concat(list_slice(list_filter([CASE WHEN l_discount * 10 >= 0.45 THEN 'grammar_prose' END, CASE WHEN l_returnflag = 'A' AND l_tax > 0.04 THEN 'translation_omission' END, CASE WHEN l_tax > 0.02 AND NOT (l_returnflag = 'A' AND l_tax > 0.04) THEN 'structure_layout' END], lambda x: x IS NOT NULL), 1, 2),
  list_filter([CASE WHEN l_linestatus = 'F' THEN 'independent_review' END, CASE WHEN l_quantity > 25 THEN 'adjudication' END], lambda x: x IS NOT NULL)) AS p FROM lineitem)
SELECT coalesce(array_to_string(list_slice(p, 1, 3), ','), '') AS passes, coalesce(array_to_string(list_slice(p, 4, 13), ','), '') AS skipped, count(*) AS n FROM w GROUP BY 1, 2
""",
    "a14_execution_state": "SELECT CASE WHEN l_tax > 0.05 THEN 'complete' WHEN l_discount > 0.07 THEN 'failed' WHEN l_tax > 0.03 THEN 'partial' ELSE 'not_run' END AS state, count(*) AS n FROM lineitem GROUP BY 1",
    "f21_contradicted_missing": """
SELECT DISTINCT f.l_orderkey || '-' || f.l_linenumber || '-' || f.l_partkey || '-' || f.l_suppkey AS id FROM lineitem f JOIN lineitem r ON f.l_suppkey = r.l_suppkey AND f.l_linenumber = r.l_linenumber
  AND trunc(f.l_quantity) = trunc(r.l_quantity) AND f.l_partkey % 4 = r.l_partkey % 4 AND f.l_returnflag = 'R' AND r.l_returnflag = 'A' AND (f.l_linestatus = 'F' OR f.l_tax > 0.04) AND (f.l_discount > 0.03 OR f.l_discount <= 0.01)
""",
    "l11_item_omissions": """
WITH i AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS idx, 'line' || l_linenumber || ' part' || min(l_partkey) || ' ship' || min(l_suppkey) AS text, max(l_tax) <= 0.05 AS there FROM lineitem GROUP BY 1, l_linenumber),
n AS (SELECT *, count(*) FILTER (WHERE there) OVER (PARTITION BY doc_id) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS nth FROM i)
SELECT doc_id, idx, text FROM n JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' AND k > 0 AND CASE WHEN doc_id % 4 = 0 THEN nth > k ELSE NOT there END
""",
    "l11_footnote_omissions": """
WITH i AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS idx, 'line' || l_linenumber || ' part' || min(l_partkey) || ' ship' || min(l_suppkey) AS text, max(l_tax) AS tax FROM lineitem GROUP BY 1, l_linenumber)
SELECT doc_id, idx, text FROM i WHERE tax > 0.05 AND doc_id NOT IN (SELECT doc_id FROM i WHERE doc_id % 3 = 0 AND tax > 0.03 AND tax <= 0.05)
""",
}
