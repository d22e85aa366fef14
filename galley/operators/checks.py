"""Checks of answers and layouts: page lists, heading numbers, footnote marks, fiscal years, running blocks, prompts, stages, glyphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions import glyphs
from galley.functions.unicode import nfkc
from galley.operators.cases import case_rows, case_sql
from galley.operators.findings import TRANSLATED
from galley.operators.text import date_keys, fold_width, year_keys
from galley.sources.tables import read

#: Verdicts of a page; longest page list, largest range and page number.
VERDICTS = ("finding", "unreadable", "skipped", "ok")
LONGEST, RANGE, PAGE = 2000, 10_000, 1_000_000


def page_checks(checks: DataFrame) -> DataFrame:
    """id, covered, missing, coverage, complete, errors of checks (id, ok_pages, exceptions: page and verdict, expected, found: pages with a finding).

    ok_pages is a list such as `7,10-13`. A page counts once, and only if it is expected; complete needs every expected
    page, some of them, and no error at all. Errors are kinds, sorted, each as often as it occurs.
    """
    text, none = F.coalesce("ok_pages", F.lit("")), F.array().cast("array<int>")
    expected = F.array_distinct(F.coalesce("expected", none))
    whole = F.when(F.length(text) > LONGEST, "too-long").when((F.trim(text) != "") & ~text.rlike(r"^[0-9,\s-]+$"), "characters")
    tokens = F.when(whole.isNotNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != ""))
    number = lambda t, p: F.regexp_extract(t, p, 1).try_cast("long")
    low, high = lambda t: number(t, r"^([0-9]+)"), lambda t: number(t, r"([0-9]+)$")
    is_range = lambda t: t.contains("-")

    def wrong(t: Column) -> Column:
        large = low(t).isNull() | high(t).isNull() | (low(t) < 1) | (high(t) > PAGE) | (high(t) - low(t) >= RANGE)
        outside = is_range(t) & (F.size(expected) > 0) & ((low(t) < F.array_min(expected)) | (high(t) > F.array_max(expected)))
        return F.when(~t.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$"), "token").when(low(t) > high(t), "descending").when(large, "large").when(outside, "outside")

    pages = F.flatten(F.transform(F.filter(tokens, lambda t: wrong(t).isNull()), lambda t: F.sequence(low(t).cast("int"), high(t).cast("int"))))
    inside = F.filter(pages, lambda p: F.array_contains(expected, p))
    ok = F.array_distinct(inside)
    said = F.coalesce("exceptions", F.array().cast("array<struct<page:int,verdict:string>>"))
    bad = lambda x: F.when(x["page"].isNull(), "page").when((F.size(expected) > 0) & ~F.array_contains(expected, x["page"]), "outside").when(~F.coalesce(x["verdict"], F.lit("")).isin(*VERDICTS), "verdict")
    sound = F.filter(said, lambda x: bad(x).isNull())
    errors = F.concat(
        F.filter(F.array(whole), lambda e: e.isNotNull()),
        F.filter(F.transform(tokens, wrong), lambda e: e.isNotNull()),
        F.array_repeat(F.lit("outside"), F.size(pages) - F.size(inside)),
        F.array_repeat(F.lit("duplicate"), F.size(inside) - F.size(ok)),
        F.filter(F.transform(said, bad), lambda e: e.isNotNull()),
        F.transform(F.filter(sound, lambda x: F.array_contains(ok, x["page"])), lambda x: F.lit("overlap")),
        F.transform(F.filter(sound, lambda x: (x["verdict"] == "finding") & ~F.array_contains(F.coalesce("found", none), x["page"])), lambda x: F.lit("no-finding")),
    )
    covered = F.array_sort(F.array_distinct(F.concat(ok, F.transform(sound, lambda x: x["page"]))))
    out = checks.select("id", covered.alias("covered"), F.array_sort(F.array_except(expected, covered)).alias("missing"), expected.alias("wanted"), F.array_sort(errors).alias("errors"))
    share = F.size("covered") / F.when(F.size("wanted") > 0, F.size("wanted")).otherwise(F.size("covered"))
    complete = (F.size("wanted") > 0) & (F.size("missing") == 0) & (F.size("covered") == F.size("wanted")) & (F.size("errors") == 0)
    return out.select("id", "covered", "missing", F.when(F.size("wanted") + F.size("covered") == 0, 1.0).otherwise(share).alias("coverage"), complete.alias("complete"), "errors")


INDEX = r"[（(]\s*[0-9]{1,3}\s*[）)]"


def heading_number_corrected(category: Column, scope: Column, quote: Column, suggestion: Column, reference: Column) -> Column:
    """A translated heading's number, `(2)` at its start, is corrected to the one that the reference starts with, and nothing else changes."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    sides = [nfkc(F.coalesce(c, F.lit(""))) for c in (quote, suggestion, reference)]
    number = lambda c: F.regexp_extract(c, r"\(\s*([0-9]{1,3})\s*\)", 1).try_cast("int")
    leads = lambda c: (F.regexp_count(c, F.lit(INDEX)) == 1) & c.rlike(rf"^\s*{INDEX}")
    rest = lambda c: low(F.regexp_replace(F.regexp_replace(c, INDEX, "#"), r"\s+", " "))
    q, s, r = sides
    translated = low(category).isin(*TRANSLATED) | (low(scope) == "translation_consistency")
    return translated & leads(q) & leads(s) & leads(r) & F.coalesce((number(q) != number(s)) & (number(r) == number(s)), F.lit(False)) & (rest(q) == rest(s))


def footnote_marks(findings: DataFrame) -> DataFrame:
    """total, with_star, suspicious: findings (quote, reason) that speak of a footnote without a star but with a bare number, so a mark was lost."""
    text = F.concat_ws(" ", F.coalesce("quote", F.lit("")), F.coalesce("reason", F.lit("")))
    star = text.rlike("[*＊]")
    bare = text.rlike(r"(?i)脚注|footnote") & text.rlike(r"(?:^|[^0-9*＊※(（.])(?<!Note\s)(?<!P\.)[1-9](?![0-9年月日%．.,])")
    n = lambda c: F.count(F.when(c, 1))
    return findings.select(star.alias("star"), bare.alias("bare")).agg(F.count(F.lit(1)).alias("total"), n(F.col("star")).alias("with_star"), n(~F.col("star") & F.col("bare")).alias("suspicious"))


MARCH, NENDO = r"(?i)\bFY\s+March\s+((?:19|20)[0-9]{2})\b", r"(?<![0-9])((?:19|20)[0-9]{2})\s*年度"


def _years(c: Column, pattern: str, later: int) -> Column:
    found = F.regexp_extract_all(fold_width(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int") + later)))


def march_years(c: Column) -> Column:
    """Years of `FY March 2025`."""
    return _years(c, MARCH, 0)


def japanese_years(c: Column) -> Column:
    """Fiscal years of `2024年度` that end in March, so named by the year after."""
    return _years(c, NENDO, 1)


def fiscal_label(c: Column) -> Column:
    """`FY March 2025` as `FY2025`: the year itself does not change."""
    return F.regexp_replace(c, MARCH, "FY$1")


def fiscal_relation(target: Column, reference: Column) -> Column:
    """equivalent if the years of one side's March labels are the other's Japanese ones, all of them; conflict if both have some that differ; none without any."""
    pair = lambda m, j: F.when((F.size(m) == 0) | (F.size(j) == 0), "none").when(m == j, "equivalent").otherwise("conflict")
    one, two = pair(march_years(target), japanese_years(reference)), pair(march_years(reference), japanese_years(target))
    return F.when((one == "conflict") | (two == "conflict"), "conflict").when((one == "equivalent") | (two == "equivalent"), "equivalent").otherwise("none")


def fiscal_label_only(category: Column, quote: Column, said: Column, reference: Column) -> Column:
    """A date mismatch that is only one of fiscal labels: one March year on the target's side, which the reference has as a Japanese one, and all other dates of the quotes the same."""
    march = march_years(F.concat_ws(" ", quote, said))
    rest = lambda c, p: F.regexp_replace(fold_width(F.coalesce(c, F.lit(""))), p, " ")
    q, r = rest(quote, MARCH), rest(reference, NENDO)
    return (F.lower(F.coalesce(category, F.lit(""))) == "date_mismatch") & (F.size(march) == 1) & F.array_contains(japanese_years(reference), F.coalesce(march[0], F.lit(0))) & (year_keys(q) == year_keys(r)) & (date_keys(q) == date_keys(r))


def apply_running(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """blocks (doc_id, page, order, role, key, text) with the role of headers and footers whose key (doc_id, key) is repeated made running, others marginal."""
    side = F.regexp_extract("role", "^(?:marginal|running)-(header|footer)$", 1)
    marked = blocks.join(repeated.select("doc_id", "key").distinct().withColumn("again", F.lit(True)), ["doc_id", "key"], "left")
    return marked.withColumn("role", F.when(side == "", F.col("role")).otherwise(F.concat(F.when(F.col("again"), "running-").otherwise("marginal-"), side))).drop("again")


#: Lines of a document that would pass for the prompt's own, and the mark put before them.
RESERVED = r"(?i)^\s*(?:=====\s+(?:PDF\s+P\.[0-9]+|APP\s+LAYOUT\s+BLOCK)\s+/|APP_TABLE_CONTEXT\s*:|LAYOUT_STATUS:|TARGET_CHECK(?:_FAST_REVIEW_INDEX)?\s*:|TARGET_CONTEXT\s*:|REF[0-9]*_?CANDIDATE\s*:)"
QUOTED = "［PDF本文］"


def protect_lines(c: Column) -> Column:
    lines = F.split(F.coalesce(c, F.lit("")), "\r?\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(RESERVED), F.concat(F.lit(QUOTED), x)).otherwise(x)), "\n")


def page_prompts(blocks: DataFrame, context: Column | None = None) -> DataFrame:
    """(doc_id, page, prompt): the blocks in order, running headers and footers left out, each under a marker line that no source line can forge; context: a text between marker and block."""
    shown = blocks.where(~F.coalesce(F.col("role"), F.lit("")).isin("running-header", "running-footer"))
    body = F.concat(F.lit("===== APP LAYOUT BLOCK / "), F.upper(F.coalesce("role", F.lit("body"))), F.lit(" =====\n"), F.coalesce(context, F.lit("")) if context is not None else F.lit(""), protect_lines(F.col("text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("order", body.alias("body")))), lambda b: b["body"])
    return shown.groupBy("doc_id", "page").agg(F.trim(F.array_join(parts, "\n\n")).alias("prompt"))


def stage_contract(packets: DataFrame) -> DataFrame:
    """(job_id, ok): the stages of a job's packets (stage, total) are 1 to their total without a gap, and all totals agree."""
    n = F.count_distinct("stage")
    ok = (F.min("stage") == 1) & (F.max("stage") == n) & (F.count_distinct("total") == 1) & (F.max("total") == n) & (F.count("stage") == F.count(F.lit(1))) & (F.count("total") == F.count(F.lit(1)))
    return packets.groupBy("job_id").agg(F.coalesce(ok, F.lit(False)).alias("ok"))


#: Pages between a block and its translation, and the weight of a pair by distance and without any common words.
NEAR_PAGES, SAME_PAGE, APART, STEP, LEAST_APART, UNLIKE = 3, 1.0, 0.78, 0.08, 0.55, 0.7


def _page_score(a: Column, b: Column) -> Column:
    """1 on the same page, less on one of the next three, 0.65 where a page is unknown, null beyond."""
    far = F.abs(a - b)
    return F.when(far.isNull(), 0.65).when(far == 0, SAME_PAGE).when(far <= NEAR_PAGES, F.greatest(F.lit(LEAST_APART), APART - STEP * far))


def block_pairs(edges: DataFrame, targets: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, target, reference, score, by): aligned blocks of one role (edges: doc_id, target, references, score) on pages near one another; then, for each reference block left, in order, the first target block of its role that is near and free.

    Blocks: doc_id, id (their order), role, page. The second step depends on what was taken before, so a document's left
    blocks of one role stream through a task in order.
    """
    t = targets.select("doc_id", F.col("id").alias("target"), F.col("role").alias("t_role"), F.col("page").alias("t_page"))
    r = references.select("doc_id", F.col("id").alias("reference"), F.col("role").alias("r_role"), F.col("page").alias("r_page"))
    known = edges.where("target is not null").select("doc_id", "target", F.get("references", F.lit(0)).alias("reference"), F.col("score").alias("alike"))
    near = _page_score(F.col("t_page"), F.col("r_page"))
    met = known.join(t, ["doc_id", "target"]).join(r, ["doc_id", "reference"]).where(F.col("t_role") == F.col("r_role")).withColumn("near", near).where("near is not null")
    aligned = met.select("doc_id", "target", "reference", F.greatest("alike", "near").alias("score"), F.lit("words").alias("by"))
    left_t = t.join(aligned.select("doc_id", "target"), ["doc_id", "target"], "left_anti").select("doc_id", F.col("t_role").alias("role"), F.lit(0).alias("side"), F.col("target").alias("id"), F.col("t_page").alias("page"))
    left_r = r.join(aligned.select("doc_id", "reference"), ["doc_id", "reference"], "left_anti").select("doc_id", F.col("r_role").alias("role"), F.lit(1).alias("side"), F.col("reference").alias("id"), F.col("r_page").alias("page"))
    schema = pa.schema([("doc_id", pa.int64()), ("target", pa.int64()), ("reference", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free = None, []
        for b in batches:
            out = []
            for x in b.to_pylist():
                if key != (x["doc_id"], x["role"]):
                    key, free = (x["doc_id"], x["role"]), []
                if x["side"] == 0:
                    free.append(x)
                    continue
                hit = next((k for k, f in enumerate(free) if f["page"] is None or x["page"] is None or abs(f["page"] - x["page"]) <= NEAR_PAGES), None)
                if hit is not None:
                    out.append({"doc_id": x["doc_id"], "target": free.pop(hit)["id"], "reference": x["id"]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    left = left_t.union(left_r).select(*(F.col(c).cast("long").alias(c) if c != "role" else F.col(c) for c in ("doc_id", "role", "side", "id", "page")))
    greedy = left.repartition("doc_id", "role").sortWithinPartitions("doc_id", "role", "side", "id").mapInArrow(run, "doc_id long, target long, reference long")
    more = greedy.join(t, ["doc_id", "target"]).join(r, ["doc_id", "reference"]).select("doc_id", "target", "reference", F.greatest(F.lit(UNLIKE), _page_score(F.col("t_page"), F.col("r_page"))).alias("score"), F.lit("order").alias("by"))
    return aligned.union(more)


def counterparts(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, page, row): the only row (doc_id, page, row, text) of the document, on another page than the finding's, that has its text, white space aside; nothing if there are several."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s\x{3000}]+", " "))
    r = rows.select("doc_id", F.col("page").alias("p"), "row", plain(F.col("text")).alias("plain"))
    f = findings.select("id", "doc_id", "page", plain(F.col("quote")).alias("plain")).where("plain <> ''")
    hits = f.join(r, ["doc_id", "plain"]).where("p <> page").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("page"), F.min("row").alias("row"))
    return hits.where("n = 1").select("id", "page", "row")


def marked_items(items: DataFrame, function: Callable[[list[dict]], list[int]]) -> DataFrame:
    """(doc_id, page, source_index) of the items that a function of a page's items picks. Pages stream in order, one at a time."""
    columns = ["doc_id", "page", "source_index", "str", "x", "y", "width", "height", "font", "has_eol"]
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int64()), ("source_index", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def picked() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{c: held[k][c] for c in columns[:3]} for k in function(held)], schema=schema)

        for b in batches:
            for item in b.to_pylist():
                if held and (held[0]["doc_id"], held[0]["page"]) != (item["doc_id"], item["page"]):
                    yield picked()
                    held.clear()
                held.append(item)
        if held:
            yield picked()

    number = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)).alias(c)
    tidy = items.select(*(F.col(c).cast("long").alias(c) for c in columns[:3]), F.coalesce("str", F.lit("")).alias("str"), number("x", 0.0), number("y", 0.0), number("width", 0.1), number("height", 10.0), F.coalesce("font", F.lit("")).alias("font"), F.coalesce("has_eol", F.lit(False)).alias("has_eol"))
    return tidy.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "source_index").mapInArrow(run, "doc_id long, page long, source_index long")


# Orders stand for checks with known outcomes.

CHECKS = (
    ("7,10-13", [], [7, 10, 11, 12, 13], [], "7,10,11,12,13||1.0|true|"), ("7", [(8, "ok")], [7, 8], [], "7,8||1.0|true|"), ("7", [(8, "finding")], [7, 8], [], "7,8||1.0|false|no-finding"), ("7", [(8, "finding")], [7, 8], [8], "7,8||1.0|true|"),
    ("13-10", [], [10, 11], [], "|10,11|0.0|false|descending"), ("a", [], [1], [], "|1|0.0|false|characters"), ("1,1", [], [1], [], "1||1.0|false|duplicate"), ("1", [(1, "ok")], [1], [], "1||1.0|false|overlap"), ("9", [], [1], [], "|1|0.0|false|outside"),
    ("1-9", [], [1, 2], [], "|1,2|0.0|false|outside"), ("1", [(2, "odd"), (None, "ok"), (7, "ok")], [1, 2], [], "1|2|0.5|false|outside,page,verdict"), ("", [], [], [], "||1.0|false|"), (None, [(3, "skipped")], [], [], "3||1.0|false|"), ("1 - 2 , ,4", [], [1, 2, 4], [], "1,2,4||1.0|true|"),
    ("1-2-3", [], [1, 2, 3], [], "|1,2,3|0.0|false|token"), ("0", [], [1], [], "|1|0.0|false|large"), ("1" * 2001, [], [1], [], "|1|0.0|false|too-long"), ("99999999999999999999", [], [1], [], "|1|0.0|false|large"), ("1-3", [], [1, 3], [], "1,3||1.0|false|outside"),
)
HEADINGS = (
    ("mistranslation", None, "(2) Consolidated Cash Flows", "(3) Consolidated  cash flows", "(3) 連結キャッシュ・フロー", True), ("typo", None, "(2) Cash", "(3) Cash", "(3) 現金", False), ("typo", "translation_consistency", "(2) Cash", "(3) Cash", "（３） 現金", True),
    ("mistranslation", None, "(2) Cash", "(2) Cash", "(2) 現金", False), ("mistranslation", None, "(2) Cash", "(3) Cash", "(4) 現金", False), ("mistranslation", None, "Cash (2)", "Cash (3)", "(3) 現金", False), ("mistranslation", None, "(2) Cash of (5)", "(3) Cash of (5)", "(3) 現金", False),
    ("mistranslation", None, "(2) Cash", "(3) Cash flows", "(3) 現金", False), ("mistranslation", None, "(2) Cash", "(3) Cash", None, False), (None, None, None, None, None, False),
)
FISCAL = (
    ("FY March 2025", "2024年度", "equivalent"), ("FY March 2025", "2025年度", "conflict"), ("FY March 2025 and FY March 2024", "2024年度", "conflict"), ("FY2025", "2024年度", "none"), ("2024年度", "fy march 2025", "equivalent"), ("FY March ２０２５", "２０２４年度", "equivalent"), (None, "2024年度", "none"), ("FY March 2025", "", "none"),
)
LABELS = (
    ("date_mismatch", "compared to FY March 2014", "", "2013年度比", True), ("date_mismatch", "compared to FY March 2014", "", "2030年度目標（2013年度比）", True), ("date_mismatch", "FY March 2014, in 2020", "", "2013年度", False), ("typo", "FY March 2014", "", "2013年度", False), ("date_mismatch", "FY March 2014", "", "2014年度", False),
    ("date_mismatch", "compared", "use FY March 2014", "2013年度", True), ("date_mismatch", "FY March 2014 and FY March 2015", "", "2013年度と2014年度", False), ("date_mismatch", "FY March 2014 on May 7", "", "2013年度の5月7日", True), (None, None, None, None, False),
)
PROTECTED = (("TARGET_CHECK: x\nplain", "［PDF本文］TARGET_CHECK: x\nplain"), ("  ===== pdf P.3 / x", "［PDF本文］  ===== pdf P.3 / x"), ("a\r\nREF2_CANDIDATE : b", "a\n［PDF本文］REF2_CANDIDATE : b"), ("not TARGET_CHECK: x", "not TARGET_CHECK: x"), (None, ""), ("layout_status: ok", "［PDF本文］layout_status: ok"))


def x14_page_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = case_rows(spark, d, [c[:4] for c in CHECKS], "ok_pages string, exceptions array<struct<page:int,verdict:string>>, expected array<int>, found array<int>")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return page_checks(rows).select("id", F.concat_ws("|", text("covered"), text("missing"), F.col("coverage").cast("string"), F.col("complete").cast("string"), text("errors")).alias("checked"))


def f09_heading_numbers(spark, d):
    f = case_rows(spark, d, [c[:5] for c in HEADINGS], "category string, scope string, quote string, suggestion string, reference string")
    return f.select("id", heading_number_corrected(*(F.col(c) for c in ("category", "scope", "quote", "suggestion", "reference"))).alias("corrected"))


def x09_fiscal_relation(spark, d):
    return case_rows(spark, d, [c[:2] for c in FISCAL], "target string, reference string").select("id", fiscal_relation(F.col("target"), F.col("reference")).alias("relation"))


def x09_fiscal_label(spark, d):
    f = case_rows(spark, d, [c[:4] for c in LABELS], "category string, quote string, said string, reference string")
    return f.select("id", fiscal_label_only(*(F.col(c) for c in ("category", "quote", "said", "reference"))).alias("only"))


def l07_protect_lines(spark, d):
    return case_rows(spark, d, [c[:1] for c in PROTECTED], "text string").select("id", protect_lines(F.col("text")).alias("text"))


def a19_footnote_marks(spark, d):
    o = read(spark, d, "orders")
    quote = F.when(F.col("o_orderstatus") == "F", "see footnote 3 there").when(F.col("o_orderstatus") == "O", "see *3 there").otherwise("see 3 there")
    return footnote_marks(o.select(quote.alias("quote"), F.when(F.col("o_orderpriority") == "1-URGENT", "本文の脚注").otherwise("Note 3, P.4 (5)").alias("reason")))


def l06_apply_running(spark, d):
    li = read(spark, d, "lineitem")
    role = F.when(F.col("l_returnflag") == "A", "marginal-header").when(F.col("l_returnflag") == "R", "running-footer").otherwise("paragraph")
    b = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("order"), role.alias("role"), F.concat_ws("|", "l_returnflag", "l_linestatus").alias("key"), F.lit("x").alias("text"))
    repeated = b.where(F.col("role") != "paragraph").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n")).where("n >= 3")
    return apply_running(b, repeated).groupBy("doc_id", "role").agg(F.count(F.lit(1)).alias("n"))


def l07_page_prompts(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"))
    b = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("order"), F.when(F.col("flag") == "A", "running-header").when(F.col("flag") == "R", "table").alias("role"), F.concat(F.lit("REF_CANDIDATE: "), F.col("part").cast("string")).alias("text"))
    return page_prompts(b)


def o02_stage_contract(spark, d):
    li = read(spark, d, "lineitem")
    total = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    return stage_contract(li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage"), total.alias("total")))


def b12_counterparts(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_linenumber") * 10).alias("row"), F.concat(F.lit(" Part  "), F.col("flag")).alias("text"))
    f = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat(F.lit("part "), F.col("flag")).alias("quote"))
    return counterparts(rows, f)


def j09_block_pairs(spark, d):
    """Each order's lines are blocks; a reference lacks the first line. Edges join equal lines of the flag A; all others pair by order."""
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("id"), F.when(F.col("flag") == "A", "list").otherwise("table").alias("role"), F.lit(1).alias("page"))
    r = t.where("id > 1").withColumn("page", F.when(F.col("role") == "list", F.lit(2)).otherwise(F.lit(1)))
    edges = t.where("role = 'list'").select("doc_id", F.col("id").alias("target"), F.array("id").alias("references"), F.lit(0.5).alias("score"))
    return block_pairs(edges, t, r)


def _items(spark, d):
    """A page for each supplier's first orders: rows of letters 20 apart, those with a tax of 8 % printed twice."""
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("tax"), F.min("l_returnflag").alias("flag"))
    base = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_linenumber") * 2).alias("source_index"), F.col("flag").alias("str"), F.lit(100.0).alias("x"), (F.lit(500) - 20 * F.col("l_linenumber")).alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"), F.lit("f").alias("font"), F.lit(True).alias("has_eol"), "tax")
    again = base.where("tax >= 0.08").withColumn("source_index", F.col("source_index") + 1).withColumn("x", F.lit(100.1))
    return base.union(again).drop("tax")


def u09_overprints(spark, d):
    return marked_items(_items(spark, d), glyphs.overprints)


def w05_vertical_runs(spark, d):
    return marked_items(_items(spark, d).where("source_index % 2 = 0"), glyphs.vertical_runs)


QUERIES = {f.__name__: f for f in (x14_page_checks, f09_heading_numbers, x09_fiscal_relation, x09_fiscal_label, l07_protect_lines, a19_footnote_marks, l06_apply_running, l07_page_prompts, o02_stage_contract, b12_counterparts, j09_block_pairs, u09_overprints, w05_vertical_runs)}

_RUNS = """
WITH i AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM i)
SELECT doc_id, CAST(1 AS BIGINT) AS page, CAST(n * 2 AS BIGINT) AS source_index FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS k FROM g) WHERE k >= 3
"""

ORACLE_SQL = {
    "x14_page_checks": case_sql([c[4] for c in CHECKS], "checked"),
    "f09_heading_numbers": case_sql([c[5] for c in HEADINGS], "corrected"),
    "x09_fiscal_relation": case_sql([c[2] for c in FISCAL], "relation"),
    "x09_fiscal_label": case_sql([c[4] for c in LABELS], "only"),
    "l07_protect_lines": case_sql([c[1] for c in PROTECTED], "text"),
    "a19_footnote_marks": "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS with_star, count(*) FILTER (WHERE o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')) AS suspicious FROM orders",
    "l06_apply_running": """WITH b AS (SELECT l_suppkey AS doc_id, l_orderkey AS page, l_returnflag AS f, l_returnflag || '|' || l_linestatus AS key FROM lineitem), r AS (SELECT doc_id, key FROM b WHERE f <> 'N' GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3)
SELECT doc_id, CASE WHEN f = 'N' THEN 'paragraph' ELSE CASE WHEN (doc_id, key) IN (SELECT (doc_id, key) FROM r) THEN 'running-' ELSE 'marginal-' END || CASE f WHEN 'A' THEN 'header' ELSE 'footer' END END AS role, count(*) AS n FROM b GROUP BY 1, 2""",
    "l07_page_prompts": """SELECT doc_id, CAST(1 AS INT) AS page, string_agg('===== APP LAYOUT BLOCK / ' || CASE f WHEN 'R' THEN 'TABLE' ELSE 'BODY' END || ' =====' || chr(10) || '［PDF本文］REF_CANDIDATE: ' || part, chr(10) || chr(10) ORDER BY n) AS prompt
FROM (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_returnflag) AS f, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2) WHERE f <> 'A' GROUP BY 1""",
    "o02_stage_contract": "SELECT l_orderkey AS job_id, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AND count(*) = count(DISTINCT l_linenumber) AS ok FROM lineitem GROUP BY 1",
    "b12_counterparts": """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS p, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT a.k * 10 + a.p AS id, CAST(min(b.p) AS INT) AS page, CAST(min(b.p) * 10 AS INT) AS "row" FROM r a JOIN r b ON a.k = b.k AND a.f = b.f AND a.p <> b.p GROUP BY a.k, a.p HAVING count(*) = 1""",
    "j09_block_pairs": """WITH t AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS id, min(l_returnflag) = 'A' AS listed FROM lineitem GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS k FROM t WHERE NOT listed), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS k FROM t WHERE NOT listed AND id > 1)
SELECT doc_id, id AS target, id AS reference, 0.78 - 0.08 AS score, 'words' AS "by" FROM t WHERE listed AND id > 1 UNION ALL SELECT a.doc_id, a.id, b.id, 1.0, 'order' FROM a JOIN b ON a.doc_id = b.doc_id AND a.k = b.k""",
    "u09_overprints": "SELECT DISTINCT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS page, CAST(l_linenumber * 2 + 1 AS BIGINT) AS source_index FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING max(l_tax) >= 0.08",
    "w05_vertical_runs": _RUNS,
}
