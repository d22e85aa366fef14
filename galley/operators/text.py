"""Scalar text operators of a review: language by script, normalisers, containment, roles, headings, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators.cases import case_rows, case_sql
from galley.sources.tables import read

JAPANESE, ENGLISH, OTHER = "日本語", "英語", "その他"
#: Script classes. Middle dots and long marks, which other texts use too, are no kana.
KANA, HAN = r"[^\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{30FD}-\x{30FF}\x{31F0}-\x{31FF}]+", r"[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]+"
OTHERS = r"[^\x{AC00}-\x{D7AF}\x{0400}-\x{04FF}\x{0600}-\x{06FF}]+"


def script_language(c: Column) -> Column:
    """日本語, 英語 or その他 by counts of letters of each script (so German or French text counts as 英語).

    Two passes over the whole text: one for Latin letters, one that leaves what is beyond U+0400, mostly nothing, for the other scripts.
    """
    far = F.regexp_replace(c, r"[\x00-\x{03FF}]+", "")
    n = lambda r: F.length(F.regexp_replace(far, r, ""))
    kana, han, rest, latin = n(KANA), n(HAN), n(OTHERS), F.length(F.regexp_replace(c, r"[^A-Za-z]+", ""))
    ja = ((kana >= 2) | ((kana > 0) & (3 * kana >= han))) & ((10 * kana >= latin) | (2 * (kana + han) >= latin))
    return F.when(c.isNull(), OTHER).when(ja, JAPANESE).when((latin >= 8) & (latin >= 2 * (han + rest)), ENGLISH).otherwise(OTHER)


def document_language(pages: DataFrame) -> DataFrame:
    """A document's language if all its pages agree, else その他."""
    return pages.groupBy("doc_id").agg(F.count_distinct("language").alias("n"), F.min("language").alias("one")).select("doc_id", F.when(F.col("n") == 1, F.col("one")).otherwise(OTHER).alias("language"))


def normalise_source(c: Column) -> Column:
    """Source fragments: no zero-width characters or variation selectors, plain dashes and quotes, single spaces."""
    c = F.regexp_replace(c, r"[\x{200B}-\x{200D}\x{FEFF}\x{FE00}-\x{FE0F}]", "")
    c = F.translate(c, "‐‑‒–—−“”„‘’‚", "------\"\"\"'''")
    return F.trim(F.regexp_replace(c, r"[\s\x{3000}\x{00A0}]+", " "))


def same_or_contained(a: Column, b: Column, least: int = 12) -> Column:
    """Equal, or the shorter (of `least` characters or more) within the longer; `*` and white space do not count."""
    a, b = (F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s*]", "")) for x in (a, b))
    short = F.least(F.length(a), F.length(b))
    return (short > 0) & ((a == b) | ((short >= least) & (F.contains(a, b) | F.contains(b, a))))


def unique_index(text: Column, part: Column) -> Column:
    """0-based place of a part that occurs once; -1 for none, several or an empty part."""
    at = F.position(part, text)
    again = F.position(part, F.substr(text, at + 1))
    return F.when((part != "") & (at > 0) & (again == 0), at - 1).otherwise(-1)


def occurrences(text: Column, part: Column, limit: int = 1000) -> Column:
    """Overlapping occurrences, at most `limit` (the operator's purpose)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(part) + 1, F.lit(1)))
    n = F.size(F.filter(starts, lambda k: F.substr(text, k, F.length(part)) == part))
    return F.when((part == "") | text.isNull() | part.isNull(), 0).otherwise(F.least(n, F.lit(limit)))


def fold_quarters(c: Column) -> Column:
    """Q1, 1Q and 第1四半期 as q1."""
    c = F.regexp_replace(c, r"第\s*([1-4])\s*四半期", "q$1")
    c = F.regexp_replace(c, r"(?i)\b([1-4])\s*Q\b", "q$1")
    return F.regexp_replace(c, r"(?i)\bQ\s*([1-4])\b", "q$1")


def fold_width(c: Column) -> Column:
    """Full-width digits as ASCII ones; the length stays."""
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def first_populated(*columns: str) -> Column:
    """The first value that is not blank; else the first that is not null."""
    return F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns), *(F.col(c) for c in columns))


#: Names of months.
MONTHS = r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s+[0-9]{1,2}\b"


def year_keys(c: Column) -> Column:
    """Years 1900 to 2099 that are no part of a longer number, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![0-9.])((?:19|20)[0-9]{2})(?![0-9.])"), F.lit(1))))


def date_keys(c: Column) -> Column:
    """Explicit month-day keys (3-31) of English and Japanese dates, sorted and distinct."""
    c = F.coalesce(c, F.lit(""))
    number = lambda x, p: F.regexp_extract(x, p, 1).cast("int").cast("string")
    month = lambda x: ((F.position(F.lower(F.substring(x, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int").cast("string")
    english = F.transform(F.regexp_extract_all(c, F.lit(MONTHS), F.lit(0)), lambda x: F.concat_ws("-", month(x), number(x, "([0-9]+)$")))
    japanese = F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日"), F.lit(0)), lambda x: F.concat_ws("-", number(x, "^([0-9]+)"), number(x, r"月\s*([0-9]+)")))
    return F.array_sort(F.array_distinct(F.concat(english, japanese)))


# Marks of numbered headings (a separator is a must), bullets, masked amounts, figures of a table row.
HEADING = r"^([0-9]{1,3}(?:\.[0-9]{1,3}){0,3}[.．)）:]|[（(][0-9]{1,3}[)）]|第[0-9]{1,3}[章節項]|(?:[IVX]{1,7}|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]{1,4})[.．)）])(\s*)(.+)$"
BULLET, MASKED = r"^[-*•●○◆◇▪▫]\s*", "⟦#[A-Z0-9]+⟧"
FIGURE = r"(?i)(?:^|\s)[+−-]?[0-9][0-9,]*(?:\.[0-9]+)?(?:%|円|yen|million|billion|thousand)?(?=\s|$)"


def numbered_heading(c: Column) -> Column:
    """(number, title) of a numbered heading, else null: a mark with its separator, then a title of three letters or more and at most 240 characters.

    A bullet, a decimal such as `3.5 million`, two masked amounts or three figures make it something else.
    """
    line = F.trim(F.regexp_replace(F.regexp_replace(c, "[\u3000\u00a0]", " "), r"\s+", " "))
    mark, gap, title = (F.regexp_extract(line, HEADING, k) for k in (1, 2, 3))
    title = F.trim(title)
    decimal = (gap == "") & mark.rlike("[.．]$") & title.rlike("^[0-9]")
    ok = (mark != "") & ~line.rlike(BULLET) & ~decimal & (F.length(title) <= 240) & (F.regexp_count(title, F.lit(r"\p{L}")) >= 3)
    ok &= (F.regexp_count(title, F.lit(MASKED)) < 2) & (F.regexp_count(title, F.lit(FIGURE)) < 3)
    return F.when(ok, F.struct(mark.alias("number"), title.alias("title")))


def last_header(lines: DataFrame, header: Column, partition: str, order: str) -> DataFrame:
    """The last header up to each line (lines need an order within their partition)."""
    from pyspark.sql import Window

    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("header", F.last(header, ignorenulls=True).over(w))


def heading_index(lines: DataFrame, most: int = 240) -> DataFrame:
    """Headings (doc_id, page, line) once per page and text, in order, `most` a document (the operator's purpose)."""
    from pyspark.sql import Window

    found = lines.withColumn("heading", numbered_heading(F.col("line"))).where("heading is not null")
    once = found.groupBy("doc_id", "page", F.lower(F.concat_ws(" ", "heading.number", "heading.title")).alias("key")).agg(F.min(F.struct("at", "heading")).alias("h"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "h.at")))
    return ranked.where(F.col("place") <= most).select("doc_id", "page", "place", "h.heading.number", "h.heading.title")


def truncate_number_safe(c: Column, n: int) -> Column:
    """The first n characters, without a number that the cut would split."""
    cut = F.substring(c, 1, n)
    split = F.substring(c, n + 1, 1).rlike("[0-9]") & cut.rlike("[0-9][0-9,.]*$")
    return F.when(F.length(c) <= n, c).when(split, F.regexp_replace(cut, "[0-9][0-9,.]*$", "")).otherwise(cut)


def is_action_suggestion(c: Column) -> Column:
    """A suggestion that asks for an action rather than giving a replacement: a Japanese verb ending or an imperative."""
    return F.trim(c).rlike(r"(する|してください|すること|します|確認|修正|削除|追加|統一)[。．.]?$") | F.lower(F.trim(c)).rlike(r"^(delete|remove|insert|add|check|confirm|review|unify)\b")


#: Answers that decline or fail, as a whole.
DECLINES = r"(?is)^(?:申し訳ございません.{0,500}(?:応答|回答)できません(?:でした)?|それに応答できません(?:でした)?|(?:sorry.{0,120})?(?:unable|can(?:not|'t))\s+(?:to\s+)?(?:respond|complete|help).{0,500})[。.!?\s]*$"
FAILS = r"(?is)^(?:申し訳ございません[。\s]*)?(?:問題が発生しました|エラーが発生しました|something\s+went\s+wrong).{0,500}$"


def is_refusal(c: Column, most: int = 1200) -> Column:
    """An answer of at most `most` characters that declines or fails and is no JSON with findings."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\x{3000}]+|[\s\x{3000}]+$", "")
    return (text != "") & (F.length(text) <= most) & ~text.rlike(r'"(?:findings|read_error)"\s*:') & (text.rlike(DECLINES) | text.rlike(FAILS))


def strip_html(c: Column) -> Column:
    """Text of a page: no scripts, styles or comments, tags as line breaks, common entities as characters."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", "")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def x18_language(spark, d):
    return _docs(spark, d).select(script_language(F.col("text")).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def x18_source_language(spark, d):
    pages = _docs(spark, d).select(F.concat_ws("/", "source", "lang").alias("doc_id"), script_language(F.col("text")).alias("language"))
    return document_language(pages)


def x04_normalise_source(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(normalise_source(F.concat(F.lit("“x”—​ "), F.col("text")))).alias("digest"))


def x05_unique_index(spark, d):
    p = read(spark, d, "part")
    return p.select(unique_index(F.col("p_name"), F.split("p_name", " ")[1]).cast("long").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))


def x06_occurrences(spark, d):
    return read(spark, d, "part").select("p_partkey", occurrences(F.col("p_type"), F.lit("E")).cast("long").alias("n"))


def x07_fold_quarters(spark, d):
    text = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" and "), F.quarter("o_orderdate").cast("string"), F.lit("Q, 第"), F.quarter("o_orderdate").cast("string"), F.lit("四半期"))
    return read(spark, d, "orders").select(fold_quarters(text).alias("folded")).groupBy("folded").agg(F.count(F.lit(1)).alias("n"))


def x08_fold_width(spark, d):
    wide = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "０１２３４５６７８９")
    return read(spark, d, "orders").select("o_orderkey", fold_width(wide).alias("folded"), F.length(wide).cast("long").alias("n"))


def x12_first_populated(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.lit(" ")).when(F.col("value") > 25, F.lit("near")).alias("a"), F.when(F.col("value") > 75, "far").alias("b"))
    return e.select(first_populated("a", "b").alias("picked")).groupBy("picked").agg(F.count(F.lit(1)).alias("n"))


def x03_same_or_contained(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", same_or_contained(F.concat_ws(" ", "p_type", "p_brand"), F.col("p_type")).alias("same"))


def x10_date_keys(spark, d):
    text = F.concat(F.lit("from "), F.date_format("o_orderdate", "MMMM d"), F.lit(", to March 31 and March 31"))
    return read(spark, d, "orders").select(F.array_join(date_keys(text), ";").alias("dates")).groupBy("dates").agg(F.count(F.lit(1)).alias("n"))


#: Marks that stand before lines of documents: headings and what looks like them.
MARKS = ("1. ", "2 ", "（3）", "第4章 ", "- 5. ", "6.5", "IV. ", "7) 1 22 333 ", "8: ⟦#AB1⟧ ⟦#CD2⟧ ", "I ", "Ⅱ．", "9. 10 ")


def marked_lines(spark, d: str):
    """Lines of documents, each after one of MARKS."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marks = F.array(*(F.lit(m) for m in MARKS))
    return lines.withColumn("line", F.concat(F.get(marks, F.pmod(F.col("doc_id") + F.col("at"), F.lit(len(MARKS))).cast("int")), "line"))


def x19_numbered_heading(spark, d):
    return marked_lines(spark, d).select("doc_id", "at", numbered_heading(F.col("line")).alias("h")).where("h IS NOT NULL").select("doc_id", F.col("at").alias("line"), "h.number", "h.title")


def x33_truncate(spark, d):
    return read(spark, d, "orders").select("o_orderkey", truncate_number_safe(F.concat(F.lit("total "), F.col("o_orderkey").cast("string"), F.lit(" yen")), 8).alias("cut"))


REFUSALS = (
    ("申し訳ございません。その件には回答できません。", True), ("それに応答できませんでした", True), ("Sorry, I am unable to help with that.", True), ("cannot complete this", True), ("申し訳ございません。問題が発生しました。もう一度お試しいただけますか?", True),
    (" Something  went wrong. Try again ", True), ('sorry, unable to help {"findings": []}', False), ("I can't see an error on this page", False), ("The parties cannot respond in time", False), ("", False), (None, False), ("sorry", False),
    ("unable to help " + "x" * 600, False), ("エラーが発生しました" + "。" * 1300, False),
)
LANGUAGES = (
    ("売上高は増加しました", "日本語"), ("Net sales rose", "英語"), ("12 34", "その他"), ("Umsatzerlöse stiegen", "英語"), ("・ー Net sales rose in Tokyo", "英語"), ("貸借対照表", "その他"), ("損益の計算", "その他"), ("損益の計算について", "日本語"), ("Net sales of トヨ Corporation in the United States", "英語"),
    ("ﾈｯﾄ売上", "その他"), ("Продажи выросли", "その他"), ("매출이 증가", "その他"), ("short", "その他"), (" ", "その他"), (None, "その他"), ("éèêëàâäôöù", "その他"), ("Sales 売上高売上高", "その他"),
)
DATES = (
    ("from March 31, to Mar. 5", "3-31;3-5", ""), ("2024年3月31日", "3-31", "2024"), ("in 2024 and 1999, not 12024", "", "1999;2024"), ("May 7 and 5月7日", "5-7", ""), ("sept 09 2020", "9-9", "2020"), ("v2.2024 or 2024.5", "", ""), (None, "", ""), ("Octo 3, 12月 25日", "12-25", ""),
)


def f26_refusals(spark, d):
    return case_rows(spark, d, [c[:1] for c in REFUSALS], "text string").select("id", is_refusal(F.col("text")).alias("refusal"))


def x18_script_cases(spark, d):
    return case_rows(spark, d, [c[:1] for c in LANGUAGES], "text string").select("id", script_language(F.col("text")).alias("language"))


def x10_date_cases(spark, d):
    return case_rows(spark, d, [c[:1] for c in DATES], "text string").select("id", F.concat(F.array_join(date_keys(F.col("text")), ";"), F.lit("|"), F.array_join(year_keys(F.col("text")), ";")).alias("dates"))


def s10_strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", F.length(strip_html(F.col("html"))).cast("long").alias("n"), F.regexp_count(strip_html(F.col("html")), F.lit("<[a-z]")).cast("long").alias("tags"))


def w03_last_header(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", F.concat(F.lit("P."), F.col("l_linenumber").cast("string"))).alias("h"), "l_partkey", "l_suppkey").withColumn("order", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return last_header(lines, F.col("h"), "l_orderkey", "order").groupBy("l_orderkey").agg(F.count("header").alias("under"), F.max("header").alias("last"))


def t05_heading_index(spark, d):
    lines = marked_lines(spark, d).select(F.pmod("doc_id", F.lit(50)).alias("doc_id"), F.lit(1).alias("page"), F.struct("doc_id", "at").alias("at"), "line")
    return heading_index(lines).select("doc_id", "place", "number", F.lower("title").alias("title"))


QUERIES = {f.__name__: f for f in (x18_language, x18_source_language, x04_normalise_source, x05_unique_index, x06_occurrences, x07_fold_quarters, x08_fold_width, x12_first_populated, x03_same_or_contained, x10_date_keys, x10_date_cases, x18_script_cases, x19_numbered_heading, x33_truncate, f26_refusals, s10_strip_html, w03_last_header, t05_heading_index)}

_LANG = """CASE WHEN k >= 2 AND (10 * k >= l OR 2 * (k + h) >= l) OR k = 1 AND 3 >= h AND (10 >= l OR 2 * (1 + h) >= l) THEN '日本語' WHEN l >= 8 AND l >= 2 * (h + o) THEN '英語' ELSE 'その他' END"""
_COUNTS = r"""SELECT *, len(regexp_replace(text, '[^\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{30FD}-\x{30FF}\x{31F0}-\x{31FF}]', '', 'g')) AS k, len(regexp_replace(text, '[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]', '', 'g')) AS h,
  len(regexp_replace(text, '[^\x{AC00}-\x{D7AF}\x{0400}-\x{04FF}\x{0600}-\x{06FF}]', '', 'g')) AS o, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents"""

_MARK = r"^([0-9]{1,3}(?:\.[0-9]{1,3}){0,3}[.．)）:]|[（(][0-9]{1,3}[)）]|第[0-9]{1,3}[章節項]|(?:[IVX]{1,7}|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]{1,4})[.．)）])"
_HEADINGS = rf"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
marked AS (SELECT doc_id, CAST(pos AS INT) AS line, trim(regexp_replace(replace(replace([{", ".join(f"'{m}'" for m in MARKS)}][(doc_id + pos) % {len(MARKS)} + 1] || line, chr(12288), ' '), chr(160), ' '), '\s+', ' ', 'g')) AS t FROM lines),
cut_at AS (SELECT *, regexp_extract(t, '{_MARK}', 1) AS number, substr(t, length(regexp_extract(t, '{_MARK}', 1)) + 1) AS rest FROM marked),
titled AS (SELECT *, trim(rest) AS title FROM cut_at WHERE number <> '' AND NOT regexp_matches(t, '^[-*•●○◆◇▪▫]')),
headings AS (SELECT doc_id, line, number, title FROM titled WHERE NOT (regexp_matches(number, '[.．]$') AND regexp_matches(rest, '^[0-9]')) AND length(title) BETWEEN 1 AND 240 AND len(regexp_extract_all(title, '\p{{L}}')) >= 3
  AND len(regexp_extract_all(title, '⟦#[A-Z0-9]+⟧')) < 2 AND len(list_filter(string_split(title, ' '), lambda w: regexp_full_match(w, '(?i)[+−-]?[0-9][0-9,]*(?:\.[0-9]+)?(?:%|円|yen|million|billion|thousand)?'))) < 3)"""

ORACLE_SQL = {
    "x18_language": f"SELECT {_LANG} AS language, count(*) AS n FROM ({_COUNTS}) GROUP BY 1",
    "x18_source_language": f"SELECT doc_id, CASE WHEN count(DISTINCT language) = 1 THEN min(language) ELSE 'その他' END AS language FROM (SELECT source || '/' || lang AS doc_id, {_LANG} AS language FROM ({_COUNTS})) GROUP BY doc_id",
    "x04_normalise_source": "SELECT doc_id, md5(trim(regexp_replace('\"x\"- ' || translate(text, '‐‑‒–—−“”„‘’‚', '------' || repeat(chr(34), 3) || repeat(chr(39), 3)), '[\\s\\x{3000}\\x{00A0}]+', ' ', 'g'))) AS digest FROM documents",
    "x05_unique_index": "SELECT CASE WHEN strpos(p_name, w) > 0 AND strpos(substr(p_name, strpos(p_name, w) + 1), w) = 0 THEN strpos(p_name, w) - 1 ELSE -1 END AS at, count(*) AS n FROM (SELECT p_name, string_split(p_name, ' ')[2] AS w FROM part) GROUP BY 1",
    "x06_occurrences": "SELECT p_partkey, len(p_type) - len(replace(p_type, 'E', '')) AS n FROM part",
    "x07_fold_quarters": "SELECT 'q' || quarter(o_orderdate) || ' and q' || quarter(o_orderdate) || ', q' || quarter(o_orderdate) AS folded, count(*) AS n FROM orders GROUP BY 1",
    "x08_fold_width": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS folded, len(CAST(o_orderkey AS VARCHAR)) AS n FROM orders",
    "x12_first_populated": "SELECT CASE WHEN value > 75 THEN 'far' WHEN value > 50 THEN ' ' WHEN value > 25 THEN 'near' END AS picked, count(*) AS n FROM events GROUP BY 1",
    "x03_same_or_contained": "SELECT p_partkey, len(regexp_replace(p_type, '\\s', '', 'g')) >= 12 AS same FROM part",
    "x10_date_keys": "SELECT CASE WHEN k = '3-31' THEN k WHEN k < '3-31' THEN k || ';3-31' ELSE '3-31;' || k END AS dates, count(*) AS n FROM (SELECT month(o_orderdate) || '-' || day(o_orderdate) AS k FROM orders) GROUP BY 1",
    "x19_numbered_heading": f"WITH {_HEADINGS} SELECT doc_id, line, number, title FROM headings",
    "x33_truncate": "SELECT o_orderkey, CASE WHEN len(CAST(o_orderkey AS VARCHAR)) <= 2 THEN substr('total ' || o_orderkey || ' yen', 1, 8) ELSE 'total ' END AS cut FROM orders",
    "f26_refusals": case_sql([c[1] for c in REFUSALS], "refusal"),
    "x18_script_cases": case_sql([c[1] for c in LANGUAGES], "language"),
    "x10_date_cases": case_sql([f"{c[1]}|{c[2]}" for c in DATES], "dates"),
    "w03_last_header": """
SELECT l_orderkey, count(header) AS under, max(header) AS last FROM (SELECT l_orderkey, last_value(CASE WHEN l_returnflag = 'A' THEN 'P.' || l_linenumber END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS header FROM lineitem) GROUP BY l_orderkey
""",
    "t05_heading_index": f"""
WITH {_HEADINGS},
o AS (SELECT doc_id % 50 AS doc_id, lower(number || ' ' || title) AS k, min((doc_id, line)) AS pos, arg_min(number, (doc_id, line)) AS number, arg_min(lower(title), (doc_id, line)) AS title FROM headings GROUP BY 1, 2)
SELECT doc_id, CAST(place AS INT) AS place, number, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM o) WHERE place <= 240
""",
}
