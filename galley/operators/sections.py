"""Page windows: overlapping sections, reference ranges, pages to scan, page lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.sources.tables import read


def page_sections(documents: DataFrame, width: int = 25, overlap: int = 3) -> DataFrame:
    """Windows of `width` pages over documents (doc_id, total); each but the first starts `overlap` pages before the last one's end."""
    width = max(1, width)
    step = width - min(max(0, overlap), width - 1)
    last = F.greatest(F.ceil((F.col("total") - width) / step), F.lit(0))
    rows = documents.where("total > 0").select("doc_id", "total", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("index"))
    start = F.col("index") * step + 1
    return rows.select("doc_id", F.col("index").cast("int").alias("index"), start.cast("int").alias("start_page"), F.least(F.col("total"), start + width - 1).cast("int").alias("end_page"))


def breakpoint_sections(breaks: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections that start at page 1 and at each valid breakpoint (doc_id, page); no overlap."""
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1)), F.coalesce("pages", F.array().cast("array<int>")))))
    listed = documents.join(breaks.join(documents, "doc_id").where("page >= 1 and page <= total").groupBy("doc_id").agg(F.collect_set(F.col("page").cast("int")).alias("pages")), "doc_id", "left")
    rows = listed.where("total > 0").select("doc_id", "total", starts.alias("s")).select("doc_id", "total", "s", F.posexplode("s").alias("index", "start_page"))
    end = F.coalesce(F.get("s", F.col("index") + 1) - 1, F.col("total"))
    return rows.select("doc_id", "index", "start_page", end.cast("int").alias("end_page"))


def section_warning(pages: Column) -> Column:
    """Size warnings of a section."""
    return F.when(pages > 100, "very_large").when(pages > 50, "large").when(pages < 3, "small")


def reference_range(sections: DataFrame, buffer: int = 5) -> DataFrame:
    """Linear scaling of (start_page, end_page) of total pages to a reference of ref_total, widened by the buffer and clamped."""
    lo = F.floor((F.col("start_page") - 1) * F.col("ref_total") / F.col("total")) + 1 - buffer
    hi = F.ceil(F.col("end_page") * F.col("ref_total") / F.col("total")) + buffer
    return sections.withColumn("ref_start", F.greatest(F.lit(1), lo).cast("int")).withColumn("ref_end", F.least(F.col("ref_total"), hi).cast("int"))


def pages_to_scan(documents: DataFrame, cap: int = 512) -> DataFrame:
    """(doc_id, page): every page, or `cap` of them, first, last and evenly spaced, which is the operator's purpose."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: (F.floor(k * (F.col("total") - 1) / (cap - 1) + 0.5) + 1).cast("int"))
    every = F.sequence(F.lit(1), F.col("total").cast("int"))
    return documents.where("total > 0").select("doc_id", F.explode(F.array_distinct(F.when(F.col("total") > cap, spaced).otherwise(every))).alias("page"))


def parse_pages(c: Column) -> Column:
    """`7,10-13` as a sorted array of pages; null where it is malformed (a bad character, a descending range, over 2000 characters)."""
    tidy = F.regexp_replace(c, "\\s", "")
    ok = (F.length(c) <= 2000) & tidy.rlike(r"^([0-9]{1,6}(-[0-9]{1,6})?)(,[0-9]{1,6}(-[0-9]{1,6})?)*$")
    parts = F.transform(F.split(tidy, ","), lambda p: F.struct(F.split(p, "-")[0].cast("int").alias("a"), F.element_at(F.split(p, "-"), -1).cast("int").alias("b")))
    good = ok & ~F.exists(parts, lambda p: (p["a"] > p["b"]) | (p["b"] - p["a"] > 10000))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(p["a"], p["b"])))))
    return F.when(c.isNull() | (tidy == ""), F.array().cast("array<int>")).when(good, pages)


def page_numbers(c: Column, most: int = 10000) -> Column:
    """All whole numbers in a text as sorted distinct pages, at most `most` of them (the operator's purpose)."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[0-9]{1,6}"), F.lit(0)), lambda x: x.cast("int"))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda x: x > 0))), 1, most)


# Orders stand for documents of as many pages as their price in thousands, suppliers' orders for their references.


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.ceil(F.col("o_totalprice") / 1000).cast("int").alias("total"))


def l09_page_sections(spark, d):
    return page_sections(_documents(spark, d))


def l09_breakpoint_sections(spark, d):
    breaks = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("int").alias("page"))
    return breakpoint_sections(breaks, _documents(spark, d))


def l10_section_warnings(spark, d):
    s = page_sections(_documents(spark, d), 60, 3)
    return s.select(section_warning(F.col("end_page") - F.col("start_page") + 1).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


def j10_reference_range(spark, d):
    s = page_sections(_documents(spark, d)).join(_documents(spark, d), "doc_id").withColumn("ref_total", F.col("total") + F.lit(7))
    return reference_range(s).select("doc_id", "index", "ref_start", "ref_end")


def t04_pages_to_scan(spark, d):
    return pages_to_scan(_documents(spark, d), 100).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("page").alias("total"), F.max("page").alias("last"))


def x13_parse_pages(spark, d):
    li = read(spark, d, "lineitem")
    text = F.concat_ws(",", F.col("l_linenumber").cast("string"), F.concat_ws("-", F.col("l_quantity").cast("int").cast("string"), F.lit("30")))
    return li.select(parse_pages(text).alias("p")).select(F.size("p").cast("int").alias("n"), F.col("p").isNull().alias("bad")).select(F.when(~F.col("bad"), F.col("n")).alias("n"), "bad").groupBy("n", "bad").agg(F.count(F.lit(1)).alias("rows"))


def x11_page_numbers(spark, d):
    text = F.concat(F.lit("P."), F.col("l_linenumber").cast("string"), F.lit(", pages "), F.col("l_quantity").cast("int").cast("string"), F.lit(" and "), F.col("l_linenumber").cast("string"))
    return read(spark, d, "lineitem").select(F.array_join(page_numbers(text), ",").alias("pages")).groupBy("pages").agg(F.count(F.lit(1)).alias("n"))


_S = "WITH d AS (SELECT o_orderkey AS doc_id, CAST(ceil(o_totalprice / 1000) AS INT) AS total FROM orders), "
_W = _S + "s AS (SELECT doc_id, total, CAST(i AS INT) AS index, CAST(i * 22 + 1 AS INT) AS start_page, CAST(least(total, i * 22 + 25) AS INT) AS end_page FROM (SELECT doc_id, total, unnest(range(CAST(greatest(ceil((total - 25) / 22.0), 0) AS BIGINT) + 1)) AS i FROM d WHERE total > 0)) "

QUERIES = {f.__name__: f for f in (l09_page_sections, l09_breakpoint_sections, l10_section_warnings, j10_reference_range, t04_pages_to_scan, x11_page_numbers, x13_parse_pages)}

ORACLE_SQL = {
    "l09_page_sections": _W + "SELECT doc_id, index, start_page, end_page FROM s",
    "l09_breakpoint_sections": _S + """
b AS (SELECT DISTINCT doc_id, total, page FROM (SELECT doc_id, total, 1 AS page FROM d WHERE total > 0 UNION ALL SELECT d.doc_id, d.total, CAST(trunc(l_quantity) AS INT) FROM lineitem JOIN d ON d.doc_id = l_orderkey WHERE trunc(l_quantity) BETWEEN 1 AND d.total))
SELECT doc_id, CAST(row_number() OVER w - 1 AS INT) AS index, CAST(page AS INT) AS start_page, CAST(coalesce(lead(page) OVER w - 1, total) AS INT) AS end_page FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY page)
""",
    "l10_section_warnings": _S + """
s AS (SELECT least(total, i * 57 + 60) - i * 57 AS n FROM (SELECT total, unnest(range(CAST(greatest(ceil((total - 60) / 57.0), 0) AS BIGINT) + 1)) AS i FROM d WHERE total > 0))
SELECT CASE WHEN n > 100 THEN 'very_large' WHEN n > 50 THEN 'large' WHEN n < 3 THEN 'small' END AS warning, count(*) AS n FROM s GROUP BY 1
""",
    "j10_reference_range": _W + "SELECT doc_id, index, CAST(greatest(1, floor((start_page - 1) * (total + 7) / total::DOUBLE) + 1 - 5) AS INT) AS ref_start, CAST(least(total + 7, ceil(end_page * (total + 7) / total::DOUBLE) + 5) AS INT) AS ref_end FROM s",
    "t04_pages_to_scan": _S + """
p AS (SELECT doc_id, unnest(range(1, total + 1)) AS page FROM d WHERE total BETWEEN 1 AND 100 UNION SELECT doc_id, CAST(floor(k * (total - 1) / 99.0::DOUBLE + 0.5) + 1 AS BIGINT) FROM (SELECT doc_id, total, unnest(range(100)) AS k FROM d WHERE total > 100))
SELECT doc_id, count(*) AS pages, CAST(sum(page) AS BIGINT) AS total, CAST(max(page) AS INT) AS last FROM p GROUP BY doc_id
""",
    "x11_page_numbers": "SELECT CASE WHEN l_linenumber = q THEN CAST(q AS VARCHAR) WHEN l_linenumber < q THEN l_linenumber || ',' || q ELSE q || ',' || l_linenumber END AS pages, count(*) AS n FROM (SELECT l_linenumber, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem) GROUP BY 1",
    "x13_parse_pages": "SELECT CASE WHEN q <= 30 THEN CAST(31 - q + CASE WHEN l_linenumber < q THEN 1 ELSE 0 END AS INT) END AS n, q > 30 AS bad, count(*) AS rows FROM (SELECT l_linenumber, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem) GROUP BY 1, 2",
}
