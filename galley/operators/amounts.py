"""Amounts in DataFrames: literals, exact scaling, token tables, consistent masking by job, leak gates, bag comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import numbers
from galley.operators.cases import case_rows, case_sql
from galley.operators.claims import applied
from galley.sources.tables import read

LITERAL = r"(?:[0-9]{1,3}(?:,[0-9]{3})+(?![0-9])|[0-9]+)(?:\.[0-9]+)?"
TOKENS = "doc_id long, ordinal int, start int, end int, raw string, negative boolean, micro decimal(38,0), quantum decimal(38,0)"


def literals(c: Column) -> Column:
    """Numeric literals, grouped or plain; a group is not followed by a digit."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LITERAL), F.lit(0))


def scaled(c: Column, power: Column) -> Column:
    """An exact decimal times a power of ten up to 12."""
    factor = F.element_at(F.array(*(F.lit(10**k).cast("decimal(13,0)") for k in range(13))), power + 1)
    return c.cast("decimal(24,6)") * factor


def number_tokens(texts: DataFrame, lang: str = "en") -> DataFrame:
    """TOKENS of texts (doc_id, text), without the numbers that stay readable (years, dates, pages, headings). Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, k, n.start, n.end, n.raw, n.negative, str(n.micro), str(n.quantum)) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, n in enumerate(numbers.tokenize(text or "", lang))]
            if rows:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in TOKENS.split(", ")])

    made = texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS.replace("decimal(38,0)", "string"))
    return made.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("micro", "quantum")})


def mask_jobs(texts: DataFrame, seed: int = 0) -> DataFrame:
    """texts (job_id, page, lang, text) masked, one table of symbols a job, numbers in page order: masked, occurrences, restored, leaks.

    Symbols are given first come first served, so a job's pages stream in order through one task, which holds its symbols only.
    """

    names = ["job_id", "page", "lang", "masked", "occurrences", "restored", "leaks"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, symbols = None, numbers.Symbols(seed)
        for b in batches:
            rows = []
            for key, page, lang, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if key != job:
                    job, symbols = key, numbers.Symbols(seed)
                text = text or ""
                masked, found = numbers.mask(text, lang, symbols)
                rows.append((key, page, lang, masked, len(found), numbers.unmask(masked, found) == text, len(numbers.leaks(masked, lang))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    ordered = texts.select("job_id", "page", "lang", "text").repartition("job_id").sortWithinPartitions("job_id", "page", "lang", "text")
    return ordered.mapInArrow(run, "job_id long, page long, lang string, masked string, occurrences long, restored boolean, leaks long")


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values that one side has more often, by key: only_left and only_right."""
    a = left.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("b"))
    n = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return a.join(b, [*keys, value], "full").withColumn("n", n).where("n <> 0").select(*keys, value, F.greatest("n", F.lit(0)).alias("only_left"), F.greatest(-F.col("n"), F.lit(0)).alias("only_right"))


def resolved_exponent(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens (id, value) whose amount is known at exactly one of the scales 1, 10^3, 10^6 and 10^8 (amounts: amount)."""
    tried = tokens.select("id", "value", F.explode(F.array(*map(F.lit, (0, 3, 6, 8)))).alias("power")).withColumn("amount", scaled(F.col("value"), F.col("power")))
    hits = tried.join(known.select(F.col("amount").cast("decimal(38,6)")).distinct(), "amount")
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("power").alias("power")).where("n = 1").select("id", "power")


def split_surfaces(occurrences: DataFrame) -> DataFrame:
    """Surfaces (digits, points and commas of raw, three digits or more) of amounts (raw, symbol, micro, family) under two or more symbols.

    digit_gap: difference in length of the symbols' amounts; families: unit families that have the surface with several
    amounts. A surface is suspicious if there is such a family, or a gap of 1 to 12 digits: one scale was read wrongly.
    """
    surface = F.regexp_replace("raw", "[^0-9.,]", "")
    o = occurrences.withColumn("surface", surface).where(F.length(F.regexp_replace("surface", "[^0-9]", "")) >= 3)
    size = F.length(F.abs(F.col("micro").cast("decimal(38,0)")).cast("string"))
    symbols = o.groupBy("surface").agg(F.count_distinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("n"), (F.max(size) - F.min(size)).cast("long").alias("digit_gap")).where("symbols > 1")
    split = o.where("family is not null and family <> ''").groupBy("surface", "family").agg(F.count_distinct("micro").alias("k")).where("k > 1").groupBy("surface").agg(F.array_join(F.array_sort(F.collect_list("family")), ",").alias("families"))
    joined = symbols.join(split, "surface", "left").withColumn("families", F.coalesce("families", F.lit("")))
    return joined.withColumn("suspicious", (F.col("families") != "") | F.col("digit_gap").between(1, 12))


def _prices(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("int").alias("quantity"), "l_returnflag")


def m01_literals(spark, d):
    text = F.concat(F.lit("of "), F.format_number("price", 2), F.lit(" yen, "), F.col("quantity").cast("string"), F.lit(" units"))
    return _prices(spark, d).select(literals(text).alias("x")).select(F.size("x").cast("long").alias("n"), F.length(F.array_join("x", "")).cast("long").alias("digits")).groupBy("n", "digits").agg(F.count(F.lit(1)).alias("rows"))


def m02_exact_amounts(spark, d):
    return _prices(spark, d).select("l_returnflag", scaled(F.col("price"), F.pmod("quantity", F.lit(7))).alias("amount")).groupBy("l_returnflag").agg(F.sum("amount").cast("string").alias("total"))


def _spread(spark: SparkSession, d: str) -> DataFrame:
    """Prices over all cores: the tables may be one row group, which one task would read and work on alone."""
    return _prices(spark, d).repartition(spark.sparkContext.defaultParallelism, "l_orderkey", "l_linenumber")


def m03_number_tokens(spark, d):
    li = _spread(spark, d)
    text = F.concat(F.lit("In 2024 sales were ("), F.format_number("price", 2), F.lit(") million and "), F.col("quantity").cast("string"), F.lit("k, see page 3"))
    tokens = number_tokens(li.select(F.col("l_orderkey").alias("doc_id"), text.alias("text")))
    return tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("negative"), -F.col("micro")).otherwise(F.col("micro"))).cast("string").alias("total"))


def m04_japanese_tokens(spark, d):
    text = F.concat(F.lit("売上高は"), F.col("quantity").cast("string"), F.lit("兆2,857億円、前年▲"), F.col("l_linenumber").cast("string"), F.lit("万円"))
    tokens = number_tokens(_spread(spark, d).select(F.col("l_orderkey").alias("doc_id"), text.alias("text")), "ja")
    return tokens.groupBy("negative").agg(F.count(F.lit(1)).alias("n"), F.sum("micro").cast("string").alias("total"))


def m08_mask_jobs(spark, d):
    li = read(spark, d, "lineitem")
    text = F.concat(F.lit("Sales of "), F.format_number("l_extendedprice", 2), F.lit(" yen in 2024, "), F.col("l_quantity").cast("int").cast("string"), F.lit(" million"))
    masked = mask_jobs(li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("page"), F.lit("en").alias("lang"), text.alias("text")))
    return masked.groupBy("restored", "leaks", "occurrences").agg(F.count(F.lit(1)).alias("n"))


def m07_resolved_exponent(spark, d):
    li = _prices(spark, d).groupBy("l_orderkey").agg(F.max("quantity").alias("value"))
    known = read(spark, d, "part").select((F.col("p_size") * 1000).alias("amount")).union(read(spark, d, "part").select("p_size").where("p_size > 40"))
    return resolved_exponent(li.select(F.col("l_orderkey").alias("id"), "value"), known)


def u03_bag_difference(spark, d):
    li = _prices(spark, d)
    side = lambda flag: li.where(F.col("l_returnflag") == flag).select(F.col("l_linenumber").alias("page"), F.col("quantity").alias("value"))
    return bag_difference(side("A"), side("R"), ["page"], "value")


def a17_split_surfaces(spark, d):
    """Parts' sizes as amounts of thousands, some read a thousand times too small."""
    p = read(spark, d, "part")
    micro = F.col("p_size").cast("decimal(38,0)") * F.when(F.col("p_retailprice") > 1400, 1).otherwise(1000)
    raw = F.concat(F.lit("¥"), F.format_number(F.col("p_size") * 100, 0))
    family = F.when(F.col("p_brand").endswith("1"), "money").when(F.col("p_brand").endswith("2"), "shares")
    return split_surfaces(p.select(raw.alias("raw"), F.concat_ws("-", F.col("p_size").cast("string"), (F.col("p_retailprice") > 1400).cast("string")).alias("symbol"), micro.alias("micro"), family.alias("family")))


MASKED = (
    ("In 2024 sales were (1,234.5) million and 12k, see page 3", "1"), ("売上高は1兆2,857億円、前年▲3万円、第3期", "1"), ("no number", "1"), (None, "1"), ("Note 5: 7 and 7 and 7.0", "1"), ("5 billion yen was 5,000 million yen", "1"),
)
KEPT = (("In 2024 and on March 31 it was 5", "5"), ("page 3, Table 2, Note 7, 3rd, Q1 and 1Q: 44", "44"), ("2024年3月31日は12", "12"), ("第3期 表 4", ""), ("1.2 Sales were 8", "1.2;8"), ("1. Sales were 8", "8"), (None, ""))
LEAKS = (("⟦#ABC⟧ and 55", "unmasked-number"), ("⟦#ABC and ⟦#XYZ⟧", "broken-symbol"), ("3⟦#ABC⟧", "partial-mask;unmasked-number"), ("⟦#ABC⟧ only", ""), ("#ABC⟧", "broken-symbol"), ("in 2024", ""), (None, ""))
RESTORES = (("x ⟦#AAA⟧ y", "AAA=5", "x 5 y"), ("⟦#AAA⟧⟦#BBB⟧", "AAA=5;BBB=(6)", "5(6)"), ("⟦#AAA⟧", "", "error"), ("x", "AAA=5", "error"), ("⟦#BBB⟧ ⟦#AAA⟧", "AAA=5;BBB=6", "error"), ("", "", ""))


def _restored(masked: str, found: str) -> str:
    try:
        return numbers.unmask(masked, [tuple(x.split("=")) for x in found.split(";") if x])
    except ValueError:
        return "error"


def m05_kept_spans(spark, d):
    lang = lambda t: "ja" if any("぀" <= c <= "鿿" for c in t) else "en"
    return applied(case_rows(spark, d, [c[:1] for c in KEPT], "text string"), lambda t: ";".join(n.raw for n in numbers.tokenize(t or "", lang(t or ""))), ["text"], "numbers", "string")


def m09_symbol_pool(spark, d):
    """Symbols of as many amounts as there are parts are all different, and of the same form for each seed."""
    def run(seed: int, n: int) -> str:
        symbols = numbers.Symbols(seed)
        names = [symbols.of(10**6 * k, 1) for k in range(n)]
        return f"{len(set(names))} {all(len(x) == 3 and set(x) <= set(numbers.LETTERS) for x in names)}".lower()

    return applied(read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_regionkey").alias("seed"), F.lit(200).alias("n")), run, ["seed", "n"], "names", "string")


def m10_mask_round_trip(spark, d):
    def run(text: str | None) -> str:
        text = text or ""
        lang = "ja" if any("぀" <= c <= "鿿" for c in text) else "en"
        masked, found = numbers.mask(text, lang, numbers.Symbols(3))
        return str(int(numbers.unmask(masked, found) == text and not numbers.leaks(masked, lang) and len(found) == len(numbers.tokenize(text, lang))))

    return applied(case_rows(spark, d, [c[:1] for c in MASKED], "text string"), run, ["text"], "whole", "string")


def m11_unmask(spark, d):
    return applied(case_rows(spark, d, [c[:2] for c in RESTORES], "masked string, found string"), _restored, ["masked", "found"], "text", "string")


def m13_leaks(spark, d):
    return applied(case_rows(spark, d, [c[:1] for c in LEAKS], "text string"), lambda t: ";".join(sorted({k for k, _ in numbers.leaks(t or "")})), ["text"], "kinds", "string")


QUERIES = {f.__name__: f for f in (m01_literals, m02_exact_amounts, m03_number_tokens, m04_japanese_tokens, m07_resolved_exponent, m08_mask_jobs, u03_bag_difference, a17_split_surfaces, m05_kept_spans, m09_symbol_pool, m10_mask_round_trip, m11_unmask, m13_leaks)}

ORACLE_SQL = {
    "m01_literals": "SELECT 2 AS n, len(format('{:,.2f}', l_extendedprice)) + len(CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR)) AS digits, count(*) AS rows FROM lineitem GROUP BY 1, 2",
    "m02_exact_amounts": "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(pow(10, CAST(trunc(l_quantity) AS INT) % 7) AS DECIMAL(10, 0))) AS VARCHAR) || '0000' AS total FROM lineitem GROUP BY 1",
    "m03_number_tokens": "SELECT l_orderkey AS doc_id, 2 * count(*) AS n, CAST(sum(-CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) * 100 AS HUGEINT) * 10000000000 + CAST(trunc(l_quantity) AS BIGINT) * 1000000000) AS VARCHAR) AS total FROM lineitem GROUP BY 1",
    "m04_japanese_tokens": "SELECT false AS negative, count(*) AS n, CAST(sum(CAST(trunc(l_quantity) AS HUGEINT) * 1000000000000000000 + 285700000000000000) AS VARCHAR) AS total FROM lineitem UNION ALL SELECT true, count(*), CAST(sum(CAST(l_linenumber AS HUGEINT) * 10000000000) AS VARCHAR) FROM lineitem",
    "m07_resolved_exponent": """
WITH k AS (SELECT DISTINCT amount FROM (SELECT CAST(p_size AS BIGINT) * 1000 AS amount FROM part UNION ALL SELECT p_size FROM part WHERE p_size > 40)),
t AS (SELECT l_orderkey AS id, max(CAST(trunc(l_quantity) AS BIGINT)) AS v FROM lineitem GROUP BY 1), x AS (SELECT id, v, unnest([0, 3, 6, 8]) AS power FROM t)
SELECT id, CAST(min(power) AS INT) AS power FROM x JOIN k ON k.amount = x.v * CAST(pow(10, x.power) AS BIGINT) GROUP BY id HAVING count(*) = 1
""",
    "m08_mask_jobs": "SELECT true AS restored, 0 AS leaks, 2 AS occurrences, count(*) AS n FROM lineitem",
    "u03_bag_difference": """
SELECT page, value, greatest(n, 0) AS only_left, greatest(-n, 0) AS only_right FROM (SELECT l_linenumber AS page, CAST(trunc(l_quantity) AS INT) AS value, CAST(sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2) WHERE n <> 0
""",
    "a17_split_surfaces": """
WITH o AS (SELECT format('{:,}', p_size * 100) AS surface, p_retailprice > 1400 AS small, p_size * CASE WHEN p_retailprice > 1400 THEN 1 ELSE 1000 END AS micro, CASE WHEN p_brand LIKE '%1' THEN 'money' WHEN p_brand LIKE '%2' THEN 'shares' END AS family FROM part),
f AS (SELECT surface, string_agg(family, ',' ORDER BY family) AS families FROM (SELECT surface, family FROM o WHERE family IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT micro) > 1) GROUP BY 1)
SELECT surface, count(DISTINCT small) AS symbols, count(*) AS n, 3 AS digit_gap, coalesce(any_value(families), '') AS families, true AS suspicious FROM o LEFT JOIN f USING (surface) GROUP BY surface HAVING count(DISTINCT small) > 1
""",
    "m05_kept_spans": case_sql([c[1] for c in KEPT], "numbers"),
    "m09_symbol_pool": "SELECT CAST(r_regionkey AS BIGINT) AS id, '200 true' AS names FROM region",
    "m10_mask_round_trip": case_sql([c[1] for c in MASKED], "whole"),
    "m11_unmask": case_sql([c[2] for c in RESTORES], "text"),
    "m13_leaks": case_sql([c[1] for c in LEAKS], "kinds"),
}
