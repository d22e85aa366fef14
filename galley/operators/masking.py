"""Occurrences of masked numbers as a table: what two symbols have to do with one another, and fragments written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import fragments
from galley.functions.unicode import nfkc
from galley.operators.claims import applied
from galley.sources.tables import read

#: Powers of ten by which a surface is read wrongly.
SPLITS = (3, 4, 6, 8, 9, 12)


def _interval(micro: Column, quantum: Column) -> tuple[Column, Column]:
    """The amounts that a display may stand for, half-open: half a unit of its last digit around it."""
    q = F.greatest(quantum, F.lit(1).cast("decimal(38,0)"))
    half = F.floor(q / 2)
    return F.abs(micro) - half, F.abs(micro) + (q - half)


def compatible_symbols(pairs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(job_id, a, b, compatible): two symbols (pairs: job_id, a, b) that may be the same amount.

    Some displays overlap, and none of the same precision are apart. occurrences: job_id, symbol, micro, quantum, namespace.
    """
    side = lambda s: occurrences.where("micro is not null").select("job_id", F.col("symbol").alias(s), *(e.alias(f"{n}_{s}") for e, n in zip(_interval(F.col("micro"), F.col("quantum")), ("low", "high"), strict=True)), F.col("quantum").alias(f"q_{s}"), F.coalesce("namespace", F.lit("amount")).alias(f"ns_{s}")).distinct()
    both = pairs.where("a <> b").join(side("a"), ["job_id", "a"]).join(side("b"), ["job_id", "b"]).where("ns_a = ns_b")
    meets = (F.col("low_a") < F.col("high_b")) & (F.col("low_b") < F.col("high_a"))
    told = both.groupBy("job_id", "a", "b").agg((F.bool_or(meets) & ~F.bool_or(~meets & (F.col("q_a") == F.col("q_b")))).alias("told"))
    return pairs.join(told, ["job_id", "a", "b"], "left").select("job_id", "a", "b", F.when(F.col("a") == F.col("b"), True).otherwise(F.coalesce("told", F.lit(False))).alias("compatible"))


def surface_digits(raw: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(nfkc(F.coalesce(raw, F.lit(""))), r"[,\s]", ""), r"[0-9]+(?:\.[0-9]+)?", 0)


def symbol_splits(occurrences: DataFrame) -> DataFrame:
    """(job_id, a, b, digits, kind): pairs of symbols whose surfaces are equal but whose amounts are a scale apart.

    inferred-scale-split if all such surfaces of a side had a scale that was guessed (sure is false), else
    explicit-scale-conflict. occurrences: job_id, symbol, raw, micro, sure, namespace.
    """
    o = occurrences.where(F.col("micro").isNotNull() & (F.col("micro") != 0) & (F.coalesce("namespace", F.lit("amount")) == "amount"))
    o = o.select("job_id", "symbol", surface_digits(F.col("raw")).alias("digits"), F.abs(F.col("micro").cast("decimal(38,0)")).alias("size"), F.coalesce("sure", F.lit(False)).alias("sure")).where("digits <> ''")
    o = o.groupBy("job_id", "digits", "symbol", "size").agg(F.bool_or("sure").alias("sure"))
    side = lambda s: o.select("job_id", "digits", F.col("symbol").alias(s), F.col("size").alias(f"size_{s}"), F.col("sure").alias(f"sure_{s}"))
    both = side("a").join(side("b"), ["job_id", "digits"]).where("a < b")
    large, small = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    apart = F.lit(False)
    for power in SPLITS:
        apart = apart | (large == small * F.lit(10**power).cast("decimal(13,0)"))
    kind = F.when(F.bool_or("sure_a") & F.bool_or("sure_b"), "explicit-scale-conflict").otherwise("inferred-scale-split")
    return both.where(apart).groupBy("job_id", "a", "b").agg(F.min("digits").alias("digits"), kind.alias("kind"))


def symbol_families(occurrences: DataFrame) -> DataFrame:
    """(job_id, symbol, status, family): known if all occurrences are of one unit family, ambiguous if some are of one or several, unknown without any."""
    family = F.nullif("family", F.lit(""))
    n, none = F.count_distinct(family), F.count(F.when(family.isNull(), 1))
    status = F.when((n == 1) & (none == 0), "known").when(n > 0, "ambiguous").otherwise("unknown")
    return occurrences.groupBy("job_id", "symbol").agg(status.alias("status"), F.when((n == 1) & (none == 0), F.min(family)).alias("family"))


def compare_families(pairs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(job_id, a, b, relation): same or disjoint unit families; unknown unless both sides' are known."""
    f = symbol_families(occurrences)
    side = lambda s: f.where("status = 'known'").select("job_id", F.col("symbol").alias(s), F.col("family").alias(f"family_{s}"))
    both = pairs.join(side("a"), ["job_id", "a"], "left").join(side("b"), ["job_id", "b"], "left")
    return both.select("job_id", "a", "b", F.when(F.col("family_a") == F.col("family_b"), "same").when(F.col("family_a").isNotNull() & F.col("family_b").isNotNull(), "disjoint").otherwise("unknown").alias("relation"))


def restored_fragments(texts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(id, readings) of fragments (id, job_id, lang, text): the one to show, then others as they may stand in the document.

    Each fragment meets the occurrences (job_id, at, symbol, raw, lang, micro, quantum, power) of its own symbols only.
    """
    symbols = texts.select("id", "job_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("⟦#([A-Z]{3})⟧"), F.lit(1)))).alias("symbol"))
    record = F.struct("at", "symbol", "raw", "lang", F.col("micro").cast("string").alias("micro"), F.col("quantum").cast("string").alias("quantum"), "power")
    # surfaces repeat: of equal ones the first counts
    once = occurrences.groupBy("job_id", "symbol", "raw", "lang", "micro", "quantum", "power").agg(F.min("at").alias("at"))
    records = symbols.join(once, ["job_id", "symbol"]).groupBy("id").agg(F.array_sort(F.collect_list(record)).alias("records"))

    def read_out(text: str | None, lang: str, found: list[dict] | None) -> list[str]:
        known = [r | {"micro": int(r["micro"]), "quantum": int(r["quantum"])} for r in found or []]
        text = text or ""
        return list(dict.fromkeys([fragments.restored(text, lang, known), *fragments.variants(text, lang, known)]))

    return applied(texts.join(records, "id", "left"), read_out, ["text", "lang", "records"], "readings", "array<string>")


# Orders stand for jobs, their lines for occurrences: line n is symbol A, B or C by its return flag.


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.max("l_tax").alias("tax"))
    symbol = F.when(F.col("flag") == "A", "AAA").when(F.col("flag") == "N", "NNN").otherwise("RRR")
    power = F.when(F.col("flag") == "A", 6).when(F.col("flag") == "N", 9).otherwise(0)
    micro = F.element_at(F.array(*(F.lit(584 * 10 ** (6 + p)).cast("decimal(38,0)") for p in (6, 9, 0))), F.when(F.col("flag") == "A", 1).when(F.col("flag") == "N", 2).otherwise(3))
    quantum = F.element_at(F.array(*(F.lit(10 ** (6 + p)).cast("decimal(38,0)") for p in (6, 9, 0))), F.when(F.col("flag") == "A", 1).when(F.col("flag") == "N", 2).otherwise(3))
    family = F.when(F.col("status") == "O", "money").when(F.col("tax") > 0.07, "units")
    return li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("at"), symbol.alias("symbol"), F.when(F.col("flag") == "A", "584 million").when(F.col("flag") == "N", "584 billion").otherwise("584").alias("raw"), F.lit("en").alias("lang"), micro.alias("micro"), quantum.alias("quantum"), power.alias("power"), family.alias("family"), (F.col("tax") > 0.05).alias("sure"), F.lit("amount").alias("namespace"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("AAA").alias("a"), F.when(F.col("o_orderstatus") == "F", "NNN").when(F.col("o_orderstatus") == "O", "RRR").otherwise("AAA").alias("b"))


def m15_compatible(spark, d):
    o = _occurrences(spark, d)
    # one of the displays of N is coarse enough to hold A's amount
    wide = o.withColumn("quantum", F.when((F.col("symbol") == "NNN") & (F.col("at") > 3), F.lit(str(10**19)).cast("decimal(38,0)")).otherwise(F.col("quantum")))
    return compatible_symbols(_pairs(spark, d), wide)


def m15_families(spark, d):
    return compare_families(_pairs(spark, d), _occurrences(spark, d))


def a18_symbol_splits(spark, d):
    return symbol_splits(_occurrences(spark, d))


def m12_fragments(spark, d):
    lang = F.when(F.col("o_orderstatus") == "F", "en").otherwise("ja")
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "was ⟦#AAA⟧ billion and ⟦#ZZZ⟧").when(F.col("o_orderpriority") == "2-HIGH", "was ⟦#AAA⟧ and ⟦#NNN⟧").otherwise("no symbol")
    return restored_fragments(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("job_id"), lang.alias("lang"), text.alias("text")), _occurrences(spark, d)).select("id", F.array_join("readings", "|").alias("readings"))


QUERIES = {f.__name__: f for f in (m12_fragments, m15_compatible, m15_families, a18_symbol_splits)}

_O = """
WITH o AS (SELECT l_orderkey AS job_id, l_linenumber AS "at", min(l_returnflag) AS f, CASE WHEN max(l_linestatus) = 'O' THEN 'money' WHEN max(l_tax) > 0.07 THEN 'units' END AS family, max(l_tax) > 0.05 AS sure FROM lineitem GROUP BY 1, 2),
s AS (SELECT job_id, f, repeat(f, 3) AS symbol, bool_or(sure) AS sure, CASE WHEN count(DISTINCT family) = 1 AND count(*) = count(family) THEN min(family) END AS family, max("at") AS latest FROM o GROUP BY 1, 2),
p AS (SELECT o_orderkey AS job_id, 'AAA' AS a, CASE o_orderstatus WHEN 'F' THEN 'NNN' WHEN 'O' THEN 'RRR' ELSE 'AAA' END AS b FROM orders)
"""

ORACLE_SQL = {
    "m12_fragments": _O + """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN x.symbol IS NULL THEN 'was ⟦#AAA⟧ billion and ⟦#ZZZ⟧' WHEN o_orderstatus = 'F' THEN 'was 0.584 billion and ⟦#ZZZ⟧|was 584 million billion and ⟦#ZZZ⟧' ELSE 'was 584 million billion and ⟦#ZZZ⟧' END
  WHEN o_orderpriority = '2-HIGH' THEN 'was ' || CASE WHEN x.symbol IS NULL THEN '⟦#AAA⟧' ELSE '584 million' END || ' and ' || CASE WHEN y.symbol IS NULL THEN '⟦#NNN⟧' ELSE '584 billion' END ELSE 'no symbol' END AS readings
FROM orders LEFT JOIN s x ON x.job_id = o_orderkey AND x.symbol = 'AAA' LEFT JOIN s y ON y.job_id = o_orderkey AND y.symbol = 'NNN'
""",
    "m15_compatible": _O + """
SELECT p.job_id, a, b, CASE WHEN a = b THEN true WHEN b = 'RRR' THEN false ELSE coalesce(x.symbol IS NOT NULL AND y.latest > 3, false) END AS compatible
FROM p LEFT JOIN s x ON x.job_id = p.job_id AND x.symbol = a LEFT JOIN s y ON y.job_id = p.job_id AND y.symbol = b
""",
    "m15_families": _O + "SELECT p.job_id, a, b, CASE WHEN x.family = y.family THEN 'same' WHEN x.family IS NOT NULL AND y.family IS NOT NULL THEN 'disjoint' ELSE 'unknown' END AS relation FROM p LEFT JOIN s x ON x.job_id = p.job_id AND x.symbol = a LEFT JOIN s y ON y.job_id = p.job_id AND y.symbol = b",
    "a18_symbol_splits": _O + "SELECT x.job_id, x.symbol AS a, y.symbol AS b, '584' AS digits, CASE WHEN x.sure AND y.sure THEN 'explicit-scale-conflict' ELSE 'inferred-scale-split' END AS kind FROM s x JOIN s y ON x.job_id = y.job_id AND x.symbol < y.symbol",
}
