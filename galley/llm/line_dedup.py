"""Cross-site boilerplate: lines found on many different sites, by HyperLogLog sketches. DataFrame functions only.

Each line is two 64-bit hashes; its sites are a HyperLogLog sketch per hash, built per task and merged by aggregation.
A line that occurs on fewer rows than the threshold cannot be on that many sites, so only the others are sketched.
Where the estimate is near the threshold, the sites are counted exactly. A document's boilerplate, as hashes, is sent to
the texts if all of it is small, which is measured first; else texts move once, in that join. A line that a third of
the rows share adds one row to its groups per task.

Nulls: a null text is empty and a null source is a site of its own. Empty lines are never boilerplate. A row with a
null doc_id is cleaned like any other. Rows that share a doc_id are each cleaned. An empty table gives no rows. Columns
other than doc_id, text and source are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import BROADCAST_BYTES, Scratch, small, text_or_empty

#: Sites from which a line counts as boilerplate; log2 of the sketch's registers; estimates within this share of SITES are counted.
SITES, LOG_K, NEAR = 10, 12, 0.25


def _key(line):
    line = F.trim(line)
    return F.when(line != "", F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")))


def spread_lines(docs: DataFrame, scratch: Scratch, sites: int = SITES) -> DataFrame:
    """(doc_id, key) of the lines that are on at least `sites` different sites."""
    exploded = docs.select("doc_id", F.col("source").alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    lines = scratch.write(exploded.select("doc_id", "site", _key(F.col("line")).alias("key")).where("key is not null").select("doc_id", "site", "key.h1", "key.h2"), "lines")
    often = scratch.write(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select("h1", "h2"), "often")
    side = F.broadcast(often) if small(often, 32) else often
    sketched = lines.join(side, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"))
    guess = scratch.write(sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("guess")), "guess")
    near = guess.where((F.col("guess") >= sites * (1 - NEAR)) & (F.col("guess") <= sites * (1 + NEAR))).select("h1", "h2")
    side = F.broadcast(near) if small(near, 32) else near
    exact = lines.join(side, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= sites).select("h1", "h2")
    sure = guess.where(F.col("guess") > sites * (1 + NEAR)).select("h1", "h2")
    boilerplate = scratch.write(sure.union(exact), "boilerplate")
    side = F.broadcast(boilerplate) if small(boilerplate, 32) else boilerplate
    return lines.join(side, ["h1", "h2"], "left_semi").select("doc_id", F.struct("h1", "h2").alias("key"))


def remove_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, text (without boilerplate lines), n_lines, n_removed."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    tidy = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_or_empty())
    hits = scratch.write(spread_lines(tidy, scratch, sites).groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "hits")
    sent = hits.agg(F.coalesce(F.sum(F.size("keys") * 16 + 64), F.lit(0)).alias("bytes")).first()["bytes"] <= BROADCAST_BYTES
    keys = hits.withColumnRenamed("doc_id", "__id")
    joined = tidy.join(F.broadcast(keys) if sent else keys, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains("keys", _key(x)), F.lit(False))))
    out = joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM t),
b AS (SELECT trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {SITES}),
m AS (SELECT l.r, l.k, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON trim(l.line) = b.line),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY r)
SELECT t.doc_id, a.n_lines, a.n_removed, CAST(length(a.text) AS BIGINT) AS kept_chars, sha256(a.text) AS text_sha256 FROM t JOIN a USING (r)
"""
