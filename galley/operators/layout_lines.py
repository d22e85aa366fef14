"""Repeated marginalia: lines that recur over many pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def repeated_lines(pages: DataFrame, page: str, text: str, least: int = 3) -> DataFrame:
    """Normalised lines (lower case, single spaces, trimmed) found on at least `least` different pages.

    Null texts hold no lines and empty lines do not count.
    """
    lines = pages.select(F.col(page).alias("page"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    norm = F.trim(F.regexp_replace(F.lower("line"), r"[ \t\r\x0B\f]+", " "))
    return lines.select("page", norm.alias("line")).where(F.col("line") != "").groupBy("line").agg(F.countDistinct("page").alias("n_pages"), F.count(F.lit(1)).alias("n_lines")).where(F.col("n_pages") >= max(3, least))


def l05_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


QUERIES = {"l05_repeated_lines": l05_repeated_lines}

ORACLE_SQL = {
    "l05_repeated_lines": r"""
SELECT line, count(DISTINCT doc_id) AS n_pages, count(*) AS n_lines
FROM (SELECT doc_id, trim(regexp_replace(lower(l), '[ \t\r\x0B\f]+', ' ', 'g')) AS line
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3
""",
}
