"""Findings with known outcomes: each order stands for one of a list of cases, in turn, so a query returns a row for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.sources.tables import read


def case_rows(spark: SparkSession, d: str, cases: list[tuple], schema: str) -> DataFrame:
    """(id, the columns of schema): the order's key and its case."""
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, {schema}")  # as many rows as there are cases
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_orderkey", F.lit(len(cases))).cast("int").alias("k"))
    return orders.join(F.broadcast(table), "k").drop("k")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (bool, int, float)):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'"


def case_sql(outcomes: list, name: str) -> str:
    """The outcome of each order's case."""
    rows = ", ".join(f"({k}, {_literal(x)})" for k, x in enumerate(outcomes))
    return f'SELECT o_orderkey AS id, r AS "{name}" FROM orders JOIN (VALUES {rows}) c(k, r) ON o_orderkey % {len(outcomes)} = k'
