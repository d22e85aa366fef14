"""Looks at the physical plan that Catalyst chose, so that tests can hold it to what is wanted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def all_pairs(df: DataFrame) -> bool:
    """Whether the plan joins every row with every row."""
    return bool(re.search("CartesianProduct|BroadcastNestedLoopJoin", physical(df)))


def columns_read(df: DataFrame) -> set[str]:
    """Columns that the Parquet scans read."""
    return {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) for c in schema.split(",") if c}


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan."""
    return len(re.findall(r"\bExchange (?:hash|range|Round|Single)", physical(df)))
