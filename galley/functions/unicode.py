"""Compatibility composition, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC. Texts of ASCII alone, which it does not change, are not sent to Python."""
    return F.coalesce(_composed(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)), c)
