"""Hashes that Spark lacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def fnv1a32(texts: pd.Series) -> pd.Series:
    """32-bit FNV-1a over UTF-16 code units; null for null. A batch is hashed position by position, in numpy."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2") if t is not None else None for t in texts]
    h = np.full(len(units), 0x811C9DC5, dtype=np.uint64)
    for k in range(max((len(u) for u in units if u is not None), default=0)):
        rows = [i for i, u in enumerate(units) if u is not None and len(u) > k]
        h[rows] = ((h[rows] ^ np.array([units[i][k] for i in rows], dtype=np.uint64)) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF)
    return pd.Series([int(x) if u is not None else None for x, u in zip(h, units, strict=True)], dtype="Int64")
