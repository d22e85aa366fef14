"""Exact duplicates against an immutable snapshot: binary fuse filters screen, exact buckets decide.

A snapshot keeps, per shard of the digest space, a static binary fuse filter and a bucket of exact rows (digest, rows,
row that stays). It is a folder that is written once and read for any number of batches. Digests of a new batch meet
only the filter of their shard; those that it passes, few but for duplicates, are joined with the exact buckets, whose
other rows stay as they were written. Digests that the filter rejects are new: they are grouped among the batch alone.
Every group of equal digests is then compared byte by byte. Texts are moved only for rows that look like duplicates,
after a map-side combine, so a text that a third of the rows share is sent once per task; and the few groups that hold
a thousandth of all rows or more are sent to their rows rather than shuffled to one task.

Nulls: a null text is an empty one; a row with a null doc_id takes part and is never preferred to another row. Rows
that repeat a doc_id and its text are duplicates of which one stays. An empty table gives an empty result. Other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.binary_fuse import BinaryFuse
from galley.llm.common import Scratch, ascii_lower, free_name, join_named, small, text_or_empty

SHARD_KEYS = 500_000
NO_ID = -(2**63)
GROUP, FILTER = "digest binary, n long, top long, rid long", "shard long, shards long, seed long, segment long, count long, prints binary"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keys(digests) -> np.ndarray:
    return np.array([int.from_bytes(d[:8].ljust(8, b"\0"), "little") for d in digests], dtype=np.uint64)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top"), F.max_by("rid", "top").alias("rid"))


class Snapshot:
    """groups: one row per digest (n rows; top and rid name the row that stays); filters: one binary fuse filter a shard."""

    def __init__(self, groups: DataFrame, filters: DataFrame, shards: int):
        self.groups, self.filters, self.shards = groups, filters, shards

    @classmethod
    def build(cls, groups: DataFrame, folder: str, rows: int) -> Snapshot:
        """Written to a folder that all executors see. rows: about how many digests there are."""
        spark, shards = groups.sparkSession, max(32, -(-rows // SHARD_KEYS))

        def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            f = BinaryFuse.build(_keys(part["digest"]))
            return pd.DataFrame({"shard": [key[0]], "shards": [shards], "seed": [f.seed], "segment": [f.segment], "count": [f.count], "prints": [f.prints.tobytes()]})

        groups.select("digest", "n", "top", "rid").write.parquet(f"{folder}/groups")
        written = spark.read.schema(GROUP).parquet(f"{folder}/groups")
        filters = written.select("digest", _shard(shards)).groupBy("shard").applyInPandas(build, FILTER)
        filters.write.parquet(f"{folder}/filters")
        return cls(written, spark.read.schema(FILTER).parquet(f"{folder}/filters"), shards)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Snapshot:
        """A snapshot that build() has written; one without rows has a single empty shard."""
        filters = spark.read.schema(FILTER).parquet(f"{folder}/filters")
        first = filters.select("shards").first()
        return cls(spark.read.schema(GROUP).parquet(f"{folder}/groups"), filters, first["shards"] if first else 1)

    def meet(self, batch: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """(digests of the snapshot that the batch has too, with the groups of both as one; digests that are new) for the batch's groups."""
        screened = scratch.write(self.screen(batch), "screened")
        asked = screened.where("positive").select("digest", F.col("n").alias("n2"), F.col("top").alias("top2"), F.col("rid").alias("rid2"))
        side = F.broadcast(asked) if small(asked, 72) else asked
        best = F.col("top") >= F.col("top2")
        merged = self.groups.join(side, "digest").select("digest", (F.col("n") + F.col("n2")).alias("n"), F.greatest("top", "top2").alias("top"), F.when(best, F.col("rid")).otherwise(F.col("rid2")).alias("rid"))
        met = scratch.write(merged, "met")
        known = met.select("digest")
        passed = screened.where("positive").join(F.broadcast(known) if small(known, 40) else known, "digest", "left_anti")
        return met, screened.where(~F.col("positive")).union(passed).drop("positive")

    def screen(self, groups: DataFrame) -> DataFrame:
        """The batch's groups with `positive`: false means surely not in the snapshot."""

        def screen(part: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            part = part.drop(columns="shard")
            if len(filters) == 0 or len(part) == 0:
                return part.assign(positive=False)
            f = filters.iloc[0]
            found = BinaryFuse(int(f["seed"]), int(f["segment"]), int(f["count"]), np.frombuffer(f["prints"], dtype=np.uint8)).has(_keys(part["digest"]))
            return part.assign(positive=found)

        batch = groups.withColumn("shard", _shard(self.shards))
        return batch.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(screen, f"{GROUP}, positive boolean")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


def exact_duplicates(docs: DataFrame, in_snapshot: Column | None = None, digest=sha256) -> DataFrame:
    """One row per document: rid, doc_id, keep_id, group_size, kept, digest. in_snapshot marks the rows that form the snapshot; the rest is the new batch."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    if in_snapshot is None:
        in_snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(text_or_empty()).alias("text"))
    hashed = base.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    rows = scratch.write(hashed.select("*", F.monotonically_increasing_id().alias("rid"), F.coalesce("doc_id", F.lit(NO_ID)).alias("top")), "rows")

    total = rows.count()
    snapshot = Snapshot.build(_grouped(rows.where("old")), f"{scratch.top}/snapshot", total)
    met, new = snapshot.meet(_grouped(rows.where(~F.col("old"))), scratch)
    touched = met.select("digest")
    untouched = snapshot.groups.join(F.broadcast(touched) if small(touched, 40) else touched, "digest", "left_anti")
    classes = scratch.write(untouched.union(met).union(new).select("digest", "n", "top", "rid"), "classes")

    suspects = scratch.write(classes.where("n > 1").select("digest"), "suspects")
    side = F.broadcast(suspects) if small(suspects, 48) else suspects
    hashed_texts = base.withColumn("digest", digest(F.col("text")))
    texts = hashed_texts.join(side, "digest", "left_semi").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    unequal = scratch.write(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "unequal")

    out = ["rid", "doc_id", "keep_id", "group_size", "kept", "digest"]
    named = classes.select("digest", F.col("n").alias("group_size"), F.col("rid").alias("keep_rid"), F.when(F.col("top") != NO_ID, F.col("top")).alias("keep_id"))
    joined = join_named(rows, named, "digest", "group_size", total).withColumn("kept", F.col("rid") == F.col("keep_rid"))
    if unequal.isEmpty():
        return joined.select(out)
    # texts that share a digest without being equal: these few are grouped by their bytes
    apart = base.withColumn("digest", digest(F.col("text"))).withColumn("rid", F.monotonically_increasing_id()).join(unequal, "digest", "left_semi")
    apart = scratch.write(apart.withColumn("top", F.coalesce("doc_id", F.lit(NO_ID))), "apart")
    by_text = apart.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), F.max("top").alias("best"), F.max_by("rid", "top").alias("keep_rid"))
    split = apart.join(by_text, ["digest", "text"]).withColumn("keep_id", F.when(F.col("best") != NO_ID, F.col("best"))).withColumn("kept", F.col("rid") == F.col("keep_rid"))
    return joined.join(unequal, "digest", "left_anti").select(out).union(split.select(out))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = exact_duplicates(docs)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns, whatever they are called. Only what goes is joined, so texts move only where that side is too large to send.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays, a null doc_id only if there is no
    other. Of rows that repeat both, any one stays. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup-keep")
    own, one, other, stays = (free_name(docs, n) for n in ("own_digest", "said_id", "said_digest", "stays"))
    found = exact_duplicates(docs).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept"))
    found = scratch.write(found.where("n > 1 or not kept").select(F.col("doc_id").alias(one), F.col("digest").alias(other), F.col("kept").alias(stays)), "found")
    side = F.broadcast(found) if small(found, 64) else found
    marked = docs.withColumn(own, sha256(ascii_lower(text_or_empty())))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.col(own) == F.col(other))
    rest = marked.join(side, match, "left_anti").drop(own)
    twins = found.where(F.col(stays))
    if twins.isEmpty():
        return rest
    return rest.union(marked.join(twins, match, "left_semi").dropDuplicates(["doc_id", own]).drop(own))
