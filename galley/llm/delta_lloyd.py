"""Vector codes of a product quantiser, trained by a Lloyd iteration that only moves differences.

Vectors are scaled to integers and cut into parts; every part position has its own codebook. Vectors lie in a table that
is bucketed by row, and so does the assignment that each round persists, so a round joins the two without a shuffle. A
round assigns all parts to the codebooks of the round before (16 entries a part: a small constant) and keeps, per Arrow
batch, the sums and counts that parts which changed their entry take away from the old one and add to the new one. Only
these differences are shuffled, as 128 partial rows a task at most; added to the running integer sums, which are a
written table too, they give the next codebooks. All arithmetic is on integers, so results do not depend on order.

Handling: vectors that are null, or hold a null or non-finite component, are dropped. So are those whose length is not
the one in force: the commonest among lengths that can be cut into PARTS equal parts (ties: the shorter). So are
components beyond about 32,000, whose squared distances a long cannot hold. With fewer than ENTRIES vectors there are
fewer entries. Rows that share a vec_id count each, ordered by their components where they tie; a null vec_id comes
last. Labels are taken together if equal, nulls together; a label's sum that no long can hold is null. An empty table
gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import Scratch, freeing, join_named

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a bucket: some 130 MB of 64 components.
BUCKET_ROWS = 500_000
DELTA = "delta array<struct<part: int, entry: int, n: long, sums: array<long>>>"


def most(length: int) -> int:
    """The largest component, as an integer, with which no sum of squared distances passes a long."""
    return math.isqrt((1 << 62) // max(1, length)) // 2


def scaled(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label and the integers x of the vectors that are kept, their length)."""
    number = lambda x: x.cast("double")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    finite = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.transform("embedding", number).alias("v")).where(usable & (F.size("v") > 0) & (F.size("v") % parts == 0))
    common = finite.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("length", F.struct("n", -F.col("length")))).first()[0]
    length = common or parts
    fits = (F.size("v") == length) & F.forall("v", lambda x: F.abs(x) * scale < most(length))
    return finite.where(fits).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("x")), length


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every part of every vector; x is rows by parts by components, ties go to the lower entry."""
    codes, far = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        d = np.stack([((x[:, p] - c) ** 2).sum(1) for c in books[p]], axis=1)
        codes[:, p] = d.argmin(1)
        far[:, p] = np.take_along_axis(d, codes[:, p, None], 1)[:, 0]
    return codes, far


def differences(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> list[dict]:
    """What the parts that changed their entry add to and take from the sums and counts; old is None in the first round."""
    out = []
    for p in range(x.shape[1]):
        moved = np.ones(len(x), bool) if old is None else old[:, p] != new[:, p]
        n, sums = np.zeros(entries, np.int64), np.zeros((entries, x.shape[2]), np.int64)
        np.add.at(sums, new[moved, p], x[moved, p])
        np.add.at(n, new[moved, p], 1)
        if old is not None:
            np.subtract.at(sums, old[moved, p], x[moved, p])
            np.subtract.at(n, old[moved, p], 1)
        out += [{"part": p, "entry": e, "n": int(n[e]), "sums": sums[e].tolist()} for e in range(entries) if n[e] or sums[e].any()]
    return out


class DeltaLloyd:
    """Codebooks of the vectors' parts, trained round by round; every round leaves its assignment and sums in the shared folder."""

    def __init__(self, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE):
        self.spark, self.parts = vectors.sparkSession, parts
        self.scratch = Scratch(self.spark, "delta-lloyd")
        kept, self.length = scaled(vectors, parts, scale)
        first = kept.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
        self.entries, self.rounds, self.previous = len(first), 0, None
        self.books = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, self.length // parts).transpose(1, 0, 2)
        numbered = kept.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "x")
        self.rows = self.scratch.write(numbered, "rows")
        self.total = self.rows.count()
        self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.total // BUCKET_ROWS))
        self.vectors = self.scratch.bucketed(self.rows.repartition(self.buckets, "rid"), "vectors", self.buckets, "rid")
        self.scratch.drop("rows")
        self.sums = None

    def step(self) -> None:
        """One round: all parts are assigned, what changed moves the sums, and the sums give the next codebooks."""
        books, parts, entries, first = self.books, self.parts, self.entries, self.previous is None
        rows = self.vectors.select("rid", "x")
        if not first:
            rows = rows.join(self.previous.select("rid", "codes").hint("shuffle_hash"), "rid").select("rid", "x", "codes")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _integers(b.column(1)).reshape(b.num_rows, parts, -1)
                codes, _ = nearest(x, books)
                old = None if first else np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                made = pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary())
                delta = pa.array([differences(x, old, codes, entries), *[None] * (b.num_rows - 1)], _DELTA)
                yield pa.RecordBatch.from_arrays([b.column(0), made, delta], ["rid", "codes", "delta"])

        assigned = self.scratch.bucketed(rows.mapInArrow(freeing(run), f"rid long, codes binary, {DELTA}"), f"codes_{self.rounds}", self.buckets, "rid")
        changed = assigned.where("delta is not null").select(F.explode("delta").alias("d")).select("d.part", "d.entry", "d.n", "d.sums")
        width = self.length // parts
        together = changed if self.sums is None else self.sums.union(changed)
        added = together.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)))
        sums = self.scratch.write(added.select("part", "entry", "n", F.array(*(f"s{k}" for k in range(width))).alias("sums")), f"sums_{self.rounds}")
        self.books = books.copy()
        for r in sums.where("n > 0").collect():  # parts x entries rows, whatever the table's size
            self.books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
        for old in (f"codes_{self.rounds - 1}", f"sums_{self.rounds - 1}"):
            self.scratch.drop_tables(old)
            self.scratch.drop(old)
        self.previous, self.sums, self.rounds = assigned, sums, self.rounds + 1

    def train(self, rounds: int = ROUNDS) -> DeltaLloyd:
        for _ in range(rounds if self.entries else 0):
            self.step()
        return self

    def encode(self) -> DataFrame:
        """vec_id, label, codes (a byte a part), error: all vectors against the codebooks as they are now."""
        books, parts, empty = self.books, self.parts, not self.entries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or empty:
                    continue
                codes, far = nearest(_integers(b.column(1)).reshape(b.num_rows, parts, -1), books)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary()), pa.array(far.sum(1))], ["rid", "codes", "error"])

        made = self.vectors.select("rid", "x").mapInArrow(freeing(run), "rid long, codes binary, error long")
        coded = self.scratch.bucketed(made, "encoded", self.buckets, "rid")
        return self.vectors.select("rid", "vec_id", "label").join(coded.hint("shuffle_hash"), "rid").select("vec_id", "label", "codes", "error")

    def digest(self) -> str:
        """Hash of all entries' components in order of part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


_DELTA = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _integers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = DeltaLloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")).train()
    named = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = model.scratch.write(model.encode().select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", named.alias("named")), "coded")
    errors = coded.groupBy("named").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    out = join_named(coded, model.scratch.write(errors, "errors"), "named", "n", model.total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Every round is three steps: distances to the entries of the round before, the nearest entry, the means of what it got."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
d{k} AS MATERIALIZED (SELECT v.rid, v.part, b.entry, sum((x[i] - y[i]) * (x[i] - y[i])) AS far
  FROM parts v JOIN b{k} b USING (part) CROSS JOIN (SELECT unnest(range(1, w + 1)) AS i FROM width) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT rid, part, arg_min(entry, far * {ENTRIES} + entry) AS entry, min(far) AS far FROM d{k} GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
m{k} AS (SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN parts USING (rid, part) CROSS JOIN (SELECT unnest(range(1, w + 1)) AS i FROM width) GROUP BY ALL),
n{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM m{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.y, b.y) AS y FROM b{k} b LEFT JOIN n{k} n USING (part, entry))""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT any_value(len(v)) // {PARTS} AS w FROM kept),
parts AS MATERIALIZED (SELECT rid, part, v[part * w + 1:(part + 1) * w] AS x FROM kept, width, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, rid AS entry, x AS y FROM parts WHERE rid < {ENTRIES}),
{",".join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
"""


OP11_SQL = _sql()
