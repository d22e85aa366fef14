"""Long repeats across documents, by a logarithmic family of suffix arrays.

A match is a string of LENGTH bytes that also starts in a document with a smaller doc_id. Each string has an anchor: of
the K-byte strings in it, the first of those with the smallest hash. Equal strings have the same anchor at the same
place, so they meet in the shard of its hash; and neighbouring strings mostly share one, so about one position in 14 is
an anchor.

1. Texts are written once, in runs of about RUN bytes, in tables bucketed by run: no later step shuffles a text.
2. Screen: the anchors of a run, as sorted 32-bit numbers a shard, are merged by shard. Only those seen in two rows or
   more go on; a false alarm costs time, nothing else.
3. The documents come in BATCHES of ascending doc_id. The stretches of a batch around its anchors (all strings of an
   anchor, which overlap, are one stretch; equal ones of a run are sent once) get a suffix array a shard: the places of
   all distinct strings in byte order, each with its smallest doc_id. It and the arrays of all existing levels are
   scanned with the batch's sorted strings, in byte order, for matches; then levels of equal size merge into one of
   twice the size (a merge of two sorted arrays). So a batch meets log2(batches) levels at most, and a string is
   rewritten log2(batches) times.
4. What matched goes back to the runs as spans, which are united and cut out.

Stretches of one run are collapsed by a 128-bit fingerprint; all else compares bytes. A task holds a run (RUN bytes and
its longest text) or one batch's share of a shard (a shard's anchors come from about SHARD bytes of text).

Handling: a null text is empty. A null doc_id is larger than any; rows that share a doc_id, or have none, do not match
each other, and each has a result. Matches within one document do not count. An empty table gives no rows. Columns other
than doc_id and the text are left out, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import Scratch, freed, freeing, text_or_empty

LENGTH, K = 50, 24
#: Bytes of text of a run and behind a shard; bytes that are hashed at once; fewest shards.
RUN, SHARD, STEP, LEAST_SHARDS = 8 << 20, 8 << 20, 1 << 16, 64
BATCHES = 4
#: What a row adds to its run besides its text.
ROW = 64
NO_ID = 2**63 - 1
_PLACE = np.uint64((1 << 17) - 1)
_B, _M1, _M2 = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

TEXTS = "batch int, run long, ord int, doc_id long, id long, size long, body binary"
LEVEL = "shard long, level int, text binary, starts binary, ids binary, places binary"
STRETCHES = "run long, shard long, text binary, ends binary, counts binary, ords binary, los binary, ids binary"
_ADDED = f"slot string, run long, ords binary, los binary, his binary, {LEVEL}"


def _schema(names: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in names.split(", ")])


def _table(names: str, rows: list[tuple]) -> pa.Table:
    schema = _schema(names)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _packed(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x)


def _unpacked(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _M2
    return x ^ (x >> np.uint64(29))


_BYTE = (np.arange(1, 257, dtype=np.uint64) * _M1) ^ ((np.arange(1, 257, dtype=np.uint64) * _M1) >> np.uint64(29))


def _times(gap: int) -> np.uint64:
    return np.uint64(pow(_B, gap, 1 << 64))


class Hashes:
    """Hashes of all K-byte strings of a piece of text, and of LENGTH-byte strings where they are asked for, by doubling."""

    def __init__(self, text: np.ndarray, wide: bool = True):
        self.by, self.n = {1: _BYTE[text]}, len(text)
        for size in (1, 2, 4, 8, 16)[: 5 if wide else 4]:
            h = self.by[size]
            self.by[2 * size] = h[:-size] * _times(size) + h[size:] if len(h) > size else h[:0]

    def short(self) -> np.ndarray:
        n = max(0, self.n - K + 1)
        return _mixed(self.by[8][:n] * _times(16) + self.by[16][8 : 8 + n])

    def long_at(self, at: np.ndarray) -> np.ndarray:
        return _mixed((self.by[32][at] * _times(16) + self.by[16][at + 32]) * _times(2) + self.by[2][at + 48])


def anchors(text: np.ndarray, prints: bool = True) -> Iterator[tuple]:
    """(anchor's hash, first and last start of the strings that have it, the Hashes, where the piece starts), piece by piece.

    The strings of an anchor that a piece's end divides come as two stretches: no harm, as strings are judged one by one.
    """
    for at in range(0, len(text) - LENGTH + 1, STEP):
        h = Hashes(text[at : at + STEP + LENGTH - 1], prints)
        short = h.short()
        # the place in the low bits: of equal hashes, the first one is the smallest
        least, size, width = (short & ~_PLACE) | np.arange(len(short), dtype=np.uint64), 1, LENGTH - K + 1
        while size < width:
            gap = min(size, width - size)
            least, size = np.minimum(least[:-gap], least[gap:]), size + gap
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        yield short[(least[first] & _PLACE).astype(np.int64)], at + first, at + np.r_[first[1:], len(least)] - 1, h, at


def _key(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard and, in the lower half, the number within it."""
    return (h & np.uint64((shards - 1) << 32 | 0xFFFFFFFF)).astype(np.int64)


def _parts(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the runs in sorted shards."""
    if not len(shard):
        return []
    at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(at, np.r_[at[1:], len(shard)], strict=True)]


def in_runs(docs: DataFrame, batches: int) -> DataFrame:
    """The documents in batches of ascending id, numbered within runs."""
    tidy = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.encode("text", "UTF-8").alias("body"))
    cuts = [c for c in tidy.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)] or [0.5], 1000)).first()[0] or [] if batches > 1]
    batch = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, runs, sizes, ords = TaskContext.get().partitionId(), {}, {}, {}
        for b in rows:
            size, out = pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64), []
            for k, n in zip(b.column(0).to_pylist(), size.tolist(), strict=True):
                if k not in runs or sizes[k] + n > RUN:
                    runs[k], sizes[k], ords[k] = len(runs) if k not in runs else runs[k] + batches, 0, 0
                out.append((task << 24 | runs[k], ords[k]))
                sizes[k], ords[k] = sizes[k] + n + ROW, ords[k] + 1
            if out:
                r, o = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r, pa.int64()), pa.array(o, pa.int32()), b.column(1), b.column(2), pa.array(size), b.column(3)], names=_schema(TEXTS).names)

    return tidy.select(batch.cast("int").alias("batch"), "doc_id", "id", "body").mapInArrow(freeing(run), TEXTS)


def screen(texts: DataFrame, shards: int) -> DataFrame:
    """(run, shard, keys): the anchors of each run that are in two rows or more, of any runs."""

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def sorted_keys(run: int) -> pa.RecordBatch:
            h = np.sort(np.concatenate(held.pop(run)))
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many, h = np.diff(np.r_[first, len(h)]) > 1, h[first]
            out = [(run, s, _packed(np.diff(h[a:b].astype(np.uint32), prepend=np.uint32(0))), np.packbits(many[a:b]).tobytes()) for s, a, b in _parts(h >> 32)]
            return _table("run long, shard long, keys binary, many binary", out).combine_chunks().to_batches()[0]

        for b in rows:
            for run, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if run not in held and held:
                    yield sorted_keys(next(iter(held)))
                text = np.frombuffer(body.as_buffer(), np.uint8)
                if found := [_key(h, shards) for h, *_ in anchors(text, False)]:
                    held.setdefault(run, []).append(np.unique(np.concatenate(found)))
        for run in list(held):
            yield sorted_keys(run)

    def repeated(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(k, np.uint32), dtype=np.uint32) for k in group["keys"]]
        many = [np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8))[: len(k)].astype(bool) for k, m in zip(keys, group["many"], strict=True)]
        seen = np.sort(np.concatenate(keys))
        again = np.union1d(seen[1:][seen[1:] == seen[:-1]], np.concatenate([k[m] for k, m in zip(keys, many, strict=True)]))
        again = np.r_[again, np.uint32(0xFFFFFFFF)]  # an end for the search: at most a false alarm
        both = [(r, s, k[again[np.searchsorted(again[:-1], k)] == k]) for r, s, k in zip(group["run"].to_pylist(), group["shard"].to_pylist(), keys, strict=True)]
        return _table("run long, shard long, keys binary", [(r, s, _packed(k)) for r, s, k in both if len(k)])

    sized = texts.where(F.col("size") >= LENGTH).select("run", "body")
    gathered = sized.mapInArrow(freeing(gather), "run long, shard long, keys binary, many binary")
    return gathered.groupBy("shard").applyInArrow(freed(repeated), "run long, shard long, keys binary")


def stretches(texts: DataFrame, hits: DataFrame | None, shards: int) -> DataFrame:
    """A row per run and shard: the different stretches around its anchors (only those among the hits, if given) and where they are in the run's documents."""

    def cut(group: pa.Table, found: pa.Table | None) -> pa.Table:
        if not group.num_rows or found is not None and not found.num_rows:
            return _table(STRETCHES, [])
        wanted = None
        if found is not None:
            wanted = np.sort(np.concatenate([_unpacked(k, np.uint32).astype(np.int64) | s << 32 for s, k in zip(found["shard"].to_pylist(), found["keys"], strict=True)]))
        run, cols = group["run"][0].as_py(), []
        bodies = [np.frombuffer(x.as_buffer(), np.uint8) for x in group["body"]]
        for row, text in enumerate(bodies):
            for h, lo, hi, piece, at in anchors(text):
                key = _key(h, shards)
                if wanted is not None:
                    keep = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                    key, lo, hi = key[keep], lo[keep], hi[keep]
                if len(key):
                    cols.append((key >> 32, piece.long_at(lo - at), piece.long_at(hi - at), hi - lo, np.full(len(key), row), lo))
        if not cols:
            return _table(STRETCHES, [])
        shard, p, q, more, row, lo = (np.concatenate(c) for c in zip(*cols, strict=True))
        order = np.lexsort((more, q, p, shard))
        shard, p, q, more, row, lo = (c[order] for c in (shard, p, q, more, row, lo))
        new = np.r_[True, (shard[1:] != shard[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (more[1:] != more[:-1])]
        ords, ids = group["ord"].to_numpy(), group["id"].to_numpy()
        out = []
        for s, a, b in _parts(shard):
            first = a + np.flatnonzero(new[a:b])
            text = b"".join(bodies[r][x : x + n].tobytes() for r, x, n in zip(row[first].tolist(), lo[first].tolist(), (more[first] + LENGTH).tolist(), strict=True))
            ends, counts = np.cumsum(more[first] + LENGTH), np.diff(np.r_[first, b])
            out.append((run, s, _packed(text), *(_packed(c) for c in (ends.astype(np.int32), counts.astype(np.int32), ords[row[a:b]].astype(np.int32), lo[a:b].astype(np.int64), ids[row[a:b]].astype(np.int64)))))
        return _table(STRETCHES, out)

    cut = freed(cut)
    by_run = texts.where(F.col("size") >= LENGTH).select("run", "ord", "id", "body").groupBy("run")
    if hits is None:
        return by_run.applyInArrow(lambda t: cut(t, None), STRETCHES)
    return by_run.cogroup(hits.groupBy("run")).applyInArrow(cut, STRETCHES)


def _strings(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The strings that start at the places, comparable as wholes: all have the same length, so stripped NULs do no harm."""
    return np.lib.stride_tricks.sliding_window_view(text, LENGTH)[places].view(f"S{LENGTH}").ravel() if len(places) else np.empty(0, f"S{LENGTH}")


class SuffixArray:
    """The places of a text's distinct strings in byte order. The text is stretches that begin at `starts`, each with the smallest doc_id that has it."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray, places: np.ndarray):
        self.text, self.starts, self.ids, self.places = text, starts, ids, places

    def id_of(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.starts, places, side="right") - 1]

    def distinct(self, order: np.ndarray, strings: np.ndarray) -> tuple[SuffixArray, np.ndarray, np.ndarray]:
        """(the array of the distinct strings, these strings, the group of each) for all places in the order of their strings. Of equal strings the first with the smallest doc_id stays."""
        if not len(order):
            return self, strings, np.empty(0, np.int64)
        places = self.places[order]
        head = np.r_[True, strings[1:] != strings[:-1]]
        ids, group, at = self.id_of(places), np.cumsum(head) - 1, np.flatnonzero(head)
        fit = np.flatnonzero(ids == np.minimum.reduceat(ids, at)[group])
        fit = fit[np.r_[True, group[fit][1:] != group[fit][:-1]]]
        return SuffixArray(self.text, self.starts, self.ids, places[fit]), strings[at], group

    def merge(self, other: SuffixArray) -> SuffixArray:
        """One sorted array of two."""
        n = len(self.text)
        both = SuffixArray(np.r_[self.text, other.text], np.r_[self.starts, other.starts + n], np.r_[self.ids, other.ids], np.r_[self.places, other.places + n])
        strings = np.r_[_strings(self.text, self.places), _strings(other.text, other.places)]
        order = np.argsort(strings, kind="stable")  # two sorted runs: merged in linear time
        return both.distinct(order, strings[order])[0]

    def smallest(self, strings: np.ndarray) -> np.ndarray:
        """For each of sorted strings, the smallest doc_id in which it starts, or NO_ID."""
        if not len(self.places):
            return np.full(len(strings), NO_ID)
        mine = _strings(self.text, self.places)
        at = np.minimum(np.searchsorted(mine, strings), len(mine) - 1)
        return np.where(mine[at] == strings, self.id_of(self.places[at]), NO_ID)

    def row(self) -> tuple:
        return tuple(map(_packed, (self.text, self.starts.astype(np.int64), self.ids.astype(np.int64), self.places.astype(np.int64))))

    @classmethod
    def read(cls, text: pa.Scalar, starts: pa.Scalar, ids: pa.Scalar, places: pa.Scalar) -> SuffixArray:
        return cls(*(_unpacked(x, kind) for x, kind in ((text, np.uint8), (starts, np.int64), (ids, np.int64), (places, np.int64))))


def _all_places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts - LENGTH + 1
    return np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def _level(group: pa.Table, k: int) -> SuffixArray:
    return SuffixArray.read(*(group[c][k] for c in range(2, 6)))


def add(batch: pa.Table, levels: pa.Table) -> pa.Table:
    """A shard's new level, and a row a run of what matched: strings with a smaller doc_id in the levels or in the batch."""
    if not batch.num_rows:
        return _table(_ADDED, [])
    arrays = {c: [_unpacked(x, kind) for x in batch[c]] for c, kind in (("text", np.uint8), ("ends", np.int32), ("counts", np.int32), ("ords", np.int32), ("los", np.int64), ("ids", np.int64))}
    sizes = np.array([len(t) for t in arrays["text"]])
    text, ends = np.concatenate(arrays.pop("text")), np.concatenate([e.astype(np.int64) + o for e, o in zip(arrays["ends"], np.cumsum(sizes) - sizes, strict=True)])
    starts = np.r_[0, ends[:-1]]
    firsts, lasts = _prints(text, starts, ends)
    counts, owners = np.concatenate(arrays["counts"]), np.concatenate(arrays["ids"])
    own = np.minimum.reduceat(owners, np.cumsum(counts) - counts)
    # equal stretches of different runs are one
    order = np.lexsort((own, ends - starts, lasts, firsts))
    f, g, n = firsts[order], lasts[order], (ends - starts)[order]
    head = np.r_[True, (f[1:] != f[:-1]) | (g[1:] != g[:-1]) | (n[1:] != n[:-1])]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(head) - 1
    kept = order[head]
    lengths = (ends - starts)[kept]
    begin = np.cumsum(lengths) - lengths
    short = text[np.repeat(starts[kept] - begin, lengths) + np.arange(lengths.sum())]
    del text
    # the suffix array of the different stretches, then the smallest doc_id of every string, here or in a level
    whole = SuffixArray(short, begin, own[kept], places := _all_places(begin, begin + lengths))
    strings = _strings(short, places)
    order = np.argsort(strings)
    level, strings, group = whole.distinct(order, strings[order])
    found = level.id_of(level.places)
    for k in range(levels.num_rows):
        found = np.minimum(found, _level(levels, k).smallest(strings))
    least = np.empty(len(places), np.int64)
    least[order] = found[group]
    del strings, group, order
    out = [("level", None, None, None, None, batch["shard"][0].as_py(), 0, *level.row())]
    # neighbouring strings of a stretch with the same smallest doc_id are one span
    of = np.repeat(np.arange(len(kept)), lengths - LENGTH + 1)
    cut = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (least[1:] != least[:-1])])
    till, stretch, who = np.r_[cut[1:], len(of)], of[cut], least[cut]
    start = places[cut] - begin[stretch]
    stop = start + (till - cut) - 1 + LENGTH
    at = np.searchsorted(stretch, np.arange(len(kept) + 1))
    # each occurrence of a stretch meets the spans of its kind
    occurrence_kind = np.repeat(kind, counts)
    spans = at[occurrence_kind + 1] - at[occurrence_kind]
    occurrence = np.repeat(np.arange(len(occurrence_kind)), spans)
    span = np.repeat(at[occurrence_kind] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    gone = who[span] < owners[occurrence]
    occurrence, span = occurrence[gone], span[gone]
    ords, los = np.concatenate(arrays["ords"]), np.concatenate(arrays["los"])
    edge = np.searchsorted(occurrence, np.cumsum([0, *(len(o) for o in arrays["ords"])]))
    for run, a, b in zip(batch["run"].to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if a < b:
            o, s = occurrence[a:b], span[a:b]
            out.append(("match", run, _packed(ords[o]), _packed(los[o] + start[s]), _packed(los[o] + stop[s]), batch["shard"][0].as_py(), None, None, None, None, None))
    return _table(_ADDED, out)


def _pieces(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of pieces of whole stretches, of about STEP bytes."""
    cut = np.r_[0, np.flatnonzero(np.diff(starts // STEP)) + 1, len(starts)]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _prints(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of each stretch's first and last string."""
    first, last = [], []
    for a, b in _pieces(starts, ends):
        lo, hi = np.searchsorted(starts, [a, b])
        h = Hashes(text[a:b])
        first.append(h.long_at(starts[lo:hi] - a))
        last.append(h.long_at(ends[lo:hi] - LENGTH - a))
    return np.concatenate(first), np.concatenate(last)


def merged(older: pa.Table, newer: pa.Table) -> pa.Table:
    """Two levels of a shard as one."""
    both = [_level(group, k) for group in (older, newer) for k in range(group.num_rows)]
    shard = (older if older.num_rows else newer)[0][0].as_py()
    return _table(LEVEL, [(shard, 0, *(both[0] if len(both) == 1 else both[0].merge(both[1])).row())])


class Family:
    """Suffix arrays of what was added so far: levels of 1, 2, 4, ... batches, each a row a shard.

    All are in one table with a folder a level, bucketed by shard, so they meet a batch and each other without a shuffle.
    """

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.added = scratch, [], 0
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))

    def _read(self, slots: list[str], schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        return self.table.where(F.col("slot").isin(slots)).select(*names)

    def _append(self, rows: DataFrame) -> None:
        self.table = self.scratch.bucketed(rows, "family", self.buckets, "shard", by="slot")

    def merge(self) -> None:
        """Levels of equal size become one, as often as the count of batches carries."""
        while len(self.levels) > 1 and self.levels[-1][1] == self.levels[-2][1]:
            (a, n), (b, _) = self.levels[-2:]
            slot = f"level_{self.added}_{2 * n}"
            older, newer = self._read([a], LEVEL), self._read([b], LEVEL)
            newer = newer.toDF(*(f"{x}_2" for x in newer.columns))  # two sides of one table need names of their own
            together = older.groupBy("shard").cogroup(newer.groupBy("shard_2")).applyInArrow(freed(merged), LEVEL)
            self._append(together.selectExpr(f"'{slot}' AS slot", *(x.split()[0] if x in LEVEL else f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in _ADDED.split(", ")[1:])))
            self.levels[-2:] = [(slot, 2 * n)]
            for gone in (a, b):
                self.scratch.drop(f"family/slot={gone}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Matches of a batch's stretches with the levels and among themselves. Batches come in ascending order of doc_id."""
        self.merge()
        made, k = batch.groupBy("shard"), self.added
        if self.levels:
            made = made.cogroup(self._read([x for x, _ in self.levels], LEVEL).groupBy("shard")).applyInArrow(freed(add), _ADDED)
        else:
            made = made.applyInArrow(freed(lambda t: add(t, _table(LEVEL, []))), _ADDED)
        self._append(made.withColumn("slot", F.concat("slot", F.lit(f"_{k}"))))
        self.levels.append((f"level_{k}", 1))
        self.added += 1
        return self._read([f"match_{k}"], MATCH)


MATCH = "run long, ords binary, los binary, his binary"
CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def removed_spans(size: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that spans cover."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return lo[new], hi[np.r_[new[1:], len(lo)] - 1]


def without_repeats(docs: DataFrame, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row; with digest, kept_sha256 in place of the bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = scratch.bucketed(in_runs(docs, batches), "texts", buckets, "run", by="batch")
    total = texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, 1 << (total // SHARD).bit_length())
    hits = scratch.write(screen(texts, shards), "hits")
    family, matches = Family(scratch), None
    for batch in sorted(r["batch"] for r in texts.select("batch").distinct().collect()):
        found = family.add(stretches(texts.where(F.col("batch") == batch), hits, shards))
        matches = found if matches is None else matches.union(found)
    if matches is None:
        matches = spark.createDataFrame([], MATCH)
    out = CLEANED.replace("kept binary", "kept_sha256 string") if digest else CLEANED

    def clean(group: pa.Table, found: pa.Table) -> pa.Table:
        ords, lo, hi = (np.concatenate([np.empty(0, kind), *(_unpacked(x, kind) for x in found[c])]) for c, kind in (("ords", np.int32), ("los", np.int64), ("his", np.int64)))
        order = np.argsort(ords, kind="stable")
        ords, lo, hi = ords[order], lo[order], hi[order]
        rows = []
        for doc_id, n, body in zip(group["doc_id"].to_pylist(), group["ord"].to_pylist(), group["body"], strict=True):
            a, b = np.searchsorted(ords, [n, n + 1])
            text, spans, gone = body.as_buffer(), 0, 0
            kept = [memoryview(text)]
            if a < b:
                starts, ends = removed_spans(len(text), lo[a:b], hi[a:b])
                spans, gone = len(starts), int((ends - starts).sum())
                kept = [memoryview(text)[x:y] for x, y in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True)]
            if digest:
                sha = hashlib.sha256()
                for k in kept:
                    sha.update(k)
            rows.append((doc_id, len(text), gone, spans, sha.hexdigest() if digest else b"".join(kept)))
        return _table(out, rows)

    return texts.select("run", "ord", "doc_id", "body").groupBy("run").cogroup(matches.groupBy("run")).applyInArrow(freed(clean), out)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP12_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {NO_ID}) AS id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
x AS (SELECT r, id, n, lower(hex(encode(text))) AS h FROM t WHERE n >= {LENGTH}),
y AS (SELECT r, id, j, substr(h, CAST(2 * j + 1 AS BIGINT), {2 * (512 + LENGTH - 1)}) AS piece FROM (SELECT *, unnest(range(0, n - {LENGTH} + 1, 512)) AS j FROM x)),
w AS (SELECT r, id, j + i AS i, md5_number(substr(piece, CAST(2 * i + 1 AS BIGINT), {2 * LENGTH})) AS s FROM (SELECT *, unnest(range(CAST(length(piece) // 2 - {LENGTH} + 1 AS BIGINT))) AS i FROM y)),
m AS (SELECT s, min(id) AS least FROM w GROUP BY s HAVING min(id) < max(id)),
d AS (SELECT w.r, w.i FROM w JOIN m USING (s) WHERE m.least < w.id),
g AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS new FROM d),
s AS (SELECT r, k, min(i) AS lo, max(i) + {LENGTH} AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY r, k),
p AS (SELECT r, k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY r ORDER BY lo) IS NULL AS final FROM s),
o AS (SELECT p.r, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed,
  string_agg(substr(x.h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)) || CASE WHEN final THEN substr(x.h, CAST(2 * hi + 1 AS BIGINT)) ELSE '' END, '' ORDER BY lo) AS kept
  FROM p JOIN x USING (r) GROUP BY p.r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(o.kept), encode(t.text))) AS kept_sha256
FROM t LEFT JOIN o USING (r)
"""
