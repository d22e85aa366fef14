"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into segments. Where two fingerprints differ in few bits, the pigeonhole principle leaves a
segment without errors and a neighbour with few; the neighbour is decoded to the (up to six) Golay codewords within 4
errors, of which two segments at 2 errors or fewer share one. So (exact segment, codeword index) is a key under which
any two fingerprints within the distance meet. Buckets are read as sorted runs; every link is verified on the bits.
No bucket is expanded into pairs: a bucket gives at most one link a member, and a run too long for a task's memory
turns into links to the 64 one-bit neighbours of each member, through which exactly the fingerprints within 2 bits meet.

Nulls: a null text is empty (fingerprint zero, linked like any other); a row with a null doc_id takes part, and names
no component. Repeated rows and equal fingerprints are one node. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import Scratch, ascii_lower, free_name, freeing, small, text_or_empty
from galley.llm.components import connected_components
from galley.llm.golay import near_indices

SEED, BLOCK = 42, 1 << 16
#: (lowest bit, bits) of the segments of a 64-bit fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a bucket that are compared each with each; beyond, by one-bit neighbours in the task, and then by links to them.
EACH, TASK = 64, 50_000
U = np.uint64
NEIGHBOURS = U(1) << np.arange(64, dtype=U)


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits, each set if set in over half the XXH64 hashes of the word shingles (A-Z lower-cased, repeats included)."""
    w = text.encode().lower().split()
    if not w:
        return 0
    total, n = np.zeros(64, dtype=np.int64), max(1, len(w) - words + 1)
    for lo in range(0, n, BLOCK):
        part = w[lo : lo + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(freeing(run), "doc_id long, fp long")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of fps) under which fingerprints at 2 bits or fewer meet."""
    parts = [((fps >> U(lo)) & U((1 << bits) - 1)).astype(np.int64) for lo, bits in SEGMENTS]
    keys, rows = [], []
    for k in range(3):
        near = near_indices(parts[(k + 1) % 3])
        row, which = np.nonzero(near >= 0)
        keys.append((k << 34) | (parts[k][row] << 12) | near[row, which])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is connected with by the links (i, j)."""
    low = np.arange(n)
    while len(i):
        m = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within each run of equal keys; at most one a row. Runs over EACH need distance 2."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[start, len(keys)])
    left, right = [], []
    small_rows = np.flatnonzero(np.repeat((length > 1) & (length <= EACH), length))
    if len(small_rows):
        k, f = keys[small_rows], fps[small_rows]
        for off in range(1, int(length[length <= EACH].max())):
            hit = np.flatnonzero((k[off:] == k[:-off]) & (np.bitwise_count(f[off:] ^ f[:-off]) <= distance))
            left.append(small_rows[hit])
            right.append(small_rows[hit + off])
    for s, n in zip(start[length > EACH], length[length > EACH], strict=True):
        # itself and its one-bit neighbours: two fingerprints within 2 bits have one of them in common
        hubs = np.concatenate([fps[s : s + n, None], fps[s : s + n, None] ^ NEIGHBOURS[None, :]], axis=1).ravel()
        owner = np.repeat(np.arange(s, s + n), 65)
        order = np.argsort(hubs, kind="stable")
        same = hubs[order[1:]] == hubs[order[:-1]]
        left.append(owner[order[:-1]][same])
        right.append(owner[order[1:]][same])
    if not left:
        return fps[:0], fps[:0]
    low = _spanning(len(fps), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero((low != np.arange(len(low))) & (fps[low] != fps))
    return fps[moved], fps[low[moved]]


def _runs(batches: Iterator[pa.RecordBatch], columns: int, limit: float | None = None) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Sorted batches as whole runs of equal first column; a run over the limit (TASK) comes in parts, marked True."""
    held, hot = None, None
    for b in batches:
        now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if hot is not None:
            n = int(np.searchsorted(now[0], hot, side="right"))
            if n:
                yield True, [c[:n] for c in now]
                now = [c[n:] for c in now]
            if not len(now[0]):
                continue
            hot = None
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1], side="left"))
        if cut:
            yield False, [c[:cut] for c in held]
            held = [c[cut:] for c in held]
        if len(held[0]) > (TASK if limit is None else limit):
            hot = held[0][-1]
            yield True, held
            held = None
    if held is not None and len(held[0]):
        yield False, held


def golay_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) whose components are those of all pairs at 2 bits or fewer."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            keys, rows = golay_keys(own.view(U))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], ["key", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hot, (keys, own) in _runs(batches, 2):
            own = own.view(U)
            if hot:
                for lo in range(0, len(own), 10_000):
                    a = np.repeat(own[lo : lo + 10_000], 64)
                    b = (own[lo : lo + 10_000, None] ^ NEIGHBOURS[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                continue
            a, b = bucket_links(keys, own)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keyed = fps.select("fp").mapInArrow(freeing(spread), "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(freeing(link), "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of 2 bits or fewer)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, words), "rows")
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = connected_components(golay_links(nodes), scratch)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = scratch.write(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates at a similarity of 0.8 over five-word shingles: the same code on longer, word-level fingerprints.

WIDE, TOLERANCE = 5, 28
SHINGLE, SIMILAR, BAND = 5, 0.8, 1.25
#: Members up to which a bucket is compared as it is; a fuller one is dealt over tiles of TILE members or so, which tasks compare: every two members meet in a tile.
FULL, TILE = 4096, 16_384
#: Pairs a member up to which a bucket gives all of them at once; beyond, two a member in a round, and after so many rounds all that verified groups don't join (see near_groups).
DENSE, ROUNDS = 4, 4
#: Words of 64 bits of an odd sketch, shingles that it is made for, and by how many deviations over the bar the shingles taken of a larger set may differ.
SKETCH, SKETCHED, SURE = 16, 512, 4
SKETCHES = ["level", *(f"k{k}" for k in range(SKETCH))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()], dtype=U)


def shingle_hashes(hashes: np.ndarray, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words make one shingle of all."""
    n = max(1, len(hashes) - words + 1) if len(hashes) else 0
    total = np.zeros(n, dtype=U)
    for k in range(min(words, len(hashes))):
        total = _mix(total + hashes[k : k + n] + U(k + 1))
    return np.unique(total >> U(32)).astype(np.uint32)


def smallest(shingles: np.ndarray, orders: int = 3) -> list[int]:
    """For each of so many orders of the hashes, the smallest: the same for two sets as often as they are similar."""
    wide = shingles.astype(U)
    return [int(_mix(wide + U((k + 1) << 40)).min() >> U(1)) if len(wide) else 0 for k in range(orders)]


def odd_sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """(level, bits): each bit is the parity of the shingles that fall on it, so two sketches differ in about as many bits as the sets in shingles (Mitzenmacher, Pagh and Pham, 2014). At level k, one in 2**k of the shingles of a large set is taken."""
    level = max(0, int(np.ceil(np.log2(max(1, len(shingles)) / SKETCHED))))
    h = _mix(shingles.astype(U) + U(0x5851F42D4C957F2D))
    h = h[(h & U((1 << level) - 1)) == 0] >> U(32)
    parity = np.bincount((h % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return level, np.packbits(parity.astype(np.uint8)).view(np.int64)


def may_be_similar(size_i: np.ndarray, size_j: np.ndarray, level_i: np.ndarray, level_j: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether so many different bits of two odd sketches allow the similarity; true where the sketches are of different levels.

    A shingle that only one set has flips one bit at most, so bits are never more than such shingles: where all are taken
    (level 0), no similar pair is ruled out. Where one in 2**level is, their number varies.
    """
    most, taken = (1 - SIMILAR) / (1 + SIMILAR) * (size_i + size_j), 0.5**level_i
    return (level_i != level_j) | (bits <= most * taken + SURE * np.sqrt(most * taken * (1 - taken)) + 1e-6)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE words of 23 bits, voted by the distinct words of the text."""
    one = np.unique(hashes)
    total = np.zeros(128, dtype=np.int64)
    for lo in range(0, len(one), BLOCK):
        h = np.stack([_mix(one[lo : lo + BLOCK]), _mix(one[lo : lo + BLOCK] ^ U(0x9E3779B97F4A7C15))], axis=1)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
    bits = (total * 2 > len(one))[: 23 * WIDE].reshape(WIDE, 23)
    return bits @ (1 << np.arange(23, dtype=np.int64))


def _row_hash():
    """With the doc_id, 128 bits that tell rows apart."""
    return F.xxhash64(ascii_lower(text_or_empty()))


def _tidy(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash().alias("hash"), text_or_empty())


def wide_prints(docs: DataFrame) -> DataFrame:
    """doc_id, hash, p, q, r, size, level, k0, ...: the fingerprint in words of two segments, the number of shingles and their odd sketch. One row a doc_id and text."""
    columns = ["p", "q", "r", "size", *SKETCHES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sizes = np.zeros((b.num_rows, WIDE), dtype=np.int64), np.ones(b.num_rows, dtype=np.int64)
            sketches = np.zeros((b.num_rows, 1 + SKETCH), dtype=np.int64)
            for k, t in enumerate(b.column(2)):
                hashes = word_hashes(t.as_py())
                shingles = shingle_hashes(hashes)
                prints[k], sizes[k] = wide_fingerprint(hashes), max(1, len(shingles))
                sketches[k, 0], sketches[k, 1:] = odd_sketch(shingles)
            wide = [prints[:, 0] | prints[:, 1] << 23, prints[:, 2] | prints[:, 3] << 23, prints[:, 4], sizes, *sketches.T]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(w)) for w in wide)], ["doc_id", "hash", *columns])

    return _tidy(docs).mapInArrow(freeing(run), ", ".join(f"{c} long" for c in ["doc_id", "hash", *columns])).dropDuplicates(["doc_id", "hash"])


def wide_keys(p: np.ndarray, q: np.ndarray, r: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row) of fingerprints: segment, band of sizes, codeword. Sizes within a factor of 0.8 are in the same band or the next."""
    band = np.floor(np.log(size) / np.log(BAND)).astype(np.int64)
    low, keys, rows = (1 << 23) - 1, [], []
    for s, part in enumerate((p & low, p >> 23, q & low, q >> 23, r)):
        near = near_indices(part)
        row, which = np.nonzero(near >= 0)
        for up in (0, 1):
            keys.append((s << 24) | ((band[row] + up) << 12) | near[row, which])
            rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def split_keys(keys: np.ndarray, rows: np.ndarray, full: np.ndarray, by: list[np.ndarray], groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) with the rows under a full key under those of its tiles instead, which are negative.

    Rows are dealt into the key's groups (three, if not given; two at least) by their numbers (by), and there is a tile for every two groups: each
    two rows of a key meet in one, so no pair is lost.
    """
    if not len(full):
        return keys, rows
    at = np.minimum(np.searchsorted(full, keys), len(full) - 1)
    crowded = full[at] == keys
    n = np.full(len(full), 3) if groups is None else groups
    mixed = np.zeros(len(by[0]), dtype=U)
    for x in by:
        mixed = _mix(mixed + x.astype(U))
    parts = [(keys[~crowded], rows[~crowded])]
    for g in np.unique(n[at[crowded]]).tolist():
        here = crowded & (n[at] == g)
        k, row = keys[here].astype(U), rows[here]
        mine = (mixed[row] % U(g)).astype(np.int64)
        for other in range(g):  # a tile for every two groups
            to = mine != other
            pair = np.minimum(mine, other)[to] * g + np.maximum(mine, other)[to]
            parts.append(((_mix(_mix(k[to]) ^ pair.astype(U)) >> U(1)).astype(np.int64) | -(1 << 63), row[to]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def crowded_keys(prints: DataFrame) -> dict[int, int]:
    """The keys with over FULL rows and the groups into which these are dealt: at most 5 segments x 4096 codewords x some 100 bands of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = np.unique(wide_keys(*(b.column(k).to_numpy() for k in range(4)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    counts = prints.select("p", "q", "r", "size").mapInArrow(freeing(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: max(2, -(-2 * r["n"] // TILE)) for r in counts.where(F.col("n") > FULL).toLocalIterator()}


def near_buckets(prints: DataFrame, tiles: dict[int, int], kept: list[str], only: DataFrame | None = None) -> DataFrame:
    """key (one of only, if given) and the columns kept (p, q, r, size and rid among them), sorted by key: under a key are rows that are to be compared, each with each."""
    known = np.array(sorted(r["key"] for r in only.toLocalIterator()), dtype=np.int64) if only is not None and small(only, 16) else None
    sent = prints.sparkSession.sparkContext.broadcast((tiles, known))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt, wanted = sent.value
        full = np.array(sorted(dealt), dtype=np.int64)
        groups = np.array([dealt[k] for k in full.tolist()], dtype=np.int64)
        for b in batches:
            every = {c: b.column(k).to_numpy() for k, c in enumerate(kept)}
            keys, rows = split_keys(*wide_keys(every["p"], every["q"], every["r"], every["size"]), full, [every["rid"]], groups)
            if wanted is not None:
                at = np.flatnonzero(np.isin(keys, wanted))
                keys, rows = keys[at], rows[at]
            for lo in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 18)]), *(pa.array(every[c][rows[lo : lo + (1 << 18)]]) for c in kept)], ["key", *kept])

    keyed = prints.select(*kept).mapInArrow(freeing(spread), ", ".join(f"{c} long" for c in ["key", *kept]))
    if only is not None and known is None:
        keyed = keyed.join(only, "key", "left_semi")
    return keyed.repartition("key").sortWithinPartitions("key")


def _close(i: slice, j: slice, p: np.ndarray, q: np.ndarray, r: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits in which the rows i and j differ; over TOLERANCE where sizes alone rule the similarity out."""
    apart = np.bitwise_count(p[i, None] ^ p[None, j]) + np.bitwise_count(q[i, None] ^ q[None, j]) + np.bitwise_count(r[i, None] ^ r[None, j])
    fits = np.minimum(size[i, None], size[None, j]) >= SIMILAR * np.maximum(size[i, None], size[None, j])
    return np.where(fits, apart, 255)


def near_candidates(buckets: DataFrame) -> DataFrame:
    """(a, b, key): pairs of row keys within TOLERANCE, all those of a bucket (key null). Of a bucket with over DENSE pairs a
    member, only a row (key) to say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, p, q, r, size, rid) in _runs(batches, 6, float("inf")):
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[start, len(key)])
            left, right, marks = [], [], []
            few, within = np.flatnonzero(np.repeat((length > 1) & (length <= EACH), length)), []
            for off in range(1, int(length[length <= EACH].max(initial=1))):
                i, j = few[:-off], few[off:]
                same = key[i] == key[j]
                i, j = i[same], j[same]
                apart = np.bitwise_count(p[i] ^ p[j]) + np.bitwise_count(q[i] ^ q[j]) + np.bitwise_count(r[i] ^ r[j])
                hit = (apart <= TOLERANCE) & (np.minimum(size[i], size[j]) >= SIMILAR * np.maximum(size[i], size[j]))
                within.append(np.stack([i[hit], j[hit]]))
            if within:
                i, j = np.concatenate(within, axis=1)
                bucket = np.searchsorted(start, i, side="right") - 1
                over = np.bincount(bucket, minlength=len(start)) > DENSE * length
                marks += key[start[over]].tolist()
                left.append(i[~over[bucket]])
                right.append(j[~over[bucket]])
            for s, n in zip(start[length > EACH].tolist(), length[length > EACH].tolist(), strict=True):
                pairs, found = [], 0
                for lo in range(s, s + n, 256):
                    pairs.append(np.argwhere(np.triu(_close(slice(lo, min(lo + 256, s + n)), slice(lo, s + n), p, q, r, size) <= TOLERANCE, 1)) + lo)
                    found += len(pairs[-1])
                    if found > DENSE * n:
                        marks.append(key[s])
                        break
                else:
                    i, j = np.concatenate(pairs).T
                    left.append(i)
                    right.append(j)
            i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
            yield from _pairs_and_marks(rid[i], rid[j], marks)

    return buckets.select("key", "p", "q", "r", "size", "rid").mapInArrow(freeing(run), "a long, b long, key long").distinct()


def _pairs_and_marks(one: np.ndarray, other: np.ndarray, marks: list[int]) -> Iterator[pa.RecordBatch]:
    a, b = (f(one[one != other], other[one != other]) for f in (np.maximum, np.minimum))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])
    yield pa.RecordBatch.from_arrays([pa.nulls(len(marks), pa.int64()), pa.nulls(len(marks), pa.int64()), pa.array(marks, pa.int64())], ["a", "b", "key"])


def _first(i: np.ndarray, j: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of each i, the one with the smallest `by`."""
    order = np.lexsort((by, i))
    i, j = i[order], j[order]
    first = np.diff(i, prepend=-1) > 0
    return i[first], j[first]


def dense_candidates(buckets: DataFrame, every: bool = False) -> DataFrame:
    """(a, b, key): the pairs within TOLERANCE of the buckets whose rows have different roots (column root), but for those
    that their sketches rule out. Of a bucket with over DENSE such pairs a member, unless every one is wanted, only each
    member's nearest by sketch and the one with most such pairs, and a row (key) to say that others are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, p, q, r, size, rid, root, level, *sketch) in _runs(batches, 8 + SKETCH, float("inf")):

            def pairs(rows: slice, others: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                i, j = np.argwhere((_close(rows, others, p, q, r, size) <= TOLERANCE) & (root[rows, None] != root[None, others])).T  # noqa: B023
                i, j = i + rows.start, j + others.start
                bits = np.zeros(len(i), dtype=np.int64)
                for k in sketch:  # noqa: B023
                    bits += np.bitwise_count((k[i] ^ k[j]).view(U))
                keep = may_be_similar(size[i], size[j], level[i], level[j], bits)  # noqa: B023
                return i[keep], j[keep], bits[keep]

            ends = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                blocks, whole, n = [slice(lo, min(lo + 256, e)) for lo in range(s, e, 256)], slice(s, e), e - s
                if every:
                    for rows in blocks:
                        i, j, _ = pairs(rows, slice(rows.start, e))
                        yield from _pairs_and_marks(rid[i[i < j]], rid[j[i < j]], [])
                    continue
                degree, chosen, held, found = np.zeros(n, dtype=np.int64), [], [], 0
                for rows in blocks:
                    i, j, bits = pairs(rows, whole)
                    degree += np.bincount(i - s, minlength=n)
                    found += len(i)
                    chosen.append(_first(i, j, bits))
                    if found <= 2 * DENSE * n:
                        held.append((i[i < j], j[i < j]))
                if found <= 2 * DENSE * n:
                    i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield from _pairs_and_marks(rid[i], rid[j], [])
                    continue
                for rows in blocks:
                    i, j, _ = pairs(rows, whole)
                    chosen.append(_first(i, j, -degree[j - s]))
                i, j = (np.concatenate(x) for x in zip(*chosen, strict=True))
                yield from _pairs_and_marks(rid[i], rid[j], [key[s]])

    return buckets.select("key", "p", "q", "r", "size", "rid", "root", *SKETCHES).mapInArrow(freeing(run), "a long, b long, key long").distinct()


def similar_pairs(docs: DataFrame, prints: DataFrame, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) at a Jaccard similarity of 0.8 or more over five-word shingles."""
    rids = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
    wanted = scratch.write(prints.select("rid", F.col("doc_id").alias("id"), F.col("hash").alias("h")).join(rids, "rid"), f"wanted-{name}")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(word_hashes(t.as_py())).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["rid", "s"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("s").to_pylist(), b.column("t").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= SIMILAR * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = F.broadcast(wanted) if small(wanted, 32) else wanted
    texts = _tidy(docs).join(side, (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("rid", "text").dropDuplicates(["rid"])
    sets = scratch.write(texts.mapInArrow(freeing(shingles), "rid long, s binary"), f"sets-{name}")
    left = pairs.join(sets.withColumnRenamed("rid", "a"), "a")
    both = left.join(sets.select(F.col("rid").alias("b"), F.col("s").alias("t")), "b").select("a", "b", "s", "t")
    return scratch.write(both.mapInArrow(freeing(similar), "a long, b long"), f"similar-{name}")


def near_groups(docs: DataFrame, prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, root) of the rows of prints that have a similar row: five-word shingles, Jaccard similarity of 0.8 or more.

    Every pair of a bucket within TOLERANCE is verified, unless sketches rule it out or its rows are in one group already:
    first all pairs of most buckets and, of those full of neighbours, a linear number of pairs that are alike by sketch;
    then of the latter, by rounds, a linear number of those that the groups so found don't join. When a round has found
    no link, or after ROUNDS of them, all that are left are verified.
    """
    tiles = crowded_keys(prints)
    columns = ["p", "q", "r", "size", "rid"]
    found = scratch.write(near_candidates(near_buckets(prints, tiles, columns)), "pairs")
    pairs, dense = found.where("key is null").select("a", "b"), found.where("key is not null").select("key")
    columns += ["root", *SKETCHES]
    if not dense.isEmpty():
        found = scratch.write(dense_candidates(near_buckets(prints.withColumn("root", F.col("rid")), tiles, columns, dense)), "dense")
        pairs = scratch.write(pairs.union(found.where("key is null").select("a", "b")).distinct(), "candidates")
        dense = found.where("key is not null").select("key")
    links = similar_pairs(docs, prints, pairs, scratch, "first")
    named = lambda k: scratch.write(connected_components(links, scratch).select(F.col("node").alias("rid"), "root"), f"roots-{k}")
    roots, k, every = named(0), 0, False
    while not dense.isEmpty():
        k += 1
        rooted = prints.join(F.broadcast(roots) if small(roots, 24) else roots, "rid", "left").select(*prints.columns, F.coalesce("root", "rid").alias("root"))
        found = scratch.write(dense_candidates(near_buckets(rooted, tiles, columns, dense), every), f"left-{k}")
        dense = found.where("key is not null").select("key")
        more = similar_pairs(docs, prints, found.where("key is null").select("a", "b"), scratch, f"left-{k}")
        every = k >= ROUNDS or more.isEmpty()
        if not more.isEmpty():
            links = links.union(more)
            roots = named(k)
    return roots


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near-duplicates, the row with the smallest doc_id; the columns are those of docs, whatever they are called.

    A row is its doc_id and its text with A-Z lower-cased: rows that repeat both are one and stay or go together. A null text
    is empty, and all empty texts are near-duplicates of one another. A null doc_id comes after all others; ties go by hash.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    prints = scratch.write(wide_prints(docs).withColumn("rid", F.monotonically_increasing_id()), "prints")
    groups = scratch.write(near_groups(docs, prints, scratch), "groups")
    named = prints.select("rid", "doc_id", "hash").join(F.broadcast(groups) if small(groups, 24) else groups, "rid")
    first = named.groupBy("root").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("keep"))
    own, one, other = (free_name(docs, n) for n in ("row_hash", "gone_id", "gone_hash"))
    gone = scratch.write(named.join(first, "root").where("rid <> keep").select(F.col("doc_id").alias(one), F.col("hash").alias(other)), "gone")
    side = F.broadcast(gone) if small(gone, 32) else gone
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.col(own) == F.col(other))
    return docs.withColumn(own, _row_hash()).join(side, match, "left_anti").drop(own)
