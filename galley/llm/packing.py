"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised once, in Arrow batches. The histogram of piece lengths, at most 1024 numbers however large the
corpus is, is all that the packing has to see. For each bin, a bitset subset-sum dynamic
programme over the lengths that are left finds the fullest combination; it is then used as often as the supply allows,
so the plan has some thousand patterns at most. Pieces find their place by their rank among pieces of equal length.

Nulls: a null text is empty (its sequence is the end token alone); a null doc_id is packed like any other. Repeated
rows are packed as often as they occur. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.common import Scratch, freeing, give_back, slices, small, text_or_empty

LIMIT, END = 1024, 2
#: Bytes of the texts that are cut up at a time, and chunks whose ids are put together at a time.
SLICE, CHUNKS = 1 << 20, 1 << 17
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"

#: The pattern of byte-level vocabularies, and white space of all versions of Unicode.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"[\s\v\x1c-\x1f\x85\p{Z}]"
#: Chunks that are empty or have white space at an end: the single space beside them does not start a new word.
ODD = rf"^$|^{WHITE}|{WHITE}\z"
#: Chunks of the scripts below U+0250, on whose letters and digits all versions of Unicode agree.
AGREED = r"^[\x00-\x{24F}]*\z"

#: How byte-level vocabularies write bytes: printable ones as themselves, the others, in order, from U+0100 on.
BYTES = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
BYTES |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in BYTES)}


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths, dtype=np.int64)


class Ids:
    """Token ids of texts. A text is cut at single spaces between non-spaces, where the byte-level pattern always starts a
    new word, so the chunks' ids in order are the text's ids. Arrow cuts a slice of texts and finds its distinct chunks;
    only these are encoded, and the ids of all chunks are then gathered.

    The distinct chunks with letters of the old scripts are one text, joined by spaces, for an encoder built from the same
    vocabulary, which gives their ids as one array; the bytes that each id stands for tell where a chunk ends in it. All
    other chunks, and those with a special token, are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in BYTES.items()}
        ranks = {bytes(byte[c] for c in t): k for t, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.encoder = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.bytes[list(ranks.values())] = list(map(len, ranks))

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts in order, number of each text's ids) by the tokenizer's plain call."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter((x for ids in got for x in ids), dtype="<u4", count=int(lengths.sum())), lengths

    def spaced(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each chunk's ids) of chunks with a space before each."""
        if not len(chunks):
            return self.plain([])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), " ")[0].as_py()
        ids = self.encoder.encode_to_numpy(f" {joined}", disallowed_special=()).astype("<u4")
        at = np.searchsorted(_ends(self.bytes[ids]), _ends(pc.binary_length(chunks).to_numpy() + 1), side="right")
        return ids, np.diff(at, prepend=0)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, by the tokenizer's plain call: the string of a special token in a text is that token."""
        cut = pc.split_pattern(texts, " ")
        offsets, chunks = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        places, words = chunks.indices.to_numpy().astype(np.int64), chunks.dictionary
        odd = np.add.reduceat(pc.match_substring_regex(words, ODD).to_numpy(zero_copy_only=False)[places], offsets[:-1], dtype=np.int64) > 0
        agreed = pc.match_substring_regex(words, AGREED).to_numpy(zero_copy_only=False)
        for mark in self.special:
            agreed &= ~pc.match_substring(words, mark).to_numpy(zero_copy_only=False)
        # the ids of a chunk are a stretch of `ids`: of the agreed chunks, the others, then of the first chunk of each text
        first = words.take(pa.array(places[offsets[:-1]])).to_pylist()
        made = [self.spaced(words.filter(pa.array(agreed))), self.plain([f" {w}" for w in words.filter(pa.array(~agreed)).to_pylist()]), self.plain(first)]
        ids, lengths = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.empty(len(words), dtype=np.int64)
        order[np.concatenate([np.flatnonzero(agreed), np.flatnonzero(~agreed)])] = np.arange(len(words))
        places = order[places]
        places[offsets[:-1]] = len(words) + np.arange(len(texts))
        starts, ends = _ends(lengths) - lengths, _ends(lengths[places])
        out = np.empty(int(ends[-1]), dtype="<u4")
        for lo in range(0, len(places), CHUNKS):
            some, end = places[lo : lo + CHUNKS], ends[lo : lo + CHUNKS]
            n = lengths[some]
            out[end[0] - n[0] : end[-1]] = ids[np.arange(end[0] - n[0], end[-1]) - np.repeat(end - n - starts[some], n)]
        by_text = np.split(out, ends[offsets[1:-1] - 1])
        for k in np.flatnonzero(odd):
            by_text[k] = self.plain([texts[k].as_py()])[0]
        return by_text


def pieces_of(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens; only the first piece of a longer one may be short."""
    first = n % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)] if n > limit else [(0, n)]


def tokenised_pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """A row per piece, with its rank among the pieces of equal length that the same task has made (part)."""
    end = np.array([END], dtype="<u4")
    names, types = [c.split()[0] for c in PIECES.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # made anew for each task: kept, it would take its memory from the stages that follow in the same worker
        tokens, part, ranks = Ids(path), TaskContext.get().partitionId(), [0] * (limit + 1)
        give_back()  # what building them took
        for b in batches:
            for some in slices(b, 1, SLICE):
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), tokens.encode(some.column(1)), strict=True):
                    held = memoryview(np.concatenate([ids, end])).cast("B")
                    for k, (start, length) in enumerate(pieces_of(len(ids) + 1, limit)):
                        rows.append((doc, k, start, length, zlib.crc32(held[4 * start : 4 * (start + length)]), part, ranks[length]))
                        ranks[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(freeing(run), PIECES)


def fullest(counts: np.ndarray, limit: int) -> list[int]:
    """Lengths (each at most as often as counts has it) with the largest sum within the limit; a bitset holds the sums reachable."""
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1] if x <= limit]
    full, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for x in lengths:
        # a binary split of the copies: each step is one shift of the whole bitset
        left, k = min(int(counts[x]), limit // x), 1
        while left > 0:
            k = min(k, left)
            before = reach
            reach |= (reach << (x * k)) & full
            steps.append((x, k, before))
            left -= k
            k *= 2
        if reach >> limit & 1:
            break
    total, used = reach.bit_length() - 1, []
    for x, k, before in reversed(steps):
        if not before >> total & 1:
            used += [x] * k
            total -= x * k
    return used


def plan_bins(histogram: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins). Each bin starts with the longest piece left, and the rest of it is as full as can be."""
    counts, plan = histogram.astype(np.int64).copy(), []
    counts[0] = 0
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        bin_ = [longest, *fullest(counts, limit - longest)]
        counts[longest] += 1
        use = np.bincount(bin_, minlength=len(counts))
        held = use > 0
        times = int((counts[held] // use[held]).min())
        counts -= use * times
        plan.append((bin_, times))
    return plan


def places(plan: list[tuple[list[int], int]], limit: int = LIMIT) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: (first rank, first bin, offset) of each run of slots, ranks ascending."""
    out: dict[int, list] = {}
    used = np.zeros(limit + 1, dtype=np.int64)
    base = 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((int(used[x]), base, offset))
            used[x] += times
            offset += x
        base += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def best_fit_pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(tokenised_pieces(docs, path, limit), "pieces")
    per_task = scratch.write(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "per-task")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = scratch.write(per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    histogram = np.zeros(limit + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `limit` rows
        histogram[row["length"]] = row["n"]
    slots = spark.sparkContext.broadcast(places(plan_bins(histogram, limit), limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = slots.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("at").to_numpy()
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                first, bin_, off = by_length[int(x)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = bin_[k] + rank[rows] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    # a row per task and length: sent whole while that is small, else joined on both, so no key has more rows than a task
    side = F.broadcast(firsts) if small(firsts, 24) else firsts.hint("merge")
    ranked = pieces.join(side, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("at"))
    return ranked.mapInArrow(freeing(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
