"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) and benchmark items are TF-IDF vectors; a randomised SVD of the passages of all documents
gives the latent space over the words of the benchmark, and passages whose cosine with an item passes a low bar are
candidates. So are passages that hold a share of the weight of an item (of a long item, of one of its windows),
whatever else they hold: a verbatim or short item is found at any size of the table. Each candidate is then checked on
the words: the longest common subsequence with the item, and whether the item's answer (its last sentence) is there too,
which catches paraphrases.

Two bounds rule most windows out without losing any. The latent cosine is linear in the window's words, so it is at most
the sum of each word's largest weight for any item. And a window holds the wanted share of a passage only if it has one
of the passage's rarer words, as the commoner ones together weigh less than that.

Document frequencies are counted over all documents: of each word of the benchmark, and of the other words by hash
bucket, so no word's weight is made up or grows without bound. The benchmark is a stated query set: blocks of its items
are sent together, up to SENT bytes a pass, and every passage of every document is searched. The space needs of the documents
only how often two words of the benchmark share a passage: whole numbers, which are summed over all passages of all
documents in one pass for all blocks, so no order or number of tasks changes them.

Nulls: a null text is empty; empty items and documents match nothing. A null doc_id is reported as such. Repeated rows
are each reported. Equal items each get a link. Empty tables give no rows. Columns other than the id and text are
ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import Scratch, free_name, freeing, slices, small, text_or_empty
from galley.llm.terms import SLICE, Weights, distinct, prefix, term_counts, terms_of, words_in, words_of

WINDOW, STEP = 32, 16
#: Items and words of a block; bytes of blocks that are sent for one pass over the documents.
ITEMS, WORDS, SENT = 512, 1 << 15, 256 << 20
#: The space is fitted on all documents, which together weigh as much as so many of them; its dimensions, and the weight of the items there, for each item.
AS_DOCS, DIMENSIONS, ITEM_WEIGHT = 500, 256, 4.0
#: Pairs of words that a task holds one by one before it counts them; different pairs that it sums before it hands them on, and those of a batch.
PAIRS, SUMMED, BATCH = 1 << 21, 1 << 20, 1 << 16
#: Cosine of candidates; shares of the item's words (of its answer's) in common order that make a leak.
COSINE, WHOLE, PART, ANSWER = 0.35, 0.8, 0.6, 0.8
#: Share of a passage's weight (of its words, by frequency) that a window needs to be a candidate whatever else it holds.
#: A leak of PART of the words, of which a window and a passage STEP apart share three quarters or more, has 0.45.
COVER = 0.3
#: Windows that are looked at together.
CHUNK = 256
LINKS = "doc_id long, item_id long, cosine double, lcs double, answer double"


def answer_of(words: list[str]) -> list[str]:
    """The last sentence; of a single sentence, its last quarter."""
    ends = [k for k, w in enumerate(words[:-1]) if re.search(r"[.!?]$", w)]
    return words[ends[-1] + 1 :] if ends else words[-max(1, len(words) // 4) :]


def places_of(words: list[str]) -> dict[str, int]:
    """By word, the bits of its places."""
    places: dict[str, int] = {}
    for k, w in enumerate(words):
        places[w] = places.get(w, 0) | 1 << k
    return places


def common_subsequence(places: dict[str, int], n: int, text: list[str]) -> int:
    """Length of the longest common subsequence of n words and a text, bit-parallel over the words (Hyyrö, 2004)."""
    full = (1 << n) - 1
    row = full
    for m in filter(None, map(places.get, text)):
        u = row & m
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows of texts of so many words, at every STEP; the last one may be shorter than the others."""
    count = np.where(lengths > 0, np.maximum(-(-lengths // STEP) - 1, 1), 0)
    text = np.repeat(np.arange(len(lengths)), count)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STEP


class Block:
    """Items to search for. Its words are rows of the vocabulary; inside the block they are numbered anew."""

    def __init__(self, items: list[tuple[int, list[str]]], weights: Weights):
        self.ids, self.items = [i for i, _ in items], [ws for _, ws in items]
        self.answers = [answer_of(ws) for ws in self.items]
        self.places = [(places_of(ws), places_of(a)) for ws, a in zip(self.items, self.answers, strict=True)]
        known = sorted({w for ws in self.items for w in ws})
        self.words = np.searchsorted(np.array(weights.vocabulary, dtype=object), known)
        self.number = {w: k for k, w in enumerate(known)}
        self.idf = weights.idf[self.words]
        self._postings()

    def _postings(self) -> None:
        """By word, the passages (windows of items) that have it and the share of their weight that it is."""
        made = []
        self.owner = []
        self.signs = np.zeros(len(self.words), dtype=bool)
        for k, ws in enumerate(self.items):
            for lo in windows(np.array([len(ws)]))[1]:
                rows, n = np.unique(self.rows(ws[lo : lo + WINDOW]), return_counts=True)
                share = n * self.idf[rows] / (n * self.idf[rows]).sum()
                made.append(np.stack([rows, np.full(len(rows), len(self.owner)), share]))
                self.owner.append(k)
                # the commonest words that weigh less than COVER together can't make a candidate on their own
                by = np.argsort(self.idf[rows], kind="stable")
                self.signs[rows[by[np.cumsum(share[by]) >= COVER - 1e-6]]] = True
        every = np.concatenate(made, axis=1)
        every = every[:, np.argsort(every[0], kind="stable")]
        self.first = np.searchsorted(every[0], np.arange(len(self.words) + 1))
        self.passage, self.share = every[1].astype(np.int64), every[2]
        self.most_share = np.maximum.reduceat(self.share, self.first[:-1])
        self.owner = np.array(self.owner)

    def rows(self, words: list[str]) -> np.ndarray:
        """Numbers of the words of the block, -1 for others."""
        return np.fromiter((self.number.get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def passages(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(TF-IDF weights, one row a window of the text, over the columns; the columns)."""
        columns, inside = np.unique(rows[rows >= 0], return_inverse=True)
        one = np.zeros((len(rows), len(columns)), dtype=np.float32)
        one[np.flatnonzero(rows >= 0), inside] = self.idf[columns][inside]
        total, (_, start) = prefix(one), windows(np.array([len(rows)]))
        return (total[np.minimum(start + WINDOW, len(rows))] - total[start]).astype(np.float32), columns

    def set_basis(self, basis: np.ndarray) -> None:
        """basis: (words, dimensions), orthonormal. Items are queries over their full length; a word's weight for an item is its part of their cosine, but for the passage's length."""
        full = np.zeros((len(self.items), len(self.words)))
        for k, ws in enumerate(self.items):
            np.add.at(full[k], self.rows(ws), self.idf[self.rows(ws)])
        queries = full @ basis / np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-9)
        self.weights = (self.idf[:, None] * (basis @ queries.T)).astype(np.float32)
        self.most = self.weights.max(axis=1).astype(np.float64)

    def nbytes(self) -> int:
        return 8 * len(self.words) * min(len(self.items), DIMENSIONS) + 4 * len(self.words) * len(self.items)

    def alike(self, rows: np.ndarray, first: np.ndarray, last: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) where the sum of the window's words is over COSINE times the window's length. Consecutive windows of a text share a step, which is summed once."""
        own = np.append(rows, -1)  # past the end, and for other words, the row of zeros
        weights = np.concatenate([self.weights, np.zeros((1, len(self.items)), dtype=np.float32)])
        window, item = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(first), CHUNK):
            begin, end = first[lo : lo + CHUNK], last[lo : lo + CHUNK]
            steps = np.unique(np.concatenate([begin, begin + STEP]))
            # a step that begins where no window does is the end of its text
            stop = end[np.minimum(np.searchsorted(begin, steps - STEP), len(begin) - 1)]
            stop = np.where(np.isin(steps, begin), end[np.minimum(np.searchsorted(begin, steps), len(begin) - 1)], stop)
            at = steps[:, None] + np.arange(STEP)
            sums = weights[own[np.where(at < stop[:, None], at, -1)]].sum(axis=1)
            total = sums[np.searchsorted(steps, begin)] + np.where((begin + STEP < end)[:, None], sums[np.searchsorted(steps, begin + STEP)], 0)
            w, k = np.nonzero(total >= (COSINE * lengths[lo : lo + CHUNK, None]).astype(np.float32))
            window.append(w + lo)
            item.append(k)
        return np.concatenate(window), np.concatenate(item)

    def covered(self, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) where the window's distinct words have COVER of the weight of a passage of the item. A word counts as often as it is in the passage, which can only add candidates."""
        window, item = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        size = max(16, min(CHUNK, (1 << 20) // len(self.owner)))
        for lo in range(0, len(first), size):
            at = first[lo : lo + size, None] + np.arange(WINDOW)
            row = np.where(at < last[lo : lo + size, None], rows[np.minimum(at, len(rows) - 1)], -1)
            which, word = np.divmod(distinct((np.arange(len(at))[:, None] * len(self.words) + row)[row >= 0]), len(self.words))
            n = self.first[word + 1] - self.first[word]
            post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[word], n)
            held = np.bincount(np.repeat(which, n) * len(self.owner) + self.passage[post], self.share[post], minlength=len(at) * len(self.owner))
            w, k = np.divmod(np.flatnonzero(held >= COVER), len(self.owner))
            window.append(w + lo)
            item.append(self.owner[k])
        return np.concatenate(window), np.concatenate(item)

    def candidates(self, terms: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, start, cosine). terms: those of the words of all texts; offsets: where each text begins; idf: by term."""
        number = np.full(len(idf), -1)
        number[self.words] = np.arange(len(self.words))
        rows = number[terms]
        text, start = windows(np.diff(offsets))
        first = offsets[text] + start
        last = np.minimum(first + WINDOW, offsets[text + 1])

        def span(values: np.ndarray) -> np.ndarray:
            total = prefix(values)
            return total[last] - total[first]

        of = lambda values: np.append(values, 0)[rows]
        # a window's words squared one by one: repeated words make it longer than this
        least = np.sqrt(span((idf**2)[terms]))
        near = np.flatnonzero(span(of(self.most)) >= COSINE * least - 1e-6)
        holds = np.flatnonzero((span(of(self.signs)) > 0) & (span(of(self.most_share)) >= COVER - 1e-6))
        alike, covered = self.alike(rows, first[near], last[near], least[near]), self.covered(rows, first[holds], last[holds])
        pairs = np.unique(np.concatenate([near[alike[0]] * len(self.items) + alike[1], holds[covered[0]] * len(self.items) + covered[1]]))
        window, item = np.divmod(pairs, len(self.items))
        cosine = np.zeros(len(pairs))
        for lo in range(0, len(pairs), CHUNK):
            w, k = window[lo : lo + CHUNK], item[lo : lo + CHUNK]
            at = first[w, None] + np.arange(WINDOW)
            inside = at < last[w, None]
            at = np.minimum(at, len(terms) - 1)
            words, times = np.unique((np.arange(len(w))[:, None] * len(idf) + terms[at])[inside], return_counts=True)
            which, term = np.divmod(words, len(idf))
            length = np.sqrt(np.bincount(which, (times * idf[term]) ** 2, minlength=len(w)))
            row = number[term]
            total = np.bincount(which, np.where(row >= 0, times * self.weights[row, k[which]], 0), minlength=len(w))
            cosine[lo : lo + CHUNK] = total / length
        keep = cosine >= COSINE
        keep |= np.isin(pairs, holds[covered[0]] * len(self.items) + covered[1])
        return text[window[keep]], item[keep], start[window[keep]], cosine[keep]

    def checked(self, words: list[str], item: int, hits: list[tuple[int, float]]) -> tuple[float, float, float] | None:
        """(cosine, share of the item in common order, share of its answer) of the best region that is a leak. hits: (start, cosine) in order."""
        n, said_by = len(self.items[item]), len(self.answers[item])
        places, answer = self.places[item]
        regions, reach = [], None
        for start, score in hits:
            lo, hi = max(0, start - n), start + WINDOW + n
            if reach is not None and lo <= reach:
                regions[-1] = (regions[-1][0], hi, max(regions[-1][2], score))
            else:
                regions.append((lo, hi, score))
            reach = hi
        best = None
        for lo, hi, score in regions:
            for part in range(lo, min(hi, len(words)), 2 * n + WINDOW):
                # a stretch of a long region at a time, overlapping by the item's length, so chance does not add up
                some = words[part : min(hi, part + 3 * n + WINDOW)]
                share = common_subsequence(places, n, some) / n
                if share >= PART and (best is None or share > best[1]):
                    said = common_subsequence(answer, said_by, some) / said_by
                    if share >= WHOLE or said >= ANSWER:
                        best = (score, share, said)
        return best


def links_in(texts: pa.Array, weights: Weights, blocks: list[Block]) -> Iterator[tuple[int, int, float, float, float]]:
    """(number of the text, item, cosine, share of the item, share of its answer) of the leaks in texts."""
    cut = words_in(texts)
    terms, offsets = terms_of(cut.flatten(), pa.array(weights.vocabulary, pa.string())), cut.offsets.to_numpy().astype(np.int64)
    for block in blocks:
        found: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for t, item, start, score in zip(*(x.tolist() for x in block.candidates(terms, offsets, weights.idf)), strict=True):
            found.setdefault(t, {}).setdefault(item, []).append((start, score))
        for t, by_item in found.items():
            words = cut[t].as_py()
            for item, hits in by_item.items():
                best = block.checked(words, item, sorted(hits))
                if best:
                    yield t, block.ids[item], *best


def pairs_in(rows: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Pairs of words of a passage, times two, one more if the pair is in two passages. A pair is the smaller word times n, and the larger; it is given for each two places, and for a place with itself.

    rows: numbers of the words of all texts, below n, or -1 for others; offsets: where each text begins. A passage is a
    step and the next one, so a step is in two, but for a text's first and last.
    """
    kind = np.int32 if 2 * n * n < 1 << 31 else np.int64
    at = np.flatnonzero(rows >= 0)
    text = np.searchsorted(offsets, at, side="right") - 1
    steps = -(-np.diff(offsets) // STEP)
    step = (at - offsets[text]) // STEP
    twice = ((step > 0) & (step < steps[text] - 1)).astype(kind)
    step = (step + (np.cumsum(steps + 1) - steps)[text]).astype(np.int32)  # a step lies between two texts
    rows = rows[at].astype(kind)
    most = PAIRS // (2 * WINDOW)
    for lo in range(0, len(rows), most):
        near = np.arange(lo, min(lo + most, len(rows)))
        made = [2 * rows[near] * (n + 1) + twice[near]]
        for apart in range(1, WINDOW):
            near = near[: np.searchsorted(near, len(rows) - apart)]
            gap = step[near + apart] - step[near]
            near, gap = near[gap <= 1], gap[gap <= 1]  # what is too far from one word is so from those after it
            if not len(near):
                break
            u, v = rows[near], rows[near + apart]
            pair = 2 * (np.minimum(u, v) * n + np.maximum(u, v)) + twice[near] * (gap == 0)
            made += [pair, pair[u == v]]  # a word with itself is met from both sides
        yield np.concatenate(made)


def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(pair, times), each pair once."""
    both = pa.table([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["pair", "n"])
    out = both.group_by("pair", use_threads=False).aggregate([("n", "sum")])
    return out["pair"].to_numpy(), out["n_sum"].to_numpy()


def passage_pairs(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """word, other, n: the sum over all passages of all texts of the product of the two words' counts, in both orders, sorted by word in each partition. Words are places in the vocabulary."""
    sent, n = texts.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        waiting, held = [], []

        def count() -> None:
            if waiting:
                pairs, times = np.unique(np.concatenate(waiting), return_counts=True)
                held.append(((pairs >> 1).astype(np.int64), times * (1 + (pairs & 1))))
                waiting.clear()

        def hand_on() -> Iterator[pa.RecordBatch]:
            pairs, times = held.pop()
            for lo in range(0, len(pairs), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[lo : lo + BATCH]), pa.array(times[lo : lo + BATCH])], ["pair", "n"])

        for b in batches:
            for some in slices(b, 0, SLICE):
                words = words_in(some.column(0))
                rows = pc.fill_null(pc.index_in(words.flatten(), known), -1).to_numpy()
                offsets = words.offsets.to_numpy().astype(np.int64)
                for pairs in pairs_in(rows, offsets - offsets[0], n):
                    waiting.append(pairs)
                    if sum(map(len, waiting)) < PAIRS:
                        continue
                    count()
                    if sum(len(p) for p, _ in held) >= 2 * SUMMED:
                        held[:] = [added(held)]
                        if len(held[0][0]) >= SUMMED:
                            yield from hand_on()
        count()
        if held:
            held[:] = [added(held)]
            yield from hand_on()

    pairs = texts.select("text").mapInArrow(freeing(run), "pair long, n long").repartition("pair").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.select(F.expr(f"pair div {n}").alias("one"), F.expr(f"pair % {n}").alias("two"), "n")
    one, two = (F.struct(F.col(a).alias("word"), F.col(b).alias("other"), "n") for a, b in (("one", "two"), ("two", "one")))
    return pairs.select(F.inline(F.when(F.col("one") == F.col("two"), F.array(one)).otherwise(F.array(one, two)))).repartition("word").sortWithinPartitions("word", "other")


def latent_basis(pairs: DataFrame | None, block: Block, share: float, seed: int = 5) -> np.ndarray:
    """The range of a randomised SVD (Halko et al., 2011) of the passages of the documents and of the items: A'A times a block of vectors. pairs: those of all documents, which are needed if the block has more words than the space dimensions; share: their weight."""
    n = len(block.words)
    k = min(n, DIMENSIONS)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, k)))[0]
    if pairs is None or n == k:
        return q  # all of the space
    sent = pairs.sparkSession.sparkContext.broadcast((block.words, block.idf[:, None] * q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = sent.value
        for b in batches:
            word, other, times = (c.to_numpy() for c in b.columns)
            i, j = (np.minimum(np.searchsorted(words, x), n - 1) for x in (word, other))
            mine = np.flatnonzero((words[i] == word) & (words[j] == other))
            i, j, times = i[mine], j[mine], times[mine].astype(np.float64)
            first = np.flatnonzero(np.diff(i, prepend=-1))
            sums = [times[lo:hi] @ vectors[j[lo:hi]] for lo, hi in zip(first, [*first[1:], len(i)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(i[first]), pa.array(sums, pa.list_(pa.float64()))], ["word", "sum"])

    product = np.zeros((n, k))
    made = pairs.mapInArrow(freeing(run), "word long, sum array<double>").toArrow()  # a row a word of the block, and one more a batch
    for b in made.to_batches():
        np.add.at(product, b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, k))
    product *= share * block.idf[:, None]
    for ws in block.items:
        a, columns = block.passages(block.rows(ws))
        product[columns] += ITEM_WEIGHT * len(block.items) * (a.T @ (a @ q[columns]))
    return np.linalg.qr(product)[0]


def item_blocks(items: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with words, in blocks of at most ITEMS items and, but for a longer item, WORDS words."""
    held, size = [], 0
    for i, text in items:
        words = words_of(text)
        if held and (len(held) == ITEMS or size + len(words) > WORDS):
            yield held
            held, size = [], 0
        if words:
            held.append((i, words))
            size += len(words)
    if held:
        yield held


def benchmark_links(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """LINKS: one row per document and item that it leaks."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty()).orderBy("item_id", "text")
    cut = list(item_blocks((r["item_id"], r["text"]) for r in items.toLocalIterator()))
    found = spark.createDataFrame([], LINKS)
    if not cut:
        return found
    vocabulary = sorted({w for block in cut for _, ws in block for w in ws})
    counts, documents = term_counts(texts, vocabulary)
    weights = Weights(vocabulary, counts, documents)
    wide = any(len({w for _, ws in made for w in ws}) > DIMENSIONS for made in cut)
    pairs = scratch.write(passage_pairs(texts, vocabulary), "pairs") if wide else None
    share = min(1.0, AS_DOCS / max(1, documents))
    group, size = [], 0
    for k, made in enumerate(cut):
        block = Block(made, weights)
        block.set_basis(latent_basis(pairs, block, share))
        group.append(block)
        size += block.nbytes()
        if k + 1 < len(cut) and size < SENT:
            continue
        sent = spark.sparkContext.broadcast((weights, group))
        group, size = [], 0

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in LINKS.split(", ")]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            for b in batches:
                for some in slices(b, 1, SLICE):
                    out = list(links_in(some.column(1), *sent.value))
                    if out:
                        text, *rest = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(text)), *(pa.array(c, t) for c, t in zip(rest, types[1:], strict=True))], names)

        hits = scratch.write(texts.mapInArrow(freeing(run), LINKS), f"links-{k}")
        found = hits if k + 1 == len(cut) and found.isEmpty() else found.union(hits)
    return found


def op9_benchmark_lsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_links(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their own columns, whatever they are called.

    All rows of a doc_id go together, repeated rows and those with a null doc_id too. A null or empty text leaks nothing
    and stays. An empty benchmark or table changes nothing.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    name = free_name(docs, "gone")
    gone = scratch.write(benchmark_links(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "gone")
    side = F.broadcast(gone) if small(gone, 16) else gone
    return docs.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")
