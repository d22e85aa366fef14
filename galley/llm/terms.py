"""Words of texts as terms of a vector space: those of a vocabulary one by one, all others by hash bucket, with document frequencies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import freeing, slices

#: Hash buckets of the words outside a vocabulary; bytes of text that are looked at together.
BUCKETS, SLICE = 1 << 16, 1 << 19


def words_in(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text, between white space; a text without words has one empty word."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))


def words_of(text: str, cut: Callable = words_in) -> list[str]:
    return [w for w in cut(pa.array([text], pa.string()))[0].as_py() if w]


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums, with a zero before."""
    return np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order, by a sort, which takes less time than the hash table of np.unique."""
    values = np.sort(values)
    first = np.ones(len(values), dtype=bool)
    first[1:] = values[1:] != values[:-1]
    return values[first]


class Weights:
    """Inverse document frequencies of terms: first the vocabulary's words, then BUCKETS buckets of all other words."""

    def __init__(self, vocabulary: list[str], counts: np.ndarray, documents: int):
        self.vocabulary = vocabulary
        self.idf = np.log((1 + documents) / (1 + np.minimum(counts, documents))) + 1


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number and its inverse, modulo 2**64, from the 0th on; a worker keeps those of a slice."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    odd = 0x9E3779B97F4A7C15
    made = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, x, dtype=np.uint64)]), dtype=np.uint64) for x in (odd, pow(odd, -1, 1 << 64))]
    if n <= 2 * SLICE:
        _powers[:] = made
    return made[0], made[1]


def terms_of(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The term of each word: its place in the vocabulary, or that of its bucket. Each different word is looked up once."""
    every = words.dictionary_encode()
    words = every.dictionary
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets -= offsets[0]
    up, down = powers(max(len(letters), 1))
    total = np.zeros(len(letters) + 1, dtype=np.uint64)
    np.cumsum((letters + np.uint64(1)) * up[: len(letters)], out=total[1:])
    # a polynomial of the word's bytes, moved to begin with power 0
    hashes = (total[offsets[1:]] - total[offsets[:-1]]) * down[np.minimum(offsets[:-1], len(down) - 1)]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    places = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy()
    return np.where(places >= 0, places, len(vocabulary) + (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS)[every.indices.to_numpy()]


def term_counts(texts: DataFrame, vocabulary: list[str], cut: Callable = words_in) -> tuple[np.ndarray, int]:
    """Documents by term, and all documents."""
    sent, n = texts.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary) + BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, known = np.zeros(n, dtype=np.int64), 0, pa.array(sent.value, pa.string())
        for b in batches:
            for some in slices(b, 0, SLICE):
                seen += some.num_rows
                words = cut(some.column(0))
                text = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
                total += np.bincount(distinct(text * n + terms_of(words.flatten(), known)) % n, minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen))], ["term", "n"])

    out, documents = np.zeros(n), 0
    for row in texts.select("text").mapInArrow(freeing(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # a number a word of the vocabulary or bucket
        if row["term"] < 0:
            documents = row["n"]
        else:
            out[row["term"]] = row["n"]
    return out, documents
