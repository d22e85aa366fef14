"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of characters, spaces between words included.

Training text is four fifths of the trusted documents (quality 1, toxic 0), in full. Tasks count n-grams, sharded
aggregates sum them, and each order's probabilities come from joins of its counts, its context totals and the order
below, sharded by n-gram. A document's perplexity is that of its whole text, white space as single spaces: each
character is looked up with the longest context that was seen, and a context's weight is paid for each step down. The
table of what was seen is sent to the executors if its size, which is counted first, allows it; else the documents'
n-gram counts are joined with it. Both ways use the same numbers.

A document is rejected if its perplexity is outside the quantiles of held-out trusted documents (the other fifth, which
the model has not seen) of its language and about its length: over the upper one it is unlike trusted text, under the
lower one it is more predictable than such text is.

Nulls: a null text is empty; a text without words has no perplexity and is rejected. A null lang is a language of its
own. Languages or lengths with few held-out documents take the quantiles of more. Labels of a null doc_id are ignored;
a repeated doc_id is trusted only if all its labels are. With no trusted document at all, every document with words
stays. Repeated rows pass through. An empty table gives no rows. Other columns are kept out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import Scratch, free_name, freeing, slices, small, text_or_empty

#: A character is 12 bits, so an n-gram of up to five is one number; 0 is none. Those from U+0D00 on share 768 numbers.
ORDER, BITS, FAR = 5, 12, 0xD00
OTHER, BOS, EOS = 1, 2, 3
#: Quantiles of held-out perplexities and the factor beyond them; held-out documents that a language and length need; the share held out.
LOWER, UPPER, MARGIN, ENOUGH, HELD_OUT = 0.001, 0.995, 1.05, 40, 5
#: Rows of the table that are sent whole, 24 bytes each; bytes of text that a task looks at together; n-grams it holds before it gives their counts on.
SENT_ROWS, SLICE, HELD_GRAMS = 2_000_000, 1 << 19, 1_000_000
U = np.uint64


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the characters of all texts as numbers, each text with its bounds; where each text begins). White space is single spaces."""
    tidy = [" ".join(t.split()) for t in texts]
    lengths = np.fromiter(map(len, tidy), dtype=np.int64, count=len(tidy))
    starts = np.cumsum(lengths + 2) - lengths - 2
    points = np.frombuffer("".join(tidy).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.empty(len(points) + 2 * len(tidy), dtype=U)
    inside = np.ones(len(out), dtype=bool)
    inside[starts] = inside[starts + lengths + 1] = False
    out[inside] = np.where(points >= FAR, FAR + points % ((1 << BITS) - FAR), np.where(points <= EOS, OTHER, points))
    out[starts], out[starts + lengths + 1] = BOS, EOS
    return out, starts


def grams_of(letters: np.ndarray, starts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each place, shorter near the beginning of its text."""
    at = np.arange(len(letters)) - np.repeat(starts, np.diff(np.append(starts, len(letters))))
    out = letters.copy()
    for k in range(1, order):
        out[k:] |= np.where(at[k:] >= k, letters[:-k] << U(BITS * k), U(0))
    return out


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n): the n-grams of the texts, the longest and those that begin one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

        for b in batches:
            for some in slices(b, 0, SLICE):
                letters, starts = folded([t for t in some.column(0).to_pylist() if t.strip()])
                if len(starts):
                    # a text's first place, its bound, is not predicted
                    held.append(np.unique(np.delete(grams_of(letters, starts, order), starts), return_counts=True))
                if sum(len(k) for k, _ in held) > HELD_GRAMS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_GRAMS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["gram", "n"])
                        held = []
        if held:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])

    return texts.select("text").mapInArrow(freeing(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    n = [*counts, 0, 0, 0, 0][:4]
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2.0]
    return tuple(float(min(max(x, 0.05), k + 0.95)) for k, x in enumerate(d))


def last(gram: Column, k: int) -> Column:
    """The last k characters of an n-gram."""
    return gram.bitwiseAND(F.lit((1 << BITS * k) - 1))


def has(gram: Column, k: int) -> Column:
    """An n-gram of k characters or more."""
    return gram >= F.lit(1 << BITS * (k - 1))


def model(grams: DataFrame, scratch: Scratch, order: int = ORDER) -> tuple[DataFrame, float]:
    """((gram, logp, back), the logarithm of the probability of a character never seen) from (gram, n).

    logp: that of the last character after the others, for the n-grams of all orders that were seen. back: that of the
    weight which the n-gram, as a context, leaves to the order below; null for what is no context.
    """
    counts = {order: grams.where(has(F.col("gram"), order)).select("gram", F.col("n").alias("c"))}
    for k in range(order - 1, 0, -1):
        left = counts[k + 1].groupBy(last(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        # what begins a text has nothing before it and keeps its own count
        starts = grams.where(has(F.col("gram"), k) & ~has(F.col("gram"), k + 1)).select("gram", F.col("n").alias("c"))
        counts[k] = scratch.write(left.union(starts) if k > 1 else left, f"counts-{k}")
    out, below, unseen = [], None, 0.0
    for k in range(1, order + 1):
        times = {r["c"]: r["n"] for r in counts[k].where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows at most
        d1, d2, d3 = discounts([times.get(i, 0) for i in range(1, 5)])
        cut = F.least(F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3), F.col("c"))
        context = F.shiftright("gram", BITS)
        totals = scratch.write(counts[k].groupBy(context.alias("context")).agg(F.sum("c").cast("double").alias("total"), (F.sum(cut) / F.sum("c")).alias("rest")), f"totals-{k}")
        if k == 1:
            row, letters = totals.first(), counts[1].count() + 1
            unseen = float(np.log((row["rest"] if row else 1.0) / letters))
            p = (F.col("c") - cut) / F.col("total") + F.col("rest") / letters
            made = counts[1].withColumns({c: F.lit(float(row[c]) if row else 1.0) for c in ("total", "rest")})
        else:
            suffixes = below.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            made = counts[k].withColumn("context", context).join(totals, "context").withColumn("suffix", last(F.col("gram"), k - 1)).join(suffixes, "suffix")
            p = (F.col("c") - cut) / F.col("total") + F.col("rest") * F.col("q")
            out.append(totals.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("rest").alias("back")))
        below = scratch.write(made.select("gram", p.alias("p")), f"order-{k}")
        out.append(below.select("gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("back")))
    every = out[0]
    for part in out[1:]:
        every = every.union(part)
    return scratch.write(every.groupBy("gram").agg(F.max("logp").alias("logp"), F.max("back").alias("back")), "model"), unseen


class Table:
    """The model as a hash table in numpy, with open addressing."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray, back: np.ndarray, unseen: float, order: int = ORDER):
        """logp and back are nan where the model has none."""
        self.order, self.unseen = order, unseen
        self.bits = max(4, int(np.ceil(np.log2(2 * len(grams) + 2))))
        self.keys, self.row = np.zeros(1 << self.bits, dtype=U), np.full(1 << self.bits, len(grams), dtype=np.int32)
        todo, at = np.arange(len(grams)), self.slot(grams)
        while len(todo):
            free = self.keys[at] == 0
            taken, one = np.unique(at[free], return_index=True)  # of those that want a free slot, one gets it
            own = np.flatnonzero(free)[one]
            self.keys[taken], self.row[taken] = grams[todo[own]], todo[own]
            rest = np.ones(len(todo), dtype=bool)
            rest[own] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.logp, self.back = np.append(logp, np.nan), np.append(np.nan_to_num(back), 0.0)

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Rows, or that of nothing."""
        at = self.slot(grams)
        out, key = self.row[at], self.keys[at]
        open_ = np.flatnonzero((key != grams) & (key != 0))
        out[key == 0] = len(self.logp) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            key = self.keys[at[open_]]
            out[open_] = np.where(key == grams[open_], self.row[at[open_]], len(self.logp) - 1)
            open_ = open_[(key != grams[open_]) & (key != 0)]
        return out

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each n-gram's last character after the others."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(self.order, 0, -1):
            if k > 1:
                long = grams[todo] >= U(1 << BITS * (k - 1))
                mine, wait = todo[long], todo[~long]
            else:
                mine, wait = todo, todo[:0]
            g = grams[mine] & U((1 << BITS * k) - 1)
            p = self.logp[self.find(g)]
            lost = np.isnan(p)
            out[mine[~lost]] += p[~lost]
            left = mine[lost]
            out[left] += self.back[self.find(g[lost] >> U(BITS))] if k > 1 else self.unseen
            todo = np.concatenate([wait, left])
        return out


def gram_scores(grams: DataFrame, table: DataFrame, unseen: float, order: int = ORDER) -> DataFrame:
    """(gram, logp) by joins: what Table.scores gives."""
    out, score = grams.select("gram"), F.lit(unseen)
    for k in range(1, order + 1):
        own = table.where("logp is not null").select(F.col("gram").alias(f"g{k}"), F.col("logp").alias(f"p{k}"))
        out = out.join(own, last(F.col("gram"), k) == F.col(f"g{k}"), "left").drop(f"g{k}")
        back = F.lit(0.0)
        if k > 1:
            context = table.where("back is not null").select(F.col("gram").alias(f"c{k}"), F.col("back").alias(f"b{k}"))
            out = out.join(context, F.shiftright(last(F.col("gram"), k), BITS) == F.col(f"c{k}"), "left").drop(f"c{k}")
            back = F.coalesce(f"b{k}", F.lit(0.0))
        score = F.when(has(F.col("gram"), k), F.coalesce(f"p{k}", back + score)).otherwise(score) if k > 1 else F.coalesce("p1", score)
    return out.select("gram", score.alias("logp"))


def perplexities(docs: DataFrame, table: DataFrame, unseen: float, scratch: Scratch, order: int = ORDER, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, lang, part, chars (characters predicted, the end included), perplexity (null without words) for docs (doc_id, lang, part, text)."""
    schema, names = "doc_id long, lang string, part int, total double, chars long", ["doc_id", "lang", "part", "total", "chars"]
    if table.count() <= sent_rows:
        rows = table.toArrow()  # bounded by sent_rows
        sent = docs.sparkSession.sparkContext.broadcast((rows["gram"].to_numpy().view(U), *(rows[c].to_numpy() for c in ("logp", "back")), unseen, order))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Table(*sent.value)
            for b in batches:
                for some in slices(b, 3, SLICE):
                    letters, starts = folded(some.column(3).to_pylist())
                    score = known.scores(grams_of(letters, starts, order))
                    score[starts] = 0.0
                    chars = np.diff(np.append(starts, len(letters))) - 1
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(np.add.reduceat(score, starts)), pa.array(np.where(chars > 1, chars, 0))], names)

        scored = docs.select("doc_id", "lang", "part", "text").mapInArrow(freeing(run), schema)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    letters, starts = folded([text])
                    if len(letters) > 2:
                        grams, n = np.unique(grams_of(letters, starts, order)[1:], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), row)), pa.array(grams.view(np.int64)), pa.array(n)], ["row", "gram", "n"])

        kept = scratch.write(docs.select("doc_id", "lang", "part", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
        counted = scratch.write(kept.select("row", "text").mapInArrow(freeing(run), "row long, gram long, n long"), "counted")
        scores = scratch.write(gram_scores(counted.select("gram").distinct(), table, unseen, order), "gram-scores")
        sums = counted.join(scores, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("total"), F.sum("n").alias("chars"))
        scored = kept.drop("text").join(sums, "row", "left").select("doc_id", "lang", "part", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("chars", F.lit(0)).alias("chars"))
    return scored.select("doc_id", "lang", "part", "chars", F.when(F.col("chars") > 0, F.exp(-F.col("total") / F.col("chars"))).alias("perplexity"))


def length_band(chars: Column) -> Column:
    """0 under 64 characters, then a band for each factor of 4, and the last from 16,384 on."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.floor(F.log2(F.greatest(chars, F.lit(1)) / 16) / 2))).cast("int")


def thresholds(scored: DataFrame, lower: float, upper: float, margin: float) -> DataFrame:
    """scored with low and high: the quantiles of the held-out documents (part 2) of a language and band, else of the language, of the band, of all; nothing is out of bounds without any."""
    good = scored.where("part = 2 and perplexity is not null").withColumn("band", length_band(F.col("chars")))
    bound = F.percentile_approx("perplexity", F.array(F.lit(lower), F.lit(upper)), F.lit(10_000))
    by = lambda *keys: good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bound.alias("q")).where(F.col("n") >= ENOUGH if keys else F.lit(True))
    out = scored.withColumn("band", length_band(F.col("chars")))
    both = by("lang", "band").select(F.col("lang").alias("l1"), F.col("band").alias("b1"), F.col("q").alias("q1"))
    lang, band = by("lang").select(F.col("lang").alias("l2"), F.col("q").alias("q2")), by("band").select(F.col("band").alias("b3"), F.col("q").alias("q3"))
    out = out.join(both, F.col("lang").eqNullSafe(F.col("l1")) & (F.col("band") == F.col("b1")), "left").join(lang, F.col("lang").eqNullSafe(F.col("l2")), "left").join(band, F.col("band") == F.col("b3"), "left")
    row = by().first()
    every = F.array(*map(F.lit, row["q"])) if row and row["q"] else F.array(F.lit(0.0), F.lit(float("inf")))
    q = F.coalesce("q1", "q2", "q3", every)
    return out.select(*scored.columns, (q[0] / margin).alias("low"), (q[1] * margin).alias("high"))


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, lower: float = LOWER, upper: float = UPPER, margin: float = MARGIN, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, lang, chars, perplexity, low, high, keep."""
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    sound = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("marked")).agg(F.min(sound).alias("trusted"))
    marks = scratch.write(marks.where("trusted").select("marked"), "trusted")
    side = F.broadcast(marks) if small(marks, 16) else marks
    tidy = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty())
    # 1: trains the model, 2: held out, 0: all others
    part = F.when(F.col("marked").isNull(), 0).when(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0, 2).otherwise(1)
    tidy = tidy.join(side, F.col("doc_id") == F.col("marked"), "left").withColumn("part", part).drop("marked")
    grams = scratch.write(gram_counts(tidy.where("part = 1"), order), "grams")
    table, unseen = model(grams, scratch, order)
    scored = scratch.write(perplexities(tidy, table, unseen, scratch, order, sent_rows), "scored")
    found = thresholds(scored, lower, upper, margin)
    keep = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return found.select("doc_id", "lang", "chars", "perplexity", "low", "high", keep.alias("keep"))


def op7_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns, whatever they are called.

    Of rows that share a doc_id, null included, all go if any is rejected. A null or empty text goes. Without labels every
    text with words stays. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    name = free_name(docs, "rejected")
    gone = scratch.write(classify(docs, labels).where(~F.col("keep")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    side = F.broadcast(gone) if small(gone, 16) else gone
    return docs.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")
