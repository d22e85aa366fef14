import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from galley.llm import packing as p

PATH = p.tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)
IDS = p.Ids(PATH)




def plain(text):
    """The tokenizer's plain call, nothing set on it."""
    return TOKENIZER.encode(text, add_special_tokens=False).ids


PARTS = st.one_of(st.text(st.sampled_from("ab éßøЖǰ,.'\n\t\x1c\x85\u00a0\u3000<|>1語"), max_size=30), st.lists(st.sampled_from(["a", " ", "<|endoftext|>", "<|endoftext", "|>", "b.", "\n", "don't", "", "x" * 70]), max_size=12).map("".join))


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=5))
def test_ids_are_those_of_the_plain_call(texts):
    assert [x.tolist() for x in IDS.encode(pa.array(texts, pa.string()))] == [plain(t) for t in texts]


def test_special_tokens_and_many_chunks(monkeypatch):
    monkeypatch.setattr(p, "CHUNKS", 2)
    for text in ("a <|endoftext|> b", "say <|endoftext|> now, don't. " + "x" * 300, "", " ", "one two three four five", "a  b \n c ", "x<|endoftext|>  <|endoftext|>y z"):
        assert [x.tolist() for x in IDS.encode(pa.array([text, "next one", ""]))] == [plain(text), plain("next one"), []]
    assert plain("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_the_encoder_has_the_tokenizers_pattern():
    import public_tokenizers

    assert p.PATTERN == public_tokenizers.PATTERN


def test_slices_have_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["", "a" * p.SLICE, "b", "", "c" * (3 * p.SLICE), "d"])], ["text"])
    parts = list(p.slices(batch, 0, p.SLICE))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist() and 1 < len(parts) <= 5 and all(x.num_rows for x in parts)


def test_pieces():
    assert p.pieces_of(1024) == [(0, 1024)]
    assert p.pieces_of(1025) == [(0, 1), (1, 1024)]
    assert p.pieces_of(3) == [(0, 3)]


@given(st.lists(st.integers(1, 20), min_size=1, max_size=12), st.integers(20, 30))
def test_fullest_is_the_best_subset(lengths, limit):
    best = {0}
    for x in lengths:
        best |= {b + x for b in best if b + x <= limit}
    used = p.fullest(np.bincount(lengths, minlength=40), limit)
    assert sum(used) == max(best)
    assert not np.any(np.bincount(used, minlength=40) > np.bincount(lengths, minlength=40))


def test_packs_all_rows(spark):
    rows = [(1, "one two"), (2, None), (2, None), (None, "x"), (3, "word " * 3000), (4, ""), (5, "a b c " * 200)]
    out = p.best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank"), PATH).collect()
    assert sum(r["length"] for r in out) == sum(len(plain(t or "")) + 1 for _, t in rows)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    ids = np.array([*plain(rows[4][1]), 2], dtype="<u4")
    for r in out:
        if r["doc_id"] == 3:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert len(by) <= -(-sum(r["length"] for r in out) // 1024) + 1


def test_empty(spark):
    assert p.best_fit_pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])


def test_batches_of_texts_are_short(spark):
    """10,000 rows of texts do not reach a worker at once; the rows are the same."""
    from galley.llm.common import BATCH_BYTES, Scratch

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    Scratch(spark, "batches")
    texts = spark.range(0, 6000, 1, 1).selectExpr("repeat('text ', 400) AS text")
    rows = texts.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in rows) == 6000 and len(rows) > 2 and max(r["bytes"] for r in rows) <= 1.1 * BATCH_BYTES
    spark.conf.set(name, "1m")
    Scratch(spark, "batches")
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)
