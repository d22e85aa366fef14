"""Vector codes, suffix-array dedup and fill-in-middle: edge cases and brute-force versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from galley.llm import delta_lloyd, fim, suffix_dedup
from galley.llm.common import Scratch
from tests.llm.test_operators import docs

VECTORS = "vec_id long, embedding array<float>, label int, rid long, codes binary, x string, named string, n long"


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(codes and errors by row, codebooks) of rows of whole components."""
    x = [[math.floor(scale * c) for c in v] for v in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    books = [[cut[e][p] for e in range(min(entries, len(x)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                got = [v[p] for v, n in zip(cut, near, strict=True) if n[p][1] == e]
                if got:
                    books[p][e] = [sum(c) // len(got) for c in zip(*got, strict=True)]
    near = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [("".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n)) for n in near], digest


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, b"", "x", "y", 2) for i, v, lab in rows], VECTORS)


@pytest.mark.parametrize("n", [5, 60])
def test_vector_codes(spark, tmp_path, n):
    r = random.Random(n)
    centre = [[r.uniform(-1, 1) for _ in range(16)] for _ in range(4)]
    rows = [(k, [float(np.float32(c + r.gauss(0, 0.2))) for c in centre[k % 4]], r.choice([None, 1, 2])) for k in range(n)]
    rows += [(n + k, rows[0][1], 7) for k in range(n // 2)]  # one vector many times
    bad = [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [math.nan] + [0.0] * 15, 1), (1003, [math.inf] + [0.0] * 15, 1), (1004, [0.0] * 8, 1), (1005, [0.0] * 17, 1), (1006, [], 1), (1007, [1e30] + [0.0] * 15, 1)]
    shuffled = rows + bad
    r.shuffle(shuffled)
    vectors(spark, shuffled).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {x["vec_id"]: x for x in delta_lloyd.op11_vector_codes(spark, str(tmp_path)).collect()}
    want, digest = lloyd([v for _, v, _ in rows])
    assert sorted(out) == [i for i, _, _ in rows]
    labels = {}
    for (_, _, lab), (_, error) in zip(rows, want, strict=True):
        labels[lab] = labels.get(lab, 0) + error
    for (i, _, lab), (code, error) in zip(rows, want, strict=True):
        assert (out[i]["code"], out[i]["error"], out[i]["label_error"], out[i]["codebooks_sha256"]) == (code, error, labels[lab], digest)


def test_vector_codes_of_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(k // 2 if k else None, [float(k % 3)] * 8, None) for k in range(40)]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = delta_lloyd.op11_vector_codes(spark, str(tmp_path)).collect()
    want, digest = lloyd([v for _, v, _ in ordered])
    assert len(out) == 40 and {x["codebooks_sha256"] for x in out} == {digest} and sorted(x["code"] for x in out) == sorted(c for c, _ in want)
    (tmp_path / "none").mkdir()
    vectors(spark, [(1, None, 1)]).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert delta_lloyd.op11_vector_codes(spark, f"{tmp_path}/none").count() == 0


def test_only_changed_parts_move_the_sums():
    r = np.random.default_rng(3)
    x, books = r.integers(-99, 99, (200, 2, 4)), r.integers(-99, 99, (2, 5, 4))
    old, _ = delta_lloyd.nearest(x, books)
    new = old.copy()
    new[3, 0] = (new[3, 0] + 1) % 5
    moved = delta_lloyd.differences(x, old, new, 5)
    assert sorted((d["entry"], d["n"]) for d in moved) == sorted([(int(old[3, 0]), -1), (int(new[3, 0]), 1)])
    assert all(d["part"] == 0 and [abs(s) for s in d["sums"]] == np.abs(x[3, 0]).tolist() for d in moved)
    assert delta_lloyd.differences(x, new, new, 5) == []


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled(doc_id, text):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark, tmp_path):
    r = random.Random(1)
    signs = ["a", "word", " ", "\t", "\n", "\x0b", "\r\n", "\x1e", "\x1b", "\x1be", "\x1bd", "\x1c", "\x85", " ", " ", "é", "漢", "😀", "é", "<", "P>", "<S", "$1", "\\", "\0"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(300)] + ["", None, " ", "x", "see <P> here", "<S>", "a<M>", "word " * 30_000, " " * 50_000 + "end", "\x1e" * 2000]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(None, "no id here", "en", "s"), (3, texts[3], "en", "s"), (3, "other text of the id", "en", "s")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = fim.op13_fill_in_middle(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *filled(i, t or "")[:4], sha(filled(i, t or "")[4]), sha(t or "")) for i, t, *_ in rows]
    key = lambda x: tuple(str(c) for c in x)
    assert sorted((tuple(x) for x in out), key=key) == sorted(want, key=key)
    assert {x["form"] for x in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs(spark, [])).count() == 0


def repeats(rows, length=50):
    """(id, bytes, removed, spans, kept) of every row, string by string."""
    least = {}
    big = 2**63 - 1
    bodies = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            least[s] = min(least.get(s, big), i)
    out = []
    for (i, b), (doc_id, _) in zip(bodies, rows, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def varied(seed):
    r = random.Random(seed)
    words = ["the", "of", "lorem", "ipsum", "é", "漢字", "😀", "zz", "\0", "and"]
    passages = ["".join(r.choices("abcdefgh ", k=r.randint(20, 400))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [r.choice([" ".join(r.choices(words, k=r.randint(0, 40))), r.choice(passages), r.choice(passages)[r.randint(0, 20) :]]) for _ in range(r.randint(0, 6))]
        rows.append((r.choice([k, k, k, k // 2, None]), "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 49), (103, "a" * 50), (104, "a" * 500), (1, "a" * 51), (105, passages[0][:50]), (106, "漢" * 30), (107, "漢" * 17)]
    rows += [(200 + k, passages[1] * 3) for k in range(9)] + [(5, passages[2]), (5, passages[2])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_long_repeats(spark, batches):
    rows = varied(batches)
    given = docs(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    out = suffix_dedup.without_repeats(given, batches, digest=True).collect()
    key = lambda x: tuple(str(c) for c in x)
    assert sorted((tuple(x) for x in out), key=key) == sorted(repeats(rows), key=key)


def test_long_repeats_over_pieces_runs_and_shards(spark, monkeypatch):
    """Texts longer than a piece that is hashed at once and than a run."""
    r = random.Random(9)
    base = "".join(r.choices("abcdefghijkl mnop", k=150_000))
    rows = [(1, base), (2, base[:70_000] + "!" + base[70_000:]), (3, "x" + base[60_000:70_000]), (4, base[::-1])]
    out = suffix_dedup.without_repeats(docs(spark, [(i, t, "en", "s") for i, t in rows]), 2, digest=True).collect()
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in out}
    assert got == {1: (0, 0), 2: (150_000, 2), 3: (10_000, 1), 4: (0, 0)}
    assert {x["doc_id"]: x["kept_sha256"] for x in out}[3] == hashlib.sha256(b"x").hexdigest()


def test_long_repeats_of_nothing(spark):
    assert suffix_dedup.without_repeats(docs(spark, [])).count() == 0
    out = suffix_dedup.without_repeats(docs(spark, [(1, None, "en", "s"), (None, "short", None, None)])).collect()
    assert sorted((x["n_bytes"], x["n_removed"], bytes(x["kept"])) for x in out) == [(0, 0, b""), (5, 0, b"short")]


def test_family_keeps_levels_of_powers_of_two(spark):
    scratch = Scratch(spark, "family-test")
    texts = scratch.bucketed(suffix_dedup.in_runs(docs(spark, [(k, f"{k % 3} " + "same passage of some length, long enough to match " * 2, "en", "s") for k in range(35)]), 7), "texts", 4, "run", by="batch")
    family, sizes, spans = suffix_dedup.Family(scratch), [], 0
    for b in range(7):  # without a screen: all stretches are indexed
        spans += family.add(suffix_dedup.stretches(texts.where(f"batch = {b}"), None, 64)).count()
        sizes.append([n for _, n in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1]] and spans > 0
    scratch.drop()


def test_full_buckets_lose_no_pair():
    """Every two rows of a bucket meet in a tile, whatever its number of groups and however unlike the rows are."""
    from galley.llm import simhash

    rows, r = np.arange(60), np.random.default_rng(5)
    keys = np.repeat([7, 9, 11], 20)
    for groups in (None, np.array([2, 5])):
        made, which = simhash.split_keys(keys, rows, np.array([7, 11]), [r.integers(0, 1 << 62, 60) for _ in range(3)], groups)
        met = {(i, j) for k in set(made.tolist()) for i in which[made == k].tolist() for j in which[made == k].tolist()}
        assert met == {(i, j) for i in range(60) for j in range(60) if keys[i] == keys[j]}
        assert (made[keys[which] == 9] == 9).all() and (made[keys[which] != 9] < 0).all()
