"""The pipeline on a small corpus with known cases: each stage's decisions take effect, clean documents stay, all tokens are packed."""

import numpy as np


def corpus(spark, folder):
    r = np.random.default_rng(8)
    parts = ["an", "er", "th", "on", "re", "ti", "st", "en", "ou", "le"]
    words = sorted({"".join(r.choice(parts, r.integers(1, 5))) for _ in range(3000)})
    text = lambda n: " ".join(r.choice(words, n))
    rows = [(k, text(int(r.integers(60, 300)))) for k in range(150)]
    items = [(k, text(30)) for k in range(5)]
    near = rows[3][1].split()
    near[10] = "changed"
    rows += [(200, rows[1][1].upper()), (201, rows[2][1]), (202, " ".join(near)), (203, f"{text(40)} {items[2][1]} {text(40)}"), (204, "#%$ ZZQX!! %%% 00 " * 30), (205, None), (206, text(30_000))]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, gone = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        if k < 4:
            assert docs.columns == columns
        gone.append(before - {r["doc_id"] for r in docs.select("doc_id").collect()})
    assert {204, 205} <= gone[0] and len(gone[0]) <= 8
    # the text in capitals is unlike the trusted ones; of two equal texts, the larger doc_id stays
    assert gone[1] | gone[0] >= {2} and 201 not in gone[1]
    assert gone[2] <= {202} <= gone[2] | gone[0] and gone[3] <= {203} <= gone[3] | gone[0] and not gone[4]
    packed = docs.collect()
    assert sum(r["length"] for r in packed) > 0 and max(r["offset"] + r["length"] for r in packed) <= 1024
    assert {r["doc_id"] for r in packed} >= set(range(150)) - {2} - gone[0]
    # the very long text is packed whole, in pieces of 1024 but for the first
    long = sorted((r["piece"], r["start"], r["length"]) for r in packed if r["doc_id"] == 206)
    assert len(long) > 60 and all(n == 1024 for _, _, n in long[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:], strict=False))


def test_pipeline_on_no_documents(spark, tmp_path):
    import corpus_pipeline

    corpus(spark, str(tmp_path / "some"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/some/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_run_leaves_only_its_result(spark, tmp_path):
    import os

    import corpus_pipeline

    from galley.llm import common

    corpus(spark, str(tmp_path))
    before = set(os.listdir(common.shared_folder(spark)))
    docs = corpus_pipeline.run(spark, str(tmp_path))
    left = set(os.listdir(common.shared_folder(spark))) - before
    assert len(left) == 1 and docs.count() > 0


def test_the_space_of_the_leaks_is_fitted_on_all_documents(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    from galley.llm import decontamination

    rows, seen = corpus(spark, str(tmp_path)), []
    basis = decontamination.latent_basis
    monkeypatch.setattr(decontamination, "DIMENSIONS", 4)
    monkeypatch.setattr(decontamination, "latent_basis", lambda pairs, block, share: seen.append(pairs) or basis(pairs, block, share))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).count()
    items = [r["text"] for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    known, want = {w for t in items for w in t.split()}, 0
    for _, text in rows:
        words = decontamination.words_of(text or "")
        for start in decontamination.windows(np.array([len(words)]))[1]:
            want += sum(w in known for w in words[start : start + decontamination.WINDOW]) ** 2
    assert sum(r["n"] for pairs in seen for r in pairs.collect()) == want
