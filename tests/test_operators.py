"""Operators on hand-written rows."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from galley.functions import answers, numbers
from galley.functions.hashing import fnv1a32
from galley.operators import alignment, amounts, calibration, findings, scoring, sections, states, text
from galley.sources import ingest
from galley.streaming import pass_stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scoring_example(spark):
    planted = spark.createDataFrame([("p", str(k), k, q, [(9, "alternative here")] if k == 4 else []) for k, q in ((1, "Net sales 100"), (2, "two"), (3, "three"), (4, "four"))], "packet_id string, id string, page int, quote string, alt array<struct<page:int,quote:string>>")
    run = spark.createDataFrame([("p", 1, "net sales, 100 *"), ("p", 9, "the alternative here"), ("p", 7, "spurious")], "packet_id string, page int, quote string")
    both = run.union(spark.createDataFrame([("p", 3, "wide 'three'")], run.schema))
    assert scoring.recall_by(planted, scoring.detected(planted, run)).first()["recall"] == 50.0
    assert scoring.recall_by(planted, scoring.detected(planted, both)).first()["recall"] == 75.0
    assert scoring.valid_candidates(run, planted).count() == 2
    assert scoring.without_ignored(run, spark.createDataFrame([("p", 7, "spurious")], run.schema)).count() == 2
    b = scoring.burden(run, spark.createDataFrame([("p",), ("q",)], "packet_id string")).first()
    assert (b["mean"], b["p90"], b["most"]) == (1.5, 3, 3)
    assert scoring.burden(run.where("false"), spark.createDataFrame([], "packet_id string")).first()["p90"] == 0


def test_sections(spark):
    got = [tuple(r) for r in sections.page_sections(spark.createDataFrame([(1, 150), (2, 26), (3, 0), (4, 25)], "doc_id long, total int")).orderBy("doc_id", "index").collect()]
    first = [r for r in got if r[0] == 1]
    assert first[0][2:] == (1, 25) and first[1][2] == 23 and first[-1][3] == 150
    assert len([r for r in got if r[0] == 2]) == 2 and not [r for r in got if r[0] == 3] and len([r for r in got if r[0] == 4]) == 1
    assert one(spark, sections.parse_pages(F.lit("7, 10-13"))) == [7, 10, 11, 12, 13]
    assert one(spark, sections.parse_pages(F.lit("13-10"))) is None and one(spark, sections.parse_pages(F.lit("a"))) is None and one(spark, sections.parse_pages(F.lit(""))) == []


def test_calibration(spark):
    r = spark.createDataFrame([(0.05, 1), (0.05, None), (1.0, 0)], "confidence double, label int")
    bins = {x["bin"]: x for x in calibration.calibration_bins(r).collect()}
    assert bins[0]["count"] == 2 and bins[0]["labelled"] == 1 and bins[9]["precision"] == 0.0 and bins[5]["count"] == 0
    assert calibration.calibration_error(r.where("label is null")).first()["ece"] is None
    assert one(spark, calibration.normalise_confidence(F.lit(87.0))) == 0.87 and one(spark, calibration.normalise_confidence(F.lit(-3.0))) == 0.0
    known = {"": 0x811C9DC5, "a": 0xE40C292C}  # FNV-1a of one code unit equals that of one byte only for ASCII's first byte
    assert one(spark, fnv1a32(F.lit(""))) == known[""] and one(spark, fnv1a32(F.lit("a"))) == known["a"]


def test_similarity(spark):
    assert one(spark, alignment.similarity(F.lit("Net Sales"), F.lit("net sales!"))) == 1.0
    assert one(spark, alignment.similarity(F.lit(""), F.lit("x"))) == 0.0
    assert one(spark, alignment.similarity(F.lit("one two three four"), F.lit("one two three"))) == pytest.approx(0.97)


def test_alignment_relations(spark):
    t = spark.createDataFrame([(1, 0, "alpha beta gamma delta"), (1, 1, "nothing like it"), (1, 2, "epsilon zeta eta theta")], "doc_id long, idx long, text string")
    r = spark.createDataFrame([(1, 0, "alpha beta gamma delta"), (1, 1, "epsilon zeta eta theta"), (1, 2, "epsilon zeta eta theta"), (1, 3, "left over words")], "doc_id long, idx long, text string")
    got = {(x["target"], tuple(x["references"])): x["relation"] for x in alignment.align_items(t, r).collect()}
    assert got == {(0, (0,)): "1:1", (2, (1, 2)): "1:n", (1, ()): "unmatched_target", (None, (3,)): "unmatched_reference"}


def test_ledger_and_states(spark):
    c = spark.createDataFrame([("f", 1, "low", "review_pending"), ("f", 2, "high", "rejected"), ("f", 3, "low", "accepted")], "fingerprint string, arrival int, severity string, state string")
    r = alignment.merge_ledger(c).first()
    assert (r["severity"], r["state"], r["merged"]) == ("high", "rejected", 3)
    assert one(spark, alignment.stable_identity(F.lit("A"), F.lit(None), F.lit(3))) == "a||3"
    p = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 7), (2, 5)], "k int, page int")
    assert {r["k"]: r["pages"] for r in states.page_ranges(p, "k", "page").collect()} == {1: "1-3,7", 2: "5"}


def test_dedupe_does_not_depend_on_order(spark):
    rows = [(1, "typo", "a  b", "x|y", 3), (1, "typo", "a b", "x|y", 1), (1, "typo", "a b", "x", 2), (1, "typo|a b", "", "x", 4)]
    for order in itertools.islice(itertools.permutations(rows), 4):
        got = findings.exact_dedupe(spark.createDataFrame(order, "page int, category string, quote string, suggestion string, no int")).collect()
        assert sorted((r["no"], r["copies"]) for r in got) == [(1, 2), (2, 1), (4, 1)]


def test_text(spark):
    assert one(spark, text.script_language(F.lit("売上高は増加しました"))) == "日本語"
    assert one(spark, text.script_language(F.lit("Net sales rose"))) == "英語" and one(spark, text.script_language(F.lit("12 34"))) == "その他"
    assert one(spark, text.fold_quarters(F.lit("第1四半期 and 2Q and Q3"))) == "q1 and q2 and q3"
    assert one(spark, text.truncate_number_safe(F.lit("total 12345 yen"), 8)) == "total "
    assert one(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 3
    assert one(spark, text.unique_index(F.lit("abcab"), F.lit("c"))) == 2 and one(spark, text.unique_index(F.lit("abcab"), F.lit("ab"))) == -1
    assert one(spark, text.strip_html(F.lit("<html><script>var a='<p>';</script><p>A &amp; B</p><!-- x --></html>"))) == "A & B"


def test_numbers():
    en = numbers.tokenize("Sales of 1,285.7 billion yen, (24) and 3k in 2024, see page 7")
    assert [(n.raw, n.negative, n.micro) for n in en] == [("1,285.7 billion", False, 1285_700_000_000 * 10**6), ("(24)", True, 24 * 10**6), ("3k", False, 3000 * 10**6)]
    ja = numbers.tokenize("売上高1兆2,857億円、▲3万円", "ja")
    assert [(n.micro, n.negative) for n in ja] == [(1_285_700_000_000 * 10**6, False), (30_000 * 10**6, True)]
    symbols = numbers.Symbols(3)
    a, found = numbers.mask("It was 4,918.2 billion yen and 7.", "en", symbols)
    b, _ = numbers.mask("4,918,172 million yen", "en", symbols)
    assert numbers.unmask(a, found) == "It was 4,918.2 billion yen and 7." and numbers.SYMBOL.findall(a)[0] == numbers.SYMBOL.findall(b)[0]
    assert not numbers.leaks(a) and numbers.leaks(a + " 55")
    with pytest.raises(ValueError, match="match"):
        numbers.unmask(a + "⟦#ABC⟧", found)
    c, _ = numbers.mask("4,918.3 billion", "en", symbols)
    assert numbers.SYMBOL.findall(c)[0] != numbers.SYMBOL.findall(a)[0]


def test_answers():
    assert answers.balanced_objects('x {"a": "}"} y {} {"b": {"c": 1}} {') == ['{"a": "}"}', "{}", '{"b": {"c": 1}}']
    assert answers.repair_json('{"a": [1, 2,],}') == ('{"a": [1, 2]}', ["trailing_comma"])
    assert json.loads(answers.repair_json('{"a": [{"b": 1}, {"b": ')[0])["a"][0] == {"b": 1}
    assert answers.repair_json("no") == (None, [])
    assert answers.pick_answer('{"packet_id": "q", "findings": []} {"packet_id": "p", "findings": [{"x": 1}]}', "p", [1])[0] == '{"findings": [{"x": 1}], "packet_id": "p"}'
    assert answers.check_answer({"findings": [], "checked_pages": [3]}, "p", [1, 2]) == ["pages"]


def test_amounts(spark):
    assert str(one(spark, amounts.scaled(F.lit("1285.7").cast("decimal(18,6)"), F.lit(12)))) == "1285700000000000.000000"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a, \"b\"\nc", 1)], "text string, n int")
    ingest.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/json")).first()["text"] == "a, \"b\"\nc"
    assert [ingest.write_report_folder(rows, str(tmp_path), "out") for _ in range(3)] == ["out", "out (2)", "out (3)"] and spark.read.json(str(tmp_path / "out (2)/json")).count() == 1
    for bad in ("", "..", "a/b", "c:d"):
        with pytest.raises(ValueError, match="name"):
            ingest.write_report_folder(rows, str(tmp_path), bad)
    with pytest.raises(Exception, match="zero|ZERO|assert|raise"):
        ingest.write_report_folder(rows.select(F.raise_error(F.lit("raise")).cast("string").alias("x")), str(tmp_path), "broken")
    assert not (tmp_path / "broken").exists()
    ingest.append_csv(rows.select("n"), str(tmp_path / "stats"))
    ingest.append_csv(rows.select("n"), str(tmp_path / "stats"))
    assert spark.read.option("header", True).csv(str(tmp_path / "stats")).count() == 2


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(k, f"2024-01-01 0{k % 3}:10:00", 1, "view", 90.0 if k == 3 else 1.0, "{}") for k in range(9)], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    rows = pass_stats.windowed_health(pass_stats.stream(spark, str(tmp_path / "in")))
    pass_stats.append_to(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and got.agg(F.sum("n")).first()[0] == 6  # the last window is still open


def test_visual_lines(spark):
    from galley.operators import documents

    items = [("Net", 0, 100, 20), (" ", 20, 100, 4), ("sales", 24, 100, 30), ("sales", 25, 100, 30), ("100", 80, 101, 20), ("Second line", 0, 80, 60), ("", 0, 60, 5)]
    df = spark.createDataFrame([(1, 1, s, float(x), float(y), float(w), 10.0) for s, x, y, w in items], "doc_id long, page long, str string, x double, y double, width double, height double")
    assert [r["text"] for r in documents.visual_lines(df).orderBy("line").collect()] == ["Net sales 100", "Second line"]
    assert documents.visual_lines(df.where("false")).count() == 0


def test_bind_source_only_unique_and_whole_numbers(spark):
    from galley.operators import documents

    rows = spark.createDataFrame([(1, 1, 1, "sales 1,234 up"), (1, 2, 2, "sales 234 up"), (1, 3, 3, "sales 234 again")], "doc_id long, page int, row int, text string")
    f = spark.createDataFrame([(1, 1, 2, "234"), (2, 1, 9, "1,234"), (3, 1, 9, "234"), (4, 1, 1, None)], "id long, doc_id long, page int, quote string")
    assert {r["id"]: r["row"] for r in documents.bind_source(f, rows).collect()} == {1: 2, 2: 1, 3: None, 4: None}


def test_claims():
    from galley.functions import claims

    assert claims.equivalent("4,918.2 billion yen", "en", "4,918,172 million yen", "en")
    assert not claims.equivalent("4,918.2 billion yen", "en", "4,918.2 million yen", "en") and not claims.equivalent("(24) yen", "en", "24 yen", "en") and not claims.equivalent("24 yen", "en", "24 usd", "en") and not claims.equivalent("none", "en", "none", "en")
    assert claims.equivalent("1,285.7 billion yen", "en", "1兆2,857億円", "ja")
    assert claims.ordered_subset("5 and 7", "en", "4, 5, 6 and 7", "en", extras=True) and not claims.ordered_subset("5 and 7", "en", "4, 5, 6 and 7", "en") and not claims.ordered_subset("7 and 5", "en", "5 and 7", "en") and not claims.ordered_subset("5 and 5", "en", "5", "en")
    assert claims.self_duplicate('use "X y" or "x  Y"') and not claims.self_duplicate('"X" or "Y"')
    assert claims.edit_conflicts("a b c d", "x b c d", "y b c d") and not claims.edit_conflicts("a b c d", "x b c d", "a b c y")
    for order in itertools.permutations(["net sales increased", "net sales increased sharply", "the net sales increased", "other"]):
        roots = dict(zip(order, claims.page_clusters(list(order)), strict=True))
        assert len(set(roots.values())) == 2 and roots["other"] != roots["net sales increased"]
