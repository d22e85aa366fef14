"""Queries on tables whose keys, groups or copies are larger than those of the given tables, against their SQL."""

import random

import duckdb
from pyspark.sql import functions as F

from galley import registry
from galley.functions.stretches import common_stretches
from galley.operators import alignment, documents, evidence
from galley.sources.tables import cut
from tests.test_queries import FOLDER, plain


def folder_with(top, **tables) -> str:
    """A folder of tables, each made by an SQL query that finds the given ones under their names."""
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        c.sql(f"COPY ({tables.get(t, f'SELECT * FROM {t}')}) TO '{top}/{t}.parquet' (FORMAT parquet)")
    return str(top)


def agrees(spark, folder: str, name: str) -> None:
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    mine, theirs = registry.QUERIES[name](spark, folder).toPandas(), c.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and len(theirs)
    assert plain(mine) == plain(theirs)


def test_visual_lines_of_large_part_keys(spark, tmp_path):
    """Keys of parts over 20,000 don't reach into the next supplier's place."""
    pieces = "SELECT * REPLACE (l_orderkey // 2 AS l_orderkey, l_linenumber % 3 AS l_linenumber, l_partkey * 9973 AS l_partkey) FROM lineitem"
    agrees(spark, folder_with(tmp_path, lineitem=pieces), "l01_visual_lines")


def test_chain_order_ends_with_its_longest_chain(spark, monkeypatch):
    """A cycle doesn't make rounds go on, each over all jobs: chains of 9 take 5 rounds, and one more shows that only the cycle is left."""
    rows = [(100 * c + k, 100 * c + k - 1 if k else None) for c in range(1, 120) for k in range(9)] + [(-1, -2), (-2, -3), (-3, -1), (-4, -1)]
    cuts = []
    monkeypatch.setattr(documents, "cut", lambda df: cuts.append(1) or cut(df))
    got = documents.chain_order(spark.createDataFrame(rows, "job_id long, parent long")).collect()
    assert {(r["job_id"], r["place"]) for r in got} == {(i, i % 100) for i, _ in rows if i > 0} and len(got) == 119 * 9
    assert len(cuts) <= 6


def test_edge_flags_of_copies_send_nothing_to_the_driver(spark, tmp_path):
    """Copies of a part score alike: the first three of a text are its references, and no side is broadcast."""
    folder = folder_with(tmp_path, part="SELECT * REPLACE (p_partkey + k * 1000000 AS p_partkey, p_size % 5 AS p_size) FROM part, range(4) r(k)")
    agrees(spark, folder, "l12_edge_flags")
    plan = registry.QUERIES["l12_edge_flags"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pages_by_words_and_neighbours_are_those_of_all_pairs(spark):
    """Documents joined by words and near pages have the edges of comparing all pages; where words are shared by all, pages are compared."""
    r = random.Random(4)
    page = lambda p, d: (d, p, " ".join(r.choices([f"w{k}" for k in range(3 if d == 1 else 400)], k=r.randint(1, 6))), r.choice(["heading", "heading paragraph", "table", "list footnote x"]))
    rows = lambda n: spark.createDataFrame([page(p, d) for d in (1, 2, 3) for p in range(n)], "doc_id long, page long, text string, roles string")
    targets, references = rows(30), rows(25)
    for least in (0.1, 0.2, 0.28):
        got = {tuple(x) for x in alignment.align_pages(targets, references, least).collect()}
        pairs = targets.alias("x").join(references.alias("y"), "doc_id")
        raw = 0.70 * alignment.similarity(F.col("x.text"), F.col("y.text")) + 0.18 * alignment.similarity(F.col("x.roles"), F.col("y.roles")) + alignment.page_bias(F.abs(F.col("x.page") - F.col("y.page")))
        by = {}
        for d, t, p, s in pairs.select("doc_id", F.col("x.page"), F.col("y.page"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).collect():
            if s >= least:
                by.setdefault((d, t), []).append((-s, p))
        want = set()
        for (d, t), found in by.items():
            found.sort()
            best = -found[0][0]
            ties = [x for x in found if best + x[0] <= 1e-9]
            near = [x for x in found if best + x[0] <= 0.10]
            kept = ties[:3] if len(ties) > 1 else near[:3] if best < 0.62 and len(near) > 1 else found[:1]
            want |= {(d, t, p) for _, p in kept}
        assert {x[:3] for x in got} == want and want


def test_known_cases_of_repeated_rows(spark):
    """Pairs stand once, though findings and cases are repeated and one finding stands under two documents."""
    cases = spark.createDataFrame([(1, 5, "Brand 12"), (1, 5, "brand 1"), (2, 5, "brand 12"), (2, 5, "brand 12"), (3, 6, "brand"), (4, 6, " "), (5, 6, None)], "case_id long, doc_id int, case_text string")
    f = spark.createDataFrame([(10, None, 5, "see BRAND 12 there"), (10, None, 5, "see BRAND 12 there"), (10, None, 6, "brand 1"), (11, 3, 5, "brand 12"), (12, None, 6, None), (10, 2, 5, ""), (13, 9, 5, "brand 12")], "id long, known_case_id long, doc_id int, text string")
    found = documents.known_cases(f, cases)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 10), (2, 10), (3, 10), (3, 11)]


def test_stretches_are_those_of_all_grams():
    """Every place where a quote and a text agree on so many characters lies in one stretch, which neither side extends."""
    r = random.Random(6)
    for _ in range(300):
        least, letters = r.randint(2, 6), "ab" if r.random() < 0.5 else "abcdé😀"
        text, quote = ("".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(2))
        grams = {(p - q, q) for p in range(len(text) - least + 1) for q in range(len(quote) - least + 1) if text[p : p + least] == quote[q : q + least]}
        want = {(s, q, next(h for h in range(q + 1, 99) if (s, h) not in grams) - 1 + least) for s, q in grams if (s, q - 1) not in grams}
        (found,) = common_stretches(text, [quote], least)
        assert len(found) == len(want) and set(found) == want


def test_fragments_move_texts_not_their_grams(spark, tmp_path):
    plan = registry.QUERIES["x24_unique_fragments"](spark, folder_with(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in plan


def test_repeated_findings_are_proven_once(spark, monkeypatch):
    """The proof of repeated texts is worked out once a worker, and texts without symbols are not restored."""
    seen, restored = [], evidence.restored_fragments
    monkeypatch.setattr(evidence, "restored_fragments", lambda texts, occurrences: seen.append(texts) or restored(texts, occurrences))
    f = [(k, 1, "number_mismatch", f"Sales were {'7' if k % 2 else '⟦#AAB⟧'} yen", "売上高は584 yen", "different", None) for k in range(40)]
    findings = spark.createDataFrame(f, "id long, job_id long, category string, quote string, reference string, reason string, suggestion string")
    known = spark.createDataFrame([(1, 1, "AAB", "584", "en", 584 * 10**6, 10**6, 0)], "job_id long, at long, symbol string, raw string, lang string, micro long, quantum long, power int")
    got = {r["id"]: (r["kept"], r["stage"], r["proof"]) for r in evidence.two_stage_import(findings, known).collect()}
    assert got == {k: (True, None, None) if k % 2 else (False, "restored", "equivalent") for k in range(40)}
    assert seen[0].count() == 20


def test_omissions_of_long_and_short_orders(spark, tmp_path):
    """Documents of few texts, compared beside one another, and of many, joined by words, in one table."""
    lines = "SELECT * REPLACE (CASE WHEN l_orderkey < 300 THEN l_orderkey // 100 * 3 + 1 ELSE l_orderkey END AS l_orderkey, CASE WHEN l_orderkey < 300 THEN CAST(10 * (l_orderkey % 100) + l_linenumber AS INT) ELSE l_linenumber END AS l_linenumber) FROM lineitem"
    folder = folder_with(tmp_path, lineitem=lines)
    agrees(spark, folder, "l11_item_omissions")
    agrees(spark, folder, "l11_footnote_omissions")
