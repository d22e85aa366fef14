"""Numeric proofs and page-wise merging of findings in DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from galley.functions import claimed, claims
from galley.operators.cases import case_rows, case_sql
from galley.operators.checks import fiscal_label_only, fiscal_relation
from galley.operators.findings import NUMERIC, TRANSLATED, direction_conflict
from galley.sources.tables import read


#: Different rows whose results a task remembers.
REPEATED = 4096


def applied(rows: DataFrame, function: Callable, columns: list[str], name: str, kind: str, id: str = "id", repeats: bool = False) -> DataFrame:
    """(id, name): a plain function of the columns of each row, in Arrow batches. kind is the result's type; if rows repeat, a task remembers results of plain values."""
    schema = f"{id} long, {name} {kind}"
    made = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        of = lru_cache(REPEATED)(function) if repeats else function
        for b in batches:
            out = [of(*row) for row in zip(*(b.column(k).to_pylist() for k in range(1, len(columns) + 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, arrow.field(1).type)], schema=arrow)

    return rows.select(F.col(id).cast("long").alias(id), *columns).mapInArrow(run, schema)


def with_proof(findings: DataFrame) -> DataFrame:
    """(id, proof) of findings (id, category, quote, reference, reason, suggestion, summary, incompatible, uncertain, bound); proof is null for what must stay.

    Vetoes before any proof: the quotes go in opposite directions, the masked symbols were of different amounts
    (incompatible), a side's scale could not be read (uncertain), or the quotes, bound to one row of their sources each
    (bound), are of different fiscal years.
    """

    def proof(veto, fiscal, bound, category, quote, reference, reason, suggestion, summary):
        if veto:
            return None
        texts = [t for t in (reason, summary, suggestion) if t]
        numeric = claimed.numeric_claim(category, quote, reference, texts, NUMERIC, TRANSLATED)
        return claims.conclusive_false_positive(numeric, quote, reference, reason, suggestion, summary, fiscal, bound)

    has = set(findings.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False)
    veto = direction_conflict(F.col("quote"), F.col("reference")) | flag("incompatible") | flag("uncertain")
    veto = veto | (flag("bound") & (fiscal_relation(F.col("quote"), F.col("reference")) == "conflict"))
    fiscal = fiscal_label_only(F.col("category"), F.col("quote"), F.concat_ws(" ", "suggestion", "reason"), F.col("reference"))
    tidy = findings.select("id", veto.alias("veto"), fiscal.alias("fiscal"), flag("bound").alias("bound"), "category", "quote", "reference", "reason", "suggestion", (F.col("summary") if "summary" in has else F.lit(None).cast("string")).alias("summary"))
    return applied(tidy, proof, ["veto", "fiscal", "bound", "category", "quote", "reference", "reason", "suggestion", "summary"], "proof", "string", repeats=True)


def merge_on_page(findings: DataFrame) -> DataFrame:
    """findings (id, page_key, quote, excluded, verified, confidence) with the finding that speaks for their cluster (keep_id).

    Clusters hold quotes that are equal or contained in one another; the best one is not excluded, verified against the
    reference, most confident, then has the smallest id, so the order of rows does not matter. Pages stream in order
    through a task, one at a time.
    """
    names, types = ["id", "keep_id", "size"], [pa.int64(), pa.int64(), pa.int64()]

    def merged(rows: list[tuple]) -> pa.RecordBatch:
        roots = claims.page_clusters([r[1] for r in rows])
        best: dict[int, tuple] = {}
        size: dict[int, int] = {}
        for root, (key, _, excluded, verified, confidence) in zip(roots, rows, strict=True):
            rank = (excluded, not verified, -confidence, key)
            best[root] = min(best.get(root, rank), rank)
            size[root] = size.get(root, 0) + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([r[0] for r in rows], [best[k][3] for k in roots], [size[k] for k in roots]), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = None, []
        for b in batches:
            for key, *row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if held and key != page:
                    yield merged(held)
                    held = []
                page = key
                held.append(tuple(row))
        if held:
            yield merged(held)

    tidy = findings.select(F.col("page_key").cast("string").alias("page_key"), F.col("id").cast("long").alias("id"), F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("excluded", F.lit(False)).alias("excluded"), F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    return tidy.repartition("page_key").sortWithinPartitions("page_key", "quote", "id").mapInArrow(run, "id long, keep_id long, size long")


# Orders stand for findings with known outcomes.

M = "number_mismatch"
PROOFS = (
    (M, "Sales were 4,918.2 billion yen", "売上高は4,918,172百万円", "値が異なる", "見直す", False, False, "equivalent"), (M, "Sales were 4,918.2 billion yen", "売上高は4,918,172千円", "値が異なる", "見直す", False, False, None),
    (M, "Sales were up 5.2%", "売上高は5.2%減", "different", "fix", False, False, None), (M, "Net income was 579", "純損失は579", "different", "fix", False, False, None), (M, "Sales were up 5.2%", "売上高は5.2%増", "different", "fix", False, False, "equivalent"),
    ("date_mismatch", "compared to FY March 2014", "2013年度比", "年度が異なる", "fix", False, False, "fiscal_label"), ("date_mismatch", "compared to FY March 2014", "2014年度比", "年度が異なる", "fix", False, False, None),
    (M, "Sales were 584", "売上高は584", "different", "fix", True, False, None), (M, "Sales were 584", "売上高は584", "different", "fix", False, True, None), ("typo", "Sales were 584", "売上高は584", "different", "fix", False, False, None),
    ("typo", "the term", None, None, 'use "That" or "that"', False, False, "self_duplicate"), ("typo", "the term", None, None, 'delete "not" or move "not"', False, False, None),
    (M, "loss of (579)", "損失△579", "TARGET (579) と REF △579 は不一致", "fix", False, False, "same_value"), (M, "loss of (579)", "損失△580", "TARGET (579) と REF △579 は不一致", "fix", False, False, None),
    ("mistranslation", "cost of (579)", "費用△579", "英語版の「(579)」と日本語版の「△579」を整合させる", "fix", False, False, "same_value"), ("mistranslation", "cost of 578", "費用579", "「578」と「579」は異なる", "fix", False, False, None),
    (M, "Sales were 7", "sales 7, cost 55", "different", "fix", False, False, None), (M, "", "売上高は584", None, None, False, False, None), (None, None, None, None, None, None, None, None),
)
CLAIMS = (
    (M, None, None, None, True), ("Accounting_Inconsistency", "x", "y", None, True), ("mistranslation", "cost of 579", "費用579", "「579」と「579」は異なる", True), ("mistranslation", "cost", "費用579", "「579」と「579」は異なる", False),
    ("mistranslation", "cost of 579", "費用579", "訳語が異なる", False), ("translation_consistency", "in FY2024", "2024年度", "「579」と「579」", False), ("typo", "579", "579", "「579」と「579」", False), (None, None, None, None, False),
)
DUPLICATES = (
    ('use "X y" or "x  Y"', True), ('"X" or "Y"', False), ("「売上高」または「売上高」に統一する", True), ('Delete "not" or move "not" before the verb', False), ('"X"', False), ("「A」を削除または「A」を削除する", True),
    ("use X or X", False), (None, False), ('"Ａ" or "A"', True), ("「売上高」もしくは「営業利益」", False),
)
IDENTICAL = (
    ("要約の584と表の584のどちらが正しいか", None, None, False, True), ("要約の584と表の585のどちらが正しいか", None, None, False, False), ("要約の584億円と表の584", None, None, False, False), ("要約の584億円と表の584", None, None, True, True),
    ("「(579)」を日本語版の「△579」と照合", None, None, False, True), ("USA 413、Japan 307、USA 413、Japan 307", None, None, False, True), ("584と584", "584 and 12", "584と13", False, False), ("584と584", "584 and 12", "584と12", False, True),
    ("値を確認", None, None, False, False), ("5 million and 5,000,000 yen differ", None, None, False, True), ("FY2024と2023年度", None, None, False, False), (None, None, None, False, False),
)
VECTORS = (
    ("584 and 12", "584と12", False), ("584 and 12", "584と13", True), ("584 and 12", "12と584", False), ("584", "584と12", True), ("no value", "584", False), ("(579)", "△579", False), ("579", "△579", True), ("5 million", "500万", False),
    ("5%", "5%", False), ("5%", "5", False), ("584億円", "584", True), ("1.50", "1.5", False), ("⟦#ABC⟧", "⟦#ABC⟧", False), ("⟦#ABC⟧", "⟦#ABD⟧", True), (None, None, False),
)
LEXEMES = (
    ("P.26 143,459 137,450 (5.2)", "143,459;137,450;(5.2)"), ("△1,234.5 and 7", "△1,234.5;7"), ("page 3: 12", "12"), ("12 up", "12"), ("", ""), (None, ""), ("1234,567", "1234,567"), ("（45）と＋3", "（45）;＋3"),
)
PAIRED = (
    ("要約の584億円と表の「584」", "584/584/false"), ("「(579)」を日本語版の「△579」と照合", "-579/-579/true"), ("5 million and 5,000,000 yen", "5/5000000/true"), ("第1と第2", ""), ("⟦#ABC⟧ vs ⟦#ABC⟧", "//true"), (None, ""), ("2.50% and 2.5%", "2.5/2.5/true"),
)
EQUAL = (
    ("4,918.2 billion yen", "en", "4,918,172 million yen", "en", True), ("4,918.2 billion yen", "en", "4,918.2 million yen", "en", False), ("(24) yen", "en", "24 yen", "en", False), ("24 yen", "en", "24 usd", "en", False),
    ("none", "en", "none", "en", False), ("1,285.7 billion yen", "en", "1兆2,857億円", "ja", True), ("5 and 7", "en", "7 and 5", "en", False),
)
SUBSETS = (("5 and 7", "5 and 7 yen", False, True), ("5 and 7", "4, 5, 6 and 7", False, False), ("5 and 7", "4, 5, 6 and 7", True, True), ("7 and 5", "5 and 7", True, False), ("5 and 5", "5", True, False), ("5 yen", "5 usd", True, False), ("x", "5", True, False))
EDITS = (("a b c d", "x b c d", "y b c d", True), ("a b c d", "x b c d", "a b c y", False), ("a b c d", "a b d", "a x c d", False), ("a b", "a b", "x b", False))


def _case_query(cases: tuple, function: Callable, columns: str, name: str, kind: str) -> tuple[Callable, str]:
    """A query that applies the function to each order's case, and its SQL."""
    n = columns.count(",") + 1

    def query(spark: SparkSession, d: str) -> DataFrame:
        return applied(case_rows(spark, d, [c[:n] for c in cases], columns), function, [c.split()[0] for c in columns.split(", ")], name, kind)

    return query, case_sql([c[n] for c in cases], name)


def f17_numeric_proofs(spark: SparkSession, d: str) -> DataFrame:
    return with_proof(case_rows(spark, d, [c[:7] for c in PROOFS], "category string, quote string, reference string, reason string, suggestion string, incompatible boolean, uncertain boolean"))


CASE_QUERIES = {
    "f14_numeric_claims": _case_query(CLAIMS, lambda c, q, r, t: claimed.numeric_claim(c, q, r, [t or ""], NUMERIC, TRANSLATED), "category string, quote string, reference string, said string", "claim", "boolean"),
    "f16_same_value": _case_query(tuple((*c[1:4], c[7] == "same_value") for c in PROOFS if c[0] in NUMERIC + TRANSLATED), lambda q, r, t: claims.same_value_claim(q, r, t, [t or ""]), "quote string, reference string, reason string", "same", "boolean"),
    "f18_self_duplicate": _case_query(DUPLICATES, claims.self_duplicate, "suggestion string", "duplicate", "boolean"),
    "f19_ordered_subset": _case_query(SUBSETS, lambda q, r, extras: claims.ordered_subset(q, "en", r, "en", extras), "quote string, reference string, extras boolean", "subset", "boolean"),
    "f20_self_identical": _case_query(IDENTICAL, lambda t, q, r, u: claimed.self_identical(q, r, [t or ""], None, u), "said string, quote string, reference string, uncertain boolean", "identical", "boolean"),
    "u04_vectors_differ": _case_query(VECTORS, claimed.vectors_differ, "a string, b string", "differ", "boolean"),
    "x22_lexemes": _case_query(LEXEMES, lambda q: ";".join(x[0] for x in claimed.lexemes(q)), "quote string", "lexemes", "string"),
    "x23_claimed_pairs": _case_query(PAIRED, lambda t: ";".join(f"{a.key}/{b.key}/{str(same).lower()}" for a, b, same in claimed.pairs(t)), "said string", "pairs", "string"),
    "b05_edit_conflicts": _case_query(EDITS, claims.edit_conflicts, "quote string, a string, b string", "conflict", "boolean"),
    "b06_equivalent": _case_query(EQUAL, claims.equivalent, "a string, a_lang string, b string, b_lang string", "equal", "boolean"),
}


def b04_merge_findings(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_tax").alias("tax"))
    quote = F.when(F.col("flag") == "A", "net sales increased * strongly").when(F.col("flag") == "R", "Net sales increased").otherwise("short")
    f = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("page_key"), quote.alias("quote"), (F.col("tax") > 0.07).alias("excluded"), (F.col("tax") < 0.01).alias("verified"), F.lit(0.5).alias("confidence"))
    return merge_on_page(f)


QUERIES = {f.__name__: f for f in (f17_numeric_proofs, b04_merge_findings)} | {k: q for k, (q, _) in CASE_QUERIES.items()}

ORACLE_SQL = {k: sql for k, (_, sql) in CASE_QUERIES.items()} | {
    "f17_numeric_proofs": case_sql([c[7] for c in PROOFS], "proof"),
    "b04_merge_findings": """
WITH f AS (SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS id, CASE WHEN min(l_returnflag) = 'N' THEN 2 ELSE 1 END AS cluster, CASE WHEN max(l_tax) > 0.07 THEN 1 ELSE 0 END AS excluded, CASE WHEN max(l_tax) < 0.01 THEN 0 ELSE 1 END AS unverified FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT id, first_value(id) OVER (PARTITION BY page, cluster ORDER BY excluded, unverified, id) AS keep_id, count(*) OVER (PARTITION BY page, cluster) AS size FROM f
""",
}
