"""Numbered headings and claims of missing items, row by row."""

import pytest
from pyspark.sql import functions as F

from galley.operators import review, text

HEADINGS = [
    ("1. Net sales", ("1.", "Net sales")), ("1 Sales 5", None), ("I think that it rose", None), ("3.5 million shares were issued", None), ("3. 5 million shares", ("3.", "5 million shares")), ("（1）売上高", ("（1）", "売上高")), ("第1章 概要です", ("第1章", "概要です")),
    ("IV) The outlook", ("IV)", "The outlook")), ("Ⅱ．見通しは", ("Ⅱ．", "見通しは")), ("- 1. item one", None), ("2: ⟦#AB⟧ to ⟦#CD⟧ here", None), ("2: ⟦#AB⟧ to the end", ("2:", "⟦#AB⟧ to the end")), ("1. Sales 1 2 3", None), ("1. Sales 1 2", ("1.", "Sales 1 2")), ("1.2.3.4. Deep one", ("1.2.3.4.", "Deep one")),
    ("1. ab", None), ("1. " + "x" * 241, None), ("　2.　Wide", ("2.", "Wide")), ("", None), (None, None),
]


def test_numbered_headings(spark):
    rows = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(HEADINGS)], "k int, line string").select("k", text.numbered_heading(F.col("line")).alias("h")).orderBy("k").collect()
    assert [tuple(r["h"]) if r["h"] else None for r in rows] == [want for _, want in HEADINGS]


FINDING, LINE = "id long, doc_id long, page long, quote string, issue string, reason string, suggestion string, text string", "doc_id long, page long, line string, id long"
BODY = "Notes on the going concern assumption"


@pytest.mark.parametrize(
    ("quote", "issue", "reason", "line", "dropped"),
    [
        (BODY, "Missing item 3", None, f"3. {BODY}", True),
        (BODY, "Item 3 is missing", None, f"(3) {BODY.upper()}!", True),
        (BODY, "Missing item 3", None, "3. Some unrelated matters here", False),
        (None, "Missing item 3", None, f"3. {BODY}", False),
        (None, "項番３が欠落しています", f"「{BODY}」とある", f"（３）{BODY}", True),
        ("going concern", "skipped 3", None, f"3: {BODY}", True),
        ("short", "skipped 3", None, "3: short", False),
        (BODY, "Missing item 4", None, f"3. {BODY}", False),
        (BODY, "It is wrong", None, f"3. {BODY}", False),
        (BODY, "Missing item 3", None, None, False),
    ],
)
def test_contradicted_missing(spark, quote, issue, reason, line, dropped):
    f = spark.createDataFrame([(7, 1, 1, quote, issue, reason, None, "x")], FINDING)
    lines = spark.createDataFrame([(1, 1, line, 5), (1, 2, f"3. {BODY}", 6), (2, 1, f"3. {BODY}", 6)], LINE)
    assert [r["id"] for r in review.contradicted_missing(f, lines).collect()] == [7] * dropped
