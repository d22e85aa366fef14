"""Answers in DataFrames: turn completion, objects, repair, schema, choice of the answer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import answers
from galley.operators.cases import case_rows, case_sql
from galley.operators.claims import applied
from galley.sources.tables import read

def object_rows(texts: DataFrame) -> DataFrame:
    """(id, ordinal, object): every outermost balanced object of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, x in enumerate(answers.balanced_objects(t or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["id", "ordinal", "object"])

    return texts.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, ordinal int, object string")


def repaired(texts: DataFrame) -> DataFrame:
    """(id, json, fixes) of texts (id, text); json is null where nothing helps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [answers.repair_json(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))], ["id", "json", "fixes"])

    return texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, json string, fixes array<string>")


def picked(texts: DataFrame) -> DataFrame:
    """(id, answer, fixes, findings) of texts (id, text, packet_id, expected: pages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [answers.pick_answer(t or "", p, e or []) for t, p, e in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            n = [len(json.loads(x)["findings"]) if x else None for x, _ in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array(n, pa.int64())], ["id", "answer", "fixes", "findings"])

    return texts.select(F.col("id").cast("long").alias("id"), "text", "packet_id", F.col("expected").cast("array<int>").alias("expected")).mapInArrow(run, "id long, answer string, fixes array<string>, findings long")


# Events stand for answers: their properties are JSON; some are cut or have a comma too many.


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    body = F.concat(F.lit('{"packet_id": "p", "checked_pages": [1, 2], "findings": [{"page": 1, "value": '), F.round("value", 2).cast("string"), F.lit("}"))
    text = F.when(F.col("value") > 75, F.concat(body, F.lit(",]}"))).when(F.col("value") > 50, body).otherwise(F.concat(F.lit("so: {} and "), body, F.lit("]} done")))
    return e.select(F.col("event_id").alias("id"), text.alias("text"), F.lit("p").alias("packet_id"), F.array(F.lit(1), F.lit(2)).alias("expected"), "value")


TURNS = (
    ('{"a": 1} <<END>>', "complete"), ('{"a": 1}<<END>>  ', "complete"), ('```json\n{"a": "}"}\n```\n<<END>>', "complete"), ('{"a": "<<END>>"}', "waiting"), ('{"a": 1} x<<END>>', "waiting"), ('{"a": 1', "waiting"),
    ('{"a": 1 <<END>>', "marked"), ("<<END>>", "marked"), ("so [1] <<END>>", "marked"), ('{a: 1} <<END>>', "marked"), ('see {"a": {"b": "{"}} and <<END>>', "complete"), (None, "waiting"), ("", "waiting"),
)
OBJECTS = (
    ('x {"a": "}"} y {} {"b": {"c": 1}}', '{"a": "}"}|{}|{"b": {"c": 1}}'), ('{ open {"a": 1} and {"b": 2}', '{"a": 1}|{"b": 2}'), ('{"a": "unclosed {"b": 1}', '{"b": 1}'), ('{{{"a": 1}', '{"a": 1}'), ('{"a": "x\\"}"}', '{"a": "x\\"}"}'),
    ("none", ""), (None, ""), ("}{}", "{}"), ('{"a": {"b": 1}', '{"b": 1}'),
)
SCHEMAS = (
    ('{"packet_id": "p", "findings": [], "checked_pages": [1, 2]}', ""), ('{"packet_id": "q", "findings": []}', "packet_id"), ('{"findings": {}, "checked_pages": [3]}', "findings,pages"), ("[]", "not_an_object"), ('{"findings": [1]}', "findings"),
    ('{"findings": [], "pages_checked": [true]}', "pages"), ('{"findings": [], "checked_pages": ["1"]}', "pages"),
)


def x28_turn_state(spark, d):
    return applied(case_rows(spark, d, [c[:1] for c in TURNS], "text string"), lambda t: answers.turn_completion(t, "<<END>>"), ["text"], "state", "string")


def x29_balanced(spark, d):
    return applied(case_rows(spark, d, [c[:1] for c in OBJECTS], "text string"), lambda t: "|".join(answers.balanced_objects(t or "")), ["text"], "objects", "string")


def x31_schema(spark, d):
    return applied(case_rows(spark, d, [c[:1] for c in SCHEMAS], "text string"), lambda t: ",".join(answers.check_answer(json.loads(t), "p", [1, 2])), ["text"], "wrong", "string")


def x29_objects(spark, d):
    return object_rows(_answers(spark, d)).groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))


def x30_repair(spark, d):
    fixed = repaired(_answers(spark, d).withColumn("text", F.regexp_replace("text", r"^so: \{\} and | done$", "")))
    return fixed.select(F.array_join("fixes", ",").alias("fixes"), F.get_json_object("json", "$.findings[0].page").alias("page")).groupBy("fixes", "page").agg(F.count(F.lit(1)).alias("n"))


def x32_pick(spark, d):
    return picked(_answers(spark, d)).select(F.array_join("fixes", ",").alias("fixes"), "findings").groupBy("fixes", "findings").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (x28_turn_state, x29_balanced, x31_schema, x29_objects, x30_repair, x32_pick)}

ORACLE_SQL = {
    "x28_turn_state": case_sql([c[1] for c in TURNS], "state"),
    "x29_balanced": case_sql([c[1] for c in OBJECTS], "objects"),
    "x31_schema": case_sql([c[1] for c in SCHEMAS], "wrong"),
    "x29_objects": "SELECT CAST(0 AS INT) AS ordinal, count(*) AS n FROM events UNION ALL SELECT 1, count(*) FROM events WHERE value <= 50",
    "x30_repair": "SELECT CASE WHEN value > 75 THEN 'trailing_comma' WHEN value > 50 THEN 'truncated_tail' ELSE '' END AS fixes, '1' AS page, count(*) AS n FROM events GROUP BY 1",
    "x32_pick": "SELECT CASE WHEN value > 75 THEN 'trailing_comma' WHEN value > 50 THEN 'truncated_tail' ELSE '' END AS fixes, 1 AS findings, count(*) AS n FROM events GROUP BY 1",
}
