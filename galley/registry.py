"""Every query of the library outside the optional subpackages, with the SQL that gives the same rows."""

from __future__ import annotations

from galley.operators import alignment, amounts, answers, calibration, checks, claims, documents, evidence, findings, layout, layout_lines, masking, review, scoring, sections, sidecars, states, text, units
from galley.sources import ingest
from galley.streaming import pass_stats

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (layout_lines, layout, scoring, calibration, states, sections, alignment, text, findings, amounts, answers, documents, claims, checks, masking, review, units, sidecars, evidence, ingest, pass_stats):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
