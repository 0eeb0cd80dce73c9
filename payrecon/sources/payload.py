"""Statements as JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = (
    "filename string, template string, columns array<string>, rows array<map<string,string>>, totals map<string,string>, "
    "subtotals array<map<string,string>>, warnings array<string>, "
    "checks array<struct<label: string, rows_total: double, stated_total: double, ok: boolean>>, "
    "payout struct<exported_total: double, commission_column: string, filename_total: double, statement_total: double, statement_label: string, "
    "references: array<struct<source: string, amount: double>>, references_disagree: boolean, status: string, ok: boolean>, "
    "cleanup array<struct<column: string, action: string, detail: string>>, delimiter string"
)
_PAYOUT = ("exported_total", "commission_column", "filename_total", "statement_total", "statement_label", "references", "references_disagree", "status", "ok")
_OWN = ("filename", "template", "columns", "rows", "totals", "subtotals", "warnings", "checks", "cleanup", "delimiter")


def to_payload(statements: DataFrame) -> Column:
    """The statement's columns, as far as there are any, as one JSON text; the verdict is its `payout`."""
    payout = F.struct(*[c for c in _PAYOUT if c in statements.columns]).alias("payout")
    return F.to_json(F.struct(*[c for c in _OWN if c in statements.columns], payout))


def from_payload(payload: Column) -> Column:
    return F.from_json(payload, PAYLOAD)
