"""Queries over statements made of order lines: sums, references, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..operators import canonical, reconcile, totals
from ..sources.store import settled
from . import inputs as I

_TOTAL_WIDE = ("policy", "insured", "eff", "gross", "rate", "comm")


def column_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.settled_rows(spark, sf_dir)
    stated = I.melt(I.view(spark, sf_dir, I.TOTALS, rows), _TOTAL_WIDE)
    return reconcile.column_checks(I.melt(rows), stated).select("stmt_id", "col_no", "label", "rows_total", "stated_total", "ok")


_OFF = "CASE WHEN cast(stmt_id AS bigint) % 13 = 0 AND row_no = 1 THEN '9.99' ELSE comm END AS comm"
_OFF_ROWS = f"SELECT stmt_id, row_no, policy, insured, eff, gross, rate, {_OFF} FROM ({I.STMT_ROWS}) r"


def rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = I.melt(I.view(spark, sf_dir, _OFF_ROWS))
    table = F.broadcast(canonical.template_table(spark))  # a fixed list
    columns = I.statements(spark, sf_dir).select("stmt_id", "template").join(table, "template").select("stmt_id", "base_col", "rate_col", "result_col")
    return reconcile.rate_check(cells, columns).select("stmt_id", "row_no", "base", "rate", "result", "message")


def _exported(stmts: DataFrame, rows: DataFrame) -> DataFrame:
    mapped = canonical.canonical_map(stmts.withColumn("columns", F.array(*[F.lit(c) for c in I.COLUMNS]))).select("stmt_id", F.col("mapping.`Commission Amount`").alias("commission_column"))
    return reconcile.exported_total(I.melt(rows), mapped.filter("commission_column IS NOT NULL"))


def exported_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.settled_rows(spark, sf_dir)
    return _exported(I.statements(spark, sf_dir, rows), rows).select("stmt_id", "commission_column", "exported_total")


def declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.declared_totals(I.view(spark, sf_dir, I.LINES, sums=I.settled_sums(spark, sf_dir)))
    amounts = F.array_join(F.transform("amounts", lambda a: S.format_amount(a)), " ")
    return found.select("stmt_id", "rank", "page_no", "line_no", "match_no", "label", amounts.alias("amounts"))


def payout(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The verdict on every statement, from its cells, its file name and its lines; lines: settled_rows()."""
    lines = I.settled_rows(spark, sf_dir) if lines is None else lines
    stmts = settled(I.statements(spark, sf_dir, lines).select("stmt_id", "filename", "template", "segment", "n_rows"), "statements")
    files = stmts.withColumn("filename_total", S.filename_amount(F.col("filename")))
    declared = reconcile.declared_totals(I.view(spark, sf_dir, I.LINES, sums=I.settled_sums(spark, sf_dir, lines)))
    chosen = reconcile.choose_reference(declared, files)
    rows = files.join(_exported(stmts, lines), "stmt_id", "left").join(chosen, "stmt_id", "left")
    return reconcile.payout_verdict(rows)


def choose_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payout(spark, sf_dir).select("stmt_id", "statement_label", "statement_total")


def payout_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array_join(F.transform("references", lambda r: F.concat(r["source"], F.lit(" "), S.format_amount(r["amount"]))), "; ")
    return payout(spark, sf_dir).select(
        "stmt_id", "filename", "exported_total", "filename_total", "statement_total", refs.alias("refs"), "references_disagree", "status", "ok"
    )


def verdict_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = payout(spark, sf_dir).withColumn("warnings", F.array(F.lit("No totals row.")))
    return reconcile.verdict_warnings(judged).select("stmt_id", F.array_join("warnings", " | ").alias("warnings"))


HEADERS = """
SELECT o_orderkey AS order_key, CASE o_orderkey % 7 WHEN 0 THEN 'Policy|Insured Name|Eff. Date|Gross|Comm%|Comm $'
  WHEN 1 THEN 'Policy Number|Client|Effective Date|Premium|Rate|Commission paid YTD|Commission paid this month'
  WHEN 2 THEN 'Cert #|Customer|Eff|Commissionable|%|Commission|Amount Paid' WHEN 3 THEN 'Name|Amount|Previous Paid|Prior Rate'
  WHEN 4 THEN 'Policy No|Named Insured|Written Premium|Gross Premium|Line Total' WHEN 5 THEN 'x|y' ELSE 'Base|Comm. Amt|Comm%|Comm %|Policy Eff' END AS header
FROM {orders}
"""


def infer_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, HEADERS).withColumn("columns", F.split("header", r"\|"))
    found = canonical.infer_canonical(rows.select("columns").distinct())
    # As many rows as there are distinct headers: Spark broadcasts them if they are few.
    return rows.join(found, "columns").select("order_key", "header", *[F.col(f"`{f}`").alias(f.lower().replace(" ", "_")) for f in config.CANONICAL_FIELDS])


def canonical_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, HEADERS).select(
        F.col("order_key").cast("string").alias("stmt_id"), F.split("header", r"\|").alias("columns"),
        F.when(F.col("order_key") % 7 == 0, "Vertigo Insurance").otherwise("x (auto-detected)").alias("template"),
    )
    mapped = canonical.canonical_map(rows)
    return mapped.select("stmt_id", "template", *[F.col(f"mapping.`{f}`").alias(f.lower().replace(" ", "_")) for f in config.CANONICAL_FIELDS])


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled, as the rules on totals look at the cells several times."""
    return settled(I.melt(I.view(spark, sf_dir, I.CLOSED_ROWS, I.settled_rows(spark, sf_dir)), _TOTAL_WIDE), "closed-cells")


def split_trailing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.split_trailing_total(_closed(spark, sf_dir))


def split_labelled_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.split_labelled_total(_closed(spark, sf_dir))


def pick_totals_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, I.TOTAL_ROWS, sums=I.settled_sums(spark, sf_dir))
    return totals.pick_totals_row(I.melt(rows, ("policy", "gross", "comm"), ("Policy", "Gross", "Comm $")))


QUERIES = {
    f.__name__: f
    for f in (
        column_checks, rate_check, exported_total, declared_totals, choose_reference, payout_verdict, verdict_warnings, infer_canonical,
        canonical_map, split_trailing_total, split_labelled_total, pick_totals_row,
    )
}


def _labels_sql() -> str:
    labels = ", ".join(f"({i}, '{p}')" for i, p in enumerate(config.DECLARED_LABELS))
    return f"labels(rank, p) AS (VALUES {labels})"


_AMT = r"\(?-?\$?\s?[\d,]+\.\d{2}\)?"
DECLARED = rf"""
{_labels_sql()},
lines AS ({I.plain(I.LINES)}),
m AS (SELECT stmt_id, page_no, line_no, text, rank, '(?i)(' || p || ')\s*:?\s*({_AMT})' AS re FROM lines, labels),
a AS (SELECT *, regexp_extract_all(text, re, 0) AS al, regexp_extract_all(text, re, 1) AS lb, regexp_extract_all(text, re, 2) AS am, regexp_split_to_array(text, re) AS bt
  FROM m WHERE regexp_matches(text, re)),
e AS (SELECT *, unnest(range(0, len(al)))::INTEGER AS match_no FROM a),
s AS (SELECT *, coalesce(list_sum(list_transform(bt[1 : match_no + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(al[1 : match_no], lambda x: length(x))), 0) AS st FROM e),
d AS (SELECT stmt_id, rank, page_no, line_no, match_no, trim(regexp_replace(lb[match_no + 1], '\s+', ' ', 'g')) AS label,
    text[greatest(1, st - 29)::BIGINT : st::BIGINT] AS prefix,
    list_filter(list_transform(regexp_extract_all(text[(st + length(al[match_no + 1]) - length(am[match_no + 1]) + 1)::BIGINT :], '{_AMT}', 0), lambda y: {I.sql_amount('y')}), lambda v: v IS NOT NULL) AS amounts
  FROM s),
declared AS (SELECT * FROM d WHERE len(amounts) > 0 AND NOT regexp_matches(prefix, '(?i){config.EXCLUDED_LABEL}') AND NOT regexp_matches(label, '(?i){config.EXCLUDED_LABEL}'))"""

PAYOUT = f"""{I.WITH},
{DECLARED},
f AS (SELECT stmt_id, filename, segment, n_rows, template, {I.sql_filename_amount('filename')} AS filename_total FROM statements),
x AS (SELECT stmt_id, 'Comm $' AS commission_column, round(sum(({I.sql_amount('comm')})::DECIMAL(18,4)), 2)::DOUBLE AS exported_total FROM stmt_rows GROUP BY stmt_id),
r AS (SELECT d.*, f.filename_total, len(list_filter(d.amounts, lambda v: abs(v - f.filename_total) < 0.01)) > 0 AS near FROM declared d JOIN f USING (stmt_id)),
c AS (SELECT stmt_id, first(label ORDER BY CASE WHEN near THEN 0 ELSE 1 END, rank, page_no, line_no, match_no) AS statement_label,
  first(CASE WHEN near THEN filename_total ELSE amounts[len(amounts)] END ORDER BY CASE WHEN near THEN 0 ELSE 1 END, rank, page_no, line_no, match_no) AS statement_total FROM r GROUP BY stmt_id),
p AS (SELECT f.*, x.commission_column, x.exported_total, c.statement_label, c.statement_total,
  coalesce(abs(filename_total - statement_total) >= 0.01, false) AS references_disagree,
  CASE WHEN exported_total IS NULL THEN 'no_amounts' WHEN filename_total IS NULL AND statement_total IS NULL THEN 'no_reference'
    WHEN coalesce(abs(exported_total - filename_total) < 0.01, true) AND coalesce(abs(exported_total - statement_total) < 0.01, true) THEN 'match' ELSE 'mismatch' END AS status
  FROM f LEFT JOIN x USING (stmt_id) LEFT JOIN c USING (stmt_id))"""

def _two(x: str) -> str:
    return "format('{:,.2f}', " + x + ")"


_CANON_CASE = {
    0: ("Policy", "Insured Name", "Eff. Date", "Gross", "Comm%", "Comm $"),
    1: ("Policy Number", "Client", "Effective Date", "Premium", "Rate", "Commission paid this month"),
    2: ("Cert #", "Customer", "Eff", "Commissionable", "%", "Amount Paid"),
    3: (None, "Name", None, None, None, "Amount"),
    4: ("Policy No", "Named Insured", None, "Gross Premium", None, "Line Total"),
    5: (None, None, None, None, None, None),
    6: (None, None, "Policy Eff", "Base", "Comm%", "Comm. Amt"),
}


def _case(i: int, vertigo: bool) -> str:
    shown = dict(_CANON_CASE)
    if vertigo:
        shown[0] = ("Policy Number", "Named Insured", "Policy Effective Date", "Total Commissionable", "Agency Commission Rate", "Total Commission Amount")
    name = config.CANONICAL_FIELDS[i].lower().replace(" ", "_")
    whens = " ".join(f"WHEN {k} THEN " + (f"'{v[i]}'" if v[i] else "NULL") for k, v in shown.items())
    return f"CASE order_key % 7 {whens} END AS {name}"


def _melted(wide, names=I.COLUMNS) -> str:
    return I.melt_sql("w", wide, names)


_NUM = I.sql_amount("value")
_CLOSED = f"""WITH w AS ({I.plain(I.CLOSED_ROWS)}), cells AS ({_melted(_TOTAL_WIDE)}),
c AS (SELECT *, {_NUM} AS num, max(row_no) OVER (PARTITION BY stmt_id) AS last_row FROM cells),
rf AS (SELECT stmt_id, row_no, last_row, count(*) FILTER (WHERE value <> '') AS filled, bool_or(regexp_matches(value, '(?i)\\b(sub)?totals?\\b')) AS says FROM c GROUP BY ALL),
g AS (SELECT stmt_id, last_row, max(filled) FILTER (WHERE row_no = last_row) AS lf, min(filled) FILTER (WHERE row_no < last_row) AS mf, bool_or(says AND row_no = last_row) AS says FROM rf GROUP BY ALL),
s AS (SELECT stmt_id, col_no, sum(num::DECIMAL(18,4)) FILTER (WHERE row_no < last_row)::DOUBLE AS above, max(num) FILTER (WHERE row_no = last_row) AS stated FROM c GROUP BY ALL),
j AS (SELECT stmt_id, count(*) AS n, bool_and(coalesce(abs(above - stated) <= 0.01, false)) AS ok FROM s WHERE stated IS NOT NULL GROUP BY stmt_id)"""

SQL = {
    "column_checks": f"""{I.WITH}, w AS ({I.plain(I.TOTALS)}), t AS ({_melted(_TOTAL_WIDE)}),
s AS (SELECT stmt_id, col_no, round(sum(num::DECIMAL(18,4)), 2)::DOUBLE AS rows_total FROM (SELECT *, {_NUM} AS num FROM cells) x WHERE num IS NOT NULL GROUP BY ALL),
y AS (SELECT stmt_id, col_no, col_name AS label, {_NUM} AS stated_total FROM t)
SELECT y.stmt_id, y.col_no, label, rows_total, stated_total, abs(rows_total - stated_total) < 0.01 AS ok FROM y JOIN s USING (stmt_id, col_no) WHERE stated_total IS NOT NULL""",
    "rate_check": f"""WITH w AS ({I.plain(_OFF_ROWS)}),
n AS (SELECT *, {I.sql_amount('gross')} AS base, ({I.sql_amount('rate')}) AS r, {I.sql_amount('comm')} AS result FROM w)
SELECT stmt_id, row_no, base, r AS rate, result, 'Row ' || policy || ': ' || base::VARCHAR || ' x ' || r::VARCHAR || '% = ' ||
  format('{{:.2f}}', base * r / 100)::DOUBLE::VARCHAR || ', but Comm $ says ' || result::VARCHAR AS message
FROM n WHERE abs(base * r / 100 - result) > 0.01""",
    "exported_total": f"{PAYOUT} SELECT stmt_id, commission_column, exported_total FROM x",
    "declared_totals": f"WITH {DECLARED} SELECT stmt_id, rank, page_no, line_no, match_no, label, array_to_string(list_transform(amounts, lambda v: {_two('v')}), ' ') AS amounts FROM declared",
    "choose_reference": f"{PAYOUT} SELECT stmt_id, statement_label, statement_total FROM p",
    "payout_verdict": f"""{PAYOUT} SELECT stmt_id, filename, exported_total, filename_total, statement_total,
  concat_ws('; ', 'filename ' || {_two('filename_total')}, statement_label || ' ' || {_two('statement_total')}) AS refs,
  references_disagree, status, status = 'match' AS ok FROM p""",
    "verdict_warnings": f"""{PAYOUT} SELECT stmt_id, concat_ws(' | ',
  CASE WHEN status = 'mismatch' THEN 'FAILSAFE: column ' || commission_column || ' exports ' || {_two('exported_total')} || ', but ' ||
    concat_ws(', ', 'filename says ' || {_two('filename_total')}, statement_label || ' says ' || {_two('statement_total')}) || '. Explain the difference before use.' END,
  CASE WHEN status = 'mismatch' AND references_disagree THEN 'The references disagree: ' || {_two('filename_total')} || ' and ' || {_two('statement_total')} || '.' END,
  'No totals row.',
  CASE WHEN status = 'no_reference' THEN 'Failsafe could not run: no declared total to hold the export against.'
    WHEN status = 'no_amounts' AND n_rows > 0 THEN 'Failsafe could not run: no commission column.' END) AS warnings FROM p""",
    "infer_canonical": f"SELECT order_key, header, {', '.join(_case(i, False) for i in range(6))} FROM ({I.plain(HEADERS)}) h",
    "canonical_map": f"""SELECT order_key::VARCHAR AS stmt_id, CASE WHEN order_key % 7 = 0 THEN 'Vertigo Insurance' ELSE 'x (auto-detected)' END AS template,
  {', '.join(_case(i, True) for i in range(6))} FROM ({I.plain(HEADERS)}) h""",
    "split_trailing_total": f"{_CLOSED} SELECT g.stmt_id, g.last_row AS total_row FROM g JOIN j USING (stmt_id) WHERE n >= 2 AND ok AND lf < mf",
    "split_labelled_total": f"""{_CLOSED} SELECT g.stmt_id, g.last_row AS total_row, CASE WHEN says THEN 'labelled' ELSE 'unlabelled' END AS detected
FROM g LEFT JOIN j USING (stmt_id) WHERE lf < mf AND (says OR (n >= 2 AND ok))""",
    "pick_totals_row": f"""WITH w AS ({I.plain(I.TOTAL_ROWS)}), n AS (SELECT stmt_id, row_no, {I.sql_amount('gross')} IS NOT NULL OR {I.sql_amount('comm')} IS NOT NULL AS num FROM w)
SELECT stmt_id, last(row_no ORDER BY num, row_no) AS row_no FROM n GROUP BY stmt_id""",
}
