"""Queries over exports, reports and a history made of orders, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..operators import canonical, export, history, report
from . import inputs as I
from .reconcile_queries import PAYOUT, _two, payout

_FIELDS = [f.lower().replace(" ", "_") for f in config.CANONICAL_FIELDS]


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in I.COLUMNS])
    return canonical.canonical_map(I.statements(spark, sf_dir).select("stmt_id", "filename", "template").withColumn("columns", names))


def _all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.stmt_rows(spark, sf_dir)
    return export.all_rows(rows.select("stmt_id", "row_no"), I.melt(rows), _mapped(spark, sf_dir))


def all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_rows(spark, sf_dir).toDF("stmt_id", "row_no", "source", "carrier", *_FIELDS)


def typed_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = export.typed_all_rows(_all_rows(spark, sf_dir))
    return typed.select(
        "stmt_id", "row_no", F.col("`Policy Number`.kind").alias("policy_kind"), F.col("`Effective Date`.kind").alias("date_kind"),
        F.col("`Effective Date`.num").alias("date_num"), F.col("`Base Amount`.num").alias("base"), F.col("`Commission Rate`.num").alias("rate"),
        F.col("`Commission Rate`.fmt").alias("rate_fmt"), F.col("`Commission Amount`.num").alias("commission"),
    )


def statement_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = I.melt(I.view(spark, sf_dir, I.TOTALS))
    rows = I.view(spark, sf_dir, I.TOTAL_ROWS).filter("row_no = 1")
    subtotals = I.melt(rows, ("policy", "gross", "comm"), ("Policy", "Gross", "Comm $"))
    sheet = export.statement_sheet(I.cells(spark, sf_dir), subtotals, totals)
    return sheet.select("stmt_id", "section", "row_no", "col_no", "col_name", "cell.kind", "cell.num", "cell.text", "cell.fmt")


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = payout(spark, sf_dir)
    checks = judged.filter("exported_total IS NOT NULL").select(
        "stmt_id", F.lit(6).alias("ord"), F.lit("Comm $").alias("label"), F.col("exported_total").alias("rows_total"), F.coalesce("filename_total", F.lit(0.0)).alias("stated_total")
    )
    checks = checks.withColumn("ok", S.same_cent(F.col("rows_total"), F.col("stated_total")))
    warnings = judged.filter("n_rows = 0").select("stmt_id", F.lit(0).alias("ord"), F.lit("No data rows.").alias("warning"))
    return export.validation_report(judged, checks, warnings)


def guard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, blocked = export.split_failsafe(payout(spark, sf_dir))
    return ok.select("stmt_id", "filename", F.lit(False).alias("blocked")).union(blocked.select("stmt_id", "filename", F.lit(True)))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file for the reports: segment and nation make the carriers, some files went wrong."""
    k = F.col("stmt_id").cast("long")
    warn = S.first_true(
        (k % 37 == 0, F.lit("CRASH: ValueError: bad")), (k % 31 == 0, F.lit("an image-only scan")), (k % 29 == 0, F.lit("no table could be located")),
        (F.lit(True), F.lit("")),
    )
    stated = F.coalesce(F.when(F.col("statement_total") != 0, F.col("statement_total")), F.col("filename_total"))
    return payout(spark, sf_dir).select(
        "stmt_id", S.carrier_name(F.col("filename")).alias("carrier"), "filename",
        F.when(k % 3 == 0, "x (auto-detected)").when(k % 3 == 1, "x (delimited export)").otherwise(F.col("template")).alias("template"),
        F.col("n_rows").alias("rows"), F.when(F.col("n_rows") > 0, k % 3).otherwise(0).alias("checks"),
        F.when(F.col("n_rows") > 0, F.least(k % 3, k % 2)).otherwise(0).alias("passed"),
        F.col("status").alias("failsafe"), F.col("exported_total").alias("exported"), stated.alias("declared"), warn.alias("warn"),
    )


def outcome_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir)
    return rows.select("stmt_id", report.outcome_bucket(F.col("warn"), F.col("checks"), F.col("passed"), F.col("rows")).alias("bucket"))


def carrier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.carrier_report(_files(spark, sf_dir))


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage_summary(report.carrier_report(_files(spark, sf_dir)))


def failsafe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.failsafe_report(payout(spark, sf_dir))


def failsafe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.failsafe_counts(payout(spark, sf_dir))


#: Uploads: events with their time and user; every seventh has none, contents repeat.
HISTORY = """
SELECT 'e' || cast(event_id AS string) AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id,
  event_type || ' ' || cast(event_id % 100 AS string) || '.pdf' AS filename, CASE WHEN event_id % 50 = 0 THEN '' ELSE event_type END AS carrier,
  ts AS uploaded_at, cast(event_id % 40 AS int) AS row_count, CASE WHEN event_id % 4 = 0 THEN 'mismatch' WHEN event_id % 4 = 1 THEN 'no_amounts' ELSE 'match' END AS failsafe,
  value AS exported_total, CASE WHEN event_id % 10 = 0 THEN '' ELSE sha2(concat(event_type, cast(event_id % 300 AS string)), 256) END AS source_sha256
FROM {events}
"""
USERS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS display_name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment || '@x' END AS email FROM {customer}"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, HISTORY)


def with_uploader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_uploader(_history(spark, sf_dir), I.view(spark, sf_dir, USERS)).select("id", "user_id", "uploaded_by")


def changed_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(history, new rows): later and earlier versions of some of its rows, and rows of new ids."""
    old = _history(spark, sf_dir)
    again = old.filter("row_count < 8").withColumn("uploaded_at", F.expr("uploaded_at + INTERVAL 1 DAY")).withColumn("carrier", F.upper("carrier"))
    older = old.filter("row_count < 4").withColumn("carrier", F.lit("older"))
    brand_new = old.filter("row_count = 9").withColumn("id", F.concat(F.lit("n"), "id"))
    return old, again.unionByName(older).unionByName(brand_new)


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.upsert_statements(*changed_history(spark, sf_dir))
    return out.select("id", "carrier", F.col("uploaded_at").cast("string").alias("uploaded_at"), "row_count")


def duplicate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = history.with_uploader(_history(spark, sf_dir), I.view(spark, sf_dir, USERS))
    new = known.select("id", "source_sha256")
    found = history.duplicate_of(new, known)
    return found.select("id", F.col("duplicate.id").alias("first_id"), F.col("duplicate.filename").alias("first_file"), F.col("duplicate.uploaded_by").alias("first_by"))


def earlier_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: whose text an earlier one has."""
    docs = I.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"), F.col("doc_id").alias("uploaded_at")
    )
    return history.earlier_copies(docs)


def list_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a search, a top-k report."""
    page, _ = history.list_history(_history(spark, sf_dir), I.view(spark, sf_dir, USERS), limit=50, offset=100, search="CLICK 1", failsafe="match")
    return page.withColumn("uploaded_at", F.col("uploaded_at").cast("string"))


def history_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.list_history(_history(spark, sf_dir), I.view(spark, sf_dir, USERS), search="purch", since="2024-01-02 00:00:00")[1]


def recent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir)
    return history.recent_ids(rows, None, "2024-01-15 12:00:00").select("id").union(history.recent_ids(rows, 8, "2024-01-20 00:00:00", 96).select("id"))


def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir)
    return history.delete_statements(rows, rows.filter("failsafe = 'mismatch' AND row_count < 20")).select("id", "filename")


def distinct_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.distinct_carriers(_history(spark, sf_dir))


def select_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = I.view(spark, sf_dir, "SELECT 'e' || cast(c_custkey * 3 AS string) AS id, -c_custkey AS ord FROM {customer}")
    return history.select_statements(_history(spark, sf_dir), ids).select("id", "ord", "filename")


def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements to JSON payloads and back to the listing's columns."""
    from ..sources.payload import to_payload

    lines = I.settled_rows(spark, sf_dir)
    rows = lines.select("stmt_id", "row_no", F.create_map(F.lit("Policy"), "policy", F.lit("Comm $"), "comm").alias("row"))
    rows = rows.groupBy("stmt_id").agg(F.sort_array(F.collect_list(F.struct("row_no", F.col("row").cast("map<string,string>").getItem("Policy").alias("p"), F.col("row").getItem("Comm $").alias("c")))).alias("_r"))
    rows = rows.select("stmt_id", F.transform("_r", lambda r: F.create_map(F.lit("Policy"), r["p"], F.lit("Comm $"), r["c"])).alias("rows"))
    docs = payout(spark, sf_dir, lines).join(rows, "stmt_id", "left")
    return history.summary(docs.select(F.col("stmt_id").alias("id"), to_payload(docs).alias("payload")))


QUERIES = {
    f.__name__: f
    for f in (
        all_rows, typed_all_rows, statement_sheet, validation_report, guard_split, outcome_bucket, carrier_report, coverage_summary, failsafe_report,
        failsafe_counts, with_uploader, upsert, duplicate_of, earlier_copies, list_history, history_total, recent_ids, delete, distinct_carriers, select_statements, payload_round_trip,
    )
}

_H = f"WITH h AS ({I.plain(HISTORY).replace('sha2(concat(event_type, cast(event_id % 300 AS string)), 256)', 'sha256(concat(event_type, cast(event_id % 300 AS string)))')}), u AS (SELECT id, coalesce(nullif(display_name, ''), nullif(email, ''), '') AS name FROM ({I.plain(USERS)}) x)"
_FILES_SQL = f"""{PAYOUT},
fl AS (SELECT stmt_id, stmt_id::BIGINT AS k, {I.sql_carrier('filename')} AS carrier, filename,
  CASE stmt_id::BIGINT % 3 WHEN 0 THEN 'auto-detected' WHEN 1 THEN 'CSV/TSV cleaner' ELSE 'hand-written template' END AS parsed_by, n_rows AS rows,
  CASE WHEN n_rows > 0 THEN stmt_id::BIGINT % 3 ELSE 0 END AS checks, CASE WHEN n_rows > 0 THEN least(stmt_id::BIGINT % 3, stmt_id::BIGINT % 2) ELSE 0 END AS passed,
  status, exported_total AS exported, coalesce(nullif(statement_total, 0), filename_total) AS declared FROM p),
bk AS (SELECT *, CASE WHEN k % 37 = 0 THEN 'crash' WHEN k % 31 = 0 THEN 'needs-ocr' WHEN k % 29 = 0 THEN 'no-table'
  WHEN checks > 0 AND passed = checks THEN 'verified' WHEN rows > 0 THEN 'unverified' ELSE 'no-rows' END AS bucket FROM fl),
rk AS (SELECT *, count(*) OVER (PARTITION BY carrier) AS files, row_number() OVER (PARTITION BY carrier ORDER BY
  list_position(['verified','unverified','no-table','no-rows','needs-ocr','crash'], bucket), filename) AS rn FROM bk),
cr AS (SELECT carrier, bucket, CASE status WHEN 'match' THEN 'PASS' WHEN 'mismatch' THEN 'FAIL' ELSE 'n/a' END AS verdict, filename, exported, declared, rows,
  CASE WHEN checks > 0 THEN passed || '/' || checks ELSE '-' END AS checks, parsed_by, files FROM rk WHERE rn = 1)"""


def _typed_sql(value: str, header: str) -> dict[str, str]:
    number = I.sql_amount(value)
    return {
        "kind": f"CASE WHEN {number} IS NOT NULL THEN 'number' ELSE 'text' END",
        "num": f"CASE WHEN contains({value}, '%') THEN {number} / 100 ELSE {number} END",
        "text": f"CASE WHEN {number} IS NULL THEN {value} END",
        "fmt": f"CASE WHEN {number} IS NULL THEN NULL WHEN contains({value}, '%') THEN '0.00%' WHEN regexp_matches({header}, '(?i)%|percent|\\brate\\b') THEN '0.00' ELSE '#,##0.00' END",
    }


_T = _typed_sql("value", "col_name")
SQL = {
    "all_rows": f"""{I.WITH} SELECT r.stmt_id, row_no, filename AS source, template AS carrier, policy AS policy_number, insured AS insured_name, eff AS effective_date,
  gross AS base_amount, rate AS commission_rate, comm AS commission_amount FROM stmt_rows r JOIN statements USING (stmt_id)""",
    "typed_all_rows": f"""{I.WITH} SELECT stmt_id, row_no, 'text' AS policy_kind, 'number' AS date_kind, eff::DOUBLE AS date_num, gross::DOUBLE AS base,
  replace(rate, '%', '')::DOUBLE / 100 AS rate, '0.00%' AS rate_fmt, {I.sql_amount('comm')} AS commission FROM stmt_rows""",
    "statement_sheet": f"""{I.WITH}, w AS ({I.plain(I.TOTALS)}), v AS (SELECT * FROM ({I.plain(I.TOTAL_ROWS)}) x WHERE row_no = 1),
a AS (SELECT stmt_id, 0 AS section, row_no, col_no, col_name, value FROM cells
  UNION ALL SELECT stmt_id, 1, row_no, col_no, col_name, value FROM ({I.melt_sql('v', ('policy', 'gross', 'comm'), ('Policy', 'Gross', 'Comm $'))}) b
  UNION ALL SELECT stmt_id, 2, row_no, col_no, col_name, value FROM ({I.melt_sql('w')}) c)
SELECT stmt_id, section, row_no, col_no, col_name, {_T['kind']} AS kind, {_T['num']} AS num, {_T['text']} AS text, {_T['fmt']} AS fmt FROM a""",
    "validation_report": f"""{PAYOUT},
z AS (SELECT *, concat_ws('; ', 'filename: ' || {_two('filename_total')}, statement_label || ': ' || {_two('statement_total')}) AS refs,
  CASE status WHEN 'match' THEN 'FAILSAFE OK' WHEN 'mismatch' THEN 'FAILSAFE FAILED' ELSE 'FAILSAFE N/A' END AS v FROM p)
SELECT 0 AS section, stmt_id, 0 AS ord, filename AS source, template AS carrier, 'Exported ' || coalesce(commission_column, 'commission') || ' vs declared total' AS "check",
  exported_total AS rows_total, coalesce(nullif(statement_total, 0), filename_total) AS stated_total, CASE WHEN refs = '' THEN v ELSE v || ' (' || refs || ')' END AS status FROM z
UNION ALL SELECT 1, stmt_id, 6, filename, template, 'Comm $', exported_total, coalesce(filename_total, 0), CASE WHEN abs(exported_total - coalesce(filename_total, 0)) < 0.01 THEN 'OK' ELSE 'MISMATCH' END FROM p WHERE exported_total IS NOT NULL
UNION ALL SELECT 2, stmt_id, 0, filename, template, 'Warning', NULL, NULL, 'No data rows.' FROM p WHERE n_rows = 0""",
    "guard_split": f"{PAYOUT} SELECT stmt_id, filename, status = 'mismatch' AS blocked FROM p",
    "outcome_bucket": f"{_FILES_SQL} SELECT stmt_id, bucket FROM bk",
    "carrier_report": f"{_FILES_SQL} SELECT * FROM cr",
    "coverage_summary": f"""{_FILES_SQL}
SELECT 'carriers' AS measure, count(*)::BIGINT AS n FROM cr UNION ALL SELECT 'files', sum(files)::BIGINT FROM cr
UNION ALL SELECT b, (SELECT count(*) FROM cr WHERE bucket = b) FROM (SELECT unnest(['verified','unverified','no-table','no-rows','needs-ocr','crash']) AS b) x
UNION ALL SELECT b, (SELECT count(*) FROM cr WHERE verdict = b) FROM (SELECT unnest(['PASS','FAIL','n/a']) AS b) y""",
    "failsafe_report": f"{PAYOUT} SELECT filename, status, exported_total, commission_column, filename_total, statement_total, statement_label, references_disagree FROM p",
    "failsafe_counts": f"{PAYOUT} SELECT status, count(*)::BIGINT AS files FROM p GROUP BY status",
    "with_uploader": f"{_H} SELECT h.id, h.user_id, coalesce(name, '') AS uploaded_by FROM h LEFT JOIN u ON u.id = h.user_id",
    "upsert": f"""{_H} SELECT id, CASE WHEN row_count < 8 THEN upper(carrier) ELSE carrier END AS carrier,
  (CASE WHEN row_count < 8 THEN uploaded_at + INTERVAL 1 DAY ELSE uploaded_at END)::VARCHAR AS uploaded_at, row_count FROM h
UNION ALL SELECT 'n' || id, carrier, uploaded_at::VARCHAR, row_count FROM h WHERE row_count = 9""",
    "duplicate_of": f"""{_H}, n AS (SELECT h.*, coalesce(name, '') AS who FROM h LEFT JOIN u ON u.id = h.user_id),
f AS (SELECT source_sha256 AS s, first(id ORDER BY uploaded_at, id) AS first_id, first(filename ORDER BY uploaded_at, id) AS first_file, first(who ORDER BY uploaded_at, id) AS first_by FROM n WHERE source_sha256 <> '' GROUP BY 1)
SELECT n.id, first_id, first_file, first_by FROM n LEFT JOIN f ON f.s = n.source_sha256""",
    "earlier_copies": """WITH f AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first_id FROM documents)
SELECT id, first_id FROM f WHERE id <> first_id""",
    "list_history": f"""{_H} SELECT h.id, filename, carrier, uploaded_at::VARCHAR AS uploaded_at, row_count, failsafe, exported_total, coalesce(name, '') AS uploaded_by
FROM (SELECT * FROM h WHERE (filename ILIKE '%CLICK 1%' OR carrier ILIKE '%CLICK 1%') AND failsafe = 'match' ORDER BY uploaded_at DESC, id LIMIT 50 OFFSET 100) h LEFT JOIN u ON u.id = h.user_id""",
    "history_total": f"{_H} SELECT count(*)::BIGINT AS total FROM h WHERE (filename ILIKE '%purch%' OR carrier ILIKE '%purch%') AND uploaded_at >= TIMESTAMP '2024-01-02 00:00:00'",
    "recent_ids": f"""{_H} SELECT id FROM h WHERE user_id IS NULL AND uploaded_at >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR
UNION ALL SELECT id FROM h WHERE user_id = 8 AND uploaded_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 96 HOUR""",
    "delete": f"{_H} SELECT id, filename FROM h WHERE NOT (failsafe = 'mismatch' AND row_count < 20)",
    "distinct_carriers": f"{_H} SELECT DISTINCT carrier FROM h WHERE carrier <> ''",
    "select_statements": f"{_H} SELECT h.id, -c_custkey AS ord, filename FROM customer JOIN h ON h.id = 'e' || (c_custkey * 3)",
    "payload_round_trip": f"{PAYOUT} SELECT stmt_id AS id, filename, template AS carrier, n_rows::INTEGER AS row_count, status AS failsafe, exported_total FROM p",
}
