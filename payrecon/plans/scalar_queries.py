"""Queries over single cells and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .inputs import plain, sql_amount, sql_carrier, sql_filename_amount, sql_mdy, sql_strip, view

_KEY = "cast(l_orderkey AS bigint) AS order_key, cast(l_linenumber AS int) AS line_no"
_G = "cast(cast(l_extendedprice AS decimal(18,2)) AS string)"
_DAY = "substr(cast(l_shipdate AS string), 1, 10)"
_MDY_PARTS = f"substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 9, 2) || '/'"

AMOUNTS = f"""
SELECT {_KEY}, CASE l_partkey % 14 WHEN 0 THEN {_G} WHEN 1 THEN '(' || {_G} || ')' WHEN 2 THEN '$' || {_G}
  WHEN 3 THEN '  ' || {_G} || ' ' WHEN 4 THEN cast(cast(l_discount * 100 AS decimal(18,2)) AS string) || '%' WHEN 5 THEN '6/1/26'
  WHEN 6 THEN '12D' WHEN 7 THEN '(-5)' WHEN 8 THEN '$(' || {_G} || ')' WHEN 9 THEN '' WHEN 10 THEN '1,' || substr('000' || {_G}, -6)
  WHEN 11 THEN '1e3' WHEN 12 THEN '26-Jun' ELSE '( ' || {_G} || ' )' END AS text FROM {{lineitem}}
"""
DATES = f"""
SELECT {_KEY}, CASE l_partkey % 9 WHEN 0 THEN replace({_DAY}, '-', '') WHEN 1 THEN {_DAY} WHEN 2 THEN replace({_DAY}, '-', '/') || ' 14:30:00'
  WHEN 3 THEN {_MDY_PARTS} || substr({_DAY}, 1, 4) || ' 09:15' WHEN 4 THEN replace({_MDY_PARTS}, '/', '-') || substr({_DAY}, 3, 2)
  WHEN 5 THEN '20261332' WHEN 6 THEN '13/01/' || substr({_DAY}, 1, 4) WHEN 7 THEN ' ' ELSE '02/31/2026' END AS text FROM {{lineitem}}
"""
BROKEN = f"""
SELECT {_KEY}, CASE l_partkey % 5 WHEN 0 THEN '( ' || {_G} || ' )' WHEN 1 THEN '150.0 ' || cast(l_linenumber AS string)
  WHEN 2 THEN '  ' || {_G} WHEN 3 THEN '1 2 3.4 5' ELSE 'Policy (  Number ) 1 , 2' END AS text FROM {{lineitem}}
"""
FILES = """
SELECT o_orderkey AS order_key, CASE o_orderkey % 8 WHEN 0 THEN c_mktsegment || ' ' || a || '.PDF' WHEN 1 THEN c_mktsegment || ' -' || a || '.pdf'
  WHEN 2 THEN 'Big Sky ' || a || ' (1).PDF' WHEN 3 THEN 'agent_statement.csv' WHEN 4 THEN a || '.pdf' WHEN 5 THEN c_mktsegment || '_1,' || substr('000' || a, -6) || '.tsv'
  WHEN 6 THEN '__' || c_mktsegment || '--' ELSE '_-.pdf' END AS filename
FROM (SELECT o_orderkey, o_custkey, cast(cast(o_totalprice AS decimal(18,2)) AS string) AS a FROM {orders}) o JOIN {customer} ON c_custkey = o_custkey
"""
CELLS = f"""
SELECT {_KEY}, CASE l_partkey % 8 WHEN 0 THEN '5.00%' WHEN 1 THEN '05/26/26' WHEN 2 THEN {_MDY_PARTS} || substr({_DAY}, 1, 4) WHEN 3 THEN {_G}
  WHEN 4 THEN '02/30/2024' WHEN 5 THEN '(' || {_G} || ')' WHEN 6 THEN c.c_name ELSE '  ' END AS text,
  CASE l_suppkey % 4 WHEN 0 THEN 'Gross' WHEN 1 THEN 'Comm%' WHEN 2 THEN 'Rate' ELSE 'Operated' END AS header
FROM {{lineitem}} JOIN {{orders}} o ON o.o_orderkey = l_orderkey JOIN {{customer}} c ON c.c_custkey = o.o_custkey
"""


def to_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = view(spark, sf_dir, AMOUNTS)
    return texts.select("order_key", "line_no", "text", S.to_amount(F.col("text")).alias("amount"), S.is_percent(F.col("text")).alias("is_percent"))


def to_mdy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DATES).select("order_key", "line_no", "text", S.to_mdy(F.col("text")).alias("mdy"))


def repair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BROKEN).select("order_key", "line_no", "text", S.repair_text(F.col("text")).alias("repaired"))


def format_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, f"SELECT {_KEY}, l_extendedprice AS price, l_tax AS tax FROM {{lineitem}}")
    return rows.select("order_key", "line_no", S.format_amount(F.col("price")).alias("price"), S.format_amount(F.col("tax") * 100, 1).alias("tax"))


def filename_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FILES).select("order_key", "filename", S.filename_amount(F.col("filename")).alias("amount"))


def carrier_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FILES).select("order_key", "filename", S.carrier_name(F.col("filename")).alias("carrier"))


def typed_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = view(spark, sf_dir, CELLS).withColumn("t", S.typed_cell(F.col("text"), F.col("header")))
    return typed.select("order_key", "line_no", "header", "t.kind", "t.num", F.col("t.date").cast("string").alias("day"), F.col("t.text").alias("shown"), "t.fmt")


def label_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts of whole documents' lines are total rows, footers, markers or labels of other sums."""
    lines = view(spark, sf_dir, "SELECT doc_id, text FROM {documents}")
    lines = lines.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.col("line")
    return lines.select(
        "doc_id", "line_no", S.is_total_row(line).alias("total"), S.is_total_row(line, template=True).alias("template_total"),
        S.is_footer(line).alias("footer"), S.excluded_label(line).alias("excluded"), S.is_marker(line, ("THE.", "DER.")).alias("marker"),
    )


QUERIES = {
    f.__name__: f
    for f in (to_amount, to_mdy, repair_text, format_amount, filename_amount, carrier_name, typed_cell, label_filters)
}

_A = sql_amount("text")
SQL = {
    "to_amount": f"SELECT order_key, line_no, text, {_A} AS amount, contains(text, '%') AS is_percent FROM ({plain(AMOUNTS)}) t",
    "to_mdy": f"SELECT order_key, line_no, text, {sql_mdy('text')} AS mdy FROM ({plain(DATES)}) t",
    "repair_text": "SELECT order_key, line_no, text, "
    + sql_strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\(\s*(.*?)\s*\)', '(\1)', 'g'), '([0-9.,])\s+([0-9.,])', '\1\2', 'g'), '([0-9.,])\s+([0-9.,])', '\1\2', 'g')")
    + f" AS repaired FROM ({plain(BROKEN)}) t",
    "format_amount": f"SELECT {_KEY}, format('{{:,.2f}}', l_extendedprice) AS price, format('{{:,.1f}}', l_tax * 100) AS tax FROM lineitem",
    "filename_amount": f"SELECT order_key, filename, {sql_filename_amount('filename')} AS amount FROM ({plain(FILES)}) t",
    "carrier_name": f"SELECT order_key, filename, {sql_carrier('filename')} AS carrier FROM ({plain(FILES)}) t",
    "typed_cell": rf"""
WITH t AS (SELECT *, trim(text) AS s, regexp_matches(trim(text), '^\d{{2}}/\d{{2}}/\d{{4}}$') AS dated FROM ({plain(CELLS)}) c),
u AS (SELECT *, CASE WHEN dated THEN try_strptime(s, '%m/%d/%Y')::DATE END AS d, CASE WHEN NOT dated THEN {_A} END AS n FROM t)
SELECT order_key, line_no, header, CASE WHEN d IS NOT NULL THEN 'date' WHEN n IS NOT NULL THEN 'number' ELSE 'text' END AS kind,
  CASE WHEN contains(s, '%') THEN n / 100 ELSE n END AS num, d::VARCHAR AS day,
  CASE WHEN d IS NULL AND n IS NULL THEN CASE WHEN dated THEN s ELSE text END END AS shown,
  CASE WHEN d IS NOT NULL THEN 'mm/dd/yyyy' WHEN n IS NULL THEN NULL WHEN contains(s, '%') THEN '0.00%'
    WHEN regexp_matches(header, '(?i)%|percent|\brate\b') THEN '0.00' ELSE '#,##0.00' END AS fmt
FROM u""",
    "label_filters": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
e AS (SELECT doc_id, unnest(range(0, len(x)))::INTEGER AS line_no, unnest(x) AS line FROM l)
SELECT doc_id, line_no, regexp_matches(line, '(?i)\b(?:sub)?totals?\b') AS total, regexp_matches(line, '(?i)\btotals?\b') AS template_total,
  regexp_matches(line, '(?i)page\s*\d+\s*of\s*\d+|print(ed)?\s*date|\S+@\S+\.\S+|confidential|www\.|\d{3}[- ]\d{3}[- ]\d{4}') AS footer,
  regexp_matches(line, '(?i)prior|previous|opening|received|minimum|ytd|year\s*to\s*date|written\s*premium|balance\s*forward|sub\s*total|subtotal') AS excluded,
  upper(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) IN ('THE.', 'DER.') AS marker
FROM e""",
}
