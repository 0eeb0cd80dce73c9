"""Statement-like inputs derived from the test tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import settled

COLUMNS = ("Policy", "Insured Name", "Eff. Date", "Gross", "Comm%", "Comm $")

#: One row per order line, as the text a statement prints.
STMT_ROWS = """
SELECT cast(l_orderkey AS string) AS stmt_id,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS int) AS row_no,
  'PN' || lpad(cast(l_partkey AS string), 7, '0') AS policy,
  c_name AS insured,
  replace(substr(cast(l_shipdate AS string), 1, 10), '-', '') AS eff,
  cast(cast(l_extendedprice AS decimal(18,2)) AS string) AS gross,
  cast(cast(l_discount * 100 AS decimal(18,2)) AS string) || '%' AS rate,
  CASE WHEN l_returnflag = 'R' THEN '(' ELSE '' END ||
    cast(cast(round(cast(l_extendedprice AS decimal(18,2)) * cast(l_discount AS decimal(18,2)), 2) AS decimal(18,2)) AS string) ||
    CASE WHEN l_returnflag = 'R' THEN ')' ELSE '' END AS comm,
  cast(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END *
    round(cast(l_extendedprice AS decimal(18,2)) * cast(l_discount AS decimal(18,2)), 2) AS decimal(18,2)) AS comm_num
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
"""

#: One row per order. The amount in the file name is right, off by one, or missing.
STATEMENTS = f"""
SELECT cast(o_orderkey AS string) AS stmt_id, o_orderkey AS order_key, c_mktsegment AS segment,
  c_mktsegment || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ' ' || cast(cast(coalesce(total, 0) +
    CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS decimal(18,2)) AS string) END || '.pdf' AS filename,
  cast(coalesce(total, 0) AS decimal(18,2)) AS true_total, cast(coalesce(n, 0) AS bigint) AS n_rows,
  'Chris Leef General Agency' AS template
FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey
LEFT JOIN (SELECT stmt_id, sum(comm_num) AS total, count(*) AS n FROM ({STMT_ROWS}) r GROUP BY stmt_id) t
  ON t.stmt_id = cast(o_orderkey AS string)
"""

_WIDE = ("policy", "insured", "eff", "gross", "rate", "comm")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, rows: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """The rows of a query whose {names} are tables of the folder; `rows` stands for STMT_ROWS and `sums` for SUMS where
    they are given."""
    given = {}
    for name, made, text in (("sums", sums, SUMS), ("stmt_rows", rows, STMT_ROWS)):
        if made is not None and f"({text})" in sql:
            given[name], sql = made, sql.replace(f"({text})", f"{{{name}}}")
    return spark.sql(sql, **given, **{name: read(spark, sf_dir, name) for name in set(re.findall(r"\{(\w+)\}", sql)) - set(given)})


def plain(sql: str) -> str:
    """The same query for an engine that knows the tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def stmt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STMT_ROWS, whose partitions lie by `stmt_id`: orders meet their customers first, and lines are moved once."""
    lines, orders, customers = (read(spark, sf_dir, name) for name in ("lineitem", "orders", "customer"))
    buyers = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").cast("string").alias("stmt_id"), "c_name")
    printed = lines.withColumn("stmt_id", F.col("l_orderkey").cast("string")).join(buyers.hint("shuffle_hash"), "stmt_id")
    sql = STMT_ROWS.replace("cast(l_orderkey AS string) AS stmt_id", "stmt_id").replace("PARTITION BY l_orderkey", "PARTITION BY stmt_id")
    return spark.sql(f"{sql[: sql.index('FROM {lineitem}')]}FROM {{printed}}", printed=printed)


def settled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STMT_ROWS computed once, for queries that look at them several times."""
    return settled(stmt_rows(spark, sf_dir), "statement-rows", "stmt_id")


def settled_sums(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """SUMS computed once."""
    rows = stmt_rows(spark, sf_dir) if rows is None else rows
    return settled(view(spark, sf_dir, SUMS, rows), "sums", "stmt_id")


def statements(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return view(spark, sf_dir, STATEMENTS, rows)


def melt(rows: DataFrame, wide=_WIDE, names=COLUMNS) -> DataFrame:
    """Long cells `stmt_id, row_no, col_no, col_name, value` of wide rows: one narrow pass."""
    cells = F.array(*[F.struct(F.lit(i + 1).alias("col_no"), F.lit(n).alias("col_name"), F.col(c).alias("value")) for i, (c, n) in enumerate(zip(wide, names, strict=True))])
    return rows.select("stmt_id", "row_no", F.inline(cells))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return melt(stmt_rows(spark, sf_dir))


def melt_sql(source: str, wide=_WIDE, names=COLUMNS) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT stmt_id, row_no, {i + 1} AS col_no, '{n}' AS col_name, {c} AS value FROM {source}" for i, (c, n) in enumerate(zip(wide, names, strict=True))
    )


#: The derived tables as common table expressions.
WITH = f"WITH stmt_rows AS ({plain(STMT_ROWS)}),\nstatements AS ({plain(STATEMENTS)}),\ncells AS ({melt_sql('stmt_rows')})"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_amount(x: str) -> str:
    cell = sql_strip(x)
    bare = f"trim(regexp_replace(regexp_replace({cell}, '^[()]+|[()]+$', '', 'g'), '[,$%]', '', 'g'))"
    number = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
    return (
        f"(CASE WHEN regexp_matches({bare}, {number}) THEN CASE WHEN {cell} LIKE '(%' AND {cell} LIKE '%)' "
        f"THEN -try_cast({bare} AS DOUBLE) ELSE try_cast({bare} AS DOUBLE) END END)"
    )


def sql_mdy(x: str) -> str:
    cell = sql_strip(x)
    forms = (
        (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
        (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T].*)?$", (1, 2, 3)),
        (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})(?:[ T].*)?$", (3, 1, 2)),
    )
    whens = []
    for pattern, (y, m, d) in forms:
        part = lambda g: f"try_cast(regexp_extract({cell}, '{pattern}', {g}) AS INTEGER)"  # noqa: B023, E731
        year = part(y)
        if y == 3:
            year = f"(CASE WHEN {year} < 70 THEN {year} + 2000 WHEN {year} < 100 THEN {year} + 1900 ELSE {year} END)"
        whens.append(
            f"WHEN regexp_matches({cell}, '{pattern}') THEN CASE WHEN {part(m)} BETWEEN 1 AND 12 AND {part(d)} BETWEEN 1 AND 31 AND {year} BETWEEN 1900 AND 2200 "
            f"THEN lpad({part(m)}::VARCHAR, 2, '0') || '/' || lpad({part(d)}::VARCHAR, 2, '0') || '/' || lpad({year}::VARCHAR, 4, '0') END"
        )
    return f"(CASE WHEN {cell} = '' THEN '' {' '.join(whens)} END)"


def sql_filename_amount(x: str) -> str:
    stem = rf"regexp_replace(regexp_replace({x}, '\.[A-Za-z]+$', ''), '\s*\(\d+\)$', '')"
    pattern = r"'(-?)\s*([\d,]+\.\d{2})\s*$'"
    value = f"try_cast(replace(regexp_extract({stem}, {pattern}, 2), ',', '') AS DOUBLE)"
    return f"(CASE WHEN regexp_extract({stem}, {pattern}, 1) = '-' THEN -{value} ELSE {value} END)"


def sql_carrier(x: str) -> str:
    stem = rf"regexp_replace(regexp_replace(regexp_replace({x}, '\.[A-Za-z]+$', ''), '\s*\(\d+\)$', ''), '[\s_-]*-?\d[\d,]*\.\d{{2}}$', '')"
    return f"coalesce(nullif(trim({stem}, ' _-'), ''), {stem})"

#: Per statement its sums, as text and number; the stated commission is off by one on every seventh order.
SUMS = f"""
SELECT stmt_id, cast(stmt_id AS bigint) AS k, cast(count(*) AS int) AS n,
  cast(cast(sum(cast(gross AS decimal(18,2))) AS decimal(18,2)) AS string) AS gross,
  cast(cast(sum(comm_num) AS decimal(18,2)) AS string) AS comm,
  cast(cast(sum(comm_num) + CASE WHEN cast(stmt_id AS bigint) % 7 = 0 THEN 1 ELSE 0 END AS decimal(18,2)) AS string) AS stated
FROM ({STMT_ROWS}) r GROUP BY stmt_id
"""
TOTALS = f"SELECT stmt_id, n + 1 AS row_no, 'Totals' AS policy, '' AS insured, '' AS eff, gross, '' AS rate, stated AS comm FROM ({SUMS}) s"

#: Rows of which the last may be a total: labelled, by its sums alone, with wrong sums, none, or a look-alike.
CLOSED_ROWS = f"""
SELECT stmt_id, row_no, policy, insured, eff, gross, rate, comm FROM ({STMT_ROWS}) a
UNION ALL
SELECT stmt_id, n + 1, CASE k % 5 WHEN 0 THEN 'Totals' WHEN 4 THEN 'PN0000000' ELSE '100360 - Agency' END,
  CASE k % 5 WHEN 4 THEN 'Total Comfort Heating' ELSE '' END, CASE k % 5 WHEN 4 THEN '20240101' ELSE '' END, gross,
  CASE k % 5 WHEN 4 THEN '1.00%' ELSE '' END, CASE k % 5 WHEN 2 THEN stated || '1' ELSE stated END
FROM ({SUMS}) s WHERE k % 5 <> 3
"""
#: Several rows that say total: group totals, the total, and captions without figures.
TOTAL_ROWS = f"""
SELECT stmt_id, 1 AS row_no, 'Subtotal' AS policy, gross, comm FROM ({SUMS}) a
UNION ALL SELECT stmt_id, 2, 'Grand Total', CASE WHEN k % 3 = 0 THEN '' ELSE gross END, CASE WHEN k % 3 = 0 THEN 'n/a' ELSE comm END FROM ({SUMS}) b
UNION ALL SELECT stmt_id, 3, 'TOTAL COMMISSIONS PAID THIS PERIOD:', '', '' FROM ({SUMS}) c WHERE k % 2 = 0
"""
#: The text lines of statements: declared totals, and totals of other periods.
LINES = f"""
SELECT stmt_id, 1 AS page_no, 1 AS line_no, 'Statement of account ' || stmt_id AS text FROM ({SUMS}) a
UNION ALL SELECT stmt_id, 1, 2, CASE k % 6 WHEN 0 THEN 'Producer commissions total ' || gross || ' ' || comm
  WHEN 1 THEN 'PRIOR MONTH Check Total ' || comm || ' now Check  Total: ' || gross WHEN 2 THEN 'Check Total: $' || comm
  WHEN 3 THEN 'grand TOTAL (' || gross || ')' WHEN 4 THEN 'Premium ' || gross
  ELSE 'Net Amount 1.00 Total Commission Paid to Agency ' || comm || ' Total credit 2.50' END FROM ({SUMS}) b
UNION ALL SELECT stmt_id, 2, 1, 'YTD total payout ' || gross FROM ({SUMS}) c WHERE k % 4 = 0
UNION ALL SELECT stmt_id, 2, 2, 'Total amount due ' || stated FROM ({SUMS}) d WHERE k % 5 = 0
"""


def closed_rows(rows: DataFrame) -> DataFrame:
    """CLOSED_ROWS, made of each row where it lies: the last row comes with the first."""
    own, k = Window.partitionBy("stmt_id"), F.col("stmt_id").cast("bigint")
    told = rows.select(
        "*", F.count(F.lit(1)).over(own).cast("int").alias("n"), F.sum(F.col("gross").cast("decimal(18,2)")).over(own).cast("decimal(18,2)").cast("string").alias("all_gross"),
        (F.sum("comm_num").over(own) + F.when(k % 7 == 0, 1).otherwise(0)).cast("decimal(18,2)").cast("string").alias("stated"),
    )
    row = lambda *values: F.struct(*[v.alias(c) for v, c in zip(values, ("row_no", *_WIDE), strict=True)])
    alike = lambda text: F.when(k % 5 == 4, text).otherwise("")
    policy = F.when(k % 5 == 0, "Totals").when(k % 5 == 4, "PN0000000").otherwise("100360 - Agency")
    last = row(F.col("n") + 1, policy, alike("Total Comfort Heating"), alike("20240101"), F.col("all_gross"), alike("1.00%"), F.when(k % 5 == 2, F.concat("stated", F.lit("1"))).otherwise(F.col("stated")))
    it = row(*map(F.col, ("row_no", *_WIDE)))
    return told.select("stmt_id", F.inline(F.when((F.col("row_no") == 1) & (k % 5 != 3), F.array(it, last)).otherwise(F.array(it))))
