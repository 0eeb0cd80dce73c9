"""Queries over word boxes laid out from order lines, and over readings made of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import canonical, layout, ocr
from ..sources.store import settled
from . import inputs as I
from .statements import read_word_statements

#: (text, x0, x1) of each word of a data line; header words have a line of their own.
_DATA = (("policy", 10, 58), ("insured", 70, 150), ("eff", 170, 210), ("gross", 225, 262), ("rate", 284, 306), ("comm", 328, 360))
_HEAD = (
    ("Policy", 10, 40, 0), ("Number", 10, 50, 1), ("Insured", 70, 110, 0), ("Name", 70, 95, 1), ("Eff.", 170, 190, 0), ("Date", 170, 192, 1),
    ("Gross", 230, 260, 0), ("Comm%", 280, 312, 0), ("Comm", 330, 352, 0), ("$", 353, 358, 0), ("Invoice", 380, 420, 0),
)
_LETTER = (("Acme", 10, 120), ("General", 122, 250), ("Agency", 255, 300), ("Statement", 305, 420))


def _boxes() -> str:
    """Word boxes by (line base, x): letterhead, a header of two lines (near, or nine points apart), rows, total."""
    parts = [
        f"SELECT stmt_id, k, 0 AS line, {i} AS w, '{t}' AS text, {a}.0 AS lo, {b}.0 AS hi, -400.0 AS base FROM ({I.SUMS}) s{i}" for i, (t, a, b) in enumerate(_LETTER)
    ]
    parts += [
        f"SELECT stmt_id, k, {1 + second}, {100 + i}, '{t}', {a}.0, {b}.0, 20.0 + {second} * CASE WHEN k % 4 = 1 THEN 9.0 ELSE 6.0 END FROM ({I.SUMS}) h{i}" for i, (t, a, b, second) in enumerate(_HEAD)
    ]
    parts += [
        f"SELECT stmt_id, cast(stmt_id AS bigint), 2 + row_no, 200 + row_no * 10 + {i}, {c}, {a}.0, {b}.0, 40.0 + row_no * 11.0 + {i % 3} * 0.8 FROM ({I.STMT_ROWS}) r{i}" for i, (c, a, b) in enumerate(_DATA)
    ]
    parts.append(f"SELECT stmt_id, cast(stmt_id AS bigint), 2 + row_no, 200 + row_no * 10 + 7, 'Jr', 152.0, 160.0, 40.0 + row_no * 11.0 FROM ({I.STMT_ROWS}) j WHERE row_no % 2 = 0")
    for i, (c, a, b) in enumerate((("'Totals'", 10, 40), ("gross", 225, 262), ("stated", 328, 360))):
        parts.append(f"SELECT stmt_id, k, 3 + n, 9000 + {i}, {c}, {a}.0, {b}.0, 40.0 + (n + 1) * 11.0 FROM ({I.SUMS}) t{i} WHERE k % 3 <> 2")
    return " UNION ALL ".join(parts)


BOXES = _boxes()
#: The same boxes on the page; every fifth page is upside down.
WORDS = f"""
SELECT stmt_id, 1 AS page_no, cast(w AS int) AS word_no, CASE WHEN k % 5 = 0 THEN reverse(text) ELSE text END AS text,
  cast(CASE WHEN k % 5 = 0 THEN base ELSE lo END AS double) AS x0, cast(CASE WHEN k % 5 = 0 THEN base + 8 ELSE hi END AS double) AS x1,
  cast(CASE WHEN k % 5 = 0 THEN -hi ELSE base END AS double) AS top, cast(CASE WHEN k % 5 = 0 THEN -lo ELSE base + 8 END AS double) AS bottom, k % 5 = 0 AS rotated
FROM ({BOXES}) b
"""


#: By order: the template's header and rows; a header without one of its words; rows that it does not know; a letterhead
#: alone; and pages of which nothing is left.
VARIED = f"""
SELECT w.* EXCEPT (text), CASE WHEN k % 4 = 2 AND text IN ('Invoice', 'eciovnI') THEN 'Ref' WHEN k % 4 = 3 AND word_no >= 200 AND word_no < 9000 AND word_no % 10 = 0
  THEN CASE WHEN rotated THEN reverse('#' || substr(reverse(text), 3)) ELSE '#' || substr(text, 3) END ELSE text END AS text
FROM (SELECT *, cast(stmt_id AS bigint) AS k FROM ({WORDS}) a) w WHERE k % 16 <> 7 AND (k % 16 <> 11 OR word_no < 100)
"""


def _array(structs: list[tuple]) -> Column:
    """Boxes `w, text, lo, hi, base` in SQL, as an array. Whole tenths, divided once, give the doubles of BOXES' decimals."""
    names = (("w", "int"), ("text", "string"), ("lo", "double"), ("hi", "double"), ("base", "double"))
    return F.array(*[F.struct(*[F.expr(str(x)).cast(kind).alias(n) for x, (n, kind) in zip(box, names, strict=True)]) for box in structs])


def boxes(rows: DataFrame) -> DataFrame:
    """BOXES without their lines, made of each row where it lies: those of the whole statement come with its first row."""
    own = Window.partitionBy("stmt_id")
    money = lambda x: x.cast("decimal(18,2)")
    paid = F.sum("comm_num").over(own)
    k = F.col("stmt_id").cast("bigint")
    told = rows.select(
        "*", k.alias("k"), F.count(F.lit(1)).over(own).cast("int").alias("n"), money(F.sum(money(F.col("gross"))).over(own)).cast("string").alias("all_gross"),
        money(paid + F.when(k % 7 == 0, 1).otherwise(0)).cast("string").alias("stated"),
    )
    head = [(i, f"'{t}'", a, b, -400) for i, (t, a, b) in enumerate(_LETTER)]
    head += [(100 + i, f"'{t}'", a, b, f"20 + {second} * CASE WHEN k % 4 = 1 THEN 9 ELSE 6 END") for i, (t, a, b, second) in enumerate(_HEAD)]
    data = [(f"200 + row_no * 10 + {i}", c, a, b, f"(400 + row_no * 110 + {i % 3 * 8}) / 10.0D") for i, (c, a, b) in enumerate(_DATA)]
    more = [("200 + row_no * 10 + 7", "'Jr'", 152, 160, "40 + row_no * 11")]
    total = [(9000 + i, c, a, b, "40 + (n + 1) * 11") for i, (c, a, b) in enumerate((("'Totals'", 10, 40), ("all_gross", 225, 262), ("stated", 328, 360)))]
    made = F.when(F.col("row_no") == 1, F.when(k % 3 != 2, _array(head + total + data)).otherwise(_array(head + data)))
    made = made.otherwise(F.when(F.col("row_no") % 2 == 0, _array(data + more)).otherwise(_array(data)))
    return told.select("stmt_id", "k", F.inline(made))


def _words(spark: SparkSession, sf_dir: str, words: str = WORDS) -> DataFrame:
    """WORDS or VARIED, whose partitions lie by `stmt_id`."""
    return spark.sql(words.replace(f"({BOXES})", "{boxes}"), boxes=boxes(I.stmt_rows(spark, sf_dir)))


def _lined(spark: SparkSession, sf_dir: str, words: str = WORDS, stored: bool = True) -> DataFrame:
    return layout.assign_lines(layout.normalise_axes(_words(spark, sf_dir, words)), stored=stored)


def normalise_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.normalise_axes(_words(spark, sf_dir)).select("stmt_id", "word_no", "pos", "lo", "hi", "txt")


def assign_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lined(spark, sf_dir, stored=False).select("stmt_id", "word_no", "line_no", "word_in_line")


def merge_header_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lined(spark, sf_dir, stored=False).select("stmt_id", "word_no", "band_no")


def assign_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of statements by distance alone."""
    lines = I.view(spark, sf_dir, f"SELECT stmt_id, 1 AS page_no, cast(line AS int) AS line_no, cast(min(base) AS double) AS pos FROM ({BOXES}) b GROUP BY stmt_id, line")
    return layout.assign_bands(lines).select("stmt_id", "line_no", "band_no")


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(_lined(spark, sf_dir, stored=False).filter("head"), "heads", "stmt_id")


def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only words of header-like bands are kept."""
    heads = _heads(spark, sf_dir)
    return layout.header_columns(heads, layout.header_bands(heads)).select("stmt_id", "band_no", "col_no", "name", "lo", "hi")


def assign_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the true header's table (band 1; the letterhead is band 0)."""
    lined = _lined(spark, sf_dir)
    bands = layout.header_bands(lined).filter("band_no = 1")
    return layout.assign_cells(lined, layout.header_columns(lined, bands), bands).select("stmt_id", "line_no", "col_no", "value")


def match_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = _lined(spark, sf_dir, VARIED, stored=False)
    return layout.match_templates(lined, canonical.template_table(spark)).select("stmt_id", "page_no", "band_no", "template")


def _template_rows(spark: SparkSession, sf_dir: str, words: str = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    lined, templates = _lined(spark, sf_dir, words), canonical.template_table(spark)
    matched = layout.match_templates(lined, templates)
    bands = layout.header_bands(lined).join(matched.select("stmt_id", "page_no", "band_no"), ["stmt_id", "page_no", "band_no"], "left_semi")
    cells = layout.assign_cells(lined, layout.header_columns(lined, bands), bands)
    return lined, matched, layout.template_rows(cells, matched, templates)


def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _template_rows(spark, sf_dir)[2]
    return rows.select("stmt_id", "line_no", "total", F.try_element_at("cells", F.lit(0)).alias("first"), F.try_element_at("cells", F.lit(5)).alias("comm"))


def candidate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the grids of letterhead and header fit the lines below them."""
    return layout.candidate_tables(_lined(spark, sf_dir))[0].select("stmt_id", "table_no", "hits", "misses", "fused", "lines_below")


def pick_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of letterhead and header the one whose table reconciles; some statements have neither."""
    return layout.pick_layout(*layout.candidate_tables(_lined(spark, sf_dir, VARIED))).select("stmt_id", "page_no", "table_no", "passing", "rows", "total_line")


def layout_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined, matched, rows = _template_rows(spark, sf_dir, VARIED)
    counts = rows.filter("NOT total").groupBy("stmt_id").agg(F.count(F.lit(1)).alias("rows"))
    picked = layout.pick_layout(*layout.candidate_tables(lined))
    return layout.layout_fallback(matched, counts, picked).select("stmt_id", "how", "template", "table_no")


def word_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from words to verdicts, over templates, unknown headers, unknown rows, no table and no words."""
    rows = I.settled_rows(spark, sf_dir)
    files = settled(I.statements(spark, sf_dir, rows).filter("n_rows > 0").select("stmt_id", "filename"), "word-files")
    made = read_word_statements(files, I.view(spark, sf_dir, VARIED, rows, I.settled_sums(spark, sf_dir, rows)).drop("k"))[0]
    return made.select(
        "stmt_id", "how", "template", "n_rows", F.coalesce("n_checks", F.lit(0)).cast("long").alias("n_checks"), F.coalesce("passed", F.lit(0)).cast("long").alias("passed"),
        "commission_column", "exported_total", "filename_total", "status", F.size("warnings").cast("long").alias("n_warnings"),
    )


READINGS = """
SELECT cast(user_id AS string) AS stmt_id, cast(event_id % 3 AS int) AS page_no, cast((event_id / 3) % 4 AS int) AS try_no, cast((event_id / 3) % 4 AS int) * 90 AS angle,
  cast(event_id AS int) AS word_no, CASE WHEN event_id % 17 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END AS text,
  CASE WHEN event_id % 23 = 0 THEN 'n/a' ELSE cast(cast(floor(value * 7) AS int) % 101 AS string) END AS conf,
  cast(event_id % 100 AS int) AS left, cast(event_id % 50 AS int) AS top, 10 AS width, 5 AS height FROM {events}
""".replace("(event_id / 3)", "cast(floor(event_id / 3) AS bigint)")


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ocr.filter_ocr_words(I.view(spark, sf_dir, READINGS))


def filter_ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)[0].select("stmt_id", "page_no", "try_no", "word_no", "text", "x0", "x1", "top", "bottom")


def ocr_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)[1]


def pick_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.pick_rotation(_facts(spark, sf_dir)[1], good_mean=48.0, good_words=10).select("stmt_id", "page_no", "try_no", "angle", "mean", "words", "dropped")


TOKENS = """
SELECT 'f' || cast(user_id AS string) || CASE WHEN user_id % 4 = 0 THEN '' ELSE ' 1,' || lpad(cast(user_id AS string), 3, '0') || '.50' END || '.pdf' AS filename,
  cast(event_id % 5 AS int) AS page_no, cast(event_id % 4 AS int) AS setting,
  CASE WHEN event_id % 6 = 0 THEN '$1,' || lpad(cast((event_id % 61) AS string), 3, '0') || '.50' ELSE event_type END AS text, cast(cast(floor(value) AS int) % 101 AS string) AS conf FROM {events}
"""


def ocr_setting_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.ocr_setting_hits(I.view(spark, sf_dir, TOKENS))[1]


def ocr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.ocr_setting_hits(I.view(spark, sf_dir, TOKENS))[0].select("filename", "setting", "words", "mean", "found")


QUERIES = {
    f.__name__: f
    for f in (
        word_statements, normalise_axes, assign_lines, merge_header_bands, assign_bands, header_columns, assign_cells, match_templates, template_rows, candidate_tables, pick_layout, layout_fallback,
        filter_ocr_words, ocr_readings, pick_rotation, ocr_setting_hits, ocr_files,
    )
}

_B = f"WITH b AS ({I.plain(BOXES)})"
_LINE_OF = "CASE WHEN line >= 1 THEN line ELSE 0 END"
_CELL_LINES = f"{_B}, r AS ({I.plain(I.STMT_ROWS)}), s AS ({I.plain(I.SUMS)})"
_N = "(SELECT n FROM s WHERE s.stmt_id = x.stmt_id)"
_READ = f"WITH w AS ({I.plain(READINGS)}), c AS (SELECT *, coalesce(try_cast(conf AS DOUBLE), -1) AS cf FROM w WHERE trim(text) <> '')"
_FACTS = f"{_READ}, f AS (SELECT stmt_id, page_no, try_no, angle, coalesce(avg(cf) FILTER (WHERE cf >= 25), 0) AS mean, count(*) FILTER (WHERE cf >= 25) AS words, count(*) FILTER (WHERE cf < 25) AS dropped FROM c GROUP BY ALL)"
_TOK = f"""WITH t AS ({I.plain(TOKENS)}), c AS (SELECT *, replace(trim(text), ',', '') AS x, {I.sql_filename_amount('filename')} AS amt FROM t WHERE page_no < 3 AND try_cast(conf AS DOUBLE) >= 25),
p AS (SELECT filename, amt, setting, page_no, count(DISTINCT x) AS words, avg(conf::DOUBLE) AS mean, bool_or(coalesce(contains(x, format('{{:.2f}}', abs(amt))), false)) AS found FROM c GROUP BY ALL),
f AS (SELECT filename, amt, setting, sum(words)::BIGINT AS words, avg(mean) AS mean, bool_or(found) AS found FROM p GROUP BY ALL)"""
SQL = {
    "word_statements": f"""{I.WITH}, s AS ({I.plain(I.SUMS)}), f AS (SELECT s.*, filename, {I.sql_filename_amount('filename')} AS filename_total, {I.sql_carrier('filename')} AS carrier,
  k % 16 IN (7, 11) AS bare, k % 4 IN (2, 3) AS auto, k % 3 <> 2 AS closed FROM s JOIN statements USING (stmt_id)),
g AS (SELECT *, CASE WHEN bare THEN NULL WHEN auto THEN 'auto-detected' ELSE 'template' END AS how, CASE WHEN NOT bare THEN comm::DOUBLE END AS exported_total FROM f),
h AS (SELECT *, CASE WHEN exported_total IS NULL THEN 'no_amounts' WHEN filename_total IS NULL THEN 'no_reference' WHEN abs(exported_total - filename_total) < 0.01 THEN 'match' ELSE 'mismatch' END AS status FROM g)
SELECT stmt_id, how, CASE how WHEN 'template' THEN 'Chris Leef General Agency' WHEN 'auto-detected' THEN carrier || ' (auto-detected)' ELSE '' END AS template,
  CASE WHEN bare THEN 0 ELSE n END::BIGINT AS n_rows, CASE WHEN closed AND NOT bare THEN 2 ELSE 0 END::BIGINT AS n_checks, CASE WHEN closed AND NOT bare THEN CASE WHEN k % 7 = 0 THEN 1 ELSE 2 END ELSE 0 END::BIGINT AS passed,
  CASE WHEN NOT bare THEN 'Comm $' END AS commission_column, exported_total, filename_total, status,
  (CASE WHEN bare OR NOT closed OR (auto AND k % 7 = 0) THEN 1 ELSE 0 END + CASE WHEN how = 'template' THEN coalesce(turned, 0) ELSE 0 END + CASE WHEN status IN ('mismatch', 'no_reference') THEN 1 ELSE 0 END)::BIGINT AS n_warnings
FROM h LEFT JOIN (SELECT stmt_id, count(*) AS turned FROM stmt_rows WHERE comm_num < 0 GROUP BY stmt_id) z USING (stmt_id)""",
    "normalise_axes": f"{_B} SELECT stmt_id, w::INTEGER AS word_no, base::DOUBLE AS pos, lo::DOUBLE AS lo, hi::DOUBLE AS hi, text AS txt FROM b",
    "assign_lines": f"{_B} SELECT stmt_id, w::INTEGER AS word_no, line::INTEGER AS line_no, row_number() OVER (PARTITION BY stmt_id, line ORDER BY lo, base, w)::INTEGER AS word_in_line FROM b",
    "merge_header_bands": f"{_B} SELECT stmt_id, w::INTEGER AS word_no, CASE WHEN line = 0 THEN 0 WHEN line <= 2 THEN 1 ELSE line - 1 END::INTEGER AS band_no FROM b",
    "assign_bands": f"""{_B}, l AS (SELECT stmt_id, line, min(base) AS pos FROM b GROUP BY ALL),
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY stmt_id ORDER BY line) > 8 THEN 1 ELSE 0 END AS new FROM l)
SELECT stmt_id, line::INTEGER AS line_no, sum(new) OVER (PARTITION BY stmt_id ORDER BY line)::INTEGER AS band_no FROM g""",
    "header_columns": f"""{_B}, h AS (SELECT stmt_id, CASE WHEN line = 0 THEN 0 ELSE 1 END AS band_no, w, text, lo, hi, base FROM b WHERE line <= 2),
g AS (SELECT *, CASE WHEN lo - max(hi) OVER (PARTITION BY stmt_id, band_no ORDER BY lo, hi, base, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 4 THEN 1 ELSE 0 END AS new FROM h),
n AS (SELECT *, sum(new) OVER (PARTITION BY stmt_id, band_no ORDER BY lo, hi, base, w ROWS UNBOUNDED PRECEDING) AS col_no FROM g)
SELECT stmt_id, band_no::INTEGER AS band_no, col_no::INTEGER AS col_no, string_agg(text, ' ' ORDER BY base, lo, w) AS name, min(lo)::DOUBLE AS lo, max(hi)::DOUBLE AS hi FROM n GROUP BY ALL""",
    "assign_cells": f"""{_CELL_LINES}, c AS (
SELECT stmt_id, row_no + 2 AS line_no, 0 AS col_no, policy AS value FROM r UNION ALL SELECT stmt_id, row_no + 2, 1, insured || CASE WHEN row_no % 2 = 0 THEN ' Jr' ELSE '' END FROM r
UNION ALL SELECT stmt_id, row_no + 2, 2, eff FROM r UNION ALL SELECT stmt_id, row_no + 2, 3, gross FROM r UNION ALL SELECT stmt_id, row_no + 2, 4, rate FROM r UNION ALL SELECT stmt_id, row_no + 2, 5, comm FROM r
UNION ALL SELECT stmt_id, n + 3, 0, 'Totals' FROM s WHERE k % 3 <> 2 UNION ALL SELECT stmt_id, n + 3, 3, gross FROM s WHERE k % 3 <> 2 UNION ALL SELECT stmt_id, n + 3, 5, stated FROM s WHERE k % 3 <> 2)
SELECT stmt_id, line_no::INTEGER AS line_no, col_no, value FROM c""",
    "match_templates": f"WITH s AS ({I.plain(I.SUMS)}) SELECT stmt_id, 1 AS page_no, 1 AS band_no, 'Chris Leef General Agency' AS template FROM s WHERE k % 4 <> 2 AND k % 16 NOT IN (7, 11)",
    "template_rows": f"""{_CELL_LINES} SELECT stmt_id, (row_no + 2)::INTEGER AS line_no, false AS total, policy AS first, comm FROM r
UNION ALL SELECT stmt_id, (n + 3)::INTEGER, true, 'Totals', stated FROM s WHERE k % 3 <> 2""",
    "layout_fallback": f"""WITH s AS ({I.plain(I.SUMS)}) SELECT stmt_id, CASE WHEN k % 4 IN (2, 3) THEN 'auto-detected' ELSE 'template' END AS how,
  CASE WHEN k % 4 NOT IN (2, 3) THEN 'Chris Leef General Agency' END AS template, 1 AS table_no FROM s WHERE k % 16 NOT IN (7, 11)""",
    "candidate_tables": f"""WITH s AS (SELECT *, (k % 3 <> 2)::INTEGER AS closed FROM ({I.plain(I.SUMS)}) x)
SELECT stmt_id, 1 AS table_no, (6 * n + 3 * closed)::BIGINT AS hits, (n // 2)::BIGINT AS misses, 0::BIGINT AS fused, (n + closed)::BIGINT AS lines_below FROM s
UNION ALL SELECT stmt_id, 0, (11 + 6 * n + n // 2 + 3 * closed)::BIGINT, 0::BIGINT, n::BIGINT, (2 + n + closed)::BIGINT FROM s""",
    "pick_layout": f"""WITH s AS ({I.plain(I.SUMS)}) SELECT stmt_id, 1 AS page_no, 1 AS table_no,
  CASE WHEN k % 3 = 2 THEN 0 WHEN k % 7 = 0 THEN 1 ELSE 2 END::BIGINT AS passing, n::BIGINT AS rows, CASE WHEN k % 3 <> 2 THEN n + 3 END::INTEGER AS total_line FROM s WHERE k % 16 NOT IN (7, 11)""",
    "filter_ocr_words": f"""{_READ} SELECT stmt_id, page_no, try_no, word_no, trim(text) AS text, "left" * 0.24::DOUBLE AS x0, ("left" + width) * 0.24::DOUBLE AS x1, top * 0.24::DOUBLE AS top, (top + height) * 0.24::DOUBLE AS bottom FROM c WHERE cf >= 25""",
    "ocr_readings": f"{_FACTS} SELECT * FROM f",
    "pick_rotation": f"""{_FACTS}, s AS (SELECT *, min(CASE WHEN mean >= 48 AND words >= 10 THEN try_no END) OVER (PARTITION BY stmt_id, page_no) AS stop FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY stmt_id, page_no ORDER BY mean DESC, words DESC, try_no) AS rn FROM s WHERE stop IS NULL OR try_no <= stop)
SELECT stmt_id, page_no, try_no, angle, mean, words, dropped FROM k WHERE rn = 1""",
    "ocr_setting_hits": f"{_TOK} SELECT setting, count(*) FILTER (WHERE found) AS hits, count(*) FILTER (WHERE amt IS NOT NULL) AS scored FROM f GROUP BY setting",
    "ocr_files": f"{_TOK} SELECT filename, setting, words, mean, found FROM f",
}
