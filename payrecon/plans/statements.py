"""The whole ways: from files, or from positioned words, to cleaned and reconciled statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..operators import canonical, delimited, export, layout, ocr, reconcile, report, totals
from ..sources import files as sources
from ..sources import large
from ..sources.payload import to_payload
from ..sources.store import settled

_ROW = ["stmt_id", "row_no"]
_TEXTS = "array<string>"


def _in_order(order: Column, value: Column) -> Column:
    """The values of a group as an array, in their order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def _row_entries(cells: DataFrame) -> DataFrame:
    """`stmt_id, row_no, row`: name and cell of each column of a row (of columns with one name the last counts)."""
    last = cells.groupBy(*_ROW, "col_name").agg(F.max_by("value", "col_no").alias("value"))
    return last.groupBy(*_ROW).agg(F.sort_array(F.collect_list(F.struct("col_name", "value"))).alias("row"))


def _maps_in_order() -> Column:
    return F.transform(_in_order(F.col("row_no"), F.col("row")), F.map_from_entries)


def payloads(statements: DataFrame, cells: DataFrame) -> DataFrame:
    """statements with `payload`: the statement and its rows as one JSON text, as the history keeps it.

    Rows of one statement come together here, as they have to in its JSON; everything else stays long.
    """
    rows = _row_entries(cells).groupBy("stmt_id").agg(_maps_in_order().alias("rows"))
    none = F.array().cast("array<map<string,string>>")
    full = statements.join(rows, "stmt_id", "left").withColumn("rows", F.coalesce("rows", none))
    return full.withColumn("payload", to_payload(full)).drop("rows")


def _judged(base: DataFrame, columns: DataFrame, cells: DataFrame, total_cells: DataFrame, checks: DataFrame, first: DataFrame) -> DataFrame:
    """base (`stmt_id, filename, template, statement_total, statement_label`, ...) with columns, mapping, rows, checks,
    totals, export and verdict; first: `stmt_id, warnings` that stand before those of the verdict."""
    mapped = canonical.canonical_map(base.select("stmt_id", "template").join(columns, "stmt_id"))
    chosen = mapped.select("stmt_id", F.col("mapping.`Commission Amount`").alias("commission_column")).filter("commission_column IS NOT NULL")
    counts = cells.groupBy("stmt_id").agg(F.count_distinct("row_no").alias("row_count"))
    proofs = checks.groupBy("stmt_id").agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if("ok").alias("passed"),
        _in_order(F.col("col_no"), F.struct("label", "rows_total", "stated_total", "ok")).alias("checks"),
    )
    totals_of = _row_entries(total_cells).groupBy("stmt_id").agg(F.map_from_entries(F.min("row")).alias("totals"))  # one row each
    out = base
    for other in (columns, mapped.select("stmt_id", "mapping"), reconcile.exported_total(cells, chosen), counts, proofs, totals_of, first):
        out = out.join(other, "stmt_id", "left")
    judged = reconcile.payout_verdict(out.withColumn("filename_total", S.filename_amount(F.col("filename"))))
    return reconcile.verdict_warnings(judged.withColumn("n_rows", F.coalesce("row_count", F.lit(0).cast("long")))).drop("row_count")


def _once(rows: DataFrame) -> DataFrame:
    """rows, of which those that repeat a statement's id are left out; contents are moved only if there are any."""
    numbered = settled(rows.withColumn("_no", F.monotonically_increasing_id()), "files")
    first = numbered.groupBy("stmt_id").agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = settled(numbered.select("stmt_id", "_no").join(first, "stmt_id").filter("_no <> _first").select("stmt_id", "_no"), "repeats")
    kept = numbered if again.isEmpty() else numbered.join(again, ["stmt_id", "_no"], "left_anti")
    return kept.drop("_no")


_OWN = ["stmt_id", "filename", "suffix", "sha256", "uploaded_at"]


def read_exports(files: DataFrame, most: int = config.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(statements, cells) of files (`stmt_id, filename, suffix, length, sha256, uploaded_at, content`).

    statements: one row a file. `status` is the verdict, or `too_large` (over `most` bytes) or `rejected` for files that
    are not read and `crash` for those that cannot be, with the reason among `warnings`. Delimited files have `template,
    delimiter, columns, mapping, n_rows, commission_column, exported_total, checks, n_checks, passed, totals`, the
    verdict, and `cleanup`, the notes on what was changed. Files of words go another way, see read_word_statements(), and
    large ones, see read_large_exports(). cells: the cleaned data rows.

    Defined cases: an empty file, and one without a row below its header, is a statement without rows and
    `no_amounts`, with a warning; of rows that repeat a statement's id the first as they lie counts; an empty table gives
    empty tables.
    """
    routed = _once(sources.route_by_suffix(files, most))
    texts = routed.filter("route = 'delimited'").withColumn("text", sources.decoded("content")).drop("content")
    texts = settled(texts.withColumn("delimiter", delimited.sniff_delimiter(F.col("text"))), "texts")
    records, errors = sources.split_records(texts)
    records = settled(records.repartition("stmt_id"), "records", "stmt_id")  # a file is small here
    read, cells = _cleaned(texts.select(*_OWN, "delimiter"), records, settled(errors, "errors"), "stmt_id")
    why = F.when(F.col("route") == "too_large", F.lit(f"Larger than {most / (1 << 20):.3g} MB: not read.")).otherwise(F.lit("Not a delimited export: not read."))
    route = F.when(F.col("route") == "too_large", "too_large").otherwise("rejected")
    left_out = routed.filter("route <> 'delimited'").select(*_OWN, route.alias("status"), F.array(why).alias("warnings"), F.lit(False).alias("ok"), F.lit(0).cast("long").alias("n_rows"))
    return settled(read.unionByName(left_out, allowMissingColumns=True), "statements"), cells


def read_large_exports(spark: SparkSession, root: str, over: int = config.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(statements, cells), as read_exports() gives them, of the delimited files below a folder that have more than `over`
    bytes: those are read by ranges, many tasks a file. Their `sha256` is null, as no task has a whole file."""
    lines = large.large_lines(spark, root, over)
    name = F.element_at(F.split(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "/"), -1)
    facts = lines.groupBy("path").agg(F.first("length").alias("length"), F.first("modificationTime").alias("uploaded_at"))
    told = large.heads_of(lines).select("path", delimited.sniff_delimiter(F.col("text")).alias("delimiter"))
    own = settled(facts.join(told, "path", "left").select(
        sources.identity(F.col("path"), F.col("uploaded_at")).alias("stmt_id"), name.alias("filename"), F.lower(F.regexp_extract(name, r"\.[A-Za-z0-9]+$", 0)).alias("suffix"),
        F.lit(None).cast("string").alias("sha256"), "uploaded_at", F.coalesce("delimiter", F.lit(",")).alias("delimiter"), "path",
    ), "large-files")
    records, errors = large.split_large_records(lines, own)
    of = own.select("path", "stmt_id")
    records, errors = settled(records.join(of, "path").select("stmt_id", "rec_no", "fields"), "records"), settled(errors.join(of, "path").select("stmt_id", "error"), "errors")
    read, cells = _cleaned(own.drop("path"), records, errors)
    return settled(read, "statements"), cells


def _cleaned(files: DataFrame, records: DataFrame, errors: DataFrame, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements, cells) of stored files (`stmt_id, filename, suffix, sha256, uploaded_at, delimiter`), the records in
    them and what went wrong. by: the key that the records lie by, if they do; large files stay spread."""
    raw, warned = delimited.normalise_header(records, files)
    raw = settled(raw, "raw-cells", by)
    plans = settled(delimited.resolve_percent_scale(raw, delimited.plan_columns(raw)), "plans", by)
    filled = settled(delimited.drop_blank_rows(delimited.apply_plans(raw, plans)), "filled-cells", by)
    markers = settled(delimited.marker_rows(filled), "markers", by)
    clean = settled(filled.join(markers, _ROW, "left_anti"), "clean-cells", by)
    closed = settled(totals.split_labelled_total(clean), "closed")
    last = closed.select("stmt_id", F.col("total_row").alias("row_no"))
    cells, total_cells = settled(clean.join(last, _ROW, "left_anti"), "cells", by), settled(clean.join(last, _ROW, "left_semi"), "total-cells", by)
    columns = plans.groupBy("stmt_id").agg(_in_order(F.col("col_no"), F.col("col_name")).alias("columns"))
    labels = total_cells.filter("value <> ''").groupBy("stmt_id").agg(F.min_by("value", "col_no").alias("label"))
    notes = delimited.cleanup_notes(plans, closed.join(labels, "stmt_id", "left").withColumn("label", F.coalesce("label", F.lit("the last row"))), markers)
    cleanup = notes.groupBy("stmt_id").agg(_in_order(F.col("ord"), F.struct("column", "action", "detail")).alias("cleanup"))
    names = F.create_map(*[F.lit(x) for kv in config.DELIMITER_NAMES.items() for x in kv])
    base = files.select(*_OWN, F.try_element_at(names, F.col("delimiter")).alias("delimiter"), sources.carrier_label(F.col("filename"), "delimited export").alias("template"))
    base = base.join(cleanup, "stmt_id", "left").withColumn("statement_total", F.lit(None).cast("double")).withColumn("statement_label", F.lit(None).cast("string"))
    failed = errors.groupBy("stmt_id").agg(F.min("error").alias("_error"))
    first = warned.join(failed, "stmt_id", "left_anti").groupBy("stmt_id").agg(F.sort_array(F.collect_list("warning")).alias("warnings"))
    judged = _judged(base, columns, cells, total_cells, reconcile.column_checks(cells, total_cells), first)
    crashed = judged.join(failed, "stmt_id", "left")
    said = F.concat(F.array(F.concat(F.lit("CRASH: "), "_error")), "warnings")
    crashed = crashed.withColumn("warnings", F.when(F.col("_error").isNotNull(), said).otherwise(F.col("warnings")))
    return crashed.withColumn("status", F.when(F.col("_error").isNotNull(), "crash").otherwise(F.col("status"))).drop("_error"), cells


def export_statements(statements: DataFrame, cells: DataFrame, guarded: bool = True) -> dict[str, DataFrame]:
    """What leaves of statements and cells that read_exports(), read_large_exports() or read_word_statements() have given:
    `all_rows`, `typed` (the same with typed cells), `sheets` (the statements' own columns) and `report` (verdicts, checks,
    warnings). With `guarded` a mismatch among the statements is an error; choose those that may leave before.

    Rows are mapped with the mapping that reading has found; statements without a column to map, and such as were not
    read, are in the report alone.
    """
    if guarded:
        export.guard_failsafe(statements)
    own = statements.select("stmt_id")
    cells = cells.join(own, "stmt_id", "left_semi")
    rows = export.all_rows(cells.select("stmt_id", "row_no").distinct(), cells, statements)
    entries = lambda maps: statements.select("stmt_id", F.posexplode(maps).alias("row_no", "_row")).select("stmt_id", "row_no", F.explode("_row").alias("col_name", "value"))
    order = statements.select("stmt_id", F.posexplode("columns").alias("_at", "_name"))
    placed = lambda df: df.join(order, (df["stmt_id"] == order["stmt_id"]) & (df["col_name"] == order["_name"])).select(df["stmt_id"], "row_no", (F.col("_at") + 1).alias("col_no"), "col_name", "value")
    below = entries("subtotals") if "subtotals" in statements.columns else entries(F.array().cast("array<map<string,string>>"))
    sheets = export.statement_sheet(cells, placed(below), placed(entries(F.array_compact(F.array("totals")))))
    checks = statements.select("stmt_id", F.posexplode("checks").alias("ord", "c")).select("stmt_id", "ord", "c.*")
    warnings = statements.select("stmt_id", F.posexplode("warnings").alias("ord", "warning"))
    return {"all_rows": rows, "typed": export.typed_all_rows(rows), "sheets": sheets, "report": export.validation_report(statements, checks, warnings)}


def carrier_sweep(statements: DataFrame) -> DataFrame:
    """carrier_report() over statements that were read: the carrier is that of the file's name."""
    stated = F.coalesce(F.when(F.col("statement_total") != 0, F.col("statement_total")), F.col("filename_total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return report.carrier_report(statements.select(
        S.carrier_name(F.col("filename")).alias("carrier"), "filename", "template", zero("n_rows").alias("rows"), zero("n_checks").alias("checks"), zero("passed").alias("passed"),
        F.col("status").alias("failsafe"), F.col("exported_total").alias("exported"), stated.alias("declared"), F.get("warnings", F.lit(0)).alias("warn"),
    ))


def words_with_readings(words: DataFrame, ocr_words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, notes): pages without words get those of their best reading; notes: `stmt_id, page_no, note`."""
    kept, facts = ocr.filter_ocr_words(ocr_words)
    page = ["stmt_id", "page_no"]
    best = settled(ocr.pick_rotation(facts).join(words.select(*page).distinct(), page, "left_anti"), "readings")
    read = kept.join(best.select(*page, "try_no"), [*page, "try_no"]).drop("try_no")
    return words.unionByName(read), best.select(*page, "note")


def _auto_rows(cells: DataFrame, how: DataFrame, picked: DataFrame) -> DataFrame:
    """Cells of the detected tables as `stmt_id, page_no, table_no, row_no, col_no, value, total`: data rows, and total
    rows or the last row that adds up."""
    table = ["stmt_id", "page_no", "table_no"]
    of = how.filter("how = 'auto-detected'").join(picked.select(*table, "total_line"), table)
    rows = cells.join(of.select(*table, "total_line"), table).withColumn("total", F.col("total") | F.coalesce(F.col("line_no") == F.col("total_line"), F.lit(False)))
    return rows.filter("total OR data").select(*table, F.col("line_no").alias("row_no"), "col_no", "value", "total")


def read_word_statements(files: DataFrame, words: DataFrame, ocr_words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements, cells) of files (`stmt_id, filename`, ...) whose pages are positioned words.

    Pages without words take those of the best OCR reading, where there are readings. A statement is read by the
    first template whose header it holds; a match without rows, and a statement without a match, goes to the table
    that agrees best with itself. Sums are held against the table's own totals, rates against amounts, and the export
    against the file name and the totals printed in the text. statements: one row a file with `how, template,
    columns, n_rows, checks, n_checks, passed, totals, subtotals`, the verdict and `warnings`. cells: data rows.

    Defined cases: a file without words, or without a table, is a statement without rows, with a warning; words of
    no file are left out; an empty table of files gives empty tables.
    """
    spark, page, table = files.sparkSession, ["stmt_id", "page_no"], ["stmt_id", "page_no", "table_no"]
    notes = spark.createDataFrame([], "stmt_id string, page_no int, note string")
    if ocr_words is not None:
        words, notes = words_with_readings(words, ocr_words)
    lined = layout.assign_lines(layout.normalise_axes(words.join(files.select("stmt_id").distinct(), "stmt_id", "left_semi")))
    templates = canonical.template_table(spark)
    matched = settled(layout.match_templates(lined, templates), "matched")
    heads = settled(layout.band_ends(lined).join(matched.select(*page, "band_no"), [*page, "band_no"], "left_semi"), "template-heads")
    head_columns = settled(layout.header_columns(lined, heads), "template-columns")
    by_template = settled(layout.template_rows(layout.assign_cells(lined, head_columns, heads), matched, templates), "template-rows")
    fit, found = layout.candidate_tables(lined)
    picked = settled(layout.pick_layout(fit, found), "picked")
    counts = by_template.filter("NOT total").groupBy("stmt_id").agg(F.count(F.lit(1)).alias("rows"))
    how = settled(layout.layout_fallback(matched, counts, picked), "layouts")
    told = by_template.join(how.filter("how <> 'auto-detected'").select(*table), table, "left_semi")
    told = told.select(*table, F.col("line_no").alias("row_no"), F.explode("cells").alias("col_no", "value"), "total")
    wanted = layout.header_bands(lined).join(how.filter("how = 'auto-detected'").select(*page, F.col("table_no").alias("band_no")), [*page, "band_no"], "left_semi")
    shown = head_columns.unionByName(layout.header_columns(lined, wanted)).withColumnRenamed("band_no", "table_no").join(how.select(*table), table, "left_semi")
    shown = settled(shown.select(*table, "col_no", F.col("name").alias("col_name")).distinct(), "columns")
    both = told.unionByName(_auto_rows(found, how, picked)).join(shown, [*table, "col_no"])
    both = settled(both.select("stmt_id", "row_no", "col_no", "col_name", "value", "total"), "word-cells")
    cells, said = both.filter("NOT total").drop("total"), both.filter("total").drop("total")
    chosen = settled(totals.pick_totals_row(said), "total-rows")
    total_cells, others = said.join(chosen, _ROW, "left_semi"), said.join(chosen, _ROW, "left_anti")
    checks = settled(reconcile.column_checks(cells, total_cells), "checks")
    columns = shown.groupBy("stmt_id").agg(_in_order(F.col("col_no"), F.col("col_name")).alias("columns"))
    named = how.filter("how <> 'auto-detected'").join(F.broadcast(templates), "template").join(columns, "stmt_id")  # a fixed list
    rated = named.filter(F.array_contains("columns", F.col("base_col")) & F.array_contains("columns", F.col("rate_col")) & F.array_contains("columns", F.col("result_col")))
    off = reconcile.rate_check(cells, rated.select("stmt_id", "base_col", "rate_col", "result_col"))
    off = off.groupBy("stmt_id").agg(_in_order(F.col("row_no"), F.col("message")).alias("rates"))
    pages = notes.groupBy("stmt_id").agg(_in_order(F.col("page_no"), F.concat(F.lit("Page "), F.col("page_no").cast("string"), F.lit(": "), "note")).alias("pages"))
    proofs = checks.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"))
    seen = lined.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("words"))
    known = files.select("stmt_id", "filename")
    for other in (how.select("stmt_id", "how", "template"), proofs, seen, off, pages, chosen.select("stmt_id", F.lit(1).alias("has_total"))):
        known = known.join(other, "stmt_id", "left")
    auto = F.col("how") == "auto-detected"
    n = F.when(auto, F.coalesce("n", F.lit(0))).otherwise(F.coalesce("has_total", F.lit(0)))
    good = F.when(auto, F.coalesce("good", F.lit(0))).otherwise(n)
    label, warning = layout.layout_status(S.carrier_name(F.col("filename")), F.col("how"), F.col("template"), F.col("words"), n, good)
    none = F.array().cast(_TEXTS)
    first = F.concat(F.coalesce("pages", none), F.array_compact(F.array(warning)), F.coalesce("rates", none))
    known = settled(known.select("stmt_id", "how", label.alias("template"), first.alias("warnings")), "known")
    words_of_line = F.array_join(_in_order(F.col("word_in_line"), F.col("txt")), " ")
    lines = lined.groupBy(*page, "line_no").agg(words_of_line.alias("text"))
    declared = reconcile.choose_reference(reconcile.declared_totals(lines), files.select("stmt_id", S.filename_amount(F.col("filename")).alias("filename_total")))
    subtotals = _row_entries(others).groupBy("stmt_id").agg(_maps_in_order().alias("subtotals"))
    own = [c for c in files.columns if c not in ("content", "template", "how", "warnings", "statement_total", "statement_label", "subtotals")]
    base = files.select(*own).join(known.drop("warnings"), "stmt_id").join(declared, "stmt_id", "left").join(subtotals, "stmt_id", "left")
    judged = _judged(base, columns, cells, total_cells, checks, known.select("stmt_id", "warnings"))
    return settled(judged, "statements"), cells
