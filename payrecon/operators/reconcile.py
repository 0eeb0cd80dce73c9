"""Proving that the money adds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S

REFERENCES = "array<struct<source: string, amount: double>>"


def column_checks(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """For each column whose total cell is a figure: the sum of the rows against it.

    cells, totals: `stmt_id, col_no, col_name, value`. Sums are exact decimals with map-side partial sums, so a
    huge statement is no hot task.
    """
    figures = cells.select("stmt_id", "col_no", S.to_amount(F.col("value")).alias("_num")).filter("_num IS NOT NULL")
    sums = figures.groupBy("stmt_id", "col_no").agg(S.cents(F.sum(S.money(F.col("_num")))).alias("rows_total"))
    stated = totals.select("stmt_id", "col_no", F.col("col_name").alias("label"), S.to_amount(F.col("value")).alias("stated_total"))
    checks = stated.filter("stated_total IS NOT NULL").join(sums, ["stmt_id", "col_no"])
    return checks.withColumn("ok", S.same_cent(F.col("rows_total"), F.col("stated_total")))


def rate_check(cells: DataFrame, columns: DataFrame, tolerance: float = config.TOTAL_TOL) -> DataFrame:
    """Rows where base * rate / 100 is not the result, with a message.

    columns: `stmt_id, base_col, rate_col, result_col` of statements that have all three.
    """
    at = cells.join(columns, "stmt_id")
    number = lambda c: F.max(F.when(F.col("col_name") == F.col(c), S.to_amount(F.col("value"))))
    rows = at.groupBy("stmt_id", "row_no", "result_col").agg(
        F.min_by(F.col("value"), F.col("col_no")).alias("label"), number("base_col").alias("base"), number("rate_col").alias("rate"), number("result_col").alias("result")
    )
    expected = F.col("base") * F.col("rate") / 100
    bad = rows.filter(F.abs(expected - F.col("result")) > tolerance)
    message = F.concat(
        F.lit("Row "), F.col("label"), F.lit(": "), S.shown_number(F.col("base")), F.lit(" x "), S.shown_number(F.col("rate")), F.lit("% = "),
        S.shown_number(F.replace(S.format_amount(expected), F.lit(","), F.lit("")).cast("double")), F.lit(", but "), F.col("result_col"), F.lit(" says "), S.shown_number(F.col("result")),
    )
    return bad.select("stmt_id", "row_no", "label", "base", "rate", "result", message.alias("message"))


def exported_total(cells: DataFrame, mapped: DataFrame) -> DataFrame:
    """`stmt_id, commission_column, exported_total`: the sum of the mapped commission column, where it has a figure.

    mapped: `stmt_id, commission_column`, from the mapping of columns alone; what the references say has no part
    in choosing it.
    """
    of = cells.join(mapped.hint("shuffle_hash"), (cells["stmt_id"] == mapped["stmt_id"]) & (cells["col_name"] == mapped["commission_column"]))
    figures = of.select(cells["stmt_id"], "commission_column", S.to_amount(F.col("value")).alias("_num")).filter("_num IS NOT NULL")
    return figures.groupBy("stmt_id", "commission_column").agg(S.cents(F.sum(S.money(F.col("_num")))).alias("exported_total"))


def declared_totals(lines: DataFrame, labels=config.DECLARED_LABELS, amount: str = config.PRINTED_AMOUNT) -> DataFrame:
    """Every printed total in the lines of statements: `stmt_id, rank, page_no, line_no, match_no, label, amounts`.

    labels are patterns, the most trustworthy first. A match's amounts are all that its line prints from there.
    Lines that no pattern can match are dropped before the patterns are tried one by one.
    """
    some = f"(?i)(?:{'|'.join(labels)})\\s*:?\\s*{amount}"
    likely = lines.filter(F.col("text").rlike(some))
    ranked = likely.select("*", F.posexplode(F.array(*[F.lit(f"(?i)({p})\\s*:?\\s*({amount})") for p in labels])).alias("rank", "_re"))
    line, found = F.col("text"), F.regexp_extract_all(F.col("text"), F.col("_re"), F.lit(0))
    ranked = ranked.withColumn("_all", found).filter(F.size("_all") > 0)
    ranked = ranked.withColumn("_between", F.split(line, F.col("_re"), -1))
    ranked = ranked.withColumn("_label", F.regexp_extract_all(line, F.col("_re"), F.lit(1))).withColumn("_first", F.regexp_extract_all(line, F.col("_re"), F.lit(2)))
    each = ranked.select("*", F.posexplode("_all").alias("match_no", "_match"))
    lengths = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    start = lengths("_between", F.col("match_no") + 1) + lengths("_all", F.col("match_no"))  # characters before the match
    each = each.withColumn("_start", start)
    prefix = F.substring(line, F.greatest(F.lit(1), F.col("_start") - 29), F.least(F.lit(30), F.col("_start")))
    label = S.strip(F.regexp_replace(F.get("_label", F.col("match_no")), r"\s+", " "))
    rest = F.substring(line, F.col("_start") + F.length("_match") - F.length(F.get("_first", F.col("match_no"))) + 1, F.length(line))
    amounts = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(amount), F.lit(0)), S.to_amount), lambda v: v.isNotNull())
    each = each.select("stmt_id", "rank", "page_no", "line_no", "match_no", label.alias("label"), amounts.alias("amounts"), prefix.alias("_prefix"))
    return each.filter(~S.excluded_label(F.col("_prefix")) & ~S.excluded_label(F.col("label")) & (F.size("amounts") > 0)).drop("_prefix")


def choose_reference(declared: DataFrame, filenames: DataFrame) -> DataFrame:
    """`stmt_id, statement_label, statement_total`: the printed total to hold the export against.

    The first declared entry that shows the amount of the file name, and then that amount; else the last
    amount of the best entry. filenames: `stmt_id, filename_total`.
    """
    order = F.struct("rank", "page_no", "line_no", "match_no")
    near = F.exists("amounts", lambda a: S.same_cent(a, F.col("filename_total")))
    joined = declared.join(filenames.select("stmt_id", "filename_total"), "stmt_id", "left").withColumn("_near", F.coalesce(near, F.lit(False)))
    best = joined.groupBy("stmt_id").agg(
        F.min(F.when(F.col("_near"), F.struct(order.alias("o"), "label"))).alias("_hit"),
        F.min(F.struct(order.alias("o"), "label", "amounts")).alias("_top"),
        F.max("filename_total").alias("_file"),
    )
    return best.select(
        "stmt_id",
        F.coalesce("_hit.label", "_top.label").alias("statement_label"),
        F.when(F.col("_hit").isNotNull(), F.col("_file")).otherwise(F.element_at("_top.amounts", -1)).alias("statement_total"),
    )


def references(filename_total: Column, statement_total: Column, label: Column) -> Column:
    """What the export is held against: the file's name, then the statement's own total."""
    one = lambda source, amount: F.when(amount.isNotNull(), F.struct(source.alias("source"), amount.alias("amount")))
    shown = F.coalesce(F.nullif(label, F.lit("")), F.lit("statement"))
    return F.array_compact(F.array(one(F.lit("filename"), filename_total), one(shown, statement_total))).cast(REFERENCES)


def payout_verdict(payout: DataFrame) -> DataFrame:
    """payout (`exported_total, filename_total, statement_total, statement_label`, ...) with the verdict:
    `references, references_disagree, status, ok`."""
    exported = F.col("exported_total")
    rows = payout.withColumn("references", references(F.col("filename_total"), F.col("statement_total"), F.col("statement_label")))
    disagree = F.coalesce(F.abs(F.col("filename_total") - F.col("statement_total")) >= config.CENT, F.lit(False))
    status = (
        F.when(exported.isNull(), "no_amounts").when(F.size("references") == 0, "no_reference")
        .when(F.forall("references", lambda r: S.same_cent(exported, r["amount"])), "match").otherwise("mismatch")
    )
    return rows.withColumn("references_disagree", disagree).withColumn("status", status).withColumn("ok", F.col("status") == "match")


def verdict_warnings(payout: DataFrame) -> DataFrame:
    """payout with a verdict and `warnings`, `n_rows`: a mismatch goes in front, what could not run to the end."""
    two = lambda c: S.format_amount(c, 2)
    refs = F.array_join(F.transform("references", lambda r: F.concat(r["source"], F.lit(" says "), two(r["amount"]))), ", ")
    failed = F.concat(
        F.lit("FAILSAFE: column "), F.col("commission_column"), F.lit(" exports "), two(F.col("exported_total")), F.lit(", but "), refs, F.lit(". Explain the difference before use.")
    )
    apart = F.concat(F.lit("The references disagree: "), two(F.col("filename_total")), F.lit(" and "), two(F.col("statement_total")), F.lit("."))
    front = F.when(F.col("status") == "mismatch", F.array_compact(F.array(failed, F.when(F.col("references_disagree"), apart))))
    missing = S.first_true(
        (F.col("status") == "no_reference", F.lit("Failsafe could not run: no declared total to hold the export against.")),
        ((F.col("status") == "no_amounts") & (F.col("n_rows") > 0), F.lit("Failsafe could not run: no commission column.")),
    )
    none = F.array().cast("array<string>")
    end = F.array_compact(F.array(missing))
    return payout.withColumn("warnings", F.concat(F.coalesce(front, none), F.coalesce("warnings", none), F.coalesce(end, none)))
