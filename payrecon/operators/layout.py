"""Rebuilding tables from positioned words by interval arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import scalars as S
from ..sources.store import settled

PAGE = ["stmt_id", "page_no"]


def normalise_axes(words: DataFrame) -> DataFrame:
    """words with `pos` (from line to line), `lo, hi` (along a line), `txt` and `height`; pages turned upside down
    get the same axes as upright ones."""
    r = F.coalesce(F.col("rotated"), F.lit(False))
    return words.select(
        *PAGE, "word_no", F.when(r, F.col("x0")).otherwise(F.col("top")).alias("pos"), F.when(r, -F.col("bottom")).otherwise(F.col("x0")).alias("lo"),
        F.when(r, -F.col("top")).otherwise(F.col("x1")).alias("hi"), F.when(r, F.reverse("text")).otherwise(F.col("text")).alias("txt"), (F.col("bottom") - F.col("top")).alias("height"),
    )


def anchor_groups(positions: list[float], tolerance: float) -> list[int]:
    """Numbers of the lines of sorted positions: a word stays on a line while it is near that line's first word."""
    out, anchor, n = [], None, -1
    for p in positions:
        if anchor is None or p - anchor > tolerance:
            anchor, n = p, n + 1
        out.append(n)
    return out


class Pages:
    """The words of many pages, in order of position, as flat lists; a page is a range of them."""

    def __init__(self, positions: list[float], heights: list[float], alpha: np.ndarray, num: np.ndarray) -> None:
        self.positions, self.heights = positions, heights
        self.alpha, self.num = ([0, *np.cumsum(x).tolist()] for x in (alpha, num))

    def heads(self, start: int, end: int) -> bool:
        """The words of a range look like a header: labels, few figures."""
        alpha, num = (x[end] - x[start] for x in (self.alpha, self.num))
        return end - start >= config.MIN_CELLS and alpha >= config.MIN_CELLS and num <= (end - start) // 3

    def bands(self, start: int, end: int, lines: list[int], gap: float, ratio: float) -> list[int]:
        """Numbers of the bands of a page's words: lines that are near, then header-like bands a line apart. `lines`: the
        numbers of the lines of its words."""
        if start == end:
            return []
        at, firsts, before = self.positions, [], None
        for i in range(start, end):
            if i == start or lines[i - start] != lines[i - start - 1]:
                if before is None or at[i] - before > gap:
                    firsts.append(i)
                before = at[i]
        merged: list[int] = []  # where the bands begin that are not taken into the one before
        for first, last in zip(firsts, [*firsts[1:], end], strict=True):
            if merged and self.heads(merged[-1], first) and self.heads(first, last):
                height = sorted(self.heights[merged[-1] : first])[(first - merged[-1]) // 2]
                if height > 0 and (at[first] - at[merged[-1]]) / height <= ratio:
                    continue
            merged.append(first)
        sizes = np.diff([*merged, end])
        return np.repeat(np.arange(len(merged)), sizes).tolist()


def _starts(values: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, or such as `apart` tells."""
    return np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | apart)))


def _line_starts(at: np.ndarray, page: np.ndarray, tolerance: float) -> np.ndarray:
    """Where lines begin, by anchor_groups(): only words that lie closer than the tolerance, one after the other, over more
    than it are looked at one by one."""
    with np.errstate(invalid="ignore"):
        starts = _starts(page, np.diff(at) > tolerance)
        ends = np.append(starts[1:], len(at))
        long = np.flatnonzero(~(at[ends - 1] - at[starts] <= tolerance))
    more = [start + _starts(np.array(anchor_groups(at[start:end].tolist(), tolerance)), np.zeros(end - start - 1, bool)) for start, end in zip(starts[long], ends[long], strict=True)]
    return np.unique(np.concatenate([starts, *more]))


def _numbered(batch: pa.Table, tolerance: float, gap: float, ratio: float) -> pa.Table:
    """Words of whole pages, in order of position, with their lines and bands; `_page` counts the pages."""
    column = lambda name, null: pc.fill_null(batch[name], null).to_numpy()
    if batch["pos"].null_count:
        raise ValueError("a word has no position")
    at, page, n = batch["pos"].to_numpy(), batch["_page"].to_numpy(), len(batch)
    alpha, num = column("alpha", False), column("num", False)
    sizes = lambda starts: np.diff(np.append(starts, n))
    lines = _line_starts(at, page, tolerance)
    line = np.repeat(np.arange(len(lines)), sizes(lines))
    first_of_page = _starts(page, np.zeros(n - 1, bool))
    # Bands by distance, then header-like ones a line apart: pages on which two of those are neighbours go one by one.
    bands = lines[_starts(page[lines], np.diff(at[lines]) > gap)]
    heads = lambda starts: (sizes(starts) >= config.MIN_CELLS) & (np.add.reduceat(alpha.astype(int), starts) >= config.MIN_CELLS) & (np.add.reduceat(num.astype(int), starts) <= sizes(starts) // 3)
    head = heads(bands)
    near = np.unique(page[bands[1:][head[1:] & head[:-1] & (page[bands[1:]] == page[bands[:-1]])]])
    if len(near):
        flat = Pages(at.tolist(), batch["height"].to_pylist(), alpha, num)
        own = np.searchsorted(page[first_of_page], near)
        ends = np.append(first_of_page[1:], n)
        kept = [bands[~np.isin(page[bands], near)]]
        for start, end in zip(first_of_page[own].tolist(), ends[own].tolist(), strict=True):
            numbers = np.array(flat.bands(start, end, line[start:end].tolist(), gap, ratio))
            kept.append(start + _starts(numbers, np.zeros(end - start - 1, bool)))
        bands = np.sort(np.concatenate(kept))
    band = np.repeat(np.arange(len(bands)), sizes(bands))
    along = np.lexsort((column("word_no", -(1 << 31)), at, column("lo", -np.inf), line))
    place = np.empty(n, np.int32)
    place[along] = np.arange(n) - lines[line] + 1
    since = np.repeat(first_of_page, sizes(first_of_page))
    for name, values in (
        ("line_no", (line - line[since]).astype(np.int32)), ("band_no", (band - band[since]).astype(np.int32)), ("word_in_line", place),
        ("line_pos", at[lines][line]), ("head", heads(bands)[band]),
    ):
        batch = batch.append_column(name, pa.array(values))
    return batch.drop_columns(["_page"])


def assign_lines(words: DataFrame, tolerance: float = config.LINE_TOL, gap: float = config.BAND_GAP, ratio: float = config.HEADER_MERGE_RATIO, stored: bool = True) -> DataFrame:
    """normalise_axes() words with `line_no, band_no`, `word_in_line`, their order along the line, `line_pos`, the position
    of the line, and `head`, whether the band looks like a header.

    The words of a statement are brought together, in order of its pages, unless they lie so already; batches of whole
    pages go through the two sequential rules as flat columns. The result is stored by statement, as bands, columns and
    cells all start from it; a caller that needs it once leaves that out.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                rest = pa.concat_tables([rest, pa.table(batch)]) if rest is not None else pa.table(batch)
            if rest is None or not rest.num_rows:
                continue
            first = pc.fill_null(pc.equal(rest["_new"], 1), False).to_numpy()
            whole = rest.num_rows if batch is None else int(np.flatnonzero(first)[-1])
            if whole:
                ready = rest.slice(0, whole).combine_chunks()
                ready = ready.append_column("_page", pa.array(np.cumsum(first[:whole]))).drop_columns(["_new"])
                yield from _numbered(ready, tolerance, gap, ratio).to_batches()
                rest = rest.slice(whole)

    alpha, num = F.col("txt").rlike("[A-Za-z]{3}").alias("alpha"), S.to_amount(F.col("txt")).isNotNull().alias("num")
    own = words.select(*PAGE, "pos", "word_no", "lo", "hi", "txt", "height", alpha, num)
    order = Window.partitionBy("stmt_id").orderBy("page_no", "pos", "word_no", "lo", "hi", "txt", "height")
    other = ~F.lag("page_no").over(order).eqNullSafe(F.col("page_no")) | (F.row_number().over(order) == 1)
    placed = own.withColumn("_new", other.cast("int"))
    schema = T.StructType([*own.schema, *T.StructType.fromDDL("line_no int, band_no int, word_in_line int, line_pos double, head boolean")])
    lined = placed.mapInArrow(numbered, schema)
    return settled(lined, "lines", "stmt_id") if stored else lined


def assign_bands(lines: DataFrame, gap: float = config.BAND_GAP) -> DataFrame:
    """lines (`line_no, pos`) with `band_no` by distance alone: a new band where the last line is further away."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(order) > gap, F.lit(False)).cast("int")
    marked = lines.withColumn("_new", apart)
    return marked.withColumn("band_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def band_ends(lined: DataFrame) -> DataFrame:
    """`stmt_id, page_no, band_no, band_end` of all bands."""
    return lined.groupBy(*PAGE, "band_no").agg(F.max("pos").alias("band_end"))


def header_bands(lined: DataFrame) -> DataFrame:
    """`stmt_id, page_no, band_no, band_end` of bands that look like a header: labels, not figures."""
    return band_ends(lined.filter("head"))


def header_columns(lined: DataFrame, bands: DataFrame, gap: float = config.MERGE_GAP) -> DataFrame:
    """`stmt_id, page_no, band_no, col_no, name, lo, hi` of the columns that the words of the bands make."""
    key = [*PAGE, "band_no"]
    words = lined.join(bands.select(*key).hint("shuffle_hash"), key, "left_semi")
    order = Window.partitionBy(*key).orderBy("lo", "hi", "pos", "word_no")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = words.withColumn("_new", F.coalesce(F.col("lo") - reach > gap, F.lit(False)).cast("int"))
    numbered = marked.withColumn("col_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    grouped = numbered.groupBy(*key, "col_no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("pos", "lo", "word_no", "txt"))).alias("_w"))
    name = S.strip(F.replace(F.array_join(F.transform("_w", lambda x: x["txt"]), " "), F.lit("*"), F.lit("")))
    return grouped.select(*key, "col_no", name.alias("name"), "lo", "hi")


def _placed(lined: DataFrame, columns: DataFrame, bands: DataFrame) -> DataFrame:
    """Words below each band with the column of the band that they overlap most (null: none).

    The join is on the page; a band's columns travel as one array, so words meet bands, not columns.
    """
    key = [*PAGE, "band_no"]
    grids = columns.groupBy(*key).agg(F.collect_list(F.struct("col_no", "lo", "hi")).alias("_grid")).join(bands.hint("shuffle_hash"), key)
    grids = grids.withColumnRenamed("band_no", "table_no")
    words = lined.select(*PAGE, "line_no", "line_pos", "word_in_line", "txt", "num", "lo", "hi")
    below = words.join(grids.hint("shuffle_hash"), PAGE).filter(F.col("line_pos") > F.col("band_end"))
    overlap = F.transform("_grid", lambda c: F.struct((F.least(F.col("hi"), c["hi"]) - F.greatest(F.col("lo"), c["lo"])).alias("o"), (-c["col_no"]).alias("c")))
    best = F.array_max(F.filter(overlap, lambda x: x["o"] > 0))
    return below.select(*PAGE, "table_no", "line_no", "word_in_line", "txt", "num", (-best["c"]).alias("col_hit"))


def _filled(lined: DataFrame, columns: DataFrame, bands: DataFrame) -> DataFrame:
    """assign_cells() before repair, with the words that fall into the column (`hits`), those that stay with the word before
    (`misses`) and the figures among the first (`figures`); words before any column are a group of their own (null)."""
    words = _placed(lined, columns, bands)
    line = Window.partitionBy(*PAGE, "table_no", "line_no").orderBy("word_in_line").rowsBetween(Window.unboundedPreceding, 0)
    held = words.withColumn("col_no", F.last("col_hit", ignorenulls=True).over(line))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_in_line", "txt"))), lambda x: x["txt"]), " ")
    hit = F.col("col_hit").isNotNull()
    return held.groupBy(*PAGE, "table_no", "line_no", "col_no").agg(text.alias("value"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(hit & F.col("num")).alias("figures"))


def _repaired(filled: DataFrame) -> DataFrame:
    return filled.filter("col_no IS NOT NULL").select(*PAGE, "table_no", "line_no", "col_no", S.repair_text(F.col("value")).alias("value"))


def assign_cells(lined: DataFrame, columns: DataFrame, bands: DataFrame) -> DataFrame:
    """`stmt_id, page_no, table_no, line_no, col_no, value`: the words below each header band in its columns.

    A word goes where it overlaps most (the first of equals), or stays with the word before it; words before
    any column are dropped.
    """
    return _repaired(_filled(lined, columns, bands))


def match_templates(lined: DataFrame, templates: DataFrame) -> DataFrame:
    """`stmt_id, page_no, band_no, template` of the first band of a statement that holds a template's header words."""
    token = F.regexp_replace(F.lower("txt"), "^[:*]+|[:*]+$", "")
    # A handful of templates, as an array on every band: nothing is joined, and no other words are gathered.
    known = [r.asDict() for r in templates.select("ord", "template", "header_tokens").orderBy("ord").collect()]
    words = lined.select(*PAGE, "band_no", token.alias("_token"))
    if all(t["header_tokens"] for t in known):
        words = words.filter(F.col("_token").isin({x for t in known for x in t["header_tokens"]}))
    bands = words.groupBy(*PAGE, "band_no").agg(F.collect_set("_token").alias("_t"))
    first = F.coalesce(*[F.when(F.size(F.array_except(F.array(*map(F.lit, t["header_tokens"])), "_t")) == 0, F.lit(t["template"])) for t in known], F.lit(None))
    hits = bands.select("stmt_id", "page_no", "band_no", first.alias("template")).filter("template IS NOT NULL")
    return hits.groupBy("stmt_id").agg(F.min(F.struct("page_no", "band_no", "template")).alias("m")).select("stmt_id", "m.*")


def relabel_totals(cells: DataFrame, template: bool = False) -> DataFrame:
    """cells with `total`: in rows that say total the label moves to the first column (0) and leaves where it was."""
    row = [c for c in (*PAGE, "table_no", "line_no") if c in cells.columns]
    says = S.is_total_row(F.col("value"), template)
    labels = cells.filter(says).groupBy(*row).agg(F.min("col_no").alias("_at"))  # few rows: no other is gathered
    joined = cells.join(labels.hint("shuffle_hash"), row, "left").withColumn("total", F.col("_at").isNotNull())
    label = F.coalesce(F.col("col_no") == F.col("_at"), F.lit(False))
    kept = joined.filter(~F.col("total") | label | (~says & (F.col("col_no") != 0)))
    return kept.select(*row, F.when(label, 0).otherwise(F.col("col_no")).alias("col_no"), "value", "total")


def template_rows(cells: DataFrame, matched: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows of matched templates: `total` rows, and data rows whose first cell the template knows; others go.

    matched: match_templates(), so only lines of the header's page count.
    """
    patterns = F.broadcast(templates.select("template", "row_first_cell"))  # a fixed list
    of = matched.join(patterns, "template").select("stmt_id", "page_no", F.col("band_no").alias("table_no"), "template", "row_first_cell").hint("shuffle_hash")
    labelled = relabel_totals(cells.join(of.select("stmt_id", "page_no", "table_no").hint("shuffle_hash"), ["stmt_id", "page_no", "table_no"], "left_semi"), template=True)
    rows = labelled.groupBy(*PAGE, "table_no", "line_no", "total").agg(F.max(F.when(F.col("col_no") == 0, F.col("value"))).alias("first"), F.map_from_entries(F.collect_list(F.struct("col_no", "value"))).alias("cells"))
    judged = rows.join(of, [*PAGE, "table_no"])
    return judged.filter(F.col("total") | F.coalesce(F.rlike(F.col("first"), F.col("row_first_cell")), F.lit(False))).drop("row_first_cell", "first")


def candidate_tables(lined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, cells): every header-like band with three columns or more and how its grid fits the lines below.

    candidates: `stmt_id, page_no, table_no, hits, misses, fused, lines_below`; cells: assign_cells() with
    `total` and `data`, whether the row says total or looks like a transaction.
    """
    bands = header_bands(lined)
    columns = settled(header_columns(lined, bands), "columns", "stmt_id")
    wide = columns.groupBy(*PAGE, "band_no").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= config.MIN_CELLS).drop("n")
    bands = settled(bands.join(wide, [*PAGE, "band_no"], "left_semi"), "bands", "stmt_id")
    words = settled(_filled(lined, columns.join(bands, [*PAGE, "band_no"], "left_semi"), bands), "filled", "stmt_id")
    fit = words.groupBy(*PAGE, "table_no").agg(
        F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.count_if(F.col("figures") >= 2).alias("fused"), F.count_distinct("line_no").alias("lines_below"),
    )
    filled = F.col("value") != ""
    cell = F.struct("col_no", "value")
    rows = relabel_totals(_repaired(words)).groupBy(*PAGE, "table_no", "line_no", "total").agg(
        F.count_if(filled).alias("n"), F.bool_or(S.to_amount(F.col("value")).isNotNull()).alias("f"), F.sort_array(F.collect_list(cell)).alias("_c"),
    )
    text = F.array_join(F.transform(F.filter("_c", lambda x: x["value"] != ""), lambda x: x["value"]), " ")
    data = (F.col("n") >= config.MIN_CELLS) & ~S.is_footer(text) & F.col("f")
    cells = rows.select(*PAGE, "table_no", "line_no", "total", data.alias("data"), F.inline("_c"))
    return fit, settled(cells.select(*PAGE, "table_no", "line_no", "col_no", "value", "total", "data"), "table-cells", "stmt_id")


def pick_layout(fit: DataFrame, cells: DataFrame) -> DataFrame:
    """`stmt_id, page_no, table_no, passing, rows, total_line`: the candidate whose table agrees best with itself.

    By passing column checks, then rows, then few cells with several figures, then words that fall into a
    column; the first seen wins ties. Candidates without data rows are out. The total is the last total row with
    a figure; where no row says total, a last row that the rows above add up to.
    """
    from .totals import split_trailing_total

    table = [*PAGE, "table_no"]
    key = F.concat_ws("|", "stmt_id", F.col("page_no").cast("string"), F.col("table_no").cast("string"))
    marked = cells.withColumn("_key", key)
    number = marked.withColumn("_num", S.to_amount(F.col("value")))
    totals = number.filter("total").groupBy(*table, "line_no").agg(F.bool_or(F.col("_num").isNotNull()).alias("f")).groupBy(*table).agg(F.max(F.struct("f", "line_no"))["line_no"].alias("said"))
    silent = settled(marked.filter("data AND NOT total").join(totals.select(*table).hint("shuffle_hash"), table, "left_anti"), "silent", "stmt_id")
    trailing = split_trailing_total(silent.select(F.col("_key").alias("stmt_id"), F.col("line_no").alias("row_no"), "col_no", "value"))
    added = silent.select(*table, "_key").distinct().join(trailing.select(F.col("stmt_id").alias("_key"), F.col("total_row").alias("added")), "_key").drop("_key")
    added = settled(added, "added")
    at = number.join(totals.hint("shuffle_hash"), table, "left").join(added.hint("shuffle_hash"), table, "left")
    at = at.withColumn("total_line", F.coalesce("said", "added")).withColumn("_row", F.col("data") & ~F.col("total") & ~F.coalesce(F.col("line_no") == F.col("added"), F.lit(False)))
    sums = at.groupBy(*table, "total_line", "col_no").agg(
        F.sum(F.when(F.col("_row"), S.money(F.col("_num")))).alias("rows_sum"), F.max(F.when(F.col("line_no") == F.col("total_line"), F.col("_num"))).alias("stated")
    )
    checks = sums.groupBy(*table, "total_line").agg(F.count_if(S.same_cent(S.cents(F.col("rows_sum")), F.col("stated"))).alias("passing"))
    rows = at.filter("_row").groupBy(*table).agg(F.count_distinct("line_no").alias("rows"))
    fused = F.rint(F.coalesce(F.try_divide(F.col("fused"), F.col("lines_below")), F.lit(0.0)) * 10)
    alignment = F.rint(F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)) / 0.05)
    scored = fit.join(rows, table).join(checks, table).select(*table, "rows", "passing", "total_line", F.struct("passing", "rows", (-fused).alias("f"), alignment.alias("a"), (-F.col("page_no")).alias("p"), (-F.col("table_no")).alias("t")).alias("_s"))
    best = scored.groupBy("stmt_id").agg(F.max_by(F.struct("page_no", "table_no", "passing", "rows", "total_line"), "_s").alias("b"))
    return best.select("stmt_id", "b.*")


def layout_fallback(matched: DataFrame, template_counts: DataFrame, picked: DataFrame) -> DataFrame:
    """`stmt_id, how, template, page_no, table_no`: a template match with rows, else the detected table, else the
    match without rows. template_counts: `stmt_id, rows` of template_rows()."""
    joined = matched.join(template_counts.select("stmt_id", F.col("rows").alias("_n")), "stmt_id", "left").join(
        picked.select("stmt_id", F.col("page_no").alias("_p"), F.col("table_no").alias("_t")), "stmt_id", "full"
    )
    template = F.coalesce(F.col("_n"), F.lit(0)) > 0
    how = F.when(template, "template").when(F.col("_t").isNotNull(), "auto-detected").otherwise("empty template")
    auto = how == "auto-detected"
    return joined.select(
        "stmt_id", how.alias("how"), F.when(~auto, F.col("template")).alias("template"), F.when(auto, F.col("_p")).otherwise(F.col("page_no")).alias("page_no"),
        F.when(auto, F.col("_t")).otherwise(F.col("band_no")).alias("table_no"),
    )


def layout_status(label: Column, how: Column, template: Column, words: Column, checks: Column, passing: Column) -> tuple[Column, Column]:
    """(template label, first warning or null) of a statement read from words."""
    shown = F.when(how == "template", template).when(how == "auto-detected", F.concat(label, F.lit(" (auto-detected)"))).otherwise(F.coalesce(template, F.lit("")))
    warning = (
        F.when(F.coalesce(words, F.lit(0)) == 0, "No text layer - this is an image-only scan.").when(how.isNull(), "Has a text layer but no table could be located.")
        .when(how == "empty template", "The header is known but no data rows matched.").when(checks == 0, "No totals row: figures are unverified.")
        .when(passing < checks, "Does not reconcile with its own totals.")
    )
    return shown, warning
