"""How often plans move rows: partitions that lie by statement stay where they are."""

import numpy as np
import pytest

from payrecon import config
from payrecon.operators import layout
from payrecon.plans import delimited_queries as D
from payrecon.plans import history_queries as H
from payrecon.plans import inputs as I
from payrecon.plans import layout_queries as L
from payrecon.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def joins_that_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["assign_lines", "merge_header_bands", "normalise_axes"])
def test_words_are_not_moved(spark, joins_that_shuffle, name):
    # Lines, orders (twice) and customers are; words are made where their lines lie.
    assert moves(L.QUERIES[name](spark, SF)) <= 4


@pytest.mark.parametrize("name", ["header_columns", "assign_cells"])
def test_stored_words_are_not_moved(spark, joins_that_shuffle, name):
    assert moves(L.QUERIES[name](spark, SF)) == 0


def test_templates_gather_their_own_words_alone(spark, joins_that_shuffle):
    assert moves(L.match_templates(spark, SF)) <= 6


def test_candidates_and_layouts_move_no_cells(spark, joins_that_shuffle):
    fit, cells = layout.candidate_tables(L._lined(spark, SF, L.VARIED))
    assert moves(fit) == 0 and fit.count() > 0
    assert moves(L._template_rows(spark, SF)[2]) <= 2  # the matched headers
    assert moves(layout.pick_layout(fit, cells)) <= 8  # totals that no row names


def test_boxes_are_those_of_the_sql(spark):
    made, told = L.boxes(I.stmt_rows(spark, SF)), I.view(spark, SF, L.BOXES)
    told = told.selectExpr("stmt_id", "k", "w", "text", "cast(lo AS double) lo", "cast(hi AS double) hi", "cast(base AS double) base")
    assert made.count() == told.count() and made.exceptAll(told).isEmpty()


def test_lines_close_to_each_other_follow_their_first_word():
    rng = np.random.default_rng(5)
    page = np.sort(rng.integers(0, 40, 900))
    at = np.concatenate([np.sort(rng.uniform(0, 60, n)) for n in np.unique(page, return_counts=True)[1]])
    starts = set(layout._line_starts(at, page, config.LINE_TOL).tolist())
    told, n = set(), 0
    for p in np.unique(page):
        own = layout.anchor_groups(at[page == p].tolist(), config.LINE_TOL)
        told |= {n + i for i in range(len(own)) if not i or own[i] != own[i - 1]}
        n += len(own)
    assert starts == told


def test_a_released_table_is_gone(spark):
    mark = len(store.made_paths(spark))
    made = store.settled(spark.range(20).selectExpr("cast(id AS string) stmt_id").repartition("stmt_id"), "rows", "stmt_id")
    path = store.made_paths(spark)[-1]
    assert made.count() == 20 and path in store._TABLES
    store.release(spark, mark)
    assert path not in store._TABLES and not [t for t in spark.catalog.listTables() if t.name.endswith(path[-32:])]


@pytest.mark.parametrize("name", ["clean_cells", "percent_scale"])
def test_cleaned_cells_are_not_moved(spark, joins_that_shuffle, name):
    assert moves(D.QUERIES[name](spark, SF)) == 0


def test_raw_rows_are_those_of_the_sql(spark):
    made, told = D.raw_rows(I.stmt_rows(spark, SF)), I.view(spark, SF, D.RAW_ROWS)
    assert made.count() == told.count() and made.exceptAll(told).isEmpty()


def test_closed_rows_are_those_of_the_sql(spark):
    made, told = I.closed_rows(I.stmt_rows(spark, SF)), I.view(spark, SF, I.CLOSED_ROWS)
    assert made.count() == told.count() and made.exceptAll(told).isEmpty()


def test_notes_move_no_cells(spark, joins_that_shuffle):
    # What the three kinds of notes join are a few rows a statement.
    assert moves(D.cleanup_notes(spark, SF)) == 0


def test_payloads_move_rows_once(spark, joins_that_shuffle):
    before = len(store.made_paths(spark))
    H.payload_round_trip(spark, SF)
    assert sum("statement-rows" in p for p in store.made_paths(spark)[before:]) == 1
