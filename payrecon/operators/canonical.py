"""Mapping many column schemas onto one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S


def template_table(spark: SparkSession, templates=config.TEMPLATES) -> DataFrame:
    """Templates as rows: `ord, template, header_tokens, row_first_cell, canonical, base_col, rate_col, result_col`."""
    schema = (
        "ord int, template string, header_tokens array<string>, row_first_cell string, canonical map<string, string>, "
        "base_col string, rate_col string, result_col string"
    )
    rows = [{"ord": i, **t} for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, schema)


def _first_match(names: Column, taken: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern that finds an untaken column decides; among its finds the first column wins."""
    return F.coalesce(*[F.get(F.filter(names, _matcher(p, taken)), F.lit(0)) for p in patterns])


def _matcher(pattern: str, taken: Column):
    def matches(name: Column) -> Column:
        return S.strip(name).rlike(f"(?i){pattern}") & ~F.array_contains(taken, name)

    return matches


def infer_canonical(lists: DataFrame, patterns=config.CANONICAL_PATTERNS, fields=config.CANONICAL_FIELDS) -> DataFrame:
    """`columns` and the column chosen for each canonical field, null where none fits.

    lists: one row per distinct `columns` array, which is what the work depends on: join back on it. Fields
    choose in the order of `patterns`; a column is taken once. Labels of other periods never count.
    """
    state = lists.select("columns", F.filter("columns", lambda c: ~S.excluded_label(c)).alias("_names"), F.array().cast("array<string>").alias("_taken"))
    for i, (_, options) in enumerate(patterns):
        state = state.withColumn(f"_f{i}", _first_match(F.col("_names"), F.col("_taken"), options))
        state = state.withColumn("_taken", F.when(F.col(f"_f{i}").isNull(), F.col("_taken")).otherwise(F.array_append("_taken", F.col(f"_f{i}"))))
    at = {name: f"_f{i}" for i, (name, _) in enumerate(patterns)}
    return state.select("columns", *[F.col(at[f]).alias(f) for f in fields])


def canonical_map(statements: DataFrame, templates=config.TEMPLATES, fields=config.CANONICAL_FIELDS) -> DataFrame:
    """statements (`stmt_id, template, columns`) with `mapping`: one struct field per canonical field.

    A known template names its columns; otherwise they are inferred, once per distinct list of columns.
    """
    known = F.create_map(*[x for t in templates for x in (F.lit(t["template"]), F.create_map(*[F.lit(y) for kv in t["canonical"].items() for y in kv]))])
    named = F.try_element_at(known, F.coalesce(F.col("template"), F.lit("")))
    other = statements.filter(named.isNull()).select("columns").distinct()
    guessed = infer_canonical(other, fields=fields)
    guess = F.struct(*[F.col(f"`{f}`").alias(f) for f in fields])
    guessed = guessed.select(F.col("columns").alias("_columns"), guess.alias("_guess"))
    joined = statements.join(guessed, statements["columns"] == guessed["_columns"], "left")
    told = F.struct(*[F.try_element_at(named, F.lit(f)).alias(f) for f in fields])
    return joined.withColumn("mapping", F.when(named.isNotNull(), told).otherwise(F.col("_guess"))).drop("_columns", "_guess")
