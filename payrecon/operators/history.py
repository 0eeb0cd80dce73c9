"""The history of statements: keep, find, compare, choose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def upsert_statements(history: DataFrame, new: DataFrame, id_col: str = "id", time_col: str = "uploaded_at") -> DataFrame:
    """history with the rows of new inserted or put in the place of those with the same id; of several new ones
    with an id the latest counts. Write it to a new path: the rows that stay are not rewritten by key."""
    row = F.struct(*new.columns)
    latest = new.groupBy(id_col).agg(F.max_by(row, F.col(time_col)).alias("_r")).select("_r.*")
    return history.join(new.select(id_col), id_col, "left_anti").unionByName(latest)


def summary(payload: DataFrame) -> DataFrame:
    """The listing's columns out of a statement's payload: `row_count, failsafe, exported_total` by id."""
    doc = F.from_json("payload", "filename string, template string, rows array<map<string,string>>, payout struct<status: string, exported_total: double>")
    return payload.withColumn("_p", doc).select(
        "id", F.col("_p.filename").alias("filename"), F.col("_p.template").alias("carrier"), F.coalesce(F.array_size("_p.rows"), F.lit(0)).alias("row_count"),
        F.coalesce("_p.payout.status", F.lit("")).alias("failsafe"), F.col("_p.payout.exported_total").alias("exported_total"),
    )


def _shown_name() -> Column:
    return F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.nullif(F.col("email"), F.lit("")), F.lit(""))


def with_uploader(history: DataFrame, users: DataFrame) -> DataFrame:
    """history with `uploaded_by`: display name, else e-mail, else ""."""
    who = users.select(F.col("id").alias("_uid"), _shown_name().alias("uploaded_by"))
    joined = history.join(who, history["user_id"] == F.col("_uid"), "left")
    return joined.drop("_uid").withColumn("uploaded_by", F.coalesce("uploaded_by", F.lit("")))


def duplicate_of(new: DataFrame, history: DataFrame) -> DataFrame:
    """new with `duplicate`: the earliest statement of the history with the same content, if any.

    An empty hash never matches, and is dropped before anything is grouped by it.
    """
    known = history.filter(F.coalesce(F.col("source_sha256") != "", F.lit(False)))
    first = known.groupBy("source_sha256").agg(F.min(F.struct("uploaded_at", "id", "filename", "uploaded_by")).alias("duplicate"))
    return new.join(first, "source_sha256", "left")


def earlier_copies(history: DataFrame) -> DataFrame:
    """`id, first_id` of every statement whose content an earlier one of the history has."""
    known = history.filter(F.coalesce(F.col("source_sha256") != "", F.lit(False))).select("id", "source_sha256", "uploaded_at")
    first = known.groupBy("source_sha256").agg(F.min(F.struct("uploaded_at", "id")).alias("_f"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return known.join(first, "source_sha256").filter(F.col("id") != F.col("_f.id")).select("id", F.col("_f.id").alias("first_id"))


def matching(history: DataFrame, search: str = "", failsafe: str = "", uploader: int | None = None, since=None) -> DataFrame:
    """The statements a search finds. `%` and `_` in the words searched for stay wildcards."""
    out = history
    if search:
        out = out.filter(F.col("filename").ilike(f"%{search}%") | F.col("carrier").ilike(f"%{search}%"))
    if failsafe:
        out = out.filter(F.col("failsafe") == failsafe)
    if uploader is not None:
        out = out.filter(F.col("user_id") == uploader)
    if since is not None:
        out = out.filter(F.col("uploaded_at") >= F.lit(since))
    return out


def list_history(history: DataFrame, users: DataFrame, limit: int = 50, offset: int = 0, **search) -> tuple[DataFrame, DataFrame]:
    """(a page of summaries, newest first, without payloads; the count of all matches).

    The page is a top-k, not a sort of the history; names are joined to the page alone.
    """
    found = matching(history, **search)
    page = found.orderBy(F.desc("uploaded_at"), "id").offset(offset).limit(min(limit, config.PAGE_LIMIT))
    shown = with_uploader(page, users).select("id", "filename", "carrier", "uploaded_at", "row_count", "failsafe", "exported_total", "uploaded_by")
    return shown, found.agg(F.count(F.lit(1)).alias("total"))


def recent_ids(history: DataFrame, user_id: int | None, now, hours: int = config.RECENT_HOURS) -> DataFrame:
    """`id, uploaded_at` of one uploader's (null: nobody's) statements of the last hours before `now`, oldest
    first: a working set of one person's day."""
    since = F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return history.filter(F.col("user_id").eqNullSafe(F.lit(user_id)) & (F.col("uploaded_at") >= since)).select("id", "uploaded_at").orderBy("uploaded_at", "id")


def delete_statements(history: DataFrame, ids: DataFrame) -> DataFrame:
    """history without the statements whose `id` is listed."""
    return history.join(ids.select("id"), "id", "left_anti")


def found_ids(history: DataFrame, ids: DataFrame) -> DataFrame:
    """`id` of the listed statements that there are: those that delete_statements() takes out; none if that does nothing."""
    return history.join(ids.select("id"), "id", "left_semi").select("id").distinct()


def distinct_carriers(history: DataFrame) -> DataFrame:
    """The carriers that have a name, by name."""
    return history.filter(F.col("carrier") != "").select("carrier").distinct().orderBy("carrier")


def select_statements(history: DataFrame, ids: DataFrame) -> DataFrame:
    """The statements listed in ids (`id, ord`), with `ord`; ids nobody has are left out."""
    return history.join(ids.select("id", "ord"), "id")
