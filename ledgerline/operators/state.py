"""Keyed state tables as pure functions: the new table from the old one and its changes.

Nothing is updated in place. publish writes the new table beside the old one and moves it there.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import schemas


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last by order; null keys are keys like others."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("__k", last).where("__k = 1").drop("__k")


def removed_count(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many rows keep_last removes."""
    return df.groupBy(*key).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("removed"))


def upsert(base: DataFrame, updates: DataFrame, key: list[str], rules: Mapping[str, Column | str] | None = None) -> DataFrame:
    """base with the rows of updates inserted, or put over the row of their key.

    updates has one row a key. For a column in rules a row that is there keeps its value ("keep") or gets
    that expression over old.* and new.*; other columns take the update's value. A column that updates
    lacks is kept, and null in rows that are new.
    """
    rules = dict(rules or {})
    same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    old, new = base.withColumn("__old", F.lit(True)), updates.withColumn("__new", F.lit(True))
    joined = old.alias("old").join(new.alias("new"), on, "full")
    there, given = F.col("old.__old").isNotNull(), F.col("new.__new").isNotNull()

    def value(c: str) -> Column:
        if c not in updates.columns:
            return F.col(f"old.{c}")
        rule = rules.get(c)
        both = F.col(f"new.{c}") if rule is None else F.col(f"old.{c}") if isinstance(rule, str) else rule
        return F.when(there & given, both).when(given, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    return joined.select(*(value(c).alias(c) for c in base.columns))


def update(base: DataFrame, updates: DataFrame, key: list[str], null_keeps: bool = True) -> DataFrame:
    """base with the columns of updates put over the rows of their key; no row is inserted.

    With null_keeps a null in an update leaves the old value, else it replaces it.
    """
    set_ = [c for c in updates.columns if c not in key]
    new = updates.select(*key, F.struct(*set_).alias("__set"))
    joined = base.join(new, key, "left")
    hit = F.col("__set").isNotNull()

    def value(c: str) -> Column:
        if c not in set_:
            return F.col(c)
        given = F.col(f"__set.{c}")
        return F.when(hit, F.coalesce(given, F.col(c)) if null_keeps else given).otherwise(F.col(c)).alias(c)

    return joined.select(*(value(c) for c in base.columns))


def delete(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key).distinct(), key, "left_anti")


def append_with_ids(base: DataFrame, rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """base and rows, which get the ids after base's greatest, in that order.

    New rows are few at a time (runs, tasks): they are numbered in one partition.
    """
    first = base.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("__max"))
    numbered = rows.withColumn("__n", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(first))
    return base.unionByName(numbered.withColumn(id_col, F.col("__max") + F.col("__n")).drop("__n", "__max").select(*base.columns))


def mark_synced(ledger: DataFrame, unmatched: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger with done upserted, unmatched without done's keys)."""
    return upsert(ledger, done, schemas.LEDGER_KEY), delete(unmatched, done, schemas.LEDGER_KEY)


def save_unmatched(unmatched: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert that leaves status, resolution and time of creation of rows that are there."""
    return upsert(unmatched, rows, schemas.LEDGER_KEY, {"status": "keep", "resolved_target_id": "keep", "created_at": "keep"})


def resolve(ledger: DataFrame, unmatched: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A reviewer's choice: into the ledger, out of the queue. Target ids that can't be ids are left out."""
    from ledgerline.functions.text import is_source_id, is_target_track_id

    valid = chosen.where(is_target_track_id(F.col("target_id")) & is_source_id(F.col("source_id")))
    return mark_synced(ledger, unmatched, valid)


def dismiss(unmatched: DataFrame, keys: DataFrame) -> DataFrame:
    return update(unmatched, keys.select(*schemas.LEDGER_KEY).distinct().withColumn("status", F.lit("dismissed")), schemas.LEDGER_KEY)


def review_page(unmatched: DataFrame, order: list[Column], limit: int = 100, offset: int = 0, status: str = "pending", sync_type: str | None = None) -> DataFrame:
    """A page of the queue with the total of its rows; limit within 1 .. 500, offset from 0."""
    rows = unmatched.where(F.col("status") == status)
    if sync_type is not None:
        rows = rows.where(F.col("sync_type") == sync_type)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), 500))
    return page.crossJoin(F.broadcast(total))


def latest(df: DataFrame, order: list[Column], limit: int = 20, per: list[str] | None = None) -> DataFrame:
    """The first limit rows by order, of all or per key."""
    if per is None:
        return df.orderBy(*order).limit(limit)
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("__k") <= limit).drop("__k")


def running_task(tasks: DataFrame) -> DataFrame:
    """Each user's latest task that is under way."""
    return latest(tasks.where(F.col("status").isin(*schemas.LIVE_TASK_STATUSES)), [F.desc("created_at"), F.desc("id")], 1, ["user_id"])


def expire_tasks(tasks: DataFrame, runs: DataFrame, as_of: Column, minutes: int = 10) -> tuple[DataFrame, DataFrame]:
    """Tasks under way without an update for that long are interrupted, and so are their runs if still running."""
    stale = F.col("status").isin(*schemas.LIVE_TASK_STATUSES) & (F.col("updated_at") < as_of - F.make_interval(mins=F.lit(minutes)))
    hit = tasks.where(stale).select(F.col("run_id").alias("__run")).where("__run IS NOT NULL").distinct()
    ended = runs.join(hit, runs["id"] == hit["__run"], "left")
    gone = F.col("__run").isNotNull() & (F.col("status") == "running")
    new_runs = ended.withColumn("completed_at", F.when(gone, as_of).otherwise(F.col("completed_at"))).withColumn("status", F.when(gone, "interrupted").otherwise(F.col("status"))).select(*runs.columns)
    new_tasks = tasks.withColumn("__stale", stale).withColumn("status", F.when(F.col("__stale"), "interrupted").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("__stale"), as_of).otherwise(F.col("updated_at"))).drop("__stale")
    return new_tasks, new_runs


def unexpired(df: DataFrame, as_of: Column, column: str = "expires_at") -> DataFrame:
    return df.where(F.col(column) > as_of)


def migrate(spark: SparkSession, versions: DataFrame, steps: list[tuple[int, str]], as_of: Column) -> DataFrame:
    """versions with the steps later than its greatest one, in order: what is still to be applied is new in it."""
    current = versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]
    pending = sorted(s for s in steps if s[0] > current)
    rows = spark.createDataFrame(pending, "version int, name string").withColumn("applied_at", as_of)
    return versions.unionByName(rows.select(*versions.columns))


def parse_json(column: Column | str, schema: str) -> Column:
    """The typed value of a JSON text; null where it can't be read."""
    s = F.col(column) if isinstance(column, str) else column
    return F.when(F.try_parse_json(s).isNotNull(), F.from_json(s, schema))


def merge_status(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Tasks with their run's counters, which chunks that are done have settled.

    They count where the task isn't running, or has told none of its own while the run has some; else
    what the task's progress says does. What neither knows is 0.
    """
    names = ["tracks_matched", "tracks_not_matched"]
    run = runs.select(F.col("id").alias("run_id"), F.col("status").alias("run_status"), *(F.coalesce(c, F.lit(0)).alias(f"__{c}") for c in names))
    joined = tasks.withColumn("__p", parse_json("progress_json", ", ".join(f"{c} int" for c in names))).join(run, "run_id", "left")
    told = F.coalesce("__p.tracks_matched", "__p.tracks_not_matched").isNotNull()
    some = (F.col("__tracks_matched") > 0) | (F.col("__tracks_not_matched") > 0)
    settled = F.coalesce(F.col("run_status").isNotNull() & ((F.col("status") != "running") | (~told & some)), F.lit(False))
    return joined.select("id", "user_id", "run_id", "status", "run_status", *(F.when(settled, F.col(f"__{c}")).otherwise(F.coalesce(f"__p.{c}", F.lit(0))).alias(c) for c in names))


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes df as the table at path, also where df reads that table: beside it first, then in its place."""
    spark = df.sparkSession
    beside, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(beside)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    system = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(Path(old), True)
    if system.exists(Path(path)):
        system.rename(Path(path), Path(old))
    system.rename(Path(beside), Path(path))
    system.delete(Path(old), True)
