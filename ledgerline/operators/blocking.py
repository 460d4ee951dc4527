"""Candidate generation: the target rows of a query's block whose titles are most like its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.similarity import score_distinct
from ledgerline.storage import cut

CANDIDATES = 15


def top_candidates(queries: DataFrame, targets: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, target_id, rank): for each query the k rows of its block by (title score, target id).

    queries: (query_id, block, title), targets: (target_id, block, title), titles normalised. An empty or
    null block or title asks for nothing. Distinct titles are scored, not rows: of a block's title at most
    k rows can be of use, and a query's title keeps the target titles before which fewer than k rows rank.
    So the work grows with the distinct titles of a block, and only k rows a distinct query are expanded.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.where("block IS NOT NULL AND block != '' AND title IS NOT NULL AND title != ''")

    queries, targets = usable(queries), usable(targets)
    row = F.row_number().over(Window.partitionBy("block", "title").orderBy("target_id"))
    rows = targets.select("target_id", "block", F.col("title").alias("t_title"), row.alias("__r")).where(F.col("__r") <= k)
    titles = rows.groupBy("block", "t_title").agg(F.count("*").alias("n"))
    asked = queries.select("block", F.col("title").alias("q_title")).distinct()
    scored = score_distinct(asked.join(titles, "block"), "q_title", "t_title", "score")
    above = Window.partitionBy("block", "q_title").orderBy(-F.col("score")).rangeBetween(Window.unboundedPreceding, -1)
    near = scored.withColumn("__above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("__above") < k)
    rank = F.row_number().over(Window.partitionBy("block", "q_title").orderBy(F.desc("score"), "target_id"))
    best = near.join(rows, ["block", "t_title"]).select("block", "q_title", "target_id", rank.alias("rank")).where(F.col("rank") <= k)
    return queries.select("query_id", "block", F.col("title").alias("q_title")).join(best, ["block", "q_title"]).select("query_id", "target_id", "rank")


def by_content(items: DataFrame, content: list[str], rows: Callable[[DataFrame, Column], DataFrame], number: str, derived: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(rows of items with the number of their content, the distinct contents with theirs and what is derived from them).

    rows selects from items what differs from one to another, and the key that it is given. Nulls are equal.
    """
    key = F.struct(*content).alias("__key")
    every = items.select(key).distinct().select("__key", "__key.*", F.monotonically_increasing_id().alias(number))
    contents = cut(every.select("__key", number, *derived))
    return rows(items, key).join(contents.select("__key", number), "__key").drop("__key"), contents.drop("__key")
