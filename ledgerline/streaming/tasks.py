"""The life of a task as an ordered fold over its events; what isn't allowed in a state changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (state, event) -> state.
TRANSITIONS = {
    ("pending", "start"): "running",
    ("chunk_complete", "start"): "running",
    ("running", "chunk_done"): "chunk_complete",
    ("running", "finish"): "completed",
    ("running", "fail"): "failed",
    **{(s, "cancel"): "cancelled" for s in ("pending", "running", "chunk_complete")},
    **{(s, "expire"): "interrupted" for s in ("pending", "running", "chunk_complete")},
}


def fold(events: Column) -> Column:
    """struct<state, rejected> after an array of event names."""
    table = F.create_map(*(F.lit(x) for (s, e), t in TRANSITIONS.items() for x in (f"{s}|{e}", t)))

    def merge(acc: Column, event: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("|"), F.coalesce(event, F.lit(""))))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["rejected"] + F.when(to.isNull(), 1).otherwise(0)).alias("rejected"))

    return F.aggregate(events, F.struct(F.lit("pending").alias("state"), F.lit(0).alias("rejected")), merge)


def final_states(events: DataFrame, task: str, order: list[str], event: str) -> DataFrame:
    """(task, state, rejected) after all of each task's events."""
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in order), F.col(event).alias("e"))))
    return events.groupBy(task).agg(fold(F.transform(rows, lambda r: r["e"])).alias("s")).select(task, "s.state", "s.rejected")
