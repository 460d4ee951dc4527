"""The adaptive delay between requests, as a fold over a client's outcomes in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, LEAST, MOST, STREAK = 50.0, 50.0, 5000.0, 10
SLOWER, FASTER = 2.0, 0.8


def step(delay: float, streak: int, limited: bool) -> tuple[float, int]:
    if limited:
        return min(MOST, delay * SLOWER), 0
    streak += 1
    if streak >= STREAK and delay > LEAST:
        return max(LEAST, delay * FASTER), 0
    return delay, streak


def fold(limited: Column) -> Column:
    """struct<delay, streak> after an array of booleans: doubled when limited, a fifth less after ten successes in a row."""

    def merge(s: Column, hit: Column) -> Column:
        n = s["streak"] + 1
        relax = (n >= STREAK) & (s["delay"] > LEAST)
        delay = F.when(hit, F.least(F.lit(MOST), s["delay"] * SLOWER)).when(relax, F.greatest(F.lit(LEAST), s["delay"] * FASTER)).otherwise(s["delay"])
        return F.struct(delay.alias("delay"), F.when(hit | relax, 0).otherwise(n).alias("streak"))

    return F.aggregate(limited, F.struct(F.lit(FIRST).alias("delay"), F.lit(0).alias("streak")), merge)


def delays(events: DataFrame, client: str = "client", order: str = "seq", limited: str = "limited") -> DataFrame:
    """(client, delay, streak) after all of each client's events, those with a null outcome taken as successes."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(limited, F.lit(False)).alias("hit"))))
    folded = events.groupBy(client).agg(fold(F.transform(rows, lambda r: r["hit"])).alias("s"))
    return folded.select(client, "s.delay", "s.streak")


def streaming_delays(events: DataFrame, client: str = "client", order: str = "seq", limited: str = "limited") -> DataFrame:
    """The same over a stream: the state is kept by client, and each micro-batch gives the clients it changed."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        delay, streak = state.get if state.exists else (FIRST, 0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for hit in rows[limited].fillna(False):
            delay, streak = step(delay, streak, bool(hit))
        state.update((delay, streak))
        yield pd.DataFrame({client: [key[0]], "delay": [delay], "streak": [streak]})

    kind = dict(events.dtypes)[client]
    return events.groupBy(client).applyInPandasWithState(update, f"{client} {kind}, delay double, streak int", "delay double, streak int", "update", "NoTimeout")


def retry_delays(attempts: int = 4, first_ms: int = 1000, limited: bool = False, retry_after_ms: int | None = None) -> list[int]:
    """The waits between attempts: doubling; a limited one waits what it was told, or twice as long."""
    waits, delay = [], first_ms
    for _ in range(attempts - 1):
        waits.append((retry_after_ms if retry_after_ms is not None else 2 * delay) if limited else delay)
        delay *= 2
    return waits


def retries(outcomes: Column, attempts: int = 4, first_ms: int = 1000) -> Column:
    """struct<state, attempts, waited_ms> of a request, from an array of struct<status, retry_after_s> in order.

    "ok" at the first status below 400; "failed" at once at a 4xx but 429; a 429 waits what it was told, or
    twice the delay, which it also sets; all else, a null status among it, waits the delay and doubles it,
    but after the last attempt. Without a success the request has failed; with attempts left it is "open".
    """

    def merge(s: Column, o: Column) -> Column:
        n, status = s["attempts"] + 1, F.coalesce(o["status"], F.lit(599))
        limited = F.coalesce(o["retry_after_s"] * 1000, s["delay"] * 2).cast("bigint")
        last = n >= attempts
        wait = F.when(status < 400, 0).when(status == 429, limited).when((status < 500) | last, 0).otherwise(s["delay"])
        state = F.when(status < 400, "ok").when(last | ((status < 500) & (status != 429)), "failed").otherwise("open")
        after = F.struct(state.alias("state"), n.alias("attempts"), (s["waited_ms"] + wait).alias("waited_ms"), F.when(status == 429, limited).when(status >= 500, s["delay"] * 2).otherwise(s["delay"]).alias("delay"))
        return F.when(s["state"] != "open", s).otherwise(after)

    start = F.struct(F.lit("open").alias("state"), F.lit(0).alias("attempts"), F.lit(0).cast("bigint").alias("waited_ms"), F.lit(first_ms).cast("bigint").alias("delay"))
    return F.aggregate(outcomes, start, merge, lambda s: F.struct(s["state"].alias("state"), s["attempts"].alias("attempts"), s["waited_ms"].alias("waited_ms")))
