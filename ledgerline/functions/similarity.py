"""Similarity of two strings in whole percents, as Column functions.

An empty string is like nothing, not even another empty one; null counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import tokens


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a column used in many places is a tree copied as often."""
    return F.get(F.transform(F.array(value), use), 0)


def _pair(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))


def _ratio(p: Column, a: str = "a", b: str = "b") -> Column:
    a, b = p[a], p[b]
    percent = F.floor((1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))) * 100 + 0.5)
    return F.when((a == "") | (b == ""), 0).when(a == b, 100).otherwise(percent.cast("int"))


def _token_sort(p: Column) -> Column:
    return _bind(F.struct(*(F.array_join(F.array_sort(tokens(p[c])), " ").alias(c) for c in "ab")), lambda q: _ratio(q))


def _token_set(p: Column) -> Column:
    def joined(q: Column) -> Column:
        return F.struct(*(F.array_join(x, " ").alias(c) for c, x in (("a", q["a"]), ("b", q["b"]), ("both", F.array_sort(F.array_intersect(q["a"], q["b"]))))))

    words = F.struct(*(F.array_sort(F.array_distinct(tokens(p[c]))).alias(c) for c in "ab"))
    return _bind(words, lambda q: _bind(joined(q), lambda r: F.greatest(_ratio(r, "both", "a"), _ratio(r, "both", "b"), _ratio(r))))


def _partial(p: Column) -> Column:
    swap = F.length(p["a"]) > F.length(p["b"])
    ordered = F.struct(F.when(swap, p["b"]).otherwise(p["a"]).alias("short"), F.when(swap, p["a"]).otherwise(p["b"]).alias("long"))

    def best(q: Column) -> Column:
        n = F.length(q["short"])
        windows = F.sequence(F.lit(1), F.length(q["long"]) - n + 1)
        shifted = F.transform(windows, lambda i: F.levenshtein(q["short"], F.substring(q["long"], i, n)))
        # of windows of one length the least distance has the best ratio
        percent = F.floor((1 - F.array_min(shifted) / n) * 100 + 0.5).cast("int")
        return F.when(q["short"] == "", 0).when(F.contains(q["long"], q["short"]), 100).otherwise(percent)

    return _bind(ordered, best)


def _once(measure: Callable) -> Callable:
    """measure, with its tree for two column names built once a JVM: it has hundreds of nodes, each a call."""
    known: dict[tuple, Column] = {}

    @wraps(measure)
    def run(a: Column | str, b: Column | str) -> Column:
        if not (isinstance(a, str) and isinstance(b, str)):
            return measure(a, b)
        key = (a, b, id(SparkContext._gateway))
        if key not in known:
            known[key] = measure(a, b)
        return known[key]

    return run


def ratio(a: Column | str, b: Column | str) -> Column:
    """By edit distance over the longer length, rounded half up."""
    return _bind(_pair(a, b), lambda p: _ratio(p))


@_once
def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """ratio of the words in order of their code points."""
    return _bind(_pair(a, b), _token_sort)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    """The best ratio among the sorted shared words and either side's sorted distinct words."""
    return _bind(_pair(a, b), _token_set)


@_once
def partial_ratio(a: Column | str, b: Column | str) -> Column:
    """The best ratio of the shorter string with a window of its length in the longer one."""
    return _bind(_pair(a, b), _partial)


@_once
def best_ratio(a: Column | str, b: Column | str) -> Column:
    """The best of the four; with an empty string all are 0, and equal strings need none."""

    def best(p: Column) -> Column:
        every = F.greatest(_ratio(p), _token_sort(p), _token_set(p), _partial(p))
        return F.when((p["a"] == "") | (p["b"] == ""), 0).when(p["a"] == p["b"], 100).otherwise(every)

    return _bind(_pair(a, b), best)


def score_distinct(pairs: DataFrame, a: str, b: str, out: str, measure=best_ratio) -> DataFrame:
    """pairs with measure(a, b) as out, computed once for each distinct pair of strings.

    Worth its shuffles where strings repeat, as titles and names do: the measures cost far more than a join.
    """
    keys = pairs.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct().withColumn(out, measure("__a", "__b"))
    return pairs.join(keys, F.col(a).eqNullSafe(F.col("__a")) & F.col(b).eqNullSafe(F.col("__b"))).drop("__a", "__b")
