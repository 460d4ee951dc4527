"""Packing documents into training sequences of a fixed capacity, by a linear grouping scheme.

Lengths are tokens. Documents longer than the capacity are cut into full sequences and a rest. In every
shard of about SHARD_PIECES pieces:

1. pieces over SMALL of the capacity are sorted and cut into GROUPS groups of equal cardinality, and
   their lengths rounded up to the greatest of the group;
2. the few sizes are packed by configurations: the linear program over all of them is solved by column
   generation, its pricing an exact knapsack; whole multiples of its configurations are opened;
3. actual pieces take the configurations' places; those that the fractions left over go best-fit,
   longest first, into the room that actual lengths leave, or into new sequences;
4. small pieces go best-fit, longest first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tokenizer import DEFAULT_PATH, encoding
from ledgerline.storage import cut

CAPACITY = 2048
GROUPS = 32
SMALL = 1 / 8
SHARD_PIECES = 100_000
_SCHEMA = "doc_id bigint, piece int, start bigint, n_tokens int, sequence_id bigint, offset int"


def _pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of at most that many sizes within the capacity."""
    best, took = np.zeros((most + 1, capacity + 1)), np.zeros((most + 1, capacity + 1), np.int64)
    for m in range(1, most + 1):
        best[m], took[m] = best[m - 1], -1
        for i, s in enumerate(sizes):
            value = best[m - 1, : capacity + 1 - s] + prices[i]
            better = value > best[m, s:] + 1e-12
            best[m, s:][better], took[m, s:][better] = value[better], i
    out, room, m = np.zeros(len(sizes), np.int64), capacity, most
    while m:
        i = took[m, room]
        if i >= 0:
            out[i] += 1
            room -= sizes[i]
        m -= 1
    return float(best[most, capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used): the least sequences in all, fractions allowed.

    Columns are added until none could lower the number of sequences. The demand is perturbed while they
    are chosen, so that every exchange lowers it and none is made twice: the loop ends by itself, with
    the optimal basis.
    """
    k = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    most = max(1, int(capacity // sizes.min()))
    wanted = demand + 1e-6 * (1 + np.arange(k) / k + np.random.default_rng(5).random(k)) * max(1.0, float(demand.max()))
    before = np.inf
    while True:
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, column = _pattern(prices, sizes, capacity, most)
        used = np.linalg.solve(basis, wanted)
        total = used.sum()
        if value <= 1 + 1e-7 or total >= before:  # nothing to gain, or less than a double can tell
            break
        before = total
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return basis.round().astype(np.int64), np.maximum(0, np.linalg.solve(basis, demand.astype(float)))


class _Rooms:
    """Open sequences by the room left in them; the least room that is enough is found in a bit set."""

    def __init__(self, room: np.ndarray):
        self.by_room: dict[int, list[int]] = {}
        self.open, self.n = 0, len(room)
        for r in np.unique(room[room > 0]):
            self.by_room[int(r)] = np.flatnonzero(room == r)[::-1].tolist()
            self.open |= 1 << int(r)

    def put(self, size: int, capacity: int) -> int:
        high = self.open >> size
        if high:
            room = size + (high & -high).bit_length() - 1
            bins = self.by_room[room]
            home = bins.pop()
            if not bins:
                self.open &= ~(1 << room)
        else:
            home, room = self.n, capacity
            self.n += 1
        if left := room - size:
            self.by_room.setdefault(left, []).append(home)
            self.open |= 1 << left
        return home


def pack(sizes: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> np.ndarray:
    """The sequence of each piece; sizes lie in 1 .. capacity."""
    order = np.argsort(-sizes, kind="stable")
    home = np.full(len(sizes), -1, np.int64)
    large = order[sizes[order] > small * capacity]
    room = np.zeros(0, np.int64)
    if len(large):
        k = min(groups, len(large))
        member = np.arange(len(large)) * k // len(large)
        rounded = sizes[large[np.searchsorted(member, np.arange(k))]]
        sized, back = np.unique(rounded, return_inverse=True)
        kind = back[member]
        demand = np.bincount(kind, minlength=len(sized))
        patterns, used = configurations(sized, demand, capacity)
        queue = [large[kind == i] for i in range(len(sized))]
        taken, n = np.zeros(len(sized), np.int64), 0
        for p in np.argsort(-used, kind="stable"):
            times = int(used[p] + 1e-6)
            for i in np.flatnonzero(patterns[:, p]):
                places = np.repeat(np.arange(n, n + times), patterns[i, p])[: len(queue[i]) - taken[i]]
                home[queue[i][taken[i] : taken[i] + len(places)]] = places
                taken[i] += len(places)
            n += times
        placed = home >= 0
        room = capacity - np.bincount(home[placed], weights=sizes[placed], minlength=n).astype(np.int64)
        empty = room == capacity
        if empty.any():  # configurations whose pieces had run out
            renumber = np.cumsum(~empty) - 1
            home[placed], room = renumber[home[placed]], room[~empty]
    rooms = _Rooms(room)
    for x in order[home[order] < 0].tolist():
        home[x] = rooms.put(int(sizes[x]), capacity)
    return home


def _shard(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        ids, n = group.column("doc_id"), group.column("n").to_numpy()
        order = np.lexsort((ids.fill_null(-(2**63)).to_numpy(), -n))
        n = n[order]
        pieces = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[row] - piece * capacity, capacity)
        home = np.full(len(row), -1, np.int64)
        home[size > 0] = pack(size[size > 0], capacity)
        by_home = np.lexsort((piece, row, home))
        before = np.cumsum(size[by_home]) - size[by_home]
        first = np.concatenate([[True], np.diff(home[by_home]) != 0])
        offset = np.empty(len(row), np.int64)
        offset[by_home] = before - np.maximum.accumulate(np.where(first, before, 0))
        return pa.table(
            {
                "doc_id": ids.take(pa.array(order[row])).combine_chunks() if len(row) else ids,
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(piece * capacity, pa.int64()),
                "n_tokens": pa.array(size, pa.int32()),
                "sequence_id": pa.array((np.int64(shard) << 32) + home, mask=home < 0),
                "offset": pa.array(offset, pa.int32(), mask=home < 0),
            }
        )

    return run


def token_count(path: str = DEFAULT_PATH):
    """A column function: how many tokens a text has; null for a null."""

    @F.pandas_udf("bigint")
    def count(text: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in text], dtype="Int64")

    return count


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, length: Column | None = None, tokenizer_path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, piece, start, n_tokens, sequence_id, offset): each piece's place in a sequence.

    Every token of every document is in one piece, and no sequence holds more than capacity tokens. A
    piece is n_tokens tokens of its document from start on, and lies at offset in its sequence. length
    takes the place of the tokenizer's count where it is given. Null and empty texts, and lengths of 0 or
    less, give one row with 0 tokens and neither sequence nor offset. Rows that repeat, and rows with a
    null id, are packed one by one. Ties go by id. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    n = token_count(tokenizer_path)(F.col(text_col).cast("string")) if length is None else length
    counted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.greatest(F.coalesce(n.cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    # rows with a null id are spread by a number of their own, which the table in the shared folder fixes
    counted = cut(counted.withColumn("spread", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))
    pieces = counted.agg(F.sum(F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, math.ceil(pieces / SHARD_PIECES))
    return counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "spread"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_shard(capacity), _SCHEMA)
