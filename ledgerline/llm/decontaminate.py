"""Benchmark decontamination: windows of documents near an item in edit distance.

Texts are sequences of words. The CGK embedding walks a sequence with random bits: at step j it puts out
the word at the pointer and then moves on or not, by a random bit drawn for (j, word). Sequences at a
small edit distance give walks that meet again soon after an edit, so their outputs differ in few places.
Sampling a few outputs is a locality-sensitive hash for the Hamming distance of the outputs; every
window start of every document is hashed, over several walks and samples, against the items. Windows
that share a hash with an item are verified by exact edit distance over the words around them.

Items are grouped by length, from 2^k to 2^(k+1) - 1 words: the walk of a group takes 2^k steps, so it
never leaves a window of the item's size. The number of repetitions of a group follows from its own
items: edited copies at the highest distance allowed are drawn from a fixed seed, and repetitions are
added until the share of them that is hit reaches the target recall at every length of item. Lengths that
don't reach it in MAX_REPETITIONS are also searched exactly: an item with at most e edits, cut into e + 1
pieces, has one of them unchanged, so that every place of every piece is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.memory import give_back
from ledgerline.llm.words import blocks, mix, text_buffer, words
from ledgerline.storage import cut

#: A window matches at an edit distance of up to this share of the item's words, rounded down.
MAX_EDITS = 0.15
TARGET_RECALL = 0.95
#: Outputs in one hash, at most; short walks have fewer.
SAMPLES = 3
#: From so many repetitions on, items of a length that still misses the target are searched exactly instead.
MAX_REPETITIONS = 64
#: Edited copies drawn for a group of lengths, and for each length in it, at least.
TRIES, TRIES_A_LENGTH = 2000, 100
#: Items that one pass over the documents is held against; more items take more passes.
ITEMS_A_PASS = 20_000
_U = np.uint64
_RESULT = "doc_id bigint, item_id bigint, distance int, n_words int, start_word bigint, end_word bigint"
_NAMES = ["doc_id", "item_id", "distance", "n_words", "start_word", "end_word"]


def allowed(n: np.ndarray | int, max_edits: float) -> np.ndarray | int:
    return np.floor(np.asarray(n) * max_edits + 1e-9).astype(np.int64)


@dataclass
class Repetition:
    """One walk with the steps whose outputs are sampled, and the items by what they put out there."""

    salt: int
    steps: list[int]
    members: list[np.ndarray] = field(default_factory=list)  # for each step, a bitmap over 16 bits or more of the words that items put out
    keys: np.ndarray | None = None  # sorted hashes of the items' samples
    items: np.ndarray | None = None  # their places in the group


def _walk(hashes: np.ndarray, starts: np.ndarray, salt: int, upto: int, bits: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(j, pointers before step j) for j = 0 .. upto, for walks from starts; past the end pointers stay put."""
    bits = mix(hashes, salt) if bits is None else bits
    at, last = starts.copy(), len(hashes) - 1
    for j in range(upto + 1):
        yield j, at
        if j < upto:
            at = np.minimum(at + ((bits[at] >> _U(j % 64)) & _U(1)).astype(at.dtype), last)
            if j % 64 == 63:
                bits = mix(bits, 5)


def _samples(hashes: np.ndarray, rep: Repetition) -> list[np.ndarray]:
    return [hashes[at] for j, at in _walk(hashes, np.zeros(1, np.int64), rep.salt, rep.steps[-1]) if j in rep.steps]


def _key(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(parts[0]), 0x1234567, np.uint64)
    for p in parts:
        out = mix(out ^ p, 3)
    return out


def _stretches(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on where there are so many."""
    size = max(0, len(hashes) - n + 1)
    return _key([hashes[k : k + size] for k in range(n)])


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    words_ = item.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(words_))), int(rng.integers(3))
        new = int(rng.integers(1, 2**63))
        if kind == 0:
            words_[at] = new
        elif kind == 1:
            words_.insert(at, new)
        elif len(words_) > 1:
            del words_[at]
    return np.array(words_, np.uint64)


class Index:
    """Items of one pass: word hashes by group of lengths, with the repetitions of each group.

    Repetition r of every group takes the same walk, which is then made once for all groups.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], max_edits: float = MAX_EDITS, target: float = TARGET_RECALL):
        self.max_edits = max_edits
        self.groups: list[tuple[list[tuple[int, np.ndarray]], list[Repetition]]] = []
        self.pieces: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = []  # for each group, by length: sorted hashes, places of items, first words
        sizes = np.array([len(w) for _, w in items], np.int64)
        for k in sorted({int(n).bit_length() - 1 for n in sizes}):
            own = [x for x in items if len(x[1]).bit_length() - 1 == k]
            reps, short = self._repetitions(own, 1 << k, target)
            self.groups.append((own, reps))
            self.pieces.append(self._pieces([k for k, (_, w) in enumerate(own) if len(w) in short], own))
        entries = [mix(w ^ _U(k)) for own, _ in self.groups for k, (_, w) in enumerate(own)]
        self.belongs = np.zeros(1 << max(16, (16 * sum(map(len, entries))).bit_length()), bool)
        for e in entries:
            self.belongs[(e & _U(len(self.belongs) - 1)).astype(np.int64)] = True

    def possible(self, who: np.ndarray, n: np.ndarray, spare: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows whose stretch holds at least n - spare words of the item: no other can be within spare edits."""
        size = high - low
        row = np.repeat(np.arange(len(who)), size)
        word = text[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]]
        hit = self.belongs[(mix(word ^ who[row].astype(np.uint64)) & _U(len(self.belongs) - 1)).astype(np.int64)]
        return np.flatnonzero(np.bincount(row[hit], minlength=len(who)) >= n - spare)

    def _repetitions(self, items: list[tuple[int, np.ndarray]], steps: int, target: float) -> tuple[list[Repetition], set[int]]:
        """The repetitions, and the lengths of items for which they don't reach the target."""
        rng = np.random.default_rng(1009 + steps)
        count = np.bincount([len(w) for _, w in items])
        tries = [(k, _edited(w, int(allowed(len(w), self.max_edits)), rng)) for k, (_, w) in enumerate(items) for _ in range(max(1, TRIES // len(items), -(-TRIES_A_LENGTH // int(count[len(w)]))))]
        missed, reps = np.ones(len(tries), bool), []
        lengths, of = np.unique([len(items[k][1]) for k, _ in tries], return_inverse=True)
        short = lambda: np.bincount(of, missed) > (1 - target) * np.bincount(of)
        bitmap = max(1 << 16, 1 << (8 * len(items)).bit_length())
        while short().any() and len(reps) < MAX_REPETITIONS:
            early = int(rng.integers(steps // 4 if steps > 4 else steps))  # an early output is among them: most starts are ruled out by it
            chosen = sorted([early, *rng.choice(np.delete(np.arange(steps), early), min(SAMPLES, steps) - 1, replace=False).tolist()])
            rep = Repetition(101 + len(reps), chosen)
            outputs = [_samples(w, rep) for _, w in items]
            keys = np.concatenate([_key(o) for o in outputs])
            for s in range(len(chosen)):
                member = np.zeros(bitmap, bool)
                member[(np.concatenate([o[s] for o in outputs]) & _U(bitmap - 1)).astype(np.int64)] = True
                rep.members.append(member)
            order = np.argsort(keys, kind="stable")
            rep.keys, rep.items = keys[order], order
            for t in np.flatnonzero(missed):
                k, edited = tries[t]
                missed[t] = len(edited) == 0 or _key(_samples(edited, rep))[0] != keys[k]
            reps.append(rep)
        return reps, set(lengths[short()].tolist())

    def _pieces(self, which: list[int], items: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k in which:
            own = items[k][1]
            cuts = np.linspace(0, len(own), int(allowed(len(own), self.max_edits)) + 2).astype(np.int64).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    found.setdefault(b - a, []).append((int(_stretches(own[a:b], b - a)[0]), k, a))
        return {n: (np.array([x[0] for x in rows], np.uint64), *(np.array([x[c] for x in rows], np.int64) for c in (1, 2))) for n, rows in ((n, sorted(rows)) for n, rows in found.items())}

    def _exact(self, g: int, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Starts of windows that hold a piece of an item of group g at its place, as item << 40 | start."""
        for n, (keys, which, first) in self.pieces[g].items():
            own = _stretches(hashes, n)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            at = np.flatnonzero(high > low)
            times = (high - low)[at]
            row = np.repeat(low[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at = np.repeat(at, times)
            start = np.maximum(at - first[row], bounds[np.searchsorted(bounds, at, side="right") - 1])
            yield (which[row] << 40) | start

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray | None = None) -> Iterator[tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]]:
        """For each group its items, and (place of an item, window start) wherever a hash is shared; bounds: of the texts in hashes."""
        found: list[list[np.ndarray]] = [list(self._exact(g, hashes, np.array([0, len(hashes)]) if bounds is None else bounds)) for g in range(len(self.groups))]
        rounds = max((len(reps) for _, reps in self.groups), default=0)
        firsts = [reps[r].steps[0] for _, reps in self.groups for r in range(len(reps))]
        padded = np.concatenate([hashes, np.zeros(max([0, *firsts]) + 1, np.uint64)])
        masks = {len(reps[0].members[0]) - 1 for _, reps in self.groups}
        slots = {m: (padded & _U(m)).astype(np.int64) for m in masks}
        for r in range(rounds):
            plans = sorted(((reps[r], g) for g, (_, reps) in enumerate(self.groups) if r < len(reps)), key=lambda x: (x[0].steps[0], x[1]))
            bits, at, step = mix(padded, plans[0][0].salt), np.arange(len(hashes)), 0
            chunk = bits
            for rep, g in plans:
                while step < rep.steps[0]:
                    if step and step % 64 == 0:
                        chunk = mix(chunk, 5)
                    plane = (chunk.view(np.uint8)[step % 64 // 8 :: 8] >> np.uint8(step % 8)) & np.uint8(1)
                    at = at + plane[at] if step else at + plane[: len(at)]
                    step += 1
                found[g] += self._follow(rep, padded, slots[len(rep.members[0]) - 1], bits, at, step)
        for (items, _), parts in zip(self.groups, found):
            if parts:
                pairs = np.unique(np.concatenate(parts))
                yield items, (pairs >> 40), pairs & ((1 << 40) - 1)

    @staticmethod
    def _follow(rep: Repetition, padded: np.ndarray, slots: np.ndarray, bits: np.ndarray, at: np.ndarray, step: int) -> list[np.ndarray]:
        """Starts whose outputs at all sampled steps are an item's, as item << 40 | start; at: the pointers at the first of these steps."""
        last = len(padded) - 1
        hit = rep.members[0][slots]
        start = np.flatnonzero(hit[at] if step else hit[: len(at)])
        at = at[start]
        parts = [padded[at]]
        for j, member in zip(rep.steps[1:], rep.members[1:]):
            while step < j and len(at):
                own = bits[at]
                for _ in range(step // 64):
                    own = mix(own, 5)
                at = np.minimum(at + ((own >> _U(step % 64)) & _U(1)).astype(np.int64), last)
                step += 1
            step, seen = j, padded[at]
            alive = np.flatnonzero(member[slots[at]])
            start, at, parts = start[alive], at[alive], [p[alive] for p in parts] + [seen[alive]]
        if not len(start):
            return []
        key = _key(parts)
        low, high = np.searchsorted(rep.keys, key, "left"), np.searchsorted(rep.keys, key, "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return [(rep.items[which].astype(np.int64) << 40) | np.repeat(start, n)] if len(which) else []


_FAR = 1 << 20


def best_windows(items: np.ndarray, sizes: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, an item (padded to one width) and a stretch low .. high of the text: the least edit
    distance of the item to one of the stretch's windows, and that window.

    The whole item is aligned with any part of the stretch; of equal distances the window that ends first
    is taken, and of its starts the last. A cell's rank joins its cost and its start, so that one minimum
    decides on both; all rows are filled at once, word by word of the items.
    """
    width = int((high - low).max())
    column = np.arange(width + 1)
    spot = low[:, None] + column[None, :-1]
    inside = spot < high[:, None]
    word = np.where(inside, text[np.minimum(spot, len(text) - 1)], 0)
    rank = np.broadcast_to(-column, (len(low), width + 1)).astype(np.int64)
    final = rank.copy()
    slope = column * _FAR
    for k in range(int(sizes.max())):
        fresh = rank + _FAR
        np.minimum(fresh[:, 1:], rank[:, :-1] + np.where(word == items[:, k, None], 0, _FAR), out=fresh[:, 1:])
        rank = np.minimum.accumulate(fresh - slope, axis=1) + slope
        done = sizes == k + 1
        final[done] = rank[done]
    final[:, 1:][~inside] = np.iinfo(np.int64).max // 2
    distance = -((-final) // _FAR)
    end = np.argmin(distance, axis=1)
    rows = np.arange(len(low))
    distance = distance[rows, end]
    return distance, low + distance * _FAR - final[rows, end], low + end


def _scan(index: Index):
    def find(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item_id, distance, n_words, start_word, end_word), the best window of each row and item."""
        for first, last in blocks(offsets, 1 << 21):
            found = words(raw, offsets, first, last)
            if not len(found.hashes):
                continue
            for items, who, where in index.candidates(found.hashes, found.doc_bounds):
                doc = np.searchsorted(found.doc_bounds, where, side="right") - 1
                n = np.array([len(w) for _, w in items])[who]
                spare = allowed(n, index.max_edits)
                low = np.maximum(where - spare, found.doc_bounds[doc])
                high = np.minimum(where + n + 2 * spare, found.doc_bounds[doc + 1])
                some = index.possible(who, n, spare, found.hashes, low, high)
                who, doc, n, spare, low, high = (x[some] for x in (who, doc, n, spare, low, high))
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for part in np.array_split(np.arange(len(who)), -(-len(who) // 5_000)) if len(who) else ():
                    table = np.zeros((len(part), int(n[part].max())), np.uint64)
                    for x, k in enumerate(who[part]):
                        table[x, : n[part[x]]] = items[k][1]
                    distance, begin, end = best_windows(table, n[part], found.hashes, low[part], high[part])
                    for x in np.flatnonzero(distance <= spare[part]):
                        d, k = int(doc[part[x]]), int(who[part[x]])
                        row = (int(distance[x]), int(begin[x] - found.doc_bounds[d]), int(end[x] - found.doc_bounds[d]))
                        if (d, k) not in best or row < best[d, k]:
                            best[d, k] = row
                for (d, k), row in best.items():
                    yield first + d, items[k][0], row[0], len(items[k][1]), row[1], row[2]

    return find


def _items(items: DataFrame, id_col: str, text_col: str) -> list[tuple[int, np.ndarray]]:
    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct().toArrow()
    raw, offsets = text_buffer(rows.column("text"))
    found = words(raw, offsets, 0, rows.num_rows) if rows.num_rows else None
    out = [(i, found.hashes[found.doc_bounds[k] : found.doc_bounds[k + 1]]) for k, i in enumerate(rows.column("id").to_pylist())]
    return sorted(((i, w) for i, w in out if len(w)), key=lambda x: (x[0], x[1].tolist()))


def _passes(items: DataFrame, id_col: str, text_col: str, max_edits: float, target: float) -> Iterator[tuple[Index, bool]]:
    """The items by slices of ids, and whether a slice is the last.

    A slice holds about ITEMS_A_PASS items; one index at a time is built and sent, so that what the driver
    and a task hold has a bound, however many items there are.
    """
    slices = max(1, -(-items.count() // ITEMS_A_PASS))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(slices)) == k) if slices > 1 else items
        yield Index(_items(part, id_col, text_col), max_edits, target), k == slices - 1


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edits: float = MAX_EDITS, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, item_id, distance, n_words, start_word, end_word): documents with a window near an item.

    One row for a document and item, with the window of least edit distance, of equal ones the first;
    n_words is the item's length, the window runs from start_word to before end_word. Case and
    punctuation play no part. Null, empty and wordless texts of either table match nothing, rows with a
    null id are left out. Rows that repeat give one row. Empty tables give no rows; other columns are
    ignored, whatever their names. Very long texts are scanned whole. Items of under 7 words allow no
    edit at the default rate.
    """
    spark, found = docs.sparkSession, None
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    for index, last in _passes(items, item_col, item_text_col, max_edits, target):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = _scan(shared.value)
            for batch in batches:
                rows = list(find(*text_buffer(batch.column(1))))
                if rows:
                    row, *rest = map(list, zip(*rows))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())))], _NAMES)

        part = texts.mapInArrow(run, _RESULT)
        if not last:
            part = cut(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start_word", "end_word", "n_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.distance", "m.n_words", "m.start_word", "m.end_word")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edits: float = MAX_EDITS, target: float = TARGET_RECALL) -> DataFrame:
    """docs without the rows that find_leaks finds an item in, all columns kept; rows with a null id or text stay."""
    spark = docs.sparkSession
    for index, last in _passes(items, item_col, item_text_col, max_edits, target):
        shared = spark.sparkContext.broadcast(index)

        def leaks(text, shared=shared):
            import pandas as pd

            out = np.zeros(len(text), bool)
            out[[r[0] for r in _scan(shared.value)(*text_buffer(pa.array(text, pa.string(), from_pandas=True)))]] = True
            give_back()
            return pd.Series(out)

        leaks.__annotations__ = {}
        docs = docs.where(~F.pandas_udf(leaks, "boolean")(F.col(text_col).cast("string")))
        if not last:
            docs = cut(docs)
            shared.destroy()
    return docs
