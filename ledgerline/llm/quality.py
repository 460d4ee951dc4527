"""A quality classifier on random-indexing word vectors.

1. Word vectors, over the whole corpus: every context (a stretch of CONTEXT tokens of a document) has a
   sparse random index vector drawn from a hash of its tokens; a token's vector is the sum of the index
   vectors of the contexts that it occurs in. Tokens are hashed to BUCKETS rows, so that the table has
   one size whatever the vocabulary. Rows are centred on the corpus mean and given unit length.
2. A document is the mean of its tokens' vectors, weighted down for frequent tokens and for those that
   are spread over the contexts by chance. A token that equals the one before it counts as REPEATED.
3. A two-layer numpy network is fitted on at most train_rows labelled documents, with one output for
   low quality and one for toxicity; a temperature for each is fitted on a held-out part.

The word table never passes through the driver: its slabs are summed into a table in the shared folder,
workers read it there, one task fits the network, and what scores documents is the table multiplied by
the first layer, again in the shared folder. The driver sees the network's few numbers alone.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import shared
from ledgerline.llm.memory import give_back
from ledgerline.llm.words import IS_SPACE, IS_WORD, blocks, mix, runs, span_hashes, text_buffer
from ledgerline.storage import drop_path, scratch_path

BUCKETS = 1 << 16
DIMENSIONS = 256
NONZEROS = 4
CONTEXT = 512
FREQUENCY_WEIGHT = 1e-3
HIDDEN = 32
#: Most labelled documents that the network is fitted on; the sample is by hash of the id, so the same each time.
TRAIN_ROWS = 20_000
#: A document is rejected when either probability reaches this.
REJECT_AT = 0.5
#: Weight decay of both layers.
DECAY = 0.1
#: A slab is one value of a row; below half a megabyte the JVM doesn't treat it as a huge object.
_SLABS = 256
#: Bytes of text whose tokens are hashed at a time; temporary arrays take many times as much.
BLOCK = 1 << 18
_U = np.uint64
#: Stands for every token that equals the one before it.
REPEATED = _U(0x5851F42D4C957F2D)
_OTHER = ~(IS_WORD | IS_SPACE)


def tokens(raw: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, case kept, and of runs of other signs, in order, and token ranges of the documents."""
    at = offsets[first : last + 1] - offsets[first]
    part = raw[offsets[first] : offsets[last]]
    starts, ends = (np.concatenate(x) for x in zip(runs(IS_WORD[part], at), runs(_OTHER[part], at)))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    hashes = span_hashes(part, starts, ends)
    again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    hashes[again[starts[again] > at[np.searchsorted(at, starts[again], side="right") - 1]]] = REPEATED
    return hashes, np.searchsorted(starts, at)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of this task's contexts by bucket, in slabs of buckets; the last column counts tokens."""
    width = DIMENSIONS + 1
    give_back()  # the worker may come from another stage
    table = np.zeros(BUCKETS * width, np.int32)
    salts = range(11, 11 + NONZEROS)
    for batch in batches:
        raw, offsets = text_buffer(batch.column(0))
        for first, last in blocks(offsets, BLOCK):
            hashes, bounds = tokens(raw, offsets, first, last)
            if not len(hashes):
                continue
            within = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
            starts = np.flatnonzero(within % CONTEXT == 0)
            sizes = np.diff(np.append(starts, len(hashes)))
            seeds = np.add.reduceat(hashes, starts)
            row = (hashes & _U(BUCKETS - 1)).astype(np.int64) * width
            for salt in salts:
                drawn = mix(seeds, salt)
                at = row + np.repeat((drawn % _U(DIMENSIONS)).astype(np.int64), sizes)
                sign = np.repeat(np.where(drawn >> _U(63), 1, -1).astype(np.int32), sizes)
                np.add.at(table, at, sign)
            np.add.at(table, row + DIMENSIONS, np.int32(1))
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for slab, part in enumerate(table.reshape(_SLABS, -1)):
        yield pa.RecordBatch.from_pylist([{"slab": slab, "task": task, "sums": part.tobytes()}], _PARTIAL)


_PARTIAL_DDL = "slab int, task int, sums binary"
_PARTIAL = pa.schema([("slab", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())])


def _total(group: pa.Table) -> np.ndarray:
    total = np.zeros(BUCKETS // _SLABS * (DIMENSIONS + 1), np.int64)
    for x in group.column("sums"):
        raw = x.as_buffer()
        total += np.frombuffer(raw, np.int32 if raw.size == total.size * 4 else np.int64)
    return total


def _add(group: pa.Table) -> pa.Table:
    return pa.Table.from_pylist([{"slab": group.column("slab")[0].as_py(), "task": group.column("task")[0].as_py(), "sums": _total(group).tobytes()}], _PARTIAL)


_SLAB_DDL = "slab int, sums binary, totals binary"
_SLAB = pa.schema([("slab", pa.int32()), ("sums", pa.binary()), ("totals", pa.binary())])


def _finish(group: pa.Table) -> pa.Table:
    """A slab's sums in single precision, and its column totals in full."""
    total = _total(group).reshape(-1, DIMENSIONS + 1)
    return pa.Table.from_pylist([{"slab": group.column("slab")[0].as_py(), "sums": total.astype(np.float32).tobytes(), "totals": total.sum(axis=0).tobytes()}], _SLAB)


@dataclass
class WordTable:
    """Where the summed slabs lie, the corpus mean of the sums, and the number of tokens."""

    path: str
    mean: np.ndarray
    tokens: float

    def slabs(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(buckets, their unit vectors, their weights in a document) slab by slab, read from the shared folder.

        A weight has two factors: one falls with the frequency; the other is near 0 where the vector is no
        longer than that of tokens spread over the contexts by chance, and so tells nothing. Vectors are
        centred in double precision before they are rounded to single.
        """
        for batch in shared.batches(self.path, ["slab", "sums"]):
            for k, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums = np.frombuffer(sums.as_buffer(), np.float32).reshape(-1, DIMENSIONS + 1)
                count = sums[:, -1].astype(np.float64)
                x = sums[:, :-1] / np.maximum(count, 1)[:, None] - self.mean
                x[count == 0] = 0
                length = np.linalg.norm(x, axis=1)
                excess = np.maximum(0, length**2 * count / NONZEROS - 1)
                weight = excess / (1 + excess) * FREQUENCY_WEIGHT / (FREQUENCY_WEIGHT + count / self.tokens)
                yield _slab(k), (x / np.where(length > 0, length, 1)[:, None]).astype(np.float32), weight.astype(np.float32)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        vectors, weight = np.zeros((BUCKETS, DIMENSIONS), np.float32), np.zeros(BUCKETS, np.float32)
        for own, v, w in self.slabs():
            vectors[own], weight[own] = v, w
        return vectors, weight


def word_vectors(docs: DataFrame, text_col: str = "text") -> WordTable:
    """A vector and a weight for each bucket, from every document.

    Tasks take about 16 input splits each and add up in two steps, so that what moves is a small part of
    the input and no group holds more than the square root of the tasks.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(texts.rdd.getNumPartitions() / 16))
    parts = texts.coalesce(tasks).mapInArrow(_tables, _PARTIAL_DDL)
    step = math.isqrt(tasks)
    if step > 8:
        parts = parts.withColumn("task", F.col("task") % step).groupBy("slab", "task").applyInArrow(_add, _PARTIAL_DDL)
    path = scratch_path(spark, "words")
    parts.groupBy("slab").applyInArrow(_finish, _SLAB_DDL).write.parquet(path)
    totals = np.zeros(DIMENSIONS + 1)
    for row in spark.read.parquet(path).select("totals").collect():  # 2 kB for each of the slabs
        totals += np.frombuffer(row["totals"], np.int64)
    return WordTable(path, totals[:-1] / max(1.0, totals[-1]), max(1.0, totals[-1]))


def _slab(k: int) -> slice:
    return slice(k * BUCKETS // _SLABS, (k + 1) * BUCKETS // _SLABS)


def pool(column: pa.Array, table: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means of the table's rows over each text's tokens, and the number of its tokens."""
    raw, offsets = text_buffer(column)
    out, n = np.zeros((len(column), table.shape[1]), np.float32), np.zeros(len(column), np.int64)
    for first, last in blocks(offsets, BLOCK):
        hashes, bounds = tokens(raw, offsets, first, last)
        at = (hashes & _U(BUCKETS - 1)).astype(np.int64)
        each = weight[at]
        for k in range(last - first):
            own = slice(bounds[k], bounds[k + 1])
            total = each[own].sum()
            if total > 0:
                out[first + k] = each[own] @ table[at[own]].astype(np.float32, copy=False) / total
        n[first:last] = np.diff(bounds)
    return out, n


@dataclass
class Network:
    """x -> tanh -> two logits, each divided by its temperature; heads: low quality, toxicity."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))) if len(z) else 0.0


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of held-out logits with the least loss, by golden-section search on its logarithm."""
    if not len(z):
        return 1.0
    low, high, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        if _loss(z / math.exp(a), y) < _loss(z / math.exp(b), y):
            high = b
        else:
            low = a
    return math.exp((low + high) / 2)


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the cross-entropy of both heads; a nan label leaves its head out for that row.

    A fifth of the rows is held out for the temperatures. Without any label of a head its probability is
    near the zero that it starts from the prior of; without rows at all every probability is 0.
    """
    rng = np.random.default_rng(seed)
    if not len(x):
        return Network(np.zeros((DIMENSIONS, hidden), np.float32), np.zeros(hidden, np.float32), np.zeros((hidden, 2), np.float32), np.full(2, -40, np.float32), np.ones(2))
    order = rng.permutation(len(x))
    held, train = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    z = ((x - mean) / scale).astype(np.float32)
    known = ~np.isnan(y)
    target = np.where(known, y, 0)
    share = np.clip((target[train] * known[train]).sum(axis=0) / np.maximum(known[train].sum(axis=0), 1), 1e-6, 1 - 1e-6)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, (hidden, 2)), np.log(share / (1 - share))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    decay = DECAY
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[batch] @ p[0] + p[1])
            d = (_sigmoid(h @ p[2] + p[3]) - target[batch]) * known[batch] / len(batch)
            e = (d @ p[2].T) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[batch].T @ e, e.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * p[k] * (k % 2 == 0))
    net = Network(p[0] / scale[:, None], p[1] - (mean / scale) @ p[0], p[2], p[3], np.ones(2))
    logits = net.logits(x[held])
    net.temperature = np.array([temperature(logits[known[held, k], k], target[held][known[held, k], k]) for k in range(2)])
    return net


@lru_cache(maxsize=1)
def _projected(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A model's projected word table and weights, read once in each Python worker."""
    rows, weight = np.zeros((BUCKETS, HIDDEN), np.float32), np.zeros(BUCKETS, np.float32)
    for batch in shared.batches(path, ["slab", "projected", "weight"]):
        for k, p, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            rows[_slab(k)], weight[_slab(k)] = np.frombuffer(p.as_buffer(), np.float32).reshape(-1, HIDDEN), np.frombuffer(w.as_buffer(), np.float32)
    return rows, weight


@dataclass
class Model:
    """The network, and where the word table lies that its first layer has already been applied to: a mean of
    vectors times w1 is a mean of these rows."""

    path: str
    net: Network

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pooled, n = pool(column, *_projected(self.path))
        return _sigmoid((np.tanh(pooled + self.net.b1) @ self.net.w2 + self.net.b2) / self.net.temperature), n


def _fit_rows(rows: pa.Table) -> Network:
    rows = rows.sort_by([("id", "ascending"), ("quality", "ascending"), ("toxic", "ascending")])
    column = rows.column("x").combine_chunks()
    x = np.frombuffer(b"".join(v.as_buffer() for v in column), np.float32).reshape(-1, DIMENSIONS)
    y = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("quality", "toxic")], axis=1)
    return fit(x, np.stack([1 - y[:, 0], y[:, 1]], axis=1))


def _fit_group(rows: pa.Table) -> pa.Table:
    """The network's numbers as one row; it is fitted in one task, on at most train_rows documents."""
    return pa.Table.from_pylist([{"net": pickle.dumps(_fit_rows(rows))}], pa.schema([("net", pa.binary())]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Word vectors from all of docs, the network from at most train_rows of the labelled ones.

    What the model needs to score (about 9 MB, whatever the corpus) stays in the shared folder, for the
    rows that it scores may be computed, or computed again, at any later time.
    """
    spark = docs.sparkSession
    table = word_vectors(docs, text_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if vectors is None:
                vectors, weight = table.whole()
            x, _ = pool(batch.column(3), vectors, weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "quality", "toxic", "x"])

    chosen = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("double"), F.col("toxic").cast("double")).where("id IS NOT NULL").dropDuplicates().orderBy(F.xxhash64("id"), "id", "quality", "toxic").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    # chosen has at most train_rows rows of 24 bytes
    labelled = texts.join(F.broadcast(chosen), "id").select("id", "quality", "toxic", "text").repartition(spark.sparkContext.defaultParallelism)
    rows = labelled.mapInArrow(features, "id bigint, quality double, toxic double, x binary")
    fitted = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_fit_group, "net binary").collect()
    net = pickle.loads(fitted[0]["net"]) if fitted else fit(np.zeros((0, DIMENSIONS)), np.zeros((0, 2)))
    path = scratch_path(spark, "classifier")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in batch.column(0).to_pylist():
                for own, v, w in table.slabs():
                    yield pa.RecordBatch.from_pylist([{"slab": own.start * _SLABS // BUCKETS, "projected": (v @ net.w1.astype(np.float32)).tobytes(), "weight": w.tobytes()}], pa.schema([("slab", pa.int32()), ("projected", pa.binary()), ("weight", pa.binary())]))

    spark.range(1, numPartitions=1).mapInArrow(project, "slab int, projected binary, weight binary").write.parquet(path)
    drop_path(spark, table.path)
    return Model(path, net)


def _scorer(model: Model):
    @F.pandas_udf("struct<low double, toxic double, tokens bigint>")
    def score(text: pd.Series) -> pd.DataFrame:
        p, n = model.score(pa.array(text, pa.string(), from_pandas=True))
        give_back()
        return pd.DataFrame({"low": p[:, 0], "toxic": p[:, 1], "tokens": n})

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, reject_at: float = REJECT_AT) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep), a row for each row of docs.

    keep is true where p_quality is over 1 - reject_at and p_toxic under reject_at. A null, empty or
    blank text can't be scored: its probabilities are null and keep is false. Rows that repeat get the
    same score each; a null id stays null. Labels that are null, or of absent documents, are left out;
    with no labels at all every text with a token is kept. An empty table gives no rows; other columns
    are ignored, whatever their names. Very long texts are read whole.
    """
    model = train(docs, labels, id_col, text_col, train_rows)
    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _scorer(model)(F.col(text_col).cast("string")).alias("s"))
    some = F.col("s.tokens") > 0
    return scored.select("doc_id", F.when(some, 1 - F.col("s.low")).alias("p_quality"), F.when(some, F.col("s.toxic")).alias("p_toxic"), (some & (F.col("s.low") < reject_at) & (F.col("s.toxic") < reject_at)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns."""
    model = train(docs, labels, id_col, text_col, train_rows)
    s = _scorer(model)(F.col(text_col).cast("string"))
    return docs.withColumn("__score", s).where(f"__score.tokens > 0 AND __score.low < {reject_at} AND __score.toxic < {reject_at}").drop("__score")
