"""Near-duplicate embeddings by range search in a robust-pruned flat graph.

1. Shards come from two levels of centroids. Lloyd rounds over all vectors give about the square root of
   the shards' number of cells; inside a cell, a hashed share of its vectors is split again and again until
   every part stands for a shard of bounded size. A vector goes to the OVERLAP nearest shards of its own
   cell and to the nearest of each of the next cells; the nearest of all is its home. Only the first
   level's centroids, √n of them, are broadcast; a cell's shards are read by the tasks of that cell.
2. In every shard each vector gets edges: its nearest members and an evenly spread choice of far ones,
   both pruned by the robust rule (a candidate goes if an edge already chosen is ALPHA times closer to it
   than the vector is). A vector's lists from its shards are united.
3. Every vector is a query: a greedy search with a beam walks from its home shard's medoid to it, then
   the range is expanded through everything within it. Edges that leave the shard are followed too, by
   joins, round by round, as long as they lead to vectors within the range; an edge is worth following
   only if its angle is no more than the range's and that of the place it starts from together.
4. Pairs are verified by exact cosine. Recall is audited: probes are added to the table, noisy copies of
   hashed vectors just within the threshold, and for them and as many real vectors all partners are found
   exactly, by comparing them with all others. If the mean over these of the share of partners found is
   below the target, the search is done again with twice the overlap and beam. So there is evidence
   in every table, however rare its pairs, and its cost is linear. Probes aren't in the result.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import shared
from ledgerline.storage import cut, drop_path, scratch_path

THRESHOLD = 0.95
SHARD_SIZE = 2000
OVERLAP = 2
NEAR, FAR = 24, 8
ALPHA = 1.2
BEAM = 24
ROUNDS = 3
TARGET_RECALL = 0.95
#: Probes, and real vectors, whose partners are found exactly.
AUDITED = 200
#: A shard of the second level stands for so many vectors of the cell's hashed share, at most twice as many.
SHARE_A_SHARD = 64
_HASHES = 1 << 30
#: Single precision may put a pair a little under the threshold; verification decides.
SLACK = 1e-4
_log = logging.getLogger(__name__)
_PAIRS = "vec_a bigint, vec_b bigint, cosine double"


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dims)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, d, v) with unit vectors and their dimensions; the least by value for an id given twice with one dimension."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    rows = rows.withColumn("__n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("__n > 0 AND __n < double('infinity')")
    unit = rows.select("vec_id", F.size("v").alias("d"), F.transform("v", lambda x: x / F.col("__n")).cast("array<float>").alias("v"))
    return cut(unit.groupBy("vec_id", "d").agg(F.min("v").alias("v")))


def _centroids(unit: DataFrame, k: int, dims: int) -> np.ndarray:
    """Spherical Lloyd rounds over all vectors, from k vectors chosen by hash; an empty cluster keeps its centroid."""
    first = unit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).toArrow()
    centroids = _matrix(first.column("v"), dims)
    spark = unit.sparkSession
    for _ in range(ROUNDS if k > 1 else 0):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            c = sent.value
            total, count = np.zeros((len(c), dims)), np.zeros(len(c), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), dims)
                for part in np.array_split(x, max(1, len(x) * len(c) // 4_000_000)):
                    near = np.argmax(part @ c.T, axis=1)
                    np.add.at(total, near, part)
                    count += np.bincount(near, minlength=len(c))
            full = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(list(total[full]), pa.list_(pa.float64()))], ["c", "s"])

        parts = unit.select("v").mapInArrow(sums, "c bigint, s array<double>").select("c", F.posexplode("s")).groupBy("c", "pos").agg(F.sum("col").alias("s")).toPandas()
        total = centroids.astype(np.float64).copy()
        total[parts["c"], parts["pos"]] = parts["s"]
        centroids = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        sent.destroy()
    return centroids


def split(x: np.ndarray, most: int) -> np.ndarray:
    """Centroids of parts of x with at most that many members each, by Lloyd rounds, part within part.

    Only a part of equal vectors may be larger: nothing tells its members apart.
    """
    if len(x) <= most or (x == x[0]).all():
        return x.mean(axis=0, keepdims=True)
    k = min(16, -(-2 * len(x) // most))
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)]
    for _ in range(5):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = np.bincount(near, minlength=k) > 0
        c = np.where(full[:, None], total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12), c)
    near = np.argmax(x @ c.T, axis=1)
    parts = [x[near == j] for j in range(k)]
    if max(map(len, parts)) == len(x):  # one centroid takes all: halve by the widest coordinate
        along = np.argsort(x[:, np.argmax(x.std(axis=0))], kind="stable")
        parts = [x[along[: len(x) // 2]], x[along[len(x) // 2 :]]]
    return np.concatenate([split(p, most) for p in parts if len(p)])


def _members(unit: DataFrame, n: int, overlap: int, shard_size: int, dims: int) -> DataFrame:
    """(shard, home, vec_id, v), each vector once for each of its shards; kept in the shared folder."""
    spark = unit.sparkSession
    shards = max(1, math.ceil(n * (2 * overlap - 1) / shard_size))
    top = _centroids(unit, math.ceil(math.sqrt(shards)), dims)
    sent = spark.sparkContext.broadcast(top)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        m = min(overlap, len(c))
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                near = np.argsort(-(_matrix(part.column(1), dims) @ c.T), axis=1, kind="stable")[:, :m]
                for k in range(m):
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, k].astype(np.int64)), pa.array(np.full(len(near), k)), part.column(0), part.column(1)], ["cell", "rank", "vec_id", "v"])

    celled = unit.select("vec_id", "v").mapInArrow(cells, "cell bigint, rank bigint, vec_id bigint, v array<float>")
    path = scratch_path(spark, "shards")
    share = min(1.0, SHARE_A_SHARD * shards / n)

    def children(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("vec_id").to_numpy(), kind="stable")
        found = split(_matrix(group.column("v"), dims)[order], 2 * SHARE_A_SHARD) if shards > 1 else np.zeros((1, dims), np.float32)
        return pa.table({"of": group.column("cell").slice(0, 1), "centroids": pa.array([found.astype(np.float32).tobytes()], pa.binary())})

    sampled = celled.where((F.col("rank") == 0) & (F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(_HASHES)) <= share * _HASHES))
    sampled.groupBy("cell").applyInArrow(children, "of bigint, centroids binary").withColumn("cell", F.col("of")).write.partitionBy("cell").parquet(path)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _matrix(batch.column(3), dims)
            for own in np.unique(cell):
                if own not in known:  # rows come cell by cell
                    known = {own: _children_of(path, int(own), dims)}
                rows = np.flatnonzero(cell == own)
                near = np.argsort(-(x[rows] @ known[own].T), axis=1, kind="stable")[:, :overlap]
                for k in range(near.shape[1]):
                    some = rows if k == 0 else rows[rank[rows] == 0]
                    if len(some):
                        which = near[:, k] if k == 0 else near[rank[rows] == 0, k]
                        taken = pa.array(some)
                        yield pa.RecordBatch.from_arrays([pa.array((np.int64(own) << 32) + which), pa.array((rank[some] == 0) & (k == 0)), batch.column(2).take(taken), batch.column(3).take(taken)], ["shard", "home", "vec_id", "v"])

    placed = celled.repartition("cell").sortWithinPartitions("cell").mapInArrow(assigned, "shard bigint, home boolean, vec_id bigint, v array<float>")
    placed = cut(placed)
    sent.destroy()
    drop_path(spark, path)
    return placed


def _children_of(path: str, cell: int, dims: int) -> np.ndarray:
    """The centroids of a cell's shards; a cell that no vector of the share fell into is one shard."""
    try:
        rows = [c for batch in shared.batches(f"{path}/cell={cell}", ["centroids"]) for c in batch.column(0)]
    except FileNotFoundError:
        return np.zeros((1, dims), np.float32)
    return np.concatenate([np.frombuffer(c.as_buffer(), np.float32).reshape(-1, dims) for c in rows])


def robust_prune(x: np.ndarray, candidates: np.ndarray, similarity: np.ndarray, most: int, alpha: float = ALPHA) -> np.ndarray:
    """For each row of candidates, most similar first, up to most of them (-1 for none): each drops the
    later ones that it is alpha times closer to than the row's vector is."""
    rows, width = candidates.shape
    alive = np.ones((rows, width), bool)
    out, taken, n = np.full((rows, most), -1, np.int64), np.zeros(rows, np.int64), np.arange(rows)
    far = np.sqrt(np.maximum(0, 2 - 2 * similarity))
    points = x[candidates]
    for _ in range(most):
        some = alive.any(axis=1)
        if not some.any():
            break
        k = np.argmax(alive, axis=1)
        out[n[some], taken[some]] = candidates[n[some], k[some]]
        taken += some
        alive[n, k] = False
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rwd,rd->rw", points, points[n, k])))
        alive &= ~(some[:, None] & (alpha * between <= far))
    return out


def _edges(dims: int):
    def run(group: pa.Table) -> pa.Table:
        ids, x = group.column("vec_id").to_numpy(), _matrix(group.column("v"), dims)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        m = len(ids)
        lists: list[np.ndarray] = []
        spread = np.unique(np.linspace(0, m - 1, min(m, 8 * FAR)).astype(np.int64))
        for start in range(0, m, 512):
            own = np.arange(start, min(start + 512, m))
            score = x[own] @ x.T
            score[own - start, own] = -2
            width = min(m - 1, 2 * NEAR)
            near = np.argpartition(-score, width - 1, axis=1)[:, :width] if 0 < width < m - 1 else np.tile(np.arange(m), (len(own), 1)) if width else np.zeros((len(own), 0), np.int64)
            parts = []
            for candidates, most in ((near, NEAR), (np.tile(spread, (len(own), 1)), FAR)):
                if candidates.shape[1]:
                    s = np.take_along_axis(score, candidates, axis=1)
                    by = np.argsort(-s, axis=1, kind="stable")
                    candidates, s = np.take_along_axis(candidates, by, axis=1), np.take_along_axis(s, by, axis=1)
                    parts.append(robust_prune(x, candidates, s, most))
            lists += [np.unique(row[(row >= 0) & (row != i)]) for i, row in zip(own, np.concatenate(parts, axis=1))] if parts else [np.zeros(0, np.int64)] * len(own)
        sizes = np.array([len(row) for row in lists], np.int64)
        owner, flat = np.repeat(np.arange(m), sizes), np.concatenate([*lists, np.zeros(0, np.int64)])
        cosine = np.concatenate([np.einsum("nd,nd->n", x[owner[k : k + 65536]], x[flat[k : k + 65536]]) for k in range(0, len(flat), 65536)] or [np.zeros(0, np.float32)])
        edges = pa.StructArray.from_arrays([pa.array(ids[flat]), pa.array(cosine.astype(np.float32))], ["to", "cosine"])
        return pa.table({"vec_id": pa.array(ids), "edges": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), edges)})

    return run


def _beam(x: np.ndarray, q: np.ndarray, graph: np.ndarray, start: int, beam: int) -> np.ndarray:
    """The beam nearest vectors that greedy search from start meets, for each query; -1 for none."""
    rows, m = len(q), len(x)
    n = np.arange(rows)
    seen = np.zeros((rows, m + 1), bool)
    seen[:, m] = True
    pool = np.full((rows, beam), m, np.int64)
    pool[:, 0], seen[:, start] = start, True
    score = np.full((rows, beam), -3.0, np.float32)
    score[:, 0] = q @ x[start]
    done = np.ones((rows, beam), bool)
    done[:, 0] = False
    while not done.all():
        active = np.flatnonzero(~done.all(axis=1))
        k = np.argmin(done[active], axis=1)
        done[active, k] = True
        next_to = graph[pool[active, k]]
        fresh = ~seen[active[:, None], next_to]
        seen[active[:, None], next_to] = True
        seen[:, m] = True
        s = np.where(fresh, np.einsum("rwd,rd->rw", x[np.minimum(next_to, m - 1)], q[active]), -3.0).astype(np.float32)
        together = np.concatenate([score[active], s], axis=1)
        by = np.argsort(-together, axis=1, kind="stable")[:, :beam]
        score[active] = np.take_along_axis(together, by, axis=1)
        pool[active] = np.take_along_axis(np.concatenate([pool[active], np.where(fresh, next_to, m)], axis=1), by, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), by, axis=1) | (score[active] <= -3)
    del n
    return np.where(score > -3, pool, -1)


def _search(dims: int, threshold: float, beam: int):
    """(vec_a, vec_b, cosine) of a shard's pairs, and with a null cosine (query, vector) where an edge leaves the shard."""
    reach = math.acos(max(-1.0, min(1.0, threshold - SLACK)))

    def run(group: pa.Table) -> pa.Table:
        ids, x = group.column("vec_id").to_numpy(), _matrix(group.column("v"), dims)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        home = group.column("home").to_numpy(zero_copy_only=False)[order]
        lists = group.column("edges").combine_chunks().take(pa.array(order))
        m = len(ids)
        flat, angle = lists.flatten().field("to").to_numpy(), np.arccos(np.clip(lists.flatten().field("cosine").to_numpy(), -1, 1))
        owner = np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(ids, flat), m - 1)
        inside = ids[at] == flat
        leaving = ~inside & (angle <= 2 * reach)
        out_from, out_to, out_angle = owner[leaving], flat[leaving], angle[leaving]
        out_first = np.searchsorted(out_from, np.arange(m + 1))
        at, owner = at[inside], owner[inside]
        both = np.unique(np.concatenate([owner * m + at, at * m + owner]))  # edges are walked both ways
        owner, at = both // m, both % m
        degree = np.bincount(owner, minlength=m)
        graph = np.full((m + 1, max(1, degree.max(initial=0))), m, np.int64)
        graph[owner, np.arange(len(owner)) - np.repeat(np.cumsum(degree) - degree, degree)] = at
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        a, b = [], []
        for queries in np.array_split(np.flatnonzero(home), max(1, -(-int(home.sum()) // 256))):
            if not len(queries):
                continue
            met = _beam(x, x[queries], graph, medoid, beam)
            row, column = np.nonzero(met >= 0)
            node = met[row, column]
            seen = np.zeros((len(queries), m + 1), bool)
            seen[:, m] = True
            seen[np.arange(len(queries)), queries] = True  # the query's own place is in the range
            row, node = np.concatenate([row, np.arange(len(queries))]), np.concatenate([node, queries])
            near = np.einsum("nd,nd->n", x[queries[row]], x[node]) >= threshold - SLACK
            frontier = np.unique(row[near] * (m + 1) + node[near])
            while len(frontier):
                row, node = frontier // (m + 1), frontier % (m + 1)
                seen[row, node] = True
                a.append(queries[row])
                b.append(node)
                onward = (row[:, None] * (m + 1) + graph[node]).ravel()
                onward = np.unique(onward[~seen.ravel()[onward]])
                row, node = onward // (m + 1), onward % (m + 1)
                seen.ravel()[onward] = True
                frontier = onward[np.einsum("nd,nd->n", x[queries[row]], x[node]) >= threshold - SLACK]
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        cosine = np.einsum("nd,nd->n", x[a].astype(np.float64), x[b].astype(np.float64))
        n_out = np.diff(out_first)[b]
        edge = np.repeat(out_first[b], n_out) + np.arange(n_out.sum()) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        query, from_angle = np.repeat(a, n_out), np.repeat(np.arccos(np.clip(cosine, -1, 1)), n_out)
        worth = out_angle[edge] <= from_angle + reach + 1e-3
        away = np.unique(np.stack([ids[query[worth]], out_to[edge[worth]]], axis=1), axis=0)
        low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        good = (cosine >= threshold) & (low < high)
        keep = np.unique(np.stack([low[good], high[good]], axis=1), axis=0, return_index=True)[1]
        none = pa.nulls(len(away), pa.float64())
        return pa.table({"vec_a": np.concatenate([low[good][keep], away[:, 0]]), "vec_b": np.concatenate([high[good][keep], away[:, 1]]), "cosine": pa.chunked_array([pa.array(cosine[good][keep]), none])})

    return run


def _verified(unit: DataFrame, asked: DataFrame, threshold: float, dims: int) -> DataFrame:
    """The distinct (vec_a, vec_b) of asked, vec_a < vec_b, whose cosine reaches the threshold."""
    ordered = asked.select(F.least("vec_a", "vec_b").alias("vec_a"), F.greatest("vec_a", "vec_b").alias("vec_b")).where("vec_a < vec_b").distinct()
    both = ordered.join(unit.select(F.col("vec_id").alias("vec_a"), F.col("v").alias("a")), "vec_a").join(unit.select(F.col("vec_id").alias("vec_b"), F.col("v").alias("b")), "vec_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(k), dims).astype(np.float64) for k in (2, 3))
            cosine = np.einsum("nd,nd->n", a, b)
            good = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(cosine).filter(good)], ["vec_a", "vec_b", "cosine"])

    return both.select("vec_a", "vec_b", "a", "b").mapInArrow(run, _PAIRS)


def _range(unit: DataFrame, members: DataFrame, edges: DataFrame, threshold: float, beam: int, dims: int) -> DataFrame:
    """All pairs that the search in home shards, and the edges that leave them, lead to."""
    lists = edges.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    lists = cut(lists)
    met = cut(members.join(lists, "vec_id").groupBy("shard").applyInArrow(_search(dims, threshold, beam), _PAIRS))
    found = cut(met.where("cosine IS NOT NULL").groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine")))
    asked = met.where("cosine IS NULL").select("vec_a", "vec_b")
    reach = math.acos(max(-1.0, min(1.0, threshold - SLACK)))
    while True:
        fresh = cut(_verified(unit, asked, threshold, dims).join(found, ["vec_a", "vec_b"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = cut(found.unionByName(fresh))
        ends = fresh.select("vec_a", "vec_b", "cosine").union(fresh.select("vec_b", "vec_a", "cosine"))
        step = ends.join(lists.select(F.col("vec_id").alias("vec_b"), F.explode("edges").alias("e")), "vec_b")
        asked = step.where(F.acos(F.least(F.lit(1.0), F.col("e.cosine").cast("double"))) <= F.acos(F.least(F.lit(1.0), F.col("cosine"))) + reach + 1e-3).select("vec_a", F.col("e.to").alias("vec_b"))


def exact_pairs(unit: DataFrame, dims: int, threshold: float, queries: DataFrame) -> DataFrame:
    """(vec_id, vec_a, vec_b, cosine) of each of some few queries with all vectors, by comparing them all."""
    few = queries.toArrow()
    ids, q = few.column("vec_id").to_numpy(), _matrix(few.column("v"), dims)
    sent = unit.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = sent.value
        for batch in batches:
            others, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            for part in np.array_split(np.arange(len(x)), max(1, len(x) * len(own) // 4_000_000)):
                row, k = np.nonzero(x[part] @ own.T >= threshold - SLACK)
                row = part[row]
                cosine = np.einsum("nd,nd->n", x[row].astype(np.float64), own[k].astype(np.float64))
                good = (cosine >= threshold) & (others[row] != own_ids[k])
                other, one = others[row[good]], own_ids[k[good]]
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.minimum(other, one)), pa.array(np.maximum(other, one)), pa.array(cosine[good])], ["vec_id", "vec_a", "vec_b", "cosine"])

    return unit.mapInArrow(run, "vec_id bigint, vec_a bigint, vec_b bigint, cosine double")


def _probes(unit: DataFrame, threshold: float, dims: int, first_id: int) -> DataFrame:
    """(vec_id, d, v): noisy copies of hashed vectors, at cosines from just over the threshold to half of the way to 1."""
    chosen = unit.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(AUDITED).select("v").toArrow()
    x = _matrix(chosen.column("v"), dims).astype(np.float64)
    rng = np.random.default_rng(11)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    cosine = threshold + (1 - threshold) * np.linspace(0.01, 0.5, len(x))[:, None]
    noisy = cosine * x + np.sqrt(np.maximum(0, 1 - cosine**2)) * aside
    noisy /= np.maximum(np.linalg.norm(noisy, axis=1, keepdims=True), 1e-12)
    table = pa.table({"vec_id": pa.array(first_id + np.arange(len(x)), pa.int64()), "d": pa.array(np.full(len(x), dims), pa.int32()), "v": pa.array(list(noisy.astype(np.float32)), pa.list_(pa.float32()))})
    return cut(unit.sparkSession.createDataFrame(table))


def _recall(truth: DataFrame, pairs: DataFrame) -> float:
    """The mean, over the audited vectors that have partners, of the share of their partners that was found."""
    hits = truth.join(pairs.select("vec_a", "vec_b", F.lit(1.0).alias("hit")), ["vec_a", "vec_b"], "left")
    share = hits.groupBy("vec_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share")).agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share


def _of_dimension(unit: DataFrame, dims: int, threshold: float, shard_size: int, target: float) -> DataFrame:
    low, high, n = unit.agg(F.min("vec_id"), F.max("vec_id"), F.count("*")).first()
    first_id = low - AUDITED if low > -(2**62) else high + 1
    probes = _probes(unit, threshold, dims, first_id)
    audited = probes.unionByName(unit.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(AUDITED))
    every = unit.unionByName(probes)
    truth = cut(exact_pairs(every.select("vec_id", "v"), dims, threshold, audited.select("vec_id", "v")))
    overlap, beam = OVERLAP, BEAM
    while True:
        members = _members(every, n, overlap, shard_size, dims)
        edges = members.groupBy("shard").applyInArrow(_edges(dims), "vec_id bigint, edges array<struct<to: bigint, cosine: float>>")
        pairs = _range(every, members, edges, threshold, beam, dims)
        recall = _recall(truth, pairs)
        _log.info("audited recall %.4f (overlap %d, beam %d)", recall, overlap, beam)
        if recall >= target:
            probe = lambda c: F.col(c).between(first_id, first_id + AUDITED - 1)
            return pairs.where(~probe("vec_a") & ~probe("vec_b"))
        if overlap * shard_size > 2 * n and beam >= 8 * BEAM:
            raise RuntimeError(f"audited recall {recall:.4f} is below {target} with every vector in every shard")
        overlap, beam = 2 * overlap, 2 * beam


def near_pairs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, shard_size: int = SHARD_SIZE, target: float = TARGET_RECALL) -> DataFrame:
    """(vec_a, vec_b, cosine), vec_a < vec_b: pairs of ids with a cosine of at least threshold.

    Every vector is a query, and no number of partners is capped. Vectors of different dimensions are
    searched apart and never form a pair. Vectors that are null, empty, zero or hold a null, a nan or an
    infinity match nothing; rows with a null id are left out; an id given twice counts once for each
    dimension, with the least of its vectors, and never pairs with itself. Ties don't matter: all pairs
    within the threshold count. An empty table gives no rows; other columns are ignored, whatever their
    names. If no setting reaches the target recall, that is an error, not a result.
    """
    unit, found = _usable(vectors, id_col, vector_col), None
    for row in sorted(unit.groupBy("d").count().collect()):  # a row for each dimension in use
        if row["count"] > 1:
            part = _of_dimension(unit.where(F.col("d") == row["d"]), row["d"], threshold, shard_size, target)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], _PAIRS)
    return found.groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))
