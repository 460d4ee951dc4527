"""Classes of near-duplicate embeddings: one row a vector, with its class and its number of links.

1. Equal vectors become one, with a weight. Linked are vectors whose cosine reaches the threshold.
2. A table of random hyperplanes gives every vector a cell: one bit for each side of the plane through the
   median of a hashed sample of at most SAMPLE vectors. A pair meets in a table if it shares the cell. The
   bits and the number of tables are fitted on that sample and noisy copies of it that lie exactly at the
   threshold: of all settings by which a share of MEET of these meet somewhere, the cheapest is taken.
   No bits at all, where everything is compared with everything, is one of them and is taken while
   tables are small. All vectors, not only the sample's, are put into all tables.
3. All that share a cell are compared, by blocks of a matrix product. A cell of over a chunk of vectors is
   cut into chunks, and every two chunks are compared as a group of their own: no cell is too large, none
   is cut short, and a task holds two chunks. A pair counts only in the first table where it meets, which
   its cells tell. A group gives for each linked vector the sum of its partners' weights and one member of
   its component in the group, never the pairs, so what is written grows with the vectors.
4. Recall is audited against brute force: noisy copies of hashed vectors just within the threshold are
   searched for along with the rest, without counting as anybody's partners, and for them and as many
   real vectors all links are counted exactly. Below the target the bits are halved and the search is
   done again; without bits it is exact.
"""

from __future__ import annotations

import gc
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.vectors import AUDITED, SLACK, TARGET_RECALL, THRESHOLD, _matrix, _probes, _usable
from ledgerline.storage import cut

#: Vectors on which hyperplanes, bits and tables are fitted.
SAMPLE = 8192
#: The share of pairs exactly at the threshold that has to meet in a table.
MEET = 0.995
MOST_TABLES, MOST_BITS = 48, 16
#: Numbers in a chunk of vectors.
CHUNK_NUMBERS = 1 << 21
#: About the nanoseconds that moving a vector and comparing a pair take, and those for each dimension.
MOVE, PAIR = (30_000, 1_000), (1, 0.03)
#: Rows of a chunk compared at once with another chunk.
ROWS = 128
#: Tables in one shuffle.
TABLES_A_PASS = 2
#: Bytes of vectors in a partition of the shuffle.
PARTITION = 32 << 20
_log = logging.getLogger(__name__)
_FOUND = "vec_id bigint, links bigint, root bigint"


def _noisy(x: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    aside = np.random.default_rng(seed).normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    return (cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * aside).astype(np.float32)


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of x as bytes: they are moved as they are, lists of numbers one by one."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    rows = [np.zeros((0, width), kind)]
    for part in parts:
        if len(part):
            first = np.frombuffer(part.buffers()[1], np.int32)[part.offset]
            rows.append(np.frombuffer(part.buffers()[2], np.uint8, len(part) * width * np.dtype(kind).itemsize, first).view(kind).reshape(-1, width))
    return rows[1] if len(rows) == 2 else np.concatenate(rows)


def chunk_size(dims: int) -> int:
    return max(64, min(1 << 15, CHUNK_NUMBERS // dims))


def fit(sample: np.ndarray, n: int, threshold: float, most_bits: int = MOST_BITS, least_bits: int = 0) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(directions, medians, bits, tables): the cheapest setting by which pairs at the threshold meet."""
    dims = sample.shape[1]
    directions = np.random.default_rng(17).normal(size=(dims, MOST_TABLES * max(1, most_bits))).astype(np.float32) / np.float32(math.sqrt(dims))
    at = sample @ directions
    medians = np.median(at, axis=0).astype(np.float32)
    own, other = (z > medians for z in (at[:2000], _noisy(sample[:2000], threshold, 18) @ directions))
    same, side, chunk, best = own == other, at > medians, chunk_size(dims), None
    for bits in range(least_bits, most_bits + 1):
        met, tables = np.zeros(len(same), bool), 0
        while met.mean() < MEET and tables < (MOST_TABLES if bits else 1):
            met |= same[:, tables * bits : (tables + 1) * bits].all(axis=1)
            tables += 1
        if met.mean() < MEET:
            break
        sizes = np.unique(side[:, :bits] @ (1 << np.arange(bits)), return_counts=True)[1] if bits else np.array([len(side)])
        crowd = n * (sizes * (sizes - 1.0)).sum() / max(1, len(side) * (len(side) - 1))  # that a vector meets on average
        copies = (sizes * np.ceil(sizes * (n / len(side)) / chunk)).sum() / len(side)
        cost = tables * (copies * (MOVE[0] + MOVE[1] * dims) + crowd * (PAIR[0] + PAIR[1] * dims))
        if best is None or cost < best[0]:
            best = cost, bits, tables
    if best is None:  # so many bits need too many tables
        return fit(sample, n, threshold, least_bits // 2, least_bits // 2)
    _, bits, tables = best
    return directions[:, : bits * tables], medians[: bits * tables], bits, tables


def _coded(vectors: DataFrame, directions: np.ndarray, medians: np.ndarray, bits: int, tables: int, dims: int) -> DataFrame:
    """vectors with the cells of all tables; kept, as rounding may put a vector close to a plane on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits)
        for batch in batches:
            side = _matrix(batch.column(2), dims) @ directions > medians
            codes = (side.reshape(batch.num_rows, tables, bits) @ power if bits else np.zeros((batch.num_rows, tables))).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(_matrix(batch.column(2), dims)), _packed(codes)], ["vec_id", "w", "v", "codes"])

    return cut(vectors.select("vec_id", "w", "v").mapInArrow(run, "vec_id bigint, w bigint, v binary, codes binary"))


def _large_cells(coded: DataFrame, tables: int, chunk: int) -> dict[tuple[int, int], int]:
    """(table, cell): the number of vectors, of cells with over a chunk of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _unpacked(batch.column(0), np.uint16, tables).astype(np.int64)
            which, n = np.unique(codes + (np.arange(tables) << MOST_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(n.astype(np.int64))], ["cell", "n"])

    rows = coded.select("codes").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > chunk).collect()
    return {(r["cell"] >> MOST_BITS, r["cell"] & (1 << MOST_BITS) - 1): r["n"] for r in rows}


def _sent(coded: DataFrame, tables: int, first: int, last: int, large: dict[tuple[int, int], int]) -> DataFrame:
    """A row for each group that a vector belongs to: in a cell of so many chunks, one for each chunk that its own is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _unpacked(batch.column(3), np.uint16, tables).astype(np.int32)
            mixed = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for t in range(first, last):
                chunks = np.array([large.get((t, int(c)), 1) for c in codes[:, t]], np.int64)
                own = (mixed % chunks.astype(np.uint64)).astype(np.int64)
                for j in range(chunks.max(initial=0)):
                    rows = np.flatnonzero(chunks > j)
                    a, b = np.minimum(own[rows], j), np.maximum(own[rows], j)
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)) for z in (np.full(len(rows), t), codes[rows, t], a, b, own[rows])] + part.columns, ["t", "cell", "i", "j", "chunk", "vec_id", "w", "v", "codes"])

    return coded.mapInArrow(run, "t int, cell int, i int, j int, chunk int, vec_id bigint, w bigint, v binary, codes binary")


def connect(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, where each node has its component's least node, after the components of a and b have been united."""
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root != root[root]).any():
            root = root[root]


def _compare(dims: int, tables: int, threshold: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        t, i, j = (key[k].as_py() for k in (0, 2, 3))
        ids, w, x = group.column("vec_id").to_numpy(), group.column("w").to_numpy(), _unpacked(group.column("v"), np.float32, dims)
        codes = np.ascontiguousarray(_unpacked(group.column("codes"), np.uint16, tables).T)
        mine = group.column("chunk").to_numpy() == i
        rows = np.flatnonzero(mine)
        columns = rows if i == j else np.flatnonzero(~mine)
        xc = np.ascontiguousarray(x[columns].T)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for start in range(0, len(rows), ROWS):
            own, others = rows[start : start + ROWS], columns[start:] if i == j else columns
            score = x[own] @ (xc[:, start:] if i == j else xc)
            hit = score >= threshold - SLACK
            if i == j:
                hit = np.triu(hit, 1)
            if not hit.any():
                continue
            r, c = np.nonzero(hit)
            sure = score[r, c] >= threshold + SLACK
            a, b = own[r], others[c]
            for s in range(t):
                new = codes[s][a] != codes[s][b]
                a, b, sure = a[new], b[new], sure[new]
            doubt = np.flatnonzero(~sure)
            for k in range(0, len(doubt), 65536):
                some = doubt[k : k + 65536]
                sure[some] = np.einsum("nd,nd->n", x[a[some]].astype(np.float64), x[b[some]].astype(np.float64)) >= threshold
            a, b = a[sure], b[sure]
            for one, other in ((a, b), (b, a)):
                links += np.bincount(one, weights=w[other], minlength=len(ids)).astype(np.int64)
            real = (w[a] > 0) & (w[b] > 0)
            root = connect(root, a[real], b[real])
        at = np.flatnonzero(links)
        return pa.table({"vec_id": ids[at], "links": links[at], "root": ids[root[at]]})

    return run


def _found(every: DataFrame, n: int, planes: tuple[np.ndarray, np.ndarray, int, int], threshold: float, dims: int) -> DataFrame:
    """(vec_id, links, root) of every group's linked vectors."""
    spark = every.sparkSession
    tables, chunk = planes[3], chunk_size(dims)
    coded = _coded(every, *planes, dims)
    sizes = _large_cells(coded, tables, chunk)
    large = {cell: -(-count // chunk) for cell, count in sizes.items()}
    found = None
    for first in range(0, tables, TABLES_A_PASS):
        last = min(tables, first + TABLES_A_PASS)
        rows = n * (last - first) + sum(count * (large[cell] - 1) for cell, count in sizes.items() if first <= cell[0] < last)
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * dims * 4 // PARTITION)
        keys = ["t", "cell", "i", "j"]
        part = cut(_sent(coded, tables, first, last, large).repartition(partitions, *keys).groupBy(*keys).applyInArrow(_compare(dims, tables, threshold), _FOUND))
        found = part if found is None else found.unionByName(part)
        if last < tables:  # the shuffle's files stay until the driver's garbage is collected
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    return found


def true_links(every: DataFrame, queries: DataFrame, threshold: float, dims: int) -> DataFrame:
    """(vec_id, links) of some few queries, by comparing them with all vectors; those without links are left out."""
    few = queries.toArrow()
    own_ids, own = few.column("vec_id").to_numpy(), _matrix(few.column("v"), dims)
    sent = every.sparkSession.sparkContext.broadcast((own_ids, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = sent.value
        links = np.zeros(len(own), np.int64)
        for batch in batches:
            ids, w, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dims)
            for part in np.array_split(np.arange(len(x)), max(1, len(x) * len(own) // 4_000_000)):
                row, k = np.nonzero(x[part] @ own.T >= threshold - SLACK)
                row = part[row]
                good = (np.einsum("nd,nd->n", x[row].astype(np.float64), own[k].astype(np.float64)) >= threshold) & (ids[row] != own_ids[k])
                links += np.bincount(k[good], weights=w[row[good]], minlength=len(own)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own_ids), pa.array(links)], ["vec_id", "links"])

    return every.select("vec_id", "w", "v").mapInArrow(run, "vec_id bigint, links bigint").groupBy("vec_id").agg(F.sum("links").alias("links")).where("links > 0")


def _recall(truth: DataFrame, links: DataFrame) -> float:
    """The mean, over the audited vectors that have links, of the share of them that was found."""
    both = truth.join(links.select("vec_id", F.col("links").alias("hits")), "vec_id", "left")
    share = both.agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("links"))).first()[0]
    return 1.0 if share is None else share


def _of_dimension(unit: DataFrame, dims: int, threshold: float, target: float, bits: int | None) -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep, links) of all vectors of a dimension, and (a, b) that connect the classes of reps."""
    equal = Window.partitionBy("v")
    placed = cut(unit.select("vec_id", "v", F.min("vec_id").over(equal).alias("rep"), F.count("*").over(equal).alias("w")))
    firsts = placed.where("vec_id = rep").select("vec_id", "v", "w")
    low, high, n = firsts.agg(F.min("vec_id"), F.max("vec_id"), F.count("*")).first()
    probes = _probes(firsts.withColumn("d", F.lit(dims)), threshold, dims, low - AUDITED if low > -(2**62) else high + 1).select("vec_id", "v", F.lit(0).cast("bigint").alias("w"))
    every = firsts.unionByName(probes)
    audited = probes.unionByName(firsts.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(AUDITED).select("vec_id", "v", "w"))
    truth = cut(true_links(every, audited, threshold, dims))
    sample = _matrix(firsts.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v"), dims)
    planes = fit(sample, n, threshold) if bits is None else fit(sample, n, threshold, bits, bits)
    while True:
        found = _found(every, n, planes, threshold, dims)
        links = cut(found.groupBy("vec_id").agg(F.sum("links").alias("links")))
        recall = _recall(truth, links)
        _log.info("audited recall %.4f (%d vectors, %d bits, %d tables)", recall, n, *planes[2:])
        if recall >= target:
            break
        if not planes[2]:
            raise RuntimeError(f"audited recall {recall:.4f} is below {target} though all were compared with all")
        planes = fit(sample, n, threshold, planes[2] // 2, planes[2] // 2)
    placed = placed.select("vec_id", "rep", "w").join(links.select(F.col("vec_id").alias("rep"), "links"), "rep", "left")
    edges = found.where("vec_id != root").select(F.col("vec_id").alias("a"), F.col("root").alias("b"))
    return placed.select("vec_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links")), edges


def near_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, target: float = TARGET_RECALL, bits: int | None = None) -> DataFrame:
    """(vec_id, class_id, links), a row for each id that isn't null: the least id of all that links lead to,
    and the number of vectors linked to it, those with a cosine of at least threshold.

    Copies count as links, and no number of them is capped. Vectors of different dimensions are never
    linked. What is null, empty, zero or holds a null, a nan or an infinity is a class of its own without
    links; an id given twice counts once for each dimension, with the least of its vectors, its links
    are summed over dimensions and join its classes. bits is the number of bits of a table, else fitted.
    """
    ids = vectors.select(F.col(id_col).cast("bigint").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    unit = _usable(vectors, id_col, vector_col)
    dimensions = sorted(row["d"] for row in unit.groupBy("d").count().collect())
    placed = edges = None
    for d in dimensions:
        own, links = _of_dimension(unit.where(F.col("d") == d), d, threshold, target, bits)
        if len(dimensions) > 1:
            links = links.union(own.where("vec_id != rep").select("vec_id", "rep"))
        placed, edges = (own, links) if placed is None else (placed.unionByName(own), edges.unionByName(links))
    if placed is None:
        return ids.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    labels = components(edges).select(F.col("node").alias("rep"), "component")
    every = placed.groupBy("vec_id").agg(F.min("rep").alias("rep"), F.sum("links").alias("links")).join(labels, "rep", "left")
    return ids.join(every, "vec_id", "left").select("vec_id", F.coalesce("component", "rep", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


#: The same by comparing all pairs, for tables small enough.
ORACLE = """WITH RECURSIVE given AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
usable AS (SELECT vec_id, len(v) AS d, v, list_sum(list_transform(v, lambda x: x * x)) AS n FROM given WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
unit AS (SELECT vec_id, d, min(list_transform(v, lambda x: CAST(x / sqrt(n) AS FLOAT))) AS v FROM usable WHERE n > 0 AND isfinite(n) GROUP BY vec_id, d),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.d = b.d AND a.vec_id != b.vec_id WHERE CASE WHEN a.v = b.v THEN TRUE WHEN a.d = b.d THEN list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) >= 0.95 END),
reach AS (SELECT DISTINCT vec_id AS a, vec_id AS b FROM given UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT c.a AS vec_id, c.class_id, coalesce(n, 0)::BIGINT AS links FROM classes c LEFT JOIN counts USING (a)"""
