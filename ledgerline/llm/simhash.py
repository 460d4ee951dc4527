"""SimHash near-duplicates by meet-in-the-middle balls around samples of the signature's bits.

A document's signature has 256 bits over its distinct words. A table samples some of these bits as a
fingerprint, and every fingerprint emits all its variants within half of RADIUS. Fingerprints that are
within RADIUS of each other have a variant in common, so they meet after one shuffle on the variants.
Pairs that meet are verified by the Hamming distance of their whole signatures and deduplicated.

Variants are shuffled by their first bits. Those of a fingerprint that agree in these travel as one row,
the signature itself, and are written out where they meet: instead of 1 + bits rows a fingerprint sends
1 + prefix, and as the signature is there, pairs are verified on the spot. The prefix grows with the
logarithm of the documents.

Two signatures that differ in d bits are within RADIUS in a table with a probability q that follows from
the hypergeometric distribution, and meet in one of n tables with 1 - (1 - q) ** n. The number of tables
follows from the greatest distance that counts: a pair just there meets with probability MEET, a nearer
one with more. More bits a fingerprint take more tables and bring fewer chance meetings, whose number
grows with the square of the documents; bits is a parameter, up to 64.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.words import blocks, mix, text_buffer, words
from ledgerline.storage import cut

#: Bits of one fingerprint.
BITS = 28
#: Fingerprints within this distance meet; each emits its variants within half of it.
RADIUS = 2
#: Verified pairs differ in at most so many of the 256 bits (cosine of about 0.83).
MAX_DISTANCE = 48
#: The probability that a pair at the greatest distance meets in a table.
MEET = 0.9
#: Signatures (40 bytes each) that one group of the shuffle holds on average.
SIGNATURES_A_GROUP = 1 << 18
#: Variants that a group writes out at a time.
VARIANTS_AT_ONCE = 1 << 21
#: A variant where more signatures meet gives the edges of a spanning forest, found by comparing all of
#: them, instead of all its pairs. Both connect exactly what the verified pairs connect.
PAIRWISE = 16

_U = np.uint64
_LANES = np.array([sum(1 << (8 * k) for k in range(8) if b >> k & 1) for b in range(256)], np.uint64)
_SIGNATURE = ["s0", "s1", "s2", "s3"]


def block_signatures(raw: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with words among first .. last, and their signatures as four 64-bit numbers.

    Bits are counted in eight byte-wide lanes of a number, over segments of at most 255 words.
    """
    found = words(raw, offsets, first, last)
    key = (found.doc_index.astype(np.uint64) << _U(52)) | (found.hashes >> _U(12))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    count = np.bincount((key >> _U(52)).astype(np.int64), minlength=last - first)
    rows = np.flatnonzero(count)
    if not len(rows):
        return rows, np.zeros((0, 4), np.int64)
    count = count[rows]
    segments = -(-count // 255)
    segment_first = np.cumsum(segments) - segments
    owner = np.repeat(np.arange(len(rows)), segments)
    at = (np.cumsum(count) - count)[owner] + 255 * (np.arange(len(owner)) - segment_first[owner])
    lanes = np.empty((len(at), 32), np.uint64)
    for k in range(4):
        random = mix(key << _U(12), k + 1).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            lanes[:, 8 * k + j] = np.add.reduceat(_LANES[random[:, j]], at)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(len(at), 256).astype(np.int32), segment_first, axis=0)
    return first + rows, np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, s0 .. s3) for each row, h being a hash of its text; without any word the signature is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            for first, last in blocks(offsets):
                rows, found = block_signatures(raw, offsets, first, last)
                own, none = np.zeros((4, last - first), np.int64), np.ones(last - first, bool)
                own[:, rows - first], none[rows - first] = found.T, False
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in (0, 1)), *(pa.array(x, mask=none) for x in own)], ["doc_id", "h", *_SIGNATURE])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, h bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def tables(max_distance: int = MAX_DISTANCE, bits: int = BITS) -> int:
    """How many tables let a pair at max_distance meet with probability MEET."""
    if not RADIUS < bits <= 64:
        raise ValueError(f"bits has to be between {RADIUS + 1} and 64")
    if not 0 <= max_distance <= 256 - bits:
        raise ValueError(f"max_distance has to be between 0 and {256 - bits}")
    q = sum(math.comb(max_distance, j) * math.comb(256 - max_distance, bits - j) for j in range(RADIUS + 1)) / math.comb(256, bits)
    return 1 if q >= MEET else math.ceil(math.log(1 - MEET) / math.log1p(-q))


def sampled_bits(count: int, bits: int = BITS) -> np.ndarray:
    """The bits that each of count tables samples, drawn from a fixed seed."""
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(256)[:bits] for _ in range(count)])


def ball(bits: int, radius: int = RADIUS // 2) -> np.ndarray:
    """The masks that turn a fingerprint into each of its variants within the radius, itself first."""
    return np.array([sum(1 << k for k in flips) for r in range(radius + 1) for flips in itertools.combinations(range(bits), r)], np.uint64)


def fingerprints(prints: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The sampled bits of each signature, the first one highest."""
    sample = np.zeros((len(prints), 64), np.uint8)
    sample[:, : len(positions)] = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, positions[::-1]]
    return np.packbits(sample, axis=1, bitorder="little").view(np.uint64).ravel()


def _rows(count: int, bits: int, prefix: int):
    """(table and prefix, signatures as bytes, ids as bytes): each signature once for every prefix of its variants."""
    positions, masks = sampled_bits(count, bits), ball(prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 10_000):
                part = batch.slice(start, 10_000)
                ids = part.column(0).to_numpy()
                prints = np.stack([part.column(k + 1).to_numpy() for k in range(4)], axis=1)
                for t in range(count):
                    homes = ((fingerprints(prints, positions[t]) >> _U(bits - prefix))[:, None] ^ masks).ravel() if prefix else np.zeros(len(ids), np.uint64)
                    order = np.argsort(homes, kind="stable")
                    found, first = np.unique(homes[order], return_index=True)
                    owners = [own // len(masks) for own in np.split(order, first[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array((t << prefix) + found.astype(np.int64)), pa.array([prints[own].tobytes() for own in owners], pa.binary()), pa.array([ids[own].tobytes() for own in owners], pa.binary())], ["home", "prints", "ids"])

    return run


def variants(center: np.ndarray, bits: int, prefix: int, value: int, radius: int = RADIUS // 2) -> tuple[np.ndarray, np.ndarray]:
    """The variants within the radius that have that prefix, and the places of their fingerprints."""
    low = bits - prefix
    flips = np.bitwise_count((center >> _U(low)) ^ _U(value)) if prefix else np.zeros(len(center), np.uint8)
    rest = center & _U((1 << low) - 1) if low < 64 else center
    points, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for f in range(radius + 1):
        own = np.flatnonzero(flips == f)
        masks = ball(low, radius - f)
        points.append(((_U(value << low if low < 64 else 0) | rest[own])[:, None] ^ masks).ravel())
        owners.append(np.repeat(own, len(masks)))
    return np.concatenate(points), np.concatenate(owners)


def _near(prints: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 18):
        own = slice(k, k + (1 << 18))
        out[own] = np.bitwise_count(prints[a[own]] ^ prints[b[own]]).sum(axis=1) <= most
    return out


def _meet(count: int, bits: int, prefix: int, most: int):
    """Verified edges (a, b), a < b, of the signatures that have a variant with the group's prefix in common.

    A variant with up to PAIRWISE signatures gives all its verified pairs, a fuller one the edges of a
    spanning forest; variants with the same members are linked once.
    """
    positions = sampled_bits(count, bits)

    def run(group: pa.Table) -> pa.Table:
        home = group.column("home")[0].as_py()
        prints = np.frombuffer(b"".join(group.column("prints").to_pylist()), np.uint64).reshape(-1, 4)
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), np.int64)
        center = fingerprints(prints, positions[home >> prefix])
        value, more = home & ((1 << prefix) - 1), 0
        while len(ids) * (bits + 1) >> more > VARIANTS_AT_ONCE and prefix + more < bits:
            more += 1
        edges, linked = [np.zeros((0, 2), np.int64)], set()
        for inner in range(1 << more):
            points, owners = variants(center, bits, prefix + more, (value << more) + inner)
            order = np.argsort(points, kind="stable")
            points, owners = points[order], owners[order]
            starts = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]])) if len(points) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(points)))
            for m in np.unique(sizes[(sizes > 1) & (sizes <= PAIRWISE)]):
                members = owners[starts[sizes == m][:, None] + np.arange(m)]
                i, j = np.triu_indices(m, 1)
                a, b = members[:, i].ravel(), members[:, j].ravel()
                near = _near(prints, a, b, most)
                edges.append(np.stack([ids[a[near]], ids[b[near]]], axis=1))
            for k in np.flatnonzero(sizes > PAIRWISE):
                members = np.sort(owners[starts[k] : starts[k] + sizes[k]])
                if (key := members.tobytes()) not in linked:
                    linked.add(key)
                    edges.append(np.array(forest(ids[members], prints[members], most), np.int64).reshape(-1, 2))
        found = np.unique(np.sort(np.concatenate(edges), axis=1), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def forest(ids: np.ndarray, prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect exactly what all pairs at distance most or less would connect."""
    left, edges, frontier = np.arange(1, len(ids)), [], [0]
    while len(left):
        if not frontier:
            frontier, left = [left[0]], left[1:]
        k = frontier.pop()
        near = np.bitwise_count(prints[left] ^ prints[k]).sum(axis=1) <= most
        edges += [(ids[k], ids[x]) for x in left[near]]
        frontier += left[near].tolist()
        left = left[~near]
    return edges


def near_duplicate_edges(prints: DataFrame, max_distance: int = MAX_DISTANCE, bits: int = BITS) -> DataFrame:
    """Verified edges (a, b), a < b, among rows (id, s0 .. s3) with distinct ids and signatures.

    They connect what all verified pairs that meet in a variant connect: one with up to PAIRWISE members
    gives all its pairs, a fuller one the edges of a spanning forest found by comparing all of its
    members, so that groups of thousands give no quadratic output.
    """
    n, count = max(1, prints.count()), tables(max_distance, bits)
    prefix = min(bits, max(0, math.ceil(math.log2(n / SIGNATURES_A_GROUP))))
    rows = prints.select("id", *_SIGNATURE).mapInArrow(_rows(count, bits, prefix), "home bigint, prints binary, ids binary")
    return rows.groupBy("home").applyInArrow(_meet(count, bits, prefix, max_distance), "a bigint, b bigint").distinct()


def _nodes(found: DataFrame) -> DataFrame:
    """(id, s0 .. s3), a row for each signature: the least doc_id that has it where no other signature has
    the same least one; otherwise, and where all ids are null, a number from the end of the bigints."""
    least = cut(found.groupBy(*_SIGNATURE).agg(F.min("doc_id").alias("id")))
    first = F.row_number().over(Window.partitionBy("id").orderBy(*_SIGNATURE)) == 1
    named = least.where("id IS NOT NULL").withColumn("id", F.when(first, F.col("id")))
    aside = F.lit(2**63 - 1) - F.monotonically_increasing_id()
    return cut(named.unionByName(least.where("id IS NULL")).withColumn("id", F.coalesce("id", aside)))


def _kept_first(group: Column | str) -> Column:
    """Whether a row is the first of its group by doc_id, nulls last, and hash of the text."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("h").alias("h"))
    return order == F.min(order).over(Window.partitionBy(group))


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_distance: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, group_id) of each distinct row of id and text with words, and (doc_id, h) of those without."""
    every = cut(signatures(docs, id_col, text_col).distinct())
    found = every.where("s0 IS NOT NULL")
    firsts = _nodes(found)
    labels = components(near_duplicate_edges(firsts, max_distance, bits))
    grouped = found.join(firsts, _SIGNATURE).join(labels, F.col("id") == F.col("node"), "left").select("doc_id", "h", F.coalesce("component", "id").alias("group_id"))
    return grouped, every.where("s0 IS NULL").select("doc_id", "h")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, bits: int = BITS) -> DataFrame:
    """(doc_id, group_id, keep): the near-duplicate group of each distinct row of id and text.

    A group is a connected component of verified pairs; its id is the smallest doc_id in it, and only the
    first of its rows, by doc_id with nulls last and then by a hash of the text, has keep = true. A
    second group with the same smallest id (two different texts share that id) and one of null ids alone
    get a number from the end of the bigints instead. Rows with a null or empty text or without any word
    are groups of their own, each kept, with their doc_id as group_id; those of one id count once, those
    with a null id together. Rows that repeat count once; ties in distance don't matter, for all pairs
    within it count. Case and punctuation play no part, and very long texts are read whole. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    grouped, alone = _grouped(docs, id_col, text_col, max_distance, bits)
    alone = alone.select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("group_id"), F.lit(True).alias("keep"))
    return grouped.select("doc_id", "group_id", _kept_first("group_id").alias("keep")).unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, bits: int = BITS) -> DataFrame:
    """docs with one row of each group of simhash_groups: all columns, texts untouched.

    Of rows that repeat an id and a text one stays, whatever their other columns hold. Rows without a
    word can't be compared and all stay.
    """
    text = F.col(text_col).cast("string")
    units = cut(_grouped(docs, id_col, text_col, max_distance, bits)[0].select("doc_id", "h", _kept_first("group_id").alias("keep")))
    dropped = units.where("NOT keep").select(F.col("doc_id").alias("__i"), F.col("h").alias("__h"))
    keyed = docs.withColumn("__unit", F.struct(F.col(id_col).cast("bigint").alias("i"), F.xxhash64(text).alias("h")))
    kept = keyed.join(dropped, F.col("__unit.i").eqNullSafe(F.col("__i")) & (F.col("__unit.h") == F.col("__h")), "left_anti")
    times = keyed.groupBy("__unit").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("__unit.i").alias("doc_id"), F.col("__unit.h").alias("h"))
    repeated = cut(times.join(units.where("keep"), times["doc_id"].eqNullSafe(units["doc_id"]) & (times["h"] == units["h"]), "left_semi").select(F.col("doc_id").alias("__i"), F.col("h").alias("__h")))
    if repeated.isEmpty():
        return kept.drop("__unit")
    same = F.col("__unit.i").eqNullSafe(F.col("__i")) & (F.col("__unit.h") == F.col("__h"))
    single = kept.join(repeated, same, "left_anti").drop("__unit")
    firsts = kept.join(repeated, same, "left_semi").withColumn("__k", F.row_number().over(Window.partitionBy("__unit").orderBy(F.lit(0)))).where("__k = 1").drop("__k", "__unit")
    return single.unionByName(firsts)
