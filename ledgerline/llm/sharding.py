"""Assignment to shards by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws -ln(u) / weight, with u a uniform
number hashed from the key and the child's path, and the least draw wins; so a child gets keys in
proportion to its weight. A draw depends on the child's own path and weight only: when weights change,
keys move only out of or into the children whose weight changed, and below any other child nothing moves.
An inner node weighs what its leaves weigh.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (region, rack, shard, weight): four regions of four racks, racks of two to five shards of unequal weight.
LEAVES = [(f"r{i}", f"k{j}", f"s{k}", float(1 + (i + 2 * j + 3 * k) % 4)) for i in range(4) for j in range(4) for k in range(2 + (i + j) % 4)]
_SCALE = 2.0**52


def _children(leaves: list[tuple[str, str, str, float]]) -> dict[str, list[tuple[str, float]]]:
    """For each inner path its children's names and weights; weights of 0 or less take no keys."""
    out: dict[str, dict[str, float]] = {}
    for region, rack, shard, weight in leaves:
        if weight > 0:
            for parent, child in (("", region), (region, rack), (f"{region}/{rack}", shard)):
                out.setdefault(parent, {})
                out[parent][child] = out[parent].get(child, 0.0) + weight
    return {p: sorted(c.items()) for p, c in out.items()}


def _draw(key: Column, path: str, weight: float) -> Column:
    digest = F.substring(F.md5(F.concat(key, F.lit("|" + path))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(_SCALE)
    return -F.log(u) / F.lit(weight)


def _choice(key: Column, parent: str, children: list[tuple[str, float]]) -> Column:
    draws = [F.struct(_draw(key, f"{parent}/{c}" if parent else c, w).alias("d"), F.lit(c).alias("c")) for c, w in children]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["c"]


def _by_parent(chosen: Column, key: Column, tree: dict[str, list[tuple[str, float]]], parents: list[str]) -> Column:
    out = None
    for p in parents:
        pick = _choice(key, p, tree[p])
        out = F.when(chosen == p, pick) if out is None else out.when(chosen == p, pick)
    return out


def assign(rows: DataFrame, key_col: str = "doc_id", leaves: list[tuple[str, str, str, float]] = LEAVES) -> DataFrame:
    """(key_col, region, rack, shard), a row for each row: its place in the tree.

    Equal keys go to one shard, so rows that repeat stay together; a null key is placed like the key
    'null'. Ties of draws go to the first child by name. Without a leaf of positive weight the places are
    null. An empty table gives no rows; other columns are ignored, whatever their names. Only the key
    column is read, and nothing is shuffled.
    """
    tree = _children(leaves)
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    if not tree:
        return rows.select(key_col, *(F.lit(None).cast("string").alias(c) for c in ("region", "rack", "shard")))
    regions = [c for c, _ in tree[""]]
    racks = [f"{r}/{c}" for r in regions for c, _ in tree[r]]
    out = rows.select(F.col(key_col), key.alias("__key")).withColumn("region", _choice(F.col("__key"), "", tree[""]))
    out = out.withColumn("rack", _by_parent(F.col("region"), F.col("__key"), tree, regions))
    out = out.withColumn("shard", _by_parent(F.concat("region", F.lit("/"), "rack"), F.col("__key"), tree, racks))
    return out.select(key_col, "region", "rack", "shard")


def oracle(leaves: list[tuple[str, str, str, float]] = LEAVES) -> str:
    tree = _children(leaves)
    nodes = ", ".join(f"('{p}', '{c}', '{p + '/' if p else ''}{c}', {w!r}::DOUBLE)" for p, own in tree.items() for c, w in own)
    level = "SELECT d.*, n.child AS {name} FROM {before} d JOIN nodes n ON n.parent = {parent} QUALIFY row_number() OVER (PARTITION BY d.row_no ORDER BY -ln((('0x' || substr(md5(d.key || '|' || n.path), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / n.weight, n.child) = 1"
    return (
        f"WITH nodes(parent, child, path, weight) AS (VALUES {nodes}), "
        "keys AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents), "
        f"one AS ({level.format(name='region', before='keys', parent="''")}), "
        f"two AS ({level.format(name='rack', before='one', parent='d.region')}), "
        f"three AS ({level.format(name='shard', before='two', parent="d.region || '/' || d.rack")}) "
        "SELECT doc_id, region, rack, shard FROM three"
    )
