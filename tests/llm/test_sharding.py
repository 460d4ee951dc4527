import collections

import duckdb

from ledgerline.llm import sharding as S


def placed(df, leaves=S.LEAVES):
    return {r.doc_id: (r.region, r.rack, r.shard) for r in S.assign(df, leaves=leaves).collect()}


def test_shares_follow_weights(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    counts = collections.Counter(placed(keys).values())
    total = sum(w for *_, w in S.LEAVES)
    for region, rack, shard, w in S.LEAVES:
        mean = 40_000 * w / total
        assert abs(counts[region, rack, shard] - mean) < 5 * mean**0.5


def test_keys_move_only_with_changed_weights(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    region, rack, shard, w = S.LEAVES[5]
    more = [(*x[:3], x[3] + 3) if x[:3] == (region, rack, shard) else x for x in S.LEAVES]
    before, after = placed(keys), placed(keys, more)
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(after[k][0] == region for k in moved)  # other regions only lose
    assert all(after[k][1] == rack for k in moved if before[k][0] == region)  # its other racks lose to the changed one
    assert all(after[k][2] == shard for k in moved if before[k][:2] == (region, rack))
    gone = [x for x in S.LEAVES if x[:3] != (region, rack, shard)]
    after = placed(keys, gone)
    assert all(before[k] == (region, rack, shard) or after[k] == before[k] or before[k][0] == region for k in before)
    stay = [k for k in before if before[k] != after[k] and before[k] != (region, rack, shard)]
    assert all(after[k][:2] != (region, rack) for k in stay if before[k][:2] == (region, rack))


def test_sql_gives_the_same(spark, make_docs, tmp_path):
    docs = make_docs([(k, "x") for k in range(2000)] + [(None, "x"), (7, "x"), (7, None)])
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    expected = sorted(map(str, con.sql(f"SELECT doc_id, region, rack, shard FROM ({S.oracle()})").fetchall()))
    assert sorted(str(tuple(r)) for r in S.assign(docs).collect()) == expected


def test_odd_rows(spark, odd_docs, make_docs):
    assert S.assign(odd_docs).count() == odd_docs.count()
    assert S.assign(make_docs([])).count() == 0
    assert {(r.region, r.rack, r.shard) for r in S.assign(odd_docs, leaves=[]).collect()} == {(None, None, None)}
    assert {(r.region, r.rack, r.shard) for r in S.assign(odd_docs, leaves=[("a", "b", "c", 1.0), ("a", "b", "d", 0.0)]).collect()} == {("a", "b", "c")}
