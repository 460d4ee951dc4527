import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import simhash as S
from ledgerline.llm.words import text_buffer


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def prints_of(texts):
    rows, prints = S.block_signatures(*text_buffer(pa.array(texts, pa.string())), 0, len(texts))
    out = np.zeros((len(texts), 4), np.int64)
    out[rows] = prints
    return out.view(np.uint64)


def test_signature_counts_bits_over_distinct_words(prose):
    texts = [prose(k, n) for k, n in enumerate((1, 3, 254, 255, 256, 700))]
    together, alone = prints_of(texts), np.concatenate([prints_of([t]) for t in texts])
    assert (together == alone).all()
    assert (prints_of([texts[3]]) == prints_of([texts[3].upper() + " " + texts[3]])).all()


def test_groups_against_brute_force(spark, make_docs, prose):
    texts = [prose(k, 120) for k in range(60)]
    texts += [changed(texts[k], 0.03, k) for k in range(30)] + [texts[5], texts[5]] + [changed(texts[7], 0.02, 100 + k) for k in range(40)]
    got = S.simhash_groups(make_docs(list(enumerate(texts)))).toPandas().set_index("doc_id").sort_index()
    prints = prints_of(texts)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= S.MAX_DISTANCE
    pairs = np.argwhere(np.triu(near, 1))
    group = got.group_id.to_numpy()
    assert (group[pairs[:, 0]] == group[pairs[:, 1]]).mean() >= 0.95
    reach = np.linalg.matrix_power(near.astype(float), 32) > 0
    assert all(reach[i, group[i]] for i in range(len(texts)))  # nothing is grouped that near pairs don't connect
    assert (got.keep == (got.group_id == got.index)).all()


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (5, 4)).astype(np.uint64)
    prints = np.concatenate([base[k % 5][None] ^ (np.uint64(1) << rng.integers(0, 60, 4).astype(np.uint64)) for k in range(60)])
    ids = np.arange(60) * 3
    edges = S.forest(ids, prints, 4)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= 4

    def parts(adjacent):
        reach = np.linalg.matrix_power(adjacent.astype(float) + np.eye(60), 64) > 0
        return [tuple(r) for r in reach]

    linked = np.zeros((60, 60))
    for a, b in edges:
        linked[a // 3, b // 3] = linked[b // 3, a // 3] = 1
    assert parts(linked) == parts(near)


def test_crowded_points_are_linked(spark, make_docs, prose):
    base = prose(3, 400)
    docs = make_docs([(k, base + f" extra{k}") for k in range(80)])
    assert S.simhash_groups(docs).select("group_id").distinct().count() == 1


def test_odd_rows(spark, odd_docs, make_docs):
    got = sorted(((r.doc_id or 0, r.group_id or 0, r.keep) for r in S.simhash_groups(odd_docs).collect()))
    assert got == [(0, 0, True), (0, 6, False), *((k, k, True) for k in (1, 2, 3, 4, 5, 6)), (7, 6, False), (8, 8, True), (9, 9, True)]
    kept = S.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    none = make_docs([])
    assert S.simhash_groups(none).count() == 0 and S.drop_near_duplicates(none).count() == 0


def test_different_texts_of_one_id_are_told_apart(make_docs, prose):
    one, two, three = (prose(k, 150) for k in (1, 2, 3))
    docs = make_docs([(5, one), (5, two), (5, two), (7, one), (8, two), (None, three), (None, three), (None, one)])
    got = S.simhash_groups(docs).toPandas()
    assert len(got) == 6 and got.groupby("group_id").keep.sum().eq(1).all()
    assert got.groupby("group_id").size().tolist() == [3, 2, 1] or sorted(got.groupby("group_id").size()) == [1, 2, 3]
    kept = sorted(((r.doc_id or 0), r.text) for r in S.drop_near_duplicates(docs).collect())
    assert kept == sorted([(5, one), (5, two), (0, three)])


def test_fingerprints_within_the_radius_share_a_variant_and_no_others():
    rng = np.random.default_rng(3)
    for bits in (28, 33, 64):
        masks = S.ball(bits)
        assert len(masks) == bits + 1 and masks[0] == 0
        x = int(rng.integers(0, 2**63)) & ((1 << bits) - 1)
        for d in range(5):
            y = x ^ sum(1 << int(k) for k in rng.permutation(bits)[:d])
            shared = np.intersect1d(np.uint64(x) ^ masks, np.uint64(y) ^ masks)
            assert (len(shared) > 0) == (d <= S.RADIUS)


@pytest.mark.parametrize("bits", [20, 36])
def test_pairs_at_the_greatest_distance_meet(spark, bits):
    rng = np.random.default_rng(6)
    one = rng.integers(0, 256, (400, 32)).astype(np.uint8)
    flips = np.stack([np.packbits(np.isin(np.arange(256), rng.permutation(256)[: S.MAX_DISTANCE])) for _ in range(400)])
    prints = np.concatenate([one, one ^ flips]).view(np.int64)
    table = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(prints)], "id bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    edges = {(r.a, r.b) for r in S.near_duplicate_edges(table, bits=bits).collect()}
    assert edges <= {(k, 400 + k) for k in range(400)} and len(edges) >= 0.85 * 400


@pytest.mark.parametrize("prefix", [0, 3, 9])
def test_variants_by_prefix_are_those_of_the_whole_ball(prefix):
    rng = np.random.default_rng(prefix)
    for bits in (12, 33, 64):
        center = rng.integers(0, 2**63, 5).astype(np.uint64) >> np.uint64(64 - bits)
        expected = sorted((int(p), k) for k, c in enumerate(center) for p in c ^ S.ball(bits))
        values = {p >> (bits - prefix) for p, _ in expected}
        got = [x for v in values for x in zip(*(y.tolist() for y in S.variants(center, bits, prefix, v)))]
        assert sorted(got) == expected


def test_many_groups_give_the_same_edges(spark, prose, monkeypatch):
    texts = [prose(k, 120) for k in range(40)]
    prints = prints_of(texts + [changed(t, 0.03, k) for k, t in enumerate(texts)]).view(np.int64)
    table = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(prints)], "id bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    monkeypatch.setattr(S, "tables", lambda *_: 6)
    once = {(r.a, r.b) for r in S.near_duplicate_edges(table).collect()}
    monkeypatch.setattr(S, "SIGNATURES_A_GROUP", 8)
    monkeypatch.setattr(S, "VARIANTS_AT_ONCE", 40)
    assert {(r.a, r.b) for r in S.near_duplicate_edges(table).collect()} == once and len(once) >= 30
