import numpy as np
import pytest

from ledgerline.llm import vectors as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, shard int"


def rows_of(x):
    return [(k, [float(a) for a in row], 0, "v", 1) for k, row in enumerate(x)]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 16))
    x = np.concatenate([c + rng.normal(scale=0.12, size=(n, 16)) for c, n in zip(centres, [3] * 140 + [40] * 9 + [300])])
    return x[rng.permutation(len(x))].astype(np.float32)


def truth_of(x, threshold=V.THRESHOLD):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    return {(int(a), int(b)) for a, b in np.argwhere(np.triu(s >= threshold, 1))}, s


def test_recall_against_brute_force(spark, points):
    truth, s = truth_of(points)
    got = V.near_pairs(spark.createDataFrame(rows_of(points), SCHEMA), shard_size=300).collect()
    pairs = {(r.vec_a, r.vec_b) for r in got}
    assert len(pairs) == len(got) and len(pairs & truth) >= 0.95 * len(truth)
    assert all(s[r.vec_a, r.vec_b] >= V.THRESHOLD - 1e-6 and abs(s[r.vec_a, r.vec_b] - r.cosine) < 1e-5 for r in got)


def test_robust_prune_against_plain_loops(points):
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    candidates = np.array([[k for k in np.argsort(-(u @ u[i]), kind="stable") if k != i][:20] for i in range(10)])
    s = np.einsum("rwd,rd->rw", u[candidates], u[:10])
    got = V.robust_prune(u, candidates, s, 6)
    for i in range(10):
        left, chosen = list(candidates[i]), []
        while left and len(chosen) < 6:
            p = left.pop(0)
            chosen.append(p)
            left = [c for c in left if 1.2 * np.sqrt(max(0, 2 - 2 * u[p] @ u[c])) > np.sqrt(max(0, 2 - 2 * u[i] @ u[c]))]
        assert [k for k in got[i] if k >= 0] == chosen


def test_odd_rows(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [float("inf"), 1.0])]
    good = [(10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [0.0, 1.0]), (13, [1.0, 0.01]), (None, [1.0, 0.0]), (12, [0.0, 1.0]), (14, [1e-30, 1e-32])]
    df = spark.createDataFrame([(i, x, 0, "v", 1) for i, x in bad + good], SCHEMA)
    assert sorted((r.vec_a, r.vec_b) for r in V.near_pairs(df).collect()) == [(10, 11), (10, 13), (10, 14), (11, 13), (11, 14), (13, 14)]
    assert V.near_pairs(df.limit(0)).count() == 0
    assert V.near_pairs(df.where("vec_id = 10")).columns == ["vec_a", "vec_b", "cosine"]


def test_many_equal_vectors(spark):
    df = spark.createDataFrame(rows_of(np.ones((120, 4), np.float32)), SCHEMA)
    assert V.near_pairs(df, shard_size=50).count() == 120 * 119 // 2


def isolated(pairs, crowd, seed, dims=64):
    """Vectors of so many pairs at a cosine of about 0.955 that are near no others, and of a crowd of equal ones."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(pairs, dims)))
    aside = rng.normal(size=(pairs, dims))
    aside = unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    return np.concatenate([x, 0.955 * x + np.sqrt(1 - 0.955**2) * aside, np.tile(unit(rng.normal(size=(1, dims))), (crowd, 1))]).astype(np.float32)


def test_isolated_pairs_are_found_beside_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(V, "OVERLAP", 1)  # loses as many pairs as two shards a vector do in a large table
    x = isolated(1000, 500, 1)
    got = {(r.vec_a, r.vec_b) for r in V.near_pairs(spark.createDataFrame(rows_of(x), SCHEMA), shard_size=100).collect()}
    assert sum((k, 1000 + k) in got for k in range(1000)) >= 0.93 * 1000
    assert sum(a >= 2000 for a, _ in got) >= 0.95 * 500 * 499 // 2


def test_rare_pairs_are_found(spark):
    x = isolated(25, 0, 2)
    x = np.concatenate([x, np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)])
    got = {(r.vec_a, r.vec_b) for r in V.near_pairs(spark.createDataFrame(rows_of(x), SCHEMA), shard_size=300).collect()}
    assert got <= {(k, 25 + k) for k in range(25)} and len(got) >= 23


def test_a_missed_target_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(V, "_recall", lambda *_: 0.9)
    with pytest.raises(RuntimeError, match="below"):
        V.near_pairs(spark.createDataFrame(rows_of(np.eye(6, 4, dtype=np.float32)), SCHEMA))


def test_parts_are_bounded():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    x[:1500] = x[0] + rng.normal(scale=0.01, size=(1500, 8))  # a popular place
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = V.split(x, 100)
    assert np.bincount(np.argmax(x @ c.T, axis=1)).max() <= 400
    assert len(V.split(np.ones((500, 3), np.float32), 100)) == 1


def test_the_registered_query_finds_isolated_pairs(spark, tmp_path):
    from ledgerline.llm import queries

    x = isolated(4000, 300, 4)
    spark.createDataFrame(rows_of(x), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op8_embedding_dedup(spark, str(tmp_path)).collect()}
    assert sum(got[k].class_id == got[4000 + k].class_id == k for k in range(4000)) >= 0.93 * 4000
    assert len(got) == 8300 and all(got[k].class_id == 8000 and got[k].links == 299 for k in range(8000, 8300))
