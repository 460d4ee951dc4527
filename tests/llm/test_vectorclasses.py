import duckdb
import numpy as np
import pytest

from ledgerline.llm import vectorclasses as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, w int"


def rows_of(x):
    return [(k, [float(a) for a in row], 0, "v", 1) for k, row in enumerate(x)]


def noisy(x, cosine, seed):
    return V._noisy((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), cosine, seed)


@pytest.fixture(scope="module")
def points():
    """Pairs at a cosine of 0.955, a crowd of near copies, chains, exact copies and strangers."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    crowd = noisy(np.tile(x[:1], (500, 1)), 0.985, 6)
    chain = [x[1:21]]
    for k in range(4):
        chain.append(noisy(chain[-1], 0.953, 7 + k))
    every = np.concatenate([x, noisy(x[100:400], 0.955, 20), crowd, *chain[1:], np.tile(x[30:31], (60, 1)), x[400:420] * 3])
    return every[rng.permutation(len(every))]


def truth_of(x, threshold=V.THRESHOLD):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = u @ u.T >= threshold
    root = np.arange(len(x))
    return linked.sum(axis=1) - 1, V.connect(root, *np.nonzero(linked))


def got_of(df):
    rows = sorted(df.collect())
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    return np.array([r.links for r in rows]), np.array([r.class_id for r in rows])


def test_all_links_and_classes(spark, points, monkeypatch):
    links, classes = truth_of(points)
    monkeypatch.setattr(V, "chunk_size", lambda _: 100)  # every pair of chunks is a group of its own
    got = got_of(V.near_classes(spark.createDataFrame(rows_of(points), SCHEMA), bits=0))
    assert (got[0] == links).all() and (got[1] == classes).all()


@pytest.mark.parametrize("chunk", [100, 100_000])
def test_links_through_cells(spark, points, monkeypatch, chunk):
    links, classes = truth_of(points)
    monkeypatch.setattr(V, "chunk_size", lambda _: chunk)
    got = got_of(V.near_classes(spark.createDataFrame(rows_of(points), SCHEMA), bits=5))
    assert (got[0] <= links).all() and got[0].sum() >= 0.98 * links.sum()
    some = links > 0
    assert (got[0][some] / links[some]).mean() >= 0.98
    assert all(classes[k] == classes[c] for k, c in enumerate(got[1]))  # nothing is joined that links don't join


def test_rows_grow_with_the_vectors(spark):
    x = noisy(np.ones((3000, 16)), 0.985, 3)
    x = np.concatenate([x, x[:200]])
    df = V.near_classes(spark.createDataFrame(rows_of(x), SCHEMA))
    got = got_of(df)
    assert len(got[0]) == 3200 and (got[0] == truth_of(x)[0]).all() and (got[1] == 0).all()


def test_a_group_holds_no_pairs():
    import pyarrow as pa

    n = 3000
    group = pa.table({"vec_id": pa.array(np.arange(n)), "w": pa.array(np.ones(n, np.int64)), "v": V._packed(noisy(np.ones((n, 8)), 0.985, 4)), "codes": V._packed(np.zeros((n, 1), np.uint16)), "chunk": pa.array(np.zeros(n, np.int32))})
    out = V._compare(8, 1, 0.95)(tuple(pa.scalar(z) for z in (0, 0, 0, 0)), group)
    assert out.num_rows == n and set(out["root"].to_pylist()) == {0}


def test_odd_rows_and_sql(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [inf, 1.0]), (8, [1.0])]
    good = [(10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [0.0, 1.0]), (13, [1.0, 0.01]), (None, [1.0, 0.0]), (12, [0.0, 1.0]), (14, [1e-30, 1e-32]), (15, [0.0, 1.0, 0.0]), (10, [0.0, 1.0, 0.0]), (16, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, x, 0, "v", 1) for i, x in odd + good], SCHEMA)
    got = sorted(tuple(r) for r in V.near_classes(df).collect())
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 7, 0), (8, 6, 1), (10, 10, 4), (11, 10, 3), (12, 12, 0), (13, 10, 3), (14, 10, 3), (15, 10, 1), (16, 16, 0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", odd + good)
    assert sorted(con.execute(V.ORACLE).fetchall()) == got
    assert V.near_classes(df.limit(0)).collect() == []
    assert [tuple(r) for r in V.near_classes(df.where("vec_id = 11")).collect()] == [(11, 11, 0)]


def test_bits_grow_with_the_table():
    x = np.random.default_rng(8).normal(size=(4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert V.fit(x, 10_000, 0.95)[2:] == (0, 1)
    bits = [V.fit(x, n, 0.95)[2] for n in (100_000, 1_000_000, 10_000_000)]
    assert bits == sorted(bits) and bits[-1] > bits[0]


def test_a_missed_target_halves_the_bits(spark, points, monkeypatch):
    links, _ = truth_of(points)
    monkeypatch.setattr(V, "MEET", 0.3)
    got = got_of(V.near_classes(spark.createDataFrame(rows_of(points), SCHEMA), bits=6, target=1.0))
    assert (got[0] == links).all()
