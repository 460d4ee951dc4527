import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import quality as Q

LABELS = "doc_id bigint, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)

    def text(low, toxic):
        words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(60, 200))]
        if toxic:
            words = [rng.choice(["vile", "foul", "nasty"]) if rng.random() < 0.06 else w for w in words]
        return " ".join(w.upper() + "!!" for w in words) if low else " ".join(words)

    rows = [(k, k % 7 == 0, k % 5 == 1) for k in range(1500)]
    return [(k, text(low, toxic), low, toxic) for k, low, toxic in rows]


def test_held_out_accuracy(spark, make_docs, corpus):
    docs = make_docs([(k, t) for k, t, *_ in corpus])
    labels = spark.createDataFrame([(k, int(not low), int(tox), "x") for k, _, low, tox in corpus[:1000]] + [(None, 1, 0, "x"), (3, None, None, "x"), (99999, 0, 0, "x")], LABELS)
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == len(corpus)
    held = corpus[1000:]
    clean = [got[k].keep for k, _, low, tox in held if not low and not tox]
    assert np.mean(clean) >= 0.95
    assert np.mean([got[k].keep for k, _, low, _ in held if low]) <= 0.05
    assert np.mean([got[k].keep for k, _, low, tox in held if tox and not low]) <= 0.25
    again = {r.doc_id: r.p_toxic for r in Q.classify(docs.repartition(3), labels).collect()}
    assert all(abs(again[k] - got[k].p_toxic) < 1e-3 for k in got)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in got if got[k].keep}


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    truth = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-truth))).astype(float)
    assert 2.5 < Q.temperature(truth * 3, y) < 3.5
    assert Q.temperature(np.zeros(0), np.zeros(0)) == 1.0


def test_projected_pooling_equals_pooled_projection(prose):
    rng = np.random.default_rng(1)
    table, weight = rng.normal(size=(Q.BUCKETS, 8)).astype(np.float32), rng.random(Q.BUCKETS).astype(np.float32)
    w = rng.normal(size=(8, 3)).astype(np.float32)
    column = pa.array([prose(1, 50), None, "", "a a a b", prose(2, 9000)])
    full, n = Q.pool(column, table, weight)
    part, _ = Q.pool(column, (table @ w).astype(np.float32), weight)
    assert np.allclose(full @ w, part, atol=1e-4) and n.tolist()[1:3] == [0, 0]


def test_repeats_are_marked():
    raw, offsets = Q.text_buffer(pa.array(["a a b", "b b"]))
    hashes, bounds = Q.tokens(raw, offsets, 0, 2)
    assert (hashes == Q.REPEATED).tolist() == [False, True, False, False, True] and bounds.tolist() == [0, 3, 5]


def test_odd_rows(spark, odd_docs, make_docs):
    labels = spark.createDataFrame([(5, 1, 0, ""), (6, 1, 1, ""), (7, 0, 0, ""), (1, 1, 0, ""), (2, 0, 1, "")], LABELS)
    got = Q.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    assert all((r.p_quality is None) == (r.doc_id in (1, 2, 3)) or r.doc_id is None for r in got)
    assert not any(r.keep for r in got if r.doc_id in (1, 2, 3))
    none = spark.createDataFrame([], LABELS)
    assert {r.keep for r in Q.classify(odd_docs, none).collect() if r.doc_id in (4, 5, 6, 7, 8, 9)} == {True}
    assert Q.classify(make_docs([]), labels).count() == 0
    assert Q.keep_good(make_docs([]), none).count() == 0


def test_word_table_starts_without_what_the_worker_had_freed(spark):
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous: +(\d+)", f.read())[1]) / 1024

    def run(batches):
        for _ in batches:
            pass
        freed = [bytes(3000) for _ in range(60_000)]
        still_used = freed[::1000]
        del freed
        before = held()
        slab = next(Q._tables(iter(())))
        yield pa.RecordBatch.from_arrays([pa.array([before - held()]), pa.array([len(still_used) + slab.num_rows])], ["mb", "n"])

    fell = spark.range(1, numPartitions=1).mapInArrow(run, "mb double, n bigint").collect()[0].mb
    assert fell > 100
