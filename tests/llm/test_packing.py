import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import packing as P
from ledgerline.llm.tokenizer import encoding


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_every_piece_fits(sizes):
    sizes = np.array(sizes)
    home = P.pack(sizes, 64)
    load = np.bincount(home, weights=sizes)
    assert (home >= 0).all() and load.max() <= 64 and (load > 0).all()


@pytest.mark.parametrize("seed", range(4))
def test_near_the_lower_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(6, 1, 5000).astype(int), 1, 2048)
    assert P.pack(sizes).max() + 1 <= 1.03 * np.ceil(sizes.sum() / 2048) + np.sqrt(len(sizes)) * 0.5


def test_configurations_are_optimal_for_few_sizes():
    patterns, used = P.configurations(np.array([30, 50, 70]), np.array([100, 100, 100]), 100)
    assert ((np.array([30, 50, 70]) @ patterns) <= 100).all()
    assert (patterns @ used >= 100 - 1e-6).all() and abs(used.sum() - 150) < 1e-6  # 70+30 and 50+50


def test_tokens_are_covered_once(spark, make_docs, prose):
    docs = make_docs([(k, prose(k, 20 * k + 1)) for k in range(120)])
    got = P.pack_documents(docs, capacity=256).toPandas()
    for doc, own in got.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own.start.tolist() == [0, *own.n_tokens.cumsum()[:-1]]
        assert own.n_tokens.sum() == len(encoding().encode_ordinary(prose(doc, 20 * doc + 1)))
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.n_tokens.cumsum()[:-1]] and own.n_tokens.sum() <= 256
    assert got.sequence_id.nunique() <= 1.08 * np.ceil(got.n_tokens.sum() / 256) + 2


def test_shards_pack_apart(spark, make_docs, monkeypatch):
    monkeypatch.setattr(P, "SHARD_PIECES", 50)
    got = P.pack_documents(make_docs([(k, "x") for k in range(400)]), capacity=100, length=F.lit(7)).toPandas()
    assert len(got) == 400 and got.groupby("sequence_id").n_tokens.sum().max() <= 98


def test_odd_rows(spark, odd_docs, make_docs):
    got = P.pack_documents(odd_docs).toPandas()
    empty = got[got.n_tokens == 0]
    assert sorted(empty.doc_id.fillna(0)) == [0, 1, 2] and empty.sequence_id.isna().all() and empty.offset.isna().all()
    assert (got.doc_id == 6).sum() == 2 and (got.doc_id == 5).sum() > 10
    assert got.groupby("sequence_id").n_tokens.sum().max() <= P.CAPACITY
    assert P.pack_documents(make_docs([])).count() == 0
    assert P.pack_documents(odd_docs, length=F.lit(None).cast("bigint")).where("sequence_id IS NOT NULL").count() == 0


def fewest(sizes, capacity):
    """The least number of sequences, by trying every way to put the pieces in, longest first."""
    order, best = sorted(sizes, reverse=True), len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(order):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= order[k]:
                i = rooms.index(room)
                place(k + 1, rooms[:i] + [room - order[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - order[k]])

    place(0, [])
    return best


def first_fit_decreasing(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, r in enumerate(rooms) if r >= s), None)
        if k is None:
            rooms.append(capacity - s)
        else:
            rooms[k] -= s
    return len(rooms)


def test_small_cases_against_every_packing():
    rng = np.random.default_rng(12)
    for _ in range(60):
        sizes = rng.integers(1, 33, rng.integers(1, 10))
        assert P.pack(sizes, 32).max() + 1 <= fewest(sizes.tolist(), 32) + 1


@pytest.mark.parametrize("seed", range(6))
def test_large_cases_against_a_plain_packer(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(40, 700, 3000) if seed % 2 else np.clip(rng.lognormal(5.5, 1, 3000).astype(int), 1, 1000)
    assert P.pack(sizes, 1000).max() + 1 <= 1.05 * first_fit_decreasing(sizes.tolist(), 1000) + P.GROUPS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(5, 64), min_size=1, max_size=12, unique=True), st.data())
def test_configurations_end_and_meet_the_demand(sizes, data):
    demand = np.array([data.draw(st.integers(1, 500)) for _ in sizes])
    patterns, used = P.configurations(np.array(sizes), demand, 64)
    assert (np.array(sizes) @ patterns <= 64).all() and (patterns @ used >= demand - 1e-6 * demand.max()).all()
    assert used.sum() >= np.array(sizes) @ demand / 64 - 1e-6


def test_rows_without_an_id_are_spread(spark, make_docs, monkeypatch):
    monkeypatch.setattr(P, "SHARD_PIECES", 50)
    got = P.pack_documents(make_docs([(None, "x") for _ in range(400)]), capacity=100, length=F.lit(7)).toPandas()
    assert len(got) == 400 and (got.sequence_id // 2**32).nunique() >= 6
