"""The registered queries over the driver's smallest tables, against brute force or SQL."""

import os

import duckdb
import numpy as np
import pytest

from ledgerline.llm import decontaminate as D
from ledgerline.llm import licenses, queries, simhash, vectors
from ledgerline.llm.tokenizer import encoding
from ledgerline.llm.words import text_buffer, words

DIR = os.environ.get("LEDGERLINE_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def run(spark, name):
    return queries.queries()[name](spark, DIR).toPandas()


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet' ORDER BY doc_id").to_arrow_table()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, expected = run(spark, name), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(repr, got[columns].astype(str).to_numpy().tolist())) == sorted(map(repr, expected[columns].astype(str).to_numpy().tolist()))


def test_packing_and_token_counts_cover_every_document(spark, docs):
    expected = {i: len(encoding().encode_ordinary(t)) for i, t in zip(*(c.to_pylist() for c in docs.columns))}
    packed, counted = run(spark, "op1_best_fit_packing"), run(spark, "op2_token_counts")
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == expected == counted.groupby("doc_id").n_tokens.sum().to_dict()
    load = packed.groupby("sequence_id").n_tokens.sum()
    assert load.max() <= 2048 and len(load) <= 1.05 * sum(expected.values()) / 2048 + 3


def test_leaks_against_all_windows(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{DIR}/benchmark.parquet' ORDER BY 1").to_arrow_table()
    (raw, offsets), (iraw, ioff) = text_buffer(docs["text"]), text_buffer(items["text"])
    own, asked = words(raw, offsets, 0, docs.num_rows), words(iraw, ioff, 0, items.num_rows)
    full = np.flatnonzero(np.diff(own.doc_bounds))
    expected = {}
    for k, item_id in enumerate(items["item_id"].to_pylist()):
        w = asked.hashes[asked.doc_bounds[k] : asked.doc_bounds[k + 1]]
        for part in np.array_split(full, 40):
            d, *_ = D.best_windows(np.repeat(w[None], len(part), axis=0), np.full(len(part), len(w)), own.hashes, own.doc_bounds[part], own.doc_bounds[part + 1])
            expected |= {(docs["doc_id"][int(x)].as_py(), item_id): int(n) for x, n in zip(part, d) if n <= D.allowed(len(w), D.MAX_EDITS)}
    got = {(r.doc_id, r.item_id): r.distance for r in run(spark, "op4_decontamination").itertuples()}
    assert set(got) <= set(expected) and len(got) >= 0.95 * len(expected) and all(expected[k] == d for k, d in got.items())


def test_near_duplicates_against_all_pairs(spark, docs):
    rows, prints = simhash.block_signatures(*text_buffer(docs["text"]), 0, docs.num_rows)
    near = np.triu(np.bitwise_count(prints.view(np.uint64)[:, None] ^ prints.view(np.uint64)[None]).sum(axis=2) <= simhash.MAX_DISTANCE, 1)
    ids = np.array(docs["doc_id"].to_pylist())[rows]
    got = run(spark, "op7_simhash").set_index("doc_id").group_id
    a, b = np.nonzero(near)
    assert (got[ids[a]].to_numpy() == got[ids[b]].to_numpy()).mean() >= 0.95
    whole = np.arange(len(ids))  # what all near pairs connect; nothing else may be grouped
    for _ in range(len(ids)):
        before = whole.copy()
        np.minimum.at(whole, a, whole[b])
        np.minimum.at(whole, b, whole[a])
        if (before == whole).all():
            break
    place = dict(zip(ids.tolist(), whole.tolist()))
    assert all(place[d] == place[g] for d, g in got.items() if d in place and g in place)


def test_embeddings_against_all_pairs(spark):
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet'").to_arrow_table()
    ids, x = np.array(table["vec_id"].to_pylist()), np.array(table["embedding"].to_pylist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = dict(zip(ids.tolist(), ((x @ x.T >= vectors.THRESHOLD).sum(axis=1) - 1).tolist()))
    got = run(spark, "op8_embedding_dedup").set_index("vec_id")
    assert got.links.to_dict() == expected and all(got.class_id[got.links == 0] == got.index[got.links == 0])


def test_licences_against_streaming_every_word(spark, docs, monkeypatch):
    got = sorted(tuple(r) for r in run(spark, "op5_license_scan").itertuples(index=False))

    def whole(self, hashes, bounds):
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[at] == hashes, at, -1)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a < b:
                yield int(a), code[a:b]

    monkeypatch.setattr(licenses.Scanner, "stretches", whole)
    raw, offsets = text_buffer(docs["text"])
    found = words(raw, offsets, 0, docs.num_rows)
    expected = sorted((docs["doc_id"][r[0]].as_py(), *r[1:]) for r in licenses.Scanner(licenses.TEMPLATES).findings(found.hashes, found.doc_bounds))
    assert got == expected


def test_classifier_keeps_what_is_good(spark):
    labels = duckdb.sql(f"SELECT * FROM '{DIR}/labels.parquet'").df().set_index("doc_id")
    got = run(spark, "op3_quality_classifier").set_index("doc_id").join(labels, how="inner")
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.keep.mean() >= 0.95 and got[got.quality == 0].keep.mean() <= 0.2
