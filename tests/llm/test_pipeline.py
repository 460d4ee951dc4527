import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ledgerline.llm import decontaminate as D
from ledgerline.llm import packing, quality, simhash
from ledgerline.llm.words import text_buffer, words


@pytest.fixture(scope="module")
def folder(spark, make_docs, prose, tmp_path_factory):
    rng = random.Random(6)
    items = [prose(9000 + k, rng.randrange(14, 50)) for k in range(8)]
    rows, k = [], 0
    for _ in range(260):
        kind = rng.choice(["clean", "clean", "clean", "low", "toxic", "copy", "near", "leak"])
        text = prose(k, rng.randrange(60, 160))
        if kind == "low":
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == "toxic":
            text = " ".join(rng.choice(["vile", "foul", "nasty"]) if rng.random() < 0.1 else w for w in text.split())
        if kind == "copy" and rows:
            text = rng.choice(rows)[1]
        if kind == "near" and rows:
            text = " ".join(f"n{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in rng.choice(rows)[1].split())
        if kind == "leak":
            text += " " + rng.choice(items)
        rows.append((k, text, kind))
        k += 1
    path = tmp_path_factory.mktemp("corpus")
    make_docs([(k, t) for k, t, _ in rows] + [(500, None), (501, ""), (None, prose(77, 80))]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(kind != "low"), int(kind == "toxic")) for k, _, kind in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def brute_force(spark, folder):
    """What stays before packing, with pairs and windows found by comparing all of them."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).where("keep").collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good and r.text), key=lambda r: (r[0] is not None, r[0] or 0))
    raw, offsets = text_buffer(pa.array([t for _, t in rows]))
    found, prints = simhash.block_signatures(raw, offsets, 0, len(rows))
    assert len(found) == len(rows)
    near = np.bitwise_count(prints.view(np.uint64)[:, None] ^ prints.view(np.uint64)[None]).sum(axis=2) <= simhash.MAX_DISTANCE
    ids = [i for i, _ in rows]
    kept, seen = [], set()
    for k, i in enumerate(ids):
        if i is None:
            kept.append(k)
            continue
        if k in seen:
            continue
        kept.append(k)
        stack = [k]
        while stack:
            x = stack.pop()
            for y in np.flatnonzero(near[x]).tolist():
                if y not in seen and ids[y] is not None:
                    seen.add(y)
                    stack.append(y)
    own = words(raw, offsets, 0, len(rows))
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    iraw, ioff = text_buffer(pa.array(items))
    ihash = words(iraw, ioff, 0, len(items))
    clean = []
    for k in kept:
        low, high = own.doc_bounds[k], own.doc_bounds[k + 1]
        least = []
        for a, b in zip(ihash.doc_bounds[:-1], ihash.doc_bounds[1:]):
            n = b - a
            d, *_ = D.best_windows(ihash.hashes[None, a:b], np.array([n]), own.hashes, np.array([low]), np.array([high]))
            least.append(d[0] <= D.allowed(n, D.MAX_EDITS))
        if not any(least):
            clean.append(ids[k])
    return {i: t for i, t in rows if i in clean}


def test_against_brute_force(spark, folder):
    expected = brute_force(spark, folder)
    got = corpus_pipeline.run(spark, folder).toPandas()
    ids = {None if i != i else int(i) for i in got.doc_id}
    assert len(ids ^ set(expected)) <= 1 and len(expected) > 60
    from ledgerline.llm.tokenizer import encoding

    sizes = got.groupby("doc_id").n_tokens.sum()
    assert all(sizes[i] == len(encoding().encode_ordinary(t)) for i, t in expected.items() if i in sizes.index)
    assert got.groupby("sequence_id").n_tokens.sum().max() <= packing.CAPACITY


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_dedup", "decontamination", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, none, folder).count() == 0
