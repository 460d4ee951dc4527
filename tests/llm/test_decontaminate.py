import random

import numpy as np
import pyarrow as pa

from ledgerline.llm import decontaminate as D
from ledgerline.llm.words import text_buffer, words

ITEMS = "item_id bigint, text string, doc_id string"


def least_distance(item, text):
    """Edit distance of the whole item to the nearest window of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for w in item:
        new = [row[0] + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (w != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edit(item, edits, rng):
    item = list(item)
    for _ in range(edits):
        k = rng.randrange(len(item))
        rng.choice([lambda: item.__setitem__(k, f"n{rng.randrange(10**6)}"), lambda: item.insert(k, f"n{rng.randrange(10**6)}"), lambda: item.pop(k)])()
    return item


def test_windows_against_brute_force():
    rng = random.Random(3)
    for _ in range(120):
        text = [rng.randrange(6) + 1 for _ in range(rng.randrange(1, 30))]
        item = [rng.randrange(6) + 1 for _ in range(rng.randrange(1, 8))]
        distance, begin, end = D.best_windows(np.array([item], np.uint64), np.array([len(item)]), np.array(text, np.uint64), np.array([0]), np.array([len(text)]))
        assert distance[0] == least_distance(item, text)
        window = text[begin[0] : end[0]]
        assert least_distance(window, item) <= distance[0] and len(window) - len(item) <= distance[0]


def test_recall_and_precision_against_brute_force(spark, make_docs, prose):
    rng = random.Random(8)
    items = [prose(1000 + k, rng.randrange(7, 60)).split() for k in range(40)]
    docs, planted = [], []
    for k in range(300):
        body = prose(k, rng.randrange(5, 120)).split()
        if k % 2:
            which = rng.randrange(len(items))
            allowed = int(D.allowed(len(items[which]), D.MAX_EDITS))
            at = rng.randrange(len(body) + 1)
            body[at:at] = edit(items[which], rng.randrange(allowed + 1), rng)
            planted.append((k, which))
        docs.append((k, ", ".join(body).title()))
    table = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id): r for r in D.find_leaks(make_docs(docs), table).collect()}
    assert sum(p in got for p in planted) >= 0.9 * len(planted)
    for (k, which), r in got.items():
        text = docs[k][1].lower().replace(",", "").split()
        assert r.distance == least_distance(items[which], text) <= D.allowed(len(items[which]), D.MAX_EDITS)
    dropped = {k for k, _ in docs} - {r.doc_id for r in D.drop_leaks(make_docs(docs), table).collect()}
    assert dropped == {k for k, _ in got}


def test_walks_of_equal_windows_are_equal():
    raw, offsets = text_buffer(pa.array(["a b c d e f g h i j k l m n o p"]))
    item = words(raw, offsets, 0, 1).hashes
    index = D.Index([(1, item)])
    noise = np.arange(1, 50, dtype=np.uint64)
    for _, who, where in index.candidates(np.concatenate([noise, item, noise])):
        assert 49 in where.tolist() and set(who.tolist()) == {0}


def test_passes_find_the_same(spark, make_docs, prose, monkeypatch):
    items = spark.createDataFrame([(k, prose(500 + k, 20), "x") for k in range(30)], ITEMS)
    docs = make_docs([(k, prose(k, 30) + " " + prose(500 + k, 20)) for k in range(30)])
    once = sorted(map(tuple, D.find_leaks(docs, items).collect()))
    monkeypatch.setattr(D, "ITEMS_A_PASS", 10)
    assert sorted(map(tuple, D.find_leaks(docs, items).collect())) == once and len(once) >= 30
    assert D.drop_leaks(docs, items).count() == 0


def test_odd_rows(spark, odd_docs, make_docs, prose):
    items = spark.createDataFrame([(1, prose(1, 60), ""), (2, None, ""), (3, "", ""), (4, "?", ""), (None, prose(1, 60), ""), (5, "x", ""), (1, prose(1, 60), "")], ITEMS)
    got = sorted((r.doc_id, r.item_id, r.distance) for r in D.find_leaks(odd_docs, items).collect())
    assert got == [(6, 1, 0), (7, 1, 0), (9, 5, 0)]
    kept = D.drop_leaks(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8]
    none = spark.createDataFrame([], ITEMS)
    assert D.find_leaks(odd_docs, none).count() == 0 and D.drop_leaks(odd_docs, none).count() == odd_docs.count()
    assert D.find_leaks(make_docs([]), items).count() == 0


def seven_words(count):
    """Items of seven words, and of each a copy with its first word replaced, between other words."""
    rng = np.random.default_rng(2)
    items = [(k, rng.integers(1, 2**63, 7).astype(np.uint64)) for k in range(count)]
    noise = lambda: rng.integers(1, 2**63, 6).astype(np.uint64)
    return items, [np.concatenate([noise(), w[1:], noise()]) for _, w in items]


def hits(index, texts):
    return [any(k in who.tolist() for _, who, _ in index.candidates(t)) for k, t in enumerate(texts)]


def test_short_items_without_their_first_word_are_found():
    items, texts = seven_words(60)
    unedited = [(1000 + k, np.arange(100 * k + 1, 100 * k + 6, dtype=np.uint64)) for k in range(540)]
    found = hits(D.Index(items + unedited), texts)
    assert np.mean(found) >= 0.8


def test_lengths_below_target_are_searched_exactly(monkeypatch):
    monkeypatch.setattr(D, "MAX_REPETITIONS", 1)
    items, texts = seven_words(60)
    assert all(hits(D.Index(items), texts))
    rng = random.Random(4)
    items = [(k, np.array([rng.randrange(1, 10**9) for _ in range(rng.randrange(8, 60))], np.uint64)) for k in range(60)]
    edited = [D._edited(w, int(D.allowed(len(w), D.MAX_EDITS)), np.random.default_rng(k)) for k, (_, w) in enumerate(items)]
    index = D.Index(items)
    places = [{(own[x][0]) for own, who, _ in index.candidates(t) for x in who} for t in edited]
    assert all(k in p for k, p in enumerate(places))
