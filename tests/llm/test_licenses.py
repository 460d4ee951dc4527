import random

import numpy as np
import pyarrow as pa

from ledgerline.llm import licenses as L
from ledgerline.llm.words import text_buffer, words


def test_statistics_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        templates = [[rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(3)]
        automaton = L.Automaton(templates)
        text = [rng.randrange(5) for _ in range(40)]
        for k, (state, length) in enumerate(automaton.statistics(text)):
            places = {n: sorted((w, p + n - 1) for w, t in enumerate(templates) for p in range(len(t) - n + 1) if t[p : p + n] == text[k + 1 - n : k + 1]) for n in range(1, k + 2)}
            longest = max((n for n, where in places.items() if where), default=0)
            assert length == longest
            if length:
                assert automaton.ends[state] == places[length]


def test_stretches_lose_no_statistics():
    scanner = L.Scanner(L.TEMPLATES)
    rng = random.Random(1)
    for _ in range(40):
        vocabulary = " ".join(L.TEMPLATES.values()).split()
        parts = [" ".join(rng.choice([rng.choice(list(L.TEMPLATES.values())).split()[k : k + rng.randrange(12)], [rng.choice(vocabulary)], ["zzz"]])) for k in (rng.randrange(20) for _ in range(30))]
        raw, offsets = text_buffer(pa.array([" ".join(parts)]))
        found = words(raw, offsets, 0, 1)
        at = np.searchsorted(scanner.vocabulary, found.hashes)
        code = [int(k) if k < len(scanner.vocabulary) and scanner.vocabulary[k] == h else -1 for k, h in zip(at, found.hashes)]
        full = {k: x for k, x in enumerate(scanner.automaton.statistics(code)) if x[1] >= scanner.least}
        some = {}
        for first, own in scanner.stretches(found.hashes, found.doc_bounds):
            some |= {first + k: x for k, x in enumerate(scanner.automaton.statistics(own.tolist())) if x[1] >= scanner.least}
        assert some == full


def test_templates_are_found(spark, make_docs, prose):
    rng = random.Random(2)
    docs, names = [], sorted(L.TEMPLATES)
    for k, name in enumerate(names):
        text = L.TEMPLATES[name].split()
        docs.append((k, prose(k, 30) + "\n" + " ".join(text) + "\n" + prose(k, 30)))
        if len(text) > 40:
            docs.append((100 + k, prose(k, 30) + " " + " ".join(w if rng.random() > 0.03 else "changed" for w in text)))
    docs.append((999, prose(5, 2000)))
    got = {}
    for r in L.scan_licenses(make_docs(docs)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r
    for doc, _ in docs[:-1]:
        assert names[doc % 100] in got[doc]
    for k, name in enumerate(names):
        r = got[k][name]
        assert (r.start_word, r.end_word - r.start_word) == (30, r.n_template) and r.n_covered == r.n_template
    assert 999 not in got


def test_one_text_may_hold_a_licence_twice(spark, make_docs):
    line = "Released under the MIT License."
    rows = L.scan_licenses(make_docs([(1, f"{line} and then some other words and again {line}")])).collect()
    assert sorted((r.license, r.start_word) for r in rows) == [("MIT-notice", 0), ("MIT-notice", 12)]


def test_odd_rows(spark, odd_docs, make_docs):
    assert L.scan_licenses(odd_docs).count() == 0
    assert [tuple(r) for r in L.scan_licenses(odd_docs, templates={"x": "x", "none": ""}).collect()] == [(9, "x", 0, 1, 1, 1)]
    assert L.scan_licenses(odd_docs, templates={}).count() == 0
    assert L.scan_licenses(make_docs([])).count() == 0
    both = make_docs([(None, "Released under the MIT License"), (4, "released under the mit license"), (4, "released under the mit license")])
    assert sorted((r.doc_id or 0) for r in L.scan_licenses(both).collect()) == [0, 4, 4]


def test_matches_against_brute_force_by_template():
    rng = random.Random(9)
    for _ in range(60):
        templates = {f"t{k}": " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(1, 14))) for k in range(3)}
        scanner = L.Scanner(templates, min_match=3)
        text = [rng.randrange(len(scanner.vocabulary)) for _ in range(30)]
        expected = set()
        for which, t in enumerate(scanner.sequences):
            for i in range(len(text)):
                for p in range(len(t)):
                    n = 0
                    while i + n < len(text) and p + n < len(t) and text[i + n] == t[p + n]:
                        n += 1
                    if n >= scanner.needs[which] and not (i and p and text[i - 1] == t[p - 1]):
                        expected.add((which, i, p, n))
        got = list(scanner.matches(text))
        assert set(got) == expected and len(got) == len(expected)


def test_a_notice_is_found_inside_what_a_longer_template_matches(spark, make_docs):
    texts = ["Licensed under the Apache License, Version 2.0. The rest is ours.", 'Licensed under the Apache License, Version 2.0 (the "License").']
    rows = L.scan_licenses(make_docs(list(enumerate(texts)))).collect()
    assert sorted((r.doc_id, r.license, r.start_word, r.n_covered) for r in rows) == [(0, "Apache-2.0-notice", 0, 8), (1, "Apache-2.0-notice", 0, 8)]


def test_many_notices_in_one_text_take_time_in_proportion():
    import time

    scanner = L.Scanner(L.TEMPLATES)
    line = "All rights reserved. No part of this work may be reproduced without permission. Copyright. "
    took = []
    for n in (4000, 16000):
        raw, offsets = text_buffer(pa.array([line * n]))
        found = words(raw, offsets, 0, 1)
        began = time.process_time()
        got = list(scanner.findings(found.hashes, found.doc_bounds))
        took.append(time.process_time() - began)
        assert len(got) >= 0.9 * n
        spans = sorted((s, e) for _, _, s, e, _, _ in got)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert took[1] < 9 * took[0] + 0.5
