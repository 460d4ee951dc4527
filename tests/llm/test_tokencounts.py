import pytest

from ledgerline.llm import tokencounts as T
from ledgerline.llm.tokenizer import encoding


def brute(text, rule):
    """Section counts token by token, from the bytes of each."""
    data, enc = text.encode(), encoding()
    edges = [0] + [k + 1 for k, b in enumerate(data) if b == 10 and k + 1 < len(data)] + [len(data)]
    counts, crossing, at = [0] * (len(edges) - 1), [0] * (len(edges) - 1), 0
    for token in enc.encode_ordinary(text):
        end = at + len(enc.decode_single_token_bytes(token))
        over = [max(0, min(end, b) - max(at, a)) for a, b in zip(edges[:-1], edges[1:])]
        hit = [k for k, n in enumerate(over) if n]
        k = {"start": hit[0], "end": hit[-1], "majority": over.index(max(over))}[rule]
        counts[k] += 1
        crossing[k] += len(hit) > 1
        at = end
    spans = [len(data[:e].decode()) for e in edges]
    return list(zip(spans[:-1], spans[1:], counts, crossing))


TEXTS = ["one", "a\nb", "a\n\n\n  b\n", "\n", "é\nü€\n\n x", "word \n word\r\n\r\nnext", "x" * 500 + "\n\n\n" + "y z " * 300]


@pytest.mark.parametrize("rule", T.RULES)
def test_against_brute_force(spark, make_docs, prose, rule):
    texts = TEXTS + [prose(k, 200).replace(" w1 ", "\n\n") for k in range(20)]
    got = T.token_counts(make_docs(list(enumerate(texts))), rule=rule).toPandas().sort_values(["doc_id", "section"])
    for k, text in enumerate(texts):
        own = got[got.doc_id == k]
        assert list(own[["char_start", "char_end", "n_tokens", "n_crossing"]].itertuples(index=False, name=None)) == brute(text, rule)
        assert own.section.tolist() == list(range(len(own)))


def test_odd_rows(spark, odd_docs, make_docs):
    got = T.token_counts(odd_docs).toPandas()
    assert (got.doc_id == 6).sum() == 2 and got[got.doc_id == 1].n_tokens.tolist() == [0] and got[got.doc_id == 2].char_end.tolist() == [0]
    assert got.doc_id.isna().sum() == 2
    assert T.token_counts(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        T.token_counts(odd_docs, rule="other")


def test_majority_against_plain_loops():
    import numpy as np

    from ledgerline.llm import tokencounts as T

    rng = np.random.default_rng(4)
    for _ in range(200):
        size = rng.integers(1, 7, rng.integers(1, 30))
        ends = np.cumsum(size)
        bounds = np.unique(np.concatenate([[0], rng.integers(0, ends[-1], rng.integers(0, 25))]))
        got, crossing = T.owners(ends - size, ends, bounds, "majority")
        for t, (a, b) in enumerate(zip(ends - size, ends)):
            held = [sum(bounds[s] <= x and (s + 1 == len(bounds) or x < bounds[s + 1]) for x in range(a, b)) for s in range(len(bounds))]
            assert got[t] == int(np.argmax(held)) and crossing[t] == (sum(h > 0 for h in held) > 1)
