import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from minpairs.llm import ranked

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    found = [(i, terms_of(t)) for i, t, *_ in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    counts = [(i, len(t), Counter(t)) for i, t in found]
    out = []
    for item, text in items:
        rows = []
        for i, n, c in counts:
            score = 0
            for x in set(terms_of(text)):
                if c[x]:
                    m = 10 + 90 * n * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 8 * m))
            if score:
                rows.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def corpus(n, seed=1):
    r = random.Random(seed)
    vocab = [f"t{int(r.paretovariate(0.6)) % 3000}" for _ in range(4000)]
    return [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 3, 30, 200, 900])))) for i in range(n)]


@pytest.mark.parametrize("bucket, share, block", [(2048, 0.02, 200_000), (7, 0.3, 40), (64, 0.0, 200_000)])
def test_against_brute_force(docs_of, items_of, monkeypatch, bucket, share, block):
    monkeypatch.setattr(ranked, "FIRST_SHARE", share)
    monkeypatch.setattr(ranked.best, "__defaults__", (bucket,))
    rows = corpus(400)
    items = [(q, " ".join(rows[q * 7][1].split()[:40]) or f"t{q} t1") for q in range(30)] + [(90, None), (91, ""), (92, "nothing known"), (93, "T1 t1 T1, t2;t1")]
    assert result(ranked.search(docs_of(rows, extra=True), items_of(items), block_terms=block)) == brute(rows, items)


def test_odd_rows_ties_and_copies(docs_of, items_of, odd_rows):
    rows = odd_rows + [(1000 + i, "copy of one text É x") for i in range(300)] + [(None, "copy of one text É x")] + [(7000, "x" * 2_000_000 + " one" * 300_000)]
    items = [(1, "one É"), (2, "copy text"), (3, "a b c d e f"), (4, "other"), (5, "你好 ﬀ"), (6, "x"), (7, "à É")]
    assert result(ranked.search(docs_of(rows), items_of(items))) == brute(rows, items)


def test_fewer_documents_than_asked_for(docs_of, items_of):
    rows = [(3, "alpha beta"), (3, "alpha beta"), (None, "alpha"), (None, None), (4, "gamma")]
    items = [(1, "alpha"), (2, "gamma delta")]
    assert result(ranked.search(docs_of(rows), items_of(items))) == brute(rows, items)


def test_empty_tables(docs_of, items_of):
    assert ranked.search(docs_of([]), items_of([(1, "a")])).collect() == []
    assert ranked.search(docs_of([(1, "a")]), items_of([])).collect() == []
    assert ranked.search(docs_of([(1, None), (2, "!")]), items_of([(1, "a"), (None, "b")])).collect() == []


def test_no_document_that_reaches_the_limit_is_lost():
    r = np.random.default_rng(2)
    for _ in range(200):
        n, v = int(r.integers(1, 60)), 40
        sets = [np.sort(r.choice(v, int(r.integers(1, 20)), replace=False)) for _ in range(n)]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        term, impact = np.concatenate(sets), r.integers(1, 1_000_000, at[-1])
        norm = np.sqrt(np.add.reduceat(impact.astype(float) ** 2, at[:-1]))
        weights = r.integers(0, 9000, v)
        q = ranked.Queries([r.choice(v, int(r.integers(1, 15)), replace=False)], weights)
        dense = np.zeros((n, v), np.int64)
        dense[np.repeat(np.arange(n), np.diff(at)), term] = impact
        want = dense[:, q.terms[0]] @ weights[q.terms[0]]
        for least in (0, 1, int(np.median(want)), int(want.max()), int(want.max()) + 1):
            ids, scores = ranked.Bucket(np.arange(n), at, term, impact, norm).reaching(q.terms[0], q.weights[0], q.rest[0], least)
            assert dict(zip(ids.tolist(), scores.tolist())) == {i: s for i, s in enumerate(want.tolist()) if s >= max(1, least)}
