import re

import numpy as np
import pytest

from minpairs.llm import minhash

from .conftest import words


def sets_of(rows):
    out = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def brute(rows, percent=85):
    docs = sets_of(rows)
    near = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is not None and docs[b][0] is not None and near(docs[a][1], docs[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted([(i, len(s), least[find(k)] if i is not None else None, i is None or least[find(k)] == i) for k, (i, s) in enumerate(docs)], key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)


def test_odd_rows(docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] != 6] + [(6, "a b c d e f")]
    assert result(minhash.near_duplicates(docs_of(rows, extra=True))) == brute(rows)


def test_an_id_with_several_texts(docs_of, odd_rows, monkeypatch):
    a, b = " ".join(words(60, 1)), " ".join(words(80, 2))
    rows = [*odd_rows, (50, a), (50, b), (51, a + " end"), (52, b + " end"), (53, a + " more"), (54, b + " more")]
    got = {}
    for r in minhash.near_duplicates(docs_of(rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got[50] == got[51] == got[52] == got[53] == got[54] == {50} and len(got) == len({r[0] for r in rows})


def cloud(n, base, changes, seed):
    import random

    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_clouds_chains_and_small_sets(docs_of):
    texts = cloud(60, words(120, 1), 6, 1) + cloud(40, words(400, 2), 14, 2) + cloud(30, words(30, 3), 2, 3)
    long = words(600, 4)
    texts += [" ".join(long[k * 8:k * 8 + 300]) for k in range(30)]  # a chain: only neighbours are linked
    texts += [" ".join(words(11, 5)[:n]) for n in range(1, 12)] + [" ".join(words(200, s)) for s in range(40)]
    texts += texts[:25]
    rows = [(7 * k % 1009, t) for k, t in enumerate(texts)]
    assert result(minhash.near_duplicates(docs_of(rows))) == brute(rows)


def test_blocks_of_a_hot_bucket(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = list(enumerate(cloud(150, words(80, 9), 7, 9)))
    assert result(minhash.near_duplicates(docs_of(rows))) == brute(rows)


def test_empty(docs_of):
    assert minhash.near_duplicates(docs_of([])).collect() == []


def test_registers_estimate_similarity():
    r = np.random.default_rng(0)
    for n, share in ((20, 0.9), (300, 0.85), (5000, 0.5)):
        errors = []
        for _ in range(30):
            both = r.integers(0, 2**63, n, dtype=np.uint64)
            cut = int(n * share)
            a = np.concatenate([both[:cut], r.integers(0, 2**63, (n - cut) // 2 + 1, dtype=np.uint64)])
            b = np.concatenate([both[:cut], r.integers(0, 2**63, (n - cut) // 2 + 1, dtype=np.uint64)])
            true = cut / (2 * len(a) - cut)
            equal = np.array([(minhash.sketch(a) == minhash.sketch(b)).sum()])
            errors.append(minhash.estimate(equal, np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < minhash.MARGIN


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (500, 500)]
    got = {r["a"]: r["b"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 200: 100, 300: 100}


@pytest.mark.parametrize("text", ["x", "a b c d", "a b c d e"])
def test_single_shingle(text):
    assert len(minhash.shingles(text)) == 1
