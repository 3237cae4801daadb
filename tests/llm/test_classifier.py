import zlib

import numpy as np
import pytest

from minpairs.llm import classifier as C

from .test_rules import good, junk


@pytest.fixture(scope="module")
def model():
    return C.fit([(float(k % 3 != 0), C.sample_chunks(good(k) if k % 3 else junk(k))) for k in range(240)])


def plain_score(m, data):
    """The network position by position and chunk by chunk."""
    n = max(1, -(-len(data) // C.STRIDE))
    padded = np.concatenate([data, np.zeros(C.WIDTH + 2, np.uint8)])
    r = np.array([sum(m.table[j, padded[C.STRIDE * p + j]] for j in range(C.WIDTH)) for p in range(n)])
    pooled = np.array([np.maximum(r[a:a + C.CHUNK].max(axis=0) + m.bias, 0) for a in range(0, n, C.STEP)])
    z = np.concatenate([pooled.mean(axis=0), pooled.min(axis=0)]) @ m.out + m.shift
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("size", [0, 1, 7, 8, 60, 447, 448, 449, 512, 900, 5001])
def test_score_covers_every_byte(model, size, monkeypatch):
    data = np.random.default_rng(size).integers(32, 127, size).astype(np.uint8)
    assert model.score(data) == pytest.approx(plain_score(model, data), abs=1e-5)
    monkeypatch.setattr(C, "BLOCK", 3 * C.STEP)  # block borders do not show
    assert model.score(data) == pytest.approx(plain_score(model, data), abs=1e-5)


def test_held_out_accuracy(docs_of, labels_of):
    rows = [(k, good(k) if k % 3 else junk(k)) for k in range(400)]
    labels = labels_of([(k, int(k % 3 != 0)) for k in range(400)])
    df = docs_of(rows, extra=True)
    got = C.classify(df, C.train_on(df, labels)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_held_out_labels_do_not_matter(docs_of, labels_of):
    rows = [(k, good(k) if k % 3 else junk(k)) for k in range(60)]
    flip = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    scores = [sorted((r["doc_id"], r["score"]) for r in C.classify(docs_of(rows), C.train_on(docs_of(rows), labels_of(
        [(k, int((k % 3 != 0) != (change and flip(k)))) for k in range(60)]))).collect()) for change in (False, True)]
    assert scores[0] == scores[1]


def test_odd_rows_and_one_class(docs_of, labels_of, odd_rows):
    df = docs_of(odd_rows, extra=True)
    got = C.classify(df, C.train_on(df, labels_of([(1, 1), (7, 1), (None, 0), (8, None)]))).collect()
    assert len(got) == len(odd_rows) and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert C.classify(docs_of([]), C.train_on(docs_of([]), labels_of([]))).collect() == []
    assert C.keep_good(df, C.fit([]), cut=0.3).columns == df.columns


def test_keep_good_agrees_with_classify(docs_of, model, odd_rows):
    df = docs_of(odd_rows + [(500 + k, junk(k)) for k in range(20)], extra=True)
    kept = C.keep_good(df, model)
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if model.score(np.frombuffer((r["text"] or "").encode(), np.uint8)) >= 0.3)


def test_sample_counts_rows_and_equal_rows_once(spark, docs_of, labels_of, monkeypatch):
    """Two labelled ids on thousands of rows: the driver gets a bounded number of them, a repeated row once."""
    rows = [(1, "good text")] * 3000 + [(2, f"bad ### text {k}") for k in range(3000)] + [(3, "fine words here")]
    got = []
    monkeypatch.setattr(C, "fit", lambda sample, **_: got.extend(sample))
    labels = labels_of([(1, 1), (2, 0), (3, 1)])
    C.train_on(docs_of(rows), labels, sample_rows=50)
    assert len(got) <= 50
    got.clear()
    C.train_on(docs_of(rows), labels, sample_rows=10_000)
    held = {k for k in (1, 2, 3) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert len(got) == sum(n for k, n in ((1, 1), (2, 3000), (3, 1)) if k not in held)
