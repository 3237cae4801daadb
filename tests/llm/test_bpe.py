import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from minpairs.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def plain(ranks):
    enc = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(enc.encode_ordinary(text), dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(ranks, PATTERN)


def naive(ranks, data):
    """Least rank first, leftmost first."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while True:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            return tuple(ranks[p] for p in parts)
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


ODD = ["", " ", "  ", "a ", " a", "a  b", "a\n\n b\t c\r\nd", "don't I'll 'tis 's 're're", "1234 567a8", "é Été 你好世界 🙂🙂 ﬀ", "\0a\0 b", "\x1c a\x85b\u2028c\u00a0d\u3000e",
       "<|endoftext|> a<|endoftext|>", "a\u200bb", "...!? -- ''", "x" * 100, " " * 50 + "y", "ab" * 999]


def test_texts_equal_the_library(codec, plain):
    r = random.Random(4)
    letters = ["a", "b", " ", "\n", "é", "好", "🙂", "1", "'s", "'", "\t", "\x85", "\u2009", "\0", ".", "the", "ing", "  "]
    for text in ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(3000)]:
        ids = codec.encode(text)
        assert ids == plain(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_joins_equal_merging_the_whole(codec, ranks):
    r = random.Random(5)
    for _ in range(1500):
        data = bytes(r.choice(b"abtheinrs \xc3\xa9") for _ in range(r.randint(2, 60)))
        cut = r.randint(0, len(data))
        assert codec.join(naive(ranks, data[:cut]), naive(ranks, data[cut:])) == codec.reduce(data) == codec.merge(data) == naive(ranks, data)


def test_other_ranks(codec):
    """Rank tables whose tokens cannot be merged from their parts, or only in another order."""
    r = random.Random(6)
    for _ in range(60):
        tokens = {bytes([c]) for c in b"abc"} | {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(r.randint(3, 25))}
        ranks = dict(zip([bytes([c]) for c in b"abc"] + r.sample(sorted(t for t in tokens if len(t) > 1), sum(len(t) > 1 for t in tokens)), range(100)))
        own = bpe.Codec(ranks, PATTERN)
        for _ in range(40):
            data = bytes(r.choice(b"abc") for _ in range(r.randint(1, 120)))
            assert own.reduce(data) == own._merge_long(data) == naive(ranks, data)


@pytest.mark.parametrize("text", ["a" * 70_001, "abc" * 30_000, "-" * 65_537, " " * 70_001 + "x", "é" * 5001, "the" * 30_000, "x" * 65_536 + " y", "word, " * 300_000])
def test_long_texts(codec, plain, text):
    ids = codec.encode(text)
    assert ids == plain(text) and codec.decode(ids) == text.encode()


def test_caches_start_afresh(ranks, plain, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(bpe, "CACHE_JOINS", 5)
    codec = bpe.Codec(ranks, PATTERN)
    text = " ".join(f"word{k % 40}ing" for k in range(500))
    assert codec.encode(text) == plain(text)


def test_tables(docs_of, odd_rows, plain):
    rows = odd_rows + [(50 + i, t) for i, t in enumerate(ODD)] + [(99, "several megabytes of text. " * 150_000)]
    encoded = bpe.encode(docs_of(rows, extra=True), PATH, PATTERN)
    got = bpe.decode(encoded, PATH, PATTERN).collect()
    want = sorted((str(i), plain(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)


def test_empty_table_and_null_ids(spark, docs_of):
    assert bpe.decode(bpe.encode(docs_of([]), PATH, PATTERN), PATH, PATTERN).collect() == []
    rows = spark.createDataFrame([(1, None), (2, b"\x00\x00\x00\x00")], "doc_id long, ids binary")
    assert [r["decoded"] is None for r in bpe.decode(rows, PATH, PATTERN).orderBy("doc_id").collect()] == [True, False]
