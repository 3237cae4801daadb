import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from minpairs.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_tokenizer(tok):
    enc = packing.ChunkEncoder(PATH)
    odd = ["", " a", "a ", "a\n", "\n", " ", "a b\n c", "don't  stop\n\n now 's we'll\t x", "\0 a", "é Été, ñ. 123abc a_b x.y, ab.. “q” 你好 世界 z <|endoftext|> \x1c a",
           "º ª aº ßẞ ǅ a² ²", "a　b c  d", "..", ".", " .,x", "it's It'S", "🙂 a🙂"]
    r = random.Random(1)
    odd += ["".join(r.choice("ab .,\n'é9²\t_-Z") for _ in range(60)) for _ in range(300)]
    odd += ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> <|endoftext|>y\n", "<|endoftext", "a <|endof text|> b", "z " * 5000 + "<|endoftext|>" + " z" * 5000]
    assert len(ids_of(tok, "a<|endoftext|>b")) == 4
    for t in odd:
        assert enc(t) == np.array(ids_of(tok, t)[:-1], dtype="<u4").tobytes(), repr(t)


def check_layout(rows, max_tokens):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in at.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= max_tokens
    return sum(n for p in at.values() for _, n in p) / (max_tokens * max(1, len(at)))


def test_pack_documents(docs_of, odd_rows, tok):
    rows = odd_rows + [(100 + i, "word " * (i * 7 % 90)) for i in range(200)]
    got = packing.pack(docs_of(rows, extra=True), PATH, max_tokens=64, with_ids=True).collect()
    want = sorted((str(i), tuple(ids_of(tok, t))) for i, t, *_ in rows)
    docs = defaultdict(dict)
    for r in got:
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        docs[r["doc_id"], r["doc_tokens"]].setdefault(r["start"], []).append(tuple(ids.tolist()))
    rebuilt = []
    for (i, n), parts in docs.items():
        for k in range(max(map(len, parts.values()))):
            whole = sum((parts[s][k] for s in sorted(parts)), ())
            if len(set(map(len, parts.values()))) == 1:
                assert len(whole) == n
                rebuilt.append((str(i), whole))
    assert sum(map(len, (w for _, w in want))) == sum(r["length"] for r in got)
    assert {w for w in rebuilt} <= set(want)
    assert check_layout(got, 64) > 0.9


def test_hot_length_is_ranked_in_parts(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    got = packing.pack(docs_of([(i, "same text" if i % 3 else None) for i in range(300)]), PATH, max_tokens=16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) == 300
    assert check_layout(got, 16) > 0.9


def test_empty_table(docs_of):
    assert packing.pack(docs_of([]), PATH).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_histogram_places_every_rank_once(seed):
    r = random.Random(seed)
    size = r.choice([8, 64, 2048])
    counts = {r.randint(1, size): r.choice([1, 2, 5, 1000, 100_003]) for _ in range(r.randint(0, 40))}
    ranges = packing.pack_histogram(counts, size)
    ends = defaultdict(int)
    for n, first, end, copies, _, _ in sorted(ranges):
        assert first == ends[n] and (end - first) % copies == 0
        ends[n] = end
    assert dict(ends) == counts
    fill = defaultdict(int)
    for n, _, _, copies, seq, offset in ranges:
        assert offset == fill[seq]
        fill[seq] += n * copies
    assert all(v <= size for v in fill.values())
