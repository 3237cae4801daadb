import random

import public_tokenizers
import pytest

from minpairs.llm import wordpiece


def greedy(word, starts, inner):
    n, at, pieces = 0, 0, starts
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                break
        else:
            return 0
        n, at, pieces = n + 1, end, inner
    return n


@pytest.mark.parametrize("seed", range(15))
def test_automaton_is_greedy_longest_match(seed):
    r = random.Random(seed)
    letters = b"abc"[:r.randint(1, 3)]
    piece = lambda n: bytes(r.choice(letters) for _ in range(r.randint(1, n)))
    starts, inner = {piece(5) for _ in range(r.randint(0, 8))}, {piece(5) for _ in range(r.randint(0, 10))}
    a = wordpiece.Automaton(starts, inner)
    for _ in range(400):
        w = piece(14)
        assert a.count(w) == greedy(w, starts, inner), (w, starts, inner)


def test_counts(docs_of, odd_rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    starts, inner = map(set, wordpiece.read_pieces(path))
    rows = [r for r in odd_rows if r[0] not in (7, 8)] + [(20, "unbelievable tokenization 12345 " + "ab" * 2000)]

    def want(text):
        split = (text or "").encode().split()
        n = [greedy(w, starts, inner) for w in split]
        return len(n), sum(n) + n.count(0), n.count(0)

    got = sorted([tuple(r) for r in wordpiece.token_counts(docs_of(rows, extra=True), path).collect()], key=str)
    assert got == sorted([(i, *want(t)) for i, t, *_ in rows], key=str)
    assert wordpiece.token_counts(docs_of([]), path).collect() == []
