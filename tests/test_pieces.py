import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from minpairs.operators import pieces as P
from minpairs.operators import score as S
from minpairs.sources.treebank import with_alignment_columns


def brute_split(word, table, size):
    out, at = [], 0
    while at < len(word):
        n = next((n for n in range(size, 1, -1) if at + n <= len(word) and word[at:at + n] in table), 1)
        out.append(word[at:at + n])
        at += n
    return out


@pytest.fixture(scope="module")
def corpus(tiny):
    return [r.words for r in with_alignment_columns(tiny.sentences).select("words").collect()]


def table_of(corpus, size, least):
    c = Counter(w[p:p + n] for ws in corpus for w in ws for n in range(2, size + 1) for p in range(len(w) - n + 1))
    return {k for k, v in c.items() if v >= least}


def test_split_against_brute_force(spark, corpus):
    words = sorted({w for ws in corpus for w in ws} | {"", "x", "dogsbarks", "éàñ你好", "a" * 500, "thethethe", "do"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    counts = spark.createDataFrame(list(Counter(w for ws in corpus for w in ws).items()), "w string, c long")
    for size, least in ((4, 2), (2, 1), (3, 3), (6, 2)):
        table = P.piece_table(counts, size, least)
        assert {r.piece for r in table.collect()} == table_of(corpus, size, least)
        got = {r.word: r.pieces for r in P.split_words(df, table, size).collect()}
        assert got == {w: brute_split(w, table_of(corpus, size, least), size) for w in words}


@pytest.mark.parametrize("order", [2, 3])
def test_chain_rule_against_brute_force(spark, tiny, corpus, order):
    size, least = 3, 2
    table = table_of(corpus, size, least)
    sents = [[x for w in ws for x in brute_split(w, table, size)] for ws in corpus]
    V = len({x for s in sents for x in s})
    pad = [["<s>", *s, "</s>"] for s in sents]
    if order == 2:
        grams = Counter((s[i], s[i + 1]) for s in sents for i in range(len(s) - 1))
        ctx = Counter(s[i] for s in sents for i in range(len(s) - 1))
    else:
        grams = Counter((s[i - 1], s[i], s[i + 1]) for s in pad for i in range(1, len(s) - 1))
        ctx = Counter((s[i - 1], s[i + 1]) for s in pad for i in range(1, len(s) - 1))
    rows = [(1, 1, "the", "barks", " dog", " dogs"), (2, 1, None, None, "Dogsbark", None), (3, 2, "unseen", ".", " cat", ""), (4, 1, "dogs", "at", "zzz", " bark")]
    pairs = spark.createDataFrame(rows, "sent_ord int, match_id int, prev_word string, next_word string, form_grammatical string, form_ungrammatical string")
    model = P.fit_pieces(tiny.sentences, order, size=size, least=least)
    assert model.ngrams.vocab == V
    known = {w for ws in corpus for w in ws}

    def prob(prev, after, word):
        left = brute_split(prev, table, size)[-1] if prev in known else "<s>"
        right = brute_split(after, table, size)[0] if after in known else "</s>"
        p = 1.0
        for x in brute_split(word, table, size):
            c, h = (grams[left, x], ctx[left]) if order == 2 else (grams[left, x, right], ctx[left, right])
            p *= max((c + 0.1) / (h + 0.1 * V), 1e-12)
            left = x
        return p

    for r in P.piece_scores(pairs, model, size=size).collect():
        for c in ("form_grammatical", "form_ungrammatical"):
            word = (r[c] or "").removeprefix(" ")
            if not word:
                assert r[f"p_{c}"] is None and r[f"n_pieces_{c}"] is None
                continue
            assert r[f"n_pieces_{c}"] == len(brute_split(word, table, size))
            assert r[f"p_{c}"] == pytest.approx(prob(r.prev_word, r.next_word, word), rel=1e-9)
            assert r[f"I_{c}"] == pytest.approx(-math.log2(r[f"p_{c}"]), rel=1e-9)


def test_floor(spark, tiny):
    model = P.fit_pieces(tiny.sentences, size=2, least=1000)
    sharp = model._replace(ngrams=model.ngrams._replace(alpha=1e-15))
    pairs = spark.createDataFrame([(1, 1, "the", None, "zz", "z")], "sent_ord int, match_id int, prev_word string, next_word string, form_grammatical string, form_ungrammatical string")
    r = P.piece_scores(pairs, sharp).first()
    assert r.n_pieces_form_grammatical == 2 and r.p_form_ungrammatical == pytest.approx(1e-12)
    assert model.ngrams.grams.where(F.col("c") < 1).count() == 0


def test_masked_sentences_against_rescored_ones(spark, tiny, corpus):
    model = S.fit_masked(tiny.sentences)
    pad = [["<s>", *s, "</s>"] for s in corpus]
    tri = Counter((s[i - 1], s[i], s[i + 1]) for s in pad for i in range(1, len(s) - 1))
    ctx = Counter((s[i - 1], s[i + 1]) for s in pad for i in range(1, len(s) - 1))

    def score(ws):
        s = ["<s>", *ws, "</s>"]
        return sum(math.log2((tri[s[i - 1], s[i], s[i + 1]] + 0.1) / (ctx[s[i - 1], s[i + 1]] + 0.1 * model.vocab)) for i in range(1, len(s) - 1))

    sents = with_alignment_columns(tiny.sentences).select("sid", "sent_ord", "words").collect()
    get = lambda w, i: w[i] if 0 <= i < len(w) else None
    rows, want = [], {}
    for s in sents:
        for i in (0, 1, len(s.words) - 1):
            w = s.words
            rows.append((s.sid, i + 1, get(w, i - 1), get(w, i + 1), get(w, i - 2), get(w, i + 2), " " + w[i], " dogs"))
            want[s.sid, i + 1] = (score(w), score([*w[:i], "dogs", *w[i + 1:]]), len(w))
    pairs = spark.createDataFrame(rows, "sid string, match_id int, prev_word string, next_word string, prev2_word string, next2_word string, form_grammatical string, form_ungrammatical string")
    pairs = pairs.join(tiny.sentences.select("sid", "sent_ord"), "sid").dropDuplicates(["sid", "match_id"])
    got = {(r.sid, r.match_id): r for r in S.sentence_pair_scores(pairs, tiny.sentences, model).collect()}
    assert set(got) == set(want)
    for k, (g, u, n) in want.items():
        assert got[k].p_form_grammatical == pytest.approx(g) and got[k].p_form_ungrammatical == pytest.approx(u) and got[k].n_scored == n


def test_words_are_split_without_shuffling_substrings(spark, tiny, monkeypatch):
    """substrings meet a small table where they are made; places beyond one number, and a large table."""
    words = ["abab" * 40, "ab" * 10 + "x" + "ba" * 11, "x" * 21 + "ab", "x" * 62 + "ab", "x" * 63 + "ba", "", "a", "ab", "你好ab", None]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, k int")
    for size, table in ((4, {"ab", "aba", "baba", "ba", "你好"}), (2, {"ab", "ba"}), (8, {"abababab", "ab", "xxxxx"}), (64, {"ab" * 32, "ab"})):
        pieces = spark.createDataFrame([(p,) for p in table], "piece string")
        want = {w: brute_split(w, table, size) for w in words if w is not None}
        got = P.split_words(df, pieces, size)
        assert {r.word: r.pieces for r in got.collect() if r.word is not None} == want and got.columns == ["word", "k", "pieces"]
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(P, "BROADCAST_PIECES", 0)
            large = P.split_words(df, pieces, size)
            assert {r.word: r.pieces for r in large.collect() if r.word is not None} == want
            assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_piece_counts_from_a_bucketed_model_with_hot_words(spark):
    """the bigrams of a word that is dealt out all meet its last piece."""
    texts = [["the" if (k + j) % 2 else f"w{(k * j) % 97}" for j in range(k % 30 + 1)] for k in range(150)]
    sents = spark.createDataFrame([(k, f"s{k}", t) for k, t in enumerate(texts)], "sent_ord long, sid string, words array<string>").select(
        "*", *[F.lit(None).cast("int").alias(c) for c in ("forms_all", "tids_all", "forms_surface", "tids_surface", "spans")])
    table = table_of(texts, 3, 5)
    split = [[x for w in t for x in brute_split(w, table, 3)] for t in texts]
    words = S.word_counts(sents)
    model = P.fit_pieces(sents, size=3, least=5, words=words, bigram=S.fit_bucketed(sents, words))
    assert {(r.prev, r.w): r.c for r in model.ngrams.grams.collect()} == Counter(p for s in split for p in zip(s, s[1:]))
