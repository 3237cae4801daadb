"""What n-gram models and sentence scores send over the network."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from minpairs.operators import pieces as P
from minpairs.operators import score as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sentences(spark, texts, orders=None):
    rows = [(k if orders is None else orders[k], f"s{k}", t.split(" ")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "sent_ord long, sid string, words array<string>").select(
        "*", *[F.lit(None).cast("int").alias(c) for c in ("forms_all", "tids_all", "forms_surface", "tids_surface", "spans")])


TEXTS = [" ".join("the" if (k + j) % 2 else f"w{(k * j) % 97}" for j in range(k % 30 + 1)) for k in range(200)] + ["alone", "<s> word </s>"]


@pytest.mark.parametrize("codes", [0, 8, 1_000_000])
def test_words_without_a_number_are_spelled(spark, monkeypatch, codes):
    """whichever words have a number in the shuffle, the counts are those of the plain fit."""
    monkeypatch.setattr(S, "WORD_CODES", codes)
    sents = sentences(spark, TEXTS)
    words = S.word_counts(sents)
    coded = S.word_codes(words)
    assert coded.count() <= codes + 2 and {r.word for r in coded.collect()} >= {S.BOS, S.EOS}
    for order, plain in ((2, S.fit_bigram(sents)), (3, S.fit_masked(sents))):
        model = S.fit_bucketed(sents, words, order, buckets=5)
        cols = [*model.keys, "w", "c"]
        assert sorted(map(tuple, model.grams.select(cols).collect())) == sorted(map(tuple, plain.grams.select(cols).collect()))


@pytest.mark.parametrize("top", [0, 20, 500_000])
def test_sentences_are_scored_in_the_buckets(spark, monkeypatch, top):
    """The model is not shuffled, frequent n-grams are looked up at home; keys may repeat."""
    monkeypatch.setattr(S, "TOP_GRAMS", top)
    sents = sentences(spark, TEXTS)
    twice = sentences(spark, TEXTS, [k // 2 for k in range(len(TEXTS))])
    words = S.word_counts(sents)
    for order, plain in ((2, S.fit_bigram(sents)), (3, S.fit_masked(sents))):
        model = S.fit_bucketed(sents, words, order, buckets=5)
        assert "Exchange" not in plan(S.gram_scores(model))
        for some in (sents, twice, sentences(spark, ["the w1 unseen", "unseen"])):
            got, want = (sorted(map(tuple, S.sentence_scores(some, m).select("sent_ord", "sentence_id", "n_scored", F.round("log2_prob", 9)).collect()), key=str) for m in (model, plain))
            assert got == want


def test_contexts_of_more_than_a_bucket_are_dealt_out(spark):
    """with many buckets, a context that would fill several of them is split, however small its share."""
    texts = [" ".join("often" if j % 80 == 0 else f"w{k}x{j}" for j in range(240)) for k in range(40)]
    sents = sentences(spark, texts)
    model = S.fit_bucketed(sents, S.word_counts(sents), buckets=200)
    assert dict(model.hot)[("often",)] == 3
    assert sorted(r._part for r in model.contexts.where("prev = 'often'").collect()) == [0, 1, 2]
    plain = S.fit_bigram(sents)
    cols = ["prev", "w", "c"]
    assert sorted(map(tuple, model.grams.select(cols).collect())) == sorted(map(tuple, plain.grams.select(cols).collect()))


@pytest.mark.parametrize("codes", [0, 8, 1_000_000])
def test_masked_pieces_are_shuffled_once(spark, monkeypatch, codes):
    """n-grams of pieces are made where the sentences are, also with words that have no split at hand."""
    monkeypatch.setattr(S, "WORD_CODES", codes)
    texts = TEXTS + ["", "a  b"]  # with empty words
    sents = sentences(spark, texts)
    model = P.fit_pieces(sents, 3, size=3, least=5)
    assert model.ngrams.hot is not None and "Bucketed: true" in plan(model.ngrams.grams.groupBy("l", "r", "_part").count())
    split = {r.word: r.pieces for r in P.split_words(S.word_counts(sents).withColumnRenamed("w", "word"), model.pieces, 3).collect()}
    want = Counter()
    for t in texts:
        ws = ["<s>", *t.split(" "), "</s>"]
        for a, b, d in zip(ws, ws[1:], ws[2:]):
            chain = [(split.get(a) or ["<s>"])[-1], *split[b], (split.get(d) or ["</s>"])[0]]
            want.update(zip(chain, chain[1:], chain[2:]))
    assert {(r.l, r.w, r.r): r.c for r in model.ngrams.grams.collect()} == want
    assert model.ngrams.vocab == len({p for ps in split.values() for p in ps})
    assert not re.search("Exchange hash", plan(model.ngrams.grams))
