import math
from collections import Counter

import pandas as pd
import pytest

from minpairs.operators import score as S
from minpairs.sources.treebank import with_alignment_columns


def test_bigram_model_against_brute_force(tiny):
    words = {r.sid: r.words for r in with_alignment_columns(tiny.sentences).select("sid", "words").collect()}
    bg = Counter((w[i - 1], w[i]) for w in words.values() for i in range(1, len(w)))
    hist = Counter(p for p, _ in bg.elements())
    V = len({x for w in words.values() for x in w})
    model = S.fit_bigram(tiny.sentences)
    assert model.vocab == V
    got = {r.sentence_id: (r.n_scored, r.log2_prob) for r in S.sentence_scores(tiny.sentences, model).collect()}
    for sid, w in words.items():
        exp = sum(math.log2((bg[(w[i - 1], w[i])] + 0.1) / (hist[w[i - 1]] + 0.1 * V)) for i in range(1, len(w)))
        assert got[sid][0] == len(w) - 1
        assert got[sid][1] == pytest.approx(exp, rel=1e-12)


def test_token_scores_context(spark, tiny):
    pairs = spark.createDataFrame([("t-4", 4, 5, "the", "barks", " dog", " dogs"), ("t-1", 1, 1, None, "dogs", "The", None)],
                                  "sentence_id string, sent_ord int, match_id int, prev_word string, next_word string, "
                                  "form_grammatical string, form_ungrammatical string")
    model = S.fit_bigram(tiny.sentences)
    r = {x.sentence_id: x for x in S.token_scores(pairs, model).collect()}
    V = model.vocab
    # history 'the' occurs twice ('the cat', 'the dog'); 'the dogs' never
    assert r["t-4"].p_form_grammatical == pytest.approx((1 + 0.1) / (2 + 0.1 * V))
    assert r["t-4"].p_form_ungrammatical == pytest.approx((0 + 0.1) / (2 + 0.1 * V))
    # first word: sentence-start context is unseen -> uniform
    assert r["t-1"].p_form_grammatical == pytest.approx(1 / V)
    assert r["t-1"].p_form_ungrammatical is None
    # certainty: 1 - H / ln V over the whole vocabulary
    seen = {"cat": 1, "dog": 1}
    p = [(c + 0.1) / (2 + 0.1 * V) for c in seen.values()] + [0.1 / (2 + 0.1 * V)] * (V - 2)
    assert r["t-4"].certainty == pytest.approx(round(1 + sum(x * math.log(x) for x in p) / math.log(V), 2))
    assert r["t-1"].certainty == 0.0  # unseen context: uniform
    m3 = S.fit_masked(tiny.sentences)
    r3 = {x.sentence_id: x for x in S.token_scores(pairs, m3).collect()}
    assert r3["t-4"].p_form_grammatical == pytest.approx((1 + 0.1) / (1 + 0.1 * m3.vocab))


# the workers cannot import this test module: ship its classes by value
import sys  # noqa: E402

from pyspark import cloudpickle  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class StubScorer:
    def score_batch(self, texts, targets, entropy_topk):
        assert len(texts) == len(targets) and entropy_topk == 100
        return [[1.0 / (1 + len(w)) for w in ws] for ws in targets], [0.5] * len(texts)


def test_evaluate_contract(spark):
    df = spark.createDataFrame(pd.DataFrame({
        "sentence_id": ["a", "b", "c"], "match_id": [1, 2, 3], "masked_text": ["x [MASK]"] * 3,
        "form_grammatical": [" is", " are", " was"], "form_ungrammatical": [" are", " is", " were"]}))
    out = S.evaluate(df, StubScorer, "mlm").orderBy("sentence_id").collect()
    assert [round(r.p_form_grammatical, 6) for r in out] == [0.25, 0.2, 0.2]
    assert all(r.certainty == 0.5 for r in out)
    assert out[0].I_form_grammatical == pytest.approx(2.0)
    lim = S.evaluate(df, StubScorer, "mlm", row_limit=2).count()
    assert lim == 2
    with pytest.raises(ValueError):
        S.evaluate(df, StubScorer, "encoder")
    with pytest.raises(KeyError):
        S.evaluate(df, StubScorer, "ntp")        # token-level NTP needs prompt_text
    with pytest.raises(ValueError, match="row_limit"):
        S.evaluate(df, StubScorer, "mlm", row_limit=0)


def test_sentence_pair_scores_against_rescored_sentences(spark, tiny):
    model = S.fit_bigram(tiny.sentences).stored()
    words = {r.sid: (r.sent_ord, r.words) for r in with_alignment_columns(tiny.sentences).select("sid", "sent_ord", "words").collect()}
    bg = Counter((w[i - 1], w[i]) for _, w in words.values() for i in range(1, len(w)))
    hist = Counter(p for p, _ in bg.elements())
    score = lambda w: sum(math.log2((bg[w[i - 1], w[i]] + 0.1) / (hist[w[i - 1]] + 0.1 * model.vocab)) for i in range(1, len(w)))
    for sid in words:
        for i in (1, 3, len(words[sid][1])):
            w = words[sid][1]
            row = tiny.sentences.where(f"sid = '{sid}'").selectExpr("sent_ord", f"{i} as match_id").withColumns(
                {"prev_word": S.F.lit(w[i - 2] if i > 1 else None).cast("string"), "next_word": S.F.lit(w[i] if i < len(w) else None).cast("string"),
                 "form_grammatical": S.F.lit(" " + w[i - 1]), "form_ungrammatical": S.F.lit(" dogs")})
            r = S.sentence_pair_scores(row, tiny.sentences, model).first()
            assert r.p_form_grammatical == pytest.approx(score(w)) and r.n_scored == len(w) - 1
            assert r.p_form_ungrammatical == pytest.approx(score([*w[:i - 1], "dogs", *w[i:]]))
            assert r.I_form_ungrammatical == -r.p_form_ungrammatical


def test_a_frequent_word_is_split(spark):
    """Half of all words are equal: both lookups of the scorer read it in parts."""
    rows = [(k, f"s{k}", " ".join("the" if (k + j) % 2 else f"w{(k * j) % 997}" for j in range(40))) for k in range(4000)]
    sents = spark.createDataFrame(rows, "sent_ord long, sid string, text string").select(
        "*", S.F.split("text", " ").alias("words"), *[S.F.lit(None).cast("int").alias(c) for c in ("forms_all", "tids_all", "forms_surface", "tids_surface", "spans")])
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        model = S.fit_bigram(sents).stored()
        pairs = S.bigrams(sents).select("sent_ord", S.F.col("tid").alias("match_id"), S.F.col("prev").alias("prev_word"),
                                        S.F.lit(None).cast("string").alias("next_word"), S.F.col("w").alias("form_grammatical"))
        scored = S.token_scores(pairs, model, cols=("form_grammatical",))
        assert scored.count() == 4000 * 39
        plan = scored._jdf.queryExecution().executedPlan().toString()
        got = S.looked_up(pairs.select("sent_ord", S.F.col("prev_word").alias("prev"), S.F.col("form_grammatical").alias("w")), model)
        got.write.format("noop").mode("overwrite").save()
        assert got.agg(S.F.count("p")).first()[0] == 4000 * 39
        x = got.agg(S.F.sum("p"))
        x.collect()
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "skewed" in plan or "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bucketed_model_scores_alike_without_shuffling_itself(spark, tiny):
    import re

    sents = spark.createDataFrame([(k, f"s{k}", " ".join("the" if (k + j) % 2 else f"w{(k * j) % 97}" for j in range(30))) for k in range(300)],
                                  "sent_ord long, sid string, text string").select(
        "*", S.F.split("text", " ").alias("words"), *[S.F.lit(None).cast("int").alias(c) for c in ("forms_all", "tids_all", "forms_surface", "tids_surface", "spans")])
    pairs = S.bigrams(sents).select("sent_ord", S.F.col("tid").alias("match_id"), S.F.col("prev").alias("prev_word"), S.F.lit(None).cast("string").alias("next_word"),
                                    S.F.col("w").alias("form_grammatical"), S.F.when(S.F.col("tid") % 3 > 0, " unseen").alias("form_ungrammatical"))
    pairs = S.cut_lineage(pairs)
    for model in (S.fit_bigram(sents), S.fit_masked(sents)):
        stored = model.bucketed(5)
        # half of all words are equal: that context is in several parts (and so in several buckets)
        parts = stored.grams.groupBy(*model.keys).agg(S.F.countDistinct("_part").alias("n")).agg(S.F.max("n")).first()[0]
        assert model.order == 3 or (parts > 10 and any(v == ("the",) for v, _ in stored.hot) and len(stored.hot) <= S.HOT_SHARE)
        a, b = (S.token_scores(pairs, m).select("sent_ord", "match_id", "p_form_grammatical", "p_form_ungrammatical", "certainty") for m in (model, stored))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        sa, sb = (sorted(map(tuple, S.sentence_scores(sents, m).select("sent_ord", "n_scored", S.F.round("log2_prob", 9)).collect())) for m in (model, stored))
        assert sa == sb
    plan = S.token_scores(pairs, S.fit_bigram(sents).bucketed(8))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) <= 4


def _sentences(spark, texts):
    return spark.createDataFrame([(k, f"s{k}", t) for k, t in enumerate(texts)], "sent_ord long, sid string, text string").select(
        "*", S.F.split("text", " ").alias("words"), *[S.F.lit(None).cast("int").alias(c) for c in ("forms_all", "tids_all", "forms_surface", "tids_surface", "spans")])


def test_a_model_fitted_in_buckets_is_the_plain_one(spark):
    """N-grams are shuffled once, by context; counts, contexts and scores are those of the plain fit."""
    import re

    texts = [" ".join("the" if (k + j) % 2 else f"w{(k * j) % 97}" for j in range(k % 30 + 1)) for k in range(200)]
    sents = _sentences(spark, [*texts, *["alone"] * 20])  # (<s>, </s>) is a hot context of trigrams
    words = S.word_counts(sents)
    seen = Counter(w for t in [*texts, *["alone"] * 20] for w in t.split(" "))
    assert {r.w: r.c for r in words.collect()} == seen
    for order, plain in ((2, S.fit_bigram(sents)), (3, S.fit_masked(sents))):
        model = S.fit_bucketed(sents, words, order, buckets=5)
        assert model.vocab == len(seen) == plain.vocab and model.bucketed() is model
        assert (("the",) if order == 2 else ("the", "the")) in dict(model.hot)
        cols = [*model.keys, "w", "c"]
        assert sorted(map(tuple, model.grams.select(cols).collect())) == sorted(map(tuple, plain.grams.select(cols).collect()))
        want = {tuple(r[k] for k in model.keys): (r.h, pytest.approx(r.e, rel=1e-9)) for r in plain.contexts.collect()}
        got = {tuple(r[k] for k in [*model.keys, "_part"]): (r.h, r.e) for r in model.contexts.collect()}
        parts = dict(model.hot)
        assert set(got) == {(*k, i) for k in want for i in range(parts.get(k, 1))}
        assert all(got[k] == want[k[:-1]] for k in got)
        for df in (model.grams, model.contexts):
            assert "Bucketed: true" in df.groupBy(*model.keys, "_part").count()._jdf.queryExecution().executedPlan().toString()
        pairs = S.cut_lineage(S.trigrams(sents).select("sent_ord", S.F.col("tid").alias("match_id"), S.F.nullif("l", S.F.lit(S.BOS)).alias("prev_word"), S.F.nullif("r", S.F.lit(S.EOS)).alias("next_word"),
                                                       S.F.col("w").alias("form_grammatical"), S.F.lit(" unseen").alias("form_ungrammatical")))
        a, b = (S.token_scores(pairs, m).select("sent_ord", "match_id", "p_form_grammatical", "p_form_ungrammatical", "certainty") for m in (plain, model))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        text = S.looked_up(pairs.selectExpr("prev_word as prev", "prev_word as l", "next_word as r", "form_grammatical as w"), model)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange ", text)) == 1 and "SortMergeJoin" not in text
