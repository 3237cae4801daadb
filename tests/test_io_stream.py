import os

import pytest
from pyspark.sql import functions as F

from minpairs.operators import lexicon as L
from minpairs.operators.mask import build_masked
from minpairs.operators.pattern import Pattern
from minpairs.sources import tables as T


def test_lexicon_roundtrip_csv_keeps_strings(spark, tiny, tmp_path):
    lex = L.lexicon(tiny.tokens)
    p = str(tmp_path / "lex.csv")
    T.save_lexicon(lex, p, fmt="csv")
    back = T.load_lexicon(spark, p, fmt="csv")
    a = {(r.sentence_id, r.token_id): (r.form, r.feats) for r in lex.collect()}
    b = {(r.sentence_id, r.token_id): (r.form, r.feats) for r in back.collect()}
    assert a == b
    # Person=3 stays the string "3"
    assert back.where("form = 'bark'").first().feats["person"] == "3"
    q = str(tmp_path / "lex.parquet")
    T.save_lexicon(lex, q)
    assert T.load_lexicon(spark, q).count() == lex.count()


def test_load_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        T.load_lexicon(spark, str(tmp_path / "nope.csv"))
    p = tmp_path / "bad.csv"
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        T.load_lexicon(spark, str(p))
    with pytest.raises(ValueError):
        T.load_pairs(spark, str(p))
    e = tmp_path / "empty.csv"
    e.write_text("sentence_id,p_form_grammatical\n")
    with pytest.raises(ValueError):
        T.load_evaluation(spark, str(e))


def test_pairs_csv_with_arrays(spark, tiny, tmp_path):
    p = Pattern(nodes={"V": {"upos": "VERB"}})
    exc = build_masked(tiny.sentences, p, "V", keep="all", legacy=True).exceptions
    out = str(tmp_path / "exc.csv")
    T.save_table(exc, out, fmt="csv")
    back = spark.read.option("header", True).csv(out)
    assert back.count() == exc.count()
    df = spark.createDataFrame([("s", "1", "t", '[{"form_grammatical": " a", "form_ungrammatical": " b"}]')],
                               "sentence_id string, match_id string, original_text string, ood_minimal_pairs string")
    q = str(tmp_path / "mp.csv")
    T.save_table(df, q, fmt="csv")
    mp = T.load_pairs(spark, q).first()
    assert mp.match_id == 1 and mp.ood_minimal_pairs[0].form_ungrammatical == " b"


def test_masked_stream_matches_batch(spark, tiny, tiny_path, tmp_path):
    from minpairs.streaming.incremental import masked_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.conllu").write_text(open(tiny_path, encoding="utf-8").read(), encoding="utf-8")
    p = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}}, edges=[("V", "nsubj", "N")])
    q = masked_stream(spark, str(src), p, "N", str(tmp_path / "out"), str(tmp_path / "ckpt"),
                      keep="all", available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "masked"))
    exp = build_masked(tiny.sentences, p, "N", keep="all").masked
    cols = ["sentence_id", "match_id", "masked_text"]
    assert sorted(got.select(cols).collect()) == sorted(exp.select(cols).collect())
