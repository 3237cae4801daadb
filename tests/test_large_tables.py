"""A lexicon that was saved and is loaded again."""

from pyspark.sql import functions as F

from minpairs.operators import lexicon as L
from minpairs.operators.pairs import lexicon_index
from minpairs.sources import tables as T
from minpairs.sources.derived import derived_treebank


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    rows = [(2, "the Dog saw a cats\n\n word and", "en", "s"), (1, "abcd ab abcd . x", None, None), (None, "no key at all", "en", "s"), (1, "abcd ab abcd . x", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_tokens_in_order_sort_sentences(spark):
    """the foreign lexicon is written in order without a sort of all tokens."""
    tb = derived_treebank(docs(spark))
    got = L.lexicon(tb.tokens_in_order)
    text = plan(got)
    assert text.index("Generate") < text.index("Sort [")  # what is sorted lies below
    rows = [(r.sent_ord, r.token_id, r.form) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(r.sent_ord, r.token_id, r.form) for r in L.lexicon(tb.tokens).collect()], key=str)
    keys = [(o.doc_id or 0, o.ln) for o, _, _ in rows]
    assert keys == sorted(keys)


def test_foreign_lexicon_is_ordered_by_one_number(spark, tmp_path):
    """sentences in reading order over files, also where their rows are apart; feature names need no join."""
    folder = tmp_path / "l.csv"
    folder.mkdir()
    head = "sentence_id,token_id,form,lemma,feats__number,feats__case\n"
    (folder / "a.csv").write_text(head + 's2,0,x,x,Sing,\ns1,0,y,y,,Nom\n,0,n,n,,\n')
    (folder / "b.csv").write_text(head + 's2,1,z,z,Plur,\ns3,0,v,v,,\n"",1,m,m,,\n')
    lex = T.load_lexicon(spark, str(folder))
    assert lex.schema["sent_ord"].dataType.typeName() == "long"
    got = [(r.sentence_id, r.token_id, r.form, r.tid, dict(r.feats)) for r in lex.orderBy("sent_ord", "tid").collect()]
    assert got == [("s2", 0, "x", 1, {"number": "Sing"}), ("s2", 1, "z", 2, {"number": "Plur"}), ("s1", 0, "y", 1, {"case": "Nom"}),
                   (None, 0, "n", 1, {}), ("s3", 0, "v", 1, {}), ("", 1, "m", 2, {})]
    assert "Join" not in plan(L.feature_names(lex)) and L.collect_feature_names(lex) == ["case", "number"]
    assert L.collect_feature_names(lex.where("form = 'x'")) == ["number"]  # what it could hold is not what it has
    assert "decimal" not in plan(lexicon_index(lex, names=["number"]).frame)


def test_saved_order_makes_an_index_of_longs(spark, tmp_path):
    """the places of a loaded lexicon are two bigints, and its index is still reduced by form."""
    lex = L.lexicon(derived_treebank(docs(spark)).tokens.where("sent_ord.doc_id is not null"))
    T.save_lexicon(lex, str(tmp_path / "l.csv"), "csv")
    back = T.load_lexicon(spark, str(tmp_path / "l.csv"))
    assert "decimal" not in plan(lexicon_index(back, names=["number"]).frame)
    a, b = (sorted(map(tuple, lexicon_index(x, names=["case", "number"]).frame.collect())) for x in (lex, back))
    assert a == b
    assert L.collect_feature_names(back) == L.collect_feature_names(lex)
    assert back.select(F.max(F.size("feats"))).first()[0] == 2
