import pytest
from pyspark.sql import functions as F

from minpairs.operators import lexicon as L
from minpairs.operators.mask import build_masked
from minpairs.operators.pairs import minimal_pairs, ood_picks, override_feats, pair_vocabulary, with_ood_pairs
from minpairs.operators.pattern import Pattern

SUBJ = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}}, edges=[("V", "nsubj", "N")])


def test_override_feats(spark):
    df = spark.createDataFrame([({"number": "Sing", "person": "3"},)], "f map<string,string>")
    got = df.select(override_feats(F.col("f"), {"Number": "Plur", "person": None}).alias("o")).first().o
    assert got == {"number": "Plur"}


def test_pairs_same_lemma_features_and_case(tiny):
    lex = L.lexicon(tiny.tokens)
    masked = build_masked(tiny.sentences, SUBJ, "N", keep="all").masked
    mp = {(r.sentence_id, r.match_id): r for r in minimal_pairs(masked, lex, {"number": "Plur"},
                                                                 leading_space=False).collect()}
    # dog (Sing) -> dogs; 'Dogs' would be the first Plur 'dog' by order only
    # if the case of the first letter were ignored
    assert mp[("t-2", 2)].form_ungrammatical == "dogs"
    assert mp[("t-4", 5)].form_ungrammatical == "dogs"
    # already plural: the override changes nothing -> identical pair dropped
    assert ("t-1", 2) not in mp
    # 'Cats' (Plur) has no other capitalised 'cat'
    assert ("t-4", 1) not in mp
    assert set(mp[("t-2", 2)].asDict()) == {"sentence_id", "match_id", "form_grammatical", "original_text",
                                             "masked_text", "form_ungrammatical"}


def test_leading_space_and_unknown_feature(tiny):
    lex = L.lexicon(tiny.tokens)
    masked = build_masked(tiny.sentences, SUBJ, "N", keep="all").masked
    r = minimal_pairs(masked, lex, {"number": "Plur"}).first()
    assert r.form_grammatical.startswith(" ") and r.form_ungrammatical.startswith(" ")
    with pytest.raises(KeyError):
        minimal_pairs(masked, lex, {"gender": "Fem"})


def test_ood_picks_invariants(spark):
    rows = [(f"s{i}", 1, f"g{i % 7}", f"u{i % 7}") for i in range(40)]
    mp = spark.createDataFrame(rows, "sentence_id string, match_id int, form_grammatical string, "
                                     "form_ungrammatical string")
    vocab = pair_vocabulary(mp).collect()
    assert sorted(v.pair_pos for v in vocab) == list(range(7))
    picks = ood_picks(mp, 3, seed=1).collect()
    assert len(picks) == 40 * 3
    by_row = {}
    for p in picks:
        by_row.setdefault(p.sentence_id, []).append((p.ood_form_grammatical, p.ood_form_ungrammatical))
    own = {r[0]: (r[2], r[3]) for r in rows}
    for sid, ps in by_row.items():
        assert own[sid] not in ps and len(set(ps)) == 3
    again = sorted(tuple(p) for p in ood_picks(mp.repartition(5), 3, seed=1).collect())
    assert again == sorted(tuple(p) for p in picks)
    with pytest.raises(ValueError):
        ood_picks(mp, 7)
    arr = with_ood_pairs(mp, 2).first().ood_minimal_pairs
    assert len(arr) == 2


def test_universal_override_and_legacy_nan(spark, tiny, tmp_path):
    lex = L.lexicon(tiny.tokens)
    masked = build_masked(tiny.sentences, SUBJ, "N", keep="all").masked
    # Asking for another part of speech; no VERB with lemma 'dog' exists
    got = minimal_pairs(masked, lex, {"number": "Plur"}, universal={"upos": "NOUN"}, leading_space=False)
    assert {(r.sentence_id, r.form_ungrammatical) for r in got.collect()} == {("t-2", "dogs"), ("t-4", "dogs")}
    assert minimal_pairs(masked, lex, {"number": "Plur"}, universal={"upos": "VERB"}).count() == 0
    # The legacy reading turns the string 'nan' into NULL, the default keeps the word
    from minpairs.sources.conllu import read_conllu
    p = tmp_path / "nan.conllu"
    p.write_text("# sent_id = n-1\n# text = nan bread\n1\tnan\tnan\tNOUN\t_\tNumber=Sing\t0\troot\t_\t_\n"
                 "2\tbread\tbread\tNOUN\t_\tNumber=nan\t1\tnmod\t_\t_\n\n", encoding="utf-8")
    tb = read_conllu(spark, str(p))
    keep = {r.token_id: (r.form, r.feats) for r in L.lexicon(tb.tokens).collect()}
    legacy = {r.token_id: (r.form, r.feats) for r in L.lexicon(tb.tokens, legacy_nan=True).collect()}
    assert keep[0][0] == "nan" and keep[1][1] == {"number": "nan"}
    assert legacy[0][0] is None and legacy[1][1] == {}


def test_carried_context_gives_the_same_pairs(tiny):
    lex = L.lexicon(tiny.tokens)
    res = build_masked(tiny.sentences, SUBJ, "N", keep="all")
    cols = ["sentence_id", "match_id", "form_grammatical", "form_ungrammatical"]
    looked_up = minimal_pairs(res.masked, lex, {"number": "Plur"}).select(*cols).collect()
    carried = minimal_pairs(res.masked_with_context, lex, {"number": "Plur"}).select(*cols).collect()
    assert sorted(looked_up) == sorted(carried) and carried


def test_index_knows_its_feature_names(tiny):
    from minpairs.operators.pairs import lexicon_index

    lex = L.lexicon(tiny.tokens)
    masked = build_masked(tiny.sentences, SUBJ, "N", keep="all").masked
    index = lexicon_index(lex)  # keyed by whole maps
    same = minimal_pairs(masked, lex, {"number": "Plur"}, index=index, validate=False).count()
    assert same == minimal_pairs(masked, lex, {"number": "Plur"}).count() > 0
    with pytest.raises(ValueError, match="built on features"):
        minimal_pairs(masked, lex, {"number": "Plur"}, names=["number"], index=lexicon_index(lex, names=L.collect_feature_names(lex)))
    with pytest.raises(ValueError, match="upos"):
        minimal_pairs(masked, lex, {"number": "Plur"}, universal={"upos": "NOUN"}, index=index, validate=False)


def test_too_many_feature_names_raise(tiny, monkeypatch):
    monkeypatch.setattr(L, "MAX_FEATURES", 2)
    with pytest.raises(ValueError, match="more than 2 feature names"):
        L.collect_feature_names(L.lexicon(tiny.tokens))


def test_targets_are_not_shuffled_for_a_small_index(spark, monkeypatch):
    """Targets carry whole texts; an index beyond the limit is joined by a shuffle, with the same pairs."""
    from minpairs.operators import lexicon as L
    from minpairs.operators import pairs as E
    from minpairs.operators.mask import mask_treebank
    from minpairs.plans import registry
    from minpairs.sources.derived import derived_treebank

    rows = [(k, "sun moon tree\nsun moonabc tree", "en", "s") for k in range(20)] + [(None, "sun moon", None, None)]
    tb = derived_treebank(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    lex, found, plans = L.lexicon(tb.tokens), [], []
    for limit in (E.BROADCAST_INDEX, 0):
        with monkeypatch.context() as m:
            m.setattr(E, "BROADCAST_INDEX", limit)
            index = E.lexicon_index(lex, names=registry.DERIVED_FEATURES).stored()
        targets = mask_treebank(tb, registry.P_EDGE, "N").masked_with_context
        pairs = E.minimal_pairs(targets, lex, {"number": "Plur"}, index=index)
        found.append(sorted(map(str, pairs.collect())))
        plans.append(pairs._jdf.queryExecution().sparkPlan().toString())
    assert found[0] == found[1] and found[0]
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
