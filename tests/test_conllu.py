from pyspark.sql import functions as F

from minpairs.operators import lexicon as L
from minpairs.sources.conllu import read_conllu
from minpairs.sources.treebank import with_alignment_columns


def test_sentences_and_tokens(tiny):
    s = {r.sid: r for r in tiny.sentences.collect()}
    assert list(s) == ["t-1", "t-2", "t-3", "t-4"] or set(s) == {"t-1", "t-2", "t-3", "t-4"}
    assert s["t-1"].text == "The dogs bark at the cat."
    toks = tiny.tokens
    assert toks.count() == 7 + 8 + 6 + 6
    rng = toks.where("id = '4-5'").first()
    assert (rng.tid, rng.range_from, rng.range_to, rng.form) == (None, 4, 5, "del")
    empty = toks.where("id = '3.1'").first()
    assert empty.tid is None and empty.range_from is None


def test_feats_lower_case_and_values_kept(tiny):
    toks = tiny.tokens
    el = toks.where("sid = 't-2' and tid = 5").first()
    assert el.feats == {"number[psor]": "Sing"}
    today = toks.where("sid = 't-3' and tid = 5").first()
    assert today.feats == {"case": "Acc,Dat"}
    assert toks.where("sid = 't-1' and tid = 4").first().feats == {}
    # '_' means no value for upos/xpos/deprel, but the form '_' is kept
    u = toks.where("sid = 't-3' and tid = 4").first()
    assert u.form == "_" and u.xpos is None


def test_lexicon_filter_and_ids(tiny):
    lex = L.lexicon(tiny.tokens)
    rows = lex.collect()
    # punctuation '.' dropped, ranges and empty nodes dropped
    assert all(r.form != "." for r in rows)
    assert len(rows) == 6 + 6 + 5 + 6
    r = lex.where("sentence_id = 't-1' and form = 'dogs'").first()
    assert r.token_id == 1
    assert sorted(L.collect_feature_names(lex)) == sorted(
        ["definite", "number", "person", "number[psor]", "verbform", "case"])


def test_wide_view_and_candidates(tiny):
    lex = L.lexicon(tiny.tokens)
    w = L.wide(lex)
    assert "feats__number" in w.columns and "feats__number[psor]" in w.columns
    c = L.candidate_set(lex, {"Number": "Plur"}).select("form").collect()
    assert sorted(x.form for x in c) == sorted(["dogs", "bark", "Dogs", "were", "Cats", "sleep"])
    # null-safe: a None value asks for the feature to be absent
    none = L.candidate_set(lex, {"number": None}, {"upos": "NOUN"}).select("form").collect()
    assert sorted(x.form for x in none) == ["today"]
    import pytest
    with pytest.raises(KeyError):
        L.candidate_set(lex, {"gender": "Fem"})


def test_crlf_and_multi_file_order(spark, tmp_path, tiny_path):
    text = open(tiny_path, encoding="utf-8").read()
    crlf = tmp_path / "crlf.conllu"
    crlf.write_bytes(text.replace("\n", "\r\n").encode("utf-8"))
    tb = read_conllu(spark, [str(crlf), tiny_path])
    s = tb.sentences
    assert s.count() == 8
    assert s.where("text = 'The dogs bark at the cat.'").count() == 2
    # file order is the order of the list
    firsts = s.orderBy("sent_ord").select("file_ord").collect()
    assert [r.file_ord for r in firsts] == [0, 0, 0, 0, 1, 1, 1, 1]


def test_alignment_columns(tiny):
    s = with_alignment_columns(tiny.sentences).where("sid = 't-2'").first()
    assert s.forms_surface == ["A", "dog", "barks", "del", "mar", "."]
    assert s.tids_surface == [1, 2, 3, None, 6, 7]
    assert s.forms_all[3:6] == ["del", "de", "el"]
    assert s.words == ["A", "dog", "barks", "de", "el", "mar", "."]


def test_multi_split_read_equals_single_split(spark, tmp_path, tiny_path):
    # many copies of the treebank in one file, read with tiny splits: the
    # record reader must resynchronise on blank lines and the ordinal must
    # still follow file order
    text = open(tiny_path, encoding="utf-8").read()
    big = tmp_path / "big.conllu"
    big.write_text("".join(text.replace("sent_id = t-", f"sent_id = c{i}-t-") for i in range(40)),
                   encoding="utf-8")
    one = read_conllu(spark, str(big)).sentences
    expected = [(r.sid, r.text, len(r.tokens)) for r in one.orderBy("sent_ord").collect()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        many = read_conllu(spark, str(big)).sentences
        assert many.rdd.getNumPartitions() > 5
        got = [(r.sid, r.text, len(r.tokens)) for r in many.orderBy("sent_ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == expected
    assert [g[0] for g in got][:4] == ["c0-t-1", "c0-t-2", "c0-t-3", "c0-t-4"]


def sentence_of(k, end):
    return f"# sent_id = {k}{end}# text = go on{end}1\tgo\tgo\tVERB\t_\t_\t0\troot\t_\t_{end}2\ton\ton\tADP\t_\t_\t1\tobl\t_\t_{end}{end}"


def sids(tb):
    return [r.sid for r in tb.sentences.orderBy("sent_ord").collect()]


def test_a_file_that_changes_its_line_ending(spark, tmp_path):
    p = tmp_path / "x.conllu"
    body = "".join(sentence_of(k, "\n" if k < 300 else "\r\n") for k in range(600)) + " \t\n\n" + sentence_of(600, "\r\n").rstrip()
    p.write_bytes(b"\n\r\n" + body.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            tb = read_conllu(spark, str(p))
            assert sids(tb) == [str(k) for k in range(601)]
            assert tb.sentences.where(F.size("tokens") != 2).count() == 0
        small = tmp_path / "y.conllu"  # splits shorter than a sentence: it goes on over several
        small.write_bytes("".join(sentence_of(k, "\n") for k in range(5)).encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "25")
        assert sids(read_conllu(spark, str(small))) == [str(k) for k in range(5)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fragments_meet_only_across_one_edge(spark):
    """Splits that begin or end with a blank line, hold none, or hold nothing else."""
    from minpairs.sources.conllu import sentence_blocks

    splits = [["a", "b"], ["c", "", "d"], ["e"], ["f", ""], ["", ""], ["g"], ["", "h"], ["i", "j", "", "", "k", ""], ["l"]]
    rows = [(x, f"file:/{name}", 100 * i, 1000 * i + j) for name in ("x", "y") for i, s in enumerate(splits) for j, x in enumerate(s)]
    lines = spark.createDataFrame(rows, "value string, path string, block_start long, o long")
    want = ["a\nb\nc", "d\ne\nf", "g", "h\ni\nj", "k", "l"]
    for n in (1, 4):
        placed = lines.repartitionByRange(n, "path").sortWithinPartitions("path", "block_start", "o")
        got = sentence_blocks(placed)
        for name in ("x", "y"):
            assert [r.value for r in got.where(f"path = 'file:/{name}'").orderBy("block_start", "row_id").collect()] == want
        assert got.select("path", "block_start", "row_id").distinct().count() == 12
    assert sentence_blocks(lines.limit(0)).count() == 0


def test_many_small_files(spark, tmp_path):
    import time

    for k in range(3000):
        (tmp_path / f"{k:05}.conllu").write_text(sentence_of(k, "\n"))
    started = time.time()
    tb = read_conllu(spark, str(tmp_path))
    named = read_conllu(spark, [str(tmp_path / f"{k:05}.conllu") for k in range(2999, 2400, -1)])
    assert time.time() - started < 60
    assert tb.sentences.count() == 3000 and sids(named) == [str(k) for k in range(2999, 2400, -1)]
