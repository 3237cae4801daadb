"""Edge cases of sources, tables and small operators that once went wrong."""

import math

import pytest
from pyspark.sql import functions as F

from minpairs import session
from minpairs.functions import metrics as M
from minpairs.operators import lexicon as L
from minpairs.operators.mask import build_masked, mask_check
from minpairs.operators.pairs import keyed_permutation, minimal_pairs, ood_picks
from minpairs.operators.pattern import Pattern, match, match_in_row
from minpairs.operators.reshape import histogram, melt_long
from minpairs.sources import scan
from minpairs.sources import tables as T
from minpairs.sources.conllu import read_conllu

VERB = Pattern(nodes={"V": {"upos": "VERB"}})


def sentence(sid, text, *words, sep="\n"):
    head = ([f"# sent_id = {sid}"] if sid else []) + [f"# text = {text}"]
    rows = [f"{i}\t{f}\t{f}\t{u}\t_\t_\t{h}\t{r}\t_\t_" for i, (f, u, h, r) in enumerate(words, 1)]
    return sep.join([*head, *rows]) + sep + sep


def test_ids_that_repeat_over_files(spark, tmp_path):
    (tmp_path / "a b.conllu").write_text(sentence("1", "run dog", ("run", "VERB", 0, "root"), ("dog", "NOUN", 1, "obj")))
    (tmp_path / "c.conllu").write_text(sentence("1", "a cat ran", ("a", "DET", 2, "det"), ("cat", "NOUN", 3, "nsubj"), ("ran", "VERB", 0, "root")))
    tb = read_conllu(spark, [str(tmp_path / "a b.conllu"), str(tmp_path / "c.conllu")])
    want = [("1", 1, "run", "[MASK] dog"), ("1", 3, "ran", "a cat [MASK]")]
    for keep in ("all", "last"):
        got = build_masked(tb.sentences, VERB, "V", keep=keep).masked.select("sentence_id", "match_id", "match_token", "masked_text").collect()
        assert sorted(map(tuple, got)) == want
        by_tokens = match(tb.tokens, VERB, "V", keep=keep)
        assert by_tokens.count() == 2
        assert build_masked(tb.sentences, matches=by_tokens).masked.count() == 2
    with pytest.raises(ValueError, match="more than once"):
        read_conllu(spark, [str(tmp_path / "c.conllu"), str(tmp_path / "c.conllu")])


def test_sentence_without_id(spark, tmp_path):
    p = tmp_path / "x.conllu"
    p.write_text(sentence("1", "go", ("go", "VERB", 0, "root")) + sentence(None, "stop", ("stop", "VERB", 0, "root")))
    with pytest.raises(Exception, match="sentence without sent_id"):
        read_conllu(spark, str(p)).sentences.collect()
    got = build_masked(read_conllu(spark, str(p), strict=False).sentences, VERB, "V").masked.collect()
    assert sorted(r.match_token for r in got) == ["go", "stop"]


def test_comments_end_with_their_line(spark, tmp_path):
    p = tmp_path / "x.conllu"
    p.write_text("# sent_id = u\u2028v\n# text = a\u2028b\u0085 dog\n1\tdog\tdog\tVERB\t_\t_\t0\troot\t_\t_\n\n"
                 "#sent_id=2\n# text =\n1\tgo\tgo\tVERB\t_\t_\t0\troot\t_\t_\n \t\n# sent_id = 3\n1\tgo\tgo\tVERB\t_\t_\t0\troot\t_\t_\n", encoding="utf-8")
    got = {r.sid: (r.text, len(r.tokens)) for r in read_conllu(spark, str(p)).sentences.collect()}
    assert got == {"u\u2028v": ("a\u2028b\u0085 dog", 1), "2": ("", 1), "3": (None, 1)}


def test_line_endings_file_by_file(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "_SUCCESS").write_text("")
    (d / ".hidden").write_text("x")
    one = lambda k, sep: sentence(f"s{k}", "go", ("go", "VERB", 0, "root"), sep=sep)
    (d / "1.conllu").write_bytes((one(1, "\n") + one(2, "\n")).encode())
    (d / "2.conllu").write_bytes((one(3, "\r\n") + one(4, "\r\n")).encode())
    (d / "3.conllu").write_bytes((one(5, "\n") + one(6, "\r\n") + one(7, "\n")).encode())
    s = read_conllu(spark, str(d)).sentences
    assert [r.sid for r in s.orderBy("sent_ord").collect()] == [f"s{k}" for k in range(1, 8)]
    assert s.select("sent_ord").distinct().count() == 7
    assert s.where(F.size("tokens") != 1).count() == 0
    with pytest.raises(FileNotFoundError):
        read_conllu(spark, str(tmp_path / "none*"))


@pytest.mark.parametrize("pattern, target", [
    (Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}}, edges=[("V", "nsubj", "N")]), "V"),
    (Pattern(nodes={"V": {"upos": "VERB"}, "N": {}}, edges=[("V", None, "N")]), "N"),
    (Pattern(nodes={"V": {}, "N": {"upos": "NOUN"}, "D": {}}, edges=[("V", ["nsubj", "obl"], "N"), ("N", "det", "D")]), "D"),
    (Pattern(nodes={"V": {}, "A": {"upos": "NOUN"}, "B": {"upos": "NOUN"}}, edges=[("V", None, "A"), ("V", None, "B")]), "A"),
    (Pattern(nodes={"V": {"upos": "VERB"}}, without=[Pattern(nodes={"V": {"Number": "Plur"}})]), "V"),
    (Pattern(nodes={"V": {"upos": "VERB"}}, without=[Pattern(nodes={"X": {"upos": "NOUN"}}, edges=[("V", "obl", "X")])]), "V"),
    (Pattern(nodes={"N": {"upos": "NOUN"}}, without=[Pattern(edges=[("H", "obl", "N")]), Pattern(nodes={"D": {}, "E": {}}, edges=[("N", "det", "D"), ("N", "det", "E")])]), "N"),
])
def test_in_row_matching_equals_the_joins(tiny, pattern, target):
    rows = lambda df: sorted((r.sentence_id, r.match_id) for r in df.collect())
    for keep in ("all", "last", "first"):
        a, b = match_in_row(tiny.sentences, pattern, target, keep), match(tiny.tokens, pattern, target, keep)
        assert rows(a) == rows(b)
    plan = match_in_row(session.cut_lineage(tiny.sentences), pattern, target)._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_csv_keeps_blanks_quotes_and_breaks(spark, tmp_path):
    rows = [("s 1", "1", " dog", " dogs", ' text "x", y '), ("s2", "2", "", None, "a\nb\tc"), ("s3", "3", "\t", "  ", "back\\slash \u2028 é")]
    df = spark.createDataFrame(rows, "sentence_id string, match_id string, form_grammatical string, form_ungrammatical string, original_text string")
    path = str(tmp_path / "pairs.csv")
    T.save_table(df, path, "csv")
    back = T.load_pairs(spark, path).select("sentence_id", F.col("match_id").cast("string"), "form_grammatical", "form_ungrammatical", "original_text")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_saved_lexicon_keeps_its_order(spark, tmp_path):
    text = "".join(f"# sent_id = s{k}\n# text = {f}\n1\t{f}\tdog\tNOUN\t_\tNumber={n}\t0\troot\t_\t_\n\n"
                   for k, f, n in [(2, "dogz", "Plur"), (10, "dogs", "Plur"), (11, "dog", "Sing")])
    (tmp_path / "x.conllu").write_text(text)
    tb = read_conllu(spark, str(tmp_path / "x.conllu"))
    lex = L.lexicon(tb.tokens)
    masked = build_masked(tb.sentences, Pattern(nodes={"N": {"Number": "Sing"}}), "N").masked
    T.save_lexicon(lex, str(tmp_path / "lex.csv"), "csv")
    T.save_lexicon(lex, str(tmp_path / "lex.parquet"))
    for x in (lex, T.load_lexicon(spark, str(tmp_path / "lex.csv")), T.load_lexicon(spark, str(tmp_path / "lex.parquet"))):
        assert minimal_pairs(masked, x, {"number": "Plur"}, leading_space=False).first().form_ungrammatical == "dogz"


def test_mask_check_names_missing_text(spark):
    df = spark.createDataFrame([("x [MASK]",), ("x",), ("[MASK][MASK]",), (None,)], "masked_text string")
    assert [r.status for r in mask_check(df).collect()] == ["ok", "no_mask", "multiple_masks", "no_text"]


def test_entropy_drops_nan(spark):
    df = spark.createDataFrame([([0.5, float("nan"), 0.5, 0.0],)], "p array<double>")
    assert df.select(M.entropy("p"), M.entropy("p", 1)).first()[:] == (0.69, 0.0)


def test_column_checks(spark):
    df = spark.createDataFrame([("a", 0.5, 0.25, "b"), ("c", 0.25, 0.5, " ")], "form_grammatical string, p_form_grammatical double, p_x double, form_ungrammatical string")
    with pytest.raises(KeyError, match="not scored yet.*form_ungrammatical"):
        M.pair_metrics(df)
    with pytest.raises(KeyError, match="missing column.*lang"):
        M.pair_metrics(df, wrong="x", by=["lang"])
    assert M.pair_metrics(df, wrong="x").first().accuracy == 0.5
    with pytest.raises(KeyError, match="missing column"):
        melt_long(df, ["id"], ["p_x"], ["x"])
    assert melt_long(df, [], ["p_x"], ["x"], pair_col="form_ungrammatical").count() == 1


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 0.99, 1.0, -0.5, float("inf"), float("nan"), None)], "x_label string, surprisal double")
    assert {r.bin: r.n for r in histogram(df).collect()} == {0: 2, 1: 1, -1: 1, None: 3}


def brute_permutation(x, key, m):
    import hashlib
    a = math.isqrt(m - 1) + 1
    b = -(-m // a)
    left, right = divmod(x, b)
    while True:
        for s in range(4):
            h = int(hashlib.md5(f"{key}:{s + 1}:{right if s % 2 == 0 else left}".encode()).hexdigest()[:8], 16)
            left, right = ((left + h) % a, right) if s % 2 == 0 else (left, (right + h) % b)
        if left * b + right < m:
            return left * b + right


@pytest.mark.parametrize("m", [1, 2, 3, 7, 30, 101, 1000, 4810])
def test_permutation_reaches_every_position_once(spark, m):
    df = spark.range(m).crossJoin(spark.createDataFrame([("k1",), ("s:2:7",)], "key string"))
    got = df.select("id", "key", keyed_permutation(F.col("id"), F.col("key"), m).alias("y")).collect()
    for key in ("k1", "s:2:7"):
        assert sorted(r.y for r in got if r.key == key) == list(range(m))
    assert all(r.y == brute_permutation(r.id, r.key, m) for r in got[:300])


def test_rows_that_share_a_pick_share_no_more_than_chance(spark):
    n, k = 400, 3
    mp = spark.createDataFrame([(f"s{i}", 1, f"g{i % n}", f"u{i % n}") for i in range(4000)], "sentence_id string, match_id int, form_grammatical string, form_ungrammatical string")
    picks = {}
    for r in ood_picks(mp, k, seed=5).collect():
        picks.setdefault(r.sentence_id, set()).add(r.ood_form_grammatical)
    by = {}
    for s, p in picks.items():
        for x in p:
            by.setdefault(x, []).append(s)
    pairs = again = 0
    for rows in by.values():
        for i, a in enumerate(rows):
            for b in rows[i + 1:]:
                pairs += 1
                again += len(picks[a] & picks[b]) > 1
    # two further picks of each among about 400: (2 * 2) / 400 of the pairs
    assert pairs > 10_000 and again / pairs < 0.02


def test_scratch_folder_only_in_one_process(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "local-cluster[2,1,1024]"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="name a folder that all executors share"):
        session.ensure_checkpoint_dir(Cluster())


def test_first_published_version_holds(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert scan.published(spark, folder) is None
    for v in ("one", "two"):
        spark.range(3).write.parquet(f"{folder}/{v}")
    assert scan.publish(spark, folder, "one") == scan.publish(spark, folder, "two") == scan.published(spark, folder) == f"{folder}/one"
    assert not scan.exists(spark, f"{folder}/two")
