import pytest
from pyspark.sql import functions as F

from minpairs.operators.mask import align_offset, build_masked, mask_check, token_surgery
from minpairs.operators.pattern import Pattern


@pytest.mark.parametrize("text, forms, k, expected", [
    ("the cat saw the dog", ["the", "cat", "saw", "the", "dog"], 3, 12),   # repeated word
    ("the cat saw the dog", ["the", "_", "cat", "saw", "the", "dog"], 4, 12),  # skippable token
    ("a b", ["a", "x", "b"], 2, None),                                      # missing token fails
    ("don't go", ["do", "n't", "go"], 2, 6),                                # no space between tokens
])
def test_align_offset(spark, text, forms, k, expected):
    df = spark.createDataFrame([(text, forms[:k], forms[k])], "t string, b array<string>, f string")
    got = df.select(align_offset(F.col("t"), F.col("b"), F.col("f")).alias("o")).first().o
    assert got == expected
    if expected is not None:
        assert text.find(forms[k], expected) == expected


@pytest.mark.parametrize("text, form, at, expected", [
    ("one two three", "two", 4, "one [MASK] three"),
    ("one two three", "one", 0, "[MASK] two three"),
    ("one two three", "three", 8, "one two [MASK]"),
])
def test_surgery(spark, text, form, at, expected):
    df = spark.createDataFrame([(text, form, at)], "t string, f string, a int")
    assert df.select(token_surgery(F.col("t"), F.col("a"), F.col("f"), F.lit("[MASK]"))).first()[0] == expected


def test_masked_and_exceptions(tiny):
    p = Pattern(nodes={"N": {"upos": ["NOUN", "DET", "ADP"]}})
    r = build_masked(tiny.sentences, p, "N", keep="all").persist()
    masked = {(x.sentence_id, x.match_id): x for x in r.masked.collect()}
    exc = {(x.sentence_id, x.match_id): x.reason for x in r.exceptions.collect()}
    assert masked[("t-1", 6)].masked_text == "The dogs bark at the [MASK]."
    # words inside the range 'del' cannot be masked alone
    assert exc == {("t-2", 4): "inside_range", ("t-2", 5): "inside_range"}
    assert masked[("t-2", 6)].masked_text == "A dog barks del [MASK]."
    # invariant: putting the word back restores the sentence
    for x in masked.values():
        assert x.masked_text.replace("[MASK]", x.match_token, 1) == x.original_text


def test_legacy_alignment_fails_after_range(tiny):
    p = Pattern(nodes={"N": {"upos": "NOUN"}})
    r = build_masked(tiny.sentences, p, "N", keep="all", legacy=True).persist()
    exc = {(x.sentence_id, x.match_id) for x in r.exceptions.collect()}
    assert ("t-2", 6) in exc          # 'de' is searched after 'del' and not found
    assert ("t-2", 2) not in exc


def test_prompt_and_mask_check(tiny):
    p = Pattern(nodes={"V": {"upos": "VERB"}})
    r = build_masked(tiny.sentences, p, "V", keep="last")
    prompts = {x.sentence_id: x.prompt_text for x in r.prompts.collect()}
    assert prompts["t-1"] == "The dogs"
    assert prompts["t-4"] == "Cats sleep while the dog"
    chk = mask_check(r.masked).select("status").distinct().collect()
    assert [c.status for c in chk] == ["ok"]
