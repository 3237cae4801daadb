"""Golden counts on a real treebank.

Set MINPAIRS_GOLDEN_CONLLU to the 281-sentence sample of the UD
Spanish-GSD treebank used for the published counts; skipped otherwise."""
import os

import pytest

from minpairs.operators import lexicon as L
from minpairs.operators.mask import build_masked
from minpairs.operators.pattern import Pattern, match

PATH = os.environ.get("MINPAIRS_GOLDEN_CONLLU")
pytestmark = pytest.mark.skipif(not PATH or not os.path.exists(PATH), reason="golden treebank not given")


@pytest.fixture(scope="module")
def gold(spark):
    from minpairs.sources.conllu import read_conllu
    return read_conllu(spark, PATH).persist()


def test_lexicon(gold):
    lex = L.lexicon(gold.tokens)
    assert lex.count() == 6690
    assert len(L.wide(lex).columns) - 2 == 25


def test_candidates(gold):
    assert L.candidate_set(L.lexicon(gold.tokens), {"number": "Plur"}).count() == 872


def test_edge_sentences(gold):
    p = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}}, edges=[("V", "nsubj", "N")])
    assert match(gold.tokens, p, "N", keep="last").count() == 105


def test_masked_legacy_and_surface(gold):
    p = Pattern(nodes={"V": {"upos": "VERB", "Number": "Sing"}})
    legacy = build_masked(gold.sentences, p, "V", legacy=True).persist()
    assert legacy.masked.count() == 170
    assert legacy.exceptions.count() == 35
    surface = build_masked(gold.sentences, p, "V").persist()
    assert surface.masked.count() == 205 and surface.exceptions.count() == 0
    a = {(r.sentence_id, r.match_id): r.masked_text for r in legacy.masked.collect()}
    b = {(r.sentence_id, r.match_id): r.masked_text for r in surface.masked.collect()}
    assert all(b[k] == v for k, v in a.items())
