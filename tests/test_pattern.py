import pytest

from minpairs.operators.pattern import Pattern, match, match_in_row


def ids(df):
    return sorted((r.sentence_id, r.match_id) for r in df.collect())


def test_one_node_in_row_equals_join(tiny):
    p = Pattern(nodes={"V": {"upos": "VERB", "Number": "Sing"}})
    assert ids(match_in_row(tiny.sentences, p, "V")) == ids(match(tiny.tokens, p, "V")) == \
        [("t-2", 3), ("t-4", 6)]


def test_edge_label_is_exact(tiny):
    p = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}}, edges=[("V", "nsubj", "N")])
    # 'nsubj:pass' in t-3 does not match 'nsubj'
    assert ids(match(tiny.tokens, p, "N")) == [("t-1", 2), ("t-2", 2), ("t-4", 1), ("t-4", 5)]
    p2 = Pattern(nodes=p.nodes, edges=[("V", ["nsubj", "nsubj:pass"], "N")])
    assert ("t-3", 1) in ids(match(tiny.tokens, p2, "N"))


def test_keep_modes(tiny):
    p = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}}, edges=[("V", "nsubj", "N")])
    assert ids(match(tiny.tokens, p, "N", keep="last")) == [("t-1", 2), ("t-2", 2), ("t-4", 5)]
    assert ids(match(tiny.tokens, p, "N", keep="first")) == [("t-1", 2), ("t-2", 2), ("t-4", 1)]


def test_chain_and_without(tiny):
    chain = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}, "D": {"upos": "DET"}},
                    edges=[("V", "nsubj", "N"), ("N", "det", "D")])
    assert ids(match(tiny.tokens, chain, "V")) == [("t-1", 3), ("t-2", 3), ("t-4", 6)]
    # subject without a determiner
    wo = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}}, edges=[("V", "nsubj", "N")],
                 without=[Pattern(nodes={"D": {}}, edges=[("N", "det", "D")])])
    assert ids(match(tiny.tokens, wo, "N")) == [("t-4", 1)]
    # without with a constraint on a shared node
    wo2 = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}}, edges=[("V", "nsubj", "N")],
                  without=[Pattern(nodes={"N": {"Number": "Plur"}})])
    assert ids(match(tiny.tokens, wo2, "N")) == [("t-2", 2), ("t-4", 5)]


def test_errors(tiny):
    p = Pattern(nodes={"V": {"upos": "VERB"}, "N": {"upos": "NOUN"}})
    with pytest.raises(ValueError):
        match(tiny.tokens, p, "V")          # disconnected: would pair every V with every N
    with pytest.raises(KeyError):
        match(tiny.tokens, Pattern(nodes={"V": {}}), "X")
