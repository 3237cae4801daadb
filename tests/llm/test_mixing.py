from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from minpairs.llm import mixing

WEIGHTS = {"domain": {"d0": 5, "d1": 2}, "lang": {"en": 6, "de": 2}, "source": {"s0": 3}}
def domain():
    return F.when(F.col("source").isin("s0", "s1"), "d0").when(F.col("source") == "s2", "d1")



def share_out(budget, children):
    """Water filling: (cap, weight) per name -> whole budget per name."""
    left, rate, open_, = budget, 0.0, dict(children)
    full = {}
    while open_:
        rate = left / sum(w for _, w in open_.values())
        now = {k for k, (cap, w) in open_.items() if cap <= rate * w}
        if not now:
            break
        for k in now:
            full[k] = open_.pop(k)[0]
            left -= full[k]
    return {**full, **{k: int(rate * w) for k, (_, w) in open_.items()}}


def brute(rows, share, epochs, seed):
    docs = [(i, {"s0": "d0", "s1": "d0", "s2": "d1"}.get(s, ""), lang or "", s or "", len((t or "").encode().split())) for i, t, lang, s in rows]
    tokens = defaultdict(int)
    for _, d, lang, s, n in docs:
        tokens[d, lang, s] += n
    cap = lambda *p: epochs * sum(n for k, n in tokens.items() if k[:len(p)] == p)
    kids = lambda *p: sorted({k[len(p)] for k in tokens if k[:len(p)] == p})
    weight = lambda level, k: WEIGHTS[level].get(k, 1)
    out = []
    b1 = share_out(int(sum(tokens.values()) * share), {d: (cap(d), weight("domain", d)) for d in kids()})
    for d in kids():
        b2 = share_out(b1[d], {x: (cap(d, x), weight("lang", x)) for x in kids(d)})
        for x in kids(d):
            b3 = share_out(b2[x], {s: (cap(d, x, s), weight("source", s)) for s in kids(d, x)})
            for s in kids(d, x):
                mine, t = [r for r in docs if r[1:4] == (d, x, s) and r[4]], tokens[d, x, s]
                whole, rest = divmod(b3[s], t) if t else (0, 0)
                key = lambda r, e=whole + 1: (md5(f"{seed}:{e}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0])
                before = 0
                for r in sorted(mine, key=key):
                    extra = before < rest and 2 * before + r[4] <= 2 * rest
                    out += [(r[0], d, x, s, r[4], e) for e in range(1, whole + extra + 1)]
                    before += r[4]
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_epoch").collect()], key=str)


ROWS = [(k, " ".join(["w"] * (k * 17 % 41)), ["en", "en", "de", None][k % 4], ["s0", "s0", "s1", "s2", "s3", None][k % 6]) for k in range(240)]


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (1.0, 2), (1.0, 1), (5.0, 3), (0.0, 2)])
def test_matches_water_filling(docs_of, share, epochs):
    got = mixing.mix(docs_of(ROWS, extra=True), weights=WEIGHTS, domain=domain(), share=share, max_epochs=epochs, seed=4)
    assert result(got) == brute(ROWS, share, epochs, 4)


def test_budget_goes_to_siblings_first(docs_of):
    rows = [(k, "w " * 10, "en", "s0") for k in range(2)] + [(10 + k, "w " * 10, "en", "s1") for k in range(50)] + [(100 + k, "w " * 10, "en", "s2") for k in range(50)]
    got = mixing.mix(docs_of(rows), weights=WEIGHTS, domain=domain(), share=0.5, max_epochs=1, seed=1).groupBy("mix_source").agg(F.sum("mix_tokens").alias("n"))
    n = {r["mix_source"]: r["n"] for r in got.collect()}
    # of 510 tokens d0 gets 5/7: s0 gives its 20, its sibling s1 takes the rest of d0's part
    assert n["s0"] == 20 and abs(n["s1"] - (510 * 5 / 7 - 20)) <= 10 and abs(n["s2"] - 510 * 2 / 7) <= 10


def test_repeated_rows_long_texts_columns_and_empty(docs_of):
    rows = [(1, "w " * 50_000, "en", "s0"), (1, "a b", "en", "s0"), (1, "a b", "en", "s0"), (None, "a", "en", "s0"), (2, None, "en", "s0")]
    df = docs_of(rows, extra=True)
    got = mixing.mix(df, weights={}, domain=domain(), share=1.0, max_epochs=1)
    assert got.columns[:len(df.columns)] == df.columns and got.count() == 4
    assert mixing.mix(docs_of([]), weights=WEIGHTS, domain=domain()).collect() == []


def test_weights_are_checked(docs_of):
    with pytest.raises(ValueError, match="weight of lang 'en'"):
        mixing.mix(docs_of(ROWS), weights={"lang": {"en": 0}}, domain=domain())
