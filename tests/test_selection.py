"""Exact quantiles by narrowing histograms, subtotals, and batches for scorers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from minpairs.functions import metrics as M
from minpairs.operators import score as S
from minpairs.operators.reshape import QUARTILES, distribution, exact_quantiles, select_ranks


def quantile(values, p):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    at = (len(v) - 1) * p
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo if lo == hi or math.isnan(lo) and math.isnan(hi) else lo + (at - math.floor(at)) * (hi - lo)


GROUPS = {
    "uniform": [random.Random(1).random() * 40 for _ in range(3000)],
    "half equal": [7.25] * 2000 + [random.Random(2).gauss(7, 3) for _ in range(2001)],
    "all equal": [3.0] * 500,
    "ratios": [2.0 ** -k for k in range(0, 1000)] + [-(3.0 ** k) for k in range(200)],
    "tiny steps": [1.0 + k * 2.0 ** -52 for k in range(900)],
    "far": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1e300] * 11,
    "one": [4.5],
    "infinite": [float("inf")] * 40 + [1.0, 2.0, 3.0] * 10 + [float("-inf")] * 3,
    "not numbers": [float("nan")] * 9 + [1.0] * 4,
    "zeros": [0.0, -0.0] * 50,
    None: [1.0, 2.0, 10.0],
}


def test_quantiles_of_awkward_groups(spark):
    rows = [(g, v) for g, vs in GROUPS.items() for v in vs] + [("uniform", None), ("only null", None)]
    df = spark.createDataFrame(rows, "x_label string, surprisal double").repartition(6)
    got = {r.x_label: r for r in exact_quantiles(df, "surprisal", "x_label", QUARTILES | {"least": 0.0, "most": 1.0, "p99": 0.99}).collect()}
    assert set(got) == set(GROUPS)
    for g, vs in GROUPS.items():
        for name, p in {**QUARTILES, "least": 0.0, "most": 1.0, "p99": 0.99}.items():
            want, found = quantile(vs, p), got[g][name]
            assert found == want or math.isnan(found) and math.isnan(want), (g, name, found, want)


def test_no_sort_and_few_steps(spark):
    df = spark.range(60_000).select(F.lit("a").alias("x_label"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.rand(3) * 10).alias("surprisal"))
    r = distribution(df, exact=True).first()
    assert r.n == 60_000 and r.median == 5.0
    plan = distribution(df, exact=True)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_ranks(spark):
    values = sorted(random.Random(4).choices(range(50), k=5000))
    v = spark.createDataFrame([(1, float(x)) for x in values], "_g int, _v double")
    want = spark.createDataFrame([(1, r) for r in range(0, 5000, 97)], "_g int, _r long")
    assert {r._r: r._val for r in select_ranks(v, want).collect()} == {r: float(values[r]) for r in range(0, 5000, 97)}


def test_subtotals_are_told_from_unknown_groups(spark):
    rows = [("en", "a", 0.5, 0.25, 0.2), ("en", None, 0.5, 0.5, 0.4), (None, "a", 0.1, 0.2, 0.6), (None, None, 0.4, 0.2, 0.8)]
    df = spark.createDataFrame(rows, "lang string, source string, p_form_grammatical double, p_form_ungrammatical double, certainty double")
    got = {(r.lang, r.source, r.level): r for r in M.pair_metrics(df, by=["lang", "source"], subtotals="rollup").collect()}
    assert set(got) == {("en", "a", 0), ("en", None, 0), (None, "a", 0), (None, None, 0), ("en", None, 1), (None, None, 1), (None, None, 3)}
    assert got[None, None, 0].n == 1 and got[None, None, 1].n == 2 and got[None, None, 3].n == 4
    assert got[None, None, 3].avg_certainty == 0.5 and got["en", None, 1].accuracy == 0.5
    cube = M.pair_metrics(df, by=["lang", "source"], subtotals="cube")
    assert cube.where("level = 2").count() == 2
    probs = df.withColumn("probs", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)))
    r = M.pair_metrics(probs, probs="probs", k=2).first()
    assert r.avg_entropy == 0.64 and r.avg_certainty == pytest.approx(0.42)
    with pytest.raises(ValueError):
        M.pair_metrics(df, by=["lang"], subtotals="sets")


def test_batches_by_length():
    r = random.Random(7)
    for _ in range(200):
        lengths, budget = [r.randint(0, 60) for _ in range(r.randint(0, 80))], r.randint(1, 200)
        got = S.batches_by_length(lengths, budget)
        assert sorted(i for b in got for i in b) == list(range(len(lengths)))
        assert all(max(lengths[i] for i in b) * len(b) <= budget or len(b) == 1 for b in got)


def test_scorer_gets_arrays_within_the_budget(spark):
    def factory():
        class Checks:
            def score_batch(self, texts, targets, entropy_topk=None):
                assert isinstance(texts, np.ndarray) and isinstance(targets, np.ndarray) and targets.shape == (len(texts), 2)
                longest = max(len(t.split()) + 2 for t in texts)
                assert longest * len(texts) <= 64 or len(texts) == 1
                assert [len(t.split()) for t in texts] == sorted(len(t.split()) for t in texts)
                return np.array([[len(w or "") for w in ws] for ws in targets]), [1 / longest] * len(texts)
        return Checks()

    rows = [(f"s{k}", k, "word " * (k * 7 % 90), " a" * (k % 5), "b") for k in range(400)] + [("s0", 0, None, None, "b")]
    df = spark.createDataFrame(rows, "sentence_id string, match_id int, masked_text string, form_grammatical string, form_ungrammatical string")
    df = df.withColumn("nested", F.struct(F.array("match_id").alias("x")))
    got = S.evaluate(df, factory, "mlm", token_budget=64).collect()
    assert len(got) == 401 and all(r.p_form_grammatical == len(r.form_grammatical or "") and r.p_form_ungrammatical == 1.0 for r in got)
    assert all(r.nested.x[0] == r.match_id for r in got)
