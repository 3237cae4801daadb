import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from minpairs.llm import rules

from .conftest import words


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeat = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, n < 20 or 100 * repeat > 30 * n


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def good(k):
    return " ".join(words(60 + k % 40, seed=k, size=100_000))


def junk(k):
    r = random.Random(k)
    return " ".join(w + r.choice(["###", "%%%", "***"]) for w in words(50, seed=k, size=100_000))


def test_counts_match_brute_force(docs_of, labels_of, odd_rows):
    texts = ["a b c d e f g h " * 5, "a b c d e f g h i", "x " * 40, "p q\np q\n\np q \n", " ".join(words(25, 1)) + " " + " ".join(words(25, 1)), "a\x0bb\x1cc\x85d e",
             "l1\r\nl1\r\nl1\n" + "m " * 8, "É|<é>&", " ".join(words(4000, 2, 40))]
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(texts)]
    got = rules.quality_rules(docs_of(rows, extra=True), labels_of([]))
    assert sorted([tuple(r) for r in got.select("doc_id", *COUNTS).collect()], key=str) == sorted([(i, *brute(t)) for i, t, *_ in rows], key=str)
    assert got.where("kept = base_failed").count() == 0  # without labels the base rule alone decides


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(docs_of, labels_of, seed):
    r = random.Random(seed)
    rows = [(k, "".join(r.choice(["a", "b", " ", " ", "\n", "|", "\t"]) for _ in range(r.randint(0, 120)))) for k in range(80)]
    got = rules.quality_rules(docs_of(rows), labels_of([]))
    assert sorted(tuple(r) for r in got.select("doc_id", *COUNTS).collect()) == sorted((i, *brute(t)) for i, t in rows)


def test_learned_list_separates(docs_of, labels_of):
    rows = [(k, junk(k) if k % 4 == 0 else good(k)) for k in range(240)]
    labels = labels_of([(k, int(k % 4 != 0)) for k in range(160)] + [(3, 1), (4, None), (None, 0), (9999, 0)])
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(docs_of(rows, extra=True), labels).collect()}
    assert not any(got[k] for k in range(0, 240, 4))  # all junk goes
    assert sum(got.values()) >= 0.97 * 180


def test_one_class_and_empty(docs_of, labels_of):
    rows = [(k, good(k)) for k in range(30)]
    assert all(r["kept"] for r in rules.quality_rules(docs_of(rows), labels_of([(k, 1) for k in range(30)])).collect())
    assert rules.quality_rules(docs_of([]), labels_of([(1, 0)])).collect() == []


def test_rules_are_pruned_conjunctions(spark):
    rows = spark.range(900).select(*[F.lit(0.0).alias(s) for s in rules.RATIOS if s not in ("words", "echo_share")],
                                   (F.col("id") % 30).cast("double").alias("words"), (F.col("id") % 7).cast("double").alias("echo_share"),
                                   ((F.col("id") % 30 > 20) & (F.col("id") % 7 < 3)).cast("int").alias("bad"), (F.col("id") % 11 < 3).alias("pruning"))
    found = rules.learn(rows)
    assert 1 <= len(found) <= rules.MAX_RULES and all(len(r) <= rules.MAX_CONDITIONS for r in found)
    wrong = rows.where((F.col("bad") == 1) != rules._any(found)).count()
    assert wrong == 0, [list(map(str, r)) for r in found]


def test_no_python_in_the_plan(docs_of, labels_of):
    plan = rules.quality_rules(docs_of([(1, good(1))]), labels_of([(1, 1)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def rare(spark, percent):
    """60000 rows, a share of them bad: those with ``words`` above every good row's; good rows are spread evenly."""
    at = (F.col("id") * 7919) % 60000
    bad = at >= 60000 * (100 - percent) / 100
    return spark.range(60000).select(*[((F.col("id") * (31 + 2 * k)) % 997).cast("double").alias(s) for k, s in enumerate(rules.RATIOS) if s != "words"],
                                     at.cast("double").alias("words"), bad.cast("int").alias("bad"), (F.xxhash64("id") % 3 == 0).alias("pruning"))


@pytest.mark.parametrize("percent", [0.5, 1, 2])
def test_rare_junk_is_cut_off_alone(spark, percent):
    rows = rare(spark, percent)
    found = rules.learn(rows)
    got = rows.agg(F.sum("bad"), F.sum(F.when(rules._any(found), F.col("bad"))), F.sum(F.when(rules._any(found), 1 - F.col("bad")))).first()
    assert got[1] >= 0.97 * got[0] and got[2] <= 0.03 * got[0], [list(map(str, r)) for r in found]
