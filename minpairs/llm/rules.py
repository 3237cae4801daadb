"""Learned decision lists over text statistics (DataFrame functions only).

Statistics of every text are computed inside its row. Labelled rows then teach an
ordered list of reject rules by sequential covering: a rule grows condition by
condition (threshold on one statistic, largest information gain on the growing
rows), is pruned to the prefix that does best on the pruning rows, and the rows it
covers are set aside. Thresholds are quantiles of the rows that the rule still covers,
and of the bad ones among them, taken anew for each condition. Each step is two
aggregations of all labelled rows, into quantiles and into counts per statistic,
threshold and class. A rule that fails on the pruning rows gives way to one with
another first condition. The list becomes one conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stage

SYMBOLS = r"[#*$%&|<>]"  # fixed value
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
THRESHOLDS, MAX_RULES, MAX_CONDITIONS = 32, 12, 4

RATIOS = {  # statistics that rules may use
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "echo_share": "n_echo / n_words",
    "line_words": "n_words / n_lines",
    "words": "n_words",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight words which occurs twice or more."""
    def spots(t: Column) -> Column:  # (hash, position) in order: equal neighbours are repeats
        at = F.sequence(F.lit(0), F.size(t) - 1)
        same = lambda i, j: F.coalesce(F.get(t, i)["h"] == F.get(t, j)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(at, lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(t, i)["p"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: F.least(F.lit(WINDOW), x - F.get(p, i)))
        return F.lit(WINDOW) + F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        sort = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(sort, lambda t: _let(spots(t), covered)))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(hashes(words), count))


def text_stats(text: Column) -> Column:
    """Struct of whole-text statistics; null counts as a text without words."""
    def of(s: Column) -> Column:
        def of_words(w: Column) -> Column:
            lines = F.filter(F.split(s, "\n", -1), lambda x: x.rlike(WORD))
            return F.struct(
                F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(s, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_echo"))
        return _let(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), of_words)
    return _let(F.coalesce(text, F.lit("")), of)


def stats_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts and the ratios rules may use (0 where there are no words)."""
    x = docs.select(F.col(id_col).alias("doc_id"), text_stats(F.col(text_col)).alias("s"))
    x = x.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", F.col("s.lines.dup").alias("n_dup_lines"), "s.n_repeat_words",
                 F.col("s.lines.n").alias("n_lines"), "s.n_distinct", "s.n_echo")
    x = stage(x, "text_stats")
    return x.withColumns({k: F.coalesce(F.expr(v.replace(" / ", " / nullif(") + (", 0)" if "/" in v else "")).cast("double"), F.lit(0.0)) for k, v in RATIOS.items()})


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool  # stat > threshold, else stat <= threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.stat)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.threshold:.6g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _bin(stat: str, thresholds: list[float]) -> Column:
    """Number of thresholds below the value."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t < F.col(stat)))


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each statistic over all rows and over the bad ones; a cut may lie at or just below a bad row's value."""
    def quantiles(x: Column) -> Column:
        return F.percentile_approx(x, [i / THRESHOLDS for i in range(THRESHOLDS)], 10000)

    grid = rows.agg(*[quantiles(F.col(s)).alias(s) for s in RATIOS],
                    *[quantiles(F.when(F.col("bad") == 1, F.col(s))).alias(f"bad_{s}") for s in RATIOS]).first()
    out = {}
    for s in RATIOS:
        bad = {float(t) for t in grid[f"bad_{s}"] or ()}
        out[s] = sorted({float(t) for t in grid[s] or ()} | bad | {math.nextafter(t, -math.inf) for t in bad})
    return out


def _choices(rows: DataFrame) -> list[Condition]:
    """Per statistic and direction the condition of the largest gain, best first; none if the rows are of one class."""
    thresholds = _thresholds(rows)
    bins = F.array(*[_bin(s, t) if t else F.lit(0) for s, t in thresholds.items()])
    counts = (rows.select("bad", F.posexplode(bins).alias("stat", "bin")).groupBy("stat", "bin")
              .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())  # statistics x thresholds: bounded
    per = {s: {} for s in range(len(thresholds))}
    for r in counts:
        per[r["stat"]][r["bin"]] = (r["p"], r["n"])
    total = [sum(v[i] for v in per[0].values()) for i in (0, 1)]
    if not total[0] or not total[1]:
        return []
    base = math.log2(total[0] / sum(total))
    best: dict[tuple[str, bool], tuple[float, Condition]] = {}
    for s, name in enumerate(thresholds):
        low_p = low_n = 0
        for k, threshold in enumerate(thresholds[name]):  # bin <= k: at or below threshold k
            p, n = per[s].get(k, (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for above, p, n in ((False, low_p, low_n), (True, total[0] - low_p, total[1] - low_n)):
                if p and (gain := p * (math.log2(p / (p + n)) - base)) > best.get((name, above), (1e-9,))[0]:
                    best[name, above] = gain, Condition(name, above, threshold)
    return [c for _, c in sorted(best.values(), key=lambda x: -x[0])]


def _grow(rows: DataFrame, first: Condition) -> list[Condition]:
    """Add the condition of the largest gain until no good row is covered."""
    rule = [first]
    while len(rule) < MAX_CONDITIONS and (found := _choices(rows.where(_all(rule)))):
        rule.append(found[0])
    return rule


def learn(rows: DataFrame) -> list[list[Condition]]:
    """Ordered reject rules from ``rows``: the ratios, ``bad`` (1 or 0) and ``pruning`` (a third of the rows)."""
    rows = stage(rows.select(*RATIOS, "bad", "pruning"), "labelled")
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        left = rows.where(~_any(rules))
        growing, pruning = left.where("not pruning"), left.where("pruning")
        for first in _choices(growing):  # the next best first condition if a rule fails
            rule = _grow(growing, first)
            prefixes = [rule[:k + 1] for k in range(len(rule))]
            held = pruning.agg(*[F.coalesce(F.sum(F.when(_all(p), x)), F.lit(0)).alias(f"{c}{k}") for k, p in enumerate(prefixes)
                                 for c, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
            value, k = max(((held[f"p{k}"] - held[f"n{k}"]) / max(1, held[f"p{k}"] + held[f"n{k}"]), -k) for k in range(len(prefixes)))
            if value > 0:
                rules.append(prefixes[-k])
                break
        else:
            break
    return rules


def _any(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: the first rule that applies decides, none keeps."""
    out = None
    for rule in rules:
        out = F.when(_all(rule), True) if out is None else out.when(_all(rule), True)
    return F.lit(False) if out is None else out.otherwise(False)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality") -> DataFrame:
    """One row per input row: ``doc_id``, the counts, ``base_failed`` and ``kept``.

    * null or empty text: no words, all counts 0, fails the base rule;
    * null ids: no label, scored like others; repeated rows: each its own row;
      repeated labels of an id: a row is bad if any label is 0;
    * no labels, or of one class only: no rules, the base rule alone decides;
    * very long texts are read whole, inside their row; empty table: empty result;
      extra columns of any name are ignored."""
    stats = stats_table(docs, id_col, text_col)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("_q")).dropna().groupBy("doc_id").agg(
        F.max(F.when(F.col("_q") == 0, 1).otherwise(0)).alias("bad"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stats.where(~base_failed).join(marks, "doc_id").withColumn("pruning", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    rules = learn(rows)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                        (~base_failed & ~_any(rules)).alias("kept"))
