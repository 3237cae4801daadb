"""Run summaries and multi-task batches.

A task is one (pattern, target, override) configuration.  All tasks run
over one pass of the sentences; their yields are tagged with the task name
and folded in a single ``groupBy``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..operators.mask import aligned
from ..operators.pairs import LexiconIndex, alternative_forms, lexicon_index, override_feats
from ..operators.pattern import Pattern, target_ids_in_row
from ..sources.treebank import Treebank, with_alignment_columns


@dataclass(frozen=True)
class Task:
    name: str
    pattern: Pattern
    target: str
    morph: dict = field(default_factory=dict)
    leading_space: bool = True
    keep: str = "last"
    legacy: bool = False


def _rows(tb: Treebank, tasks: list[Task], lex: DataFrame, names: list[str], index: LexiconIndex) -> DataFrame:
    """(task_name, _ok, _pair) per target of every task.

    All tasks match inside the sentence row, in one pass: a sentence yields its
    (task, target) structs, which are aligned together.  The alternative's
    features differ per task, so the override is a conditional on the task name;
    one join with the index serves all."""
    sentences = with_alignment_columns(tb.sentences)
    parts = []
    for legacy in sorted({t.legacy for t in tasks}):
        mine = [t for t in tasks if t.legacy == legacy]
        tagged = sentences.withColumn("_tagged", F.concat(*[_tagged(t) for t in mine])).withColumn("_targets", F.array_distinct(F.transform("_tagged", lambda x: x["id"])))
        parts.append(aligned(tagged, legacy=legacy, targets_ready=True, carry=["_tagged"]))
    al = parts[0]
    for x in parts[1:]:
        al = al.unionByName(x)
    per = al.withColumn("_task", F.explode_outer(F.filter("_tagged", lambda x: x["id"] == F.col("match_id")))).where(F.col("_task").isNotNull())
    per = per.withColumn("task_name", F.col("_task.task"))
    feats = F.col("feats")
    for t in tasks:
        feats = F.when(F.col("task_name") == t.name, override_feats(F.col("feats"), t.morph)).otherwise(feats)
    alt = alternative_forms(per.withColumn("feats", feats), lex, {}, names=names, index=index)
    ok = F.col("reason").isNull()
    is_pair = ok & F.col("form_ungrammatical").isNotNull() & (F.col("form_ungrammatical") != F.col("match_token"))
    return alt.select("task_name", ok.alias("_ok"), is_pair.alias("_pair"))


def _tagged(t: Task):
    return F.transform(target_ids_in_row(t.pattern, t.target, t.keep), lambda i: F.struct(F.lit(t.name).alias("task"), i.alias("id")))


def _checked(tb: Treebank, tasks: list[Task], names: list[str] | None) -> tuple[DataFrame, list[str]]:
    if len({t.name for t in tasks}) != len(tasks):
        raise ValueError("task names must be unique")
    lex = L.lexicon(tb.tokens)
    names = names if names is not None else L.collect_feature_names(lex)
    for t in tasks:
        unknown = [k for k in t.morph if k.lower() not in set(names)]
        if unknown:
            raise KeyError(f"task {t.name}: cannot override {unknown}; features are {sorted(names)}")
    return lex, names


def run_summary(tb: Treebank, task: Task, names: list[str] | None = None, index: LexiconIndex | None = None) -> DataFrame:
    """Targets (= masked + exceptions), masked, exceptions and pairs of one task, in one pass."""
    lex, names = _checked(tb, [task], names)
    rows = _rows(tb, [task], lex, names, index or lexicon_index(lex, names=names).stored())
    return rows.agg(F.count(F.lit(1)).alias("targets"), F.count(F.when(F.col("_ok"), 1)).alias("masked"),
                    F.count(F.when(~F.col("_ok"), 1)).alias("exceptions"),
                    F.count(F.when(F.col("_pair"), 1)).alias("pairs"))


def task_batch(tb: Treebank, tasks: list[Task], names: list[str] | None = None, index: LexiconIndex | None = None) -> DataFrame:
    """One row per task: structures masked, exceptions, pairs found.

    One pass over the sentences and one index join for the whole batch."""
    lex, names = _checked(tb, tasks, names)
    rows = _rows(tb, tasks, lex, names, index or lexicon_index(lex, names=names).stored())
    return rows.groupBy("task_name").agg(
        F.count(F.when(F.col("_ok"), 1)).alias("structures_masked"),
        F.count(F.when(~F.col("_ok"), 1)).alias("exceptions"),
        F.count(F.when(F.col("_pair"), 1)).alias("minimal_pairs_found"))
