"""Mixing sources to target weights: hierarchical budgets and seeded epochs.

The tree is domain -> language -> source. A token budget is passed down from the
root: among the children of a node it is shared by weight, but no child gets more
than its subtree can give (its tokens times the allowed epochs). What a child cannot
take is shared by its siblings; only when a whole family is short does the budget go
to the family's own siblings, as its capacity limits what it gets one level up.

A leaf with budget ``b`` and ``t`` tokens gives ``b // t`` whole epochs and a
prefix of one more epoch in that epoch's seeded order. Prefix sums run over hash ranges
first, about as many as the root of the largest leaf's rows; rows are ordered only
inside the one range that the cut falls into. A leaf of n rows thus puts about
sqrt(n) ranges and sqrt(n) rows into a task, and one that holds most rows is no bottleneck.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, bounded, fresh, stage

LEVELS = ["domain", "lang", "source"]
MAX_RANGE_CHARS = 8  # hex digits of the order key that name a range, at most


def word_tokens(text: Column) -> Column:
    """Tokens of a text, counted as words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _weight(level: str, weights: dict[str, int]) -> Column:
    given = F.lit(1)
    for name, w in weights.items():
        if w != int(w) or w < 1:
            raise ValueError(f"weight of {level} {name!r} is {w!r}: whole numbers of 1 or more are asked for")
        given = F.when(F.col(level) == name, F.lit(w)).otherwise(given)
    return given.cast("double")


def _share(nodes: DataFrame, family: list[str], level: str) -> DataFrame:
    """Give each node of ``level`` its part ``budget`` of its parent's ``parent`` budget.

    Children stand in order of capacity per weight; ``rate`` is what a unit of weight
    gets if all children before are full and the rest share what they leave."""
    order = Window.partitionBy(*family).orderBy(F.col("cap") / F.col("weight"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*family)
    rate = (F.col("parent") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the rate rises while children are full and falls after that: its peak is the rate of those that are not
    nodes = nodes.withColumn("rate", rate).withColumn("rate", F.max("rate").over(every))
    part = F.floor(F.col("rate") * F.col("weight"))
    return nodes.withColumn("budget", F.greatest(F.lit(0), F.least("cap", part)).cast("long")).drop("rate")


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def plan(rows: DataFrame, *, weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: ``domain, lang, source, tokens, budget, epochs, cut_key, cut_id``.

    ``rows`` has ``doc_id, domain, lang, source, n_tokens``. The budget of the root is
    ``share`` of all tokens. ``epochs`` are whole; of epoch ``epochs + 1`` a leaf gives
    the rows up to ``(cut_key, cut_id)`` in that epoch's order."""
    leaves = stage(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")), "leaves")
    total, most = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("n_rows"), F.lit(0))).first()
    range_chars = min(MAX_RANGE_CHARS, max(1, math.ceil(math.log(max(2, most), 256))))  # 16 ** chars is the root or up to 16 times it
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    parent = None
    for depth, level in enumerate(LEVELS):
        at = LEVELS[:depth + 1]
        nodes = leaves.groupBy(*at).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights.get(level, {})))
        nodes = nodes.withColumn("parent", F.lit(int(total * share))) if parent is None else nodes.join(parent, at[:-1])
        nodes = _share(nodes, at[:-1], level).select(*at, "budget")
        parent = nodes.withColumnRenamed("budget", "parent")
    leaves = leaves.join(nodes, LEVELS).where("tokens > 0").withColumn("epochs", F.expr("budget div tokens"))
    leaves = stage(leaves.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
                   .select(*LEVELS, "tokens", "budget", "epochs", "rest"), "budgets")

    keyed = (rows.where("n_tokens > 0").join(bounded(leaves.select(*LEVELS, "epochs", "rest")), LEVELS).where("rest > 0")
             .withColumn("key", _order_key(seed, F.col("epochs") + 1, F.col("doc_id")))
             .withColumn("range", F.substring("key", 1, range_chars)))
    ranges = keyed.groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    edge = stage(ranges.withColumn("end", running).where((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("n") < F.col("rest")))
                 .select(*LEVELS, "range", (F.col("end") - F.col("n")).alias("begin")), "edge")
    inside = keyed.join(bounded(edge), [*LEVELS, "range"])
    before = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("key", "doc_id", "n_tokens")
                                    .rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") + F.col("begin")
    # a row is taken if at least half of it lies within the budget
    taken = inside.withColumn("before", before).where("before < rest and 2 * before + n_tokens <= 2 * rest")
    cuts = taken.groupBy(*LEVELS).agg(F.max(F.struct("key", "doc_id")).alias("cut"))
    out = leaves.join(edge.select(*LEVELS, "range"), LEVELS, "left").join(cuts, LEVELS, "left")
    return stage(out.select(*LEVELS, "tokens", "budget", "epochs", F.coalesce("cut.key", "range", F.lit("")).alias("cut_key"),
                            F.col("cut.doc_id").alias("cut_id")), "mix_plan")


def mix(docs: DataFrame, *, weights: dict[str, dict[str, int]], domain: Column, share: float = 1.0, max_epochs: int = 1,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that make up the mix, once per epoch they occur in, with
    ``mix_domain, mix_lang, mix_source, mix_tokens, mix_epoch`` added.

    ``weights``: whole-numbered weights per level and name, 1 where none is given.

    * null domain, language or source: a node named ``''``;
    * rows without words: have no tokens and are never taken;
    * repeated rows stand next to each other in an epoch's order and count singly
      (a cut between equal ids takes all of them);
    * very long texts are counted whole; a text is taken or left whole;
    * empty table: empty result; extra columns stay as they are, but columns that
      are already called ``mix_...`` are replaced."""
    names = {"domain": "mix_domain", "lang": "mix_lang", "source": "mix_source"}
    docs = docs.drop(*names.values(), "mix_tokens", "mix_epoch")
    epochs, cut_key, cut_id, n_copies = (fresh(docs, n) for n in ("_epochs", "_cut_key", "_cut_id", "_copies"))
    rows = docs.select("*", F.coalesce(domain, F.lit("")).alias(names["domain"]), F.coalesce(F.col(lang_col), F.lit("")).alias(names["lang"]),
                       F.coalesce(F.col(source_col), F.lit("")).alias(names["source"]), word_tokens(F.col(text_col)).alias("mix_tokens"))
    narrow = stage(rows.select(F.col(id_col).alias("doc_id"), *(F.col(v).alias(k) for k, v in names.items()),
                               F.col("mix_tokens").alias("n_tokens")), "mix_rows")
    leaves = plan(narrow, weights=weights, share=share, max_epochs=max_epochs, seed=seed)
    side = leaves.select(*(F.col(k).alias(v) for k, v in names.items()), F.col("epochs").alias(epochs),
                         F.col("cut_key").alias(cut_key), F.col("cut_id").alias(cut_id))
    key = _order_key(seed, F.col(epochs) + 1, F.col(id_col))
    extra = (key < F.col(cut_key)) | ((key == F.col(cut_key)) & F.coalesce(F.col(id_col) <= F.col(cut_id), F.lit(True)))
    copies = F.col(epochs) + F.when(extra, 1).otherwise(0)
    return (rows.where("mix_tokens > 0").join(bounded(side), list(names.values())).withColumn(n_copies, copies).where(F.col(n_copies) > 0)
            .withColumn("mix_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n_copies))))
            .select(*docs.columns, *names.values(), "mix_tokens", "mix_epoch"))
