"""Locate the target word in the raw sentence and mask it.

Everything here runs inside the sentence row with higher-order functions:
the token array and the text are already in the same row, so once the
targets are attached to their sentence (one join on the sentence id, or
none for one-node patterns) no further shuffle happens.

Alignment (D1) walks the tokens left to right with ``locate`` from a
running offset, exactly like the reference's recursive ``find``: a token
that is not found is skipped if it is ``_`` or a space, anything else
fails the sentence.  Two token sequences are offered:

* surface-aware (default, D8): range rows plus the words they do not
  cover -- the pieces that really occur in the text.  A target covered by
  a range cannot be masked alone and is reported as ``inside_range``.
* legacy: every token line in file order (range rows *and* their parts),
  as the reference does; sentences with ranges then mostly fail.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_MASK, PROMPT_CUTOFF, SKIPPABLE_TOKENS, count_occurrences, py_strip
from ..sources.treebank import ALIGN_COLUMNS, TOKEN_TYPE, Treebank, with_alignment_columns
from .pattern import Pattern, match, target_ids_in_row

MASKED_COLUMNS = ["sentence_id", "match_id", "match_token", "original_text", "masked_text"]
PROMPT_COLUMNS = ["sentence_id", "match_id", "match_token", "original_text", "prompt_text"]
# what later steps need of a target and its neighbours, taken while its sentence row is in hand
CONTEXT_COLUMNS = ["sent_ord", "lemma", "upos", "feats", "prev_word", "next_word", "prev2_word", "next2_word"]
EXCEPTION_COLUMNS = ["sentence_id", "match_id", "all_tokens", "match_token", "original_text", "reason"]


def _locate(sub: Column, text: Column, start1: Column) -> Column:
    return F.call_function("locate", sub, text, start1)


def align_walk(text: Column, forms_before: Column) -> Column:
    """D1, walk part: ``struct(off, ok)`` after searching every token
    before the target (``off`` is the 0-based end of the last match)."""
    init = F.struct(F.lit(0).alias("off"), F.lit(True).alias("ok"))

    def step(acc, f):
        p = _locate(f, text, acc["off"] + 1)
        return (
            F.when(~acc["ok"], acc)
            .when(p > 0, F.struct((p - 1 + F.length(f)).alias("off"), F.lit(True).alias("ok")))
            .when(f.isin(SKIPPABLE_TOKENS), acc)
            .otherwise(F.struct(acc["off"].alias("off"), F.lit(False).alias("ok")))
        )

    return F.aggregate(forms_before, init, step)


def align_offset(text: Column, forms_before: Column, target_form: Column) -> Column:
    """0-based character offset of the target, or NULL when the walk
    fails (a non-skippable token or the target is missing)."""
    walked = align_walk(text, forms_before)
    at = _locate(target_form, text, walked["off"] + 1)
    return F.when(walked["ok"] & (at > 0), at - 1)


def token_surgery(text: Column, offset0: Column, form: Column, replacement: Column) -> Column:
    """Replace ``len(form)`` characters at ``offset0`` (0-based)."""
    return F.overlay(text, replacement, offset0 + 1, F.length(form))


def _attach(sentences: DataFrame, matches: DataFrame) -> DataFrame:
    """Given targets grouped per sentence, then one equi join on the sentence
    key (on the id where the matches carry no ``sent_ord``; ids must then be unique)."""
    ours, theirs = ("sent_ord", "sent_ord") if "sent_ord" in matches.columns else ("sid", "sentence_id")
    per_sent = matches.groupBy(F.col(theirs).alias("_key")).agg(
        F.array_sort(F.collect_set("match_id")).alias("_targets"))
    return sentences.join(per_sent, F.col(ours) == F.col("_key"), "inner").drop("_key")


def _with_targets(sentences: DataFrame, pattern: Pattern | None, target: str | None,
                  matches: DataFrame | None, keep: str, tokens: DataFrame | None = None) -> DataFrame:
    if matches is not None:
        return _attach(sentences, matches)
    if "tokens" in sentences.columns:
        return sentences.select("*", target_ids_in_row(pattern, target, keep).alias("_targets"))
    return _attach(sentences, match(tokens, pattern, target, keep))


def pinned(df: DataFrame, **exprs: Column) -> DataFrame:
    """Evaluate ``exprs`` once per row as generator outputs.

    Catalyst substitutes projected aliases into filters pushed below them
    and into every lambda that references them; for array-walking
    expressions that multiplies the work per row.  Attributes produced by
    a Generate are opaque to those rewrites, so each value is computed
    exactly once.  (``inline_outer`` avoids the inferred size() filter.)"""
    return df.select("*", F.inline_outer(F.array(F.struct(*[v.alias(k) for k, v in exprs.items()]))))


def aligned(sentences: DataFrame, pattern: Pattern | None = None, target: str | None = None,
            matches: DataFrame | None = None, keep: str = "last", legacy: bool = False,
            tokens: DataFrame | None = None, targets_ready: bool = False, carry: list[str] | None = None,
            word: Callable | None = None) -> DataFrame:
    """Targets with their alignment: one row per (sentence, target) with
    ``offset`` (0-based, NULL on failure) and ``reason``.

    Works on the parallel alignment arrays of the sentence row
    (``sources.treebank.ALIGN_COLUMNS``): locating the target is
    ``array_position`` and the tokens before it a ``slice``; only the
    left-to-right search itself is a lambda."""
    carry = list(carry or [])
    s = with_alignment_columns(sentences)
    if not targets_ready:  # else ``_targets`` holds the ids already
        s = _with_targets(s, pattern, target, matches, keep, tokens)
    # explode_outer + NULL filter: the plain generator would make Catalyst
    # re-evaluate the target array in an inferred size() > 0 filter
    if word is not None or "tokens" in s.columns:
        token = word or (lambda i: F.get(F.filter("tokens", lambda t: t["tid"] == i), 0))
        targets = F.transform("_targets", lambda i: F.struct(i.alias("match_id"), token(i).alias("t")))
    else:
        targets = F.transform("_targets", lambda i: F.struct(i.alias("match_id"), F.lit(None).cast(TOKEN_TYPE).alias("t")))
    s = s.select("sid", "sent_ord", "text", *carry, *ALIGN_COLUMNS, F.explode_outer(targets).alias("_target")) \
        .where(F.col("_target").isNotNull())
    s = s.select("sid", "sent_ord", "text", *carry, *ALIGN_COLUMNS, "_target.match_id", F.col("_target.t.lemma").alias("lemma"),
                 F.col("_target.t.upos").alias("upos"), F.col("_target.t.feats").alias("feats"),
                 F.get("words", F.col("_target.match_id") - 2).alias("prev_word"),
                 F.get("words", F.col("_target.match_id")).alias("next_word"),
                 F.get("words", F.col("_target.match_id") - 3).alias("prev2_word"),
                 F.get("words", F.col("_target.match_id") + 1).alias("next2_word"))
    forms, tids = ("forms_all", "tids_all") if legacy else ("forms_surface", "tids_surface")
    k = F.array_position(tids, F.col("match_id")).cast("int")
    k_all = F.array_position("tids_all", F.col("match_id")).cast("int")
    inside = F.lit(False) if legacy else (k == 0) & F.exists(
        "spans", lambda r: (F.col("match_id") >= r["range_from"]) & (F.col("match_id") <= r["range_to"]))
    s = s.select("*", k.alias("_k"), F.try_element_at("forms_all", k_all).alias("_form"),
                 (k_all > 0).alias("_present"), inside.alias("_inside"))
    before = F.slice(forms, 1, F.greatest(F.col("_k") - 1, F.lit(0)))
    # Fast path: when the text starts with the preceding tokens joined by
    # single spaces, the left-to-right search can only stop at exactly
    # those positions, so the offset is the prefix length.  Only other rows
    # pay for the interpreted walk (CASE evaluates it lazily).
    prefix = F.when(F.col("_k") > 1, F.concat(F.array_join(before, " "), F.lit(" "))).otherwise(F.lit(""))
    s = s.select("*", prefix.alias("_prefix"))
    plen = F.length("_prefix")
    fast = (F.col("_k") > 0) & F.col("text").startswith(F.col("_prefix")) \
        & (F.substring(F.col("text"), plen + 1, F.length("_form")) == F.col("_form")) \
        & ~F.array_contains(before, " ") & ~F.col("_form").startswith(" ")
    s = pinned(s, _fast=fast)
    walk_off = F.when(F.col("_k") > 0, align_offset(F.col("text"), before, F.col("_form")))
    offset = F.when(F.col("_fast"), plen).otherwise(walk_off)
    s = pinned(s, _off=offset)
    offset = F.col("_off")
    return s.select(
        F.col("sid").alias("sentence_id"),
        "match_id",
        *CONTEXT_COLUMNS, *carry,
        F.col("_form").alias("match_token"),
        F.col("text").alias("original_text"),
        F.col("forms_all").alias("all_tokens"),
        F.when(F.col("text").isNull() | F.col("_inside") | ~F.col("_present"), F.lit(None))
        .otherwise(offset).alias("offset"),
        F.when(~F.col("_present"), "no_target")
        .when(F.col("text").isNull(), "no_text")
        .when(F.col("_inside"), "inside_range")
        .when(offset.isNull(), "not_aligned").alias("reason"),
    )


class MaskResult(NamedTuple):
    """One plan, two outputs (D3/D4); ``persist()`` before using both."""
    frame: DataFrame
    mask_token: str = DEFAULT_MASK
    carry: tuple[str, ...] = ()

    def persist(self) -> "MaskResult":
        return self._replace(frame=self.frame.persist())

    @property
    def masked(self) -> DataFrame:
        return self.masked_with_context.select(*MASKED_COLUMNS)

    @property
    def masked_with_context(self) -> DataFrame:
        """The masked dataset with the columns that pair search and scoring use."""
        f = self.frame.where(F.col("reason").isNull())
        return f.select(
            "sentence_id", "match_id", "match_token", "original_text", *CONTEXT_COLUMNS, *self.carry,
            token_surgery(F.col("original_text"), F.col("offset"), F.col("match_token"),
                          F.lit(self.mask_token)).alias("masked_text"),
        )

    @property
    def prompts(self) -> DataFrame:
        """The stripped text before the target (what the reference
        gets by masking with a cut-off marker and cutting there)."""
        f = self.frame.where(F.col("reason").isNull())
        return f.select(
            "sentence_id", "match_id", "match_token", "original_text",
            py_strip(F.substring(F.col("original_text"), F.lit(1), F.col("offset"))).alias("prompt_text"),
        )

    @property
    def exceptions(self) -> DataFrame:
        return self.frame.where(F.col("reason").isNotNull()).select(*EXCEPTION_COLUMNS)


def build_masked(sentences: DataFrame, pattern: Pattern | None = None, target: str | None = None,
                 mask_token: str = DEFAULT_MASK, matches: DataFrame | None = None, keep: str = "last",
                 legacy: bool = False, tokens: DataFrame | None = None, carry: list[str] | None = None,
                 word: Callable | None = None) -> MaskResult:
    """D3: masked and exception datasets for a pattern (or given matches).
    ``carry``: columns of the sentence that ``masked_with_context`` keeps.

    ``tokens`` (the treebank's token table) is used by multi-node
    patterns; by default it is exploded from ``sentences``.  ``word`` gives a target's
    token where the sentences' own are narrow (``Treebank.word``)."""
    return MaskResult(aligned(sentences, pattern, target, matches, keep, legacy, tokens, carry=carry, word=word), mask_token, tuple(carry or ()))


def mask_treebank(tb: Treebank, pattern: Pattern, target: str, **kw) -> MaskResult:
    """``build_masked`` of a treebank: where it can, tokens are built with the fields of the
    pattern only, and whole for the targets alone."""
    if tb.narrow is None or tb.word is None:
        return build_masked(tb.sentences, pattern, target, **kw)
    return build_masked(tb.narrow(pattern.fields()), pattern, target, word=tb.word, **kw)


def masked_dataset(sentences, pattern=None, target=None, mask_token=DEFAULT_MASK, **kw) -> DataFrame:
    return build_masked(sentences, pattern, target, mask_token, **kw).masked


def prompt_dataset(sentences, pattern=None, target=None, **kw) -> DataFrame:
    return build_masked(sentences, pattern, target, PROMPT_CUTOFF, **kw).prompts


def exception_dataset(sentences, pattern=None, target=None, **kw) -> DataFrame:
    return build_masked(sentences, pattern, target, **kw).exceptions


def mask_check(df: DataFrame, col: str = "masked_text", mask_token: str = DEFAULT_MASK) -> DataFrame:
    """Rows must hold exactly one mask; adds ``n_masks`` and ``status``."""
    n = count_occurrences(F.col(col), mask_token)
    return df.select("*", n.alias("n_masks"),
                     F.when(n.isNull(), "no_text").when(n == 0, "no_mask").when(n > 1, "multiple_masks").otherwise("ok").alias("status"))
