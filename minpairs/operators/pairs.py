"""Minimal pairs.

The reference answers "which other word has the same lemma and the same
features except the overridden ones?" by copying and scanning the whole
lexicon once per target.  Here the lexicon is first collapsed into an
index with one row per ``(lemma, feature key, starts upper)`` -- the first
form in treebank order -- and every target is resolved by one equi join.
The target rows carry their own lemma and features from the masking step,
so that is the only join.  The index is stored before use: with an exchange
of its own on both sides AQE can split a lemma that many targets share (an
aggregate joined on its own keys has none, and is never split).
"""

from __future__ import annotations

import math
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LEXICON_EXCLUDED_FORMS, feat_key, feat_key_fixed, starts_upper
from ..session import cut_lineage
from . import lexicon as L
from .pattern import let


def override_feats(feats: Column, morph: dict) -> Column:
    """Replace the overridden features (lower-cased keys); a None value
    removes the feature, i.e. asks for a word without it."""
    keys = [k.lower() for k in morph]
    kept = F.map_filter(feats, lambda k, v: ~k.isin(keys)) if keys else feats
    add = [(k.lower(), v) for k, v in morph.items() if v is not None]
    if not add:
        return kept
    extra = F.create_map(*[x for k, v in add for x in (F.lit(k), F.lit(v))])
    return F.map_concat(kept, extra)


def _key(feats, names):
    return feat_key(feats) if names is None else feat_key_fixed(feats, names)


BROADCAST_INDEX = 500_000  # rows of an index (lemma, features and one form) that is broadcast


class LexiconIndex(NamedTuple):
    """The index and the feature names its key is made of."""
    frame: DataFrame
    names: list[str] | None
    with_upos: bool = False

    def stored(self) -> "LexiconIndex":
        """The index as a table; one of up to ``BROADCAST_INDEX`` rows goes to the targets, which
        carry whole texts: a join that shuffles them costs more than all the rest of the search."""
        frame = cut_lineage(self.frame)
        return self._replace(frame=F.broadcast(frame) if frame.count() <= BROADCAST_INDEX else frame)


_INTS = {"tinyint", "smallint", "int"}


def _hashed_order(lex: DataFrame) -> tuple[list[Column], Column] | None:
    """Treebank order ``(sent_ord, tid)`` as (leading columns, one number): the same order, nulls first.
    None if ``sent_ord`` is not made of whole numbers.

    The number holds the last two parts if both are ints (else the last) and 61 bits
    of the part before; the leading columns hold the rest, which varies little."""
    kind, parts = lex.schema["sent_ord"].dataType, [F.col("sent_ord")]
    kinds = [kind.simpleString()]
    if isinstance(kind, T.StructType):
        kinds, parts = [f.dataType.simpleString() for f in kind.fields], [F.col("sent_ord")[f.name] for f in kind.fields]
    kinds, parts = [*kinds, lex.schema["tid"].dataType.simpleString()], [*parts, F.col("tid")]
    if not set(kinds) <= _INTS | {"bigint"}:
        return None
    number = lambda c, k: F.coalesce(c.cast("long"), F.lit(-2 ** (31 if k in _INTS else 63)).cast("long"))
    place, left = number(parts.pop(), last := kinds.pop()), len(parts)
    if last in _INTS and kinds[-1] in _INTS:
        place, left = F.shiftleft(number(parts[-1], kinds[-1]), 32).bitwiseOR(place + F.lit(2 ** 31)), left - 1
    if not left:
        return [], place
    c = parts[left - 1].cast("long")
    low = F.coalesce(c.bitwiseAND(F.lit(2 ** 61 - 1)), F.lit(0)).cast("decimal(20,0)")
    return [*parts[:left - 1], F.shiftright(c, 61)], low * F.lit(Decimal(2 ** 64)) + place


def _packed_order(lex: DataFrame) -> tuple[list[Column], Column, Column] | None:
    """Treebank order as (leading columns, one long, the order of both together).
    Places that share their leading columns are in the order of the long.

    The long holds 31 bits of the first part and 16 of the others, the leading columns the rest of
    every part, which is 0 nearly always.  None unless the others are one or two whole numbers."""
    kind, parts = lex.schema["sent_ord"].dataType, [F.col("sent_ord")]
    kinds = [kind.simpleString()]
    if isinstance(kind, T.StructType):
        kinds, parts = [f.dataType.simpleString() for f in kind.fields], [F.col("sent_ord")[f.name] for f in kind.fields]
    kinds, parts = [*kinds, lex.schema["tid"].dataType.simpleString()], [c.cast("long") for c in (*parts, F.col("tid"))]
    if not 2 <= len(parts) <= 3 or not set(kinds) <= _INTS | {"bigint"}:
        return None
    bits = [31] + [16] * (len(parts) - 1)
    lead = [F.shiftright(c, n) for c, n in zip(parts, bits)]
    place, order = F.lit(0).cast("long"), []
    for i, (c, n) in enumerate(zip(parts, bits)):
        place = F.shiftleft(place, n).bitwiseOR(F.coalesce(c.bitwiseAND(F.lit(2 ** n - 1)), F.lit(0)))
        order += [F.col(f"_o{i}"), F.shiftright("_place", sum(bits[i + 1:])).bitwiseAND(F.lit(2 ** n - 1))]
    return lead, place, F.struct(*order)


def lexicon_index(lex: DataFrame, with_upos: bool = False, names: list[str] | None = None) -> LexiconIndex:
    """First form (treebank order) per lemma, feature set and case
    of the first letter.  Map-side partial aggregation makes the shuffle
    proportional to the number of distinct keys, not to the lexicon.
    With ``names`` (the lexicon's feature names) the feature key is a
    generated-code expression."""
    keys = [F.col("lemma").alias("_lemma"), _key(F.col("feats"), names).alias("_fkey")]
    if with_upos:
        keys.append(F.col("upos").alias("_upos"))
    words = lex.where(F.col("lemma").isNotNull() & (F.length("form") > 0))
    upper = starts_upper("form").alias("_upper")
    order, packed = _hashed_order(words), _packed_order(words)
    if order is None:
        keys.append(upper)
        frame = words.groupBy(*keys).agg(F.min_by("form", F.struct("sent_ord", "tid")).alias("form_ungrammatical"))
        return LexiconIndex(frame, names, with_upos)
    # a buffer that holds strings or structs makes Spark sort all tokens: first the least place of
    # every form as a number (hash aggregation), then the first form of the few distinct ones
    # (a decimal, or better a long); what follows from the form is computed on distinct forms
    lead, place = packed[:2] if packed else order
    by = [*keys, F.col("form"), *[c.alias(f"_o{i}") for i, c in enumerate(lead)]]
    forms = words.groupBy(*by).agg(F.min(place).alias("_place"))
    at = packed[2] if packed else F.struct(*[f"_o{i}" for i in range(len(lead))], "_place")
    frame = forms.groupBy("_lemma", "_fkey", upper, *["_upos"] * with_upos).agg(F.min_by("form", at).alias("form_ungrammatical"))
    return LexiconIndex(frame, names, with_upos)


def _own_features(targets: DataFrame, lex: DataFrame) -> DataFrame:
    """C11 for targets that do not carry their lemma and features: a key join
    with the lexicon (on the sentence key, or on the id where there is none)."""
    ours, theirs = ("sent_ord", "sent_ord") if "sent_ord" in targets.columns else ("sentence_id", "sentence_id")
    own = lex.select(F.col(theirs).alias("_ls"), (F.col("token_id") + 1).alias("_lm"), "lemma", "feats")
    on = (F.col(ours) == F.col("_ls")) & (F.col("match_id") == F.col("_lm"))
    return targets.join(own, on, "left").drop("_ls", "_lm")


def alternative_forms(targets: DataFrame, lex: DataFrame, morph: dict, universal: dict | None = None,
                      validate: bool = True, names: list[str] | None = None,
                      index: LexiconIndex | None = None) -> DataFrame:
    """E2 for many targets at once: ``targets`` has ``sentence_id`` and
    ``match_id`` (1-based); adds ``form_ungrammatical`` (NULL when the
    lexicon holds no such word).

    Targets with ``lemma`` and ``feats`` (``MaskResult.masked_with_context``)
    need one join; others look their features up first.  ``names``: the
    lexicon's feature names (collected once if not given); ``index``: a
    ``lexicon_index`` to share between tasks, whose names then hold."""
    universal = universal or {}
    bad = [k for k in universal if k != "upos"]
    if bad:
        raise KeyError(f"unsupported universal override: {bad}")
    if index is not None:
        if names is not None and index.names is not None and sorted(names) != sorted(index.names):
            raise ValueError(f"the index is built on features {index.names}, not on {names}")
        if index.with_upos != ("upos" in universal):
            raise ValueError("an index with upos goes with an upos override, and only with one")
        names = index.names
    if names is None and validate:
        names = L.collect_feature_names(lex)
    if validate:
        unknown = [k for k in morph if k.lower() not in set(names)]
        if unknown:
            raise KeyError(f"cannot override {unknown}: the lexicon has the features {sorted(names)}")
    form = F.col("match_token" if "match_token" in targets.columns else "form_grammatical")
    carried = {"lemma", "feats"} <= set(targets.columns)
    t = targets if carried else _own_features(targets, lex)
    # a form outside the lexicon has no alternative; carried rows skip the lookup that would show it
    t = t.withColumns({"_lemma": F.when(~form.isin(LEXICON_EXCLUDED_FORMS), F.col("lemma")),
                       "_fkey": _key(override_feats(F.col("feats"), morph), names), "_upper": starts_upper(form)})
    jk = ["_lemma", "_fkey", "_upper"]
    if "upos" in universal:
        t = t.withColumn("_upos", F.lit(universal["upos"]))
        jk.append("_upos")
    if index is None:  # of the words asked for
        own = lex.where(F.col("upos") == F.lit(universal["upos"])) if "upos" in universal else lex
        index = lexicon_index(own, with_upos="upos" in universal, names=names).stored()
    out = t.join(index.frame, jk, "left").drop(*jk)
    return out if carried else out.drop("lemma", "feats")


def minimal_pairs(dataset: DataFrame, lex: DataFrame, morph: dict, universal: dict | None = None,
                  leading_space: bool = True, validate: bool = True, names: list[str] | None = None,
                  index: LexiconIndex | None = None) -> DataFrame:
    """E5: masked or prompt dataset -> minimal-pair dataset."""
    out = alternative_forms(dataset, lex, morph, universal, validate, names, index)
    out = out.withColumnRenamed("match_token", "form_grammatical")             # B12
    out = out.where(F.col("form_ungrammatical").isNotNull())                    # B10
    out = out.where(F.col("form_grammatical") != F.col("form_ungrammatical"))   # B11
    if leading_space:                                                           # B13
        out = out.withColumn("form_grammatical", F.concat(F.lit(" "), "form_grammatical")) \
            .withColumn("form_ungrammatical", F.concat(F.lit(" "), "form_ungrammatical"))
    return out


def pair_vocabulary(pairs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Distinct (grammatical, ungrammatical) pairs with a dense position
    ``0..n-1`` in md5 order.

    No global window: rows are ranked inside hash buckets (the md5 prefix,
    so bucket order is md5 order), and bucket offsets come from a table of
    at most ``buckets`` counts, which is broadcast.  ``buckets`` is rounded up
    to a power of 16; by default four per shuffle partition."""
    if buckets is None:
        buckets = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = F.md5(F.concat_ws("\u0001", "form_grammatical", "form_ungrammatical"))
    p = pairs.select("form_grammatical", "form_ungrammatical").distinct().withColumn("_h", h)
    digits = max(1, -(-(buckets - 1).bit_length() // 4))
    p = p.withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    # the distinct pairs feed both the ranking and the bucket counts:
    # materialise them once instead of evaluating the input plan twice
    p = cut_lineage(p)
    w = Window.partitionBy("_b").orderBy("_h", "form_grammatical", "form_ungrammatical")
    p = p.withColumn("_rk", F.row_number().over(w))
    counts = p.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
                         .alias("_off"))
    offs = offs.select("_b", F.coalesce("_off", F.lit(0)).alias("_off"))
    return p.join(F.broadcast(offs), "_b").select(
        "form_grammatical", "form_ungrammatical", (F.col("_off") + F.col("_rk") - 1).alias("pair_pos"))


ROUNDS, WALKS = 4, 24  # of a permutation; walks beyond the first are rarely taken, see below


def keyed_permutation(x: Column, key: Column, m: int) -> Column:
    """A permutation of 0..m-1 per ``key``, as a column expression: a Feistel network with cycle walking.

    A number below ``m`` is a pair (l, r) of digits in a grid a x b of just over m
    cells.  Rounds add a hash of the key, the round and one digit to the other digit,
    in turn, which is a permutation of the grid; a result beyond m is permuted again.
    Less than one cell in sqrt(m) is beyond, and at most a - 1 in all, so that
    ``WALKS`` repetitions leave nothing but a chance below m ** -12 (an error)."""
    a = math.isqrt(max(m, 1) - 1) + 1
    b = -(-m // a)
    walks = min(WALKS, a * b - m)
    cell = lambda p: p["l"] * b + p["r"]

    def moved(acc: Column, s: Column) -> tuple[Column, Column]:
        left = s % 2 == 0
        digest = F.md5(F.concat_ws(":", key, (s % ROUNDS + 1).cast("string"), F.when(left, acc["r"]).otherwise(acc["l"]).cast("string")))
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        return F.when(left, (acc["l"] + h) % a).otherwise(acc["l"]), F.when(left, acc["r"]).otherwise((acc["r"] + h) % b)

    def first(acc: Column, s: Column) -> Column:
        l, r = moved(acc, s)
        return F.struct(l.alias("l"), r.alias("r"))

    def step(acc: Column, s: Column) -> Column:
        settled = acc["done"] | (s > 0) & (s % ROUNDS == 0) & (cell(acc) < m)
        l, r = moved(acc, s)
        return F.struct(F.when(settled, acc["l"]).otherwise(l).alias("l"), F.when(settled, acc["r"]).otherwise(r).alias("r"), settled.alias("done"))

    def finish(acc: Column) -> Column:
        return F.coalesce(F.when(cell(acc) < m, cell(acc)), F.raise_error(F.lit("no position below the limit")).cast("long"))

    def settle(p: Column) -> Column:
        if not walks:
            return finish(p)
        again = F.struct(p["l"].alias("l"), p["r"].alias("r"), F.lit(False).alias("done"))
        return F.when(cell(p) < m, cell(p)).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * walks - 1)), again, step, finish))

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    # nearly all rows are done after one permutation: only the others pay for walks
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, first), settle)


def ood_picks(mp: DataFrame, k: int, seed: int = 0, key_cols=("sentence_id", "match_id"), carry=()) -> DataFrame:
    """E6 (long form): for every row, ``k`` distinct pairs other than its own,
    drawn deterministically: with n pairs and the row's own position p,
    pick j (0..k-1) is position ``(p + 1 + f(j)) mod n``, where f is a permutation
    of 0..n-2 of its own for every row key and seed.  Never the own pair, no
    repeats, rows that share a pick share others by chance only; no cross
    join, one lookup join on the position."""
    key_cols = list(key_cols)
    # the input feeds a count and two joins: materialise it once in the
    # checkpoint folder instead of recomputing the pair pipeline each time
    carry = [c for c in carry if c not in key_cols]
    mp = cut_lineage(mp.select(*key_cols, *carry, "form_grammatical", "form_ungrammatical"), "pairs")
    vocab = cut_lineage(pair_vocabulary(mp), "pair_vocabulary")  # counted, and read for the own and the picked positions
    n = vocab.count()
    if n - 1 < k:
        raise ValueError(f"Sample larger than population: {k} OOD pairs requested, {n - 1} available")
    own = mp.join(vocab, ["form_grammatical", "form_ungrammatical"]).select(*key_cols, *carry, "pair_pos")
    picks = own.select(*key_cols, *carry, "pair_pos", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("pick"))
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed)))
    drawn = keyed_permutation(F.col("pick").cast("long"), key, n - 1)
    picks = picks.select(*key_cols, *carry, "pick", F.pmod(F.col("pair_pos") + 1 + drawn, F.lit(n)).alias("_p"))
    v = vocab.select(F.col("pair_pos").alias("_p"),
                     F.col("form_grammatical").alias("ood_form_grammatical"),
                     F.col("form_ungrammatical").alias("ood_form_ungrammatical"))
    return picks.join(v, "_p").drop("_p")


def with_ood_pairs(mp: DataFrame, k: int, seed: int = 0, key_cols=("sentence_id", "match_id")) -> DataFrame:
    """Adds ``ood_minimal_pairs ARRAY<STRUCT<form_grammatical,
    form_ungrammatical>>`` (k entries per row, bounded by the parameter)."""
    key_cols = list(key_cols)
    picks = ood_picks(mp, k, seed, key_cols)
    arr = picks.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct(
        "pick", F.col("ood_form_grammatical").alias("form_grammatical"),
        F.col("ood_form_ungrammatical").alias("form_ungrammatical")))).alias("_a"))
    arr = arr.select(*key_cols, F.transform("_a", lambda x: F.struct(
        x["form_grammatical"].alias("form_grammatical"),
        x["form_ungrammatical"].alias("form_ungrammatical"))).alias("ood_minimal_pairs"))
    return mp.join(arr, key_cols, "left")
