"""S3/S5 for targets of several sub-word pieces.

A piece table is made of the corpus: all substrings of two to ``size`` characters
that occur at least ``least`` times in its words, and every single character.  A word
is split greedily, the longest piece first.  Words are split once per distinct form,
and the n-grams of pieces are sums over the n-gram counts of *words*: no second pass
over the tokens.

A target's probability is the product over its pieces, each in the context that the
pieces before it have made (chain rule): ``p(p1 | prev) p(p2 | p1) ...`` for next-token
prediction, with the word after the target as right-hand context of every piece for
masked prediction.  A factor is at least ``FLOOR``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import require_columns, round_half_even, surprisal
from ..session import cut_lineage
from . import score as S

SIZE, LEAST = 4, 200
FLOOR = 1e-12  # fixed value: least probability of a piece
BROADCAST_PIECES = 1_000_000  # a piece table of up to so many rows is broadcast


class PieceModel(NamedTuple):
    pieces: DataFrame      # (piece, c): the table; single characters are not in it
    splits: DataFrame      # (word, first, last) of every word form of the corpus
    ngrams: S.NgramModel   # of pieces


def _sections(words: DataFrame, word: str, size: int) -> DataFrame:
    """``words`` with (p, n, piece): a row per substring of 2 to ``size`` characters, ``p`` from 1."""
    starts = words.where(F.length(word) >= 2).select("*", F.explode(F.sequence(F.lit(1), F.length(word) - 1)).alias("p"))
    lengths = starts.select("*", F.explode(F.array(*[F.lit(n) for n in range(2, size + 1)])).alias("n"))
    return lengths.where(F.col("p") + F.col("n") - 1 <= F.length(word)).withColumn("piece", F.substr(word, "p", "n"))


def piece_table(words: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """(piece, c) from distinct words (w, c)."""
    return _sections(words, "w", size).groupBy("piece").agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def split_words(words: DataFrame, pieces: DataFrame, size: int = SIZE, word: str = "word") -> DataFrame:
    """``words`` (distinct in ``word``) with ``pieces``: the greedy split, in time linear in the word.

    Substrings meet the table where they are made, if it is of up to ``BROADCAST_PIECES`` rows
    (else they are shuffled).  What is found at ``span`` places of a word is one number, a bit per
    place and length, so that hardly more than a row per word is shuffled."""
    bits = size - 1
    span = 63 // bits
    table = pieces.select("piece")
    if table.count() <= BROADCAST_PIECES:
        table = F.broadcast(table)
    at, bit = F.floor((F.col("p") - 1) / span).cast("int"), (F.col("p") - 1) % span * bits + F.col("n") - 2
    found = (_sections(words.select(word), word, size).join(table, "piece", "left_semi")
             .groupBy(F.col(word).alias("_w"), at.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")))
    marks = found.groupBy("_w").agg(F.array_sort(F.collect_list(F.struct("at", "bits"))).alias("_marks"))
    w = F.col(word)

    def longest(x: Column) -> Column:  # (p, n) of every place of a number; n is 1 where nothing is found
        last = F.least(F.lit(span - 1), F.length(w) - 1 - x["at"] * span)
        here = lambda i: F.call_function("shiftright", x["bits"], i * bits).bitwiseAND(2 ** bits - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            (x["at"] * span + i + 1).alias("p"), F.when(here(i) > 0, F.length(F.bin(here(i))) + 1).otherwise(1).alias("n")))

    spots = F.filter(F.flatten(F.transform("_marks", longest)), lambda x: x["n"] > 1)
    singles = lambda a, b: F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda i: F.substr(w, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    none = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, x: F.when(x["p"] < acc["next"], acc).otherwise(F.struct(
        (x["p"] + x["n"]).alias("next"), F.concat(acc["out"], singles(acc["next"], x["p"] - 1), F.array(F.substr(w, x["p"], x["n"]))).alias("out")))
    walked = F.aggregate(F.coalesce("_spots", F.array().cast("array<struct<p:int,n:int>>")), none, step,
                         lambda acc: F.concat(acc["out"], singles(acc["next"], F.length(w))))
    return words.join(marks, w == F.col("_w"), "left").withColumn("_spots", spots).select(*words.columns, walked.alias("pieces"))


def fit_pieces(sentences: DataFrame, order: int = 2, alpha: float = S.DEFAULT_ALPHA, size: int = SIZE, least: int = LEAST,
               words: DataFrame | None = None, bigram: S.NgramModel | None = None) -> PieceModel:
    """Piece table, splits and piece n-grams (``order`` 2: next piece, 3: masked piece) of a corpus.
    ``words``: its ``word_counts``, ``bigram``: its bucketed bigram model (``order`` 2), where they are at hand."""
    words = words if words is not None else S.word_counts(sentences)
    pieces = cut_lineage(piece_table(words, size, least), "pieces")
    split = cut_lineage(split_words(words.withColumnRenamed("w", "word"), pieces, size), "splits")
    ends = cut_lineage(split.select("word", F.get("pieces", F.lit(0)).alias("first"), F.element_at("pieces", -1).alias("last")).where("first is not null"), "piece_ends")
    side = lambda c, end, name: ends.select(F.col("word").alias(f"_{name}"), F.col(end).alias(name))
    if order == 2:
        n = F.size("pieces")
        pairs = F.arrays_zip(F.slice("pieces", 1, n - 1).alias("prev"), F.slice("pieces", 2, n - 1).alias("w"))
        inside = split.where(n >= 2).select("c", F.explode(pairs).alias("x")).select("x.prev", "x.w", "c")
        model = (bigram or S.fit_bucketed(sentences, words)).bucketed()
        # the last piece of the first word is found where its bigrams lie; ends go to all parts of a hot word
        last = ends.select(F.col("word").alias("prev"), F.col("last").alias("_last")).withColumn("_part", F.explode(F.sequence(F.lit(0), model.parts() - 1)))
        seen = model.grams.join(last.hint("shuffle_hash"), ["prev", "_part"]).select(F.col("_last").alias("prev"), F.col("w").alias("b"), "c")
        across = seen.join(side("b", "first", "w").hint("shuffle_hash"), F.col("b") == F.col("_w")).select("prev", "w", "c")
        counts, keys = inside.unionByName(across), ["prev"]
        vocab = split.select(F.explode("pieces").alias("x")).agg(F.countDistinct("x")).first()[0]
    else:
        counts = cut_lineage(split.select("c", F.explode("pieces").alias("w")).groupBy("w").agg(F.sum("c").alias("c")), "piece_counts")
        return PieceModel(pieces, ends, _fit_masked(sentences, words, split, ends, counts, alpha))
    return PieceModel(pieces, ends, S.fit_counts(counts.groupBy(*keys, "w").agg(F.sum("c").alias("c")), keys, order, alpha, vocab))


def _fit_masked(sentences: DataFrame, words: DataFrame, split: DataFrame, ends: DataFrame, counts: DataFrame, alpha: float) -> S.NgramModel:
    """The masked model of pieces, bucketed: every word with its neighbours becomes piece n-grams where the sentence is,
    and these are shuffled once.  The splits of the most frequent words go to the sentences; n-grams with
    another word are shuffled to their splits.  ``counts``: (w, c) of the pieces."""
    common = F.broadcast(S.most_frequent(split.where(F.size("pieces") > 0), S.WORD_CODES).select("word", "pieces"))
    real = {r.w for r in words.where(F.col("w").isin(S.BOS, S.EOS)).select("w").collect()}  # a marker may be a word as well
    found = S.trigrams(sentences).select("l", "w", "r").where("w is not null")
    for c in ("l", "w", "r"):
        found = found.join(common.select(F.col("word").alias(f"_{c}"), F.col("pieces").alias(f"p{c}")), F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    known = F.col("pw").isNotNull()
    for c, mark in (("l", S.BOS), ("r", S.EOS)):
        known = known & (F.col(f"p{c}").isNotNull() | F.col(c).isNull() | (F.lit(mark not in real) & (F.col(c) == mark)))
    near = found.where(known).select(F.element_at("pl", -1).alias("l"), F.col("pw").alias("pieces"), F.get("pr", F.lit(0)).alias("r"))
    side = lambda c, end: ends.select(F.col("word").alias(f"_{c}"), F.col(end).alias(end))
    far = found.where(~known).select("l", "w", "r").join(split.select(F.col("word").alias("_w"), "pieces"), F.col("w") == F.col("_w"))
    far = far.join(side("l", "last"), F.col("l") == F.col("_l"), "left").join(side("r", "first"), F.col("r") == F.col("_r"), "left")
    all_ = near.unionByName(far.select(F.col("last").alias("l"), "pieces", F.col("first").alias("r")))
    chain = F.concat(F.array(F.coalesce("l", F.lit(S.BOS))), F.col("pieces"), F.array(F.coalesce("r", F.lit(S.EOS))))
    n = F.size("pieces")
    z = F.arrays_zip(F.slice("chain", 1, n).alias("l"), F.slice("chain", 2, n).alias("w"), F.slice("chain", 3, n).alias("r"))
    ngrams = all_.select("pieces", chain.alias("chain")).select(F.explode(z).alias("x")).select("x.l", "x.r", "x.w")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # a context is at most as frequent as each of its two pieces
    frequent = {r.w: r.c for r in counts.where(F.col("c") * S.HOT_SHARE > total).collect()}
    lefts, rights = ({**frequent, mark: total} for mark in (S.BOS, S.EOS))
    hot = tuple(((a, b), -(-min(x, y) * S.HOT_SHARE // max(1, total))) for a, x in lefts.items() for b, y in rights.items())
    return S.fit_dealt(ngrams, counts, hot, 3, alpha, S.bucket_count(counts, total))


def piece_scores(pairs: DataFrame, model: PieceModel, cols=("form_grammatical", "form_ungrammatical"), key=("sent_ord", "match_id"),
                 size: int = SIZE) -> DataFrame:
    """Adds ``p_<col>``, ``I_<col>``, ``n_pieces_<col>`` and ``certainty`` (of the first piece's
    context) to ``pairs``, which carries its neighbours.  A null or empty form has no
    probability; a target with characters the corpus lacks is split into them."""
    key, cols, ngrams = list(key), list(cols), model.ngrams
    require_columns(pairs, "prev_word", "next_word", *key, *cols)
    words = F.array(*[F.struct(F.lit(i).alias("col"), S._bare(c).alias("word")) for i, c in enumerate(cols)])
    narrow = pairs.select(*key, "prev_word", "next_word", F.explode(words).alias("x")).select(*key, "prev_word", "next_word", "x.*").where(F.length("word") > 0)
    split = split_words(narrow.select("word").distinct(), model.pieces, size).withColumnRenamed("word", "_word")
    ends = model.splits
    rows = narrow.join(split, F.col("word") == F.col("_word")).join(
        ends.select(F.col("word").alias("_before"), F.col("last").alias("_left")), F.col("prev_word") == F.col("_before"), "left")
    if ngrams.order == 3:
        rows = rows.join(ends.select(F.col("word").alias("_after"), F.col("first").alias("_right")), F.col("next_word") == F.col("_after"), "left")
    left = F.concat(F.array(F.coalesce("_left", F.lit(S.BOS))), F.slice("pieces", 1, F.size("pieces") - 1))
    z = F.arrays_zip(left.alias("l"), F.col("pieces").alias("w"))
    right = F.coalesce("_right", F.lit(S.EOS)) if ngrams.order == 3 else F.lit(None)
    steps = rows.select(*key, "col", right.alias("_r"), F.posexplode(z).alias("i", "x"))
    context = [F.col("x.l").alias("prev")] if ngrams.order == 2 else [F.col("x.l").alias("l"), F.col("_r").alias("r")]
    got = S.looked_up(steps.select(*key, "col", "i", *context, F.col("x.w").alias("w")), ngrams)
    sure = round_half_even(F.lit(1.0) - F.col("e") / F.lit(math.log(ngrams.vocab)))
    per = got.groupBy(*key, "col").agg(F.exp(F.sum(F.log(F.greatest("p", F.lit(FLOOR))))).alias("p"), F.count(F.lit(1)).alias("n"),
                                       F.max(F.when(F.col("i") == 0, sure)).alias("s"))
    per = per.groupBy(*[F.col(k).alias(f"_k{k}") for k in key]).agg(
        *[F.max(F.when(F.col("col") == i, F.col(v))).alias(f"{a}_{c}") for i, c in enumerate(cols) for v, a in (("p", "p"), ("n", "n_pieces"))],
        F.max("s").alias("certainty"))
    out = pairs.join(per, S._and([F.col(k) == F.col(f"_k{k}") for k in key]), "left").drop(*[f"_k{k}" for k in key])
    return out.withColumns({f"I_{c}": surprisal(F.col(f"p_{c}")) for c in cols})
