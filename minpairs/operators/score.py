"""Scoring minimal pairs.

Two kinds of scorer share one output contract (``p_<col>``, ``I_<col>``
and, at token level, ``certainty``):

* the corpus n-gram scorer (S8), made only of DataFrame operators.  NTP
  uses bigrams p(w | prev) = (c(prev, w) + a) / (c(prev, *) + a V); the
  masked (MLM) variant uses both neighbours
  p(w | l, r) = (c(l, w, r) + a) / (c(l, *, r) + a V); V is the number of
  distinct word forms and a = 0.1 by default.  Certainty is 1 - H / ln V of
  the whole distribution, from sums per context plus the unseen mass.
* model scorers (S1-S5): a user object scored batch by batch with
  ``mapInArrow``; the model is loaded once per Python worker.

n-grams are built inside each sentence row from its word array
(``arrays_zip`` of shifted slices, then explode): no self join, no window.
Contexts are sums over the n-gram counts, not a second pass over tokens.
Both count tables are stored by the fit: a lookup join
then has an exchange on both sides, which is what AQE needs to split a very
frequent word; an aggregate joined on its own keys would be read in place.
Targets are unpivoted, so any number of target columns is one lookup.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import require_columns, round_half_even, surprisal
from ..session import cut_lineage, scratch
from ..sources import tables
from ..sources.treebank import with_alignment_columns

BOS, EOS = "<s>", "</s>"
DEFAULT_ALPHA = 0.1
HOT_SHARE = 64  # contexts with more than one in so many of all n-grams are dealt out in a bucketed model
BUCKET_ROWS = 1_000_000  # a fitted bucket takes about so many n-grams with repeats, or fewer
WORD_CODES, CODE_BITS = 1_000_000, 21  # at most so many words, the most frequent ones, travel as numbers in the shuffle of a fit
TOP_GRAMS = 500_000  # at most so many n-grams, the most frequent ones, are looked up where the sentences are


def word_rows(sentences: DataFrame) -> DataFrame:
    """(sent_ord, sid, words): the word forms of each sentence in id order."""
    return with_alignment_columns(sentences).select("sent_ord", "sid", "words")


def bigrams(sentences: DataFrame) -> DataFrame:
    """(sent_ord, sid, tid, prev, w) for every word that has a predecessor.

    Consecutive words are already in the same sentence row, so the pairs
    come from native array functions (``arrays_zip`` of two slices) and an
    explode -- no self join, no shuffle before the counting aggregation."""
    s = word_rows(sentences)
    n = F.size("words")
    z = F.arrays_zip(F.slice("words", 1, n - 1).alias("prev"), F.slice("words", 2, n - 1).alias("w"))
    e = s.select("sent_ord", "sid", F.posexplode_outer(F.when(n >= 2, z)).alias("i", "bg")).where(F.col("bg").isNotNull())
    return e.select("sent_ord", "sid", (F.col("i") + 2).cast("int").alias("tid"), F.col("bg")["prev"].alias("prev"),
                    F.col("bg")["w"].alias("w"))


def trigrams(sentences: DataFrame) -> DataFrame:
    """(sent_ord, sid, tid, l, w, r) for every word, padded with sentence markers."""
    s = word_rows(sentences)
    n = F.size("words")
    left = F.concat(F.array(F.lit(BOS)), F.slice("words", 1, n - 1))
    right = F.concat(F.slice("words", 2, n - 1), F.array(F.lit(EOS)))
    z = F.arrays_zip(left.alias("l"), F.col("words").alias("w"), right.alias("r"))
    e = s.select("sent_ord", "sid", F.posexplode_outer(F.when(n >= 1, z)).alias("i", "tg")).where(F.col("tg").isNotNull())
    return e.select("sent_ord", "sid", (F.col("i") + 1).cast("int").alias("tid"), F.col("tg")["l"].alias("l"),
                    F.col("tg")["w"].alias("w"), F.col("tg")["r"].alias("r"))


class NgramModel(NamedTuple):
    grams: DataFrame      # bigram: (prev, w, c);  trigram: (l, r, w, c)
    contexts: DataFrame   # bigram: (prev, h, e);  trigram: (l, r, h, e); h = count, e = entropy of the context's distribution
    vocab: int
    alpha: float
    order: int
    hot: tuple | None = None  # a bucketed model: ((context values), parts) of the contexts that are dealt out

    @property
    def keys(self) -> list[str]:
        return ["prev"] if self.order == 2 else ["l", "r"]

    def stored(self) -> "NgramModel":
        """The model itself: both tables are stored by the fit."""
        return self

    def parts(self) -> Column:
        """The number of parts of a context: 1, or more for a hot one."""
        if not self.hot:
            return F.lit(1)
        named = {}
        for values, parts in self.hot:
            named["\u0001".join(values)] = max(parts, named.get("\u0001".join(values), 1))
        some = _and([F.col(k).isin(*{values[i] for values, _ in self.hot}) for i, k in enumerate(self.keys)])
        found = F.try_element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.concat_ws("\u0001", *self.keys))
        return F.when(some, F.coalesce(found, F.lit(1))).otherwise(1)

    def part(self, word: str = "w") -> Column:
        """Which part of its context an n-gram is in: 0, or by the word's hash for a hot context."""
        return F.pmod(F.xxhash64(F.col(word)), self.parts()).cast("int")

    def bucketed(self, buckets: int | None = None) -> "NgramModel":
        """The model as tables bucketed on the context: lookups then shuffle their own rows only,
        never the model, which pays where one model scores many datasets.

        A bucket is one task's share and AQE cannot split it, so contexts with more than one in
        ``HOT_SHARE`` of all n-grams (at most as many contexts) are dealt out by the word's hash
        on both sides: their n-grams to parts, their context row to every part."""
        if self.hot is not None:
            return self
        spark = self.grams.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        total = self.contexts.agg(F.coalesce(F.sum("h"), F.lit(0))).first()[0]
        hot = self.contexts.where(F.col("h") * HOT_SHARE > total).select(*self.keys, F.ceil(F.col("h") * HOT_SHARE / F.lit(max(1, total))).alias("n")).collect()
        model = self._replace(hot=tuple((tuple(r[k] for k in self.keys), int(r["n"])) for r in hot))
        by = [*self.keys, "_part"]
        grams = self.grams.withColumn("_part", model.part()).repartition(buckets, *by)
        contexts = self.contexts.withColumn("_part", F.explode(F.sequence(F.lit(0), model.parts() - 1))).repartition(buckets, *by)
        return model._replace(grams=_bucket_table(grams, "ngrams", buckets, by), contexts=_bucket_table(contexts, "contexts", buckets, by))


def _bucket_table(df: DataFrame, name: str, buckets: int, by: list[str]) -> DataFrame:
    """``df``, partitioned alike, as an external bucketed table: its files lie in the checkpoint folder.
    Rows are not sorted: ``sortBy`` saves a quarter of the room, but computes the bucket in every comparison."""
    spark, table = df.sparkSession, f"minpairs_{name}_{uuid.uuid4().hex}"
    (df.write.bucketBy(buckets, *by).option("path", scratch(spark, name)).option("compression", "zstd").saveAsTable(table))
    return spark.table(table)


def word_counts(sentences: DataFrame) -> DataFrame:
    """(w, c): the distinct word forms and how often each occurs, stored."""
    return cut_lineage(word_rows(sentences).select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")), "words")


def vocab_size(sentences: DataFrame) -> int:
    """V: one scalar, computed by a distributed distinct count."""
    return word_rows(sentences).select(F.explode("words").alias("f")).select(F.countDistinct("f")).first()[0]


def fit_counts(counts: DataFrame, keys: list[str], order: int, alpha: float, vocab: int) -> NgramModel:
    """Model from n-gram counts (keys, w, c): both tables are stored, each once; contexts are sums over the stored counts."""
    counts = cut_lineage(counts, "ngrams")
    ctx = _context_sums(counts, keys, alpha).select(*keys, "h", _context_entropy(alpha, vocab).alias("e"))
    return NgramModel(counts, cut_lineage(ctx, "contexts"), vocab, alpha, order)


def _context_sums(counts: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    seen = F.col("c") + F.lit(float(alpha))
    return counts.groupBy(*keys).agg(F.sum("c").alias("h"), F.sum(seen * F.log(seen)).alias("_s"), F.count(F.lit(1)).alias("_n"))


def _context_entropy(alpha: float, vocab: int) -> Column:
    a, v = float(alpha), float(vocab)
    mass = F.col("h") + F.lit(a * v)
    return F.log(mass) - (F.col("_s") + (F.lit(v) - F.col("_n")) * F.lit(a * math.log(a))) / mass


def _fit(ngrams: DataFrame, keys: list[str], order: int, alpha: float, vocab: int) -> NgramModel:
    return fit_counts(ngrams.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("c")), keys, order, alpha, vocab)


def fit_bigram(sentences: DataFrame, alpha: float = DEFAULT_ALPHA, vocab: int | None = None) -> NgramModel:
    """Bigram counts (map-side combined aggregations over exploded pairs)."""
    return _fit(bigrams(sentences), ["prev"], 2, alpha, vocab if vocab is not None else vocab_size(sentences))


def fit_masked(sentences: DataFrame, alpha: float = DEFAULT_ALPHA, vocab: int | None = None) -> NgramModel:
    return _fit(trigrams(sentences), ["l", "r"], 3, alpha, vocab if vocab is not None else vocab_size(sentences))


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of the greatest ``c``, at most ``limit``.  Counts that are much alike stand or fall together:
    classes of them are counted first, so that nothing is sorted."""
    kind = F.floor(F.log2("c") * 8)
    least, room = None, limit
    for k, n in sorted(counts.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if (room := room - n) < 0:
            break
        least = k
    return counts.where(kind >= least) if least is not None else counts.where(F.lit(False))


def word_codes(words: DataFrame) -> DataFrame:
    """(word, code): the sentence markers and the most frequent words of ``word_counts``, numbered, stored."""
    marks = words.sparkSession.range(2).select(F.when(F.col("id") == 0, BOS).otherwise(EOS).alias("w"))
    kept = most_frequent(words.where(F.col("w").isNotNull() & ~F.col("w").isin(BOS, EOS)), WORD_CODES)
    numbers = F.row_number().over(Window.orderBy("w")).cast("long")  # of a table of fixed size
    return cut_lineage(kept.select("w").unionByName(marks).select(F.col("w").alias("word"), numbers.alias("code")), "codes")


def _coded(codes: DataFrame, names: list[str], df: DataFrame, *rest: Column) -> DataFrame:
    """``rest`` and the words of ``names`` as one number ``_k``; a word without a code is spelled in ``_s<i>``."""
    for i, n in enumerate(names):
        df = df.join(F.broadcast(codes.select(F.col("word").alias(f"_w{i}"), F.col("code").alias(f"_c{i}"))), F.col(n) == F.col(f"_w{i}"), "left")
    number = F.lit(0).cast("long")
    for i in range(len(names)):  # the first word in the highest bits
        number = F.shiftleft(number, CODE_BITS).bitwiseOR(F.coalesce(F.col(f"_c{i}"), F.lit(0)))
    return df.select(*rest, number.alias("_k"), *[F.when(F.col(f"_c{i}").isNull(), F.col(n)).alias(f"_s{i}") for i, n in enumerate(names)])


def _spelled(codes: DataFrame, names: list[str], df: DataFrame, *rest: str) -> DataFrame:
    """The words again, from the columns of ``_coded``."""
    for i in range(len(names)):
        at = F.shiftright("_k", CODE_BITS * (len(names) - 1 - i)).bitwiseAND(2 ** CODE_BITS - 1)
        df = df.join(F.broadcast(codes.select(F.col("word").alias(f"_w{i}"), F.col("code").alias(f"_c{i}"))), at == F.col(f"_c{i}"), "left")
    return df.select(*[F.coalesce(f"_w{i}", f"_s{i}").alias(n) for i, n in enumerate(names)], *rest)


def fit_bucketed(sentences: DataFrame, words: DataFrame, order: int = 2, alpha: float = DEFAULT_ALPHA, buckets: int | None = None) -> NgramModel:
    """The model of ``fit_bigram`` or ``fit_masked``, bucketed from the start: n-grams are shuffled once,
    by context, and are counted, summed and looked up where they lie.

    ``words``: ``word_counts`` of the same sentences.  A context with more than one in ``HOT_SHARE``
    of all n-grams (or with more than a bucket's share) is made of words that are as frequent, so hot contexts
    are known before the n-grams are counted."""
    keys = ["prev"] if order == 2 else ["l", "r"]
    ngrams = (bigrams if order == 2 else trigrams)(sentences).select(*keys, "w")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    buckets = buckets or bucket_count(words, total)
    share = max(HOT_SHARE, buckets)
    frequent = {r.w: r.c for r in words.where(F.col("c") * share > total).where("w is not null").collect()}
    if order == 2:
        counts = [((w,), c) for w, c in frequent.items()]
    else:
        known = ngrams.where(F.col("l").isin(BOS, *frequent) & F.col("r").isin(EOS, *frequent)).groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        counts = [((r.l, r.r), r.c) for r in known.where(F.col("c") * share > total).collect()]
    return fit_dealt(ngrams, words, tuple((k, -(-c * share // total)) for k, c in counts), order, alpha, buckets)


def bucket_count(words: DataFrame, total: int) -> int:
    return max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS))


def fit_dealt(ngrams: DataFrame, words: DataFrame, hot: tuple, order: int, alpha: float, buckets: int) -> NgramModel:
    """The bucketed model of n-grams (keys, w; with a count ``c`` or one each), whose words and counts are ``words`` (w, c).

    Rows cross the network as a number for the words that have a code; what has none is spelled."""
    keys, vocab, codes = ["prev"] if order == 2 else ["l", "r"], words.agg(F.count("w")).first()[0], word_codes(words)
    model = NgramModel(ngrams, ngrams, vocab, alpha, order, hot)
    by, names, counted = [*keys, "_part"], [*keys, "w"], "c" in ngrams.columns
    owner = F.pmod(F.hash(*by), F.lit(buckets)).alias("_b")  # the bucket that Spark gives the context
    dealt = _coded(codes, names, ngrams.withColumn("_part", model.part()), owner, *[F.col("c")] * counted).repartitionById(buckets, F.col("_b"))
    seen = dealt.groupBy("_b", "_k", *[f"_s{i}" for i in range(len(names))]).agg((F.sum("c") if counted else F.count(F.lit(1))).alias("c"))
    grams = _bucket_table(_spelled(codes, names, seen, "c").withColumn("_part", model.part()), "ngrams", buckets, by)
    sums = _context_sums(grams, by, alpha)
    if model.hot:  # the whole sums of a hot context go to all its parts, also to those without an n-gram
        whole = sums.where(model.parts() > 1).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("h", "_s", "_n")])
        whole = whole.withColumn("_part", F.explode(F.sequence(F.lit(0), model.parts() - 1)))
        sums = sums.where(model.parts() == 1).unionByName(whole).repartition(buckets, *by)
    contexts = sums.select(*by, "h", _context_entropy(alpha, vocab).alias("e"))
    return model._replace(grams=grams, contexts=_bucket_table(contexts, "contexts", buckets, by))


def smoothed(model: NgramModel, c: Column, h: Column) -> Column:
    """(c + a) / (h + a V); a missing count is 0, a missing context gives 1/V."""
    a, v = float(model.alpha), float(model.vocab)
    return (F.coalesce(c, F.lit(0)).cast("double") + F.lit(a)) / (F.coalesce(h, F.lit(0)).cast("double") + F.lit(a * v))


def looked_up(df: DataFrame, model: NgramModel, word: str = "w") -> DataFrame:
    """Add ``p``, the smoothed probability of ``word`` in the context columns
    of ``df``, and ``e``, the entropy of that context's distribution."""
    bucketed = model.hot is not None
    if bucketed:  # same buckets on both sides: the context and its part
        df = df.withColumn("_part", model.part(word))
    keys = model.keys + ["_part"] * bucketed
    g = model.grams.select(*[F.col(k).alias(f"_g{k}") for k in keys], F.col("w").alias("_gw"), F.col("c").alias("_c"))
    h = model.contexts.select(*[F.col(k).alias(f"_h{k}") for k in keys], F.col("h").alias("_h"), F.col("e").alias("e"))
    # a bucketed model is streamed past the rows of its bucket, which are hashed: it is not sorted
    side = (lambda d: d.hint("shuffle_hash")) if bucketed else (lambda d: d)
    df = side(df).join(g, _and([F.col(f"_g{k}") == F.col(k) for k in keys] + [F.col("_gw") == F.col(word)]), "left")
    df = side(df).join(h, _and([F.col(f"_h{k}") == F.col(k) for k in keys]), "left")
    df = df.withColumn("p", smoothed(model, F.col("_c"), F.col("_h")))
    df = df.withColumn("e", F.coalesce("e", F.lit(math.log(model.vocab))))
    return df.drop(*[f"_g{k}" for k in keys], *[f"_h{k}" for k in keys], "_gw", "_c", "_h", *["_part"] * bucketed)


def _and(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def gram_scores(model: NgramModel) -> DataFrame:
    """(keys, w, c, lp): log2 probability of every n-gram of the corpus, from narrow distinct rows.  In a bucketed
    model (with the part of the context) from bucket to bucket, without a shuffle.

    In a plain one the keys pass through ``coalesce`` (they are never null): a join on all of them
    then shuffles by all of them, and not by a context that many n-grams share."""
    keys = model.keys + ["_part"] * (model.hot is not None)
    h = model.contexts.select(*[F.col(k).alias(f"_h{k}") for k in keys], "h")
    got = model.grams.join(h if model.hot is None else h.hint("shuffle_hash"), _and([F.col(k) == F.col(f"_h{k}") for k in keys]))
    named = [F.coalesce(F.col(k), F.lit("")) if model.hot is None else F.col(k) for k in keys]
    return got.select(*[c.alias(f"_g{k}") for c, k in zip(named, keys)], F.col("w").alias("_gw"), "c",
                      F.log2(smoothed(model, F.col("c"), F.col("h"))).alias("lp"))


def sentence_scores(sentences: DataFrame, model: NgramModel) -> DataFrame:
    """Sentence log2 probability.  Bigram model (S6): sum of log2 p(w_i | w_i-1), first
    word skipped (a 1-word sentence has no row).  Masked model (S4): every word is
    masked in turn and predicted from both neighbours.

    Every n-gram of the corpus has its probability in one table of distinct
    n-grams: one lookup per token, contexts are looked up once per n-gram.  With a bucketed
    model the most frequent n-grams go to the sentences, and only the other tokens go
    to the buckets, and from there back as sums."""
    tokens = (bigrams if model.order == 2 else trigrams)(sentences).select("sent_ord", "sid", *model.keys, "w")
    on = [F.col(k) == F.col(f"_g{k}") for k in model.keys] + [F.col("w") == F.col("_gw")]
    sums = [F.count("lp").alias("n_scored"), F.sum("lp").alias("log2_prob")]
    # the id is part of the key: as an aggregate (a string) it would make Spark sort all tokens
    key = ["sent_ord", F.col("sid").alias("sentence_id")]
    if model.hot is None:
        return tokens.join(gram_scores(model).drop("c"), _and(on)).groupBy(*key).agg(*sums)
    top = F.broadcast(cut_lineage(most_frequent(gram_scores(model), TOP_GRAMS).drop("c"), "top_ngrams"))
    near = cut_lineage(tokens.join(top, _and(on), "left").groupBy(*key).agg(*sums), "sentence_scores")
    # the id stays at home, but where a key has several
    alone = near.groupBy("sent_ord").count().where("count > 1").isEmpty()
    far_key = ["sent_ord"] if alone else key
    rest = tokens.join(top, _and(on), "left_anti").withColumn("_part", model.part())
    rest = rest.drop("sid") if alone else rest
    far = rest.join(gram_scores(model).drop("c").hint("shuffle_hash"), _and([*on, F.col("_part") == F.col("_g_part")])).groupBy(*far_key).agg(*sums)
    far = far.toDF(*["_so", "_si"][:len(far_key)], "_n", "_l")
    same = [F.col("sent_ord").eqNullSafe(F.col("_so"))] + ([] if alone else [F.col("sentence_id").eqNullSafe(F.col("_si"))])
    both = near.join(far, _and(same), "left")
    n = F.col("n_scored") + F.coalesce("_n", F.lit(0))
    return both.select("sent_ord", "sentence_id", n.alias("n_scored"), (F.coalesce("log2_prob", F.lit(0.0)) + F.coalesce("_l", F.lit(0.0))).alias("log2_prob")).where("n_scored > 0")


def _require_context(pairs: DataFrame) -> DataFrame:
    return require_columns(pairs, "sent_ord", "match_id", "prev_word", "next_word")


def _bare(c: str) -> Column:
    return F.regexp_replace(F.col(c), "^ ", "")


def target_probabilities(pairs: DataFrame, model: NgramModel, cols, key) -> DataFrame:
    """``key``, ``p_<col>`` per target column and the context's ``certainty``, from narrow
    rows (key, word, context), one per target column."""
    pairs = _require_context(pairs)
    key, cols = list(key), list(cols)
    require_columns(pairs, *key, *cols)
    before, after = F.coalesce("prev_word", F.lit(BOS)), F.coalesce("next_word", F.lit(EOS))
    context = [before.alias("prev")] if model.order == 2 else [before.alias("l"), after.alias("r")]
    # a null form has no probability
    words = F.array(*[F.struct(F.lit(i).alias("col"), _bare(c).alias("w")) for i, c in enumerate(cols)])
    narrow = pairs.select(*key, *context, F.explode(words).alias("x")).select(*key, *model.keys, "x.col", "x.w")
    return looked_up(narrow, model).groupBy(*key).agg(
        *[F.max(F.when((F.col("col") == i) & F.col("w").isNotNull(), F.col("p"))).alias(f"p_{c}") for i, c in enumerate(cols)],
        F.max(round_half_even(F.lit(1.0) - F.col("e") / F.lit(math.log(model.vocab)))).alias("certainty"))


def token_scores(pairs: DataFrame, model: NgramModel, cols=("form_grammatical", "form_ungrammatical"),
                 key=("sent_ord", "match_id")) -> DataFrame:
    """S3/S5 (and S9 for any list of target columns): score each target column
    in the context of the target position; ``certainty`` is the context's.

    ``pairs`` carries its neighbours (``masked_with_context``), so no sentence
    is read.  The narrow lookups meet the wide rows once at the end."""
    key, cols = list(key), list(cols)
    per = target_probabilities(pairs, model, cols, key)
    per = per.select(*[F.col(k).alias(f"_k{k}") for k in key], *[F.col(f"p_{c}") for c in cols],
                     *[surprisal(F.col(f"p_{c}")).alias(f"I_{c}") for c in cols], "certainty")
    return pairs.join(per, _and([F.col(k) == F.col(f"_k{k}") for k in key]), "left").drop(*[f"_k{k}" for k in key])


def _changed(model: NgramModel, word: Column) -> list[Column]:
    """The n-grams of a sentence that its target takes part in, as structs; NULL members where there is none."""
    col = F.col
    if model.order == 2:
        return [F.struct(col("prev_word").alias("prev"), word.alias("w")), F.struct(word.alias("prev"), col("next_word").alias("w"))]
    start, end = F.lit(BOS), F.lit(EOS)
    return [F.struct(F.coalesce("prev2_word", start).alias("l"), word.alias("r"), col("prev_word").alias("w")),
            F.struct(F.coalesce("prev_word", start).alias("l"), F.coalesce("next_word", end).alias("r"), word.alias("w")),
            F.struct(word.alias("l"), F.coalesce("next2_word", end).alias("r"), col("next_word").alias("w"))]


def sentence_pair_scores(pairs: DataFrame, sentences: DataFrame, model: NgramModel,
                         cols=("form_grammatical", "form_ungrammatical"), key=("sent_ord", "match_id")) -> DataFrame:
    """log2 probability of the sentence with each target filled in.

    Only the n-grams around the target change (two with the bigram model; with
    the masked model three, as the target is a neighbour of both its neighbours),
    so the score is the sentence's own sum, less those, plus the same of the
    filled-in form.  Adds ``n_scored`` and ``p_<col>`` (log2) and ``I_<col>`` = -p."""
    pairs = _require_context(pairs)
    key, cols = list(key), list(cols)
    require_columns(pairs, "form_grammatical", *key, *cols, *(["prev2_word", "next2_word"] if model.order == 3 else []))
    original = F.coalesce(F.col("match_token"), _bare("form_grammatical")) if "match_token" in pairs.columns else _bare("form_grammatical")
    steps = [F.struct(F.lit(i).alias("col"), x.alias("x")) for i, word in enumerate([original, *[_bare(c) for c in cols]]) for x in _changed(model, word)]
    narrow = pairs.select(*key, F.explode(F.array(*steps)).alias("s")).select(*key, "s.col", "s.x.*")
    got = looked_up(narrow.where(_and([F.col(k).isNotNull() for k in [*model.keys, "w"]])), model)
    part = lambda i: F.coalesce(F.sum(F.when(F.col("col") == i, F.log2("p"))), F.lit(0.0))
    per = got.groupBy(*key).agg(part(0).alias("_own"), *[part(i + 1).alias(f"_d{i}") for i in range(len(cols))])
    base = sentence_scores(sentences, model).select(F.col("sent_ord").alias("_so"), "n_scored", "log2_prob")
    per = per.select(*[F.col(k).alias(f"_k{k}") for k in key], "_own", *[f"_d{i}" for i in range(len(cols))])
    out = pairs.join(per, _and([F.col(k) == F.col(f"_k{k}") for k in key]), "left").join(base, F.col("sent_ord") == F.col("_so"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))  # noqa: E731  a one-word sentence scores nothing
    for i, c in enumerate(cols):
        out = out.withColumn(f"p_{c}", F.when(F.col(c).isNotNull(), zero("log2_prob") - zero("_own") + zero(f"_d{i}")))
        out = out.withColumn(f"I_{c}", surprisal(F.col(f"p_{c}"), is_log=True))
    out = out.withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    return out.drop("_so", "_own", "log2_prob", *[f"_d{i}" for i in range(len(cols))], *[f"_k{k}" for k in key])


def ood_average(picks: DataFrame, model: NgramModel, key=("sent_ord", "match_id")) -> DataFrame:
    """Mean probability of each row's OOD pairs (scored in the row's
    own context) and the surprisal of that mean.  The picks themselves are not
    read again: sentence id and pick number travel in the key."""
    key = list(key)
    cols = ("ood_form_grammatical", "ood_form_ungrammatical")
    s = target_probabilities(picks, model, cols, [*key, "sentence_id", "pick"])
    agg = s.groupBy(*key, "sentence_id").agg(*[F.avg(f"p_{c}").alias(c.replace("ood_form", "ood_avg_p")) for c in cols])
    return agg.select(*key, "sentence_id", "ood_avg_p_grammatical", "ood_avg_p_ungrammatical",
                      surprisal("ood_avg_p_grammatical").alias("ood_avg_I_grammatical"),
                      surprisal("ood_avg_p_ungrammatical").alias("ood_avg_I_ungrammatical"))


# --- model scorers (S1-S5, S7) -------------------------------------------------

TASKS = ("mlm", "ntp")
LEVELS = ("token-level", "sentence-level")


def batches_by_length(lengths: list[int], budget: int) -> list[list[int]]:
    """Places in batches: shortest first, the longest of a batch times its size within ``budget``;
    a text over the budget is a batch of its own."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and lengths[i] * (len(out[-1]) + 1) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def evaluate(dataset: DataFrame, scorer_factory: Callable, task_type: str,
             evaluation_type: str = "token-level",
             evaluation_cols=("form_grammatical", "form_ungrammatical"),
             entropy_topk: int = 100, row_limit: int | None = None,
             order_cols=("sentence_id", "match_id"), token_budget: int = 16_384,
             token_count: Callable[[str], int] = lambda text: len(text.split()) + 2) -> DataFrame:
    """Score every row with a user model.

    ``scorer_factory()`` is called once per Python worker and must return an
    object with ``score_batch(texts, targets) -> scores``, where ``texts`` is an
    array of strings, ``targets`` an array with a row of targets per text, and
    ``scores`` has a row of numbers per text: probabilities at token level,
    log-probabilities at sentence level.  At token level it returns ``(scores,
    certainties)`` and is also given ``entropy_topk=``.  Text is ``masked_text`` for
    MLM and for sentence-level NTP, ``prompt_text`` for token-level NTP.  ``row_limit``:
    the first n rows by ``order_cols``; None for all, 0 is an error.

    Only a row number, the text and the targets cross to Python; scores are joined
    back on the row number of the stored dataset.  Texts of an Arrow batch
    are sorted by length, and a call gets as many as, padded to the longest, stay
    within ``token_budget`` tokens (``token_count`` of a text; a longer text is
    scored alone).  A NULL text is scored as an empty one."""
    if task_type not in TASKS:
        raise ValueError(f"task_type must be one of {TASKS}")
    if evaluation_type not in LEVELS:
        raise ValueError(f"evaluation_type must be one of {LEVELS}")
    text_col = "prompt_text" if (task_type == "ntp" and evaluation_type == "token-level") else "masked_text"
    cols = list(evaluation_cols)
    require_columns(dataset, text_col, *cols)
    if row_limit is not None and row_limit < 1:
        raise ValueError(f"row_limit is {row_limit}: give None to score all rows")
    if row_limit is not None:                                       # S7: the first n rows
        dataset = dataset.orderBy(*order_cols).limit(row_limit)
    token_level = evaluation_type == "token-level"
    names = [f"p_{c}" for c in cols] + (["certainty"] if token_level else [])
    stored = cut_lineage(dataset.withColumn("_row", F.monotonically_increasing_id()), "to_score")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer = scorer_factory()
        for batch in batches:
            texts = np.array([t or "" for t in batch.column(1).to_pylist()] + [""], dtype=object)[:-1]
            targets = np.empty((len(texts), len(cols)), dtype=object)
            for j in range(len(cols)):
                targets[:, j] = batch.column(2 + j).to_pylist()
            result = np.empty((len(texts), len(names)))
            for at in batches_by_length([token_count(t) for t in texts], token_budget):
                if token_level:
                    scores, sure = scorer.score_batch(texts[at], targets[at], entropy_topk=entropy_topk)
                    result[at, len(cols)] = np.asarray(sure, dtype=float)
                else:
                    scores = scorer.score_batch(texts[at], targets[at])
                result[at, :len(cols)] = np.asarray(scores, dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(result[:, j]) for j in range(len(names)))], names=["_key", *names])

    narrow = stored.select("_row", F.col(text_col).alias("t"), *[F.col(c).cast("string").alias(f"c{j}") for j, c in enumerate(cols)])
    schema = T.StructType([T.StructField("_key", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    scored = stored.join(narrow.mapInArrow(run, schema), F.col("_row") == F.col("_key"), "left").drop("_row", "_key")
    for c in cols:
        scored = scored.withColumn(f"I_{c}", surprisal(F.col(f"p_{c}"), is_log=not token_level))
    return scored


def evaluate_file(spark, path: str, score: Callable[[DataFrame], DataFrame], out_path: str | None = None,
                  fmt: str | None = None, targets=("form_grammatical", "form_ungrammatical")) -> DataFrame:
    """Load a stored pair table (checked), score it, check that it was
    scored, and store the result if ``out_path`` is given.  ``score`` maps the
    table to the scored one: ``evaluate`` or ``token_scores`` with its options."""
    from ..functions.metrics import require_scored

    scored = require_scored(score(require_columns(tables.load_pairs(spark, path, fmt), *targets)), *targets)
    if out_path is None:
        return scored
    tables.save_table(scored, out_path, fmt or "parquet")
    return spark.read.parquet(out_path) if (fmt or "parquet") == "parquet" else tables.load_evaluation(spark, out_path, fmt)
