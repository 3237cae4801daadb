"""The treebank data model shared by every source.

``sentences``: one row per sentence --
    sid STRING, sent_ord (any orderable type), text STRING,
    tokens ARRAY<TOKEN>, plus source columns (file_ord / doc_id, ...).
``tokens``: ``sentences`` exploded, one row per token line --
    sid, sent_ord, and the TOKEN fields below.

TOKEN fields: ``pos`` (0-based position in the token list, ranges
included), ``id`` (raw id text), ``tid`` (integer id, NULL for range and
empty-node rows), ``range_from``/``range_to`` (set on multi-word range
rows such as ``18-19``), ``form lemma upos xpos``, ``feats``
(MAP<STRING,STRING>, lower-cased keys), ``head`` (INT, 0 = root),
``deprel deps misc``.

The token array lives inside the sentence row, so every per-sentence
operator (alignment, masking, one-node patterns) is a narrow map with no
shuffle; only operators that relate tokens across sentences (lexicon
index, n-gram counts) or multi-node patterns shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_TYPE = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("tid", T.IntegerType()),
    T.StructField("range_from", T.IntegerType()),
    T.StructField("range_to", T.IntegerType()),
    T.StructField("form", T.StringType()),
    T.StructField("lemma", T.StringType()),
    T.StructField("upos", T.StringType()),
    T.StructField("xpos", T.StringType()),
    T.StructField("feats", T.MapType(T.StringType(), T.StringType())),
    T.StructField("head", T.IntegerType()),
    T.StructField("deprel", T.StringType()),
    T.StructField("deps", T.StringType()),
    T.StructField("misc", T.StringType()),
])
TOKEN_FIELDS = [f.name for f in TOKEN_TYPE.fields]


class Treebank(NamedTuple):
    """``sentences`` and ``tokens`` come from the same input; ``tokens`` is
    built by the cheapest route a source has (an exploded, codegen'd
    projection rather than array lambdas), and a query that needs only
    one of them never computes the other (column pruning)."""
    sentences: DataFrame
    token_frame: DataFrame | None = None
    array_frame: DataFrame | None = None  # sentences without the token array, where that saves building it
    narrow: Callable | None = None  # token fields -> sentences whose ``tokens`` are words with these fields only
    word: Callable | None = None  # word id -> its token, from a sentence's other columns
    ordered: Callable | None = None  # () -> the treebank with its sentences in order, from a sort of sentences instead of tokens
    keyed: Callable | None = None  # (sent_ord, ids) -> the tokens of these words, from a join of sentences instead of tokens

    @property
    def arrays(self) -> DataFrame:
        """Sentence rows for what reads the word arrays only (n-grams)."""
        return self.array_frame if self.array_frame is not None else self.sentences

    @property
    def tokens(self) -> DataFrame:
        return self.token_frame if self.token_frame is not None else explode_tokens(self.sentences)

    @property
    def tokens_in_order(self) -> DataFrame:
        """The tokens, sorted by ``(sent_ord, tid)``; range rows may stand anywhere."""
        return self.tokens.orderBy("sent_ord", "tid") if self.ordered is None else self.ordered().tokens

    def tokens_at(self, keys: DataFrame) -> DataFrame:
        """The tokens at the distinct places ``(sent_ord, tid)`` of ``keys``."""
        if self.keyed is None:
            return self.tokens.join(keys.select("sent_ord", "tid").distinct(), ["sent_ord", "tid"], "left_semi")
        return self.keyed(keys.where("tid is not null").groupBy("sent_ord").agg(F.collect_set("tid").alias("ids")))

    def persist(self) -> "Treebank":
        return Treebank(self.sentences.persist(), None if self.token_frame is None else self.token_frame.persist())

    def write(self, path: str, mode: str = "overwrite") -> "Treebank":
        """Parse once, persist: store both tables as parquet and return a
        treebank that reads them (scans then prune columns and push
        filters down)."""
        spark = self.sentences.sparkSession
        self.sentences.write.mode(mode).parquet(f"{path}/sentences")
        self.tokens.write.mode(mode).parquet(f"{path}/tokens")
        return read_treebank(spark, path)


def read_treebank(spark, path: str) -> Treebank:
    return Treebank(spark.read.parquet(f"{path}/sentences"), spark.read.parquet(f"{path}/tokens"))


def explode_tokens(sentences: DataFrame) -> DataFrame:
    """One row per token line (narrow: no shuffle).

    ``inline_outer`` + a NULL filter instead of ``inline``: for the plain
    generator Catalyst infers ``size(tokens) > 0`` and pushes it below the
    projections, which evaluates the whole token array a second time."""
    return explode_outer_rows(sentences.select("sid", "sent_ord", F.inline_outer("tokens")), "pos")


def explode_outer_rows(df: DataFrame, probe: str) -> DataFrame:
    return df.where(F.col(probe).isNotNull())


def words_of(tokens_col="tokens"):
    """Word rows only (integer ids), in id order."""
    c = F.col(tokens_col) if isinstance(tokens_col, str) else tokens_col
    return F.filter(c, lambda t: t["tid"].isNotNull())


ALIGN_COLUMNS = ["forms_all", "tids_all", "forms_surface", "tids_surface", "spans", "words"]


def alignment_columns(tokens_col="tokens") -> list:
    """Parallel arrays used by alignment and n-gram counting, derived from a
    token array: every token line (``*_all``, legacy order), the surface
    pieces (``*_surface``: ranges plus uncovered words; NULL id for a
    range), the range spans and the word forms in id order (``words``).  Sources that can build them without lambdas (see
    ``sources.derived``) provide them directly."""
    c = F.col(tokens_col)
    # without ranges and empty nodes all are words, and no lambda is called
    no_range = F.size(F.array_compact(c["range_from"])) == 0
    plain = no_range & (F.size(F.array_compact(c["tid"])) == F.size(c))
    spans = F.transform(ranges_of(c), lambda r: F.struct(r["range_from"].alias("range_from"),
                                                         r["range_to"].alias("range_to")))
    surf = surface_of(c, spans)
    return [
        c["form"].alias("forms_all"),
        c["tid"].alias("tids_all"),
        F.when(plain, c["form"]).otherwise(surf["form"]).alias("forms_surface"),
        F.when(plain, c["tid"]).otherwise(surf["tid"]).alias("tids_surface"),
        F.when(no_range, F.array().cast("array<struct<range_from:int,range_to:int>>")).otherwise(spans).alias("spans"),
        F.when(plain, c["form"]).otherwise(words_of(c)["form"]).alias("words"),
    ]


def with_alignment_columns(sentences: DataFrame) -> DataFrame:
    if all(c in sentences.columns for c in ALIGN_COLUMNS):
        return sentences
    if "tokens" not in sentences.columns:
        raise ValueError("sentences need either the alignment arrays or a token array")
    return sentences.select("*", *alignment_columns("tokens"))


def ranges_of(tokens_col="tokens"):
    """Multi-word range rows of a sentence."""
    c = F.col(tokens_col) if isinstance(tokens_col, str) else tokens_col
    return F.filter(c, lambda t: t["range_from"].isNotNull())


def surface_of(tokens_col="tokens", ranges_col=None):
    """Surface rows: range rows plus words not covered by a range, i.e. the
    pieces that actually appear in the sentence text, in order.

    Pass ``ranges_col`` (an already computed ``ranges_of`` column) so the
    range list is not rebuilt inside the per-token lambda."""
    c = F.col(tokens_col) if isinstance(tokens_col, str) else tokens_col
    ranges = ranges_of(c) if ranges_col is None else (
        F.col(ranges_col) if isinstance(ranges_col, str) else ranges_col)

    def covered(t):
        return F.exists(ranges, lambda r: (t["tid"] >= r["range_from"]) & (t["tid"] <= r["range_to"]))

    return F.filter(c, lambda t: t["range_from"].isNotNull() | (t["tid"].isNotNull() & ~covered(t)))
