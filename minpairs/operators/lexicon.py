"""Lexicon operators: B1-B8, C11.

The lexicon keeps features as one MAP column (schema independent of the
treebank); the wide ``feats__<name>`` form is a projection over the
distinct feature names, which are a small, bounded vocabulary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEXICON_EXCLUDED_FORMS, nullif_nan_string
from ..sources.treebank import Treebank

FEAT_PREFIX = "feats__"
MAX_FEATURES = 10_000
HEAD = 1000  # rows of a loaded lexicon that are looked at before all of them
UNIVERSAL_COLUMNS = ("form", "lemma", "upos", "xpos")


def lexicon(tokens: DataFrame, legacy_nan: bool = False) -> DataFrame:
    """B1+B2(+B3): one row per word with integer id, punctuation removed.

    ``token_id`` is the CoNLL-U id minus one, as in the reference.
    ``legacy_nan`` turns the string ``nan`` into NULL everywhere (the
    reference does this; it also erases a real word "nan")."""
    t = tokens.where(F.col("tid").isNotNull() & ~F.coalesce(F.col("form").isin(LEXICON_EXCLUDED_FORMS), F.lit(False)))
    cols = {c: F.col(c) for c in UNIVERSAL_COLUMNS}
    feats = F.col("feats")
    if legacy_nan:
        cols = {c: nullif_nan_string(v) for c, v in cols.items()}
        feats = F.map_filter(F.transform_values(feats, lambda k, v: nullif_nan_string(v)), lambda k, v: v.isNotNull())
    return t.select(
        F.col("sid").alias("sentence_id"),
        (F.col("tid") - 1).alias("token_id"),
        *[v.alias(c) for c, v in cols.items()],
        feats.alias("feats"),
        "sent_ord",
        "tid",
    )


def feature_names(lex: DataFrame) -> DataFrame:
    """Distinct morphological feature names (lower-cased)."""
    return lex.select(F.explode(F.map_keys("feats")).alias("feature")).distinct()


def collect_feature_names(lex: DataFrame) -> list[str]:
    """Driver copy of B5; the feature vocabulary is small by nature (tens of
    names per treebank).  More than ``MAX_FEATURES`` means a broken FEATS
    column: that raises, nothing is cut.  Where the column says which features it can hold (a loaded wide
    table) and its head has them all, the rest need not be read."""
    can_be = lex.schema["feats"].metadata.get("features")
    if can_be and {r[0] for r in feature_names(lex.limit(HEAD)).collect()} == set(can_be):
        return sorted(can_be)
    names = [r[0] for r in feature_names(lex).limit(MAX_FEATURES + 1).collect()]
    if len(names) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} feature names, such as {sorted(names)[:5]}: is the FEATS column broken?")
    return sorted(names)


def wide(lex: DataFrame, features: list[str] | None = None, prefix: str = FEAT_PREFIX,
         keep: tuple[str, ...] = ("sentence_id", "token_id") + UNIVERSAL_COLUMNS) -> DataFrame:
    """One column per feature name."""
    if features is None:
        features = collect_feature_names(lex)
    return lex.select(*keep, *[F.col("feats")[f].alias(prefix + f) for f in features])


def morphological_features(lex: DataFrame, features: list[str] | None = None) -> DataFrame:
    """The wide lexicon with the ``feats__`` prefix stripped."""
    return wide(lex, features, prefix="")


def _check_keys(lex: DataFrame, morph: dict, universal: dict) -> None:
    bad_u = [k for k in universal if k not in UNIVERSAL_COLUMNS]
    bad_m = []
    if morph:
        known = set(collect_feature_names(lex))
        bad_m = [k for k in morph if k.lower() not in known]
    if bad_u or bad_m:
        raise KeyError(f"no such column or feature: {bad_u + bad_m} (columns {list(UNIVERSAL_COLUMNS)}; features are lower-cased)")


def constraint(morph: dict | None = None, universal: dict | None = None, feats: str = "feats") -> Column:
    """Conjunction of null-safe equalities (a None value asks for the
    feature to be absent)."""
    conds = [F.col(feats)[k.lower()].eqNullSafe(F.lit(v)) for k, v in (morph or {}).items()]
    conds += [F.col(k).eqNullSafe(F.lit(v)) for k, v in (universal or {}).items()]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def candidate_set(lex: DataFrame, morph: dict | None = None, universal: dict | None = None,
                  validate: bool = True) -> DataFrame:
    """Lexicon rows matching the given features."""
    morph, universal = morph or {}, universal or {}
    if validate:
        _check_keys(lex, morph, universal)
    return lex.where(constraint(morph, universal))


def lookup(lex: DataFrame, keys: DataFrame, sentence_col: str | None = None,
           token_col: str = "token_id") -> DataFrame:
    """C11: features and lemma of given (sentence, token) keys, as a join on
    the sentence key ``sent_ord`` where the keys have it, else on the id."""
    sentence_col = sentence_col or ("sent_ord" if "sent_ord" in keys.columns else "sentence_id")
    on = "sent_ord" if sentence_col == "sent_ord" else "sentence_id"
    k = keys.select(F.col(sentence_col).alias(on), F.col(token_col).alias("token_id")).distinct()
    return k.join(lex, [on, "token_id"], "inner")


def lookup_in(treebank: Treebank, keys: DataFrame, token_col: str = "token_id") -> DataFrame:
    """C11 on a treebank, for keys with ``sent_ord``: the rows of ``lookup`` with its lexicon.
    Sentences meet their keys, and only the words asked for become lexicon rows."""
    places = keys.select("sent_ord", (F.col(token_col) + 1).cast("int").alias("tid"))
    lex = lexicon(treebank.tokens_at(places))
    return lex.select("sent_ord", "token_id", *[c for c in lex.columns if c not in ("sent_ord", "token_id")])
