"""Column expressions for the string operators (all JVM built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Forms never entered into the lexicon (other punctuation stays).
LEXICON_EXCLUDED_FORMS = [".", ",", "!", "?", "*"]
# Tokens the legacy aligner may skip when they are absent from the text.
SKIPPABLE_TOKENS = ["_", " "]
DEFAULT_MASK = "[MASK]"
PROMPT_CUTOFF = "[PROMPT_CUTOFF]"
TRUNCATE_AT = 50
TRUNCATE_SUFFIX = "..."


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def starts_upper(c) -> Column:
    """True when the first character is upper case (Python ``str.isupper``
    on one character); NULL for NULL or empty strings."""
    c = col_(c)
    return F.when(F.length(c) > 0, c.rlike(r"^\p{IsUppercase}"))


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes every Unicode whitespace at both ends
    (``trim`` only removes spaces)."""
    return F.regexp_replace(F.regexp_replace(col_(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def truncate_text(c, max_len: int = TRUNCATE_AT) -> Column:
    """First ``max_len`` characters plus ``...`` when longer; NULL passes."""
    c = col_(c)
    return F.when(F.length(c) > max_len,
                  F.concat(F.substring(c, 1, max_len), F.lit(TRUNCATE_SUFFIX))).otherwise(c)


def count_occurrences(c, token: str) -> Column:
    """Non-overlapping occurrences of a literal ``token`` in ``c``."""
    c = col_(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / F.lit(len(token))).cast("int")


def parse_feats(c) -> Column:
    """A3: ``A=x|B=y`` -> map with lower-cased keys; ``_`` or NULL -> empty map."""
    c = col_(c)
    parsed = F.transform_keys(F.str_to_map(c, F.lit(r"\|"), F.lit("=")), lambda k, v: F.lower(k))
    return F.when(c.isNull() | (c == "_") | (c == ""), F.create_map().cast("map<string,string>")).otherwise(parsed)


def feat_key(feats) -> Column:
    """Hashable, order-free key for a feature map (maps cannot be
    join keys).  NULL values are dropped first, so ``{a: NULL}`` equals
    ``{}`` -- the null-safe equality the reference applies per column."""
    m = F.map_filter(col_(feats), lambda k, v: v.isNotNull())
    return F.to_json(F.array_sort(F.map_entries(m)))


# marker for "feature absent" in a feature key (values never hold control characters)
_ABSENT = "\u0002"
_SEP = "\u0001"


def feat_key_fixed(feats, names: list[str]) -> Column:
    """C13 over a known, bounded list of feature names: one slot per name,
    an absent (or NULL) value gets a marker.  Built from map lookups and
    ``concat_ws`` only, so it runs in generated code (``feat_key`` needs
    array lambdas and JSON)."""
    m = col_(feats)
    return F.concat_ws(_SEP, *[F.coalesce(F.concat(F.lit("="), m[n]), F.lit(_ABSENT)) for n in sorted(names)])


def nullif_nan_string(c) -> Column:
    """B3 (legacy): the literal string ``nan`` becomes NULL."""
    c = col_(c)
    return F.when(c == "nan", F.lit(None).cast("string")).otherwise(c)
