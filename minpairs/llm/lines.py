"""Line dedup over overlapping windows of three consecutive lines.

A line is cut into units after its sentence ends, so that a passage inside long lines is
found too; a line without one is a single unit. Windows of three units run over the
units that hold a word; a text with fewer has one window of all it has. Equal windows are
found globally by a 128-bit hash, counted map-side first; of each, the first occurrence
by document and position stays. Later occurrences cover their units (less those that the
first occurrence itself covers); covered positions are merged and removed, per row.
Copies of a whole text are set aside first: their windows are all repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, stage
from .rules import _let

SPAN = 3
# a sentence end, the blanks after it, and what the next unit begins with
SENTENCE_END = "([.!?][\"')\\]]*[ \t]+)([^ \t\r\x0b\x0c])"
SPACES = " \t\n\x0b\x0c\r"  # what words are separated by
BLANKS = " \t\r"  # not compared at either end of a unit
BROADCAST_SPANS = 8_000_000  # covered spans (4 bytes each) that are broadcast at most; beyond, texts are shuffled


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES)) != ""


def _cut(line: Column) -> Column:
    """Units of a line (which holds no line feed). All units of a line with a word have one."""
    return F.split(F.regexp_replace(line, SENTENCE_END, "$1\n$2"), "\n", -1)


def _scan(text: Column) -> Column:
    """Struct of n_lines, n_units and the hashes (h1, h2) of all windows, in order; lines and units with a word."""
    def hashed(units: Column) -> Column:
        def at(k: Column) -> Column:
            part = F.slice(units, k, SPAN)
            return F.struct(F.xxhash64(part).alias("h1"), F.xxhash64(F.lit(1), part).alias("h2"))
        return F.struct(F.size(units).alias("n_units"),
                        F.when(F.size(units) >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(units) - SPAN + 1, F.lit(1))), at)).alias("w"))

    def of(worded: Column) -> Column:
        units = F.flatten(F.transform(worded, lambda x: F.transform(_cut(x), lambda u: F.trim(u, F.lit(BLANKS)))))
        return F.struct(F.size(worded).alias("n_lines"), _let(units, hashed).alias("u"))

    return _let(F.filter(_lines(text), _has_word), of)


def _without(text: Column, spans: Column) -> Column:
    """Struct of the number of units that ``spans`` cover, and the text without them."""
    def strip(units: Column) -> Column:  # (line, unit, whether it has a word)
        def rest(places: Column) -> Column:
            covered = F.flatten(F.transform(spans, lambda s: F.sequence(F.shiftright(s, 2), F.shiftright(s, 2) + F.pmod(s, F.lit(4)) - 1)))
            removed = F.array_distinct(F.filter(F.transform(covered, lambda j: F.get(places, j)), lambda p: p.isNotNull()))
            kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(units) - 1), removed), lambda p: F.get(units, p))
            lined = _let(kept, lambda x: F.transform(x, lambda u, i: F.when(
                (i > 0) & (F.get(x, i - 1)["line"] != u["line"]), F.concat(F.lit("\n"), u["unit"])).otherwise(u["unit"])))
            return F.struct(F.size(removed).cast("long").alias("n"), F.array_join(lined, "").alias("text"))
        return _let(F.filter(F.transform(units, lambda u, p: F.when(u["word"], p)), lambda p: p.isNotNull()), rest)

    units = F.flatten(F.transform(_lines(text), lambda x, i: F.transform(
        F.when(_has_word(x), _cut(x)).otherwise(F.array(x)), lambda u: F.struct(i.alias("line"), u.alias("unit"), _has_word(u).alias("word")))))
    return _let(units, strip)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_units, n_removed, text``; ``n_lines`` and
    ``n_units`` count lines and units with a word, ``n_removed`` the units that went.

    * a line all of whose units go, goes with its line feed; blank lines are never removed;
    * null text stays null with no lines; fewer than three worded units: one window of
      all of them, equal only to a text that has the same ones and no others;
    * repeated rows (same id, same text) count as one occurrence and are treated
      alike; an id that repeats with other texts: each text is a document of its own;
      null ids: each row is a document of its own, after all others;
    * texts of any length are read whole; a very frequent window travels as one row
      per task; empty table: empty result; extra columns of any name are ignored."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    scanned = src.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), F.explode(F.array(_scan(F.col("text")))).alias("s"))
    docs = stage(scanned.select("doc_id", "text", "row", "t1", "t2", "s.n_lines", "s.u.n_units", "s.u.w"), "line_docs")

    # copies of a whole text bring no windows: of each text the first row does. A copy loses all its
    # units; a row that repeats the first one's id is the same document, ``home`` is the row to go by
    narrow = docs.where("n_units > 0").select("doc_id", "row", "t1", "t2")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    heads = stage(narrow.groupBy("t1", "t2").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1")
                  .select("t1", "t2", F.col("f.doc_id").alias("f_doc"), F.col("f.row").alias("home")), "first_texts")
    others = narrow.join(bounded(heads), ["t1", "t2"]).where("row <> home")
    others = stage(others.select(F.col("row").alias("o_row"), "home", (~F.coalesce(F.col("doc_id") == F.col("f_doc"), F.lit(False))).alias("copy")), "other_texts")

    fresh = docs.where("n_units > 0").select("doc_id", "row", "w").join(bounded(others.select("o_row")), F.col("row") == F.col("o_row"), "left_anti")
    windows = fresh.select("doc_id", "row", F.posexplode("w").alias("k", "h")).select("doc_id", "row", "k", "h.h1", "h.h2")  # stored with their rows
    # all windows are only counted; where an occurrence stands matters for the repeated ones alone
    hashes = stage(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated")
    again = stage(windows.join(hashes, ["h1", "h2"], "left_semi"), "occurrences")
    spot = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "k")
    first = stage(again.groupBy("h1", "h2").agg(F.min(spot).alias("f")).select("h1", "h2", F.col("f.row").alias("f_row"), F.col("f.k").alias("f_k")), "first_places")
    own = F.col("row") == F.col("f_row")
    later = again.join(first, ["h1", "h2"]).where(~(own & (F.col("k") == F.col("f_k"))))
    begin = F.when(own, F.greatest(F.col("k"), F.col("f_k") + SPAN)).otherwise(F.col("k"))
    spans = later.select("row", "k", begin.alias("begin")).where(F.col("begin") < F.col("k") + SPAN)
    # a span is its first unit and its length, in one number: at most one per unit and document
    gone = stage(spans.groupBy(F.col("row").alias("g_row")).agg(F.collect_set(F.col("begin") * 4 + F.col("k") + SPAN - F.col("begin")).alias("spans")), "covered")
    size = gone.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]

    rows = docs.select("doc_id", "text", "row", "n_lines", "n_units").join(bounded(others), F.col("row") == F.col("o_row"), "left")
    joined = rows.join(bounded(gone) if size <= BROADCAST_SPANS else gone, F.coalesce("home", "row") == F.col("g_row"), "left")
    blank = F.struct(F.col("n_units").cast("long").alias("n"), F.array_join(F.filter(_lines(F.col("text")), lambda x: ~_has_word(x)), "\n").alias("text"))
    same = F.struct(F.lit(0).cast("long").alias("n"), F.col("text").alias("text"))
    result = F.when(F.coalesce("copy", F.lit(False)), blank).when(F.col("spans").isNotNull(), _without(F.col("text"), F.col("spans"))).otherwise(same)
    return joined.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_units").cast("long").alias("n_units"),
                         F.explode(F.array(result)).alias("s")).select("doc_id", "n_lines", "n_units", F.col("s.n").alias("n_removed"), F.col("s.text").alias("text"))
