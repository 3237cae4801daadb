"""Ranked lexical search over buckets of impact vectors ordered by length (LEMP style).

A document is the vector of its terms' impacts, restricted to the terms of the queries;
a query is the vector of its terms' weights; the score is their inner product. Inside
every task documents are sorted by the length (Euclidean norm) of their vectors and
cut into buckets. For a query whose k-th best score so far is ``t``:

* a bucket whose longest vector times the query's length is below ``t`` is skipped
  (Cauchy-Schwarz);
* else the heaviest query terms are its focus: as many as it takes for the rest of the
  query, times the longest vector, to fall below ``t``. Documents without a focus term
  cannot reach ``t`` and are never touched. For the others the part over the focus is
  summed from the bucket's postings, and what the remaining coordinates can add at most,
  ``|rest of query| * |rest of document|``, is bounded by the coordinates seen;
* survivors are scored exactly in 64-bit integers, and ``t`` rises.

The longest vectors go first, in a round of their own; its k-th best scores are where
the second round starts, over all other documents. Bounds are rounded upwards, so that
no document that reaches ``t`` (also one that equals it) is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stage, text_batches

# fixed value: ASCII characters that separate terms
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS = 200_000  # query terms that are searched for in one pass over the documents
BUCKET = 2048  # documents of a bucket
FIRST_SHARE = 0.02  # about this part of the documents, the longest vectors, goes first
SLACK = 1 + 1e-9  # bounds are doubles: rounded upwards by this factor
NO_ID = 2**63 - 1  # stands for a null id inside a task; such documents come last among equals

_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: Column) -> Column:
    """Array of a text's terms in order; null has none."""
    return F.filter(F.split(ascii_lower(text), SEPARATORS, -1), lambda x: x != "")


def split_terms(text: str | None) -> list[bytes]:
    """The same inside a task; bytes from 128 up belong to letters."""
    return (text or "").encode("utf-8", "replace").translate(_TO_TERMS).split()


def vectors(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, term, tf`` per document: number of terms, and those of ``vocabulary`` (its places, ascending) with their counts."""
    blob = "\0".join(vocabulary).encode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(blob.split(b"\0"))}
        place.pop(b"", None)
        for b in batches:
            n, at, term, tf = [], [0], [], []
            for text in b.column(1):
                found = split_terms(text.as_py())
                n.append(len(found))
                known = np.array([i for i in map(place.get, found) if i is not None], dtype=np.int32)
                t, c = np.unique(known, return_counts=True)
                term.append(t)
                tf.append(c.astype(np.int64))
                at.append(at[-1] + len(t))
            at = pa.array(at, pa.int32())
            flat = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)]).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat(term, np.int32))),
                                              pa.ListArray.from_arrays(at, pa.array(flat(tf, np.int64)))], names=["doc_id", "n", "term", "tf"])

    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n long, term array<int>, tf array<long>")


def impacts(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``doc_id, term, impact, norm`` of the documents that hold a query term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("term").offsets.to_numpy().astype(np.int64)
            at -= at[0]
            m = np.array([10 + 90 * n * n_docs // n_terms for n in b.column("n").to_pylist()], dtype=np.int64)
            tf = b.column("tf").flatten().to_numpy(zero_copy_only=False)
            v = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(at)))
            norm = np.sqrt(np.add.reduceat(v.astype(np.float64) ** 2, at[:-1]))
            offsets = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(offsets, b.column("term").flatten()),
                                              pa.ListArray.from_arrays(offsets, pa.array(v)), pa.array(norm)], names=["doc_id", "term", "impact", "norm"])

    return rows.where(F.size("term") > 0).mapInArrow(run, "doc_id long, term array<int>, impact array<long>, norm double")


class Queries:
    """Queries of one block: per query its terms by falling weight, and the lengths of what follows each."""

    def __init__(self, places: list[np.ndarray], weights: np.ndarray):
        self.terms, self.weights, self.rest = [], [], []
        for p in places:
            p = p[np.argsort(-weights[p], kind="stable")]
            w = weights[p]
            self.terms.append(p)
            self.weights.append(w)
            self.rest.append(np.sqrt(np.concatenate([np.cumsum((w.astype(np.float64) ** 2)[::-1])[::-1], [0.0]])))


class Bucket:
    """Some documents with the postings of their terms."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, term: np.ndarray, impact: np.ndarray, norm: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.ids, self.norm, self.longest = ids, norm, float(norm.max()) * SLACK
        self.term, self.impact = term[order], impact[order]
        self.doc = np.repeat(np.arange(len(ids)), np.diff(at))[order]

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of ``terms``, and which term each is of."""
        lo, hi = np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(terms)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which], which

    def reaching(self, terms: np.ndarray, weights: np.ndarray, rest: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the documents that score ``least`` or more, and above 0."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if rest[0] * self.longest < least:
            return none
        focus = int(np.searchsorted(-(rest * self.longest), -least, side="right")) if least else len(terms)  # rest[focus] * longest < least
        focus = min(focus, len(terms))
        at, which = self.postings(terms[:focus])
        if not len(at):
            return none
        doc, v = self.doc[at], self.impact[at].astype(np.float64)
        part = np.bincount(doc, weights[which] * v, len(self.ids))
        seen = np.bincount(doc, v * v, len(self.ids))
        bound = part + rest[focus] * np.sqrt(np.maximum(self.norm ** 2 * SLACK - seen, 0))
        keep = np.bincount(doc, minlength=len(self.ids)).astype(bool) & (bound * SLACK >= least)
        if not keep.any():
            return none
        score = np.zeros(len(self.ids), np.int64)
        np.add.at(score, doc, weights[which] * self.impact[at])
        if focus < len(terms):
            at, which = self.postings(terms[focus:])
            mine = keep[self.doc[at]]
            at, which = at[mine], which[mine] + focus
            np.add.at(score, self.doc[at], weights[which] * self.impact[at])
        keep &= (score >= max(least, 1))
        return self.ids[keep], score[keep]


def best(rows: DataFrame, queries: Queries, names: list[int], least: list[int], k: int, bucket: int = BUCKET) -> DataFrame:
    """``item, doc_id, score``: of every task, its ``k`` best documents per query that reach ``least`` of the query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, top = list(least), {}

        def visit(b: Bucket) -> None:
            for q in range(len(names)):
                ids, scores = b.reaching(queries.terms[q], queries.weights[q], queries.rest[q], limit[q])
                if not len(ids):
                    continue
                if q in top:
                    ids, scores = np.concatenate([top[q][0], ids]), np.concatenate([top[q][1], scores])
                order = np.lexsort((ids, -scores))[:k]
                top[q] = ids[order], scores[order]
                if len(order) == k:
                    limit[q] = max(limit[q], int(scores[order[-1]]))

        for batch in batches:
            for lo in range(0, batch.num_rows, bucket):
                x = batch.slice(lo, bucket)
                at = x.column("term").offsets.to_numpy()
                visit(Bucket(x.column("doc_id").fill_null(NO_ID).to_numpy(), at - at[0], x.column("term").flatten().to_numpy(),
                             x.column("impact").flatten().to_numpy(), x.column("norm").to_numpy()))
        for q, (ids, scores) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(ids), pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(scores)],
                                             names=["item", "doc_id", "score"])

    return rows.sortWithinPartitions(F.desc("norm")).mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows per item; the window's limit is applied before the rows are shuffled, too."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """``item, doc_id, score, rank`` for the queries of one block (rows ``item, terms``)."""
    vocabulary = sorted({t for r in items for t in r["terms"]})
    place = {t: i for i, t in enumerate(vocabulary)}
    rows = stage(vectors(docs, vocabulary, id_col, text_col), "vectors")
    n_docs, n_terms = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in rows.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
    weights[df == 0] = 0  # in no document
    queries = Queries([np.array(sorted(place[t] for t in r["terms"]), dtype=np.int64) for r in items], weights)
    names = [r["item"] for r in items]

    pool = impacts(rows, n_docs, max(1, n_terms))
    cut = pool.agg(F.percentile_approx("norm", 1 - FIRST_SHARE, 1000)).first()[0]
    cut = math.inf if cut is None else cut
    first = stage(_ranked(best(pool.where(F.col("norm") >= cut), queries, names, [0] * len(names), k), k).drop("rank"), "first_best")
    least = dict(first.groupBy("item").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).select("item", "s").collect())
    rest = best(pool.where(F.col("norm") < cut), queries, names, [least.get(i, 0) for i in names], k)
    return _ranked(first.unionByName(rest), k)


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0.

    Terms are runs of ASCII letters and digits and all characters beyond ASCII, A-Z
    lower-cased. With N documents that have a term, L terms in all and n of them in a
    document, ``m = 10 + 90 n N div L``; a term in ``df`` documents weighs
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; the score sums
    ``w * (10^9 tf div (1000 tf + 8 m))`` over an item's distinct terms. Equal scores
    are ordered by id.

    * null or empty item, or one without a known term: no rows; an item id that
      repeats: every row is a query of its own, ranks start anew for each;
    * null or empty document: has no terms and is not counted in N;
    * null document id: ranks after all others of its score; repeated rows: each is
      a document. Ids must be integers;
    * very long texts are read whole; empty tables: empty result; extra columns of
      any name are ignored;
    * queries are taken in blocks of about ``block_terms`` terms, the only part of
      them that the driver and a task hold; each block is a pass over the documents."""
    wanted = stage(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"),
                                F.array_distinct(terms(F.col(item_text_col))).alias("terms")).where(F.size("terms") > 0), "queries")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_terms))
    found = None
    for b in range(n_blocks):
        block = wanted.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).select("item", "terms").orderBy("item").collect()
        if block or found is None:
            part = _search_block(docs, block, k, id_col, text_col)
            found = part if found is None else found.unionByName(part)
    return found.join(wanted.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
