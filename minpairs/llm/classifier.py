"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Filters of ``WIDTH`` bytes, learned as one weight per
filter, offset and byte value, slide over the whole text in steps of ``STRIDE``.
Overlapping chunks of ``CHUNK`` filter positions cover the document; each filter is
max-pooled within a chunk, and mean and minimum over all chunks enter one logistic
unit. Training uses a bounded sample of labelled rows, scoring reads every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, hash_sample, stage, text_batches

WIDTH, STRIDE, FILTERS = 8, 2, 16
STEP, OVERLAP = 224, 29  # filter positions between chunk starts, and shared by neighbours
CHUNK = STEP + OVERLAP
CHUNK_BYTES = STRIDE * (CHUNK - 1) + WIDTH
# bounds of the training sample (documented parameters): labelled rows, chunks of a row
SAMPLE_ROWS, SAMPLE_CHUNKS = 3000, 8
BLOCK = 1 << 16  # filter positions computed at once


@dataclass
class Model:
    table: np.ndarray  # (WIDTH, 256, FILTERS): weight of each byte value at each offset
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    shift: float

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at every position; the text is followed by zero bytes."""
        n = max(1, -(-len(data) // STRIDE))
        padded = np.zeros(n * STRIDE + WIDTH, dtype=np.uint8)
        padded[:len(data)] = data
        r = np.take(self.table[0], padded[0:n * STRIDE:STRIDE], axis=0)
        for j in range(1, WIDTH):
            r += np.take(self.table[j], padded[j:j + n * STRIDE:STRIDE], axis=0)
        return r

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): activations max-pooled per chunk, computed block by block."""
        n = max(1, -(-len(data) // STRIDE))
        heads, rests = [], []
        block = BLOCK - BLOCK % STEP
        for p in range(0, n, block):
            r = self.positions(data[p * STRIDE:(p + block) * STRIDE + WIDTH - 1])[:min(block, n - p)]
            starts = np.arange(0, len(r), STEP)
            heads.append(np.maximum.reduceat(r, np.stack([starts, np.minimum(starts + OVERLAP, len(r) - 1)], 1).ravel(), axis=0)[::2])
            rests.append(np.maximum.reduceat(r, starts, axis=0))
            if len(r) - starts[-1] <= OVERLAP:  # the last chunk is no longer than its head
                heads[-1][-1] = rests[-1][-1]
        head, rest = np.concatenate(heads), np.concatenate(rests)
        rest[:-1] = np.maximum(rest[:-1], head[1:])  # a chunk reaches into the next one
        return np.maximum(rest + self.bias, 0)

    def score(self, data: np.ndarray) -> float:
        x = self.pooled(data)
        z = float(np.concatenate([x.mean(axis=0), x.min(axis=0)]) @ self.out + self.shift)
        return 1 / (1 + np.exp(-z))


def train(chunks: np.ndarray, lengths: np.ndarray, owner: np.ndarray, y: np.ndarray, *, steps: int = 552, batch: int = 64,
          rate: float = 0.03, decay: float = 1e-4, seed: int = 5) -> Model:
    """Fit by Adam in at least ``steps`` steps. ``chunks``: (n, CHUNK_BYTES) bytes, ``lengths``: used bytes of each,
    ``owner``: document of each (ascending), ``y``: label per document."""
    rng = np.random.default_rng(seed)
    p = {"table": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.full(FILTERS, 0.1, np.float32),
         "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), "shift": np.full(1, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), np.float32)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    n_batches = max(1, len(y) // batch)
    epochs = -(-steps // n_batches)
    step, steps = 0, epochs * n_batches
    # the rarer class counts more, by the root of the classes' ratio
    share = y.mean()
    weight = np.where(y == 1, ((1 - share) / share) ** 0.25, (share / (1 - share)) ** 0.25).astype(np.float32)
    for _ in range(epochs):
        for docs in np.array_split(rng.permutation(len(y)), n_batches):
            step += 1
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            counts = first[docs + 1] - first[docs]
            at = np.concatenate([[0], np.cumsum(counts)[:-1]])
            c = chunks[rows]
            r = np.take(p["table"][0], c[:, 0:STRIDE * CHUNK:STRIDE], axis=0)
            for j in range(1, WIDTH):
                r += np.take(p["table"][j], c[:, j:j + STRIDE * (CHUNK - 1) + 1:STRIDE], axis=0)
            r[np.arange(CHUNK)[None, :] * STRIDE >= np.maximum(lengths[rows], 1)[:, None]] = -1e9
            best = r.argmax(axis=1)  # (chunks, FILTERS)
            pool = np.take_along_axis(r, best[:, None, :], 1)[:, 0] + p["bias"]
            act = np.maximum(pool, 0)
            mean = np.add.reduceat(act, at, axis=0) / counts[:, None]
            low = np.minimum.reduceat(act, at, axis=0)
            x = np.concatenate([mean, low], axis=1)
            err = (1 / (1 + np.exp(-(x @ p["out"] + p["shift"]))) - y[docs]) * weight[docs] / len(docs)
            dx = err[:, None] * p["out"]
            which = np.repeat(np.arange(len(docs)), counts)
            is_low = act == low[which]
            ties = np.add.reduceat(is_low.astype(np.float32), at, axis=0)
            da = (dx[:, :FILTERS] / counts[:, None])[which] + is_low * (dx[:, FILTERS:] / ties)[which]
            da *= pool > 0
            g = {"out": x.T @ err, "shift": err.sum(keepdims=True), "bias": da.sum(axis=0), "table": np.zeros_like(p["table"])}
            f = np.broadcast_to(np.arange(FILTERS), best.shape)
            for j in range(WIDTH):
                byte = np.take_along_axis(c, best * STRIDE + j, 1)
                np.add.at(g["table"][j], (byte, f), da)
            lr = rate * min(1, step / 20) * (1 - step / (steps + 1))
            for k in p:
                d = g[k].astype(np.float32) + decay * p[k]
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                p[k] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)
    return Model(p["table"], p["bias"], p["out"], float(p["shift"][0]))


def sample_chunks(text: str | None, limit: int = SAMPLE_CHUNKS) -> list[bytes]:
    """At most ``limit`` chunks spread evenly over the whole text (all, if there are no more)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-max(1, -(-len(data) // STRIDE)) // STEP))
    at = range(n) if n <= limit else np.linspace(0, n - 1, limit).round().astype(int)
    return [data[k * STEP * STRIDE:k * STEP * STRIDE + CHUNK_BYTES] for k in at]


def fit(rows: list[tuple[float, list[bytes]]], **options) -> Model:
    """Train on ``(label, chunks)`` rows; with one class only, a constant model."""
    y = np.array([r[0] for r in rows], dtype=np.float32)
    parts = [(i, c) for i, r in enumerate(rows) for c in r[1]]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32),
                     float(np.log((share + 0.01) / (1.01 - share))))
    chunks = np.zeros((len(parts), CHUNK_BYTES + WIDTH), dtype=np.uint8)
    for k, (_, c) in enumerate(parts):
        chunks[k, :len(c)] = np.frombuffer(c, dtype=np.uint8)
    return train(chunks, np.array([len(c) for _, c in parts]), np.array([i for i, _ in parts]), y, **options)


def fold(id_col: str) -> Column:
    """Fold 0 to 4 of a document: crc32 of its id as text; 0 is held out. Null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train_on(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold, chosen by a
    hash of their id and text. Equal rows count once, an id that repeats with other texts
    gives a row for each; repeated labels of an id: their mean."""
    marks = stage(labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna()
                  .where(fold("_id") != 0).groupBy("_id").agg(F.avg("_y").alias("_y")), "marks")
    docs = text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_h"))
    labelled = docs.select("_id", "_h").join(bounded(marks), "_id").groupBy("_id", "_h").agg(F.first("_y").alias("_y"))
    picked = stage(hash_sample(stage(labelled, "labelled"), sample_rows, "_id", "_h"), "train_sample")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([sample_chunks(t.as_py()) for t in b.column(3)], pa.list_(pa.binary()))],
                                             names=["id", "h", "y", "chunks"])

    rows = docs.join(F.broadcast(picked), ["_id", "_h"]).select(F.col("_id").cast("string").alias("id"), F.col("_h").alias("h"), F.col("_y").alias("y"), "_text")
    once = rows.mapInArrow(chunk, "id string, h long, y double, chunks array<binary>").groupBy("id", "h").agg(F.first("y").alias("y"), F.first("chunks").alias("chunks"))
    return fit([(r["y"], [bytes(c) for c in r["chunks"]]) for r in sorted(once.collect(), key=lambda r: (r["id"], r["chunks"]))])


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted`` (1 if ``score >= cut``).

    * null or empty text: scored as one window of zero bytes;
    * null id: fold of the empty string; repeated rows: each scored alike;
    * very long texts: whole, block by block; empty table: empty result;
    * extra columns of any name are ignored: only the text enters the score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()),
                                              pa.array([int(s >= cut) for s in scores], pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return text_batches(docs).select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns, unchanged.
    Null and empty texts are scored as ``classify`` does; empty table: empty result."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [model.score(np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)) >= cut for t in b.column(at)]
            yield b.filter(pa.array(good, pa.bool_()))

    return text_batches(docs).mapInArrow(run, docs.schema)
