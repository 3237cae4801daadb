"""Near-duplicate groups by HyperMinHash sketches, confirmed on full shingle sets.

* A document is the set of its distinct 5-word shingles (64-bit hashes). Documents
  with equal sets form a class; one representative of each class goes on.
* Sketch: ``REGISTERS`` minima of a bucketed hash. Buckets that stay empty are filled
  in further rounds with fresh hashes, so that small sets have full sketches too. A
  minimum is stored as its leading-zero count and ten mantissa bits (16 bits).
* Bands of registers are hashed; documents sharing a band are candidates. The threshold
  sets their size (``banding``): 36 bands of 7 registers at 0.85, 42 of 6 at 0.80. A pair
  at the threshold shares none of them about once in a million (0.85), thrice (0.80).
* The share of equal registers, corrected for chance collisions of compressed
  registers, estimates the similarity; pairs well below the threshold go no further.
* What remains is confirmed on full sets, 100 * intersection >= percent * union.

Groups are connected without listing all pairs of a bucket. First every member is
compared with one leader per bucket (a few rounds, other leaders each time); linked
documents share a label from then on. After that a bucket's members that do not carry
its commonest label are compared, block by block, with all members of other labels,
so no link between different components is missed; pairs inside a component can add
nothing and are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, partitions, stage, text_batches

SHINGLE = 5
REGISTERS = 256  # the leading 8 bits of a hash name the bucket
MISS = 1e-5  # a pair at the threshold shares no band at most this often
VALUE_BITS, MANTISSA_BITS = 50, 10
MARGIN = 0.12  # over five standard errors of the estimate at 0.85; lower thresholds widen it alike
LEADER_ROUNDS = 2
BLOCK = 1024  # rows of a bucket compared at once

_rng = np.random.default_rng(20)
_WEIGHTS = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_WEIGHTS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased; empty without words."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII space only
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    size = min(n, SHINGLE)
    x = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        x += h[j:n - size + 1 + j] * _WEIGHTS[j]
    x = np.sort(_mix(x))  # several times faster than np.unique
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def sketch(x: np.ndarray) -> np.ndarray:
    """Registers (leading zeros << 10 | mantissa) of a non-empty set of hashes."""
    reg = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    first, rounds = 0, max(1, -(-3000 // len(x)))
    while True:
        t = np.arange(first, first + rounds, dtype=np.uint64)
        y = _mix(x[None, :] + (t[:, None] + np.uint64(1)) * _STEP).ravel()
        value = (y << np.uint64(8)) >> np.uint64(64 - VALUE_BITS)
        value |= np.repeat(t, len(x)) << np.uint64(VALUE_BITS)  # an earlier round comes first
        np.minimum.at(reg, (y >> np.uint64(56)).astype(np.intp), value)
        if reg.max() != np.iinfo(np.uint64).max:
            break
        first += rounds
    fraction, exponent = np.frexp((reg & np.uint64((1 << VALUE_BITS) - 1)).astype(np.float64))
    mantissa = np.floor(np.maximum(2 * fraction - 1, 0) * (1 << MANTISSA_BITS)).astype(np.uint16)
    return ((VALUE_BITS - exponent).astype(np.uint16) << MANTISSA_BITS) | mantissa


def banding(percent: int) -> tuple[int, int]:
    """Registers in a band and number of bands: the longest bands that miss a pair at ``percent`` at most ``MISS`` often."""
    fits = [r for r in range(1, REGISTERS + 1) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISS]
    size = max(fits, default=1)
    return size, REGISTERS // size


def least_estimate(percent: int) -> float:
    """Pairs with a lower estimate go no further."""
    s = percent / 100
    return s - MARGIN * max(1.0, (s * (1 - s) / (0.85 * 0.15)) ** 0.5)


def band_keys(registers: np.ndarray, size: int, bands: int) -> np.ndarray:
    """One 64-bit key per band for each row of ``registers``; the band number is part of the key."""
    r = registers[:, :size * bands].reshape(len(registers), bands, size).astype(np.uint64)
    return _mix((r * _BAND_WEIGHTS[:size]).sum(axis=2, dtype=np.uint64) + (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _STEP)


def chance_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of two unrelated sets agree: same leading-zero
    count and same mantissa, with about ``n / REGISTERS`` values behind a minimum."""
    i = np.arange(VALUE_BITS)
    total = 0.0
    load = [np.maximum(np.asarray(n, dtype=float) / REGISTERS, 1e-9)[..., None] for n in (n_a, n_b)]
    p = [(np.exp(-v * 2.0 ** -(i + 1)) - np.exp(-v * 2.0 ** -i)) / -np.expm1(-v) for v in load]
    total = (p[0] * p[1]).sum(axis=-1)
    return total / 2 ** MANTISSA_BITS


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, without chance collisions."""
    e = chance_rate(n_a, n_b)
    return np.clip((equal / REGISTERS - e) / (1 - e), 0, 1)


def components(edges: DataFrame) -> DataFrame:
    """``a, b``: every vertex ``a`` of ``edges`` with its component's least vertex ``b``
    (the least one itself is left out). Each pass ties every neighbour of a vertex to
    the least vertex seen from there; distances halve. Tables between passes are stored,
    so that joins on hub vertices can be split."""
    stars = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return stars
        seen = tuple(mark)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        tied = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = stage(tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")


def sketch_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, sketch``; ``f1, f2`` identify the set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, regs = [], [], [], []
            for text in batch.column(1):
                x = shingles(text.as_py())
                n.append(len(x))
                f1.append(int(x.sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(np.bitwise_xor.reduce(_mix(x + _STEP)).astype(np.int64)) if len(x) else 0)
                regs.append(sketch(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, f1 long, f2 long, sketch binary")


def _band_rows(reps: DataFrame, size: int, bands: int) -> DataFrame:
    """``key, band, id`` per representative and band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(band_keys(regs, size, bands).ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(regs))),
                     pa.array(ids, pa.int64())], names=["key", "band", "id"])

    return reps.select("id", "sketch").mapInArrow(run, "key long, band int, id long")


def _set_table(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, shingles, low``: full sets of the documents in ``ids``, computed from their texts
    anew, and the low 16 bits of their members (a quarter of the size)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in b.column(1)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.int64)])
            low = pa.array([x.astype(np.uint16).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), low],
                                             names=["id", "shingles", "low"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(bounded(ids), "id", "left_semi").mapInArrow(run, "id long, shingles array<long>, low binary")


def _estimated(pairs: DataFrame, reps: DataFrame, low: float) -> DataFrame:
    """The pairs ``a, b`` whose sketches promise a similarity of ``low`` or more."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            na, nb = (x.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            ok = pa.array(estimate((sa == sb).sum(axis=1), na, nb) >= low)
            yield pa.RecordBatch.from_arrays([x.column("a").filter(ok), x.column("b").filter(ok)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold."""
    x = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
         .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b"))
    x = x.select("a", "b", (F.size("xa") + F.size("xb")).alias("total"), F.size(F.array_intersect("xa", "xb")).alias("common"))
    return x.where(F.expr(f"100 * common >= {percent} * (total - common)")).select("a", "b")


def _across(mates: DataFrame, reps: DataFrame, sets: DataFrame, low: float, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different labels that share a bucket and may be linked, each once.

    A bucket's commonest label needs no queries: every pair across labels has a
    member outside it. Members and queries meet in blocks of bounded size. After the
    estimate, the low 16 bits of the sets bound the intersection from above; as hardly
    any pair passes that is not linked, few pairs leave the task however large a group is."""
    size, bands = banding(percent)
    by_label = mates.groupBy("key", "label").agg(F.count("*").alias("n"))
    buckets = stage(by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("major"),
                                                F.max("n").alias("top")).where("labels > 1")
                    .select("key", "major", F.ceil(F.col("n") / BLOCK).alias("m_blocks"),
                            F.ceil((F.col("n") - F.col("top")) / BLOCK).alias("q_blocks")), "mixed")
    rows = mates.join(bounded(buckets), "key").join(reps.select("id", "sketch", "n_shingles"), "id").join(
        sets.select("id", F.size("shingles").cast("long").alias("n_shingles"), "low"), ["id", "n_shingles"])
    rows = rows.withColumn("minor", F.col("label") != F.col("major"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["key", "band", "id", "label", "minor", "n_shingles", "sketch", "low"]
    members = rows.select(*cols, F.lit(0).alias("role"), own("m_blocks").alias("mb"), "q_blocks").select(
        *cols, "role", "mb", every("q_blocks").alias("qb"))
    queries = rows.where("minor").select(*cols, F.lit(1).alias("role"), own("q_blocks").alias("qb"), "m_blocks").select(
        *cols, "role", every("m_blocks").alias("mb"), "qb")
    blocks = members.unionByName(queries).repartition(partitions(mates.sparkSession), "key", "mb", "qb").sortWithinPartitions("key", "mb", "qb", "role")

    def compare(group: dict[str, np.ndarray]) -> tuple[list, list]:
        q, m = np.flatnonzero(group["role"] == 1), np.flatnonzero(group["role"] == 0)
        a, b = [], []
        regs, band, sizes = group["sketch"], int(group["band"][0]), group["n_shingles"]
        member = np.zeros(1 << 16, dtype=np.int64)
        for i in q:
            ok = m[(group["label"][m] != group["label"][i]) & ~(group["minor"][m] & (group["id"][m] > group["id"][i]))]
            same = regs[ok] == regs[i]
            near = estimate(same.sum(axis=1), np.full(len(ok), sizes[i]), sizes[ok]) >= low
            ok, same = ok[near], same[near]
            # a pair belongs to the first band it shares
            ok = ok[same[:, :size * bands].reshape(len(ok), bands, size).all(axis=2).argmax(axis=1) == band] if len(ok) else ok
            if len(ok):
                own = np.frombuffer(group["low"][i], dtype=np.uint16)
                member[own] = 1
                hits = member[np.frombuffer(b"".join(group["low"][ok].tolist()), dtype=np.uint16)]
                common = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(sizes[ok])[:-1]]))  # at least the intersection
                member[own] = 0
                ok = ok[100 * common >= percent * (sizes[i] + sizes[ok] - common)]
                a += [int(group["id"][i])] * len(ok)
                b += group["id"][ok].tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool) -> tuple[list, list, pa.Table]:
            n = table.num_rows
            g = {c: table.column(c).to_numpy() for c in ("key", "mb", "qb", "role", "band", "id", "label", "minor", "n_shingles")}
            g["low"] = np.array(table.column("low").to_pylist() + [None], dtype=object)[:-1]
            g["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            cut = np.flatnonzero((np.diff(g["key"]) != 0) | (np.diff(g["mb"]) != 0) | (np.diff(g["qb"]) != 0)) + 1
            at = [0, *cut.tolist(), n]
            a, b = [], []
            for lo, hi in zip(at[:-1] if last else at[:-2], at[1:], strict=False):
                x, y = compare({c: v[lo:hi] for c, v in g.items()})
                a, b = a + x, b + y
            return a, b, table.slice(n if last else at[-2])

        for batch in batches:
            if batch.num_rows:
                a, b, rest = groups(pa.Table.from_batches([*held, batch]), last=False)
                held = rest.combine_chunks().to_batches()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if held:
            a, b, _ = groups(pa.Table.from_batches(held), last=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 85) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if ``100 * intersection >= percent * union`` of their
    5-word shingle sets; ``component_id`` is the least id reachable over links.

    * null, empty or blank text: empty set, linked with nothing; fewer than five
      words: the whole sequence is the only shingle;
    * null id: linked with nothing, ``component_id`` null, kept;
    * repeated rows and copies: one class, compared once; each row is returned;
      an id that repeats with other texts: each row has its own set, links that
      one of them has hold for the id;
    * very long texts are read whole; empty table: empty result; extra columns
      of any name are ignored. Ids must be integers."""
    sketches = stage(sketch_table(docs, id_col, text_col), "sketches")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = stage(sketches.where(linkable).groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    # one row per class; a class's representative may occur in several equal rows
    firsts = classes.select(F.col("rep").cast("long").alias("id"), "n_shingles", "f1", "f2")
    reps = stage(sketches.where(linkable).withColumn("id", F.col("doc_id").cast("long"))
                 .join(firsts, ["id", "n_shingles", "f1", "f2"], "left_semi")
                 .dropDuplicates(["id", "n_shingles", "f1", "f2"]).select("id", "n_shingles", "sketch"), "reps")
    bands = stage(_band_rows(reps, *banding(percent)), "bands")
    shared = stage(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    mates = stage(bands.join(bounded(shared), "key", "left_semi"), "mates")
    ids = stage(mates.select("id").distinct(), "mate_ids")
    sets = stage(_set_table(docs, ids, id_col, text_col), "sets")
    reps = stage(reps.join(bounded(ids), "id", "left_semi"), "mate_sketches")
    low = least_estimate(percent)

    labels = ids.select("id", F.col("id").alias("label"))

    def relabel(links: DataFrame) -> DataFrame:
        """Labels after the links; links are between ids."""
        ends = (links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
                .join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
                .select(F.col("la").alias("a"), F.col("lb").alias("b")))
        roots = components(ends)
        return stage(labels.join(roots.select(F.col("a").alias("label"), F.col("b").alias("root")), "label", "left")
                     .select("id", F.coalesce("root", "label").alias("label")), "labels")

    for r in range(LEADER_ROUNDS):
        now = mates.join(labels, "id")
        leader = F.min_by(F.struct("id", "label"), F.struct(F.xxhash64("id", F.lit(r)), "id"))
        leaders = stage(now.groupBy("key").agg(leader.alias("l"), F.min("label").alias("x"), F.max("label").alias("y"))
                        .where("x <> y").select("key", F.col("l.id").alias("b"), F.col("l.label").alias("lb")), "leaders")
        pairs = now.join(leaders, "key").where("label <> lb").select(F.col("id").alias("a"), "b").distinct()
        labels = relabel(stage(_confirmed(_estimated(pairs, reps, low), sets, percent), "links"))
    pairs = stage(_across(mates.join(labels, "id"), reps, sets, low, percent), "across")
    labels = relabel(stage(_confirmed(pairs, sets, percent), "links"))

    kind = docs.schema[id_col].dataType
    roots = labels.select(F.col("id").alias("rep_id"), F.col("label").cast(kind).alias("root"))
    known = stage(classes.join(roots, F.col("rep").cast("long") == F.col("rep_id"), "left")
                  .select("n_shingles", "f1", "f2", F.coalesce("root", "rep").alias("root")), "class_roots")
    out = sketches.select("doc_id", "n_shingles", "f1", "f2").join(known, ["n_shingles", "f1", "f2"], "left")
    component = F.when(linkable, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not near-duplicates of a document with a smaller id, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, **options)
    name = fresh(docs, "_gone")
    gone = stage(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(bounded(gone), F.col(id_col) == F.col(name), "left_anti")
