"""Evaluation results reshaped for plotting and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import require_columns, surprisal
from ..session import cut_lineage


def has_pair(df: DataFrame, col: str = "form_ungrammatical") -> DataFrame:
    """Rows whose alternative form is present and not blank."""
    return df.where(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))


def melt_long(results: DataFrame, ids: list[str], value_cols: list[str], labels: list[str],
              value_name: str = "prob", is_log: bool = False, pair_col: str | None = None) -> DataFrame:
    """V1: one row per (row, measured column) with the fixed x label and
    the surprisal of the value.  Column names are parameters (the scorer
    writes ``p_<target column>``).  With ``pair_col``, rows without an
    alternative form in it are left out first (B16)."""
    require_columns(results, *ids, *value_cols, *([pair_col] if pair_col else []))
    if pair_col:
        results = has_pair(results, pair_col)
    if len(value_cols) != len(labels):
        raise ValueError("one label per value column")
    long = results.unpivot(ids, value_cols, "source", value_name)
    mapping = F.create_map(*[x for c, lab in zip(value_cols, labels) for x in (F.lit(c), F.lit(lab))])
    return long.select(*ids, "source", mapping[F.col("source")].alias("x_label"), value_name,
                       surprisal(F.col(value_name), is_log=is_log).alias("surprisal"))


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


BINS = 1024  # bins of one narrowing step, per interval
BROADCAST_GROUPS = 50_000  # intervals are broadcast up to so many rows (a few per label)


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """Bin of ``v`` in ``[lo, hi]`` (finite, lo < hi): never falls as v rises.  Wide ranges of one
    sign are cut in equal ratios, others in equal widths (halved where a width would overflow)."""
    part = lambda x, a, b: (x - a) / (b - a)
    half = lambda x: x * F.lit(0.5)
    share = (F.when((lo > 0) & (hi / lo > 1024), part(F.log(v), F.log(lo), F.log(hi)))
             .when((hi < 0) & (lo / hi > 1024), 1 - part(F.log(-v), F.log(-hi), F.log(-lo)))
             .when(hi - lo < F.lit(float("inf")), part(v, lo, hi)).otherwise(part(half(v), half(lo), half(hi))))
    # the ends have bins of their own: an interval always shrinks
    return F.when(v <= lo, 0).when(v >= hi, BINS + 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(BINS), F.floor(share * BINS) + 1))).cast("int")


def select_ranks(v: DataFrame, want: DataFrame) -> DataFrame:
    """Values at given ranks, exactly: (_g, _r, _val) for ``want`` (_g, _r; ranks from 0) over ``v`` (_g, _v: doubles, stored).

    Distributed selection: count values per bin, keep the bins that the wanted ranks
    fall into, with their least and greatest value as the next interval, and
    repeat until both are equal.  A step is one map-side combined aggregation;
    equal values make no work, as they share every bin and end the search."""
    kind = F.when(F.isnan("_v"), 3).when(F.col("_v") == float("inf"), 2).when(F.col("_v") == float("-inf"), 0).otherwise(1)
    ends = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    hist = v.groupBy("_g", kind.alias("_bin")).agg(*ends).withColumns({"_from": F.lit(None).cast("double"), "_below": F.lit(0).cast("long")})
    state, done = want.withColumns({"_from": F.lit(None).cast("double")}), None
    while True:
        # one row per interval and bin, at most BINS + 2 of an interval
        order = Window.partitionBy("_g", "_from").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_c").over(order), F.lit(0)))
        bins = hist.select(F.col("_g").alias("_hg"), F.col("_from").alias("_hf"), "_c", "_lo", "_hi", "_below")
        found = state.select("_g", "_r", "_from").join(bins, F.col("_g").eqNullSafe(F.col("_hg")) & F.col("_from").eqNullSafe(F.col("_hf"))
                                                      & (F.col("_r") >= F.col("_below")) & (F.col("_r") < F.col("_below") + F.col("_c")))
        found = cut_lineage(found.select("_g", "_r", "_lo", "_hi", "_below"), "selection")  # a few rows per label
        ready = found.where(F.col("_lo").eqNullSafe(F.col("_hi"))).select("_g", "_r", F.col("_lo").alias("_val"))
        done = ready if done is None else done.unionByName(ready)
        state = found.where(~F.col("_lo").eqNullSafe(F.col("_hi"))).withColumn("_from", F.col("_lo"))
        spans = state.select(F.col("_g").alias("_sg"), "_from", "_hi", "_below").distinct()
        n = spans.count()
        if not n:
            return done
        side = F.broadcast(spans) if n <= BROADCAST_GROUPS else spans
        inside = v.join(side, F.col("_g").eqNullSafe(F.col("_sg")) & (F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_hi")))
        hist = (inside.groupBy("_g", "_from", "_below", _bin(F.col("_v"), F.col("_from"), F.col("_hi")).alias("_bin"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_top"))
                .withColumnRenamed("_top", "_hi"))


def exact_quantiles(df: DataFrame, value: str, by: str, probs: dict) -> DataFrame:
    """Exact quantiles (linear interpolation, as ``quantile_cont``) by ``select_ranks``:
    nothing is sorted and no group is gathered, however many values are equal.
    NULL values do not count; NaN is the greatest value; a NULL label is a label."""
    v = cut_lineage(df.select(F.col(by).alias("_g"), (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull()), "values")
    spots = F.array(*[F.struct(F.lit(name).alias("_q"), ((F.col("_n") - 1) * F.lit(float(p))).alias("_pos")) for name, p in probs.items()])
    want = v.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).select("_g", F.explode(spots).alias("x")).select("_g", "x.*")
    want = cut_lineage(want, "wanted")
    ends = F.array(F.floor("_pos").cast("long"), F.ceil("_pos").cast("long"))
    ranks = select_ranks(v, want.select("_g", F.explode(ends).alias("_r")).distinct())

    def found(end: str, f) -> tuple[DataFrame, Column]:
        side = ranks.select(F.col("_g").alias(f"_g{end}"), F.col("_r").alias(f"_r{end}"), F.col("_val").alias(f"_v{end}"))
        return side, F.col("_g").eqNullSafe(F.col(f"_g{end}")) & (f("_pos").cast("long") == F.col(f"_r{end}"))

    q = want.join(*found("lo", F.floor)).join(*found("hi", F.ceil))
    between = F.when(F.col("_vlo").eqNullSafe(F.col("_vhi")), F.col("_vlo")).otherwise(F.col("_vlo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_vhi") - F.col("_vlo")))
    return q.select("_g", "_q", between.alias("_val")).groupBy(F.col("_g").alias(by)).pivot("_q", list(probs)).agg(F.first("_val"))


def distribution(long: DataFrame, value: str = "surprisal", by: str = "x_label",
                 exact: bool = False) -> DataFrame:
    """V2: the shape of a distribution per label (what the violin plot
    shows): count, min, quartiles, max, mean.  The default
    ``percentile_approx`` has bounded memory per group; ``exact`` gives the
    interpolated quantiles by distributed selection."""
    v = F.col(value)
    if exact:
        # read several times (counts, selection): materialise once
        long = cut_lineage(long.select(by, value), "distribution")
    base = long.groupBy(by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
                                F.avg(v).alias("mean"),
                                *([] if exact else [F.percentile_approx(v, F.lit(p)).alias(k)
                                                    for k, p in QUARTILES.items()]))
    if not exact:
        return base
    q = exact_quantiles(long, value, by, QUARTILES).withColumnRenamed(by, "_by")
    return base.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def histogram(long: DataFrame, value: str = "surprisal", by: str = "x_label", width: float = 1.0) -> DataFrame:
    """Rows per label and bin of fixed ``width``: ``bin`` b covers ``[b * width, (b + 1) * width)``;
    infinite, NaN and NULL values are in the NULL bin."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    b = F.when(finite, F.floor(F.when(finite, v) / F.lit(float(width))))
    return long.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
