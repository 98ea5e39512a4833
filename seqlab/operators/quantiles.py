"""Exact quantiles and medians of groups of any size by counting (A22, box plots).

A histogram of each group's values is a mergeable buffer of fixed size. The
first pass bins by sign and power of two; each further pass splits the bin that
holds a quantile evenly between its least and its largest value, until few
values are left or they are all equal. Only those few are ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.sources.scratch import broadcast_if_small, saved

#: Bins of a pass after the first, and values of a group that are gathered in the end.
BINS, FEW = 4096, 4096

#: What a group's bins carry: the ranks about the quantile, and the number of values.
RANKS = ("first", "second", "total")

#: Above the binary exponent of every number, so that bins of positive numbers are positive.
_OFFSET = 1100


def _power_bin(x: Column) -> Column:
    """A bin that never falls as x grows: by sign and power of two; infinities and NaN (above all) have their own."""
    size = (F.floor(F.log2(F.abs(x))) + _OFFSET).cast("int")
    return F.when(F.isnan(x), 2 * _OFFSET + 2).when(F.abs(x) == float("inf"), F.when(x > 0, 2 * _OFFSET + 1).otherwise(-2 * _OFFSET)).when(x > 0, size).when(x < 0, -size).otherwise(0)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_{k}"])
    return on


def _of_quantile(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each group's bins (bin, n, low, high, below, first, second, total): the bin of the quantile, or both values if its two ranks part there.

    ``first`` and ``second`` are the ranks, from 0, between which the quantile
    lies; ``below`` is the number of values below all bins, ``total`` that of
    all values of the group.
    """
    keys = list(keys)
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = histogram.withColumn("start", F.col("below") + upto - F.col("n"))
    holds = lambda rank: F.max(F.when((F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("start") + F.col("n")), F.struct("start", "n", "low", "high")))
    found = bins.groupBy(*keys).agg(*(F.max(c).alias(c) for c in RANKS), holds("first").alias("a"), holds("second").alias("b"))
    parted = F.col("a.start") != F.col("b.start")
    one = F.col("a.low") == F.col("a.high")
    return found.select(
        *keys, *RANKS, F.col("a.start").alias("below"), F.col("a.n").alias("n"), F.col("a.low").alias("low"), F.col("a.high").alias("high"),
        F.when(parted, F.col("a.high")).when(one, F.col("a.low")).alias("lower"), F.when(parted, F.col("b.low")).when(one, F.col("a.low")).alias("upper"),
    )


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str = "value", *, probabilities: Sequence[float], few: int = FEW, bins: int = BINS) -> DataFrame:
    """(keys, probability, quantile, n) of the values that aren't null: between the two values about probability * (n - 1), by linear interpolation.

    NaN is above every number. Groups without a value have no row. Keys may be
    null; without keys all rows are one group. A repeated probability counts once.

    Plan: a pass is one aggregation, combined before its shuffle to at most
    ``bins`` rows a group, quantile and task, whatever the number of values;
    the first serves all quantiles. Ranges that the next pass looks into are a
    written table, broadcast only if it is small. A group of n values takes
    about 1 + log(n / ``few``) / log(``bins``) passes. The last gathers at most
    ``few`` values a group and quantile.
    """
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must be between 0 and 1")
    made = not keys
    keys = list(keys) or ["_all"]
    each = [*keys, "_p"]
    long = (rows.withColumn("_all", F.lit(0)) if made else rows).select(*keys, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    first = long.groupBy(*keys, _power_bin(F.col("x")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    first = first.withColumn("total", F.sum("n").over(Window.partitionBy(*keys))).withColumn("_p", F.explode(F.array(*(F.lit(float(p)) for p in sorted(set(probabilities))))))
    place = F.col("_p") * (F.col("total") - 1)
    ranks = first.withColumn("below", F.lit(0).cast("long")).withColumn("first", F.floor(place)).withColumn("second", F.ceil(place))
    state = saved(_of_quantile(ranks, each), "quantiles")
    done = state.where("lower IS NOT NULL")

    def within(part: DataFrame) -> DataFrame:
        """The rows that lie in a range of their group's, with the range."""
        ranges = broadcast_if_small(part.select(*(F.col(k).alias(f"_{k}") for k in keys), "_p", *RANKS, "below", "low", "high"))
        return long.join(ranges, _same(long, ranges, keys) & (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).drop(*(f"_{k}" for k in keys))

    gathered = state.where(F.col("lower").isNull() & (F.col("n") <= few))
    left = state.where(F.col("lower").isNull() & (F.col("n") > few))
    kept = [F.max(c).alias(c) for c in ("below", *RANKS)]
    while not left.isEmpty():
        share = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves, as a difference may overflow
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        histogram = within(left).groupBy(*each, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("_low"), F.max("x").alias("_high"), *kept).withColumnsRenamed({"_low": "low", "_high": "high"})
        state = saved(_of_quantile(histogram, each), "quantiles")
        done = done.unionByName(state.where("lower IS NOT NULL"))
        gathered = gathered.unionByName(state.where(F.col("lower").isNull() & (F.col("n") <= few)))
        left = state.where(F.col("lower").isNull() & (F.col("n") > few))
    values = within(gathered).groupBy(*each).agg(F.sort_array(F.collect_list("x")).alias("v"), *kept)
    at = lambda rank: F.get("v", (F.col(rank) - F.col("below")).cast("int"))
    values = values.select(*each, *RANKS, at("first").alias("lower"), at("second").alias("upper"))
    out = done.select(*each, *RANKS, "lower", "upper").unionByName(values)
    part = F.col("_p") * (F.col("total") - 1) - F.col("first")
    between = F.when(F.col("first") == F.col("second"), F.col("lower")).otherwise((1 - part) * F.col("lower") + part * F.col("upper"))
    return out.select(*([] if made else keys), F.col("_p").alias("probability"), between.alias("quantile"), F.col("total").alias("n"))


def exact_medians(rows: DataFrame, keys: Sequence[str], value: str = "value", *, few: int = FEW, bins: int = BINS) -> DataFrame:
    """(keys, median, n): ``exact_quantiles`` at one half, the mean of the two middle values if n is even."""
    return exact_quantiles(rows, keys, value, probabilities=(0.5,), few=few, bins=bins).select(*keys, F.col("quantile").alias("median"), "n")
