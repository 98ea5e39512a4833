"""Tables ready to plot; nothing is drawn here (section 2.12)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.operators.quantiles import exact_quantiles

#: Columns of a box and their probabilities.
BOX = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


def box_quantiles(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Minimum, quartiles and maximum of each group, exact, by counting (``exact_quantiles``): by, n (rows), low, q1, median, q3, high.

    A group without a value has nulls; a null group is a group.
    """
    q = exact_quantiles(rows, by, value, probabilities=tuple(BOX.values()))
    boxes = q.groupBy(*(F.col(k).alias(f"_{k}") for k in by)).agg(*(F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(c) for c, p in BOX.items()))
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    same = reduce(lambda a, b: a & b, (groups[k].eqNullSafe(boxes[f"_{k}"]) for k in by), F.lit(True))
    return groups.join(boxes, same, "left").select(*by, "n", *BOX)


def histogram(rows: DataFrame, value: str, *, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins between the smallest and largest value: by, bin (from 0), start, n."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))
    met = rows.where(F.col(value).isNotNull()).join(F.broadcast(ends.withColumn("_w", width)))
    return met.withColumn("bin", at).groupBy(*by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("start")).agg(F.count(F.lit(1)).alias("n"))


#: A prime below 2**31: products of two remainders are exact in 64 bits.
PRIME = 2_147_483_647
#: Where a uniform number in [0, PRIME) is a Poisson number of 0, 1, 2, ... with mean 1.
POISSON = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12))


def with_poisson_weight(rows: DataFrame, key: str, replicate: str, weight: str, *, seed: int = 0) -> DataFrame:
    """``rows`` with a Poisson number with mean 1 from a row's key (long) and a replicate's number: how often the replicate draws the row.

    Rounds of squaring modulo a prime, in exact integers, so that any engine
    finds the same weights. Each round is a column: a round uses the last one
    more than once, and nested expressions would be evaluated once per use.
    """
    prime, r, t = F.lit(PRIME), F.col(replicate), F.col(weight)
    rounds = (F.pmod(F.pmod(F.col(key), prime) * 48_271 + r * 69_621 + (seed * 40_692 + 11), prime), F.pmod(t * t + r * 16_807 + 7, prime), F.pmod(t * (t + 30_269), prime))
    for step in (*rounds, sum(((t >= cut).cast("long") for cut in POISSON), F.lit(0))):
        rows = rows.withColumn(weight, step)
    return rows


def bootstrap_bands(rows: DataFrame, values: Sequence[str], by: Sequence[str], *, key: str, replicates: int = 250, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean of each value in each group with the band of its bootstrapped means: by, metric, n, mean, low, high.

    A Poisson bootstrap: a row's weight in a replicate is a number drawn from its
    ``key`` (a distinct long) and the replicate's, so that no sample is drawn and
    weights do not depend on how rows are stored. All replicates are sums of one
    aggregation, combined in each task to a row per group and replicate before
    the shuffle. The band is the interval of quantiles that holds ``level`` of a
    group's replicates. Nulls don't count; a group without a value has null for
    mean and band.
    """
    by, place = list(by), {v: f"_v{i}" for i, v in enumerate(values)}
    drawn = rows.select(*by, F.col(key).cast("long").alias("_k"), *(F.col(v).cast("double").alias(c) for v, c in place.items())).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    # replicate 0 has every row once: the plain mean
    drawn = with_poisson_weight(drawn, "_k", "_r", "_w", seed=seed).withColumn("_w", F.when(F.col("_r") == 0, 1).otherwise(F.col("_w")).cast("long"))
    sums = [f for c in place.values() for f in (F.sum(F.when(F.col(c).isNotNull(), F.col("_w"))).alias(f"n{c}"), F.sum(F.col(c) * F.col("_w")).alias(f"s{c}"))]
    per = drawn.groupBy(*by, "_r").agg(*sums)
    long = per.select(*by, "_r", F.inline(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(f"n{c}").alias("_n"), F.try_divide(F.col(f"s{c}"), F.col(f"n{c}")).alias("_m")) for v, c in place.items()))))
    tails = F.percentile(F.when(F.col("_r") > 0, F.col("_m")), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    out = long.groupBy(*by, "metric").agg(F.coalesce(F.max(F.when(F.col("_r") == 0, F.col("_n"))), F.lit(0)).alias("n"), F.max(F.when(F.col("_r") == 0, F.col("_m"))).alias("mean"), tails.alias("_q"))
    return out.select(*by, "metric", "n", "mean", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"))


def mean_with_error(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean with a 95 % normal interval, without a bootstrap."""
    s = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n"))
    half = 1.96 * F.col("_s") / F.sqrt("n")
    return s.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
