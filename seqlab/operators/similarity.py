"""Vector similarity, label agreement, trajectory correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dots(left: DataFrame, right: DataFrame, keys_l: Sequence[str], keys_r: Sequence[str], dim: str, value: str) -> DataFrame:
    """Sparse dot products: an equi-join on the dimension, summed per pair."""
    a = left.select(*(F.col(k).alias(f"a_{k}") for k in keys_l), dim, F.col(value).alias("_x"))
    b = right.select(*(F.col(k).alias(f"b_{k}") for k in keys_r), dim, F.col(value).alias("_y"))
    return a.join(b, dim).groupBy(*(f"a_{k}" for k in keys_l), *(f"b_{k}" for k in keys_r)).agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"))


def _norms(rows: DataFrame, keys: Sequence[str], value: str, prefix: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias(f"{prefix}_norm")).select(*(F.col(k).alias(f"{prefix}_{k}") for k in keys), f"{prefix}_norm")


def cosine_distances(left: DataFrame, right: DataFrame, *, keys_l: Sequence[str], keys_r: Sequence[str], dim: str = "syllable", value: str = "usage") -> DataFrame:
    """Cosine distance of every left vector to every right one (V1, J8), long form: a_*, b_*, cosine_distance.

    Vectors are sparse rows (key, dim, value), a missing dimension is 0; pairs
    without a common one are at distance 1; a zero vector gives null. The
    result holds all pairs because that is what is asked: one row for each.
    """
    na, nb = _norms(left, keys_l, value, "a"), _norms(right, keys_r, value, "b")
    on = [f"a_{k}" for k in keys_l] + [f"b_{k}" for k in keys_r]
    pairs = na.join(nb).join(_dots(left, right, keys_l, keys_r, dim, value), on, "left")
    return pairs.select(*on, (1 - F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("a_norm") * F.col("b_norm"))).alias("cosine_distance"))


def subject_distances(left: DataFrame, right: DataFrame, *, group: str = "group", subject: str = "uuid", dim: str = "syllable", value: str = "usage", spread: int = 32) -> DataFrame:
    """For each left subject and right group, the mean cosine distance to the group's subjects (V2); zero vectors don't count, nor does a left one have distances.

    The mean of cosines is the product with the mean of the group's unit
    vectors, so that subjects never meet: a group's unit vectors are added up
    first, and a subject meets one vector a group. Each vector has a further
    entry of 0, dealt to ``spread`` values on the left and to all of them on the
    right, so that subjects and groups without a common dimension meet too,
    and that no dimension is hotter than those of the data.
    """
    def units(rows: DataFrame) -> DataFrame:
        norm = rows.groupBy(group, subject).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm")).withColumnsRenamed({group: "_g", subject: "_s"})
        met = rows.join(norm, rows[group].eqNullSafe(norm["_g"]) & rows[subject].eqNullSafe(norm["_s"]))
        return met.select(rows[group].alias("g"), rows[subject].alias("s"), F.col(dim).alias("d"), F.when(F.col("_norm") > 0, F.col(value) / F.col("_norm")).alias("x"))

    none = F.lit(None).cast(dict(left.dtypes)[dim])
    a, b = units(left), units(right)
    salt = F.pmod(F.xxhash64("s"), F.lit(spread)).cast("int")
    own = a.groupBy("g", "s").agg(F.max(F.col("x").isNotNull()).alias("ok")).select("g", "s", none.alias("d"), F.lit(0.0).alias("x"), "ok", salt.alias("slot"))
    a = a.where("x IS NOT NULL").select("g", "s", "d", "x", F.lit(None).cast("boolean").alias("ok"), F.lit(-1).alias("slot")).unionByName(own)
    means = b.groupBy("g", "d").agg(F.sum("x").alias("y"))
    sizes = b.groupBy("g").agg(F.countDistinct(F.when(F.col("x").isNotNull(), F.struct("s"))).alias("n"))
    every = sizes.select("g", none.alias("d"), F.lit(0.0).alias("y"), "n", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("slot"))
    b = means.where("y IS NOT NULL").select("g", "d", "y", F.lit(None).cast("long").alias("n"), F.lit(-1).alias("slot")).unionByName(every)
    b = b.select(F.col("g").alias("group2"), F.col("d").alias("e"), "y", "n", F.col("slot").alias("place"))
    met = a.join(b, (F.col("slot") == F.col("place")) & F.col("d").eqNullSafe(F.col("e")))
    dots = met.groupBy(F.col("g").alias("group1"), "group2", F.col("s").alias(subject)).agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.max("n").alias("n"), F.max("ok").alias("ok"))
    return dots.select("group1", "group2", subject, F.when(F.col("ok") & (F.col("n") > 0), 1 - F.col("dot") / F.col("n")).alias("cosine_distance"))


def both_directions(a: DataFrame, b: DataFrame, **names) -> DataFrame:
    """Subject distances of a to b's groups and of b to a's."""
    return subject_distances(a, b, **names).unionByName(subject_distances(b, a, **names))


def to_long(vectors: DataFrame, keys: Sequence[str], column: str, n: int | None = None) -> DataFrame:
    """Array vectors as rows (keys, dim from 0, value)."""
    v = F.slice(column, 1, n) if n else F.col(column)
    return vectors.select(*keys, F.posexplode(v).alias("dim", "_v")).select(*keys, "dim", F.col("_v").cast("double").alias("value"))


def mean_vectors(vectors: DataFrame, key: str, column: str, n: int | None = None) -> DataFrame:
    """Mean vector of each key (A16), long form."""
    return to_long(vectors, [key], column, n).groupBy(key, "dim").agg(F.avg("value").alias("value"))


def label_cosine(vectors: DataFrame, key: str, column: str, n: int | None = None) -> DataFrame:
    """Cosine similarity between the mean vectors of labels i and j."""
    means = mean_vectors(vectors, key, column, n)
    d = cosine_distances(means, means, keys_l=[key], keys_r=[key], dim="dim", value="value")
    return d.select(F.col(f"a_{key}").alias("i"), F.col(f"b_{key}").alias("j"), (1 - F.col("cosine_distance")).alias("similarity"))


def l2_normalize(vectors: DataFrame, column: str) -> DataFrame:
    """Vectors divided by their Euclidean norm (V15); a zero vector stays."""
    v = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn("_norm", norm).withColumn(column, F.when(F.col("_norm") > 0, F.transform(v, lambda x: x / F.col("_norm"))).otherwise(v)).drop("_norm")


def agreement(pairs: DataFrame, *, a: str = "label", b: str = "flipped", session: str = "uuid") -> DataFrame:
    """Mean over sessions of the share of equal labels, in percent."""
    per = pairs.groupBy(session).agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("_share"))
    return per.agg((100 * F.avg("_share")).alias("agreement"), F.count(F.lit(1)).alias("n_sessions"))


def session_differences(a: DataFrame, b: DataFrame, session: str = "uuid") -> DataFrame:
    """(session, in_a, in_b) of the sessions that only one of the tables holds; none if the sets are equal.

    One aggregation of both tables, combined to a row per session before its
    shuffle; nothing is joined, and equality is exact.
    """
    sides = a.select(session, F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionAll(b.select(session, F.lit(False), F.lit(True)))
    return sides.groupBy(session).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")).where("in_a <> in_b")


def check_same_sessions(a: DataFrame, b: DataFrame, session: str = "uuid") -> None:
    """Raises unless both tables hold the same sessions (J7, U8), and names one that only one of them holds."""
    off = session_differences(a, b, session).first()
    if off is not None:
        raise ValueError(f"the two tables hold different sessions: {off[session]} is in the {'first' if off['in_a'] else 'second'} alone")


def check_same_frames(a: DataFrame, b: DataFrame, session: str = "uuid") -> None:
    """Raises unless each session of ``a`` has as many rows in ``b`` (F17); sessions that only ``b`` has don't count."""
    n, m = a.groupBy(session).agg(F.count(F.lit(1)).alias("_n")), b.groupBy(session).agg(F.count(F.lit(1)).alias("_m"))
    off = n.join(m, session, "left").where(~F.col("_n").eqNullSafe(F.col("_m"))).first()
    if off is not None:
        raise ValueError(f"session {off[session]} has {off['_n']} frames and {off['_m'] or 0} scores")


def label_jaccard(pairs: DataFrame, *, a: str = "label", b: str = "flipped", labels: DataFrame | None = None) -> DataFrame:
    """Jaccard similarity of label i of a and j of b: n_ij / (n_i + n_j - n_ij) (V5), of observed pairs.

    One aggregation of frames; margins are sums over its small result. With
    ``labels`` (a column ``label``) every pair is given: unobserved ones are 0,
    or 1 if neither label is used.
    """
    n = pairs.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    out = n.withColumn("n_i", F.sum("n").over(Window.partitionBy("i"))).withColumn("n_j", F.sum("n").over(Window.partitionBy("j")))
    if labels is not None:
        grid = labels.select(F.col("label").alias("i")).join(labels.select(F.col("label").alias("j")))
        mi, mj = n.groupBy("i").agg(F.sum("n").alias("n_i")), n.groupBy("j").agg(F.sum("n").alias("n_j"))
        out = grid.join(n, ["i", "j"], "left").join(mi, "i", "left").join(mj, "j", "left").na.fill(0, ["n", "n_i", "n_j"])
    union = F.col("n_i") + F.col("n_j") - F.col("n")
    return out.select("i", "j", "n", union.alias("n_union"), F.when(union == 0, 1.0).otherwise(F.try_divide(F.col("n"), union)).alias("jaccard"))


def similar_pairs(jaccard: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Pairs i < j above the threshold (F8)."""
    return jaccard.where((F.col("i") < F.col("j")) & (F.col("jaccard") > threshold))


def detrend(long: DataFrame, *, by: Sequence[str] = ("label", "metric"), value: str = "value") -> DataFrame:
    """Values minus their group's minimum (V7)."""
    return long.withColumn(value, F.col(value) - F.min(value).over(Window.partitionBy(*by)))


def zscore(rows: DataFrame, columns: Sequence[str], *, by: Sequence[str] = (), population: bool = False) -> DataFrame:
    """(x - mean) / deviation within ``by`` (V8: sample deviation; V9: population). A single value or no spread gives null.

    Without ``by`` the statistics are one row, broadcast; no window gathers all rows.
    """
    spread = F.stddev_pop if population else F.stddev_samp
    stats = rows.groupBy(*by).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.avg, "mean"), (spread, "sd"))))
    met = rows.join(stats, list(by)) if by else rows.join(F.broadcast(stats))
    return met.select(*rows.columns, *(F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")).alias(f"z_{c}") for c in columns))


def _pearson(x: Column, y: Column) -> Column:
    """Correlation of two columns from sums; null where one of them is constant."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    cov, vx, vy = F.sum(x * y) - sx * sy / n, F.sum(x * x) - sx * sx / n, F.sum(y * y) - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(F.greatest(vx, F.lit(1e-300)) * F.greatest(vy, F.lit(1e-300))))


def trajectory_correlation(trajectories: DataFrame, metrics: Sequence[str], pairs: DataFrame, *, label: str = "label", flip: str | None = None) -> DataFrame:
    """Correlation of the detrended trajectories of i and j over all metrics, by place in each.

    ``flip``: the metric that is negated for j (an angle seen from the other
    side). Pairs whose trajectories differ in length are left out.
    """
    long = trajectories.unpivot([label, "offset"], list(metrics), "metric", "value")
    long = detrend(long, by=(label, "metric"))
    place = Window.partitionBy(label, "metric").orderBy("offset")
    long = long.withColumn("at", F.row_number().over(place))
    long = long.withColumn("len", F.count(F.lit(1)).over(Window.partitionBy(label, "metric")))
    a = long.select(F.col(label).alias("i"), "metric", "at", "len", F.col("value").alias("x"))
    sign = F.when(F.col("metric") == flip, -1.0).otherwise(1.0) if flip else F.lit(1.0)
    b = long.select(F.col(label).alias("j"), "metric", "at", "len", (F.col("value") * sign).alias("y"))
    met = pairs.select("i", "j").join(a, "i").join(b, ["j", "metric", "at", "len"])
    return met.groupBy("i", "j").agg(_pearson(F.col("x"), F.col("y")).alias("correlation"))


def accept_candidates(pairs: DataFrame, *, kinematic: float = 0.85, confusion: float = 0.35) -> DataFrame:
    """Pairs above both thresholds."""
    return pairs.where((F.col("correlation") > kinematic) & (F.col("confusion_rate") > confusion))
