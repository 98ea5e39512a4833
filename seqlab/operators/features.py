"""Per-label features: kinematics, durations, frequency, PCs, AR dynamics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL = -5


def usable_frames(frames: DataFrame, sessions: DataFrame, *, label: str = "label", key: str = "uuid") -> DataFrame:
    """Frames of the given sessions without the warm-up label."""
    return frames.where(F.col(label) != SENTINEL).join(sessions.select(key).distinct(), key, "left_semi")


def attach_scores(frames: DataFrame, scores: DataFrame, *, keys: Sequence[str] = ("uuid", "frame_seq"), skip: int = 3) -> DataFrame:
    """PC scores on their frames (J6); the first ``skip`` frames of a session have none."""
    return frames.where(F.col(keys[-1]) >= skip).join(scores, list(keys))


def label_features(onsets: DataFrame, metrics: Sequence[str], *, label: str = "label", frames_column: str = "run_frames", fps: float = 30.0, pc: str | None = None, n_pc: int = 10) -> DataFrame:
    """One row per label over onset rows: mean and sample deviation of metrics, of the duration in seconds and of PCs, and the frequency.

    One aggregation; the total for frequencies is summed over its rows.
    """
    seconds = F.col(frames_column) / fps
    stats = [f(x).alias(f"{n}_{name}") for name, x in [*((m, F.col(m)) for m in metrics), ("duration_s", seconds)] for n, f in (("avg", F.avg), ("std", F.stddev_samp))]
    if pc:
        stats += [f(F.get(pc, F.lit(i))).alias(f"{n}_pc_{i + 1}") for i in range(n_pc) for n, f in (("avg", F.avg), ("std", F.stddev_samp))]
    rows = onsets.groupBy(label).agg(F.count(F.lit(1)).alias("n_onsets"), *stats)
    total = rows.agg(F.sum("n_onsets").alias("_total"))
    return rows.join(F.broadcast(total)).withColumn("normalized_frequency", F.col("n_onsets") / F.col("_total")).drop("_total")


def drop_bias(ar: DataFrame, *, values: str = "values") -> DataFrame:
    """AR rows without their last column, the bias."""
    return ar.withColumn(values, F.slice(values, F.lit(1), F.size(values) - 1))


def ar_eigenvalues(ar: DataFrame, *, label: str = "label", row: str = "row", values: str = "values", lags: int = 3, mode: str = "eigh") -> DataFrame:
    """Absolute eigenvalues, descending, of each label's companion matrix (V18): label, magnitudes.

    ``eigh`` reads the lower triangle only, as a symmetric solver does; ``eig``
    is the spectrum of the matrix. A label's matrix is n rows of n * lags; the
    rows are gathered per label in the JVM, and solved in Arrow batches.
    """
    solve = {"eigh": np.linalg.eigvalsh, "eig": np.linalg.eigvals}[mode]

    def magnitudes(matrices: pd.Series) -> pd.Series:
        out: list = [None] * len(matrices)
        by_size: dict[int, list[int]] = {}
        for i, rows in enumerate(matrices):
            by_size.setdefault(len(rows), []).append(i)
        for n, places in by_size.items():  # matrices of one size are solved together
            stacked = np.zeros((len(places), n * lags, n * lags))
            for k, i in enumerate(places):
                for j, r in enumerate(sorted(matrices.iloc[i], key=lambda r: r["row"])):
                    stacked[k, j] = r["values"][: n * lags]
            stacked[:, n:, : n * (lags - 1)] = np.eye(n * (lags - 1))
            found = np.sort(np.abs(solve(stacked)), axis=1)[:, ::-1]
            for i, x in zip(places, found.tolist(), strict=True):
                out[i] = x
        return pd.Series(out)

    udf = F.pandas_udf(magnitudes, "array<double>")
    gathered = ar.groupBy(label).agg(F.collect_list(F.struct(F.col(row).alias("row"), F.col(values).alias("values"))).alias("m"))
    return gathered.select(label, udf("m").alias("magnitudes"))


def spectral_radius(magnitudes: Column) -> Column:
    """Largest absolute eigenvalue."""
    return F.array_max(magnitudes)


def dynamic_complexity(magnitudes: Column) -> Column:
    """-sum(m ln(m + 1e-10)) of the normalised absolute eigenvalues (V20); null if they sum to 0."""
    total = F.aggregate(magnitudes, F.lit(0.0), lambda a, x: a + F.abs(x))
    share = F.transform(magnitudes, lambda x: F.try_divide(F.abs(x), total))
    return F.aggregate(share, F.lit(0.0), lambda a, m: a - m * F.ln(m + 1e-10))


def first_magnitudes(magnitudes: Column, n: int = 10) -> list[Column]:
    """The first n as columns eigval_1.. (V21); null where there are fewer."""
    return [F.try_element_at(magnitudes, F.lit(i)).alias(f"eigval_{i}") for i in range(1, n + 1)]


def dynamics_features(ar: DataFrame, *, label: str = "label", mode: str = "eigh") -> DataFrame:
    """spectral_radius, dynamic_complexity and eigval_1..10 per label."""
    e = ar_eigenvalues(drop_bias(ar), label=label, mode=mode)
    m = F.col("magnitudes")
    return e.select(label, spectral_radius(m).alias("spectral_radius"), dynamic_complexity(m).alias("dynamic_complexity"), *first_magnitudes(m))
