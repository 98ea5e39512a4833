"""Normalisation and missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.operators.quantiles import FEW, exact_medians
from seqlab.sources.scratch import broadcast_if_small, saved

MAD_SCALE = 1.4826


def nan_to_null(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN becomes null, so that aggregates skip it."""
    return rows.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})


def missing_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null counts per column (A25), one row each, from one aggregation."""
    wide = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns), F.count(F.lit(1)).alias("_n"))
    return wide.unpivot(["_n"], list(columns), "column_name", "n_missing").select("column_name", "n_missing", F.col("_n").alias("n_rows"))


def drop_missing(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without nulls in the columns."""
    return rows.na.drop("any", subset=list(columns))


def robust_zscore(rows: DataFrame, columns: Sequence[str], *, by: Sequence[str] = ("experiment_name",), mad_scope: str = "column", few: int = FEW) -> DataFrame:
    """(x - median) / (1.4826 * MAD) within ``by``, as z_*.

    ``mad_scope='column'`` (V10): a MAD for each column; ``'global'`` (V11): one
    for all columns together. A MAD of 0, or a group without values, gives null.
    Medians are exact and counted (``exact_medians``): no buffer grows with a
    group. Medians and MADs are one row a group, joined back once.
    """
    if mad_scope not in ("column", "global"):
        raise ValueError("mad_scope must be 'column' or 'global'")
    by = list(by)
    names = {k: f"_by_{i}" for i, k in enumerate(by)}
    long = rows.select(*(F.col(k).alias(v) for k, v in names.items()), F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("_c", "x")).where("x IS NOT NULL")
    keys = [*names.values(), "_c"]
    medians = saved(exact_medians(long, keys, "x", few=few).drop("n"), "column-medians")
    of = broadcast_if_small(medians.select(*(F.col(k).alias(f"_{k}") for k in keys), "median"))
    on = [long[k].eqNullSafe(of[f"_{k}"]) for k in keys]
    gaps = long.join(of, reduce(lambda a, b: a & b, on)).select(*keys, F.abs(F.col("x") - F.col("median")).alias("x"))
    scope = keys if mad_scope == "column" else keys[:-1]
    mads = exact_medians(gaps, scope, "x", few=few)
    wide = lambda t, name: t.groupBy(*keys[:-1]).agg(*(F.max(F.when(F.col("_c") == i, F.col("median"))).alias(f"_{name}_{i}") for i in range(len(columns))))
    spread = wide(mads, "mad") if mad_scope == "column" else mads.select(*keys[:-1], *(F.col("median").alias(f"_mad_{i}") for i in range(len(columns))))
    stats = wide(medians, "median")
    if by:
        stats = stats.join(spread.withColumnsRenamed({k: f"_{k}" for k in keys[:-1]}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys[:-1]]), "left")
        met = rows.join(stats, reduce(lambda a, b: a & b, [rows[k].eqNullSafe(stats[v]) for k, v in names.items()]), "left")
    else:
        met = rows.join(F.broadcast(stats)).join(F.broadcast(spread))  # a row each
    return met.select(*(rows[c] for c in rows.columns), *(F.try_divide(rows[c] - F.col(f"_median_{i}"), MAD_SCALE * F.col(f"_mad_{i}")).alias(f"z_{c}") for i, c in enumerate(columns)))


def preprocess(rows: DataFrame, columns: Sequence[str], *, method: str = "robust_zscore", order: str = "dropna_first", by: Sequence[str] = ("experiment_name",), mad_scope: str = "column") -> DataFrame:
    """Normalise per experiment and drop rows with missing values, in either order (V12); columns keep their names."""
    from seqlab.operators.similarity import zscore

    rows = nan_to_null(rows, columns)
    if order == "dropna_first":
        rows = drop_missing(rows, columns)
    out = zscore(rows, columns, by=by) if method == "zscore" else robust_zscore(rows, columns, by=by, mad_scope=mad_scope)
    others = [c for c in rows.columns if c not in columns]
    out = out.select(*others, *(F.col(f"z_{c}").alias(c) for c in columns))
    return drop_missing(out, columns) if order == "normalize_first" else out


def union_experiments(tables: dict[str, DataFrame]) -> DataFrame:
    """All experiments' rows with ``experiment_name``; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn("experiment_name", F.lit(name)) for name, t in tables.items()))


def missing_columns(rows: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Wanted columns that the table lacks (U4)."""
    return sorted(set(wanted) - set(rows.columns))


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns (A23): a, b, correlation; one aggregation for all pairs."""
    pairs = list(combinations_with_replacement(columns, 2))
    both = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)]
    n = F.count(F.lit(1))

    def pearson(a, b):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        vx, vy = F.var_pop(x), F.var_pop(y)
        return F.when((n > 1) & (vx > 0) & (vy > 0), F.try_divide(F.covar_pop(x, y), F.sqrt(vx) * F.sqrt(vy)))

    half = rows.agg(*(pearson(a, b).alias(f"_{k}") for k, (a, b) in enumerate(pairs))).select(F.inline(F.array(*both)))
    return half.unionByName(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "correlation"))
