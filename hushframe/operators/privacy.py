"""l-diversity and t-closeness of equivalence classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ec import require, with_class_size


def _small(df: DataFrame, qis: list[str], threshold: int | None) -> DataFrame:
    """Rows without a null QI, with their class size `_n`, of classes of at most `threshold` rows."""
    d = with_class_size(df.na.drop(subset=qis), qis, "_n")
    return d if threshold is None else d.where(F.col("_n") <= threshold)


def l_diversity(df: DataFrame, qis: list[str], sensitive: str, threshold: int | None = None) -> DataFrame:
    """(qis, n, l): distinct non-null sensitive values of each class of at most `threshold` rows (None: all)."""
    require(df, [*qis, sensitive])
    ec = df.na.drop(subset=qis).groupBy(*qis).agg(F.count("*").alias("n"), F.count_distinct(sensitive).alias("l"))
    return ec if threshold is None else ec.where(F.col("n") <= threshold)


def entropy_l_diversity(df: DataFrame, qis: list[str], sensitive: str, threshold: int | None = None) -> DataFrame:
    """(qis, n, entropy, effective_l): natural-log entropy of the sensitive values and its exponential."""
    require(df, [*qis, sensitive])
    cells = df.na.drop(subset=[*qis, sensitive]).groupBy(*qis, sensitive).agg(F.count("*").alias("c"))
    ec = cells.groupBy(*qis).agg(F.sum("c").alias("n"), (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("entropy"))
    ec = ec.withColumn("entropy", F.greatest("entropy", F.lit(0.0))).withColumn("effective_l", F.exp("entropy"))
    return ec if threshold is None else ec.where(F.col("n") <= threshold)


def t_closeness_categorical(df: DataFrame, qis: list[str], sensitive: str, threshold: int | None = None) -> DataFrame:
    """(qis, t): total variation between each class's distribution of a category and the table's.

    Values that a class lacks contribute their global share, so the sum over the class's own values gives all:
    TVD = sum over values of the class of max(p - q, 0). No class is crossed with the values it lacks.
    """
    require(df, [*qis, sensitive])
    d = df.where(F.col(sensitive).isNotNull())
    total = d.agg(F.count("*").alias("N"))
    world = d.groupBy(sensitive).agg(F.count("*").alias("g")).join(F.broadcast(total)).select(F.col(sensitive).alias("_v"), (F.col("g") / F.col("N")).alias("_q"))
    own = _small(d, qis, threshold).groupBy(*qis, sensitive).agg(F.count("*").alias("c"), F.first("_n").alias("_n"))
    return own.join(world, F.col(sensitive) == F.col("_v")).groupBy(*qis).agg(F.sum(F.greatest(F.col("c") / F.col("_n") - F.col("_q"), F.lit(0.0))).alias("t"))


def t_closeness_numeric(df: DataFrame, qis: list[str], sensitive: str, threshold: int | None = None) -> DataFrame:
    """(qis, t): earth mover's distance of a number between class and table, over its range.

    EMD = E|X-Y| - (E|X-X'| + E|Y-Y'|)/2 for the absolute distance would need squares; on a line it is the integral of
    |F_class - F_table|. That splits into pieces on which F_class is constant; on each, prefix integrals of F_table give the
    value once the crossing point is known. The table's distinct values are joined by rank, never crossed with classes.
    """
    require(df, [*qis, sensitive])
    d = df.where(F.col(sensitive).isNotNull()).withColumn("_x", F.col(sensitive).cast("double"))
    values = d.groupBy("_x").agg(F.count("*").alias("g"))
    bounds = d.agg(F.count("*").alias("N"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    if not bounds["N"] or bounds["hi"] == bounds["lo"]:
        return d.groupBy(*qis).agg(F.lit(0.0).alias("t"))
    grid = _grid(values, bounds["N"])
    spread = bounds["hi"] - bounds["lo"]
    own = _small(d, qis, threshold).groupBy(*qis, "_x").agg(F.count("*").alias("c"), F.first("_n").alias("_n"))
    steps = own.groupBy(*qis).agg(F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_x", "c"))).alias("s"))
    held = df.sparkSession.sparkContext.broadcast(grid)

    @F.pandas_udf("double")
    def emd(points, size):
        import numpy as np
        import pandas as pd

        xs, cum = held.value  # distinct values and the table's distribution function at them
        gaps = np.diff(xs)
        area = np.concatenate([[0.0], np.cumsum(cum[:-1] * gaps)])
        out = []
        for p, n in zip(points, size):
            v = np.array([r["_x"] for r in p])
            f = np.concatenate([[0.0], np.cumsum([r["c"] for r in p]) / n])
            a = np.concatenate([[0], np.searchsorted(xs, v)])
            b = np.append(a[1:], len(xs) - 1)
            cross = np.clip(np.searchsorted(cum, f, side="left"), a, b)  # the table lies below before, at or above from there on
            below = f * (xs[cross] - xs[a]) - (area[cross] - area[a])
            above = (area[b] - area[cross]) - f * (xs[b] - xs[cross])
            out.append(float((below + above).sum()) / spread)
        return pd.Series(out)

    return steps.select(*qis, emd(F.col("s"), F.col("_n")).alias("t"))


#: Most distinct values whose distribution function is broadcast (16 MB); a column with more must be rounded first.
MOST_VALUES = 1_000_000


def _grid(values: DataFrame, total: int):
    """The table's distribution function as two arrays of at most MOST_VALUES entries; more values raise an error."""
    import numpy as np

    n = values.count()
    if n > MOST_VALUES:
        raise ValueError(f"{n} distinct values, but at most {MOST_VALUES} can be compared exactly: round the column first")
    rows = values.toPandas().sort_values("_x")
    return rows["_x"].to_numpy(float), np.cumsum(rows["g"].to_numpy(float)) / total


def gates(df: DataFrame, qis: list[str], sensitive: str, least_l: int | None = None, most_t: float | None = None) -> dict[str, bool]:
    """Which privacy targets hold: the least l and the greatest t over all classes."""
    out = {}
    if least_l is not None:
        out["l"] = (l_diversity(df, qis, sensitive).agg(F.min("l")).first()[0] or 0) >= least_l
    if most_t is not None:
        kind = dict(df.dtypes)[sensitive]
        t = t_closeness_categorical if kind in ("string", "boolean") else t_closeness_numeric
        out["t"] = (t(df, qis, sensitive).agg(F.max("t")).first()[0] or 0.0) <= most_t
    return out
