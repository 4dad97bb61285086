"""Equivalence classes: the table of distinct quasi-identifier values with their counts, on which all risk figures rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> None:
    """Raises ValueError for an empty list or a column that df lacks, before any job runs."""
    if not columns:
        raise ValueError("no quasi-identifiers given")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def ec_sizes(df: DataFrame, qis: list[str], nulls: str = "exclude", count: str = "n") -> DataFrame:
    """(qis, n) of each class. nulls: 'exclude' drops rows with a null QI, 'as_value' lets null be a value of its own."""
    require(df, qis)
    if nulls not in ("exclude", "as_value"):
        raise ValueError("nulls must be 'exclude' or 'as_value'")
    d = df.select(*qis)
    return (d.na.drop() if nulls == "exclude" else d).groupBy(*qis).agg(F.count("*").alias(count))


def same_class(left: DataFrame, right: DataFrame, qis: list[str]) -> Column:
    """Null-safe equality of all QIs of two tables."""
    return reduce(lambda a, b: a & b, [left[q].eqNullSafe(right[q]) for q in qis])


def checkpoints(df: DataFrame) -> None:
    """Checkpoints go to the shared folder of spark.checkpoint.dir; to a temporary one where Spark runs in one process."""
    import tempfile

    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def with_class_size(df: DataFrame, columns: list[str], name: str, weight: str | None = None) -> DataFrame:
    """df with the size of each row's class (null is a value), rows or the sum of `weight`.

    Sizes are aggregated and joined back, so a class that holds most rows spreads over tasks, as it would not in a window.
    """
    df = df.drop(name)
    size = F.sum(weight) if weight else F.count("*")
    sizes = df.groupBy(*columns).agg(size.alias(name)).select(*[F.col(c).alias(f"_ec_{i}") for i, c in enumerate(columns)], name)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_ec_{i}")) for i, c in enumerate(columns)])
    return df.join(sizes, on).select(*df.columns, name)


def uniform(rid: Column, seed: int, salt: str) -> Column:
    """A draw in [0, 1) that depends on the row's identity, seed and salt alone, never on partitioning."""
    return F.xxhash64(rid, F.lit(seed), F.lit(salt)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def with_row_id(df: DataFrame, key: str | None = None, name: str = "_rid") -> DataFrame:
    """Adds a row identity: the key's hash, else the hash of all columns with the occurrence number of equal rows.

    Equal rows are interchangeable, so numbering them inside their own group needs no global order.
    """
    if key:
        return df.withColumn(name, F.xxhash64(F.col(key)))
    from pyspark.sql import Window as W

    h = F.xxhash64(*[F.col(c) for c in df.columns])
    d = df.withColumn(name, h)
    return d.withColumn(name, F.xxhash64(name, F.row_number().over(W.partitionBy(name).orderBy(F.lit(0)))))
