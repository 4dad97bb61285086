"""Swapping of values between records, and the risk-utility front of several results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import global_rank
from .ec import require, uniform, with_class_size


def rank_swap(df: DataFrame, columns: list[str], rid: str, share: float = 0.05, seed: int = 1) -> DataFrame:
    """Permutes each column among rows whose ranks are within `share` of the rows of each other.

    Ranks come from range partitions, blocks of neighbouring ranks are permuted by hashed draws, which are ranked by range
    partitions too, so that no block need fit in one task: the column keeps its distribution exactly. Nulls stay where they
    are.
    """
    require(df, [*columns, rid])
    n = df.count()
    width = max(2, int(n * share))
    for c in columns:
        part = df.where(F.col(c).isNotNull()).select(F.col(rid).alias("_r"), F.col(c).alias("_v"), uniform(F.col(rid), seed, c).alias("_u")).withColumn("_s", F.struct("_v", "_u", "_r"))
        ranked = global_rank(part, "_s", "_k").withColumn("_b", F.floor((F.col("_k") - 1) / width))
        drawn = ranked.select("_r", F.struct("_b", F.xxhash64("_r", F.lit(seed), F.lit(c + "'")).alias("_h"), "_r").alias("_d"))
        moved = global_rank(drawn, "_d", "_k").select("_r", "_k").join(ranked.select("_v", "_k"), "_k").select("_r", "_v")
        df = df.join(moved, F.col(rid) == F.col("_r"), "left").withColumn(c, F.col("_v")).select(*df.columns)
    return df


def record_swap(df: DataFrame, swap: list[str], match: list[str], rid: str, k: int = 3, seed: int = 1) -> DataFrame:
    """Exchanges the `swap` values of records in classes under k (over swap and match) with a drawn neighbour that agrees on
    `match`. Records pair up in hashed order inside their match group; a record without a partner keeps its values."""
    require(df, [*swap, *match, rid])
    sized = with_class_size(df, [*swap, *match], "_size")
    risky, calm = sized.where(F.col("_size") < k), sized.where(F.col("_size") >= k)  # only risky rows are put in order
    d = risky.withColumn("_i", F.row_number().over(W.partitionBy(*match).orderBy(uniform(F.col(rid), seed, "swap"), rid)))
    pair = W.partitionBy(*match, F.floor((F.col("_i") - 1) / 2)).orderBy("_i")
    for c in swap:
        other = F.coalesce(F.lead(F.struct(c)).over(pair), F.lag(F.struct(c)).over(pair))
        d = d.withColumn(f"_n_{c}", F.when(other.isNotNull(), other[c]).otherwise(F.col(c)))
    return d.select(*[F.col(f"_n_{c}").alias(c) if c in swap else F.col(c) for c in df.columns]).unionByName(calm.select(*df.columns))


def pareto(results: list[tuple[str, float, float]]) -> list[tuple[str, float, float]]:
    """Of (name, risk, utility), those that no other beats in one without losing in the other, by risk."""
    best = [r for r in results if not any((o[1] <= r[1] and o[2] >= r[2]) and (o[1] < r[1] or o[2] > r[2]) for o in results)]
    return sorted(best, key=lambda r: (r[1], -r[2], r[0]))
