"""Disclosure-risk aggregates over equivalence classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ec import ec_sizes, require, with_class_size

HIGH_RISK = 0.2


def record_risk(df: DataFrame, qis: list[str], name: str = "risk") -> DataFrame:
    """df without rows that have a null QI, with each row's risk 1/|class|. Class sizes are joined, so no class is one task."""
    require(df, qis)
    return with_class_size(df.na.drop(subset=qis), qis, name).withColumn(name, F.lit(1.0) / F.col(name))


def reid(df: DataFrame, qis: list[str], quantiles=(0.5, 0.95, 0.99), high: float = HIGH_RISK) -> DataFrame:
    """One row: risk quantiles over records (reid_50, ...), max, mean, records above `high`, evaluated and suppressed.

    Rows with a null QI are suppressed. Quantiles are exact and weighted by class size, so no row is joined.
    """
    ec = ec_sizes(df, qis)
    total = df.agg(F.count("*").alias("total"))
    r, n = F.lit(1.0) / F.col("n"), F.col("n")
    row = ec.agg(
        *[F.coalesce(F.percentile(r, F.lit(q), n), F.lit(0.0)).alias(f"reid_{round(q * 100)}") for q in quantiles],
        F.coalesce(F.max(r), F.lit(0.0)).alias("max_risk"),
        F.coalesce(F.count("*") / F.sum("n"), F.lit(0.0)).alias("mean_risk"),
        F.coalesce(F.sum(F.when(r > high, n)), F.lit(0)).alias("n_high"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"),
    )
    row = row.join(F.broadcast(total))  # two single rows
    return row.select(*row.columns[:-1], (F.col("total") - F.col("evaluated")).alias("suppressed"), F.when(F.col("evaluated") > 0, F.col("n_high") / F.col("evaluated")).otherwise(F.lit(0.0)).alias("high_rate"))


def k_check(df: DataFrame, qis: list[str], k: int, nulls: str = "exclude") -> DataFrame:
    """One row: n_groups, n_violations (groups under k), violating_rows, min_k, is_k_anonymous."""
    ec = ec_sizes(df, qis, nulls)
    small = F.col("n") < k
    return ec.agg(
        F.count("*").alias("n_groups"),
        F.count_if(small).alias("n_violations"),
        F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("violating_rows"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_k"),
        (F.count_if(small) == 0).alias("is_k_anonymous"),
    )


def uniqueness(df: DataFrame, qis: list[str]) -> DataFrame:
    """One row: n_unique, uniqueness (singletons over rows) and distinct_ratio (classes over rows)."""
    ec, total = ec_sizes(df, qis), df.agg(F.count("*").alias("total"))
    row = ec.agg(F.count_if(F.col("n") == 1).alias("n_unique"), F.count("*").alias("groups")).join(F.broadcast(total))
    over = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(0.0))
    return row.select("n_unique", over("n_unique").alias("uniqueness"), over("groups").alias("distinct_ratio"))


def disclosure_summary(df: DataFrame, qis: list[str], k: int = 3) -> DataFrame:
    """One row of seven figures: groups, mean and least size, unique records and rate, records and share under k."""
    ec = ec_sizes(df, qis)
    n = F.col("n")
    return ec.agg(
        F.count("*").alias("n_groups"), F.avg("n").alias("mean_size"), F.min("n").alias("min_size"), F.count_if(n == 1).alias("n_unique"),
        (F.count_if(n == 1) / F.sum("n")).alias("unique_rate"), F.coalesce(F.sum(F.when(n < k, n)), F.lit(0)).alias("at_risk"),
        (F.coalesce(F.sum(F.when(n < k, n)), F.lit(0)) / F.sum("n")).alias("at_risk_rate"),
    )


def rare_combinations(df: DataFrame, qis: list[str], threshold: int = 3) -> DataFrame:
    """Classes of fewer than `threshold` rows."""
    return ec_sizes(df, qis).where(F.col("n") < threshold)


def risk_above(df: DataFrame, qis: list[str], alpha: float) -> DataFrame:
    """Records whose risk exceeds the (1 - alpha) quantile of record risks."""
    cut = ec_sizes(df, qis).agg(F.percentile(F.lit(1.0) / F.col("n"), F.lit(1 - alpha), F.col("n")).alias("_cut"))
    return record_risk(df, qis).join(F.broadcast(cut), F.col("risk") > F.col("_cut")).drop("_cut")


def importance(df: DataFrame, qis: list[str], quantile: float = 0.95) -> DataFrame:
    """(qi, reid_without, reid_all, importance): how much the risk quantile falls without each QI.

    One class table at the finest grain, rolled up for all subsets at once by grouping sets. A null QI is a value here.
    """
    ec = ec_sizes(df, qis, "as_value").cache()
    sets = [[c for c in qis if c != q] for q in qis] + [list(qis)]
    rolled = ec.groupingSets(sets, *qis).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    by = rolled.groupBy("g").agg(F.percentile(F.lit(1.0) / F.col("n"), F.lit(quantile), F.col("n")).alias("reid"))
    m = len(qis)
    names = F.create_map(*[x for i, q in enumerate(qis) for x in (F.lit(1 << (m - 1 - i)), F.lit(q))])
    full = by.where("g = 0").select(F.col("reid").alias("reid_all"))
    out = by.where("g > 0").join(F.broadcast(full))
    return out.select(names[F.col("g").cast("int")].alias("qi"), F.col("reid").alias("reid_without"), "reid_all", (F.col("reid_all") - F.col("reid")).alias("importance"))


def backward_elimination(df: DataFrame, qis: list[str], quantile: float = 0.95) -> list[tuple[str, float]]:
    """QIs in the order in which leaving them out lowers the risk quantile most, with the quantile left each time."""
    left, out = list(qis), []
    while len(left) > 1:
        rows = importance(df, left, quantile).collect()
        best = min(rows, key=lambda r: (r["reid_without"], r["qi"]))
        out.append((best["qi"], best["reid_without"]))
        left.remove(best["qi"])
    return out


def outliers(df: DataFrame, columns: list[str], iqr: float = 1.5, z: float = 3.0) -> DataFrame:
    """(column, lower, upper, n_iqr, n_z) of numeric columns: values outside the IQR fences, and beyond z deviations."""
    require(df, columns)
    first = df.agg(*[F.struct(F.percentile(c, F.lit(0.25)).alias("q1"), F.percentile(c, F.lit(0.75)).alias("q3"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).first()
    parts = []
    for c in columns:
        s = first[c]
        spread = (s["q3"] or 0) - (s["q1"] or 0)
        lo, hi = (None, None) if s["q1"] is None else (s["q1"] - iqr * spread, s["q3"] + iqr * spread)
        v = F.col(c)
        far = F.count_if(F.abs(v - F.lit(s["m"])) > z * s["s"]) if s["s"] else F.lit(0).cast("long")
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(lo).cast("double").alias("lower"), F.lit(hi).cast("double").alias("upper"), F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias("n_iqr"), far.alias("n_z")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def dimensionality(df: DataFrame, qis: list[str]) -> DataFrame:
    """One row: combination_space (product of cardinalities), space_ratio, n_distinct combinations, distinct_ratio."""
    require(df, qis)
    a = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"c_{c}") for c in qis])
    b = df.select(*qis).distinct().agg(F.count("*").alias("n_distinct"))
    space = F.lit(1.0)
    for c in qis:
        space = space * F.col(f"c_{c}")
    return a.join(F.broadcast(b)).select(space.alias("combination_space"), (space / F.col("n")).alias("space_ratio"), "n_distinct", (F.col("n_distinct") / F.col("n")).alias("distinct_ratio"))


def entropy_bits(df: DataFrame, column: str) -> DataFrame:
    """One row: Shannon entropy in bits of the non-null values."""
    c = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # H = log2 N - sum(n log2 n) / N, so no second pass needs N
    return c.agg(F.coalesce(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), F.lit(0.0)).alias("entropy_bits"))


def small_cells(table: DataFrame, dims: list[str], threshold: int = 5) -> DataFrame:
    """One row: cells, small (0 < value < threshold) and zero cells of a frequency table and their shares."""
    cells = [c for c in table.columns if c not in dims]
    n = table.agg(F.count("*").alias("r"), *[F.struct(F.count_if((F.col(c) > 0) & (F.col(c) < threshold)).alias("s"), F.count_if(F.col(c) == 0).alias("z")).alias(c) for c in cells])
    s, z = sum((F.col(c)["s"] for c in cells), F.lit(0)), sum((F.col(c)["z"] for c in cells), F.lit(0))
    total = F.col("r") * len(cells)
    return n.select(total.alias("n_cells"), s.alias("n_small"), z.alias("n_zero"), (s / total).alias("small_rate"), (z / total).alias("zero_rate"))


def small_cell_mask(table: DataFrame, dims: list[str], threshold: int = 5) -> DataFrame:
    return table.select(*dims, *[(F.col(c) < threshold).alias(c) for c in table.columns if c not in dims])


#: Levels in falling order; one holds if a figure exceeds its bound (min size: falls below).
LEVELS = [
    ("critical", {"uniqueness": 0.10, "risk_rate": 0.15, "min_size": 0}),
    ("high", {"uniqueness": 0.05, "risk_rate": 1.0, "min_size": 2}),
    ("medium", {"uniqueness": 0.02, "risk_rate": 0.05, "min_size": 0}),
]


def risk_level(uniqueness: float, risk_rate: float, min_size: int, k_anonymous: bool = True) -> str:
    """critical, high, medium or low; a table that is not k-anonymous is at least high."""
    for name, most in LEVELS:
        if uniqueness > most["uniqueness"] or risk_rate > most["risk_rate"] or min_size < most["min_size"] or (name == "high" and not k_anonymous):
            return name
    return "low"


def risk_pattern(r50: float, r95: float, r99: float, mean: float = 0.0) -> str:
    """Shape of the risk distribution from its quantiles: the first rule that holds names it."""
    tail = r99 / r50 if r50 > 0 else 100.0 if r99 > 0 else 1.0
    shapes = {
        "uniform_high": r50 > 0.20 and r99 - r50 < 0.10,
        "widespread": r50 > 0.20,
        "severe_tail": tail > 10 and r99 > 0.30,
        "tail": r95 > 0.30 or (tail > 5 and (r99 > 0.50 or (r50 < 0.05 and r99 > 0.20))),
        "uniform_low": r50 < 0.05,
        "bimodal": abs(mean - r50) > 0.15,
    }
    return next((name for name, holds in shapes.items() if holds), "moderate")


@dataclass
class Assessment:
    metric: str
    raw: float
    normalized: float
    target: float
    meets: bool


def assess(df: DataFrame, qis: list[str], metric: str, target: float, sensitive: str | None = None) -> Assessment:
    """One of reid95, k_anonymity, uniqueness and l_diversity, raw and as a risk from 0 to 1 (1/k, 1/l)."""
    if metric == "reid95":
        raw = reid(df, qis, (0.95,)).first()["reid_95"]
        return Assessment(metric, raw, raw, target, raw <= target)
    if metric == "k_anonymity":
        k = k_check(df, qis, 1).first()["min_k"]
        return Assessment(metric, k, 1 / k if k else 0.0, target, not k or k >= target)
    if metric == "uniqueness":
        raw = uniqueness(df, qis).first()["uniqueness"]
        return Assessment(metric, raw, raw, target, raw <= target)
    if metric == "l_diversity":
        from .privacy import l_diversity

        value = l_diversity(df, qis, sensitive).agg(F.min("l")).first()[0] or 0
        return Assessment(metric, value, 1 / value if value else 0.0, target, not value or value >= target)
    raise ValueError(f"unknown metric {metric}")


