"""Generalization ladders: for a column, one expression for each level from the value itself to '*'.

Levels are computed from the original value, never from another level's label, so no value map is built or joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import by_edges, floor_to, plain, remap, truncate_date

Level = Callable[[Column], Column]


def starred(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("*"))


@dataclass
class Ladder:
    """levels[0] is the identity; the last one is '*'. names describe them."""

    column: str
    kind: str
    levels: list[Level]
    names: list[str] = field(default_factory=list)

    @property
    def height(self) -> int:
        return len(self.levels) - 1

    def at(self, level: int) -> Column:
        return self.levels[min(level, self.height)](F.col(self.column))

    def info_loss(self, df: DataFrame) -> list[float]:
        """1 - cardinality(level) / cardinality(0) of each level, in one aggregate."""
        row = df.agg(*[F.count_distinct(self.at(i)).alias(f"l{i}") for i in range(len(self.levels))]).first()
        return [1 - n / row[0] if row[0] else 0.0 for n in row]


def nice(x: float) -> int:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that reaches x, as a whole number of at least 1."""
    if x <= 0:
        return 1
    unit = 10.0 ** math.floor(math.log10(x))
    return max(1, int(min(f for f in (1, 2, 2.5, 5, 10) if f >= x / unit - 1e-12) * unit))


def skewness(df: DataFrame, column: str) -> float:
    """Bias-adjusted skewness (G1); 0 for fewer than three values or none that differ."""
    r = df.agg(F.count(column).alias("n"), F.skewness(column).alias("g")).first()
    n = r["n"]
    return r["g"] * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 and r["g"] is not None and not math.isnan(r["g"]) else 0.0


def bound_label(sign: str, v: float) -> str:
    return sign + (str(int(v)) if v == int(v) else f"{v:.1f}")


def interval_ladder(df: DataFrame, column: str, base: float | None = None, levels: int = 4, top: float | None = None, bottom: float | None = None) -> Ladder:
    """Intervals of width base * 2^(level - 1); values beyond the 98th and below the 2nd percentile become >= and <= bounds.

    The base is nice(range / 50), or 5 where values look like ages; level 1 takes quantiles where |skewness| exceeds 3.
    """
    r = df.agg(F.percentile(column, F.array(F.lit(0.02), F.lit(0.98))).alias("p"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_distinct(column).alias("k")).first()
    if r["lo"] is None:
        return Ladder(column, "interval", [lambda c: c, starred], ["value", "*"])
    low, high = float(r["lo"]), float(r["hi"])
    t, b = float(r["p"][1]) if top is None else top, float(r["p"][0]) if bottom is None else bottom
    spread = max(high - low, 1)
    if base is None:
        base = 5 if low >= 0 and high <= 135 and spread > 10 else nice(spread / 50)

    def at(width: float) -> Level:
        def label(c: Column) -> Column:
            lo = (floor_to(c, width) * F.lit(float(width))).cast("bigint")
            inside = F.concat(lo.cast("string"), F.lit("-"), (lo + int(width) - 1).cast("string"))
            return F.when(c > t, F.lit(bound_label(">=", t))).when(c < b, F.lit(bound_label("<=", b))).when(c.isNotNull(), inside)

        return label

    steps = [at(base * 2**i) for i in range(levels)]
    if abs(skewness(df, column)) > 3:
        bins = min(50, max(2, r["k"]))
        edges = sorted(set(df.agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0]))
        if len(edges) > 1:
            names = [f"{plain(x)}-{plain(y)}" for x, y in zip(edges, edges[1:])]
            steps[0] = lambda c: by_edges(c, edges, names)
    return Ladder(column, "interval", [lambda c: c, *steps, starred], ["value", *[f"width {base * 2**i:g}" for i in range(levels)], "*"])


def date_grain(c: Column, grain: str) -> Column:
    """Ladder labels: 2024-03-05, ISO week 2024-W10, 2024-03, 2024-Q1, 2024."""
    if grain == "day":
        return F.date_format(c, "yyyy-MM-dd")
    if grain == "week":
        thursday = F.date_add(c.cast("date"), 3 - F.weekday(c))
        return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
    if grain == "quarter":
        return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))
    return truncate_date(c, grain)


def date_ladder(df: DataFrame, column: str, grains=("day", "week", "month", "quarter", "year")) -> Ladder:
    """Day (from 90 days of span), ISO week (from 180), month, quarter and year."""
    r = df.agg(F.datediff(F.max(column), F.min(column)).alias("d")).first()
    span = r["d"] or 0
    used = [g for g in grains if span >= {"day": 90, "week": 180}.get(g, 0)] or ["year"]
    return Ladder(column, "date", [lambda c: c, *[lambda c, g=g: date_grain(c, g) for g in used], starred], ["value", *used, "*"])


def mask_ladder(df: DataFrame, column: str, right: bool = True, levels: int | None = None) -> Ladder:
    """One more * from the right (or left) at each level, up to the longest value."""
    longest = df.agg(F.max(F.length(F.col(column).cast("string")))).first()[0] or 0
    n = min(longest, levels or longest)

    def at(i: int) -> Level:
        def label(c: Column) -> Column:
            s = c.cast("string")
            keep = F.greatest(F.length(s) - i, F.lit(0))
            return F.rpad(F.left(s, keep), F.length(s), F.lit("*")) if right else F.lpad(F.right(s, keep), F.length(s), F.lit("*"))

        return label

    return Ladder(column, "masking", [lambda c: c, *[at(i) for i in range(1, n)], starred], ["value", *[f"{i} masked" for i in range(1, n)], "*"])


def category_ladder(df: DataFrame, column: str, groups: dict[str, list[str]] | None = None, least_share: float = 0.01, top: int | None = None) -> Ladder:
    """Rare values to Other, then the most frequent 3 to 10 (root of the cardinality); or groups, then the ungrouped to Other."""
    if groups:
        to = {m: g for g, members in groups.items() for m in members}
        second = lambda c: F.when(c.isNotNull(), F.when(c.isin(list(to)), remap(c, to)).otherwise(F.lit("Other")))
        return Ladder(column, "categorical", [lambda c: c, lambda c: remap(c, to), second, starred], ["value", "groups", "groups or Other", "*"])
    if least_share < 1e-4:
        raise ValueError("least_share must be at least 0.0001, as its frequent values become a list")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")).cache()
    facts = counts.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    top = top or max(3, min(10, math.isqrt(facts["k"])))
    least = max(1, int(facts["n"] * least_share))
    # at most 1 / least_share values reach their share; fewer rows than that leave every value frequent
    often = [r["v"] for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "v").collect()]
    best = [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(top).collect()]
    counts.unpersist()
    keep = lambda values: lambda c: F.when(c.isNotNull(), F.when(c.cast("string").isin(values), c.cast("string")).otherwise(F.lit("Other")))
    return Ladder(column, "categorical", [lambda c: c, keep(often), keep(best), starred], ["value", "rare merged", f"top {top}", "*"])


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def auto_ladder(df: DataFrame, column: str) -> Ladder | None:
    """The ladder that the column's type and content ask for; None for two values or fewer and for free text."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    r = df.agg(F.count(column).alias("n"), F.approx_count_distinct(column).alias("k"), F.avg(F.length(c.cast("string"))).alias("len"), F.avg(c.cast("string").rlike(r"^\d{3,}$").cast("int")).alias("digits")).first()
    if not r["n"] or r["k"] <= 2:
        return None
    if kind.startswith(("date", "timestamp")):
        return date_ladder(df, column)
    if kind in NUMERIC or kind.startswith("decimal"):
        return interval_ladder(df, column)
    if kind != "string" or (r["len"] or 0) > 50:
        return None
    return mask_ladder(df, column) if (r["digits"] or 0) > 0.8 else category_ladder(df, column)
