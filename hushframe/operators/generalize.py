"""GENERALIZE: recoding of quasi-identifiers to fewer categories, column by column, under a utility gate."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import by_edges, equal_width, floor_to, quantile_edges, top_values, truncate_date
from ..functions.hierarchy import NUMERIC, skewness
from .ec import require
from .risk import reid

#: Most categories of each tier.
TIERS = {"light": 15, "moderate": 10, "aggressive": 5, "very_aggressive": 3}
#: Cardinality above which a numeric column keeps at least so many bins.
BIN_FLOORS = [(5000, 15), (1000, 10), (0, 5)]


def numeric_bins(c: Column, width: float) -> Column:
    """Labels lo-hi of left-closed bins; whole widths name the last whole number inside."""
    if float(width).is_integer() and width >= 1:
        lo = (floor_to(c, width) * int(width)).cast("bigint")
        return F.concat(lo.cast("string"), F.lit("-"), (lo + int(width) - 1).cast("string"))
    places = max(1, 1 - math.floor(math.log10(abs(width))))
    ten = 10**places
    label = lambda v: F.format_string(f"%.{places}f", F.bround(v * ten, 0) / ten)
    lo = floor_to(c, width) * F.lit(float(width))
    return F.when(c.isNotNull(), F.concat(label(lo), F.lit("-"), label(lo + F.lit(float(width)))))


def generalize_numeric(df: DataFrame, column: str, most: int) -> DataFrame:
    """Equal-width bins, or quantile bins where |skewness| exceeds 3; at least 5, 10 or 15 bins by cardinality."""
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_distinct(column).alias("k")).first()
    if r["lo"] is None or r["k"] <= 1:
        return df
    bins = max(most, min(r["k"], next(b for k, b in BIN_FLOORS if r["k"] > k)))
    if abs(skewness(df, column)) > 3:
        edges = quantile_edges(df, column, bins)
        if len(edges) > 2:
            return df.withColumn(column, by_edges(F.col(column), edges))
    return df.withColumn(column, numeric_bins(F.col(column), equal_width(float(r["lo"]), float(r["hi"]), bins)))


def date_grain_for(df: DataFrame, column: str, most: int) -> str:
    """The finest of month, quarter and year with at most `most` and at least three periods, else year."""
    grains = ["month", "quarter", "year"]
    r = df.agg(*[F.count_distinct(truncate_date(F.col(column), g)).alias(g) for g in grains]).first()
    return next((g for g in grains if 3 <= r[g] <= most), "year")


def generalize_date(df: DataFrame, column: str, most: int) -> DataFrame:
    return df.withColumn(column, truncate_date(F.col(column), date_grain_for(df, column, most)))


def generalize_category(df: DataFrame, column: str, most: int) -> DataFrame:
    """Keeps the most - 1 most frequent values."""
    if df.agg(F.count_distinct(column)).first()[0] <= most:
        return df
    return top_values(df, column, most - 1)


def recode(df: DataFrame, column: str, most: int) -> DataFrame:
    kind = dict(df.dtypes)[column]
    if kind.startswith(("date", "timestamp")):
        return generalize_date(df, column, most)
    if kind in NUMERIC or kind.startswith("decimal"):
        return generalize_numeric(df, column, most)
    return generalize_category(df, column, most)


def cardinalities(df: DataFrame, columns: list[str]) -> dict[str, int]:
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first().asDict()


def risk_limits(importances: dict[str, float], most: int) -> dict[str, int]:
    """Fewer categories for QIs that carry more risk: half from 15 % of it, 1.5 times under 3 %."""
    total = sum(importances.values()) or 1.0
    return {c: max(3, round(most * (0.5 if v / total >= 0.15 else 1.5 if v / total < 0.03 else 1))) for c, v in importances.items()}


@dataclass
class Generalized:
    df: DataFrame
    applied: list[str] = field(default_factory=list)
    rolled_back: list[str] = field(default_factory=list)
    reid_95: float | None = None


def generalize(df: DataFrame, qis: list[str], most: int = 10, strategy: str = "auto", target: float | None = None, utility: Callable[[DataFrame, str], float] | None = None, least_utility: float = 0.0, limits: dict[str, int] | None = None) -> Generalized:
    """Recodes QIs of more than `most` values in falling order of cardinality.

    strategy: auto and all take every type, numeric and categorical one. A step whose utility falls under the gate is rolled
    back; the loop ends once reid_95 reaches the target. Only column expressions pile up; nothing is copied.
    """
    require(df, qis)
    kinds = dict(df.dtypes)
    number = lambda c: kinds[c] in NUMERIC or kinds[c].startswith("decimal")
    card = cardinalities(df, qis)
    limits = limits or {}
    chosen = [c for c in qis if card[c] > limits.get(c, most) and (strategy in ("auto", "all") or (strategy == "numeric") == number(c))]
    out = Generalized(df)
    for c in sorted(chosen, key=lambda c: (-card[c], c)):
        step = recode(out.df, c, limits.get(c, most))
        if utility is not None and utility(step, c) < least_utility:
            out.rolled_back.append(c)
            continue
        out.df = step
        out.applied.append(c)
        if target is not None:
            out.reid_95 = reid(out.df, qis, (0.95,)).first()["reid_95"]
            if out.reid_95 <= target:
                break
    return out


def suggest(df: DataFrame, qis: list[str], k: int = 5) -> dict[str, int]:
    """Most categories for each QI so that the combination space falls to rows / k: the largest are cut first."""
    card, n = cardinalities(df, qis), df.count()
    budget = max(1.0, n / k)
    out = dict(card)
    while math.prod(out.values()) > budget and max(out.values()) > 3:
        worst = max(out, key=lambda c: (out[c], c))
        out[worst] = max(3, out[worst] // 2)
    return {c: v for c, v in out.items() if v < card[c]}




def candidates(most: int, cardinality: int, treatment: str = "standard") -> list[int]:
    """Three numbers of bins to try around `most`, gentlest (most bins) first; heavy and light treatment shift them.

    Fixed values: standard halves and adds a half; heavy goes down to a third, light up to the double, never over the cardinality.
    """
    wide, wider = min(cardinality, int(most * 1.5)), min(cardinality, most * 2)
    tries = {"heavy": [max(2, most // 3), max(2, most // 2), most], "standard": [max(3, most // 2), most, wide], "light": [most, wide, wider]}[treatment]
    return sorted({c for c in tries if c >= 2}, reverse=True)


def generalize_adaptively(df: DataFrame, column: str, most: int, passes, treatment: str = "standard") -> tuple[DataFrame, int]:
    """(df, bins) with the gentlest candidate whose result `passes`; the coarsest where none does."""
    known = df.agg(F.count_distinct(column)).first()[0]
    tries = candidates(most, known, treatment)
    for bins in tries:
        out = df.withColumn(column, numeric_bins(F.col(column), equal_width(*[float(x) for x in df.agg(F.min(column), F.max(column)).first()], bins))) if known > bins else df
        if passes(out):
            return out, bins
    return out, tries[-1]
