"""Summaries of tables, preparations and results, and what to do where a protection run failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hierarchy import NUMERIC
from ..operators.ec import require
from ..operators.risk import Assessment, reid


def summary(df: DataFrame) -> DataFrame:
    """(column, kind, n, n_null, n_distinct, low, high): what each column holds, from one aggregate.

    kind: numeric, date or category; low and high are of numeric columns. An empty table has counts of zero.
    """
    kind = lambda t: "numeric" if t in NUMERIC or t.startswith("decimal") else "date" if t.startswith(("date", "timestamp")) else "category"
    none = F.lit(None).cast("double")
    parts = []
    for c, t in df.dtypes:
        x, number = F.col(f"`{c}`"), kind(t) == "numeric"
        low, high = (F.min(x).cast("double"), F.max(x).cast("double")) if number else (none, none)
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kind(t)).alias("kind"), F.count("*").alias("n"), (F.count("*") - F.count(x)).alias("n_null"), F.count_distinct(x).alias("n_distinct"), low.alias("low"), high.alias("high")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def variable_roles(df: DataFrame, most_categories: int = 50, least_values: int = 20) -> DataFrame:
    """(column, role): continuous numbers (over `least_values` distinct), categorical columns (up to `most_categories`), dates,
    identifiers (a distinct value a row) and other."""
    s = summary(df)
    values = F.col("n") - F.col("n_null")
    role = (
        F.when(F.col("kind") == "date", "date")
        .when((F.col("n_distinct") == values) & (F.col("n_distinct") > most_categories), "identifier")
        .when((F.col("kind") == "numeric") & (F.col("n_distinct") > least_values), "continuous")
        .when(F.col("n_distinct") <= most_categories, "categorical")
        .otherwise("other")
    )
    return s.select("column", role.alias("role"))


#: The shares of a normalized risk that stand for the quantiles of a metric that has none.
QUANTILES = {"reid_50": 0.5, "reid_90": 0.8, "reid_95": 1.0, "reid_99": 1.2, "mean_risk": 0.6, "max_risk": 1.5}


def as_quantiles(a: Assessment) -> dict[str, float]:
    """Risk quantiles that stand for an assessment by another metric, so that rules which read them apply."""
    out = {name: min(1.0, a.normalized * share) if share > 1 else a.normalized * share for name, share in QUANTILES.items()}
    out["high_rate"] = min(0.5 * a.normalized, 1.0) if a.normalized > 0.20 else 0.0
    return out


def preparation_report(before: DataFrame, after: DataFrame, qis: list[str]) -> DataFrame:
    """(figure, before, after): rows, each QI's cardinality, their product over rows, and the 95 % risk quantile."""
    require(before, qis)

    def figures(d: DataFrame) -> dict[str, float]:
        r = d.agg(F.count("*").alias("rows"), *[F.count_distinct(q).alias(f"values_{q}") for q in qis]).first().asDict()
        space = 1.0
        for q in qis:
            space *= max(1, r[f"values_{q}"])
        return {**r, "expected_size": r["rows"] / space, "reid_95": reid(d, qis, (0.95,)).first()["reid_95"]}

    a, b = figures(before), figures(after)
    return before.sparkSession.createDataFrame([(k, float(a[k]), float(b[k])) for k in a], "figure string, before double, after double")


def guidance(after: float, target: float, suppressed: float, utility: float, method: str, qis: list[str], cardinality: dict[str, int]) -> list[str]:
    """What to try where a run missed: nothing if it met its target with bearable losses."""
    out = []
    if after > target:
        widest = max(qis, key=lambda q: (cardinality.get(q, 0), q))
        out.append(f"risk {after:.3f} is above {target:.3f}: generalize {widest} ({cardinality.get(widest, 0)} values) or leave it out")
        if method in ("PRAM", "NOISE"):
            out.append(f"{method} leaves classes as they are: use kANON or LOCSUPR for this target")
        elif method in ("kANON", "LOCSUPR"):
            out.append("raise k")
        if after > 2 * target and len(qis) > 4:
            out.append("drop quasi-identifiers of little use: classes of so many columns stay small")
    if suppressed > 0.3:
        out.append("over 30 % of the records lost a value: generalize before suppressing, or lower k")
    if utility < 0.5:
        out.append("utility is under .5: relax the target or treat fewer columns")
    return out


#: Least utility of good, fair and poor results that met their target.
GRADES = [("good", 0.70), ("fair", 0.50), ("poor", 0.0)]


def grade(after: float, target: float, utility: float) -> str:
    """good, fair or poor by utility where the target is met; near miss within a tenth of it; failed otherwise."""
    if after <= target:
        return next(name for name, least in GRADES if utility >= least)
    return "near_miss" if after <= 1.1 * target else "failed"
