"""Preparing a table before protection: identifiers, coding, rare values, recoding, feasibility."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import detect, generalize
from ..operators.ec import require
from ..operators.risk import outliers, reid

MODES = ("none", "report_only", "mandatory_only", "auto", "full")


@dataclass
class Prepared:
    df: DataFrame
    steps: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def prepare(df: DataFrame, qis: list[str], mode: str = "auto", sensitive: list[str] | None = None, identifiers: str = "drop", salt: str = "", most: int = 20) -> Prepared:
    """Identifiers first (drop, hash or pseudonym; never QIs or sensitive columns), then coding, rare values, recoding.

    Coding applies where some but under 10 % of values are outliers, merging where over a fifth of the categories are rare,
    recoding (full: always; auto: over `most` values) last. report_only and none change nothing, mandatory_only stops after
    the identifiers. A QI space wider than the rows gives a warning.
    """
    require(df, qis)
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    out = Prepared(df)
    if mode == "none":
        return out
    keep = {*qis, *(sensitive or [])}
    ids = {c: k for c, k in detect.direct_identifiers(df).items() if c not in keep}
    prof = {c: p for c, p in detect.profile(df).items() if c in qis}
    note = lambda step, c: out.steps.append((step, c))
    for c in ids:
        note(identifiers, c)
        if mode == "report_only":
            continue
        if identifiers == "drop":
            out.df = out.df.drop(c)
        elif identifiers == "hash":
            out.df = out.df.withColumn(c, cells.hashed(F.col(c), salt))
        else:
            out.df = cells.pseudonyms(out.df, c)
    if mode == "mandatory_only":
        return out
    nums = [c for c, p in prof.items() if p.kind == "continuous"]
    n = df.count()
    if nums and n:
        for r in outliers(df, nums).collect():
            if 0 < r["n_iqr"] / n < 0.10:
                note("coding", r["column"])
                if mode != "report_only":
                    out.df = cells.top_bottom_code(out.df, [r["column"]])
    for c in [c for c, p in prof.items() if p.kind == "categorical" and dict(df.dtypes)[c] == "string"]:
        f = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.avg((F.col("n") < 10).cast("double")).alias("rare")).first()
        if (f["rare"] or 0) > 0.2:
            note("merge", c)
            if mode != "report_only":
                out.df = cells.merge_rare(out.df, c)
    if mode in ("auto", "full"):
        limits = [c for c, p in prof.items() if p.distinct > (most if mode == "auto" else 2)]
        if limits:
            g = generalize.generalize(out.df, limits, most)
            out.df = g.df
            out.steps += [("generalize", c) for c in g.applied]
    space = math.prod(max(1, p.distinct) for p in prof.values())
    if n and space > n:
        out.warnings.append(f"{space} combinations of quasi-identifiers for {n} rows")
    return out


def prepare_gated(df: DataFrame, qis: list[str], utility: Callable[[DataFrame, DataFrame], float], least: float, **how) -> Prepared:
    """prepare() step by step: a step that takes utility under the gate (recoding: .8 of it) is taken back."""
    now = Prepared(df)
    ids = prepare(df, qis, "mandatory_only", **how)
    now.df, now.steps = ids.df, ids.steps
    for name, step, gate in (
        ("coding", lambda d: cells.top_bottom_code(d, [q for q in qis if dict(d.dtypes)[q] in detect.NUMERIC]), least),
        ("merge", lambda d: _merge_all(d, qis), least),
        ("generalize", lambda d: generalize.generalize(d, qis, 20).df, 0.8 * least),
    ):
        made = step(now.df)
        if utility(df, made) >= gate:
            now.df = made
            now.steps.append((name, ",".join(qis)))
        else:
            now.warnings.append(f"{name} taken back")
    return now


def _merge_all(df: DataFrame, qis: list[str]) -> DataFrame:
    for q in qis:
        if dict(df.dtypes)[q] == "string":
            df = cells.merge_rare(df, q)
    return df


def typed_plan(df: DataFrame, qis: list[str], most: int = 15) -> dict[str, tuple[str, dict]]:
    """Action for each QI by type and content: dates by the finest grain that fits, ages in fives, codes coarsened, else bins or top values."""
    prof = detect.profile(df)
    plan: dict[str, tuple[str, dict]] = {}
    for q in qis:
        p, words = prof[q], detect.tokens(q)
        if p.distinct <= most:
            continue
        if p.kind == "date":
            plan[q] = ("date", {"grain": generalize.date_grain_for(df, q, most)})
        elif p.low is not None and ("age" in words or (0 <= p.low and (p.high or 0) <= 120 and p.high > 50 and "size" not in words)):
            plan[q] = ("age", {"width": 5 if p.distinct <= 75 else 10})
        elif any(w in words for w in ("zip", "postal", "postcode")):
            plan[q] = ("place", {"keep": 3})
        elif p.kind == "continuous" or p.low is not None:
            plan[q] = ("bins", {"bins": most})
        else:
            plan[q] = ("top", {"keep": most - 1})
    return plan


def apply_plan(df: DataFrame, plan: dict[str, tuple[str, dict]]) -> DataFrame:
    for q, (action, p) in plan.items():
        if action == "date":
            df = df.withColumn(q, cells.truncate_date(F.col(q), p["grain"]))
        elif action == "age":
            df = df.withColumn(q, cells.age_bins(F.col(q), p["width"]))
        elif action == "place":
            df = df.withColumn(q, cells.coarsen_place(F.col(q).cast("string"), p["keep"]))
        elif action == "bins":
            edges = cells.quantile_edges(df, q, p["bins"])
            df = df.withColumn(q, cells.by_edges(F.col(q), edges)) if len(edges) > 2 else generalize.generalize_numeric(df, q, p["bins"])
        elif action == "top":
            df = cells.top_values(df, q, p["keep"])
        elif action != "keep":
            raise ValueError(f"unknown action {action}")
    return df


def diagnose(df: DataFrame, qis: list[str], k: int = 5) -> DataFrame:
    """One row: status FEASIBLE, HARD or VERY_HARD, expected and mean class size, share of classes and of records under k."""
    card = generalize.cardinalities(df, qis)
    ec = df.groupBy(*qis).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.avg("n").alias("mean_size"), F.avg((F.col("n") < k).cast("double")).alias("classes_below_k"),
        (F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)) / F.sum("n")).alias("records_below_k"),
    )
    expected = F.col("rows") / F.lit(float(math.prod(max(1, c) for c in card.values())))
    status = F.when(F.col("records_below_k") <= 0.10, "FEASIBLE").when(F.col("records_below_k") <= 0.50, "HARD").otherwise("VERY_HARD")
    return ec.select(status.alias("status"), expected.alias("expected_size"), "mean_size", "classes_below_k", "records_below_k")


def ensure_feasible(df: DataFrame, qis: list[str], k: int = 5) -> tuple[list[str], int]:
    """QIs and k with which at most half of the records are under k: drops the largest QI, then lowers k."""
    left = list(qis)
    while len(left) > 2 and diagnose(df, left, k).first()["status"] == "VERY_HARD":
        card = generalize.cardinalities(df, left)
        left.remove(max(left, key=lambda q: (card[q], q)))
    while k > 2 and diagnose(df, left, k).first()["status"] == "VERY_HARD":
        k -= 1
    return left, k


def adaptive(df: DataFrame, qis: list[str], target: float = 0.05, start: str = "light") -> tuple[DataFrame, str, float]:
    """Recodes by growing tiers until reid_95 meets the target; (df, tier, reid_95) of the last."""
    tiers = list(generalize.TIERS)
    out, tier, r = df, start, 1.0
    for tier in tiers[tiers.index(start) :]:
        out = generalize.generalize(df, qis, generalize.TIERS[tier]).df
        r = reid(out, qis, (0.95,)).first()["reid_95"]
        if r <= target:
            break
    return out, tier, r


def badge(expected: float) -> str:
    """Bands of the expected class size as shown to users."""
    return "good" if expected >= 10 else "fair" if expected >= 5 else "poor" if expected >= 2 else "bad"
