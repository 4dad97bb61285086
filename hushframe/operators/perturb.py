"""Perturbation: post-randomization of categories (PRAM) and additive noise on numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ec import require, uniform

Matrix = dict[str, dict[str, float]]

#: Most categories of a transition matrix; a cell for each pair of them travels with the plan.
MOST_CATEGORIES = 500


def uniform_matrix(categories: list[str], p_change: float, pd_min: float = 0.01) -> Matrix:
    """Values stay with max(1 - p_change, pd_min) and else move to any other alike."""
    n = len(categories)
    stay = max(1 - p_change, pd_min) if n > 1 else 1.0
    return {a: {b: stay if a == b else (1 - stay) / (n - 1) for b in categories} for a in categories}


def invariant_matrix(shares: dict[str, float], p_change: float, alpha: float = 0.5) -> Matrix:
    """Stays with 1 - p + p f; moves by a mix of equal shares (1 - alpha) and the others' own shares (alpha)."""
    names, n = list(shares), len(shares)
    out: Matrix = {}
    for a in names:
        stay = 1 - p_change + p_change * shares[a] if n > 1 else 1.0
        pull = {b: (1 - alpha) / (n - 1) + alpha * shares[b] / (1 - shares[a]) if shares[a] < 1 else 1 / (n - 1) for b in names if b != a}
        total = sum(pull.values()) or 1.0
        out[a] = {b: stay if b == a else (1 - stay) * pull[b] / total for b in names}
    return out


def shares_of(df: DataFrame, column: str) -> dict[str, float]:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy("v").limit(MOST_CATEGORIES + 1).collect()
    if len(counts) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} categories; generalize it first")
    total = sum(r["n"] for r in counts)
    return {r["v"]: r["n"] / total for r in counts}


def _draw(c: Column, matrix: Matrix, u: Column) -> Column:
    """The first target whose cumulative probability passes u."""
    rows = []
    for a, targets in matrix.items():
        total, steps = 0.0, []
        for b, p in targets.items():
            total += p
            steps.append(F.struct(F.lit(total).alias("p"), F.lit(b).alias("v")))
        rows += [F.lit(a), F.array(*steps)]
    line = F.create_map(*rows)[c.cast("string")]
    return F.coalesce(F.get(F.filter(line, lambda s: u < s["p"]), F.lit(0))["v"], F.element_at(line, -1)["v"])


def pram(df: DataFrame, columns: list[str], rid: str, p_change: float = 0.2, pd_min: float = 0.01, method: str = "uniform", alpha: float = 0.5, seed: int = 1, matrices: dict[str, Matrix] | None = None) -> DataFrame:
    """Redraws categories by a transition matrix each; null and columns of one category stay.

    p_change is at most 0.5, pd_min at least 0.01. The draw hangs on the row's identity `rid` alone, so reruns agree.
    """
    require(df, [*columns, rid])
    p_change, pd_min = min(p_change, 0.5), max(pd_min, 0.01)
    out = {}
    for c in columns:
        m = (matrices or {}).get(c)
        if m is None:
            shares = shares_of(df, c)
            if len(shares) < 2:
                continue
            m = uniform_matrix(list(shares), p_change, pd_min) if method == "uniform" else invariant_matrix(shares, p_change, alpha)
        out[c] = F.when(F.col(c).isNotNull(), F.coalesce(_draw(F.col(c), m, uniform(F.col(rid), seed, c)), F.col(c).cast("string"))).cast(df.schema[c].dataType)
    return df.withColumns(out) if out else df


def laplace_scale(low: float, high: float, epsilon: float) -> float:
    """Sensitivity over epsilon, the sensitivity being the range."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return (high - low) / epsilon


def noise(df: DataFrame, columns: list[str], rid: str, magnitude: float | dict[str, float] = 0.1, kind: str = "gaussian", cap: float | None = 0.25, keep_mean: bool = True, keep_sign: bool = True, bounds: dict[str, tuple[float, float]] | None = None, seed: int = 1) -> DataFrame:
    """Adds noise of magnitude times the standard deviation (proportional: times the value) to numbers.

    kind: gaussian, laplace, uniform or proportional. Changes are capped at `cap` of the value's size; values that no cap met
    are then shifted so that the mean holds, as far as their own caps allow; bounds and signs hold; whole-number columns stay whole. Columns without
    variance stay. Two aggregates in all, whatever the number of columns.
    """
    require(df, [*columns, rid])
    kinds = dict(df.dtypes)
    stats = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    used = [c for c in columns if stats[c]]
    size = lambda c: magnitude.get(c, 0.1) if isinstance(magnitude, dict) else magnitude

    def draw(c: str) -> Column:
        u, v = uniform(F.col(rid), seed, c), uniform(F.col(rid), seed, c + "'")
        x = F.col(c).cast("double")
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
        if kind == "gaussian":
            return normal * (size(c) * stats[c])
        if kind == "proportional":
            return normal * size(c) * F.abs(x)
        if kind == "laplace":
            w = u - 0.5
            return -F.signum(w) * F.log(F.greatest(1 - 2 * F.abs(w), F.lit(1e-300))) * (size(c) * stats[c] / math.sqrt(2))
        if kind == "uniform":
            return (2 * u - 1) * (size(c) * stats[c] * math.sqrt(3))
        raise ValueError(f"unknown noise {kind}")

    if not used:
        return df
    moved = df.withColumns({f"_d_{c}": draw(c) for c in used})
    limit = lambda c: cap * F.abs(F.col(c).cast("double"))
    if cap is not None:
        moved = moved.withColumns({f"_m_{c}": F.abs(f"_d_{c}") > limit(c) for c in used})
        moved = moved.withColumns({f"_d_{c}": F.when(F.col(f"_m_{c}"), F.signum(f"_d_{c}") * limit(c)).otherwise(F.col(f"_d_{c}")) for c in used})
    else:
        moved = moved.withColumns({f"_m_{c}": F.lit(False) for c in used})
    if keep_mean:
        r = moved.agg(*[(F.sum(f"_d_{c}") / F.sum(F.when(~F.col(f"_m_{c}") & F.col(c).isNotNull(), 1.0))).alias(c) for c in used]).first()
        moved = moved.withColumns({f"_d_{c}": F.when(~F.col(f"_m_{c}"), F.col(f"_d_{c}") - F.lit(r[c] or 0.0)).otherwise(F.col(f"_d_{c}")) for c in used})
        if cap is not None:  # the shift may not carry a value over its cap
            moved = moved.withColumns({f"_d_{c}": F.greatest(F.least(F.col(f"_d_{c}"), limit(c)), -limit(c)) for c in used})
    out = {}
    for c in used:
        x = F.col(c).cast("double")
        y = x + F.col(f"_d_{c}")
        if bounds and c in bounds:
            y = F.least(F.greatest(y, F.lit(float(bounds[c][0]))), F.lit(float(bounds[c][1])))
        if keep_sign:
            y = F.when((x >= 0) & (y < 0), F.lit(0.0)).when((x <= 0) & (y > 0), F.lit(0.0)).otherwise(y)
        y = F.when(x.isNotNull(), y)
        out[c] = y if kinds[c] in ("double", "float") else F.bround(y, 0).cast(df.schema[c].dataType)
    return moved.withColumns(out).select(*df.columns)


def correlated_noise(df: DataFrame, columns: list[str], rid: str, magnitude: float = 0.1, seed: int = 1) -> DataFrame:
    """Gaussian noise whose covariance is magnitude squared times the columns' own, by its Cholesky factor."""
    import numpy as np

    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    r = df.agg(*[F.covar_samp(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((n, n))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    chol = np.linalg.cholesky(cov + np.eye(n) * 1e-12 * max(1.0, np.trace(cov))) * magnitude
    z = [F.sqrt(-2 * F.log(1 - uniform(F.col(rid), seed, c))) * F.cos(2 * math.pi * uniform(F.col(rid), seed, c + "'")) for c in columns]
    return df.withColumns({c: F.col(c).cast("double") + sum((z[j] * float(chol[i, j]) for j in range(i + 1)), F.lit(0.0)) for i, c in enumerate(columns)})


def change_report(original: DataFrame, protected: DataFrame, rid: str, columns: list[str]) -> DataFrame:
    """(column, changed_rate, mean_o, mean_p): how much perturbation changed."""
    from .utility import is_number, paired

    p = paired(original, protected, rid, columns)
    mean = lambda t, c: F.avg(F.col(f"{t}_{c}").cast("double")) if is_number(original, c) else F.lit(None).cast("double")
    one = lambda c: F.struct(F.lit(c).alias("column"), F.avg((~F.col(f"o_{c}").eqNullSafe(F.col(f"p_{c}"))).cast("double")).alias("changed_rate"), mean("o", c).alias("mean_o"), mean("p", c).alias("mean_p"))
    return p.agg(F.array(*[one(c) for c in columns]).alias("a")).select(F.explode("a").alias("x")).select("x.*")
