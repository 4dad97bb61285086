"""What the rule table sees of a table: a few aggregates, gathered once."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hierarchy import NUMERIC
from ..operators.ec import ec_sizes, require
from ..operators.kanon import estimate_suppression
from ..operators.risk import importance, reid, risk_pattern

#: Name parts that mark a place and a time.
PLACES = ("region", "city", "state", "country", "zip", "postal", "county", "district", "municipality", "prefecture")
TIMES = ("date", "time", "year", "month", "quarter", "period", "day")


@dataclass
class Features:
    n: int
    qis: list[str]
    continuous: list[str]
    categorical: list[str]
    cardinality: dict[str, int]
    expected_size: float
    feasibility: str
    r50: float
    r95: float
    r99: float
    mean: float
    pattern: str
    high_rate: float
    uniqueness: float
    suppression: dict[int, float]
    outliers: bool = False
    skewed: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    high_card: list[str] = field(default_factory=list)
    max_category: float = 0.0
    importances: dict[str, float] = field(default_factory=dict)
    sensitive_diversity: int | None = None
    least_l: int | None = None
    tier: str = "SCIENTIFIC"
    target: float = 0.05
    metric: str = "reid95"
    utility_floor: float = 0.0

    @property
    def cat_ratio(self) -> float:
        total = len(self.continuous) + len(self.categorical)
        return len(self.categorical) / total if total else 0.0

    @property
    def infeasible(self) -> bool:
        return self.feasibility == "infeasible" or self.suppression.get(3, 0.0) > 0.5

    @property
    def dominant(self) -> str | None:
        """The QI that carries at least 40 % of the importance."""
        total = sum(v for v in self.importances.values() if v > 0)
        best = max(self.importances, key=lambda q: (self.importances[q], q), default=None)
        return best if total > 0 and self.importances[best] / total >= 0.4 else None

    @property
    def max_unique(self) -> float:
        return max((c / self.n for c in self.cardinality.values()), default=0.0) if self.n else 0.0

    def geo(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {"fine": [], "coarse": []}
        for q in self.qis:
            if any(w in q.lower() for w in PLACES):
                out["fine" if self.cardinality[q] > 50 else "coarse"].append(q)
        return out


def feasibility(expected: float) -> str:
    """Bands of the expected class size rows / product of cardinalities."""
    return "easy" if expected >= 10 else "moderate" if expected >= 5 else "hard" if expected >= 3 else "infeasible"


def features(df: DataFrame, qis: list[str], sensitive: list[str] | None = None, with_importance: bool = False, **context) -> Features:
    """Gathers the features in a handful of aggregates over the table and its class table."""
    require(df, qis)
    kinds = dict(df.dtypes)
    number = lambda c: kinds[c] in NUMERIC or kinds[c].startswith("decimal")
    row = df.agg(F.count("*").alias("n"), *[F.count_distinct(q).alias(f"c_{q}") for q in qis]).first()
    n, card = row["n"], {q: row[f"c_{q}"] for q in qis}
    cont = [q for q in qis if number(q) and card[q] > 20]
    dates = [q for q in qis if kinds[q].startswith(("date", "timestamp")) or any(w in q.lower() for w in TIMES)]
    cat = [q for q in qis if q not in cont]
    space = math.prod(max(1, c) for c in card.values())
    r = reid(df, qis).first()
    est = estimate_suppression(df, qis)
    ec = ec_sizes(df, qis, "as_value").agg(F.count("*").alias("k"), F.coalesce(F.sum(F.when(F.col("n") < 5, F.col("n"))), F.lit(0)).alias("high")).first()
    stats = df.agg(*[F.struct(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.skewness(c).alias("g"), F.count(c).alias("m")).alias(c) for c in cont]).first() if cont else {}
    skew, fences = [], {}
    for c in cont:
        s = stats[c]
        if s["m"] >= 10 and s["q"]:
            m = s["m"]
            if s["g"] is not None and abs(s["g"] * math.sqrt(m * (m - 1)) / (m - 2)) > 1.5:
                skew.append(c)
            spread = s["q"][1] - s["q"][0]
            if spread > 0:
                fences[c] = (s["q"][0] - 1.5 * spread, s["q"][1] + 1.5 * spread)
    out = False
    if fences:
        rates = df.agg(*[F.avg(((F.col(c) < lo) | (F.col(c) > hi)).cast("double")).alias(c) for c, (lo, hi) in fences.items()]).first()
        out = any((rates[c] or 0) > 0.02 for c in fences)
    top = [df.groupBy(q).agg(F.count("*").alias("n")).agg(F.max("n").alias("m")) for q in cat]
    most = max((t.first()["m"] or 0 for t in top), default=0) / n if n else 0.0
    imp = {x["qi"]: x["importance"] for x in importance(df, qis).collect()} if with_importance and len(qis) > 1 else {}
    div = min((df.select(s).distinct().count() for s in sensitive), default=None) if sensitive else None
    least = None
    if sensitive and div is not None and div <= 10:
        from ..operators.privacy import l_diversity

        least = min((l_diversity(df, qis, s, 100).agg(F.min("l")).first()[0] or 0) for s in sensitive)
    return Features(
        n, list(qis), cont, cat, card, n / space if space else 0.0, feasibility(n / space if space else 0.0), r["reid_50"], r["reid_95"], r["reid_99"], r["mean_risk"],
        risk_pattern(r["reid_50"], r["reid_95"], r["reid_99"], r["mean_risk"]), ec["high"] / n if n else 0.0, ec["k"] / n if n else 0.0, est, out, skew, dates,
        [q for q in qis if n and card[q] / n > 0.5], most, imp, div, least, **context,
    )
