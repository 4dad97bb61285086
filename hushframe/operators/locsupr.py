"""Local suppression: single QI values are nulled in classes under k until none is left or the caps are reached."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ec import checkpoints, require, with_class_size
from .kanon import apply_plan

#: Most cells of one column and of all QIs that may be nulled.
COLUMN_CAP, CELL_CAP = 0.60, 0.20


@dataclass
class Suppressed:
    df: DataFrame
    cells: dict[str, int]
    rounds: int
    violations: int


def priorities(df: DataFrame, qis: list[str], strategy: str, weights: dict[str, float] | None) -> dict[str, float]:
    """Order in which QIs give way, highest first: most values (minimum), least weight, most entropy, or none (random)."""
    if strategy == "weighted":
        return {q: -(weights or {}).get(q, 1.0) for q in qis}
    if strategy == "random":
        return dict.fromkeys(qis, 0.0)
    if strategy == "minimum":
        return {q: float(v) for q, v in df.agg(*[F.count_distinct(q).alias(q) for q in qis]).first().asDict().items()}
    if strategy == "entropy":
        from .risk import entropy_bits

        return {q: entropy_bits(df, q).first()[0] for q in qis}
    raise ValueError(f"unknown strategy {strategy}")


def suppress_locally(df: DataFrame, qis: list[str], k: int = 3, strategy: str = "minimum", weights: dict[str, float] | None = None, most_per_record: int | None = None) -> Suppressed:
    """Nulls one QI in all classes under k in each round, in order of priority; null is a value of its own.

    Caps: 60 % of a column, 20 % of all QI cells, `most_per_record` values of a record; at most QIs + 5 rounds. All rounds run
    on the class table; rows are touched once at the end. Classes that still violate are reported.
    """
    require(df, qis)
    checkpoints(df)
    order = priorities(df, qis, strategy, weights)
    now = [f"_now_{q}" for q in qis]
    t = df.groupBy(*qis).agg(F.count("*").alias("_n")).select(*qis, *[F.col(q).alias(n) for q, n in zip(qis, now)], "_n", F.lit(0).alias("_gone")).checkpoint()
    total = t.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    cells, rounds, bad = dict.fromkeys(qis, 0), 0, 0
    spent: set[str] = set()
    while rounds < len(qis) + 5:
        sized = with_class_size(t, now, "_c", "_n")
        hit = F.col("_c") < k
        if most_per_record is not None:
            hit = hit & (F.col("_gone") < most_per_record)
        r = sized.agg(F.coalesce(F.sum(F.when(F.col("_c") < k, F.col("_n"))), F.lit(0)).alias("bad"), *[F.coalesce(F.sum(F.when(hit & F.col(n).isNotNull(), F.col("_n"))), F.lit(0)).alias(n) for n in now]).first()
        bad = r["bad"]
        room = int(CELL_CAP * total * len(qis)) - sum(cells.values())
        fits = [q for q in qis if q not in spent and 0 < r[f"_now_{q}"] <= room and cells[q] + r[f"_now_{q}"] <= COLUMN_CAP * total]
        if not bad or not fits:
            break
        q = max(fits, key=lambda x: (order[x], x))
        spent.add(q)
        n = f"_now_{q}"
        cells[q] += r[n]
        gone = hit & F.col(n).isNotNull()
        t = sized.select(*qis, *[F.when(~gone, F.col(x)).alias(x) if x == n else F.col(x) for x in now], "_n", (F.col("_gone") + gone.cast("int")).alias("_gone")).checkpoint()
        rounds += 1
        if len(spent) == len(qis):
            spent = set()
    bad = with_class_size(t, now, "_c", "_n").agg(F.coalesce(F.sum(F.when(F.col("_c") < k, F.col("_n"))), F.lit(0))).first()[0]
    return Suppressed(apply_plan(df, t, qis, now), cells, rounds, bad)


def report(original: DataFrame, result: Suppressed, qis: list[str]) -> dict[str, float]:
    """Shares of nulled cells, by QI and in all, and the rows that still violate."""
    n = original.count()
    return {**{f"rate_{q}": c / n if n else 0.0 for q, c in result.cells.items()}, "cell_rate": sum(result.cells.values()) / (n * len(qis)) if n else 0.0, "violating_rows": result.violations}
