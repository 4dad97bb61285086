"""k-anonymization by full-domain generalization, searched on the class table, with suppression of what remains."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hierarchy import Ladder, auto_ladder, starred
from .ec import checkpoints, require, with_class_size

Vector = tuple[int, ...]


@dataclass
class Anonymized:
    df: DataFrame
    levels: dict[str, int]
    k: int
    suppressed: int = 0
    searched: int = 0
    notes: list[str] = field(default_factory=list)


class Search:
    """Figures of level vectors, from aggregates of the class table and remembered.

    The cardinality of a QI at a level depends on its own values alone, so all of them come from one job at the start.
    """

    def __init__(self, df: DataFrame, ladders: list[Ladder], k: int):
        self.ladders, self.k = ladders, k
        self.qis = [x.column for x in ladders]
        self.table = df.groupBy(*self.qis).agg(F.count("*").alias("_n")).cache()
        self.rows = self.table.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        self.memo: dict[Vector, tuple[int, int, dict[str, int]]] = {}
        self.top = tuple(x.height for x in ladders)
        counts = [self.table.select(x.column).distinct().agg(F.array(*[F.count_distinct(x.at(i)) for i in range(x.height + 1)]).alias("c")).select(F.lit(j).alias("j"), "c") for j, x in enumerate(ladders)]
        self.cardinality = [r["c"] for r in sorted(reduce(DataFrame.unionByName, counts).collect(), key=lambda r: r["j"])]

    def close(self) -> None:
        self.table.unpersist()

    def score(self, vectors) -> None:
        """Figures of several vectors in one job: classes of all of them are counted side by side."""
        new = [v for v in vectors if v not in self.memo]
        if not new:
            return
        levels = [F.struct(F.lit(j).alias("_v"), *[x.at(i).cast("string").alias(x.column) for x, i in zip(self.ladders, v)]) for j, v in enumerate(new)]
        classes = self.table.select("_n", F.explode(F.array(*levels)).alias("_s")).select("_n", "_s.*").groupBy("_v", *self.qis).agg(F.sum("_n").alias("_n"))
        bad = F.col("_n") < self.k
        figures = [F.count_if(bad).alias("classes"), F.coalesce(F.sum(F.when(bad, F.col("_n"))), F.lit(0)).alias("rows"), *[F.count_distinct(F.when(bad, F.col(q))).alias(f"b_{q}") for q in self.qis]]
        for r in classes.groupBy("_v").agg(*figures).collect():
            self.memo[new[r["_v"]]] = (r["classes"], r["rows"], {q: r[f"b_{q}"] for q in self.qis})
        for v in new:  # an empty table has no classes
            self.memo.setdefault(v, (0, 0, dict.fromkeys(self.qis, 0)))

    def figures(self, v: Vector) -> tuple[int, int, dict[str, int]]:
        """(violating classes, violating rows, cardinality of each QI among violating classes)."""
        self.score([v])
        return self.memo[v]

    def loss(self, v: Vector) -> float:
        """Mean information loss 1 - cardinality(level) / cardinality(0)."""
        return sum(1 - c[i] / c[0] if c[0] else 0.0 for c, i in zip(self.cardinality, v)) / len(v)


def greedy(s: Search, most_rows: float = 0.0, least_cardinality: int | None = None) -> Vector:
    """Raises, step by step, the QI whose values fill the violating classes most for the information it loses.

    Columns do not go under max(3, (rows / k) ** (1 / QIs)) values while another can still rise; once all others are spent
    they may. Ends when at most `most_rows` rows violate, or at the top. One job a step.
    """
    floor = least_cardinality or max(3, int((s.rows / s.k) ** (1 / len(s.qis)))) if s.rows else 3
    v = (0,) * len(s.qis)
    while s.figures(v)[1] > most_rows and v != s.top:
        inside = s.figures(v)[2]
        options = []
        for i, q in enumerate(s.qis):
            if v[i] >= s.top[i]:
                continue
            up = v[:i] + (v[i] + 1,) + v[i + 1 :]
            under = s.cardinality[i][up[i]] < floor
            cost = max(s.loss(up) - s.loss(v), 1e-6)
            options.append((under, -((inside[q] / s.k) / cost + 0.1 * (s.top[i] - v[i])), q, up))
        v = min(options)[3]
    return v


def beam(s: Search, width: int = 5) -> Vector:
    """Breadth-limited search of the level lattice by (violations, loss); the greedy result if no vector is free of violations.

    All vectors of a breadth are scored in one job.
    """
    front, best = [(0,) * len(s.qis)], None
    for _ in range(sum(s.top) + 1):
        s.score(front)
        done = [v for v in front if not s.figures(v)[0]]
        if done:
            best = min(done, key=lambda v: (s.loss(v), v))
            break
        nxt = {v[:i] + (v[i] + 1,) + v[i + 1 :] for v in front for i in range(len(v)) if v[i] < s.top[i]}
        if not nxt:
            break
        s.score(sorted(nxt))
        front = sorted(nxt, key=lambda v: (s.figures(v)[1], s.loss(v), v))[:width]
    return best if best is not None else greedy(s)


def project(df: DataFrame, ladders: list[Ladder], v: Vector) -> DataFrame:
    return df.withColumns({x.column: x.at(i) for x, i in zip(ladders, v)})


def _hash_of_rank(d: DataFrame, columns: list[str], rank: int) -> int:
    """The hash at a rank (from 1) in the order of the hashes of some columns, found by counts of leading bits."""
    d = d.select(F.xxhash64(*columns).alias("h"))
    for shift in (54, 44, 34):
        counts = sorted((r["b"], r["count"]) for r in d.groupBy(F.shiftright("h", shift).alias("b")).count().collect())
        for bucket, n in counts:
            if rank <= n:
                break
            rank -= n
        d = d.where(F.shiftright("h", shift) == bucket)
        if n <= 4096:
            break
    return sorted(r["h"] for r in d.collect())[rank - 1]


def suppress_small(df: DataFrame, qis: list[str], k: int, most_rows: float = 0.05, rounds: int = 8) -> tuple[DataFrame, int]:
    """Nulls QIs of rows in classes under k, on the class table; (df, rows touched).

    Up to `rounds` times the QI of most values (if over half of it is left) is nulled in the smallest classes, whole classes in
    order of size, and among equal sizes of a hash of their values, as far as the row budget reaches; then all QIs of what
    still violates. Null is a value: if the rows without any QI are fewer than k, the smallest of the other classes joins them,
    so no class under k is left unless the table has fewer than k rows. The plan of each original class is joined back
    null-safely, so rows are touched once. Cut-offs come from counts by size and by leading bits; nothing is sorted in one task.
    """
    checkpoints(df)
    now = [f"_now_{q}" for q in qis]
    t = df.groupBy(*qis).agg(F.count("*").alias("_n")).select(*qis, *[F.col(q).alias(n) for q, n in zip(qis, now)], "_n").checkpoint()
    total = t.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    budget = int(total * most_rows)
    for _ in range(rounds):
        classes = t.groupBy(*now).agg(F.sum("_n").alias("_c"))
        r = classes.agg(F.coalesce(F.sum(F.when(F.col("_c") < k, F.col("_c"))), F.lit(0)).alias("bad"), *[F.count_distinct(n).alias(n) for n in now], *[F.sum(F.when(F.col(n).isNotNull(), F.col("_c"))).alias(f"f_{n}") for n in now]).first()
        usable = [n for n in now if (r[f"f_{n}"] or 0) > total / 2]
        if not r["bad"] or not usable or budget <= 0:
            break
        target = max(usable, key=lambda n: (r[n], n))
        small = classes.where((F.col("_c") < k) & F.col(target).isNotNull())
        used, edge = 0, None
        for size, n in sorted((r["_c"], r["count"]) for r in small.groupBy("_c").count().collect()):
            fit = min(n, (budget - used) // size)
            used += fit * size
            if fit < n:
                edge = (size, _hash_of_rank(small.where(F.col("_c") == size), now, fit) if fit else None)
                break
        if not used:
            break
        budget -= used
        hit = (F.col("_c") < k) & F.col(target).isNotNull()
        if edge:
            inside = F.lit(False) if edge[1] is None else (F.col("_c") == edge[0]) & (F.xxhash64(*now) <= edge[1])
            hit = hit & ((F.col("_c") < edge[0]) | inside)
        sized = with_class_size(t, now, "_c", "_n")
        t = sized.select(*qis, *[F.when(~hit, F.col(n)).alias(n) if n == target else F.col(n) for n in now], "_n").checkpoint()
    sized = with_class_size(t, now, "_c", "_n")
    classes = t.groupBy(*now).agg(F.sum("_n").alias("_c"))
    no_value = reduce(lambda a, b: a & b, [F.col(n).isNull() for n in now])
    emptied = classes.agg(F.sum(F.when((F.col("_c") < k) | no_value, F.col("_c")))).first()[0] or 0
    stays = F.col("_c") >= k
    if 0 < emptied < k:
        extra = classes.where(stays & ~no_value).agg(F.min(F.struct("_c", *now)).alias("x")).first()["x"]
        if extra is not None:
            stays = stays & ~reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.lit(extra[n])) for n in now])
    left = sized.select(*qis, *[F.when(stays, F.col(n)).alias(n) for n in now], "_n")
    changed = reduce(lambda a, b: a | b, [~F.col(q).eqNullSafe(F.col(n)) for q, n in zip(qis, now)])
    plan = left.withColumn("_changed", changed).checkpoint()
    touched = plan.agg(F.coalesce(F.sum(F.when(F.col("_changed"), F.col("_n"))), F.lit(0))).first()[0]
    return apply_plan(df, plan, qis, now), touched


def apply_plan(df: DataFrame, plan: DataFrame, qis: list[str], now: list[str]) -> DataFrame:
    """df with its QIs replaced by what the plan says for their class."""
    p = plan.select(*[F.col(q).alias(f"_old_{q}") for q in qis], *now)
    on = None
    for q in qis:
        c = F.col(q).eqNullSafe(F.col(f"_old_{q}"))
        on = c if on is None else on & c
    joined = df.join(p, on, "left")
    return joined.select(*[F.col(f"_now_{c}").alias(c) if c in qis else F.col(c) for c in df.columns])


def k_anonymize(df: DataFrame, qis: list[str], k: int = 5, strategy: str = "hybrid", ladders: dict[str, Ladder] | None = None, most_suppressed: float = 0.05, vector: dict[str, int] | None = None) -> Anonymized:
    """k-anonymizes df over its QIs.

    strategy: generalization (levels only), suppression, hybrid (levels up to where the budget covers the rest, then
    suppression), beam, recursive (hybrid that first recodes violating rows locally). `vector` pins the levels instead of a
    search. QIs without a ladder (two values, free text) can only be starred.
    """
    require(df, qis)
    if k < 2:
        raise ValueError("k must be at least 2")
    if strategy not in ("generalization", "suppression", "hybrid", "beam", "recursive"):
        raise ValueError(f"unknown strategy {strategy}")
    checkpoints(df)
    given = ladders or {}
    steps = [given.get(q) or auto_ladder(df, q) or Ladder(q, "star", [lambda c: c, starred], ["value", "*"]) for q in qis]
    if strategy == "suppression":
        out, n = suppress_small(df, qis, k, 1.0)
        return Anonymized(out, dict.fromkeys(qis, 0), k, n)
    s = Search(df, steps, k)
    try:
        return _searched(df, qis, steps, s, strategy, most_suppressed, vector)
    finally:
        s.close()


def _searched(df: DataFrame, qis: list[str], steps: list[Ladder], s: Search, strategy: str, most_suppressed: float, vector: dict[str, int] | None) -> Anonymized:
    if vector is not None:
        v = tuple(vector.get(q, 0) for q in qis)
    elif strategy == "beam":
        v = beam(s)
    elif strategy in ("hybrid", "recursive"):
        v = greedy(s, most_suppressed * s.rows)
    else:
        v = greedy(s)
    out = project(df, steps, v)
    result = Anonymized(out, dict(zip(qis, v)), s.k, 0, len(s.memo))
    if vector is None and s.figures(v)[0]:
        if strategy == "recursive":
            out = recode_locally(out, df, steps, v, s.k)
        result.df, result.suppressed = suppress_small(out, qis, s.k, most_suppressed)
    return result


def recode_locally(out: DataFrame, original: DataFrame, ladders: list[Ladder], v: Vector, k: int, depth: int = 2) -> DataFrame:
    """Raises the levels of rows in violating classes only, one more at each depth; other rows keep theirs."""
    qis = [x.column for x in ladders]
    raw = original.withColumns({f"_raw_{q}": F.col(q) for q in qis}).withColumns({x.column: x.at(i).cast("string") for x, i in zip(ladders, v)})
    for d in range(1, depth + 1):
        raw = with_class_size(raw, qis, "_c")
        higher = {x.column: x.levels[min(i + d, x.height)](F.col(f"_raw_{x.column}")).cast("string") for x, i in zip(ladders, v)}
        raw = raw.withColumns({q: F.when(F.col("_c") < k, e).otherwise(F.col(q)) for q, e in higher.items()})
    return raw.select(*out.columns)


def report(original: DataFrame, result: Anonymized) -> dict[str, float]:
    """Levels, suppressed share and classes of a result."""
    from .risk import k_check

    r = k_check(result.df, list(result.levels), result.k, "as_value").first()
    n = original.count()
    return {"suppressed_rate": result.suppressed / n if n else 0.0, "mean_level": sum(result.levels.values()) / len(result.levels), **r.asDict()}


def estimate_suppression(df: DataFrame, qis: list[str], ks=(3, 5, 7, 10)) -> dict[int, float]:
    """Share of rows in classes under each k, from one class table."""
    t = df.groupBy(*qis).agg(F.count("*").alias("n"))
    r = t.agg(F.sum("n").alias("N"), *[F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias(f"k{k}") for k in ks]).first()
    return {k: r[f"k{k}"] / r["N"] if r["N"] else 0.0 for k in ks}


def feasible_k(n: int, classes: int) -> int:
    """The largest k that the mean class size allows."""
    return max(2, math.floor(n / classes)) if classes else 2
