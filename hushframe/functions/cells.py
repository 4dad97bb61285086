"""Transforms of single columns. Null stays null in all of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(number: float) -> str:
    """A bound as text: whole numbers without a fraction, others as they are."""
    return str(int(number)) if float(number).is_integer() else repr(float(number))


def floor_to(c: Column, width: float) -> Column:
    return F.floor(c.cast("double") / F.lit(float(width)))


# --- identifiers -----------------------------------------------------------------------------------------------------


def hashed(c: Column, salt: str = "") -> Column:
    """First 16 hex digits of the SHA-256 of salt and value."""
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 16)


def pseudonyms(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Replaces values by ID_00000001 ... in order of value; null stays null.

    Ranks come from range partitions: order inside each, plus the counts of those before, so no task sees all values.
    """
    values = df.select(F.col(column).alias("_v")).where("_v IS NOT NULL").distinct()
    ranked = global_rank(values, "_v", "_k").select("_v", F.format_string("ID_%08d", "_k").alias("_id"))
    out = df.join(ranked, F.col(column) == F.col("_v"), "left").drop("_v")
    return out.withColumn(name or column, F.col("_id")).drop("_id")


def global_rank(df: DataFrame, by: str, name: str) -> DataFrame:
    """Adds 1-based ranks of distinct values by range partitions and an offset for each partition."""
    from pyspark.sql import Window as W

    d = df.repartitionByRange(by).withColumn("_gr_p", F.spark_partition_id()).cache()
    counts = d.groupBy("_gr_p").agg(F.count("*").alias("_gr_c"))
    offsets = counts.select("_gr_p", (F.coalesce(F.sum("_gr_c").over(W.orderBy("_gr_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_gr_o"))
    inside = d.withColumn("_gr_r", F.row_number().over(W.partitionBy("_gr_p").orderBy(by)))
    return inside.join(F.broadcast(offsets), "_gr_p").withColumn(name, F.col("_gr_r") + F.col("_gr_o")).drop("_gr_p", "_gr_r", "_gr_o")


# --- numbers ---------------------------------------------------------------------------------------------------------


def clamp(c: Column, low: Column | float | None, high: Column | float | None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = c
    if low is not None:
        out = F.greatest(out, lit(low))
    if high is not None:
        out = F.least(out, lit(high))
    return F.when(c.isNotNull(), out)


def coding_bounds(df: DataFrame, columns: list[str], method: str = "percentile", percentiles: dict | tuple = (0.01, 0.99), iqr: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper coding bound of each column, by 'percentile' (one pair or one for each column) or 'iqr'."""
    pair = lambda c: percentiles.get(c, (0.01, 0.99)) if isinstance(percentiles, dict) else percentiles
    ask = {c: pair(c) if method == "percentile" else (0.25, 0.75) for c in columns}
    row = df.agg(*[F.percentile(c, F.array(*[F.lit(float(q)) for q in ask[c]])).alias(c) for c in columns]).first()
    if method == "percentile":
        return {c: tuple(row[c]) for c in columns if row[c]}
    if method == "iqr":
        return {c: (row[c][0] - iqr * (row[c][1] - row[c][0]), row[c][1] + iqr * (row[c][1] - row[c][0])) for c in columns if row[c]}
    raise ValueError(f"unknown coding method {method}")


def top_bottom_code(df: DataFrame, columns: list[str], method: str = "percentile", bounds: dict | None = None, **how) -> DataFrame:
    """Clamps numeric columns to bounds: given ones (method 'fixed'), percentiles or IQR fences."""
    found = bounds or {} if method == "fixed" else coding_bounds(df, columns, method, **how)
    return df.withColumns({c: clamp(F.col(c).cast("double"), *found[c]) for c in columns if c in found})


def round_base(c: Column, base: float) -> Column:
    """To the nearest multiple of base, halves to even."""
    return F.bround(c.cast("double") / F.lit(float(base)), 0) * F.lit(float(base))


def round_significant(c: Column, digits: int) -> Column:
    """To so many significant digits; zero stays."""
    v = c.cast("double")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - (digits - 1))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.bround(v / scale, 0) * scale)


#: Least median and the base it asks for.
AUTO_BASES = [(10_000, 1000), (1000, 100), (100, 10)]


def auto_base(median: float | None) -> int | None:
    return next((base for least, base in AUTO_BASES if median is not None and median >= least), None)


def round_auto(df: DataFrame, column: str) -> DataFrame:
    """Rounds by the base that the median asks for; small columns stay."""
    base = auto_base(df.agg(F.percentile(column, F.lit(0.5))).first()[0])
    return df.withColumn(column, round_base(F.col(column), base)) if base else df


def interval(c: Column, width: float, sep: str = "-") -> Column:
    """Left-closed interval label lo-hi with hi = lo + width."""
    lo = floor_to(c, width)
    text = (lambda v: (v * F.lit(float(width))).cast("bigint").cast("string")) if float(width).is_integer() else (lambda v: F.bround(v * F.lit(float(width)), 6).cast("string"))
    return F.concat(text(lo), F.lit(sep), text(lo + 1))


def age_bins(c: Column, width: int = 5, edges: list[int] | None = None) -> Column:
    """lo-hi with an inclusive upper end (20-24); with edges, the last bin is open (65+) and smaller values get <first."""
    if edges is None:
        lo = (floor_to(c, width) * width).cast("bigint")
        return F.concat(lo.cast("string"), F.lit("-"), (lo + (width - 1)).cast("string"))
    out = F.when(c < edges[0], F.lit(f"<{edges[0]}"))
    for a, b in zip(edges, edges[1:]):
        out = out.when((c >= a) & (c < b), F.lit(f"{a}-{b - 1}"))
    return out.when(c >= edges[-1], F.lit(f"{edges[-1]}+"))


def quantile_edges(df: DataFrame, column: str, bins: int = 20) -> list[float]:
    """Distinct quantile edges; empty where the table has fewer values than bins."""
    row = df.agg(F.count(column).alias("n"), F.percentile(column, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("q")).first()
    return sorted(set(row["q"])) if row["n"] >= bins and row["q"] else []


def edge_labels(edges: list[float]) -> list[str]:
    """lo-hi labels: whole numbers where both ends reach ten, else one decimal (halves to even in tenths)."""
    tenth = lambda v: f"{round(v * 10) / 10:.1f}"
    return [f"{round(a)}-{round(b)}" if abs(a) >= 10 and abs(b) >= 10 else f"{tenth(a)}-{tenth(b)}" for a, b in zip(edges, edges[1:])]


def by_edges(c: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """Right-closed bins, the first closed on both sides."""
    names = labels or edge_labels(edges)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for b, name in zip(edges[1:-1], names):
        out = out.when(c <= b, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def equal_width(low: float, high: float, bins: int) -> float:
    """Bin width: the range over the bins (at least two), whole from one upwards."""
    w = (high - low) / max(2, bins)
    return float(math.ceil(w)) if w >= 1 else w


# --- categories and text ---------------------------------------------------------------------------------------------


def merge_rare(df: DataFrame, column: str, min_freq: int = 10, pct: float = 1.0, other: str = "Other") -> DataFrame:
    """Values of fewer than max(min_freq, rows * pct / 100) rows become `other`.

    Columns of four or more values of which over 80 % look like ranges stay, since their labels are bins already.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c")).cache()
    facts = counts.agg(F.count("*").alias("k"), F.sum("_c").alias("n"), F.avg(F.col("_v").cast("string").rlike(r"^-?\d+(\.\d+)?\s*-\s*-?\d+(\.\d+)?$").cast("int")).alias("ranges")).first()
    if not facts["k"] or (facts["k"] >= 4 and facts["ranges"] > 0.8):
        return df
    least = max(min_freq, int(df.count() * pct / 100))
    rare = counts.where(F.col("_c") < least).select("_v")
    out = df.join(rare, F.col(column) == F.col("_v"), "left")
    return out.withColumn(column, F.when(F.col("_v").isNotNull(), F.lit(other)).otherwise(F.col(column))).drop("_v")


def top_values(df: DataFrame, column: str, keep: int, other: str = "Other") -> DataFrame:
    """Keeps the `keep` most frequent values (ties by value) and turns the rest into `other`; no-op if no more exist."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    kept = [r[column] for r in counts.orderBy(F.desc("_c"), column).limit(keep + 1).collect()]
    if len(kept) <= keep:
        return df
    return df.withColumn(column, F.when(F.col(column).isNull() | F.col(column).isin(kept[:keep]), F.col(column)).otherwise(F.lit(other)))


def derived(df: DataFrame, column: str, how: str, keep: int = 10, bins: int = 10, mapping: dict[str, str] | None = None) -> DataFrame:
    """A recoded copy beside a column: {column}_topk (most frequent values, else Other), {column}_binned (quantile bins) or
    {column}_generalized (by a map, unmapped values as Other). Null stays null; too few rows for bins leave the copy null."""
    c = F.col(column)
    if how == "topk":
        name = f"{column}_topk"
        return top_values(df.withColumn(name, c), name, keep)
    if how == "binned":
        edges = quantile_edges(df, column, bins)
        return df.withColumn(f"{column}_binned", by_edges(c, edges) if len(edges) > 2 else F.lit(None).cast("string"))
    if how == "generalized":
        known = F.coalesce(*[F.when(c.cast("string") == a, F.lit(b)) for a, b in (mapping or {}).items()], F.lit("Other"))
        return df.withColumn(f"{column}_generalized", F.when(c.isNotNull(), known))
    raise ValueError(f"unknown recoding {how}")


def remap(c: Column, mapping: dict[str, str]) -> Column:
    """Mapped values, unmapped ones as they are."""
    if not mapping:
        return c
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c], c)


def prefix(c: Column, n: int = 3) -> Column:
    return F.concat(F.left(c, F.lit(n)), F.lit("*"))


def coarsen_place(c: Column, keep: int = 3) -> Column:
    """First characters of the trimmed code, the rest starred."""
    t = F.trim(c)
    return F.when(F.length(t) > keep, F.rpad(F.left(t, F.lit(keep)), F.length(t), F.lit("*"))).otherwise(t)


def truncate_text(c: Column, n: int = 10, end: bool = False) -> Column:
    """The first (or last) n characters."""
    return F.right(c, F.lit(n)) if end else F.left(c, F.lit(n))


# --- dates -----------------------------------------------------------------------------------------------------------


def truncate_date(c: Column, grain: str) -> Column:
    """Labels 2024, 2024Q1, 2024-03 or 2024-W09 (weeks from Monday, days before the first one in week 00)."""
    if grain == "year":
        return F.date_format(c, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(c, "yyyy"), F.lit("Q"), F.quarter(c).cast("string"))
    if grain == "month":
        return F.date_format(c, "yyyy-MM")
    if grain == "week":
        week = F.floor((F.dayofyear(c) + 6 - F.weekday(c)) / 7)
        return F.concat(F.date_format(c, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    raise ValueError(f"unknown grain {grain}")


# --- tables ----------------------------------------------------------------------------------------------------------


def frequency_table(df: DataFrame, dims: list[str], value: str | None = None, agg: str = "count") -> DataFrame:
    """Cross table of the dimensions, the last one as columns; empty cells are zero."""
    g = df.groupBy(*dims[:-1]).pivot(dims[-1])
    out = g.count() if agg == "count" or value is None else g.agg({value: agg})
    return out.na.fill(0)


def sample(df: DataFrame, fraction: float | None = None, size: int | None = None, strata: str | None = None, seed: int = 1) -> DataFrame:
    """A seeded sample by the hash of whole rows: a share (of each stratum), or exactly `size` rows.

    Partitioning never matters; equal rows go together. Rows of a null stratum are in none and left out.
    """
    h = F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed))
    if size is not None:
        return df.orderBy(h).limit(size)
    if strata is None:
        return df.where((h.bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < fraction)
    draw = F.xxhash64(h, F.col(strata)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return df.where(F.col(strata).isNotNull() & (draw < fraction))
