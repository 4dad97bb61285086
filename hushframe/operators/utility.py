"""Utility of a protected table against its original, paired by row identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hierarchy import NUMERIC

EPS = 1e-10


def paired(original: DataFrame, protected: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key of both tables: o_<column> and p_<column>."""
    o = original.select(F.col(key).alias("_k"), *[F.col(c).alias(f"o_{c}") for c in columns])
    p = protected.select(F.col(key).alias("_k"), *[F.col(c).alias(f"p_{c}") for c in columns])
    return o.join(p, "_k")


def is_number(df: DataFrame, column: str) -> bool:
    kind = dict(df.dtypes)[column]
    return kind in NUMERIC or kind.startswith("decimal")


def information_loss(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mae, mae_over_std, changed_rate) of numeric columns; a change to or from null counts as changed."""
    def one(c: str) -> Column:
        o, p = F.col(f"o_{c}").cast("double"), F.col(f"p_{c}").cast("double")
        mae, sd = F.avg(F.abs(o - p)), F.stddev_samp(o)
        return F.struct(F.lit(c).alias("column"), mae.alias("mae"), F.when(sd > 0, mae / sd).otherwise(F.lit(0.0)).alias("mae_over_std"), F.avg((~o.eqNullSafe(p)).cast("double")).alias("changed_rate"))

    return pairs.agg(F.array(*[one(c) for c in columns]).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def utility_score(pairs: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row: `utility`, the mean over columns of |Pearson| (numeric) and of the share of equal values (categorical)."""
    parts = [F.abs(F.corr(F.col(f"o_{c}").cast("double"), F.col(f"p_{c}").cast("double"))).alias(c) for c in numeric]
    parts += [F.avg(F.col(f"o_{c}").cast("string").eqNullSafe(F.col(f"p_{c}").cast("string")).cast("double")).alias(c) for c in categorical]
    scores = F.filter(F.array(*[F.col(c) for c in [*numeric, *categorical]]), lambda x: x.isNotNull() & ~F.isnan(x))
    row = pairs.agg(*parts)
    return row.select(F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(F.lit(1.0)).alias("utility"))


def il1s(pairs: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row: `il1s`, the mean over columns of mean |o - p| / range (numeric) and of the mismatch rate (categorical).

    A suppressed number costs the whole range.
    """
    def num(c):
        o, p = F.col(f"o_{c}").cast("double"), F.col(f"p_{c}").cast("double")
        spread = F.max(o) - F.min(o)
        lost = F.avg(F.when(o.isNotNull() & p.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
        return F.when(spread > 0, F.sum(F.abs(o - p)) / spread / F.count("*") + lost).otherwise(F.lit(0.0))

    def cat(c):
        return F.avg((~F.col(f"o_{c}").cast("string").eqNullSafe(F.col(f"p_{c}").cast("string"))).cast("double"))

    cols = [num(c) for c in numeric] + [cat(c) for c in categorical]
    return pairs.agg((reduce(lambda a, b: a + b, cols) / len(cols)).alias("il1s"))


def suppression(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """One row: cells and records that lost a value, as shares."""
    lost = [(F.col(f"o_{c}").isNotNull() & F.col(f"p_{c}").isNull()).cast("int") for c in columns]
    total = reduce(lambda a, b: a + b, lost)
    return pairs.agg((F.sum(total) / (F.count("*") * len(columns))).alias("cells_suppressed"), F.avg((total > 0).cast("double")).alias("records_suppressed"))


def value_distance(original: DataFrame, protected: DataFrame, column: str) -> DataFrame:
    """One row: total variation, overlap of the value sets, values added and removed."""
    share = lambda d, n: d.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias(n))
    both = share(original, "a").join(share(protected, "b"), "v", "full")
    sums = both.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    d = both.join(F.broadcast(sums)).na.fill(0, ["a", "b"])
    return d.agg(
        (F.sum(F.abs(F.col("a") / F.col("all_a") - F.col("b") / F.col("all_b"))) / 2).alias("tvd"),
        (F.count_if((F.col("a") > 0) & (F.col("b") > 0)) / F.count_if(F.col("a") > 0)).alias("overlap"),
        F.count_if(F.col("a") == 0).alias("added"), F.count_if(F.col("b") == 0).alias("removed"),
    )


def _histogram(df: DataFrame, column: str, bounds: DataFrame, bins: int, name: str) -> DataFrame:
    """Counts of equal-width bins between the bounds, the last bin closed; values outside are left out."""
    v = F.col(column).cast("double")
    b = df.select(v.alias("v")).join(F.broadcast(bounds)).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    return b.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias(name))


def divergence(original: DataFrame, protected: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """One row: Kullback-Leibler divergence and Hellinger distance of a column, numbers in equal-width bins of the original."""
    if is_number(original, column) and is_number(protected, column):
        bounds = original.agg(F.min(F.col(column).cast("double")).alias("lo"), F.max(F.col(column).cast("double")).alias("hi"))
        a, b = _histogram(original, column, bounds, bins, "a"), _histogram(protected, column, bounds, bins, "b")
        cells = original.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(a, "bin", "left").join(b, "bin", "left")
    else:
        share = lambda d, n: d.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("bin")).agg(F.count("*").alias(n))
        cells = share(original, "a").join(share(protected, "b"), "bin", "full")
    cells = cells.na.fill(0, ["a", "b"])
    sums = cells.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"), F.count("*").alias("m"))
    d = cells.join(F.broadcast(sums))
    norm = 1 + F.col("m") * EPS
    p, q = (F.col("a") / F.col("all_a") + EPS) / norm, (F.col("b") / F.col("all_b") + EPS) / norm
    return d.agg(F.sum(p * F.log(p / q)).alias("kl"), F.sqrt(0.5 * F.sum(F.pow(F.sqrt(p) - F.sqrt(q), 2))).alias("hellinger"))


def cramers_v(df: DataFrame, x: str, y: str, most: int = 500) -> DataFrame:
    """One row: bias-corrected Cramér's V of two categories, values beyond the `most` frequent merged."""
    def merged(c):
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(most + 1).collect()
        return F.col(c).cast("string") if len(top) <= most else F.when(F.col(c).isin([r[c] for r in top[:most]]), F.col(c).cast("string")).otherwise(F.lit("__other__"))

    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(merged(x).alias("x"), merged(y).alias("y"))
    cells = d.groupBy("x", "y").agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("r")), cells.groupBy("y").agg(F.sum("n").alias("c"))
    # chi2 / n = sum n_ij^2 / (r_i c_j) - 1, so empty cells need no row
    s = cells.join(rows, "x").join(cols, "y").agg(F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"), F.sum("n").alias("N"), F.count_distinct("x").alias("a"), F.count_distinct("y").alias("b"))
    phi = F.greatest(F.lit(0.0), F.col("s") - 1 - (F.col("a") - 1) * (F.col("b") - 1) / (F.col("N") - 1))
    ra, rb = (F.col(k) - F.pow(F.col(k) - 1, 2) / (F.col("N") - 1) for k in ("a", "b"))
    least = F.least(ra - 1, rb - 1)
    return s.select(F.when((F.col("N") > 1) & (least > 0), F.sqrt(phi / least)).otherwise(F.lit(0.0)).alias("cramers_v"))


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: share of a number's variance between groups (r squared where the group is a number itself)."""
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    v = F.col(value).cast("double")
    if is_number(df, group):
        r = F.corr(F.col(group).cast("double"), v)
        return d.agg(F.coalesce(F.when(~F.isnan(r), r * r), F.lit(0.0)).alias("eta_sq"))
    g = d.groupBy(group).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    t = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    parts = g.join(F.broadcast(t)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("b"), F.sum(F.col("n") * F.col("s")).alias("w"))
    return parts.select(F.when(F.col("b") + F.col("w") > 0, F.col("b") / (F.col("b") + F.col("w"))).otherwise(F.lit(0.0)).alias("eta_sq"))


def group_preservation(original: DataFrame, protected: DataFrame, group: str, value: str) -> DataFrame:
    """One row: 1 - the mean over groups of the total variation of a category's distribution in them."""
    def share(d, n):
        c = d.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("g"), F.col(value).cast("string").alias("v")).agg(F.count("*").alias("c"))
        t = c.groupBy("g").agg(F.sum("c").alias("t"))
        return c.join(t, "g").select("g", "v", (F.col("c") / F.col("t")).alias(n))

    both = share(original, "a").join(share(protected, "b"), ["g", "v"], "full").na.fill(0.0, ["a", "b"])
    return both.groupBy("g").agg((F.sum(F.abs(F.col("a") - F.col("b"))) / 2).alias("t")).agg((1 - F.avg("t")).alias("preservation"))


def moments(original: DataFrame, protected: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean_o, mean_p, mean_shift, var_ratio): means and variances of numeric columns before and after."""
    side = lambda d, t: d.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).cast("double")).alias(f"mean_{t}"), F.var_samp(F.col(c).cast("double")).alias(f"var_{t}")) for c in columns]).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    d = side(original, "o").join(F.broadcast(side(protected, "p")), "column")
    return d.select("column", "mean_o", "mean_p", F.when(F.col("mean_o") != 0, F.abs(F.col("mean_p") - F.col("mean_o")) / F.abs("mean_o")).otherwise(F.abs("mean_p")).alias("mean_shift"), F.when(F.col("var_o") > 0, F.col("var_p") / F.col("var_o")).otherwise(F.lit(1.0)).alias("var_ratio"))


def correlation_difference(original: DataFrame, protected: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean absolute difference of the pairwise correlations."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    side = lambda d: d.agg(F.array(*[F.coalesce(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for a, b in pairs]).alias("r"))
    o, p = side(original).withColumnRenamed("r", "o"), side(protected).withColumnRenamed("r", "p")
    return o.join(F.broadcast(p)).select((F.aggregate(F.zip_with("o", "p", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x) / len(pairs)).alias("correlation_difference"))


def midpoint(c: Column) -> Column:
    """The number that a label stands for: itself, or the middle of lo-hi."""
    lo, hi = F.regexp_extract(c, r"^\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*$", 1), F.regexp_extract(c, r"^\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*$", 2)
    ranged = (lo.try_cast("double") + hi.try_cast("double")) / 2
    return F.coalesce(ranged, F.regexp_replace(c, r"[<>=+]", "").try_cast("double"))


def tabular(original: DataFrame, protected: DataFrame, dims: list[str]) -> DataFrame:
    """One row for a frequency table: suppression_rate, mean_abs_deviation, relative_deviation, sum_preserved, information_loss
    and utility_score over the cells of the rows that both tables hold; a null cell is suppressed.

    Fixed values: losses weigh .4, .3 and .3.
    """
    cells = [c for c in original.columns if c not in dims and c in protected.columns]
    stacked = lambda d, n: d.select(*dims, F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).cast("string").try_cast("double").alias(n)) for c in cells])).alias("x")).select(*dims, "x.*")
    o, p = F.col("o"), F.col("p")
    both = stacked(original, "o").join(stacked(protected, "p"), [*dims, "cell"]).select("o", "p", F.when(p.isNotNull(), o).alias("k"))
    r = both.agg(F.count("*").alias("n"), F.count("p").alias("m"), F.avg(F.when(p.isNotNull(), F.abs(o - p))).alias("mad"), F.avg(F.abs("k")).alias("size"), F.sum("k").alias("so"), F.sum("p").alias("sp"))
    zero = F.lit(0.0)
    r = r.select(
        F.when(F.col("n") > 0, 1 - F.col("m") / F.col("n")).otherwise(F.lit(1.0)).alias("suppression_rate"), F.coalesce("mad", zero).alias("mean_abs_deviation"),
        F.when(F.col("size") > 0, F.col("mad") / F.col("size")).otherwise(zero).alias("relative_deviation"),
        F.when(F.col("m") == 0, zero).when(F.col("so") > 0, F.least(F.col("sp") / F.col("so"), F.lit(1.0))).otherwise((F.col("sp") == 0).cast("double")).alias("sum_preserved"),
    )
    loss = 0.4 * F.col("suppression_rate") + 0.3 * F.least(F.col("relative_deviation"), F.lit(1.0)) + 0.3 * (1 - F.col("sum_preserved"))
    return r.select("*", loss.alias("information_loss"), F.greatest(1 - loss, zero).alias("utility_score"))


def relation_kept(original: DataFrame, protected: DataFrame, qi: str, sensitive: list[str]) -> float:
    """How much of a QI's relation to the sensitive columns is left: ratios of eta squared or Cramér's V, at most 1, averaged.

    Relations that were next to none (eta squared to .01, V to .03; fixed values) count as kept.
    """
    kept = []
    for s in sensitive:
        measure, least = (lambda d, s=s: eta_squared(d, qi, s), 0.01) if is_number(original, s) else (lambda d, s=s: cramers_v(d, s, qi), 0.03)
        was, left = measure(original).first()[0] or 0.0, measure(protected).first()[0] or 0.0
        kept.append(min(1.0, left / was) if was > least else 1.0)
    return sum(kept) / len(kept) if kept else 1.0


def cross_tabs(original: DataFrame, protected: DataFrame, sensitive: list[str], qis: list[str]) -> DataFrame:
    """(sensitive, qi, preservation): how far group figures hold, for each pair.

    Numbers: 1 - the mean relative change of the group means (at most 1 a group) over groups of both tables; categories: the
    group preservation of distributions.
    """
    parts = []
    for s in sensitive:
        for q in qis:
            if is_number(original, s):
                side = lambda d, n: d.where(F.col(q).isNotNull() & F.col(s).isNotNull()).groupBy(F.col(q).cast("string").alias("g")).agg(F.avg(F.col(s).cast("double")).alias(n))  # noqa: B023, E731
                both = side(original, "a").join(side(protected, "b"), "g")
                change = F.when(F.col("a") != 0, F.least(F.abs(F.col("b") - F.col("a")) / F.abs("a"), F.lit(1.0))).otherwise((F.col("b") != 0).cast("double"))
                one = both.agg((1 - F.avg(change)).alias("preservation"))
            else:
                one = group_preservation(original, protected, q, s)
            parts.append(one.select(F.lit(s).alias("sensitive"), F.lit(q).alias("qi"), "preservation"))
    return reduce(DataFrame.unionByName, parts)


def cross_tab_gate(tabs: DataFrame, least: float = 0.60) -> DataFrame:
    """One row: mean preservation, the worst pair, pairs looked at, and whether relations are degraded (mean under `least`)."""
    worst = F.min(F.struct("preservation", "sensitive", "qi"))
    r = tabs.where(F.col("preservation").isNotNull()).agg(F.avg("preservation").alias("mean_preservation"), worst.alias("w"), F.count("*").alias("n_pairs"))
    return r.select("mean_preservation", F.col("w.sensitive").alias("worst_sensitive"), F.col("w.qi").alias("worst_qi"), F.col("w.preservation").alias("worst_preservation"), "n_pairs", F.coalesce(F.col("mean_preservation") < least, F.lit(False)).alias("degraded"))


def blended(sensitive: float, qis: list[float]) -> float:
    """Utility of a preparation: the QIs' mean alone where sensitive columns are hardly touched (.95), else half and half."""
    mean = sum(map(abs, qis)) / len(qis) if qis else 1.0
    return mean if sensitive >= 0.95 else 0.5 * sensitive + 0.5 * mean


#: Weights of the composite score.
COMPOSITE = {"information_loss": -0.25, "correlation": 0.15, "mean": 0.20, "distribution": 0.15, "records_suppressed": -0.15, "rows": 0.10}


def composite(original: DataFrame, protected: DataFrame, key: str, numeric: list[str], categorical: list[str]) -> dict[str, float]:
    """The composite utility and its parts: information loss, correlations, means, distributions, suppression, rows."""
    cols = [*numeric, *categorical]
    pairs = paired(original, protected, key, cols).cache()
    out = {"information_loss": min(1.0, il1s(pairs, numeric, categorical).first()[0] or 0.0), "records_suppressed": suppression(pairs, cols).first()["records_suppressed"] or 0.0}
    pairs.unpersist()
    out["correlation"] = 1 - (correlation_difference(original, protected, numeric).first()[0] if len(numeric) > 1 else 0.0)
    shifts = [min(1.0, r["mean_shift"]) for r in moments(original, protected, numeric).collect()] if numeric else []
    out["mean"] = 1 - sum(shifts) / len(shifts) if shifts else 1.0
    far = [divergence(original, protected, c, 10).first()["hellinger"] or 0.0 for c in cols]
    out["distribution"] = 1 - sum(far) / len(far) if far else 1.0
    n, m = original.count(), protected.count()
    out["rows"] = m / n if n else 1.0
    out["score"] = sum(w * out[k] if w > 0 else -w * (1 - out[k]) for k, w in COMPOSITE.items())
    return out


def verdict(before: float, after: float) -> str:
    """Bands of a QI's change."""
    d = abs(after - before)
    return "minimal" if d < 0.05 else "moderate" if d < 0.15 else "significant"


def overall(sensitive: float | None, qi: float | None, relation: float | None = None) -> float:
    """Half sensitive, a fifth QI, three tenths relationships; .7 and .3 without these. A relation under .40 caps the rest."""
    s, q = sensitive if sensitive is not None else 1.0, qi if qi is not None else 1.0
    if relation is None:
        return 0.7 * s + 0.3 * q
    score = 0.5 * s + 0.2 * q + 0.3 * relation
    return min(score, 0.4 + relation) if relation < 0.4 else score


def ml_utility(original: DataFrame, protected: DataFrame, features: list[str], label: str, folds: int = 3, seed: int = 1) -> dict[str, float]:
    """Cross-validated accuracy of a logistic regression on both tables and its ratio; 2 to 10 classes and 30 rows needed.

    Numbers are imputed by their median, categories one-hot encoded with null as one of them; a row's fold follows the hash of its values.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler

    def accuracy(d: DataFrame) -> float:
        numbers = [c for c in features if is_number(d, c)]
        words = [c for c in features if c not in numbers]
        x = d.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in numbers], *[F.coalesce(F.col(c).cast("string"), F.lit("__null__")).alias(c) for c in words], F.col(label).cast("string").alias("_label"))
        x = x.withColumn("_fold", F.pmod(F.xxhash64(*x.columns, F.lit(seed)), F.lit(folds)))
        stages = [StringIndexer(inputCol="_label", outputCol="_y", handleInvalid="keep")]
        stages += [Imputer(inputCols=numbers, outputCols=[f"{c}_i" for c in numbers], strategy="median")] if numbers else []
        stages += [StringIndexer(inputCols=words, outputCols=[f"{c}_s" for c in words], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_s" for c in words], outputCols=[f"{c}_h" for c in words])] if words else []
        stages += [VectorAssembler(inputCols=[f"{c}_i" for c in numbers] + [f"{c}_h" for c in words], outputCol="_x", handleInvalid="keep"), LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=30)]
        judge = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy")
        got = [judge.evaluate(Pipeline(stages=stages).fit(x.where(F.col("_fold") != i)).transform(x.where(F.col("_fold") == i))) for i in range(folds)]
        return sum(got) / len(got)

    facts = original.agg(F.count_distinct(label).alias("k"), F.count(label).alias("n")).first()
    if not 2 <= facts["k"] <= 10 or facts["n"] < 30:
        raise ValueError("needs 2 to 10 classes and at least 30 rows")
    a, b = accuracy(original), accuracy(protected)
    return {"original": a, "protected": b, "ratio": b / a if a else 1.0}
