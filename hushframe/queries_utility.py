"""Queries over utility metrics, an original table against a recoded copy of itself."""

from pyspark.sql import functions as F

from .catalog import query
from .functions import cells
from .operators import utility
from .queries_risk import r6

#: lineitem has no key, so orders and part stand in: prices rounded to thousands, priority 5-LOW merged into 4.
_P = "(SELECT o_orderkey, o_orderstatus, round_even(o_totalprice / 50000, 0) * 50000 AS o_totalprice, CASE o_orderpriority WHEN '5-LOW' THEN '4-NOT SPECIFIED' ELSE o_orderpriority END AS o_orderpriority FROM orders)"


def both(read):
    o = read("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    p = o.withColumns({"o_totalprice": cells.round_base(F.col("o_totalprice"), 50000), "o_orderpriority": cells.remap(F.col("o_orderpriority"), {"5-LOW": "4-NOT SPECIFIED"})})
    return o, p


_J = f"(SELECT o.o_totalprice AS o, p.o_totalprice AS p, o.o_orderpriority AS oc, p.o_orderpriority AS pc FROM orders o JOIN {_P} p USING (o_orderkey))"


def pairs(read):
    o, p = both(read)
    return utility.paired(o, p, "o_orderkey", ["o_totalprice", "o_orderpriority"])


@query("ut1_information_loss", f"SELECT 'o_totalprice' AS \"column\", round(avg(abs(o - p)), 6) AS mae, round(avg(abs(o - p)) / stddev_samp(o), 6) AS mae_over_std, round(avg((o <> p)::INT), 6) AS changed_rate FROM {_J}")
def _(read):
    return r6(utility.information_loss(pairs(read), ["o_totalprice"]))


@query("ut4_utility", f"SELECT round((abs(corr(o, p)) + avg((oc = pc)::INT)) / 2, 6) AS utility FROM {_J}")
def _(read):
    return r6(utility.utility_score(pairs(read), ["o_totalprice"], ["o_orderpriority"]))


@query("ut6_il1s", f"SELECT round((avg(abs(o - p)) / (max(o) - min(o)) + avg((oc <> pc)::INT)) / 2, 6) AS il1s FROM {_J}")
def _(read):
    return r6(utility.il1s(pairs(read), ["o_totalprice"], ["o_orderpriority"]))


@query("ut2_suppression", "SELECT round(avg((c_mktsegment = 'BUILDING')::INT) / 2, 6) AS cells_suppressed, round(avg((c_mktsegment = 'BUILDING')::INT), 6) AS records_suppressed FROM customer")
def _(read):
    o = read("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    p = o.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return r6(utility.suppression(utility.paired(o, p, "c_custkey", ["c_mktsegment", "c_nationkey"]), ["c_mktsegment", "c_nationkey"]))


@query("ut2_composite")
def _(read):
    o, p = both(read)
    d = utility.composite(o, p, "o_orderkey", ["o_totalprice"], ["o_orderpriority"])
    return o.sparkSession.createDataFrame([(k, float(v)) for k, v in d.items()], "part string, value double")


_TVD = f"""WITH a AS (SELECT o_orderpriority AS v, count(*) AS a FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS v, count(*) AS b FROM {_P} GROUP BY 1),
j AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b, (SELECT count(*) FROM orders) AS n FROM a FULL JOIN b USING (v))"""


@query("ut5_value_distance", _TVD + " SELECT round(sum(abs(a / n - b / n)) / 2, 6) AS tvd, round(count(*) FILTER (a > 0 AND b > 0) / count(*) FILTER (a > 0), 6) AS overlap, count(*) FILTER (a = 0) AS added, count(*) FILTER (b = 0) AS removed FROM j")
def _(read):
    return r6(utility.value_distance(*both(read), "o_orderpriority"))


@query("ut5_midpoint", "SELECT c_custkey, floor(c_acctbal / 500) * 500 + 250 AS m FROM customer")
def _(read):
    return read("customer").select("c_custkey", utility.midpoint(cells.interval(F.col("c_acctbal"), 500)).alias("m"))


_KL = "SELECT round(sum(p * ln(p / q)), 6) AS kl, round(sqrt(0.5 * sum(pow(sqrt(p) - sqrt(q), 2))), 6) AS hellinger FROM (SELECT (a / sum(a) OVER () + 1e-10) / (1 + count(*) OVER () * 1e-10) AS p, (b / sum(b) OVER () + 1e-10) / (1 + count(*) OVER () * 1e-10) AS q FROM j)"


@query("ut12_divergence_categorical", _TVD + _KL)
def _(read):
    return r6(utility.divergence(*both(read), "o_orderpriority"))


@query("ut12_divergence_numeric", f"""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
a AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS a FROM orders, s GROUP BY 1),
b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS b FROM {_P}, s WHERE o_totalprice BETWEEN lo AND hi GROUP BY 1),
j AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT unnest(range(20)) AS bin) LEFT JOIN a USING (bin) LEFT JOIN b USING (bin)) """ + _KL)
def _(read):
    return r6(utility.divergence(*both(read), "o_totalprice"))


@query("ut9_cramers_v", """WITH c AS (SELECT p_brand AS x, p_type AS y, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT sum(n) AS s, count(DISTINCT x) AS a, count(DISTINCT y) AS b FROM c),
k AS (SELECT sum(n * n / (r * q)) - 1 AS phi FROM (SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS q FROM c))
SELECT round(sqrt(greatest(0, phi - (a - 1) * (b - 1) / (s - 1)) / least(a - pow(a - 1, 2) / (s - 1) - 1, b - pow(b - 1, 2) / (s - 1) - 1)), 6) AS cramers_v FROM k, t""")
def _(read):
    return r6(utility.cramers_v(read("part"), "p_brand", "p_type"))


@query("ut10_eta_squared", """WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS s FROM part GROUP BY 1), t AS (SELECT avg(p_retailprice) AS a FROM part)
SELECT round(sum(n * pow(m - a, 2)) / (sum(n * pow(m - a, 2)) + sum(n * s)), 6) AS eta_sq FROM g, t""")
def _(read):
    return r6(utility.eta_squared(read("part"), "p_brand", "p_retailprice"))


@query("ut10_eta_numeric", "SELECT round(pow(corr(p_size, p_retailprice), 2), 6) AS eta_sq FROM part")
def _(read):
    return r6(utility.eta_squared(read("part"), "p_size", "p_retailprice"))


@query("ut11_group_preservation", f"""WITH a AS (SELECT g, v, n / sum(n) OVER (PARTITION BY g) AS a FROM (SELECT o_orderstatus AS g, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2)),
b AS (SELECT g, v, n / sum(n) OVER (PARTITION BY g) AS b FROM (SELECT o_orderstatus AS g, o_orderpriority AS v, count(*) AS n FROM {_P} GROUP BY 1, 2))
SELECT round(1 - avg(t), 6) AS preservation FROM (SELECT g, sum(abs(coalesce(a, 0) - coalesce(b, 0))) / 2 AS t FROM a FULL JOIN b USING (g, v) GROUP BY g)""")
def _(read):
    return r6(utility.group_preservation(*both(read), "o_orderstatus", "o_orderpriority"))


@query("ut7_moments", f"SELECT 'o_totalprice' AS \"column\", round(avg(o), 4) AS mean_o, round(avg(p), 4) AS mean_p, round(abs(avg(p) - avg(o)) / abs(avg(o)), 6) AS mean_shift, round(var_samp(p) / var_samp(o), 6) AS var_ratio FROM {_J}")
def _(read):
    m = utility.moments(*both(read), ["o_totalprice"])
    return m.select("column", F.round("mean_o", 4).alias("mean_o"), F.round("mean_p", 4).alias("mean_p"), F.round("mean_shift", 6).alias("mean_shift"), F.round("var_ratio", 6).alias("var_ratio"))


@query("ut7_correlation_difference", "SELECT round(abs(corr(l_quantity, l_extendedprice) - corr(least(l_quantity, 25), l_extendedprice)), 6) AS correlation_difference FROM lineitem")
def _(read):
    d = read("lineitem").select("l_quantity", "l_extendedprice")
    return r6(utility.correlation_difference(d, d.withColumn("l_quantity", F.least("l_quantity", F.lit(25.0))), ["l_quantity", "l_extendedprice"]))


@query("ut16_ml_utility")
def _(read):
    o, p = both(read)
    d = utility.ml_utility(o, p, ["o_totalprice", "o_orderpriority"], "o_orderstatus")
    return o.sparkSession.createDataFrame([(k, float(v)) for k, v in d.items()], "part string, accuracy double")


_EMPTIED = "(SELECT o_orderpriority, CASE WHEN a >= {t} THEN a END AS a, CASE WHEN b >= {t} THEN b END AS b FROM x)"


@query("ut3_tabular", f"""WITH x AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'P') AS b FROM orders GROUP BY 1), y AS {_EMPTIED.format(t=100)},
c AS (SELECT x.a AS o, y.a // 10 * 10 AS p FROM x JOIN y USING (o_orderpriority) UNION ALL SELECT x.b, y.b // 10 * 10 FROM x JOIN y USING (o_orderpriority)),
m AS (SELECT 1 - count(p) / count(*) AS s, coalesce(avg(abs(o - p)), 0) AS d, coalesce(avg(abs(o - p)) / nullif(avg(abs(o)) FILTER (p IS NOT NULL), 0), 0) AS r, CASE WHEN count(p) = 0 THEN 0 WHEN sum(o) FILTER (p IS NOT NULL) > 0 THEN least(1, sum(p) / sum(o) FILTER (p IS NOT NULL)) ELSE (sum(p) = 0)::INT END AS k FROM c)
SELECT round(s, 6) AS suppression_rate, round(d, 6) AS mean_abs_deviation, round(r, 6) AS relative_deviation, round(k, 6) AS sum_preserved, round(0.4 * s + 0.3 * least(r, 1) + 0.3 * (1 - k), 6) AS information_loss, round(greatest(0, 1 - (0.4 * s + 0.3 * least(r, 1) + 0.3 * (1 - k))), 6) AS utility_score FROM m""")
def _(read):
    o = read("orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "P").alias("b"))
    p = o.select("o_orderpriority", *[F.when(F.col(c) >= 100, F.floor(F.col(c) / 10) * 10).alias(c) for c in "ab"])
    return r6(utility.tabular(o, p, ["o_orderpriority"]))


_ETA = "(SELECT sum(n * pow(m - a, 2)) / (sum(n * pow(m - a, 2)) + sum(n * s)) FROM (SELECT count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS s FROM part GROUP BY {g}), (SELECT avg(p_retailprice) AS a FROM part))"


@query("ut8_relation_kept", f"SELECT round(CASE WHEN o > 0.01 THEN least(1, p / o) ELSE 1 END, 6) AS kept FROM (SELECT {_ETA.format(g='p_type')} AS o, {_ETA.format(g='left(p_type, 5)')} AS p)")
def _(read):
    d = read("part")
    return r6(d.sparkSession.createDataFrame([(float(utility.relation_kept(d, d.withColumn("p_type", F.substring("p_type", 1, 5)), "p_type", ["p_retailprice"])),)], "kept double"))


@query("ut13_cross_tab_gate", """WITH p AS (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.5 ELSE o_totalprice * 3 END AS o_totalprice FROM orders),
g AS (SELECT 'o_orderstatus' AS qi, 1 - avg(least(abs(b - a) / abs(a), 1)) AS x FROM (SELECT o_orderstatus AS g, avg(o_totalprice) AS a FROM orders GROUP BY 1) JOIN (SELECT o_orderstatus AS g, avg(o_totalprice) AS b FROM p GROUP BY 1) USING (g)
UNION ALL SELECT 'o_orderpriority', 1 - avg(least(abs(b - a) / abs(a), 1)) FROM (SELECT o_orderpriority AS g, avg(o_totalprice) AS a FROM orders GROUP BY 1) JOIN (SELECT o_orderpriority AS g, avg(o_totalprice) AS b FROM p GROUP BY 1) USING (g))
SELECT round(avg(x), 6) AS mean_preservation, 'o_totalprice' AS worst_sensitive, arg_min(qi, x) AS worst_qi, round(min(x), 6) AS worst_preservation, count(*) AS n_pairs, avg(x) < 0.6 AS degraded FROM g""")
def _(read):
    o = read("orders")
    p = o.withColumn("o_totalprice", F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "F", 1.5).otherwise(3.0))
    return r6(utility.cross_tab_gate(utility.cross_tabs(o, p, ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])))
