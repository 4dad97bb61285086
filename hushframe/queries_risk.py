"""Queries over risk and privacy aggregates."""

from pyspark.sql import functions as F

from .catalog import query
from .operators import ec, privacy, risk

LI = ["l_returnflag", "l_linestatus", "l_quantity", "l_tax"]
QI3 = ["l_returnflag", "l_linestatus", "l_quantity"]
LIS, QI3S = ", ".join(LI), ", ".join(QI3)
OR = ["o_orderstatus", "o_orderpriority", "month"]
ORDERS = "(SELECT *, strftime(o_orderdate, '%Y-%m') AS month FROM orders)"


def r6(df, *keep):
    """Doubles rounded to six places, as on the SQL side."""
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes])


def orders(read):
    return read("orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))


def nulled(read):
    return read("customer").withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))


@query("ec_sizes", f"SELECT {LIS}, count(*) AS n FROM lineitem GROUP BY ALL")
def _(read):
    return ec.ec_sizes(read("lineitem"), LI)


@query("agg2_record_risk", f"SELECT l_orderkey, l_linenumber, {QI3S}, round(1.0 / count(*) OVER (PARTITION BY {QI3S}), 6) AS risk FROM lineitem")
def _(read):
    return r6(risk.record_risk(read("lineitem").select("l_orderkey", "l_linenumber", *QI3), QI3), "l_quantity")


_REID = """WITH e AS (SELECT {q}, count(*) AS n FROM {t} WHERE {notnull} GROUP BY ALL),
r AS (SELECT 1.0 / n AS risk FROM (SELECT count(*) OVER (PARTITION BY {q}) AS n FROM {t} WHERE {notnull}))
SELECT round(quantile_cont(risk, 0.5), 6) AS reid_50, round(quantile_cont(risk, 0.95), 6) AS reid_95, round(quantile_cont(risk, 0.99), 6) AS reid_99,
       round(max(risk), 6) AS max_risk, round(avg(risk), 6) AS mean_risk, count(*) FILTER (risk > 0.2) AS n_high, count(*) AS evaluated,
       (SELECT count(*) FROM {t}) - count(*) AS suppressed, round(count(*) FILTER (risk > 0.2) / count(*), 6) AS high_rate FROM r"""


@query("agg1_reid", _REID.format(q=LIS, t="lineitem", notnull="true"))
def _(read):
    return r6(risk.reid(read("lineitem"), LI))


_SEG = "(SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)"


@query("agg1_reid_nulls_excluded", _REID.format(q="c_nationkey, seg", t=_SEG, notnull="seg IS NOT NULL"))
def _(read):
    return r6(risk.reid(nulled(read), ["c_nationkey", "seg"]))


_K = """SELECT count(*) AS n_groups, count(*) FILTER (n < {k}) AS n_violations, coalesce(sum(n) FILTER (n < {k}), 0)::BIGINT AS violating_rows,
min(n) AS min_k, count(*) FILTER (n < {k}) = 0 AS is_k_anonymous FROM (SELECT count(*) AS n FROM {t} GROUP BY {q})"""


@query("agg3_k_anonymity", _K.format(k=5, t="lineitem", q=LIS))
def _(read):
    return risk.k_check(read("lineitem"), LI, 5)


@query("agg3_k_nulls_as_value", _K.format(k=5, t=_SEG, q="c_nationkey, seg"))
def _(read):
    return risk.k_check(nulled(read), ["c_nationkey", "seg"], 5, "as_value")


@query("agg3_k_nulls_excluded", _K.format(k=5, t=_SEG + " WHERE seg IS NOT NULL", q="c_nationkey, seg"))
def _(read):
    return risk.k_check(nulled(read), ["c_nationkey", "seg"], 5)


@query("agg4_uniqueness", f"SELECT count(*) FILTER (n = 1) AS n_unique, round(count(*) FILTER (n = 1) / sum(n), 6) AS uniqueness, round(count(*) / sum(n), 6) AS distinct_ratio FROM (SELECT count(*) AS n FROM {ORDERS} GROUP BY {', '.join(OR)})")
def _(read):
    return r6(risk.uniqueness(orders(read), OR))


@query("agg5_disclosure_summary", f"""SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_size, min(n) AS min_size, count(*) FILTER (n = 1) AS n_unique, round(count(*) FILTER (n = 1) / sum(n), 6) AS unique_rate,
coalesce(sum(n) FILTER (n < 3), 0)::BIGINT AS at_risk, round(coalesce(sum(n) FILTER (n < 3), 0) / sum(n), 6) AS at_risk_rate FROM (SELECT count(*) AS n FROM lineitem GROUP BY {LIS})""")
def _(read):
    return r6(risk.disclosure_summary(read("lineitem"), LI, 3))


@query("fil2_rare_combinations", f"SELECT {LIS}, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) < 8")
def _(read):
    return risk.rare_combinations(read("lineitem"), LI, 8)


@query("fil1_drop_null_qi", f"SELECT c_custkey, c_nationkey, seg FROM {_SEG} WHERE seg IS NOT NULL")
def _(read):
    return nulled(read).select("c_custkey", "c_nationkey", "seg").na.drop(subset=["seg"])


@query("hlp10_risk_above", f"WITH r AS (SELECT o_orderkey, {', '.join(OR)}, 1.0 / count(*) OVER (PARTITION BY {', '.join(OR)}) AS risk FROM {ORDERS}) SELECT o_orderkey, round(risk, 6) AS risk FROM r WHERE risk > (SELECT quantile_cont(risk, 0.9) FROM r)")
def _(read):
    return r6(risk.risk_above(orders(read), OR, 0.1).select("o_orderkey", "risk"))


def _loo(qis, t):
    one = lambda q: f"(SELECT quantile_cont(risk, 0.95) FROM (SELECT 1.0 / count(*) OVER (PARTITION BY {', '.join(q)}) AS risk FROM {t}))"
    return " UNION ALL ".join(f"SELECT '{c}' AS qi, round({one([x for x in qis if x != c])}, 6) AS reid_without, round({one(qis)}, 6) AS reid_all, round({one(qis)} - {one([x for x in qis if x != c])}, 6) AS importance" for c in qis)


@query("agg11_importance", _loo(OR, ORDERS))
def _(read):
    return r6(risk.importance(orders(read), OR))


def _subsets():
    """SQL of (mask, r): the 95 % risk quantile of every non-empty set of LI, a bit a column."""
    one = lambda m: f"SELECT {m} AS mask, quantile_cont(1.0 / n, 0.95) AS r FROM (SELECT count(*) OVER (PARTITION BY {', '.join(c for i, c in enumerate(LI) if m >> i & 1)}) AS n FROM lineitem)"
    return " UNION ALL ".join(one(m) for m in range(1, 1 << len(LI)))


_LEFT = "SELECT v.qi, {m} - v.bit AS mask, s.r AS r FROM v, s{more} WHERE {m} & v.bit > 0 AND s.mask = {m} - v.bit ORDER BY round(s.r, 12), v.qi LIMIT 1"


@query("agg11_backward_elimination", f"""WITH s AS ({_subsets()}), v AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {1 << i})" for i, c in enumerate(LI))}) t(qi, bit)),
a AS ({_LEFT.format(m=15, more="")}), b AS ({_LEFT.format(m="a.mask", more=", a")}), c AS ({_LEFT.format(m="b.mask", more=", b")})
SELECT qi, round(r, 6) AS reid_left FROM a UNION ALL SELECT qi, round(r, 6) FROM b UNION ALL SELECT qi, round(r, 6) FROM c""")
def _(read):
    steps = risk.backward_elimination(read("lineitem"), LI)
    return r6(read("region").sparkSession.createDataFrame(steps, "qi string, reid_left double"))


@query("agg9_metrics", """WITH e AS (SELECT p_type, p_size, count(*) AS n, count(DISTINCT p_brand) AS l FROM part GROUP BY ALL),
r AS (SELECT quantile_cont(1.0 / n, 0.95) AS r FROM (SELECT count(*) OVER (PARTITION BY p_type, p_size) AS n FROM part)), t AS (SELECT min(n) AS k, count(*) FILTER (n = 1) / sum(n) AS u, min(l) AS l FROM e)
SELECT 'reid95' AS metric, round(r, 6) AS raw, round(r, 6) AS normalized, r <= 0.05 AS meets FROM r UNION ALL SELECT 'k_anonymity', k, round(1 / k, 6), k >= 5 FROM t
UNION ALL SELECT 'uniqueness', round(u, 6), round(u, 6), u <= 0.05 FROM t UNION ALL SELECT 'l_diversity', l, round(1 / l, 6), l >= 2 FROM t""")
def _(read):
    d = read("part")
    rows = [(a.metric, float(a.raw), float(a.normalized), a.meets) for a in (risk.assess(d, ["p_type", "p_size"], m, t, "p_brand") for m, t in (("reid95", 0.05), ("k_anonymity", 5), ("uniqueness", 0.05), ("l_diversity", 2)))]
    return r6(d.sparkSession.createDataFrame(rows, "metric string, raw double, normalized double, meets boolean"))


@query("agg10_as_quantiles", """WITH u AS (SELECT count(*) FILTER (n = 1) / sum(n) AS u FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type, p_size))
SELECT 'reid_50' AS figure, round(u * 0.5, 6) AS value FROM u UNION ALL SELECT 'reid_90', round(u * 0.8, 6) FROM u UNION ALL SELECT 'reid_95', round(u, 6) FROM u UNION ALL SELECT 'reid_99', round(least(1, u * 1.2), 6) FROM u
UNION ALL SELECT 'mean_risk', round(u * 0.6, 6) FROM u UNION ALL SELECT 'max_risk', round(least(1, u * 1.5), 6) FROM u UNION ALL SELECT 'high_rate', round(CASE WHEN u > 0.2 THEN u * 0.5 ELSE 0 END, 6) FROM u""")
def _(read):
    from .plans.review import as_quantiles

    d = read("part")
    a = risk.assess(d, ["p_brand", "p_type", "p_size"], "uniqueness", 0.05)
    return r6(d.sparkSession.createDataFrame([(k, float(v)) for k, v in as_quantiles(a).items()], "figure string, value double"))


_COLUMNS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "category"), ("o_totalprice", "numeric"), ("o_orderdate", "date"), ("o_orderpriority", "category")]


@query("agg20_data_summary", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, {f"min({c})::DOUBLE" if k == "numeric" else "NULL::DOUBLE"} AS low, {f"max({c})::DOUBLE" if k == "numeric" else "NULL::DOUBLE"} AS high FROM orders""" for c, k in _COLUMNS))
def _(read):
    from .plans.review import summary

    return summary(read("orders").select(*[c for c, _ in _COLUMNS]))


@query("cls15_variable_roles", " UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN '{k}' = 'date' THEN 'date' WHEN count(DISTINCT {c}) = count({c}) AND count(DISTINCT {c}) > 50 THEN 'identifier' WHEN '{k}' = 'numeric' AND count(DISTINCT {c}) > 20 THEN 'continuous' WHEN count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'other' END AS role FROM orders""" for c, k in _COLUMNS))
def _(read):
    from .plans.review import variable_roles

    return variable_roles(read("orders").select(*[c for c, _ in _COLUMNS]))


PT = "p_type, p_size"


@query("agg12_l_diversity", f"SELECT {PT}, count(*) AS n, count(DISTINCT p_brand) AS l FROM part GROUP BY ALL")
def _(read):
    return privacy.l_diversity(read("part"), ["p_type", "p_size"], "p_brand")


@query("agg12_l_diversity_small", f"SELECT {PT}, count(*) AS n, count(DISTINCT p_brand) AS l FROM part GROUP BY ALL HAVING count(*) <= 6")
def _(read):
    return privacy.l_diversity(read("part"), ["p_type", "p_size"], "p_brand", 6)


@query("agg13_entropy_l", f"""WITH c AS (SELECT {PT}, p_brand, count(*) AS c FROM part GROUP BY ALL)
SELECT {PT}, sum(c)::BIGINT AS n, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS entropy, round(exp(ln(sum(c)) - sum(c * ln(c)) / sum(c)), 6) AS effective_l FROM c GROUP BY {PT}""")
def _(read):
    return r6(privacy.entropy_l_diversity(read("part"), ["p_type", "p_size"], "p_brand"))


@query("agg14_t_categorical", f"""WITH g AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part) AS q FROM part GROUP BY 1),
e AS (SELECT {PT}, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT {PT}, p_brand, count(*) AS c FROM part GROUP BY ALL)
SELECT p_type, p_size, round(sum(abs(coalesce(c, 0) / n - q)) / 2, 6) AS t FROM e CROSS JOIN g LEFT JOIN c USING (p_type, p_size, p_brand) GROUP BY 1, 2""")
def _(read):
    return r6(privacy.t_closeness_categorical(read("part"), ["p_type", "p_size"], "p_brand"))


@query("agg15_t_numeric", """WITH v AS (SELECT p_size AS x, count(*) AS g FROM part GROUP BY 1),
w AS (SELECT x, sum(g) OVER (ORDER BY x) / (SELECT count(*) FROM part) AS f, lead(x) OVER (ORDER BY x) - x AS gap FROM v),
e AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
c AS (SELECT p_brand, p_type, p_size AS x, count(*) AS c FROM part GROUP BY ALL),
j AS (SELECT p_brand, p_type, x, f, gap, sum(coalesce(c, 0)) OVER (PARTITION BY p_brand, p_type ORDER BY x) / n AS fc FROM e CROSS JOIN w LEFT JOIN c USING (p_brand, p_type, x))
SELECT p_brand, p_type, round(sum(abs(fc - f) * coalesce(gap, 0)) / (SELECT max(x) - min(x) FROM v), 6) AS t FROM j GROUP BY 1, 2""")
def _(read):
    return r6(privacy.t_closeness_numeric(read("part"), ["p_brand", "p_type"], "p_size"))


@query("agg16_gates", """WITH w AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part) AS q FROM part GROUP BY 1), g AS (SELECT p_type, p_brand, count(*) AS c FROM part GROUP BY p_type, p_brand), c AS (SELECT *, sum(c) OVER (PARTITION BY p_type) AS n FROM g),
t AS (SELECT p_type, sum(greatest(c / n - q, 0)) AS t, count(*) AS l FROM c JOIN w USING (p_brand) GROUP BY 1) SELECT 'l' AS gate, min(l) >= 2 AS holds FROM t UNION ALL SELECT 't', max(t) <= 0.3 FROM t""")
def _(read):
    d = read("part")
    g = privacy.gates(d, ["p_type"], "p_brand", 2, 0.3)
    return d.sparkSession.createDataFrame([(k, v) for k, v in g.items()], "gate string, holds boolean")


_OUT = " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_iqr, count(*) FILTER (abs({c} - m) > 3 * s) AS n_z
FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem) GROUP BY q1, q3""" for c in ("l_quantity", "l_extendedprice"))


@query("agg17_outliers", _OUT)
def _(read):
    return r6(risk.outliers(read("lineitem"), ["l_quantity", "l_extendedprice"]))


@query("agg18_dimensionality", f"""SELECT combination_space, round(combination_space / n, 6) AS space_ratio, n_distinct, round(n_distinct / n, 6) AS distinct_ratio FROM
(SELECT (count(DISTINCT l_returnflag) * count(DISTINCT l_linestatus) * count(DISTINCT l_quantity) * count(DISTINCT l_tax))::DOUBLE AS combination_space, count(*) AS n FROM lineitem), (SELECT count(*) AS n_distinct FROM (SELECT DISTINCT {LIS} FROM lineitem))""")
def _(read):
    return r6(risk.dimensionality(read("lineitem"), LI))


@query("agg22_entropy", "WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits FROM c")
def _(read):
    return r6(risk.entropy_bits(read("orders"), "o_orderpriority"))


_CROSS = """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1"""


@query("tx14_frequency_table", _CROSS)
def _(read):
    from .functions.cells import frequency_table

    return frequency_table(read("orders"), ["o_orderpriority", "o_orderstatus"])


@query("agg21_small_cells", f"""SELECT 3 * count(*) AS n_cells, sum(("F" > 0 AND "F" < 1000)::INT + ("O" > 0 AND "O" < 1000)::INT + ("P" > 0 AND "P" < 1000)::INT)::BIGINT AS n_small, sum(("F" = 0)::INT + ("O" = 0)::INT + ("P" = 0)::INT)::BIGINT AS n_zero,
round(sum(("F" > 0 AND "F" < 1000)::INT + ("O" > 0 AND "O" < 1000)::INT + ("P" > 0 AND "P" < 1000)::INT) / (3 * count(*)), 6) AS small_rate, round(sum(("F" = 0)::INT + ("O" = 0)::INT + ("P" = 0)::INT) / (3 * count(*)), 6) AS zero_rate FROM ({_CROSS})""")
def _(read):
    from .functions.cells import frequency_table

    return r6(risk.small_cells(frequency_table(read("orders"), ["o_orderpriority", "o_orderstatus"]), ["o_orderpriority"], 1000))


@query("fil3_small_cell_mask", f"""SELECT o_orderpriority, "F" < 1000 AS "F", "O" < 1000 AS "O", "P" < 1000 AS "P" FROM ({_CROSS})""")
def _(read):
    from .functions.cells import frequency_table

    return risk.small_cell_mask(frequency_table(read("orders"), ["o_orderpriority", "o_orderstatus"]), ["o_orderpriority"], 1000)
