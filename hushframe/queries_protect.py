"""Queries over the protection methods. Searches have no SQL twin; pinned level vectors and formulas have."""

from pyspark.sql import functions as F

from .catalog import query
from .functions.hierarchy import category_ladder, date_ladder, interval_ladder
from .operators import kanon, locsupr, perturb, swap
from .operators.risk import k_check
from .queries_risk import orders, r6

OQ = ["o_orderstatus", "o_orderpriority", "o_orderdate"]


@query("pro3_kanon_pinned", "SELECT o_orderkey, o_orderstatus, o_orderpriority, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS o_orderdate FROM orders")
def _(read):
    d = read("orders").select("o_orderkey", *OQ)
    ladder = date_ladder(d, "o_orderdate")
    return kanon.k_anonymize(d, OQ, 5, ladders={"o_orderdate": ladder}, vector={"o_orderdate": ladder.names.index("quarter")}).df


for _s in ("generalization", "suppression", "hybrid", "beam", "recursive"):

    @query(f"pro1_kanon_{_s}")
    def _(read, s=_s):
        return kanon.k_anonymize(read("part").select("p_partkey", "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"], 5, s).df


@query("pro2_levels", "SELECT p_partkey, CASE WHEN p_size > t THEN '>=' || CASE WHEN t = floor(t) THEN t::INT::VARCHAR ELSE printf('%.1f', t) END WHEN p_size < b THEN '<=' || CASE WHEN b = floor(b) THEN b::INT::VARCHAR ELSE printf('%.1f', b) END ELSE (p_size // 20 * 20) || '-' || (p_size // 20 * 20 + 19) END AS p_size, '*' AS p_type FROM part, (SELECT quantile_cont(p_size, 0.98) AS t, quantile_cont(p_size, 0.02) AS b FROM part)")
def _(read):
    d = read("part").select("p_partkey", "p_size", "p_type")
    ladders = [interval_ladder(d, "p_size"), category_ladder(d, "p_type")]
    return kanon.project(d, ladders, (3, ladders[1].height))


@query("pro5_suppress_small")
def _(read):
    return kanon.suppress_small(read("part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], 12)[0]


@query("pro5_estimate_suppression", "SELECT unnest([3, 5, 7, 10])::BIGINT AS k, unnest([round(coalesce(sum(n) FILTER (n < 3), 0) / sum(n), 6), round(coalesce(sum(n) FILTER (n < 5), 0) / sum(n), 6), round(coalesce(sum(n) FILTER (n < 7), 0) / sum(n), 6), round(coalesce(sum(n) FILTER (n < 10), 0) / sum(n), 6)]) AS rate FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type)")
def _(read):
    d = read("part")
    return d.sparkSession.createDataFrame([(k, round(v, 6)) for k, v in kanon.estimate_suppression(d, ["p_brand", "p_type"]).items()], "k long, rate double")


for _s in ("minimum", "weighted", "entropy", "random"):

    @query(f"pro7_locsupr_{_s}")
    def _(read, s=_s):
        return locsupr.suppress_locally(read("part").select("p_partkey", "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"], 3, s, {"p_brand": 1.0, "p_type": 3.0, "p_size": 2.0}).df


def _long(m, spark):
    return spark.createDataFrame([(a, b, round(p, 6)) for a, t in m.items() for b, p in t.items()], "a string, b string, p double")


@query("pro10_uniform_matrix", "WITH v AS (SELECT DISTINCT o_orderpriority AS v FROM orders) SELECT a.v AS a, b.v AS b, round(CASE WHEN a.v = b.v THEN 0.8 ELSE 0.2 / ((SELECT count(*) FROM v) - 1) END, 6) AS p FROM v a CROSS JOIN v b")
def _(read):
    d = read("orders")
    return _long(perturb.uniform_matrix(list(perturb.shares_of(d, "o_orderpriority")), 0.2), d.sparkSession)


@query("pro11_invariant_matrix", """WITH f AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders) AS f FROM orders GROUP BY 1), n AS (SELECT count(*) AS n FROM f),
w AS (SELECT a.v AS a, b.v AS b, a.f AS fa, CASE WHEN a.v <> b.v THEN 0.5 / (n - 1) + 0.5 * b.f / (1 - a.f) END AS w FROM f a CROSS JOIN f b, n)
SELECT a, b, round(CASE WHEN a = b THEN 0.8 + 0.2 * fa ELSE (1 - 0.8 - 0.2 * fa) * w / sum(w) OVER (PARTITION BY a) END, 6) AS p FROM w""")
def _(read):
    d = read("orders")
    return _long(perturb.invariant_matrix(perturb.shares_of(d, "o_orderpriority"), 0.2), d.sparkSession)


@query("pro9_pram")
def _(read):
    return perturb.pram(read("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("pro9_pram_invariant")
def _(read):
    return perturb.pram(read("orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", method="invariant")


for _k in ("gaussian", "laplace", "uniform", "proportional"):

    @query(f"pro12_noise_{_k}")
    def _(read, k=_k):
        return perturb.noise(read("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "c_custkey", kind=k)


@query("pro13_correlated_noise")
def _(read):
    return perturb.correlated_noise(read("orders").select("o_orderkey", "o_totalprice", F.length("o_orderpriority").cast("double").alias("len")), ["o_totalprice", "len"], "o_orderkey")


@query("pro14_laplace_scale", "SELECT round((max(c_acctbal) - min(c_acctbal)) / 0.5, 6) AS scale FROM customer")
def _(read):
    d = read("customer")
    r = d.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    return d.sparkSession.createDataFrame([(round(perturb.laplace_scale(r[0], r[1], 0.5), 6),)], "scale double")


@query("pro15_kanon_report", "SELECT count(*) AS n_groups, count(*) FILTER (n < 5) AS n_violations, coalesce(sum(n) FILTER (n < 5), 0)::BIGINT AS violating_rows, min(n) AS min_k, count(*) FILTER (n < 5) = 0 AS is_k_anonymous FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority, year(o_orderdate))")
def _(read):
    d = read("orders").select("o_orderkey", *OQ)
    ladder = date_ladder(d, "o_orderdate")
    out = kanon.k_anonymize(d, OQ, 5, ladders={"o_orderdate": ladder}, vector={"o_orderdate": ladder.names.index("year")})
    return k_check(out.df, OQ, 5, "as_value")


@query("pro15_change_report")
def _(read):
    o = read("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    p = perturb.noise(perturb.pram(o, ["o_orderpriority"], "o_orderkey"), ["o_totalprice"], "o_orderkey")
    return r6(perturb.change_report(o, p, "o_orderkey", ["o_orderpriority", "o_totalprice"]))


@query("pro7_locsupr_with_month")
def _(read):
    return locsupr.suppress_locally(orders(read).select("o_orderkey", "o_orderstatus", "o_orderpriority", "month"), ["o_orderstatus", "o_orderpriority", "month"], 5, most_per_record=1).df


@query("swp1_rank_swap")
def _(read):
    return swap.rank_swap(read("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "c_custkey")


@query("swp1_rank_swap_distribution", "SELECT round(sum(c_acctbal), 2) AS total, count(DISTINCT c_acctbal) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer")
def _(read):
    out = swap.rank_swap(read("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "c_custkey")
    return out.agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.count_distinct("c_acctbal").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("swp2_record_swap")
def _(read):
    return swap.record_swap(read("part").select("p_partkey", "p_brand", "p_type"), ["p_brand"], ["p_type"], "p_partkey", 12)
