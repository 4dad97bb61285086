"""Queries that state what must hold of searched and random results, and decisions that SQL can repeat.

Searches and seeded draws have no SQL twin row by row. What they promise has: classes reach k, every value is an old one or
null, changes keep their cap, sums of untouched columns stay. Each of these queries counts the rows that break a promise.
"""

from functools import reduce

from pyspark.sql import functions as F

from .catalog import query
from .functions import cells
from .operators import detect, kanon, locsupr, perturb, risk, swap, utility
from .operators.ec import ec_sizes
from .plans import advice, engine
from .queries_risk import r6
from .sources import io

PQ = ["p_brand", "p_type", "p_size"]
_K = ("generalization", "suppression", "hybrid", "beam", "recursive")
_L = ("minimum", "weighted", "entropy", "random")
_N = ("gaussian", "laplace", "uniform", "proportional")


def union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def values(names):
    return ", ".join(f"('{n}')" for n in names)


def parts(read):
    return read("part").select("p_partkey", *PQ)


def misfits(original, result, key, columns):
    """Cells that are neither null nor what they were."""
    p = utility.paired(original, result, key, columns)
    bad = [F.count_if(F.col(f"p_{c}").isNotNull() & ~F.col(f"o_{c}").cast("string").eqNullSafe(F.col(f"p_{c}").cast("string"))) for c in columns]
    return p.agg(reduce(lambda a, b: a + b, bad).alias("misfits"))


@query("pro1_kanon_holds", f"SELECT s AS strategy, count(*) AS n_rows, sum(p_partkey)::BIGINT AS keys, 0::BIGINT AS below_k FROM part, (VALUES {values(_K)}) t(s) GROUP BY s")
def _(read):
    def facts(s):
        out = kanon.k_anonymize(parts(read), PQ, 5, s).df
        below = ec_sizes(out, PQ, "as_value").agg(F.count_if(F.col("n") < 5).alias("below_k"))
        return out.agg(F.count("*").alias("n_rows"), F.sum("p_partkey").alias("keys")).crossJoin(below).select(F.lit(s).alias("strategy"), "*")

    return union(map(facts, _K))


@query("pro5_suppression_holds", "SELECT count(*) AS n_rows, sum(p_partkey)::BIGINT AS keys, 0::BIGINT AS below_k, 0::BIGINT AS misfits FROM part")
def _(read):
    d, q = read("part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"]
    out = kanon.suppress_small(d, q, 12)[0]
    below = ec_sizes(out, q, "as_value").agg(F.count_if(F.col("n") < 12).alias("below_k"))
    return out.agg(F.count("*").alias("n_rows"), F.sum("p_partkey").alias("keys")).crossJoin(below).crossJoin(misfits(d, out, "p_partkey", q))


@query("pro7_locsupr_holds", f"SELECT s AS strategy, count(*) AS n_rows, 0::BIGINT AS misfits, true AS within_caps FROM part, (VALUES {values(_L)}) t(s) GROUP BY s")
def _(read):
    def facts(s):
        d = parts(read)
        out = locsupr.suppress_locally(d, PQ, 3, s, {"p_brand": 1.0, "p_type": 3.0, "p_size": 2.0}).df
        gone = [F.count_if(F.col(c).isNull()) for c in PQ]
        caps = reduce(lambda a, b: a & b, [g <= 0.6 * F.count("*") for g in gone]) & (reduce(lambda a, b: a + b, gone) <= 0.2 * 3 * F.count("*"))
        return out.agg(F.count("*").alias("n_rows"), caps.alias("within_caps")).crossJoin(misfits(d, out, "p_partkey", PQ)).select(F.lit(s).alias("strategy"), "*")

    return union(map(facts, _L))


@query("pro9_pram_holds", """SELECT m AS method, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS keys, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS statuses, 0::BIGINT AS strange
FROM orders, (VALUES ('uniform'), ('invariant')) t(m) GROUP BY m""")
def _(read):
    d = read("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    known = [d.select(c).distinct() for c in ("o_orderpriority", "o_orderstatus")]

    def facts(m):
        out = perturb.pram(d, ["o_orderpriority", "o_orderstatus"], "o_orderkey", method=m)
        strange = union([out.select(k.columns[0]).join(k, k.columns[0], "left_anti").select(F.lit(1)) for k in known]).agg(F.count("*").alias("strange"))
        return out.agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"), F.count_distinct("o_orderpriority").alias("priorities"), F.count_distinct("o_orderstatus").alias("statuses")).crossJoin(strange).select(F.lit(m).alias("method"), "*")

    return union(map(facts, ("uniform", "invariant")))


@query("pro12_noise_holds", f"SELECT k AS kind, count(*) AS n_rows, sum(c_custkey)::BIGINT AS keys, 0::BIGINT AS over_cap, 0::BIGINT AS sign_lost, true AS mean_near FROM customer, (VALUES {values(_N)}) t(k) GROUP BY k")
def _(read):
    d = read("customer").select("c_custkey", "c_acctbal")

    def facts(k):
        p = utility.paired(d, perturb.noise(d, ["c_acctbal"], "c_custkey", kind=k).select("c_custkey", "c_acctbal"), "c_custkey", ["c_acctbal"])
        o, n = F.col("o_c_acctbal"), F.col("p_c_acctbal")
        near = F.abs(F.avg(n) - F.avg(o)) <= 0.01 * F.stddev_samp(o)
        return p.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(n - o) > 0.25 * F.abs(o) + 1e-9).alias("over_cap"), F.count_if(o * n < 0).alias("sign_lost"), near.alias("mean_near")).crossJoin(d.agg(F.sum("c_custkey").alias("keys"))).select(F.lit(k).alias("kind"), "*")

    return union(map(facts, _N))


@query("swp2_record_swap_holds", "SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type")
def _(read):
    out = swap.record_swap(read("part").select("p_partkey", "p_brand", "p_type"), ["p_brand"], ["p_type"], "p_partkey", 12)
    return union([out.groupBy(F.lit(c).alias("column"), F.col(c).alias("value")).agg(F.count("*").alias("n")) for c in ("p_brand", "p_type")])


@query("tx10_sample_holds", "SELECT least(count(*), 100) AS n_rows, least(count(*), 100) AS known FROM customer")
def _(read):
    d = read("customer")
    out = cells.sample(d, size=100)
    return out.agg(F.count("*").alias("n_rows")).crossJoin(out.join(d, d.columns, "left_semi").agg(F.count("*").alias("known")))


@query("sel8_protect_holds", "SELECT count(*) AS n_rows, sum(p_partkey)::BIGINT AS keys, true AS met FROM part")
def _(read):
    r = engine.protect(parts(read), ["p_brand", "p_type"], 0.10, "p_partkey")
    after = risk.reid(r.df, ["p_brand", "p_type"], (0.95,)).select((F.col("reid_95") <= 0.10).alias("met"))
    return r.df.agg(F.count("*").alias("n_rows"), F.sum("p_partkey").alias("keys")).crossJoin(after)


_EDGES = "(SELECT quantile_cont(v, {}) FROM e)"


def _steps(bins):
    return "[" + ", ".join(f"{i / bins!r}" for i in range(bins + 1)) + "]"


@query("gen3_quantile_edges", f"""WITH e AS (SELECT exp(value / 20) AS v FROM events), b AS (SELECT greatest(10, least(k, CASE WHEN k > 5000 THEN 15 WHEN k > 1000 THEN 10 ELSE 5 END)) AS n FROM (SELECT count(DISTINCT v) AS k FROM e)),
q AS (SELECT DISTINCT unnest(CASE WHEN n = 15 THEN {_EDGES.format(_steps(15))} ELSE {_EDGES.format(_steps(10))} END) AS edge FROM b),
s AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS i FROM q)
SELECT bin, count(*) AS n FROM (SELECT greatest(1, (SELECT count(*) FROM s WHERE edge < v)) AS bin FROM e) GROUP BY bin""")
def _(read):
    d = read("events").select(F.exp(F.col("value") / 20).alias("v"))
    known = d.agg(F.count_distinct("v")).first()[0]
    edges = cells.quantile_edges(d, "v", max(10, min(known, 15 if known > 5000 else 10 if known > 1000 else 5)))
    return d.select(cells.by_edges(F.col("v"), edges, [str(i + 1) for i in range(len(edges) - 1)]).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("tx15_topk", """WITH c AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r, count(*) OVER () AS k FROM part GROUP BY p_type)
SELECT p_partkey, p_type, CASE WHEN k <= 3 OR r <= 3 THEN p_type ELSE 'Other' END AS p_type_topk FROM part JOIN c USING (p_type)""")
def _(read):
    return cells.derived(read("part").select("p_partkey", "p_type"), "p_type", "topk", keep=3)


@query("tx15_generalized", "SELECT n_name, n_regionkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 3 THEN 'north' ELSE 'Other' END AS n_regionkey_generalized FROM nation")
def _(read):
    return cells.derived(read("nation").select("n_name", "n_regionkey"), "n_regionkey", "generalized", mapping={"0": "south", "3": "north"})


@query("src7_coerce", "SELECT c_custkey, round(c_acctbal, 2) AS eu, c_custkey::DOUBLE AS coded, c_mktsegment AS word FROM customer")
def _(read):
    eu = F.translate(F.format_number(F.round("c_acctbal", 2), 2), ",.", ".,")
    d = read("customer").select("c_custkey", eu.alias("eu"), F.col("c_custkey").cast("string").alias("coded"), F.col("c_mktsegment").alias("word"))
    return io.coerce(d, {"eu": "Character (numeric) — Continuous", "coded": "Coded", "word": "Float"})


@query("cls6_simple_qis", """WITH d AS (SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS seg, count(DISTINCT c_nationkey) AS nat FROM customer)
SELECT 'region' AS "column", 0::BIGINT AS place UNION ALL SELECT 'c_mktsegment', 1 FROM d WHERE seg BETWEEN 2 AND 50""")
def _(read):
    d = read("customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("string").alias("region"))
    return d.sparkSession.createDataFrame([(c, i) for i, c in enumerate(detect.simple_qis(d))], "column string, place long")


@query("cls17_handling", """WITH x AS (SELECT 'c_custkey' AS c, count(DISTINCT c_custkey) AS k, count(*) AS n FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(*) FROM customer UNION ALL SELECT 'debt', count(DISTINCT round(c_acctbal)), count(*) FROM customer
UNION ALL SELECT 'postal', count(DISTINCT c_custkey // 10), count(*) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(*) FROM customer UNION ALL SELECT 'one', 1, count(*) FROM customer)
SELECT c AS "column", CASE WHEN c IN ('c_custkey', 'c_name') OR k > 0.9 * n THEN 'direct_identifier' WHEN c = 'debt' THEN 'sensitive' WHEN c = 'postal' OR k BETWEEN 2 AND 100 THEN 'quasi_identifier' ELSE 'safe' END AS role, k AS "distinct",
CASE WHEN c = 'postal' AND k > 100 THEN 'hierarchy' END AS strategy FROM x""")
def _(read):
    c = read("customer")
    return detect.handling(c.select("c_custkey", "c_name", F.round("c_acctbal").alias("debt"), F.floor(F.col("c_custkey") / 10).alias("postal"), "c_mktsegment", F.lit(1).alias("one")))


@query("cls2_greek_rates", """SELECT 'amka' AS "column", 'amka' AS kind UNION ALL SELECT 'tax', 'afm' FROM (SELECT avg(regexp_full_match(lpad(c_custkey::VARCHAR, 9, '0'), '\\d{9}')::INT) AS r FROM customer) WHERE r >= 0.8""")
def _(read):
    d = read("customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("tax"), F.lit("x").alias("amka"))
    return d.sparkSession.createDataFrame(sorted(advice.greek_identifiers(d).items()), "column string, kind string")


@query("cls4_type_labels", """WITH x AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_orderstatus) AS b, count(DISTINCT o_totalprice) AS c, count(DISTINCT o_orderdate) AS d FROM orders)
SELECT 'o_orderkey' AS "column", 'Integer — Identifier (' || a || ' values)' AS label FROM x UNION ALL SELECT 'o_orderstatus', 'Character — Categorical (' || b || ' values)' FROM x
UNION ALL SELECT 'o_totalprice', 'Float — Continuous (' || c || ' values)' FROM x UNION ALL SELECT 'o_orderdate', 'Date — Temporal (' || d || ' values)' FROM x""")
def _(read):
    d = read("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    kinds = dict(d.dtypes)
    return d.sparkSession.createDataFrame([(c, advice.semantic_label(p, kinds[c])) for c, p in detect.profile(d).items()], "column string, label string")


@query("sel11_least_k", """WITH n AS (SELECT count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders), s AS (SELECT unnest([3, 5, 7]) AS k)
SELECT coalesce(min(k), 10)::BIGINT AS k FROM (SELECT k, (SELECT quantile_cont(1.0 / n, 0.95) FROM n WHERE n >= k) AS r FROM s) WHERE r <= 0.10""")
def _(read):
    d = read("orders")
    return d.sparkSession.createDataFrame([(advice.step_down(d, ["o_orderstatus", "o_orderpriority"], 10, 0.10),)], "k long")


@query("sel7_contexts", """SELECT * FROM (VALUES ('public_release', 10::BIGINT, 0.01::DOUBLE, 0.15::DOUBLE, 'PUBLIC'), ('scientific_use', 5, 0.05, 0.10, 'SCIENTIFIC'), ('secure_environment', 3, 0.10, 0.08, 'SECURE'), ('regulatory_compliance', 5, 0.03, 0.12, 'PUBLIC'), ('default', 5, 0.05, 0.12, 'SCIENTIFIC')) t(context, k, reid_95, info_loss, tier)""")
def _(read):
    rows = [(n, c["k_min"], c["reid_95_max"], c["info_loss_max"], c["tier"]) for n in advice.CONTEXTS for c in [advice.context(n)]]
    return read("region").sparkSession.createDataFrame(rows, "context string, k long, reid_95 double, info_loss double, tier string")


def _quantiles(column: str) -> str:
    return f"SELECT quantile_cont(1.0 / n, 0.5) AS r50, quantile_cont(1.0 / n, 0.95) AS r95, quantile_cont(1.0 / n, 0.99) AS r99, avg(1.0 / n) AS m FROM (SELECT count(*) OVER (PARTITION BY p_brand, {column}) AS n FROM part)"


_SHAPE = """CASE WHEN r50 > 0.20 AND r99 - r50 < 0.10 THEN 'uniform_high' WHEN r50 > 0.20 THEN 'widespread' WHEN r99 / r50 > 10 AND r99 > 0.30 THEN 'severe_tail'
WHEN r95 > 0.30 OR (r99 / r50 > 5 AND (r99 > 0.50 OR (r50 < 0.05 AND r99 > 0.20))) THEN 'tail' WHEN r50 < 0.05 THEN 'uniform_low' WHEN abs(m - r50) > 0.15 THEN 'bimodal' ELSE 'moderate' END"""


@query("agg7_risk_pattern", " UNION ALL ".join(f"SELECT '{c}' AS qi, {_SHAPE} AS pattern FROM ({_quantiles(c)})" for c in ("p_type", "p_size", "p_partkey")))
def _(read):
    d, rows = read("part"), []
    for c in ("p_type", "p_size", "p_partkey"):
        sizes = ec_sizes(d, ["p_brand", c])
        share = F.lit(1.0) / F.col("n")
        r = sizes.agg(F.percentile(share, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n")).alias("q"), (F.count("*") / F.sum("n")).alias("m")).first()
        rows.append((c, risk.risk_pattern(*r["q"], r["m"])))
    return d.sparkSession.createDataFrame(rows, "qi string, pattern string")


@query("agg6_risk_level", """WITH e AS (SELECT c, n FROM (SELECT 'p_type' AS c, count(*) AS n FROM part GROUP BY p_brand, p_type UNION ALL SELECT 'p_size', count(*) FROM part GROUP BY p_brand, p_size UNION ALL SELECT 'p_partkey', count(*) FROM part GROUP BY p_brand, p_partkey)),
f AS (SELECT c, count(*) FILTER (n = 1) / sum(n) AS u, min(n) AS least, coalesce(sum(n) FILTER (n < 3), 0) / sum(n) AS bad FROM e GROUP BY c)
SELECT c AS qi, CASE WHEN u > 0.10 OR bad > 0.15 THEN 'critical' WHEN u > 0.05 OR least < 2 OR least < 3 THEN 'high' WHEN u > 0.02 OR bad > 0.05 THEN 'medium' ELSE 'low' END AS level FROM f""")
def _(read):
    rows = []
    for c in ("p_type", "p_size", "p_partkey"):
        r = ec_sizes(read("part"), ["p_brand", c]).agg((F.count_if(F.col("n") == 1) / F.sum("n")).alias("u"), F.min("n").alias("least"), (F.coalesce(F.sum(F.when(F.col("n") < 3, F.col("n"))), F.lit(0)) / F.sum("n")).alias("bad")).first()
        rows.append((c, risk.risk_level(r["u"], r["bad"], r["least"], r["least"] >= 3)))
    return read("region").sparkSession.createDataFrame(rows, "qi string, level string")


@query("ut17_verdicts", """SELECT n_nationkey AS before, n_regionkey AS after, CASE WHEN abs(n_regionkey - n_nationkey) * 0.04 < 0.05 THEN 'minimal' WHEN abs(n_regionkey - n_nationkey) * 0.04 < 0.15 THEN 'moderate' ELSE 'significant' END AS verdict,
round(0.7 * n_nationkey / 25 + 0.3 * n_regionkey / 5, 6) AS overall, round(CASE WHEN n_regionkey / 5 < 0.4 THEN least(0.5 * n_nationkey / 25 + 0.2 + 0.3 * n_regionkey / 5, 0.4 + n_regionkey / 5) ELSE 0.5 * n_nationkey / 25 + 0.2 + 0.3 * n_regionkey / 5 END, 6) AS related,
round(CASE WHEN n_nationkey >= 24 THEN (n_regionkey / 5 + 1) / 2 ELSE 0.5 * n_nationkey / 25 + 0.25 * (n_regionkey / 5 + 1) END, 6) AS blended FROM nation""")
def _(read):
    rows = []
    for r in read("nation").collect():
        a, b = r["n_nationkey"], r["n_regionkey"]
        rows.append((a, b, utility.verdict(a * 0.04, b * 0.04), utility.overall(a / 25, b / 5), utility.overall(a / 25, 1.0, b / 5), utility.blended(a / 25, [b / 5, 1.0])))
    return r6(read("region").sparkSession.createDataFrame(rows, "before int, after int, verdict string, overall double, related double, blended double"))
