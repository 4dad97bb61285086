"""Queries over detection, selection, preparation and whole protection runs."""

from pyspark.sql import functions as F

from .catalog import query
from .operators import detect
from .plans import advice, engine, preprocess, rules
from .plans.features import features
from .queries_risk import r6
from .sources import io

_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
_CARD = r"^[0-9]{13,19}$"


def words(read):
    return read("documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))


@query("cls1_pattern_rates", f"SELECT 'w' AS \"column\", p AS pattern, round(avg(regexp_matches(w, r)::INT), 6) AS rate FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents), (VALUES ('email', '{_EMAIL}'), ('credit_card', '{_CARD}')) t(p, r) GROUP BY ALL")
def _(read):
    keep = {k: detect.IDENTIFIER_PATTERNS[k] for k in ("email", "credit_card")}
    return r6(detect.pattern_rates(words(read), ["w"], keep))


@query("cls1_direct_identifiers", """SELECT column_name AS "column", 'name' AS kind FROM (DESCRIBE customer) WHERE column_name LIKE '%name'""")
def _(read):
    d = read("customer")
    return d.sparkSession.createDataFrame(sorted(detect.direct_identifiers(d).items()), "column string, kind string")


@query("cls3_profile", """SELECT * FROM (SELECT unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice']) AS "column", unnest([count(DISTINCT o_orderstatus), count(DISTINCT o_orderpriority), count(DISTINCT o_totalprice)]) AS "distinct", unnest([NULL, NULL, min(o_totalprice)]) AS low, unnest([NULL, NULL, max(o_totalprice)]) AS high FROM orders)""")
def _(read):
    d = read("orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    return d.sparkSession.createDataFrame([(c, p.distinct, p.low, p.high) for c, p in detect.profile(d).items()], "column string, distinct long, low double, high double")


@query("cls5_qi_scores")
def _(read):
    d = read("part")
    return d.sparkSession.createDataFrame([(c, float(s)) for c, s in detect.qi_scores(d).items()], "column string, score double")


@query("cls8_classify")
def _(read):
    return detect.classify(read("customer"))


@query("cls12_dependencies", """WITH j AS (SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT 'n_nationkey' AS determinant, 'n_regionkey' AS dependent, avg((d <= 1)::INT) AS share FROM (SELECT count(DISTINCT n_regionkey) AS d FROM j GROUP BY n_nationkey)
UNION ALL SELECT 'n_nationkey', 'r_name', avg((d <= 1)::INT) FROM (SELECT count(DISTINCT r_name) AS d FROM j GROUP BY n_nationkey)
UNION ALL SELECT 'n_regionkey', 'n_nationkey', avg((d <= 1)::INT) FROM (SELECT count(DISTINCT n_nationkey) AS d FROM j GROUP BY n_regionkey)
UNION ALL SELECT 'n_regionkey', 'r_name', avg((d <= 1)::INT) FROM (SELECT count(DISTINCT r_name) AS d FROM j GROUP BY n_regionkey)
UNION ALL SELECT 'r_name', 'n_nationkey', avg((d <= 1)::INT) FROM (SELECT count(DISTINCT n_nationkey) AS d FROM j GROUP BY r_name)
UNION ALL SELECT 'r_name', 'n_regionkey', avg((d <= 1)::INT) FROM (SELECT count(DISTINCT n_regionkey) AS d FROM j GROUP BY r_name)) SELECT * FROM s WHERE share >= 0.95""")
def _(read):
    d = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return detect.dependencies(d, ["n_nationkey", "n_regionkey", "r_name"])


@query("cls12_correlated", """WITH c AS (SELECT corr(p_size, p_retailprice) AS x, corr(p_retailprice, 2 * p_retailprice) AS y FROM part)
SELECT * FROM (SELECT 'p_size' AS a, 'p_retailprice' AS b, round(x, 6) AS r FROM c UNION ALL SELECT 'p_size', 'double_price', round(x, 6) FROM c UNION ALL SELECT 'p_retailprice', 'double_price', round(y, 6) FROM c) WHERE abs(r) > 0.95""")
def _(read):
    return r6(detect.correlated(read("part").withColumn("double_price", F.col("p_retailprice") * 2), ["p_size", "p_retailprice", "double_price"]))


@query("cls14_sequential", "SELECT 'o_orderkey' AS \"column\", count(DISTINCT o_orderkey) = count(*) AND count(*) / (max(o_orderkey) - min(o_orderkey) + 1) >= 0.8 AS is_sequential FROM orders")
def _(read):
    d = read("orders")
    return d.sparkSession.createDataFrame([("o_orderkey", detect.is_sequential(d, "o_orderkey"))], "column string, is_sequential boolean")


@query("cls13_frequency_table", """SELECT (SELECT bool_and(a < 10000 AND b < 10000 AND c < 10000) FROM (SELECT count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b, count(*) FILTER (o_orderstatus = 'P') AS c FROM orders GROUP BY o_orderpriority)) AS "table",
(SELECT bool_and(p_partkey < 10000 AND p_size < 10000 AND p_retailprice = floor(p_retailprice) AND p_retailprice BETWEEN 0 AND 9999.99) FROM part) AS part""")
def _(read):
    from .functions.cells import frequency_table

    t = frequency_table(read("orders"), ["o_orderpriority", "o_orderstatus"])
    return t.sparkSession.createDataFrame([(detect.is_frequency_table(t), detect.is_frequency_table(read("part")))], "table boolean, part boolean")




@query("src6_recover_types", "SELECT c_custkey::DOUBLE AS id, round(c_acctbal, 2) AS bal, c_mktsegment AS seg FROM customer")
def _(read):
    d = read("customer").select(F.col("c_custkey").cast("string").alias("id"), F.format_string("%.2f", "c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return io.recover_types(d)


@query("src7_european_numbers", "SELECT c_custkey, round(c_acctbal, 2) AS bal FROM customer")
def _(read):
    text = F.translate(F.format_number(F.round("c_acctbal", 2), 2), ",.", ".,")
    return read("customer").select("c_custkey", io.european(text).alias("bal"))


@query("agg19_features", """WITH e AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT quantile_cont(1.0 / n, 0.95) AS r FROM (SELECT count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n FROM part)),
t AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT p_brand) * count(DISTINCT p_type) * count(DISTINCT p_size) AS space, count(DISTINCT p_size) AS sizes FROM part)
SELECT 'n' AS feature, n AS value FROM t UNION ALL SELECT 'reid_95', round(r, 6) FROM r UNION ALL SELECT 'expected_size', round(n / space, 6) FROM t UNION ALL SELECT 'high_rate', round(coalesce(sum(n) FILTER (n < 5), 0) / sum(n), 6) FROM e
UNION ALL SELECT 'uniqueness', round(count(*) / sum(n), 6) FROM e UNION ALL SELECT 'cat_ratio', round((2 + (sizes <= 20)::INT) / 3, 6) FROM t
""" + "".join(f"UNION ALL SELECT 'suppression_{k}', round(coalesce(sum(n) FILTER (n < {k}), 0) / sum(n), 6) FROM e " for k in (3, 5, 7, 10)))
def _(read):
    f = features(read("part"), ["p_brand", "p_type", "p_size"], ["p_retailprice"])
    rows = [("n", float(f.n)), ("reid_95", f.r95), ("expected_size", f.expected_size), ("high_rate", f.high_rate), ("uniqueness", f.uniqueness), ("cat_ratio", f.cat_ratio), *[(f"suppression_{k}", v) for k, v in f.suppression.items()]]
    return r6(read("part").sparkSession.createDataFrame([(a, float(b)) for a, b in rows], "feature string, value double"))


@query("pre9_preparation_report", """WITH a AS (SELECT p_brand AS b, p_size AS s FROM part), c AS (SELECT left(p_brand, 7) AS b, p_size // 10 AS s FROM part),
f AS (SELECT 'rows' AS figure, (SELECT count(*) FROM a)::DOUBLE AS before, (SELECT count(*) FROM c)::DOUBLE AS after
UNION ALL SELECT 'values_p_brand', (SELECT count(DISTINCT b) FROM a), (SELECT count(DISTINCT b) FROM c) UNION ALL SELECT 'values_p_size', (SELECT count(DISTINCT s) FROM a), (SELECT count(DISTINCT s) FROM c)
UNION ALL SELECT 'expected_size', (SELECT count(*) / (count(DISTINCT b) * count(DISTINCT s)) FROM a), (SELECT count(*) / (count(DISTINCT b) * count(DISTINCT s)) FROM c)
UNION ALL SELECT 'reid_95', (SELECT quantile_cont(1.0 / n, 0.95) FROM (SELECT count(*) OVER (PARTITION BY b, s) AS n FROM a)), (SELECT quantile_cont(1.0 / n, 0.95) FROM (SELECT count(*) OVER (PARTITION BY b, s) AS n FROM c)))
SELECT figure, round(before, 6) AS before, round(after, 6) AS after FROM f""")
def _(read):
    from .plans.review import preparation_report

    d = read("part")
    return r6(preparation_report(d, d.withColumns({"p_brand": F.substring("p_brand", 1, 7), "p_size": F.floor(F.col("p_size") / 10)}), ["p_brand", "p_size"]))


@query("sel1_rule")
def _(read):
    rows = []
    for t, q in (("part", ["p_brand", "p_type"]), ("orders", ["o_orderstatus", "o_orderpriority"]), ("supplier", ["s_nationkey", "s_name"])):
        c = rules.select(features(read(t), q))
        rows.append((t, c.rule, c.method))
    return read("region").sparkSession.createDataFrame(rows, "table string, rule string, method string")


@query("sel8_protect")
def _(read):
    return engine.protect(read("part").select("p_partkey", "p_brand", "p_type", "p_size"), ["p_brand", "p_type"], 0.10, "p_partkey").df.drop("_rid")


@query("sel14_compare")
def _(read):
    return engine.compare(read("part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], {"kANON": {"k": 5}, "LOCSUPR": {"k": 3}, "PRAM": {"variables": ["p_type"]}}, key="p_partkey", target=0.10)


@query("pre1_prepare")
def _(read):
    return preprocess.prepare(read("customer"), ["c_nationkey", "c_mktsegment"], sensitive=["c_acctbal"]).df


@query("pre3_typed_plan")
def _(read):
    d = read("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return preprocess.apply_plan(d, preprocess.typed_plan(d, ["o_orderdate", "o_totalprice"]))


@query("pre7_diagnose", """SELECT CASE WHEN b <= 0.10 THEN 'FEASIBLE' WHEN b <= 0.50 THEN 'HARD' ELSE 'VERY_HARD' END AS status, round(rows / space, 6) AS expected_size, round(m, 6) AS mean_size, round(c, 6) AS classes_below_k, round(b, 6) AS records_below_k FROM
(SELECT sum(n) AS rows, avg(n) AS m, avg((n < 5)::INT) AS c, coalesce(sum(n) FILTER (n < 5), 0) / sum(n) AS b FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type, p_size)), (SELECT count(DISTINCT p_brand) * count(DISTINCT p_type) * count(DISTINCT p_size) AS space FROM part)""")
def _(read):
    return r6(preprocess.diagnose(read("part"), ["p_brand", "p_type", "p_size"]))


@query("pre8_ensure_feasible")
def _(read):
    d = read("part")
    qis, k = preprocess.ensure_feasible(d, ["p_brand", "p_type", "p_size"])
    return d.sparkSession.createDataFrame([(",".join(qis), k)], "qis string, k long")


@query("pre5_adaptive")
def _(read):
    return preprocess.adaptive(read("part"), ["p_brand", "p_size"], 0.05)[0]


@query("sel6_kanon_advice", """SELECT CASE WHEN below < 0.05 OR least >= 3 THEN 5 WHEN below > 0.5 THEN greatest(3, least) ELSE 3 END::BIGINT AS k, CASE WHEN below < 0.1 THEN 'suppression' WHEN below < 0.4 THEN 'hybrid' ELSE 'generalization' END AS strategy, round(below, 6) AS classes_below, round(lost, 6) AS suppression FROM
(SELECT avg((n < 5)::INT) AS below, min(n) AS least, coalesce(sum(n) FILTER (n < 5), 0) / sum(n) AS lost FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type))""")
def _(read):
    d = read("part")
    a = advice.kanon_advice(d, ["p_brand", "p_type"], 5)
    return d.sparkSession.createDataFrame([(a.parameters["k"], a.parameters["strategy"], round(a.figures["classes_below"], 6), round(a.figures["suppression"], 6))], "k long, strategy string, classes_below double, suppression double")


@query("cls2_greek_identifiers")
def _(read):
    d = read("customer").withColumn("tax", F.lpad(F.col("c_custkey").cast("string"), 9, "0")).withColumn("amka", F.lit("x"))
    return d.sparkSession.createDataFrame(sorted(advice.greek_identifiers(d).items()), "column string, kind string")


@query("pre6_warnings")
def _(read):
    d = read("part")
    return d.sparkSession.createDataFrame([(w,) for w in advice.warnings(d, ["p_brand", "p_size", "p_name"])], "warning string")


@query("cls4_labels")
def _(read):
    d = read("part")
    kinds = dict(d.dtypes)
    return d.sparkSession.createDataFrame([(c, advice.semantic_label(p, kinds[c])) for c, p in detect.profile(d).items()], "column string, label string")


@query("sel11_step_down")
def _(read):
    d = read("part")
    return d.sparkSession.createDataFrame([(advice.step_down(d, ["p_brand", "p_type"], 10, 0.10),)], "k long")
