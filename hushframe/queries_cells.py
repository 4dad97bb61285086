"""Queries over column transforms, binning and generalization ladders."""

from pyspark.sql import functions as F

from .catalog import query
from .functions import cells, hierarchy
from .operators import generalize
from .queries_risk import r6


@query("prj1_projection", "SELECT c_custkey, c_mktsegment FROM customer")
def _(read):
    return read("customer").select("c_custkey", "c_mktsegment")


@query("tx1_hash_identifier", "SELECT c_custkey, substr(sha256('s' || c_name), 1, 16) AS c_name FROM customer")
def _(read):
    return read("customer").select("c_custkey", cells.hashed(F.col("c_name"), "s").alias("c_name"))


@query("tx1_pseudonyms", "SELECT c_custkey, printf('ID_%08d', dense_rank() OVER (ORDER BY c_name)) AS c_name FROM customer")
def _(read):
    return cells.pseudonyms(read("customer").select("c_custkey", "c_name"), "c_name")


@query("tx1_drop_identifiers", "SELECT * EXCLUDE (c_name) FROM customer")
def _(read):
    return read("customer").drop("c_name")


@query("tx2_top_bottom_percentile", "SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 6) AS c_acctbal FROM customer, (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer)")
def _(read):
    return r6(cells.top_bottom_code(read("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("tx2_top_bottom_iqr", "SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, q1 - 0.5 * (q3 - q1)), q3 + 0.5 * (q3 - q1)), 6) AS price FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)")
def _(read):
    d = cells.top_bottom_code(read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"], "iqr", iqr=0.5)
    return r6(d.withColumnRenamed("l_extendedprice", "price"))


@query("tx2_top_bottom_fixed", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN least(greatest(c_acctbal, 100.0), 5000.0) END AS bal FROM customer")
def _(read):
    d = read("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    return cells.top_bottom_code(d, ["bal"], "fixed", {"bal": (100.0, 5000.0)})


@query("tx3_merge_rare", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n < greatest(10, (SELECT floor(count(*) * 2 / 100) FROM part)) THEN 'Other' ELSE p_size::VARCHAR END AS size FROM part JOIN c USING (p_size)")
def _(read):
    return cells.merge_rare(read("part").select("p_partkey", F.col("p_size").cast("string").alias("size")), "size", 10, 2.0)


@query("tx4_round_base", "SELECT o_orderkey, round_even(o_totalprice / 500, 0) * 500 AS price FROM orders")
def _(read):
    return read("orders").select("o_orderkey", cells.round_base(F.col("o_totalprice"), 500).alias("price"))


@query("tx4_round_significant", "SELECT o_orderkey, round(CASE WHEN o_totalprice = 0 THEN 0 ELSE round_even(o_totalprice / pow(10, floor(log10(abs(o_totalprice))) - 1), 0) * pow(10, floor(log10(abs(o_totalprice))) - 1) END, 6) AS price FROM orders")
def _(read):
    return r6(read("orders").select("o_orderkey", cells.round_significant(F.col("o_totalprice"), 2).alias("price")))


@query("tx4_round_auto", "SELECT o_orderkey, CASE WHEN m >= 10000 THEN round_even(o_totalprice / 1000, 0) * 1000 WHEN m >= 1000 THEN round_even(o_totalprice / 100, 0) * 100 WHEN m >= 100 THEN round_even(o_totalprice / 10, 0) * 10 ELSE o_totalprice END AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders)")
def _(read):
    return cells.round_auto(read("orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("tx5_quantile_bins", """WITH q AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [i / 20 FOR i IN range(21)]))) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, len(list_filter(e[2:-2], lambda b: b < l_extendedprice)) + 1 AS bin FROM lineitem, q""")
def _(read):
    d = read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    edges = cells.quantile_edges(d, "l_extendedprice", 20)
    return d.select("l_orderkey", "l_linenumber", cells.by_edges(F.col("l_extendedprice"), edges, [str(i + 1) for i in range(len(edges) - 1)]).cast("bigint").alias("bin"))


_DATE = {"year": "strftime(o_orderdate, '%Y')", "quarter": "year(o_orderdate) || 'Q' || quarter(o_orderdate)", "month": "strftime(o_orderdate, '%Y-%m')", "week": "strftime(o_orderdate, '%Y-W%W')"}
for _g, _s in _DATE.items():

    @query(f"tx6_date_{_g}", f"SELECT o_orderkey, {_s} AS d FROM orders")
    def _(read, g=_g):
        return read("orders").select("o_orderkey", cells.truncate_date(F.col("o_orderdate"), g).alias("d"))


@query("tx7_age_bins", "SELECT p_partkey, (p_size // 5 * 5) || '-' || (p_size // 5 * 5 + 4) AS age FROM part")
def _(read):
    return read("part").select("p_partkey", cells.age_bins(F.col("p_size"), 5).alias("age"))


@query("tx7_age_custom", "SELECT p_partkey, CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 18 THEN '10-17' WHEN p_size < 40 THEN '18-39' ELSE '40+' END AS age FROM part")
def _(read):
    return read("part").select("p_partkey", cells.age_bins(F.col("p_size"), edges=[10, 18, 40]).alias("age"))


@query("tx8_coarsen_place", "SELECT c_custkey, CASE WHEN length(trim(c_name)) > 9 THEN rpad(substr(trim(c_name), 1, 9), length(trim(c_name))::INT, '*') ELSE trim(c_name) END AS c FROM customer")
def _(read):
    return read("customer").select("c_custkey", cells.coarsen_place(F.col("c_name"), 9).alias("c"))


@query("tx9_truncate_text", "SELECT c_custkey, left(c_name, 10) AS a, right(c_name, 4) AS b FROM customer")
def _(read):
    return read("customer").select("c_custkey", cells.truncate_text(F.col("c_name"), 10).alias("a"), cells.truncate_text(F.col("c_name"), 4, True).alias("b"))


@query("tx10_sample")
def _(read):
    return cells.sample(read("customer"), size=100)


@query("tx10_sample_stratified")
def _(read):
    return cells.sample(read("customer"), 0.2, strata="c_mktsegment")


@query("tx11_generalize_numeric", "SELECT c_custkey, (floor(c_acctbal / 500) * 500)::BIGINT || '-' || (floor(c_acctbal / 500) * 500 + 500)::BIGINT AS b FROM customer")
def _(read):
    return read("customer").select("c_custkey", cells.interval(F.col("c_acctbal"), 500).alias("b"))


@query("tx12_generalize_categorical", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'works' WHEN 'MACHINERY' THEN 'works' ELSE c_mktsegment END AS s FROM customer")
def _(read):
    return read("customer").select("c_custkey", cells.remap(F.col("c_mktsegment"), {"BUILDING": "works", "MACHINERY": "works"}).alias("s"))


@query("tx13_prefix", "SELECT c_custkey, left(c_name, 3) || '*' AS p FROM customer")
def _(read):
    return read("customer").select("c_custkey", cells.prefix(F.col("c_name"), 3).alias("p"))


@query("gen2_equal_width", """WITH w AS (SELECT ceil((max(l_quantity) - min(l_quantity)) / 10) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, (floor(l_quantity / w) * w)::BIGINT || '-' || (floor(l_quantity / w) * w + w - 1)::BIGINT AS q FROM lineitem, w""")
def _(read):
    d = generalize.generalize_numeric(read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q")), "q", 10)
    return d


@query("gen3_quantile_skewed")
def _(read):
    d = read("events").select("event_id", F.exp(F.col("value") / 20).alias("v"))
    return generalize.generalize_numeric(d, "v", 10)


@query("gen4_adaptive_date", "SELECT o_orderkey, CASE WHEN m BETWEEN 3 AND 60 THEN strftime(o_orderdate, '%Y-%m') WHEN q BETWEEN 3 AND 60 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) ELSE strftime(o_orderdate, '%Y') END AS o_orderdate FROM orders, (SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS m, count(DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate)) AS q FROM orders)")
def _(read):
    return generalize.generalize_date(read("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 60)


@query("gen5_top_n", "WITH r AS (SELECT p_name, row_number() OVER (ORDER BY count(*) DESC, p_name) AS r FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN r <= 9 THEN p_name ELSE 'Other' END AS p_name FROM part JOIN r USING (p_name)")
def _(read):
    return generalize.generalize_category(read("part").select("p_partkey", "p_name"), "p_name", 10)


@query("gen1_generalize")
def _(read):
    return generalize.generalize(read("part"), ["p_brand", "p_type", "p_size"], 8, target=0.02).df


@query("gen7_suggest")
def _(read):
    d = read("part")
    return d.sparkSession.createDataFrame(list(generalize.suggest(d, ["p_brand", "p_type", "p_size"]).items()), "qi string, most long")


for _l in (1, 2, 3, 4):

    @query(f"hie2_interval_l{_l}", f"""WITH s AS (SELECT quantile_cont(p_size, 0.98) AS t, quantile_cont(p_size, 0.02) AS b FROM part)
SELECT p_partkey, CASE WHEN p_size > t THEN '>=' || CASE WHEN t = floor(t) THEN t::INT::VARCHAR ELSE printf('%.1f', t) END WHEN p_size < b THEN '<=' || CASE WHEN b = floor(b) THEN b::INT::VARCHAR ELSE printf('%.1f', b) END
ELSE (p_size // {5 * 2 ** (_l - 1)} * {5 * 2 ** (_l - 1)}) || '-' || (p_size // {5 * 2 ** (_l - 1)} * {5 * 2 ** (_l - 1)} + {5 * 2 ** (_l - 1) - 1}) END AS g FROM part, s""")
    def _(read, level=_l):
        d = read("part")
        return d.select("p_partkey", hierarchy.interval_ladder(d, "p_size").at(level).alias("g"))


for _g, _s in {"day": "strftime(l_shipdate, '%Y-%m-%d')", "week": "strftime(l_shipdate, '%G-W%V')", "month": "strftime(l_shipdate, '%Y-%m')", "quarter": "year(l_shipdate) || '-Q' || quarter(l_shipdate)", "year": "strftime(l_shipdate, '%Y')"}.items():

    @query(f"hie3_date_{_g}", f"SELECT l_orderkey, l_linenumber, {_s} AS g FROM lineitem")
    def _(read, g=_g):
        d = read("lineitem")
        ladder = hierarchy.date_ladder(d, "l_shipdate")
        return d.select("l_orderkey", "l_linenumber", ladder.at(ladder.names.index(g)).alias("g"))


@query("hie4_masking", "SELECT c_custkey, rpad(left(c_name, greatest(length(c_name) - 3, 0)::INT), length(c_name)::INT, '*') AS r, lpad(right(c_name, greatest(length(c_name) - 3, 0)::INT), length(c_name)::INT, '*') AS l FROM customer")
def _(read):
    d = read("customer")
    return d.select("c_custkey", hierarchy.mask_ladder(d, "c_name").at(3).alias("r"), hierarchy.mask_ladder(d, "c_name", False).at(3).alias("l"))


@query("hie5_categorical", """WITH c AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n >= greatest(1, (SELECT floor(count(*) * 0.01) FROM part)) THEN p_brand ELSE 'Other' END AS l1, CASE WHEN r <= greatest(3, least(10, floor(sqrt((SELECT count(*) FROM c))))) THEN p_brand ELSE 'Other' END AS l2, '*' AS l3 FROM part JOIN c USING (p_brand)""")
def _(read):
    d = read("part")
    x = hierarchy.category_ladder(d, "p_brand")
    return d.select("p_partkey", *[x.at(i).alias(f"l{i}") for i in (1, 2, 3)])


@query("hie5_groups", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'works' ELSE c_mktsegment END AS l1, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'works' ELSE 'Other' END AS l2 FROM customer")
def _(read):
    d = read("customer")
    x = hierarchy.category_ladder(d, "c_mktsegment", {"works": ["BUILDING", "MACHINERY"]})
    return d.select("c_custkey", x.at(1).alias("l1"), x.at(2).alias("l2"))


@query("hie1_info_loss", "SELECT * FROM (SELECT unnest(range(5)) AS level, unnest([0.0, 0.0, round(1 - count(DISTINCT strftime(o_orderdate, '%G-W%V')) / count(DISTINCT o_orderdate), 6), round(1 - count(DISTINCT strftime(o_orderdate, '%Y-%m')) / count(DISTINCT o_orderdate), 6), round(1 - count(DISTINCT year(o_orderdate) || '-Q' || quarter(o_orderdate)) / count(DISTINCT o_orderdate), 6)]) AS loss FROM orders)")
def _(read):
    d = read("orders")
    loss = hierarchy.date_ladder(d, "o_orderdate").info_loss(d)
    return d.sparkSession.createDataFrame([(i, round(x, 6)) for i, x in enumerate(loss[:5])], "level long, loss double")


@query("hie6_auto_ladder")
def _(read):
    d = read("customer")
    found = [(c, x.kind, x.height) for c in d.columns if (x := hierarchy.auto_ladder(d, c))]
    return d.sparkSession.createDataFrame(found, "column string, kind string, height long")


@query("gen6_adaptive", """WITH s AS (SELECT min(p_size) AS lo, max(p_size) AS hi, count(DISTINCT p_size) AS k FROM part), c AS (SELECT unnest([5, 10, least(k, 15)]) AS n FROM s)
SELECT n::BIGINT AS candidate, rank() OVER (ORDER BY n DESC) AS tried FROM c""")
def _(read):
    d = read("part")
    k = d.agg(F.count_distinct("p_size")).first()[0]
    return d.sparkSession.createDataFrame([(n, i + 1) for i, n in enumerate(generalize.candidates(10, k))], "candidate long, tried long")
