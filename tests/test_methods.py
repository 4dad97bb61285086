import pytest
from pyspark.sql import functions as F

from hushframe.functions import cells, hierarchy
from hushframe.operators import detect, generalize, kanon, locsupr, perturb, swap, utility
from hushframe.operators.ec import with_row_id
from hushframe.operators.risk import k_check
from hushframe.plans import advice, engine, preprocess, review, rules
from hushframe.plans.features import features
from hushframe.sources import io
from tests import fixtures_tables as fx


@pytest.mark.parametrize("strategy", ["generalization", "hybrid", "beam", "recursive", "suppression"])
def test_kanon_is_k_anonymous(spark, strategy):
    rows, schema, qis = fx.low3()
    out = kanon.k_anonymize(spark.createDataFrame(rows[:1500], schema), qis, 5, strategy)
    r = k_check(out.df, qis, 5, "as_value").first()
    assert r["is_k_anonymous"] and out.df.count() == 1500


@pytest.mark.parametrize("strategy", ["generalization", "hybrid", "beam", "recursive", "suppression"])
def test_kanon_leaves_no_small_class_of_emptied_rows(spark, strategy):
    """Two odd rows among equal ones: the rows without any value are k as well, or none."""
    rows = [(30, "M")] * 200 + [(31, "F"), (77, "X")]
    d = spark.createDataFrame(rows, "age long, sex string")
    out = kanon.k_anonymize(d, ["age", "sex"], 5, strategy)
    assert k_check(out.df, ["age", "sex"], 5, "as_value").first()["is_k_anonymous"] and out.df.count() == 202


def test_suppress_small_takes_the_smallest_classes_within_budget(spark):
    rows = [(g, "x") for g in range(40) for _ in range(g % 4 + 1)] + [(100, "x")] * 300
    d = spark.createDataFrame(rows, "g long, h string")
    out, touched = kanon.suppress_small(d, ["g", "h"], 5, most_rows=0.05)
    assert k_check(out, ["g", "h"], 5, "as_value").first()["is_k_anonymous"]
    assert touched == 100 and out.where("g = 100").count() == 300


@pytest.mark.parametrize("name", list(fx.DEGENERATE))
def test_degenerate_tables(spark, name):
    d = spark.createDataFrame(fx.DEGENERATE[name], fx.DEGENERATE_SCHEMA)
    n, qis = d.count(), ["age", "sex"]
    assert kanon.k_anonymize(d, qis, 3).df.count() == n
    assert locsupr.suppress_locally(d, qis, 3).df.count() == n
    r = with_row_id(d)
    assert perturb.pram(r, ["sex"], "_rid").count() == n
    assert perturb.noise(r, ["income"], "_rid").count() == n
    assert generalize.generalize(d, qis, 5).df.count() == n


def test_kanon_checks_arguments(spark):
    d = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        kanon.k_anonymize(d, ["a"], 1)
    with pytest.raises(ValueError):
        kanon.k_anonymize(d, ["a"], 3, "magic")


def test_locsupr_caps_and_leaves_other_columns(spark):
    rows, schema, qis = fx.severe_tail()
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", v long")
    out = locsupr.suppress_locally(d, qis, 3)
    assert sum(out.cells.values()) <= 0.2 * len(rows) * len(qis)
    assert out.violations < k_check(d, qis, 3, "as_value").first()["violating_rows"]
    assert out.df.select(F.sum("v")).first()[0] == sum(range(len(rows)))
    one = locsupr.suppress_locally(d, qis, 3, most_per_record=1).df
    assert one.select(F.max(sum(F.col(q).isNull().cast("int") for q in qis))).first()[0] <= 1


def test_pram_keeps_shares_and_reruns_agree(spark):
    d = spark.range(20000).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("c"))
    one = perturb.pram(d, ["c"], "id", 0.3, method="invariant")
    two = perturb.pram(d.repartition(7), ["c"], "id", 0.3, method="invariant")
    assert one.exceptAll(two).count() == 0
    share = one.agg(F.avg((F.col("c") == "a").cast("double"))).first()[0]
    assert abs(share - 0.25) < 0.02
    for m in (perturb.uniform_matrix(["a", "b", "c"], 0.4), perturb.invariant_matrix({"a": 0.7, "b": 0.2, "c": 0.1}, 0.4)):
        assert all(abs(sum(t.values()) - 1) < 1e-9 for t in m.values())


@pytest.mark.parametrize("kind", ["gaussian", "laplace", "uniform", "proportional"])
def test_noise_keeps_mean_sign_cap_and_type(spark, kind):
    d = spark.range(5000).select("id", (F.col("id") % 100 - 20).alias("n"), (F.col("id") * 1.5).alias("x"))
    out = perturb.noise(d, ["n", "x"], "id", 0.2, kind)
    j = utility.paired(d, out, "id", ["n", "x"])
    r = j.agg(F.avg("o_x").alias("a"), F.avg("p_x").alias("b"), F.max(F.abs(F.col("p_x") - F.col("o_x")) - 0.2500001 * F.abs("o_x")).alias("over"), F.count_if(F.signum("o_n") * F.signum("p_n") < 0).alias("flips")).first()
    assert abs(r["a"] - r["b"]) / r["a"] < 0.02 and r["flips"] == 0
    assert dict(out.dtypes)["n"] == "bigint"


def test_correlated_noise_follows_the_covariance(spark):
    d = spark.range(20000).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    out = utility.paired(d, perturb.correlated_noise(d, ["x", "y"], "id", 0.1), "id", ["x", "y"])
    assert out.agg(F.corr(F.col("p_x") - F.col("o_x"), F.col("p_y") - F.col("o_y"))).first()[0] > 0.95


def test_ladders_end_in_a_star_and_lose_more(spark):
    d = spark.range(400).select((F.col("id") % 100).alias("age"), F.concat(F.lit("1"), F.lpad((F.col("id") % 90).cast("string"), 4, "0")).alias("zip"), F.timestamp_seconds(F.col("id") * 86400 * 3).alias("day"), F.concat(F.lit("c"), (F.col("id") % 30).cast("string")).alias("cat"))
    for c, kind in (("age", "interval"), ("zip", "masking"), ("day", "date"), ("cat", "categorical")):
        x = hierarchy.auto_ladder(d, c)
        assert x.kind == kind
        loss = x.info_loss(d)
        assert loss[0] == 0 and loss[-1] == max(loss)
        assert {r[0] for r in d.select(x.at(99)).distinct().collect()} == {"*"}


def test_null_stays_null_in_cell_transforms(spark):
    d = spark.createDataFrame([(None, None, None)], "n double, s string, t timestamp")
    n, s, t = F.col("n"), F.col("s"), F.col("t")
    out = d.select(cells.clamp(n, 0.0, 1.0), cells.round_base(n, 5), cells.round_significant(n, 2), cells.interval(n, 10), cells.age_bins(n), cells.age_bins(n, edges=[1, 5]), cells.coarsen_place(s), cells.truncate_text(s), cells.prefix(s), cells.truncate_date(t, "week"), cells.hashed(s), cells.remap(s, {"a": "b"}), cells.by_edges(n, [0.0, 1.0, 2.0]), generalize.numeric_bins(n, 0.5), hierarchy.starred(s))
    assert all(v is None for v in out.first())


def test_nice_numbers():
    assert [hierarchy.nice(x) for x in (0, 0.3, 1, 1.1, 2.2, 3, 7, 11, 21, 24, 26, 120)] == [1, 1, 1, 2, 2, 5, 10, 20, 25, 25, 50, 200]


@pytest.mark.parametrize("fixture,rule,context", [
    (fx.severe_tail, "QR1_Severe_Tail_Risk", {}), (fx.low1, "LOW1_Categorical", {}), (fx.low3, "LOW3_Mixed", {}), (fx.hr6, "HR6_Very_Small_Dataset", {}), (fx.sr3, "SR3_Near_Unique_Few_QIs", {}),
    (fx.pub1_high, "PUB1_Public_Release_High_Risk", {"tier": "PUBLIC", "target": 0.01}), (fx.cat1, "SEC1_Secure_Categorical", {"tier": "SECURE", "utility_floor": 0.9}), (fx.pub1_high, "QR2_Moderate_Tail_Risk", {}),
    (fx.cat1, "CAT1_Categorical_Moderate", {"metric": "l_diversity"}),
])
def test_rule_table(spark, fixture, rule, context):
    rows, schema, qis = fixture()
    assert rules.select(features(spark.createDataFrame(rows, schema), qis, **context)).rule == rule


def test_k_follows_size():
    assert [rules.sized_k(n, 10) for n in (300, 900, 1500, 3000, 9000)] == [3, 8, 8, 7, 10]


def test_protect_meets_a_feasible_target(spark):
    rows, schema, qis = fx.low3()
    p = engine.protect(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", id long"), qis, 0.05, "id")
    assert p.met and p.df.count() == len(rows) and 0 <= p.utility["score"] <= 1
    assert not [w for w in engine.validate(p, qis) if "classes" in w]


def test_engine_rejects_unknown_parameters(spark):
    d = spark.createDataFrame([("a",), ("b",)], "q string")
    with pytest.raises(ValueError, match="unknown parameters"):
        engine.apply_method(d, ["q"], "PRAM", {"strenght": 1})
    with pytest.raises(ValueError, match="unknown method"):
        engine.apply_method(d, ["q"], "MAGIC")


def test_utility_of_an_unchanged_table_is_whole(spark):
    d = spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    u = utility.composite(d, d, "id", ["x"], ["c"])
    assert abs(u["score"] - 1) < 1e-6 and u["information_loss"] == 0


def test_detection(spark):
    d = spark.range(300).select(F.col("id").alias("customer_id"), F.concat(F.lit("a"), F.col("id").cast("string"), F.lit("@x.org")).alias("contact"), (F.col("id") % 60 + 18).alias("age"), F.when(F.col("id") % 2 == 0, "M").otherwise("F").alias("sex"), (F.col("id") * 97 % 1000).cast("double").alias("income"))
    assert detect.direct_identifiers(d) == {"customer_id": "other_identifier", "contact": "email"}
    role = {r["column"]: r["role"] for r in detect.classify(d).collect()}
    assert role["customer_id"] == role["contact"] == "identifier" and role["sex"] == "quasi_identifier" and role["income"] == "sensitive"
    assert detect.is_sequential(d, "customer_id") and not detect.is_sequential(d, "age")


def test_prepare_drops_identifiers_only_once_asked(spark):
    d = spark.range(300).select(F.col("id").alias("customer_id"), (F.col("id") % 60 + 18).alias("age"), (F.col("id") % 5).cast("string").alias("area"))
    qis = ["age", "area"]
    assert "customer_id" not in preprocess.prepare(d, qis).df.columns
    assert preprocess.prepare(d, qis, "report_only").df.columns == d.columns
    assert preprocess.prepare(d, qis, identifiers="pseudonymize").df.filter(F.col("customer_id").startswith("ID_")).count() == 300
    assert preprocess.prepare(d, qis, "none").steps == []


def test_csv_round_trip_and_types(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write("id;amount;day;name\n1;1.234,5;31/12/2020;x\n2;;01/02/2021;\n3;2,5;05/06/2021;z\n")
    d = io.read_csv(spark, path)
    assert {t for _, t in d.dtypes} == {"string"} and d.where("name = ''").count() == 1
    t = io.recover_types(d)
    assert dict(t.dtypes) == {"id": "double", "amount": "double", "day": "timestamp", "name": "string"}
    assert [r["amount"] for r in t.orderBy("id").collect()] == [1234.5, None, 2.5]
    io.export(t, str(tmp_path / "out"), "parquet", {"k": 5})
    assert io.read(spark, t) is t and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_stream_recoding(spark, tmp_path):
    from hushframe.streaming import recode

    spark.range(100).select((F.col("id") % 50).alias("age")).write.parquet(str(tmp_path / "in"))
    s = recode.recode_stream(spark.readStream.schema("age long").parquet(str(tmp_path / "in")), {"age": lambda c: cells.age_bins(c, 10)})
    q = s.writeStream.format("memory").queryName("recoded").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["age"] for r in spark.sql("SELECT DISTINCT age FROM recoded").collect()} == {"0-9", "10-19", "20-29", "30-39", "40-49"}
    raw = spark.readStream.schema("age long").parquet(str(tmp_path / "in"))
    q = recode.protect_batches(raw, lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_rank_swap_reaches_its_share_of_a_large_table(spark):
    d = spark.range(300_000).select("id", F.col("id").alias("x"))
    out = swap.rank_swap(d, ["x"], "id", 0.05).agg(F.max(F.abs(F.col("x") - F.col("id"))).alias("far"), F.countDistinct("x").alias("n")).first()
    assert 10_000 < out["far"] < 15_000 and out["n"] == 300_000


def test_swapping_keeps_distributions(spark):
    d = spark.range(1000).select("id", (F.col("id") * 7 % 501).alias("x"), (F.col("id") % 40).cast("string").alias("g"), (F.col("id") % 3).cast("string").alias("m"))
    out = swap.rank_swap(d, ["x"], "id", 0.05)
    assert out.groupBy("x").count().exceptAll(d.groupBy("x").count()).count() == 0
    j = utility.paired(d, out, "id", ["x"])
    assert j.agg(F.max(F.abs(F.col("o_x") - F.col("p_x")))).first()[0] <= 40 and j.where("o_x <> p_x").count() > 500
    out = swap.record_swap(d, ["g"], ["m"], "id", 100)
    assert out.groupBy("g", "m").count().exceptAll(d.groupBy("g", "m").count()).count() == 0
    assert swap.pareto([("a", 0.1, 0.9), ("b", 0.2, 0.8), ("c", 0.05, 0.5)]) == [("c", 0.05, 0.5), ("a", 0.1, 0.9)]


def test_advice(spark):
    assert advice.merge_advice({"k": 5, "strategy": "hybrid"}, {"k": 3, "strategy": "beam", "evil": 1}) == {"k": 5, "strategy": "beam"}
    assert advice.merge_advice({"k": 5}, {"k": 99}) == {"k": 50}
    assert advice.context("public_release")["tier"] == "PUBLIC"
    with pytest.raises(ValueError):
        advice.context("nowhere")
    rows, schema, qis = fx.low3()
    d = spark.createDataFrame(rows, schema)
    assert advice.kanon_advice(d, qis, 5).parameters["strategy"] == "suppression"
    assert advice.pram_advice(d, ["region"]).parameters["variables"] == ["region"]
    assert advice.noise_advice(d, ["age"]).parameters["kind"] == "gaussian"
    assert any("rows are few" in w for w in advice.warnings(d.limit(50), qis))
    assert advice.recommendations(features(d, qis)) == []


def test_preference_and_trace():
    c = rules.Choice("R", "kANON", {"k": 5}, [("PRAM", {"p_change": 0.2}), ("LOCSUPR", {"k": 3})], trace=["R"])
    got = rules.prefer(c, "LOCSUPR")
    assert (got.method, got.parameters, got.fallbacks) == ("LOCSUPR", {"k": 3}, [("kANON", {"k": 5}), ("PRAM", {"p_change": 0.2})])
    assert got.trace == ["R", "preferred:LOCSUPR"] and rules.prefer(c, "NOISE") is c and rules.prefer(c, None) is c


def _result(method, after, score, suppressed, target=0.05):
    return engine.Protected(None, method, {}, 0.2, after, {"score": score}, suppressed, target)


def test_challenge_gates(spark):
    rows, schema, qis = fx.low1()
    f = features(spark.createDataFrame(rows, schema), qis)
    best = _result("kANON", 0.04, 0.70, 0.10)
    assert engine.challenge_parameters(f, best) == {"variables": f.categorical, "p_change": round(min(0.35, 0.15 + 0.3 * f.r95), 2)}
    assert engine.challenge_parameters(f, _result("kANON", 0.04, 0.70, 0.01)) is None
    assert engine.challenge_parameters(f, _result("NOISE", 0.04, 0.70, 0.10)) is None
    assert engine.challenge_parameters(f, _result("kANON", 0.40, 0.70, 0.10)) is None
    assert engine.wins(_result("PRAM", 0.04, 0.74, 0.0), best) and not engine.wins(_result("PRAM", 0.04, 0.72, 0.0), best) and not engine.wins(_result("PRAM", 0.06, 0.90, 0.0), best)


def test_apply_and_validate_retries_once(spark):
    rows = [(f"g{g}", g * 100 + i) for g in range(30) for i in range(5 if g < 10 else 7)]
    d = spark.createDataFrame(rows, "g string, id long")
    run = lambda target: engine.apply_and_validate(d, ["g"], "kANON", {"k": 5, "strategy": "suppression"}, target=target, key="id")
    best, wrong = run(0.25)
    assert best.parameters["k"] == 5 and not wrong
    best, wrong = run(0.15)
    assert best.parameters["k"] == 7 and best.met and not wrong
    best, wrong = run(0.01)
    assert "the risk target is missed" in wrong


def test_guidance_grades_and_candidates(spark):
    assert review.guidance(0.04, 0.05, 0.0, 0.9, "kANON", ["a"], {"a": 3}) == []
    assert len(review.guidance(0.5, 0.05, 0.4, 0.3, "PRAM", list("abcde"), {"c": 9})) == 5
    assert [review.grade(*x) for x in ((0.04, 0.05, 0.8), (0.04, 0.05, 0.6), (0.04, 0.05, 0.1), (0.054, 0.05, 0.9), (0.2, 0.05, 0.9))] == ["good", "fair", "poor", "near_miss", "failed"]
    assert generalize.candidates(10, 12) == [12, 10, 5] and generalize.candidates(10, 100, "heavy") == [10, 5, 3] and generalize.candidates(10, 100, "light") == [20, 15, 10]
    d = spark.range(1000).select((F.col("id") % 100).alias("v"))
    out, bins = generalize.generalize_adaptively(d, "v", 10, lambda x: x.distinct().count() <= 12)
    assert bins == 10 and out.distinct().count() <= 12
    assert utility.blended(1.0, [0.5, 0.7]) == pytest.approx(0.6) and utility.blended(0.5, [0.7]) == pytest.approx(0.6)


def test_coerce_needs_over_half_and_keeps_the_rest(spark):
    d = spark.createDataFrame([("1", "1.234,5", "x", "7"), ("2", "2,5", "3", None), ("", "abc", "y", "8"), (None, "7", "z", "?")], "a string, b string, c string, d string")
    out = io.coerce(d, {"a": "Coded", "b": "Numeric", "c": "Numeric", "d": "Character"})
    assert dict(out.dtypes) == {"a": "double", "b": "double", "c": "string", "d": "string"}
    assert [r["b"] for r in out.collect()] == [1234.5, 2.5, None, 7.0] and [r["a"] for r in out.collect()] == [1.0, 2.0, None, None]


def test_derived_columns_stand_beside_their_source(spark):
    d = spark.createDataFrame([(i, "a" if i < 6 else "b" if i < 9 else "c", float(i)) for i in range(10)] + [(10, None, None)], "id long, c string, v double")
    top = cells.derived(d, "c", "topk", keep=1)
    assert [r["c_topk"] for r in top.orderBy("id").collect()] == ["a"] * 6 + ["Other"] * 4 + [None] and top.drop("c_topk").columns == d.columns
    assert cells.derived(d, "v", "binned", bins=2).select("v_binned").distinct().count() == 3
    assert cells.derived(d.limit(0), "v", "binned").columns == [*d.columns, "v_binned"]


def test_record_swap_touches_risky_rows_alone(spark):
    rows = [(i, "r" if i < 40 else f"q{i}", "m" if i % 2 else None) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, a string, g string")
    out = {r["id"]: r for r in swap.record_swap(d, ["a"], ["g"], "id", 5).collect()}
    assert all(out[i]["a"] == "r" for i in range(40)) and sorted(r["a"] for r in out.values()) == sorted(r[1] for r in rows)
    assert all(out[i]["a"] != f"q{i}" and rows[int(out[i]["a"][1:])][2] == rows[i][2] for i in range(40, 60))
