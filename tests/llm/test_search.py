"""Pair and passage operators, the classifier and the mix against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.llm import classifier, common, components, decontamination, hashing, mixing, ngram_join, suffix_dedup

DOCS = "doc_id long, text string, source string"


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, k=5):
    w = words(t)
    m = min(k, len(w))
    return frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else frozenset()


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = text(60)
    out = [None, "", "  \n ", "one", "One", "two words", "two  WORDS", "a b c d", "a b c d e"]
    base = text(150)
    for _ in range(90):  # near copies around the threshold
        w = base.split()
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    out += [base] * 20
    for _ in range(60):
        out.append(text(r.randrange(5, 80)) + " " + passage + " " + text(r.randrange(0, 80)))
    out += [text(r.randrange(1, 200)) for _ in range(60)]
    out.append("long " * 3000)
    out.append(text(4000))
    return [(i, t, "s") for i, t in enumerate(out)]


def brute_classes(rows):
    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("short,big,block", [(48, 128, 512), (4, 10_000, 512), (4, 8, 16)])
def test_ngram_join(spark, monkeypatch, short, big, block):
    """Whole short lists, the join of long ones, and blocks of very long ones."""
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BIG", big)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = corpus()
    d = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).withColumn("sid", F.lit(0)).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(d).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("big, block", [(128, 512), (4, 8)])
def test_ngram_join_tells_every_link(spark, monkeypatch, big, block):
    monkeypatch.setattr(ngram_join, "BIG", big)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = [*corpus(5), (7, "One", "s"), (None, "one", "s")]
    sets = [shingles(t) for _, t, _ in rows]
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    want = sorted((i or 0, len(x), sum(near(x, y) for y in sets) - bool(x)) for (i, _, _), x in zip(rows, sets))
    d = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["n_links"]) for r in ngram_join.link_counts(d).collect()) == want
    found = ngram_join.links(d)[1]
    different = {x for x in sets if x}
    assert found.count() == found.select("a", "b").distinct().count() == sum(near(x, y) for x, y in itertools.combinations(different, 2))


def test_ngram_join_links_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.link_counts(none).count() == 0 and ngram_join.links(none)[1].count() == 0
    bare = spark.createDataFrame([(1, None, "s"), (2, " ", "s")], DOCS)
    assert {tuple(r) for r in ngram_join.link_counts(bare).collect()} == {(1, 0, 0), (2, 0, 0)}


def test_ngram_join_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f", "s"), (5, "a b c d e f", "s"), (5, "a b c d e f", "s"), (7, "A b c d e f", None)]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.classes(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 5), (5, 5), (5, 5), (7, 5)]
    assert ngram_join.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_ngram_join_of_a_template_with_many_fillings(spark, monkeypatch):
    """Long lists of one template: a large class, what hangs on it by a chain, and sets that only share its frequent shingles."""
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    monkeypatch.setattr(ngram_join, "BIG", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    r = random.Random(8)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for _ in range(120):
        w = base[:]
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(100)] = f"f{r.randrange(10**6)}"
        rows.append(" ".join(w))
    for j in range(4, 60, 4):  # a chain that leads away from the template
        rows.append(" ".join([f"c{i}" for i in range(j)] + base[j:]))
    rows += [" ".join(base[:50] + [f"o{r.randrange(10**6)}" for _ in range(50)]) for _ in range(60)]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    rows = [(i, t, "s") for i, t in rows]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.classes(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute_classes(rows)


def test_ngram_join_orders_lines_of_unrelated_documents_last(spark, monkeypatch):
    """A line that a piece of memory rarely holds twice is frequent all the same, so its list brings no candidates."""
    monkeypatch.setattr(ngram_join, "CHUNK", 1000)
    r = random.Random(11)
    line = " ".join(f"line{i}" for i in range(30))
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(100)) + (f" {line}" if i % 20 == 0 else ""), "s") for i in range(1200)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    postings = ngram_join._prefixes(d, 80, 5)[1]
    assert postings.where("NOT hot").groupBy("h").count().agg(F.max("count")).first()[0] <= 2
    assert not any(r["component_id"] != r["doc_id"] for r in ngram_join.classes(d).collect())


@pytest.mark.parametrize("slots", [64, 1 << 16])
def test_ngram_join_looks_sets_up_by_a_filter(spark, monkeypatch, slots):
    """No text is shuffled; the filter holds every id, negative ones too, and letting others through changes nothing."""
    monkeypatch.setattr(ngram_join, "SLOTS", slots)
    ids = [-(2**62), -5, -1, 0, 1, 77, 2**40 + 3]
    marks = ngram_join._marks(spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long"))
    assert ngram_join._marked(pa.array(ids, pa.int64()), marks).all()
    assert ngram_join._marked(pa.array(range(10_000, 20_000), pa.int64()), marks).sum() <= 10_000 * len(ids) / min(slots, 10_000) + len(ids)
    rows = [(i - 60, t, s) for i, t, s in corpus(9)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute_classes(rows)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(None, 3), (7, 7)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if find(x) != x}


def test_word_hashes_match_split():
    texts = ["", None, " a  b\tc ", "Éa éA", "x", "\n\nq\x0bw\x0ce\r", "z" * 5000, "A a"]
    h, at = hashing.word_hashes(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        assert at[i + 1] - at[i] == len(w)
        for x, y in zip(w, h[at[i] : at[i + 1]]):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
    sliced = pa.RecordBatch.from_arrays([pa.array(texts[1:])], names=["text"]).slice(1)
    assert sum(p.num_rows for p in hashing.slices(sliced, most_bytes=8)) == len(texts) - 2


CLASHES = ["tid", "uid", "hits", "row", "key", "n", "iid", "shingle", "tid0", "a.b"]


def test_decontamination(spark, monkeypatch):
    rows = corpus()
    rows += [rows[120], rows[121], rows[2], (1000, "filler " * 200_000 + rows[140][1], "s")]
    items = [(1, rows[120][1]), (2, "nothing of this is there at all anywhere"), (3, None), (4, ""), (5, "two words"), (6, " ".join(rows[140][1].split()[2:40])), (6, "x y z q r s"), (None, rows[10][1])]
    d, b = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for item, t in items:
        q = shingles(t)
        k = min(5, len(words(t)))
        for i, text, _ in rows:
            if q and 100 * len(q & (shingles(text, k) if len(words(text)) >= k else set())) >= 80 * len(q):
                want.append((i, item, len(q)))
    clash = d.withColumns({c: F.lit("clash") for c in CLASHES})
    for bits in (28, 16):  # hardly a hit by chance, and many
        monkeypatch.setattr(decontamination, "MOST_BITS", bits)
        got = [(r["doc_id"], r["item_id"], r["n_shingles"]) for r in decontamination.contained_items(clash, b.withColumn("n", F.lit("clash"))).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    for told in (1 << 22, 0):  # told to all tasks, and joined
        monkeypatch.setattr(decontamination, "MOST_TOLD", told)
        left = decontamination.drop_contaminated(clash, b)
        assert left.columns == ["doc_id", "text", "source", *CLASHES]
        assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((i for i, *_ in rows if i not in {x[0] for x in want}), key=str)
    assert decontamination.contained_items(d, b.limit(0)).count() == 0 and decontamination.contained_items(d.limit(0), b).count() == 0


def brute_repeats(rows, least):
    grams, texts = {}, {}
    for i, t, _ in rows:
        if i is not None:
            texts.setdefault(i, []).append(words(t))
    for i, ws in texts.items():
        for w in ws:
            for p in range(len(w) - least + 1):
                grams.setdefault(tuple(w[p : p + least]), set()).add(i)
    out = {}
    for i, ws in texts.items():
        at = {x for w in ws for p in range(len(w) - least + 1) if len(grams[tuple(w[p : p + least])]) > 1 for x in range(p, p + least)}
        if at:
            out[i] = len(at)
    return out


def test_suffix_dedup(spark):
    rows = [*corpus(), (None, corpus()[120][1], "s"), (120, corpus()[120][1], "s")]
    d = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("tid", F.lit(0)).repartition(3)
    got = {r["doc_id"]: r["n_repeat_words"] for r in suffix_dedup.repeated_spans(d).collect()}
    want = brute_repeats(rows, 50)
    assert got == want
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_dedup_over_partition_boundaries(spark):
    r = random.Random(11)
    text = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    shared = [text(60) for _ in range(60)]
    rows = [(2 * k + side, text(10) + " " + p + " " + text(10), "s") for k, p in enumerate(shared) for side in (0, 1)]
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x["doc_id"]: x["n_repeat_words"] for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute_repeats(rows, 50)


def test_suffix_dedup_of_passages_that_one_document_repeats(spark):
    r = random.Random(12)
    text = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    passages = [text(60) for _ in range(4)]
    rows = [(i, " ".join(text(50) + " " + p for _ in range(60)), "s") for i, p in enumerate(passages)]
    rows += [(10 + i, text(50) + " " + p + " " + text(50), "s") for i, p in enumerate(passages)]
    got = {x["doc_id"]: x["n_repeat_words"] for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_repeats(rows, 50)


def test_suffix_dedup_in_runs_of_one_word(spark):
    r = random.Random(13)
    text = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    tails = [text(45) for _ in range(3)]
    rows = [(10 * k + i, text(20) + f" of{k}" * n + " " + tail + " " + text(20), "s") for k, tail in enumerate(tails) for i, n in enumerate((30, 75, 200, 400))]
    got = {x["doc_id"]: x["n_repeat_words"] for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_repeats(rows, 50)


@pytest.mark.parametrize("case", ["one word only", "tails and heads of a passage", "large keys", "runs around the least length"])
def test_suffix_dedup_of_hot_keys(spark, case):
    r = random.Random(5)
    text = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    if case == "one word only":
        rows = [(0, "q " * 100, "s"), (1, "q " * 100, "s")]
    elif case == "tails and heads of a passage":
        w = text(50).split()
        rows = [(i, " ".join([text(20), *w, text(20)]), "s") for i in (0, 1)]
        rows += [(10 + i, " ".join([text(30), *(w[25:] if i % 2 else w[:25]), text(30)]), "s") for i in range(120)]
    elif case == "large keys":
        rows = []
        for k, n in enumerate((33, 200, 5000)):
            q = text(55)
            rows += [(10_000 * (k + 1) + i, text(6) + " " + q + " " + text(4), "s") for i in range(n)]
    else:
        rows = [(i, text(20) + " of" * n + " " + text(30), "s") for i, n in enumerate((49, 50, 51, 60, 120, 300, 500))]
    got = {x["doc_id"]: x["n_repeat_words"] for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_repeats(rows, 50)


def test_ngram_join_links_over_null_ids(spark):
    w = [f"n{i}" for i in range(100)]
    first, bridge = w, w[:94] + [f"m{i}" for i in range(6)]
    last = [f"k{i}" for i in range(6)] + bridge[6:]
    rows = [(7, " ".join(first), "s"), (None, " ".join(bridge), "s"), (None, " ".join(bridge), "s"), (9, " ".join(last), "s"), (11, "alone", "s")]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.classes(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 7), (0, 7), (7, 7), (9, 7), (11, 11)]


def test_minimisers_are_the_windows_least():
    r = np.random.default_rng(2)
    for n in (0, 5, 42, 43, 44, 300):
        keys = r.integers(0, 1000, n, dtype=np.uint64)
        want = {p for s in range(n - 43 + 1) for p in range(s, s + 43) if keys[p] == keys[s : s + 43].min() and (p == 0 or keys[p] != keys[p - 1])}
        assert set(suffix_dedup.minimisers(keys, 43).tolist()) == want


def test_classifier_on_held_out_rows(spark):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "a", "mat"]) + r.choice(["", "s"]) for _ in range(40))
    rows = [(i, good() if i % 3 else " ".join(w + "%%%" for w in good().split())) for i in range(400)] + [(400, None), (401, ""), (None, good())]
    rows += [rows[3], (500, "word " * 300_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "row", "inner", "slots", "y", "a.b")})
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = classifier.quality_classifier(d, labels).withColumn("held", classifier.is_held_out()).collect()
    assert len(out) == len(rows)
    held = [x for x in out if x["held"] and x["doc_id"] is not None and x["doc_id"] < 400]
    assert held and all(x["predicted"] == int(x["doc_id"] % 3 > 0) for x in held)
    assert all(0 <= x["score"] <= 1 for x in out)
    again = {x["doc_id"]: x["score"] for x in classifier.quality_classifier(d.repartition(5), labels).collect()}
    assert again == {x["doc_id"]: x["score"] for x in out}
    assert classifier.quality_classifier(d.limit(0), labels.limit(0)).count() == 0


def test_classifier_sends_texts_alone_to_python_once(spark, monkeypatch):
    d = common.table(spark, "/root/testdata/sf0.001", "documents").withColumn("score", F.lit("own"))
    model = np.random.default_rng(5).normal(size=1 << classifier.BITS).astype(np.float32)
    scored, good = classifier.score(d, model), classifier.keep_good(d, model)
    monkeypatch.setattr(classifier, "train", lambda *a, **k: model)
    for out in (scored, good, classifier.quality_classifier(d, None)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    rows, slots, weights = classifier.features(pa.array([x["text"] for x in d.collect()]))
    plain = 1 / (1 + np.exp(-np.bincount(rows, (model[slots] * weights).astype(np.float64))))
    assert np.allclose([x["score"] for x in scored.collect()], plain)
    assert good.columns == d.columns and sorted(map(str, good.collect())) == sorted(str(x) for x, p in zip(d.collect(), plain) if p >= 0.3)


def test_ftrl_against_the_plain_recurrence():
    """Per-coordinate follow-the-regularised-leader, one number at a time."""
    r = random.Random(4)
    rows = []
    for _ in range(60):
        slots = sorted(r.sample(range(16), 5))
        rows.append((np.array(slots, np.int32), np.array([r.random() for _ in slots], np.float32), float(3 in slots)))
    alpha, beta, l1, l2 = 0.15, 1.0, 0.02, 0.5
    z, n = [0.0] * 16, [0.0] * 16
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)
    rng = np.random.default_rng(7)
    for _ in range(4):
        for k in rng.permutation(len(rows)):
            slots, xs, y = rows[k]
            w = [weight(i) for i in slots]
            p = 1 / (1 + np.exp(-sum(a * float(x) for a, x in zip(w, xs))))
            for i, a, x in zip(slots, w, xs):
                g = (p - y) * float(x)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * a
                n[i] += g * g
    assert np.allclose(classifier.ftrl(rows, bits=4), [weight(i) for i in range(16)], atol=1e-5)


def brute_features(text, bits):
    raw = [w for w in (text or "").encode().split()]
    sign = lambda b: "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else chr(b)
    shapes = [re.sub(r"(.)\1+", r"\1", "".join(map(sign, w))) for w in raw]
    return [w.lower() for w in raw], shapes


def test_features_follow_words_and_shapes():
    texts = ["The the of%%% that***", None, "", "a", "Éa x1 y22 z333 \n zz", "w " * 50]
    rows, slots, weights = classifier.features(pa.array(texts))
    for i, t in enumerate(texts):
        words_, shapes = brute_features(t, 18)
        views = [set(zip(*[x[k:] for k in range(m)])) for x, m in ((words_, 1), (words_, 2), (shapes, 1), (shapes, 2), (shapes, 3))]
        again = sum(a == b for a, b in zip(words_, words_[1:]))
        mine = rows == i
        assert len(slots[mine]) == sum(map(len, views)) + 1 + (again > 0)
        w = dict(zip(slots[mine].tolist(), weights[mine].tolist()))
        assert w[0] == 1 and (not again or abs(w[1] - (again / len(words_)) ** 0.5) < 1e-6)
        assert abs(sum(v * v for s, v in w.items() if s > 1) * max(1, len(words_)) - sum(max(0, len(words_) - k) for k in (0, 1, 0, 1, 2))) < 1e-3


def test_water_fill():
    t = mixing.water_fill([100, 10, 100], [5, 2, 1])
    assert t[1] == 20 and abs(sum(t) - 315) < 1e-9 and t[0] == 200
    assert mixing.water_fill([0, 0], [5, 2]) == [0, 0] and mixing.water_fill([], []) == []


def test_route_fills_overlapping_quotas():
    flow = mixing.route([(100, (0,)), (100, (0, 1)), (50, (1,))], [150, 120])
    into = [sum(v for (_, j, _), v in flow.items() if j == s) for s in (0, 1)]
    assert into == [150, 120]
    for i, w in enumerate([100, 100, 50]):
        for c in (1, 2):
            assert sum(v for (p, _, k), v in flow.items() if (p, k) == (i, c)) <= w
    assert sum(v for (_, _, c), v in flow.items() if c == 1) == 250


def brute_route(capacity, quotas):
    """(words that reach the quotas, least cost) over all whole-word plans: each pattern gives some words to each source."""
    best = (0, 0)
    options = []
    for words, members in capacity:
        options.append([x for x in itertools.product(*[range(2 * words + 1) if j in members else (0,) for j in range(len(quotas))]) if sum(x) <= 2 * words])
    for plan in itertools.product(*options):
        into = [sum(x[j] for x in plan) for j in range(len(quotas))]
        if all(a <= q for a, q in zip(into, quotas)):
            cost = sum(min(sum(x), w) + 4 * max(0, sum(x) - w) for x, (w, _) in zip(plan, capacity))
            best = max(best, (sum(into), -cost))
    return best[0], -best[1]


@pytest.mark.parametrize("seed", range(12))
def test_route_against_brute_force(seed):
    r = random.Random(seed)
    capacity = [(r.randrange(1, 4), tuple(sorted(r.sample(range(2), r.randrange(1, 3))))) for _ in range(3)]
    quotas = [r.randrange(0, 8), r.randrange(0, 8)]
    flow = mixing.route(capacity, quotas)
    into = [sum(v for (_, j, _), v in flow.items() if j == k) for k in range(2)]
    assert all(a <= q for a, q in zip(into, quotas)) and all(j in capacity[i][1] for i, j, _ in flow)
    assert all(sum(v for (p, _, k), v in flow.items() if (p, k) == (i, c)) <= w for i, (w, _) in enumerate(capacity) for c in (1, 2))
    assert (sum(into), sum(v * c * c for (_, _, c), v in flow.items())) == brute_route(capacity, quotas)


MIX_CLASHES = ["taken", "pattern", "size", "row", "order", "id", "rounds", "room", "limit", "whole", "extra", "p", "s", "_m_rest", "a.b"]


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(r.randrange(0, 60))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(900, None, "b"), (901, "x " * 2000, "a"), (None, "q", "c")]
    d = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in MIX_CLASHES})
    frame = mixing.mix_documents(d)
    assert {c for c in MIX_CLASHES if c not in ("taken", "size")} <= set(frame.columns) and len(set(frame.columns)) == len(frame.columns)
    out = frame.collect()
    assert len(out) == len(rows)
    sizes, taken = {}, {}
    for x in out:
        assert x["taken"] in (0, x["size"], 2 * x["size"])
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    for n, t in zip(names, mixing.by_weight()([sizes[n] for n in names])):
        assert abs(taken[n] - t) <= max(20, 0.006 * t), n
        assert {(x["source_size"], x["target"]) for x in out if x["source"] == n} == {(sizes[n], t)}
    again = {x["doc_id"]: x["taken"] for x in mixing.mix_documents(d.repartition(7)).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in out}
    assert mixing.mix_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_mixing_passes_over_what_does_not_fit(spark, seed):
    """One document longer than the room, and rows that repeat a key: the rest still comes near the target."""
    rows = [(i, "w " * 100, "a") for i in range(200)] + [(500, "w " * 30_000, "a")] + [(600, "w " * 90, "a")] * 40
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS), F.array("source"), mixing.word_count(), lambda sizes: [20_050.0], seed=seed).collect()
    assert abs(sum(x["taken"] for x in out) - 20_050) <= 270
    assert len({x["taken"] for x in out if x["doc_id"] == 600}) == 1


def test_mixing_of_overlapping_sources(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(1, 40), r.choice([["a"], ["a", "b"], ["b"], ["b", "c"], ["c", None], [], None])) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    out = mixing.mix_sources(d, F.col("sources"), mixing.word_count(), lambda sizes: [0.5 * s for s in sizes]).collect()
    given = {}
    for x in out:
        assert not x["taken"] or x["sources"]
        given[tuple(x["pattern"] or ())] = given.get(tuple(x["pattern"] or ()), 0) + x["taken"]
    sizes = {n: sum(x["size"] for x in out if n in (x["sources"] or [])) for n in ("a", "b", "c", None)}
    assert abs(sum(given.values()) - 0.5 * sum(sizes.values())) <= 0.01 * sum(sizes.values())
    with pytest.raises(ValueError):
        mixing.mix_sources(d, F.col("sources"), mixing.word_count(), lambda sizes: sizes, most_patterns=2)


def brute_lines(rows):
    """Texts by doc_id without the lines whose keys three documents hold, but for the largest."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(h := holders.get(key(x), ())) >= 3 and i != max(h)
    return {i: "\n".join(x for x in (t or "").split("\n") if not gone(i, x)) for i, t in rows.items()}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage of the whole pipeline on a whole table against a plain version of what it keeps."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").withColumns({c: F.lit("clash") for c in ("row", "rest", "taken", "n_dropped", "kept", "score", "tid", "component_id", "pattern")})
    names = docs.columns
    states = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mix":
            assert docs.columns == names
        states[name] = {r["doc_id"]: r for r in docs.collect()}
        assert states[name] and all(r["rest"] == r["row"] == "clash" for r in states[name].values())
    texts = {n: {i: r["text"] for i, r in s.items()} for n, s in states.items()}
    source = common.table(spark, sf, "documents")
    model = classifier.train(source, common.table(spark, sf, "labels"))
    assert set(texts["quality"]) == {r["doc_id"] for r in classifier.score(source, model).where("score >= 0.3").collect()}
    assert texts["lines"] == brute_lines(texts["quality"])
    assert all(r["n_chars"] == len(r["text"]) for i, r in states["lines"].items() if r["text"] != texts["quality"][i])
    classes = brute_classes([(i, t, "s") for i, t in texts["lines"].items()])
    assert set(texts["near_duplicates"]) == {i for i, (_, least) in classes.items() if i == least}
    items = [shingles(r["text"]) for r in common.table(spark, sf, "benchmark").collect()]
    hit = lambda t: any(q and 100 * len(q & shingles(t, min(5, len(next(iter(q)))))) >= 80 * len(q) for q in items)
    assert texts["decontaminate"] == {i: t for i, t in texts["near_duplicates"].items() if not hit(t)}
    sizes = {}
    for r in states["decontaminate"].values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for n, target in zip(order, mixing.by_weight()([sizes[n] for n in order])):
        mixed = [r for r in states["mix"].values() if r["source"] == n]
        longest = max(len(words(r["text"])) for r in states["decontaminate"].values() if r["source"] == n)
        assert abs(sum(r["taken"] for r in mixed) - target) <= max(0.006 * target, longest / 2 + 1)
        assert all(r["taken"] in (r["size"], 2 * r["size"]) and r["size"] == len(words(r["text"])) for r in mixed)


def test_pipeline_stage_of_unrelated_documents_with_common_lines(spark, monkeypatch):
    """Near duplicates are found and no block is made for lists of a line that rare pieces of memory hold twice."""
    import corpus_pipeline

    monkeypatch.setattr(ngram_join, "CHUNK", 1000)
    monkeypatch.setattr(ngram_join, "BIG", 8)
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    blocks, made = ngram_join._block_links, []
    monkeypatch.setattr(ngram_join, "_block_links", lambda sets, *a: made.append(sets.count()) or blocks(sets, *a))
    r = random.Random(12)
    line = " ".join(f"line{i}" for i in range(30))
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(100)) + (f" {line}" if i % 20 == 0 else ""), "s") for i in range(1200)]
    rows += [(2000 + i, rows[i][1] + " end", "s") for i in range(0, 100, 10)]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, d, "").collect()) == list(range(1200))
    assert made == []


def shuffled_bytes(spark, action):
    """What `action` returns, and the bytes of shuffle that its stages write."""
    store, lists = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    stages = lambda: store.stageList(lists(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), lists())
    last = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    out = action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    told = stages()
    return out, sum(x.shuffleWriteBytes() for x in map(told.apply, range(told.size())) if x.stageId() > last)


def test_pipeline_stage_drops_copies_without_a_shuffle_of_texts(spark):
    import corpus_pipeline

    r = random.Random(13)
    rows = [(i, " ".join(f"w{r.randrange(10**9)}" for _ in range(300)), "s") for i in range(300)]
    rows += [(1000 + i, rows[i][1], "s") for i in range(10)] + [(None, rows[0][1], "s"), (None, None, "s"), (2000, "", None)]
    d = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.near_duplicates(spark, d, "")
    out, size = shuffled_bytes(spark, kept.collect)
    assert sorted(map(str, out)) == sorted(str(x) for x in d.collect() if not 1000 <= (x["doc_id"] or 0) < 2000)
    assert size < 0.3 * sum(len(t or "") for _, t, _ in rows)


@pytest.mark.parametrize("slots", [8, 64, 1 << 25])
def test_without_compares_what_the_filter_stops(spark, monkeypatch, slots):
    monkeypatch.setattr(ngram_join, "SLOTS", slots)
    ids = [0, 1, 5, 63, 64, -1, -7, 2**62, -(2**63), 2**40 + 3, None]
    d = spark.createDataFrame([(i, str(i), 1, "b") for i in ids + ids], "doc_id long, text string, id int, bits string")
    for gone in ([], [5], [64, -1, 2**62, 99], ids):
        out = ngram_join.without(d, spark.createDataFrame([(i,) for i in gone + gone], "doc_id long"))
        assert out.columns == d.columns
        assert sorted(x["text"] for x in out.collect()) == sorted(2 * [str(i) for i in ids if i is None or i not in gone])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
