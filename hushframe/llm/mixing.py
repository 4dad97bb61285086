"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import BLANK, cut, packed, table, text_of, unpacked


def word_count(text: str = "text") -> Column:
    """Words of a text without building them: blanks-to-word steps; null has none."""
    return F.size(F.array_remove(F.split(text_of(text), BLANK + "+", -1), "")).cast("long")


def water_fill(sizes: list[float], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets by weight of `share` of all sizes, each at most `most` times its size, excess reshared by weight."""
    left, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left = max(0.0, left - sum(out[i] for i in over))
        free -= over
    return out


def route(capacity: list[tuple[int, tuple[int, ...]]], quotas: list[int], copies: int = 2) -> dict[tuple[int, int, int], int]:
    """(pattern, source, copy) to words: a min-cost flow from membership patterns to source quotas.

    capacity: (words, sources) of each pattern. Copy c of a pattern's words costs c*c, so repeats spread before they deepen;
    at most `copies` copies. Successive shortest paths on integer capacities. The graph has a node for each pattern and
    source, whatever the number of documents.
    """
    p, s = len(capacity), len(quotas)
    source, sink = p + s, p + s + 1
    to, cap, cost, adj = [], [], [], [[] for _ in range(p + s + 2)]

    def arc(a, b, c, w):
        adj[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        adj[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
        return len(to) - 2

    carried = [[] for _ in range(p)]
    supply = [[arc(source, i, words, c * c) for c in range(1, copies + 1)] for i, (words, _) in enumerate(capacity)]
    carry = {(i, j): arc(i, p + j, copies * words, 0) for i, (words, members) in enumerate(capacity) for j in members}
    for (i, j), e in carry.items():
        carried[i].append((j, e))
    for j, q in enumerate(quotas):
        arc(p + j, sink, q, 0)
    price = [0] * (p + s + 2)
    while True:
        dist, back, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in adj[u]:
                nd = d + cost[e] + price[u] - price[to[e]]
                if cap[e] and nd < dist.get(to[e], 1 << 60):
                    dist[to[e]], back[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if sink not in dist:
            break
        for u in range(p + s + 2):
            price[u] += min(dist.get(u, dist[sink]), dist[sink])
        path, u = [], sink
        while u != source:
            path.append(back[u])
            u = to[back[u] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flow = {}
    for i in range(p):
        amounts = [(c + 1, cap[e ^ 1]) for c, e in enumerate(supply[i])]
        for j, e in carried[i]:
            need = cap[e ^ 1]
            for k, (c, left) in enumerate(amounts):
                use = min(need, left)
                if use:
                    flow[i, j, c] = use
                    need, amounts[k] = need - use, (c, left - use)
    return flow


def _place() -> Column:
    """A document's place in the seeded order of its pattern; rows that repeat a key and a size share it."""
    return F.struct("order", "id", "size")


def _taken() -> Column:
    """Whether a document went in some round: no longer than the room was, and before what did not fit then."""
    return F.exists("rounds", lambda r: (F.col("size") <= r["room"]) & (r["after"].isNull() | (_place() > r["after"])) & (r["next"].isNull() | (_place() < r["next"])))


def _narrowed(e: DataFrame, shift: int) -> DataFrame:
    """The rows of the one stretch of each pattern's order in which its room ends, `before` grown by what stands before it."""
    e = e.withColumn("stretch", F.shiftright("order", shift))
    sums = e.groupBy("pattern", "stretch").agg(F.sum("size").alias("words"), F.first("room").alias("room"), F.first("before").alias("before"))
    sums = sums.withColumn("reached", F.col("before") + F.sum("words").over(W.partitionBy("pattern").orderBy("stretch")))
    ends = sums.where("reached > room").groupBy("pattern").agg(F.min(F.struct("stretch", (F.col("reached") - F.col("words")).alias("before"))).alias("end"))
    ends = ends.select(F.col("pattern").alias("p"), F.col("end.stretch").alias("s"), F.col("end.before").alias("b"))
    e = e.join(F.broadcast(ends), (F.col("pattern") == F.col("p")) & (F.col("stretch") == F.col("s")))
    return e.select("pattern", "room", "order", "id", "size", F.col("b").alias("before"))


def _next_round(d: DataFrame, plan: DataFrame) -> DataFrame:
    """(pattern, taken, next): what the documents that fit, in order, bring of each pattern's room, and the first that does not.

    plan: (pattern, room, after). Documents behind `after` count that alone would fit; a pattern without any has no row. What an
    earlier round passed over is too large for good, as the room only shrinks. The end is looked for in a thousandth of the order, then in a thousandth of that, so no task sorts
    more than a millionth of a pattern.
    """
    left = d.join(F.broadcast(plan), "pattern").where((F.col("size") > 0) & (F.col("size") <= F.col("room")) & (F.col("after").isNull() | (_place() > F.col("after"))))
    left = left.select("pattern", "room", "order", "id", "size", F.lit(0).cast("long").alias("before"))
    last = _narrowed(_narrowed(left, 54), 44).groupBy("pattern", _place().alias("place"), "room", "before").agg(F.sum("size").alias("words"))
    last = last.withColumn("reached", F.col("before") + F.sum("words").over(W.partitionBy("pattern").orderBy("place")))
    fits = F.col("reached") <= F.col("room")
    last = last.groupBy(F.col("pattern").alias("p")).agg(F.coalesce(F.max(F.when(fits, F.col("reached"))), F.first("before")).alias("part"), F.min(F.when(~fits, F.col("place"))).alias("next"))
    whole = left.groupBy("pattern").agg(F.sum("size").alias("all"))
    return whole.join(F.broadcast(last), F.col("pattern") == F.col("p"), "left").select("pattern", F.coalesce("part", "all").alias("taken"), "next")


def _name(x) -> tuple[bool, str]:
    return x["none"], x["name"] or ""


def _mix(docs: DataFrame, members: Column, size: Column, targets, seed: int, key: str, copies: int, most_patterns: int, near: float) -> tuple[DataFrame, list[tuple]]:
    """(docs with size, pattern and taken; (name, size, target) of each source): see mix_sources()."""
    tagged = F.array_sort(F.array_distinct(F.transform(members, lambda x: F.struct(x.isNull().alias("none"), x.alias("name")))))
    marked = docs.select(packed(docs), size.alias("size"), tagged.alias("pattern"), F.xxhash64(F.col(key), F.lit(seed)).alias("order"), F.col(key).alias("id"))
    d = cut(marked.select("size", "pattern", "order", "id"))
    totals = cut(d.groupBy("pattern").agg(F.sum("size").alias("words")))
    if (n := totals.count()) > most_patterns:
        raise ValueError(f"{n} membership patterns, but most_patterns is {most_patterns}: join sources or raise it")
    found = sorted(((r["pattern"] or [], int(r["words"])) for r in totals.collect()), key=lambda x: [_name(m) for m in x[0]])
    held: dict[tuple, int] = {}
    for p, w in found:
        for m in p:
            held[_name(m)] = held.get(_name(m), 0) + w
    names = sorted(held)
    at = {x: i for i, x in enumerate(names)}
    goal = targets([held[x] for x in names])
    flow = route([(w, tuple(at[_name(m)] for m in p)) for p, w in found], [int(q) for q in goal], copies)
    gives = [0] * len(found)
    for (i, _, _), v in flow.items():
        gives[i] += v
    whole = [g // w if w else 0 for g, (_, w) in zip(gives, found)]
    room = [g % w if w else 0 for g, (_, w) in zip(gives, found)]
    after, rounds, extra = [None] * len(found), [[] for _ in found], [None] * len(found)
    place = T.StructType([d.schema[c] for c in ("order", "id", "size")])
    took = T.ArrayType(T.StructType([T.StructField("room", T.LongType()), T.StructField("after", place), T.StructField("next", place)]))
    schema = T.StructType([d.schema["pattern"], T.StructField("room", T.LongType()), T.StructField("after", place), T.StructField("rounds", took)])
    where = {tuple(map(_name, p)): i for i, (p, _) in enumerate(found)}
    table_of = lambda which: docs.sparkSession.createDataFrame([(found[i][0], room[i], after[i], rounds[i]) for i in which], schema)
    missing = lambda i: room[i] > near * found[i][1]
    open_ = list(filter(missing, range(len(found))))
    while open_:
        rows = {where[tuple(map(_name, r["pattern"]))]: r for r in _next_round(d, table_of(open_)).collect()}
        for i, r in rows.items():
            rounds[i].append((room[i], after[i], r["next"]))
            room[i] -= int(r["taken"])
            after[i] = r["next"]
        open_ = [i for i in open_ if i in rows and after[i] is not None and missing(i)]
    short = list(filter(missing, range(len(found))))
    if short:  # what is left is longer than the room: the one whose size is nearest, if that is nearer than nothing
        left = d.join(F.broadcast(table_of(short)), "pattern").where((F.col("size") > 0) & (F.col("size") < 2 * F.col("room")) & ~_taken())
        left = left.groupBy("pattern", "room", _place().alias("place")).agg(F.sum("size").alias("words"))
        off = F.abs(F.col("words") - F.col("room"))
        for r in left.where(off < F.col("room")).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "place"))["place"].alias("place")).collect():
            extra[where[tuple(map(_name, r["pattern"]))]] = r["place"]
    schema = T.StructType([d.schema["pattern"], T.StructField("whole", T.LongType()), T.StructField("rounds", took), T.StructField("extra", place)])
    plan = docs.sparkSession.createDataFrame([(found[i][0], whole[i], rounds[i], extra[i]) for i in range(len(found))], schema)
    plan = plan.withColumnsRenamed({"pattern": "p"})
    out = marked.join(F.broadcast(plan), F.coalesce("pattern", F.array().cast(d.schema["pattern"].dataType)) == F.col("p"), "left")
    more = F.coalesce(_taken(), F.lit(False)) | F.coalesce(_place().eqNullSafe(F.col("extra")) & F.col("extra").isNotNull(), F.lit(False))
    taken = F.col("size") * (F.coalesce("whole", F.lit(0)) + more.cast("long"))
    out = out.select("row", "size", F.transform("pattern", lambda x: x["name"]).alias("pattern"), taken.cast("long").alias("taken"))
    return out, [(None if x[0] else x[1], held[x], float(t)) for x, t in zip(names, goal)]


def mix_sources(docs: DataFrame, members: Column, size: Column, targets, seed: int = 1, key: str = "doc_id", copies: int = 2, most_patterns: int = 100_000, near: float = 0.005) -> DataFrame:
    """docs with `size`, `pattern` (sorted sources), `taken` (words, repeats counted), which replace columns of their names.

    members: the sources of a row as an array (null elements are a source; a null or empty array is in none and gives nothing).
    targets: function from the sizes of the sources, in code point order with null last, to their targets. Documents are
    aggregated by membership pattern; the flow says how many words each pattern gives. Whole passes take every document of
    the pattern; the rest takes documents in a seeded order, passing over those that do not fit, until less than the share
    `near` of the pattern is missing or nothing fits, and then the one document nearest to what is missing. Order depends on
    key, size and seed alone, so reruns agree; equal rows are taken alike. Empty tables give no rows, empty texts take nothing.

    No task holds more than a millionth of a pattern's order. Patterns and sources, not documents, reach the driver and are
    broadcast back: `most_patterns` bounds them, and more raise an error.
    """
    out, _ = _mix(docs, members, size, targets, seed, key, copies, most_patterns, near)
    return unpacked(docs, out, size=F.col("size"), pattern=F.col("pattern"), taken=F.col("taken"))


def by_weight(weights=(5, 2, 1), share: float = 1.5, most: float = 2.0):
    """Targets of sources in code point order (null last) under repeating weights."""
    return lambda sizes: water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)


def mix_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with size, source_size, target (its source's) and taken under the default weights, each in its one source."""
    out, sources = _mix(docs, F.array("source"), word_count(), by_weight(), seed, "doc_id", 2, 100_000, 0.005)
    by = docs.sparkSession.createDataFrame(sources, "s string, source_size long, target double")
    out = out.join(F.broadcast(by), F.col("pattern")[0].eqNullSafe(F.col("s")), "left")
    return unpacked(docs, out, **{c: F.col(c) for c in ("size", "source_size", "target", "taken")})


def query(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_documents(d).select("doc_id", "size", "source_size", "target", "taken")
