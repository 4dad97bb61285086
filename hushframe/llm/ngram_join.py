"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, grams, packed, shingle_set, table, tidy, unpacked
from .components import components
from .hashing import slices, word_hashes

#: Fragments of the order in which overlaps are counted apart.
FRAGMENTS = 4
#: Shingles whose local counts meet in one piece of memory, the least local count that is told, and the least sum of told ones
#: of a frequent shingle. In C pieces, one of D documents is told about D * D / C times, so D is found from about sqrt(OFTEN * C).
CHUNK, TELL, OFTEN = 2_000_000, 2, 6
#: Most shingles that the order puts last as frequent; any choice gives the same links.
MOST_FREQUENT = 1 << 19
#: Bits of the filters of documents: those whose sets are looked up, and those that a list names.
SLOTS = 1 << 25
#: Longest posting list whose pairs are all formed at once.
SHORT = 24
#: Longest list whose pairs are joined in the exact step; sets and shingles of a block in which those of larger ones meet.
BIG, BLOCK_SETS, BLOCK_SHINGLES = 128, 512, 500_000


def _prefix_length(n: int, percent: int) -> int:
    """Any set that is `percent` similar shares one of the first so many shingles, in any order common to all sets."""
    return n - -(-percent * n // 100) + 1


def _sets(batch: pa.RecordBatch, k: int):
    """(doc_id, sorted shingle hashes) of each row."""
    for part in slices(batch):
        h, bounds = word_hashes(part.column("text"))
        all_grams = grams(h, k)
        for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            yield doc, np.unique(all_grams[a : b - k + 1]) if b - a >= k else shingle_set(h[a:b], k)


def _finger(s: np.ndarray) -> tuple[int, int]:
    """Two 63-bit fingerprints of a set."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return d & (2**63 - 1), d >> 65


def signatures(docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid, check) of every row, and (h, df) of frequent shingles.

    sid identifies a set; equal sets share it. With 63 bits, n distinct sets collide in n*n/2**64 pairs, as many as one at four
    billion sets; `check` has further bits, which similar_sets() compares, so a collision is an error and no link. Counts of
    shingles come from all documents: a chunk of two million shingles tells those that it holds twice.
    """

    def run(batches):
        held, size = [], 0

        def told():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= TELL], c[c >= TELL]
            empty = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=names)

        names = ["doc_id", "n", "sid", "check", "h", "df"]
        for b in batches:
            rows = []
            for doc, s in _sets(b, k):
                sid, check = _finger(s)
                rows.append((doc, len(s), sid, check))
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield told()
                    held, size = [], 0
            cols = list(zip(*rows)) or [()] * 4
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], none, none], names=names)
        if held:
            yield told()

    out = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sid long, check long, h long, df long"))
    frequent = out.where("h IS NOT NULL").groupBy("h").agg(F.sum("df").alias("df")).where(F.col("df") >= OFTEN)
    return out.where("sid IS NOT NULL").select("doc_id", "n", "sid", "check"), frequent


def _postings(docs: DataFrame, held, percent: int, k: int) -> DataFrame:
    """(h, sid, n, hot): the prefix of each set, rare shingles first, each order by hash. held: the frequent ones, broadcast."""

    def run(batches):
        often, seen = held.value, {}
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                hs, sids, ns, hots = [], [], [], []
                for _, s in _sets(b.slice(at, 1000), k):
                    if not len(s):
                        continue
                    sid = _finger(s)[0]
                    if sid in seen:  # an equal set of this task has told its prefix
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen[sid] = None
                    p = _prefix_length(len(s), percent)
                    hot = _hot(s, often)
                    order = np.concatenate([np.flatnonzero(~hot)[:p], np.flatnonzero(hot)[: max(0, p - int((~hot).sum()))]])
                    hs.append(s[order].view(np.int64))
                    hots.append(hot[order])
                    sids.append(np.full(len(order), sid, np.int64))
                    ns.append(np.full(len(order), len(s), np.int32))
                cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else [], t)
                yield pa.RecordBatch.from_arrays([cat(hs, pa.int64()), cat(sids, pa.int64()), cat(ns, pa.int32()), cat(hots, pa.bool_())], names=["h", "sid", "n", "hot"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, sid long, n int, hot boolean")


def _list_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Streams posting lists in order of (h, n, sid): all pairs (a, b) of near sizes of short lists, the rows of long ones.

    Memory holds one short list. Pairs have h null and the sizes n and m of a and b; rows of long lists have b and m null.
    """
    names = ["h", "a", "b", "n", "m"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def pairs(rows):
        for j in range(1, len(rows)):
            for i in range(j - 1, -1, -1):
                if 100 * rows[i][1] < percent * rows[j][1]:
                    break
                (a, n), (b, m) = sorted((rows[i], rows[j]))
                yield None, a, b, n, m

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)], names=names)

    def run(batches):
        now, rows, last, long, out = None, [], None, False, []
        for batch in batches:
            for h, sid, n in zip(*[batch.column(c).to_pylist() for c in ("h", "sid", "n")]):
                if h != now:
                    if not long:
                        out.extend(pairs(rows))
                    now, rows, last, long = h, [], None, False
                if sid == last:
                    continue
                last = sid
                if long:
                    out.append((h, sid, None, n, None))
                else:
                    rows.append((sid, n))
                    if len(rows) > SHORT:
                        out.extend((h, s, None, m, None) for s, m in rows)
                        rows, long = [], True
            yield told(out)
            out = []
        if not long:
            yield told(list(pairs(rows)))

    return postings.repartition("h").sortWithinPartitions("h", "n", "sid").select("h", "sid", "n").mapInArrow(run, "h long, a long, b long, n int, m int")


def _ceil(x, y: int):
    return F.floor((x + (y - 1)) / y)


def _least_common(percent: int, n=None, m=None):
    """Common shingles that the prefixes of similar sets of n and m shingles have at least.

    Up to where the first of two prefixes ends, both tell all common shingles; behind it, no more than the rest of that set can
    be common. So it is the least overlap less the longest rest.
    """
    n, m = F.col("n") if n is None else n, F.col("m") if m is None else m
    return _ceil(percent * (n + m), 100 + percent) - _ceil(percent * F.greatest(n, m), 100) + 1


def _with_longs(pairs: DataFrame, longs: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m, c) with c grown by the shingles that both sets have in long lists, `longs` (sid, hs)."""
    side = lambda x: longs.select(F.col("sid").alias(x), F.col("hs").alias(f"h{x}"))
    d = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return d.withColumn("c", F.col("c") + F.coalesce(F.size(F.array_intersect("ha", "hb")), F.lit(0)))


def _hot(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which of a set's hashes are frequent."""
    return often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s if len(often) else np.zeros(len(s), bool)


def _slot(x: Column) -> Column:
    """An id's bit in a filter, as in _marked."""
    return x.bitwiseXOR(F.shiftrightunsigned(x, 25)).bitwiseAND(F.lit(SLOTS - 1).cast("long"))


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of SLOTS bits with the slots of all ids of the column doc_id set."""
    slots = ids.where("doc_id IS NOT NULL").select((_slot(F.col("doc_id")) + 1).alias("s"))
    parts = slots.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    marks = np.zeros(SLOTS // 8, np.uint8)
    for bucket, bits in parts.collect():
        part = np.frombuffer(bits, np.uint8)
        marks[(bucket - 1) * len(part) : bucket * len(part)] = part[: max(0, len(marks) - (bucket - 1) * len(part))]
    return marks


def _marked(ids: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Which ids, none of them null, have their slot set: all that were marked and a few others."""
    x = ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    slot = (x ^ (x >> np.uint64(25))) & np.uint64(8 * len(marks) - 1)
    return (marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _segments(docs: DataFrame, needed: DataFrame, often, k: int) -> DataFrame:
    """(sid, n, head, tail): the sets of the needed (doc_id, sid), cut into FRAGMENTS of the order of shingles that also gives
    the prefixes: ranges of the hashes of rare ones, the first of them apart, and the frequent ones last.

    A filter of bounded size picks the documents, so no text is shuffled; it may let a few more through. Partitioned by sid
    once and written, so that later joins move pairs only. A repeated doc_id, or a copy that the filter lets through, may
    repeat a row. A needed set without a doc_id is looked up by its sid among the rows that have none.
    """
    spark = docs.sparkSession
    needed = cut(needed)
    marks = spark.sparkContext.broadcast(_marks(needed))

    def picked(batches):
        for b in batches:
            yield from run([b.filter(pa.array(_marked(b.column("doc_id"), marks.value)))])

    def run(batches):
        frequent = often.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = []
                for _, s in _sets(b.slice(at, 500), k):
                    hot = _hot(s, frequent)
                    rare = s[~hot]
                    bounds = np.array([(i << 64) // (FRAGMENTS - 1) for i in range(1, FRAGMENTS - 1)], np.uint64)
                    first, *rest = np.split(rare.view(np.int64), np.searchsorted(rare, bounds))
                    rows.append((_finger(s)[0], len(s), first, [*rest, s[hot].view(np.int64)]))
                cols = list(zip(*rows)) or [()] * 4
                types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["sid", "n", "head", "tail"])

    shape = "sid long, n int, head array<long>, tail array<array<long>>"
    bare = docs.where("doc_id IS NULL").select("doc_id", "text").mapInArrow(run, shape)
    bare = bare.join(needed.where("doc_id IS NULL").select("sid"), "sid", "left_semi").dropDuplicates(["sid"])
    made = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(picked, shape).unionByName(bare)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan would not tell that its rows lie by sid
    try:
        return cut(made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sid"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _meet(pairs: DataFrame, segments: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the sizes na and nb and a fragment column of both, xa and xb."""
    side = lambda s: segments.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col(column).alias(f"x{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _verify(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared) of the pairs whose partial overlaps, counted apart for each fragment of the order, sum to the similarity.

    The first fragment goes first; pairs that could not reach it even if all the rest were common end there.
    """
    head = _meet(pairs.select("a", "b"), segments, "head")
    c = F.size(F.array_intersect("xa", "xb"))
    reach = c + F.least(F.col("na") - F.size("xa"), F.col("nb") - F.size("xb"))
    enough = lambda shared: (100 + percent) * shared >= percent * (F.col("na") + F.col("nb"))
    head = head.select("a", "b", c.alias("c"), (enough(reach)).alias("open"))
    open_ = cut(head.where("open").groupBy("a", "b").agg(F.max("c").alias("c")))
    tail = _meet(open_, segments, "tail").select("a", "b", "c", "na", "nb", F.posexplode(F.arrays_zip("xa", "xb")).alias("fragment", "x"))
    part = F.size(F.array_intersect("x.xa", "x.xb"))
    # a set may be there twice, where a doc_id repeats: its fragments have equal counts
    partial = tail.groupBy("a", "b", "c", "na", "nb", "fragment").agg(F.max(part).alias("part"))
    return partial.groupBy("a", "b", "c", "na", "nb").agg((F.col("c") + F.sum("part")).alias("shared")).where(enough(F.col("shared"))).select("a", "b", "shared")


def _prefixes(docs: DataFrame, percent: int, k: int):
    """Rows (doc_id, n, sid), the postings of all prefixes, and a function from sids to the segments of their sets."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, frequent = signatures(d, k)
    top = frequent.orderBy(F.desc("df"), "h").limit(MOST_FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64)
    top = d.sparkSession.sparkContext.broadcast(np.sort(top.view(np.uint64)))
    postings = _postings(d, top, percent, k)
    one_set = F.assert_true(F.col("lo") == F.col("hi"), F.lit("two sets share a 63-bit identity"))
    owners = rows.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("lo"), F.max("check").alias("hi")).where(one_set.isNull())
    of = lambda sids: _segments(d, owners.join(sids.distinct(), "sid", "left_semi").select("sid", "doc_id"), top, k)
    return rows, postings, of


def similar_sets(docs: DataFrame, percent: int = 80, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of every row, and (sid, component) of the sets that are linked to another set.

    Links are Jaccard similarities of at least `percent` between sets of k-word shingles (A-Z lower-cased; fewer words make
    one shingle; no words, no links). Equal sets are one. The order of shingles is by hash with frequent ones last; a set's
    prefix in it must meet the prefix of every similar set. Short posting lists give all their pairs of near sizes; pairs with
    too few common shingles in their prefixes end there. Of longer lists, pairs that components still separate count their common
    shingles; sets of very long ones are compared with one set of each list, and those that are still apart meet in blocks, where
    pairs make no rows. Overlaps of candidates are counted for each
    fragment of the order and summed. Links inside a component are not looked for; none between components is missed.
    """
    rows, postings, of = _prefixes(docs, percent, k)
    hot = postings.where("hot").groupBy("h", "sid").agg(F.first("n").alias("n"))
    none = lambda t: F.lit(None).cast(t)
    lists = cut(_list_pairs(postings.where("NOT hot"), percent).unionByName(hot.select("h", F.col("sid").alias("a"), none("long").alias("b"), "n", none("int").alias("m"))))
    enough = F.col("c") >= _least_common(percent)
    long = lists.where("b IS NULL").select("h", F.col("a").alias("sid"), "n")
    longs = cut(long.groupBy("sid").agg(F.collect_set("h").alias("hs")))
    near = lists.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    near = cut(_with_longs(near, longs).where(enough).select("a", "b"))
    sizes = cut(long.groupBy("h").agg(F.count("*").alias("size")))
    big = cut(long.join(sizes.where(F.col("size") > BIG), "h").groupBy("sid").agg(F.first("n").alias("n")))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    labels = cut(ends(near).unionByName(long.select("sid")).distinct().select(F.col("sid").alias("node"), F.col("sid").alias("component")))
    named = lambda df: df.join(labels.select(F.col("node").alias("sid"), "component"), "sid")

    def join(links: DataFrame) -> DataFrame:
        """Labels with one component where links (a, b) between sets join several."""
        tag = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        new = components(cut(links.join(tag("a"), "a").join(tag("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        to = new.select(F.col("node").alias("component"), F.col("component").alias("to"))
        return cut(labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")))

    segments = of(ends(near).unionByName(big.select("sid")))
    labels = join(_verify(near, segments, percent).select("a", "b"))
    # a pair without common shingles in short lists has them in long ones only: sets of lists over BIG are compared with two of
    # each list, which gathers most, then those of lists that hold several components meet in blocks; in the other lists each
    # pair that components still separate counts what it has in common
    crowded = cut(long.join(sizes.where(F.col("size") > BIG).select("h"), "h").join(longs.select("sid", F.size("hs").alias("longs")), "sid"))
    pairs = cut(_pivot_pairs(crowded, labels, percent, True).unionByName(_pivot_pairs(crowded, labels, percent, False)).distinct())
    if not pairs.isEmpty():
        labels = join(_verify(pairs, segments, percent).select("a", "b"))
    # two sets that are still apart and share a list make that list hold two components: only sets of such lists go on
    open_ = named(crowded).groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    big = cut(named(crowded.join(open_, "h", "left_semi").groupBy("sid").agg(F.first("n").alias("n"))))
    if not big.isEmpty():
        labels = join(_block_links(big, segments, percent))
    apart = named(long.join(sizes.where(F.col("size") <= BIG), "h")).join(longs.select("sid", F.size("hs").alias("longs")), "sid")
    mixed = cut(apart.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h"))
    apart = cut(apart.join(mixed, "h"))
    x, y = apart.alias("x"), apart.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    fits = (100 * n >= percent * m) & (100 * m >= percent * n) & (F.least("x.longs", "y.longs") >= _least_common(percent, n, m))
    cross = x.join(y, "h").where((F.col("x.component") != F.col("y.component")) & (F.col("x.sid") < F.col("y.sid")) & fits)
    cross = cross.groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).agg(F.count("*").alias("c"), F.first("x.n").alias("n"), F.first("y.n").alias("m"))
    cross = cut(cross.where(enough).select("a", "b"))
    if not cross.isEmpty():
        links = _verify(cross, of(ends(cross)), percent)
        labels = join(links.select("a", "b"))
    return rows, labels.select(F.col("node").alias("sid"), "component")


def _pivot_pairs(lists: DataFrame, labels: DataFrame, percent: int, least: bool) -> DataFrame:
    """(a, b): in each list (h, sid, n, longs), its least (or greatest) set with those of other components that it may be similar
    to: of near sizes, and both in enough long lists, as pairs that share a short one have been compared."""
    named = lists.join(labels.select(F.col("node").alias("sid"), "component"), "sid")
    one = F.struct("sid", "n", "component", "longs")
    pivot = named.groupBy("h").agg((F.min(one) if least else F.max(one)).alias("p"))
    d = named.join(pivot, "h").where((F.col("p.component") != F.col("component")) & (100 * F.col("n") >= percent * F.col("p.n")) & (100 * F.col("p.n") >= percent * F.col("n")))
    d = d.where(F.least("longs", "p.longs") >= _least_common(percent, F.col("n"), F.col("p.n")))
    return d.select(F.least("sid", "p.sid").alias("a"), F.greatest("sid", "p.sid").alias("b")).distinct()


def _block_links(sets: DataFrame, segments: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """(a, b): links that join the components of the given (sid, n, component) as similar pairs do; if `every`, all similar
    pairs with a < b and the shingles that they share.

    Sets go to size bands and inside them to blocks of bounded sets and shingles; a task holds two blocks of one band or of
    neighbouring ones, counts overlaps shingle by shingle and tells at most one link for each component in it, never the
    pairs. A large component has blocks of its own, which meet those of all others but not one another, so a component that
    holds nearly all sets of a band is moved as often as the rest has blocks, not as often as it has blocks itself.
    """
    spark = sets.sparkSession
    banded = sets.withColumn("g", F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int"))
    per = banded.groupBy("g", "component").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    large = (2 * F.col("k") > BLOCK_SETS) | (2 * F.col("s") > BLOCK_SHINGLES)
    per = per.groupBy("g", F.when(large, F.col("component")).alias("owner")).agg(F.sum("k").alias("k"), F.sum("s").alias("s")).collect()
    if not per:
        return sets.select(F.col("component").alias("a"), F.col("component").alias("b"), *([F.lit(0).cast("long").alias("shared")] if every else []))
    # blocks of each band, numbered: those of the pool first, then of each large component
    groups, blocks, used = [], [], {}
    for r in sorted(per, key=lambda r: (r["g"], r["owner"] is not None, r["owner"] or 0)):
        width, first = max(1, -(-r["k"] // BLOCK_SETS), -(-r["s"] // BLOCK_SHINGLES)), used.get(r["g"], 0)
        groups.append((r["g"], r["owner"], first, width))
        blocks += [(r["g"], first + j, r["owner"]) for j in range(width)]
        used[r["g"]] = first + width
    groups = spark.createDataFrame(groups, "g int, owner long, first int, width int")
    x, y = (spark.createDataFrame(blocks, f"g{c} int, j{c} int, owner{c} long") for c in "xy")
    meet = x.join(y, F.col("gx") == F.col("gy")).where("jx <= jy").unionByName(x.join(y, F.col("gx") + 1 == F.col("gy")))
    meet = meet.where(F.col("ownerx").isNull() | F.col("ownery").isNull() | (F.col("ownerx") != F.col("ownery")))
    same = (F.col("gx") == F.col("gy")) & (F.col("jx") == F.col("jy"))
    end = lambda c, side: F.struct(F.col(f"g{c}").alias("g"), F.col(f"j{c}").alias("j"), side.alias("side"))
    ends = F.when(same, F.array(end("x", F.lit(2)))).otherwise(F.array(end("x", F.lit(0)), end("y", F.lit(1))))
    goes = meet.select(F.concat_ws(":", "gx", "jx", "gy", "jy").alias("key"), F.explode(ends).alias("to")).select("key", F.col("to.g").alias("to_g"), F.col("to.j").alias("to_j"), "to.side")
    own = groups.where("owner IS NOT NULL").select(F.col("g").alias("own_g"), "owner", F.col("first").alias("own_first"), F.col("width").alias("own_width"))
    pool = groups.where("owner IS NULL").select(F.col("g").alias("pool_g"), F.col("first").alias("pool_first"), F.col("width").alias("pool_width"))
    placed = banded.join(own, (F.col("g") == F.col("own_g")) & (F.col("component") == F.col("owner")), "left").join(pool, F.col("g") == F.col("pool_g"), "left")
    spot = F.coalesce("own_first", "pool_first") + F.pmod(F.xxhash64("sid"), F.coalesce("own_width", "pool_width")).cast("int")
    whole = segments.select("sid", F.concat("head", F.flatten("tail")).alias("hashes"))
    placed = placed.select("sid", "n", "component", "g", spot.alias("j")).join(goes, (F.col("g") == F.col("to_g")) & (F.col("j") == F.col("to_j")))
    placed = placed.join(whole, "sid").select("sid", "n", "component", "hashes", "key", "side")

    def run(key, table):
        del key
        rows = list(zip(*[table.column(c).to_pylist() for c in ("sid", "n", "component", "side")]))
        hashes = table.column("hashes").combine_chunks()
        at, values = np.asarray(hashes.offsets), np.asarray(hashes.values)
        sides = [[i for i, r in enumerate(rows) if r[3] in (s, 2)] for s in (0, 1)]
        flat = []
        for side in sides:
            v = np.concatenate([values[at[i] : at[i + 1]] for i in side]) if side else np.empty(0, np.int64)
            r = np.repeat(np.arange(len(side)), [at[i + 1] - at[i] for i in side])
            order = np.argsort(v, kind="stable")
            flat.append((v[order], r[order]))
        (va, ra), (vb, rb) = flat
        both = np.intersect1d(va, vb)
        counts = np.zeros((len(sides[0]), len(sides[1])), np.int32)
        bounds = [np.searchsorted(x, both, side=s) for x in (va, vb) for s in ("left", "right")]
        for a0, a1, b0, b1 in zip(*[x.tolist() for x in bounds]):
            counts[np.ix_(ra[a0:a1], rb[b0:b1])] += 1
        n = [np.array([rows[i][1] for i in side], np.int64) for side in sides]
        c = [np.array([rows[i][2] for i in side], np.int64) for side in sides]
        names, where = np.unique(np.concatenate(c), return_inverse=True)
        wa, wb = where[: len(c[0])], where[len(c[0]) :]
        label = np.arange(len(names))
        if counts.size:
            linked = (100 + percent) * counts.astype(np.int64) >= percent * (n[0][:, None] + n[1][None, :])
            if every:
                i, j = np.nonzero(linked)
                ids = [np.array([rows[x][0] for x in side], np.int64) for side in sides]
                a, b = np.minimum(ids[0][i], ids[1][j]), np.maximum(ids[0][i], ids[1][j])
                new = a < b
                return pa.table({"a": a[new], "b": b[new], "shared": counts[i, j][new].astype(np.int64)})
            while True:  # the least label of all that links reach
                la, lb, new = label[wa], label[wb], label.copy()
                np.minimum.at(new, wb, np.where(linked, la[:, None], len(names)).min(axis=0))
                np.minimum.at(new, wa, np.where(linked, lb[None, :], len(names)).min(axis=1))
                if (new == label).all():
                    break
                label = new
        if every:
            return pa.table({c: np.empty(0, np.int64) for c in ("a", "b", "shared")})
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[label[moved]]})

    return placed.groupBy("key").applyInArrow(run, "a long, b long, shared long" if every else "a long, b long").distinct()


def links(docs: DataFrame, percent: int = 80, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of every row, and (a, b, shared): each link between two different sets once, a < b.

    Sets whose prefixes share a shingle of at most BIG sets are paired and verified by fragments; those of more frequent ones
    meet in blocks, where similar pairs alone become rows. Equal sets have one sid; their copies are not expanded. Null and
    empty texts have no links. The blocks' shuffle grows with the sets of frequent shingles in a size band times their blocks.
    """
    with tidy(docs.sparkSession):
        rows, postings, of = _prefixes(docs, percent, k)
        lists = cut(postings.groupBy("h", "sid").agg(F.first("n").alias("n")))
        sizes = cut(lists.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"))
        short = lists.join(sizes.where(F.col("size") <= BIG).select("h"), "h")
        near = (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
        pairs = short.alias("x").join(short.alias("y"), "h").where((F.col("x.sid") < F.col("y.sid")) & near)
        pairs = cut(pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct())
        big = cut(lists.join(sizes.where(F.col("size") > BIG).select("h"), "h").groupBy("sid").agg(F.first("n").alias("n")))
        segments = of(pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(big.select("sid")))
        found = _verify(pairs, segments, percent)
        if not big.isEmpty():
            found = found.unionByName(_block_links(big.withColumn("component", F.col("sid")), segments, percent, True))
        return cut(rows.select("doc_id", "n", "sid")), cut(found.select("a", "b", F.col("shared").cast("long").alias("shared")).distinct())


def link_counts(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, n_links): for each row, how many other rows it is linked with, copies of its own text included.

    Rows without words have none; rows that repeat a doc_id, and those with a null one, count as rows of their own.
    """
    rows, pairs = links(docs, percent, k)
    size = rows.where("n > 0").groupBy("sid").agg(F.count("*").alias("rows"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(size.select(F.col("sid").alias("b"), "rows"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("rows").alias("others"))
    d = rows.join(size, "sid", "left").join(others, "sid", "left")
    count = F.coalesce(F.col("rows") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))
    return d.select("doc_id", F.col("n").alias("n_shingles"), count.cast("long").alias("n_links"))


def classes(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): for each row, the size of its set and the least doc_id that links reach from it.

    Rows without words are linked with nothing; a null doc_id reaches the least id of its class; repeated ids repeat rows.
    """
    with tidy(docs.sparkSession):
        rows, linked = similar_sets(docs, percent, k)
        d = rows.join(linked, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "sid").alias("_c"))
        d = cut(d)
        least = cut(d.where("n_shingles > 0").groupBy("_c").agg(F.min("doc_id").alias("_least")).select(F.col("_c").alias("_k"), "_least"))
    d = d.join(least, (F.col("_c") == F.col("_k")) & (F.col("n_shingles") > 0), "left")
    return d.select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids (one column, doc_id); rows with a null one stay.

    A filter of SLOTS bits, broadcast as words of 64 bits, lets all rows pass that no listed id can be; only the others, those
    listed and a few more, are shuffled to be compared in full. docs are read twice.
    """
    at = _slot(F.col("id"))
    word, bit = F.shiftrightunsigned(at, 6), at.bitwiseAND(F.lit(63).cast("long")).cast("int")
    ids = ids.select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    filter_ = F.broadcast(ids.groupBy(word.alias("word")).agg(F.bit_or(set_bit).alias("bits")))
    d = docs.select(packed(docs), F.col("doc_id").cast("long").alias("id"))
    d = d.join(filter_, word == F.col("word"), "left").select("row", "id", F.coalesce(F.getbit("bits", bit) == 1, F.lit(False)).alias("maybe"))
    kept = d.where("NOT maybe").select("row").unionByName(d.where("maybe").join(ids, "id", "left_anti").select("row"))
    return unpacked(docs, kept)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') || least(len(ws), 5)) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""
