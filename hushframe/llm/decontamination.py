"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, grams, packed, split_words, table, tidy, unpacked
from .hashing import slices, word_hashes

K = 5
#: Bits of the prefilter for each shingle of the benchmark, and the most bits it may have (as a power of two): 32 MB.
BITS_EACH, MOST_BITS = 4096, 28
#: Contaminated texts up to this number are told to all tasks (8 bytes each); beyond it documents are joined with them.
MOST_TOLD = 1 << 22


def sketch_size(n: int, percent: int) -> int:
    """Bottom-k size of an item of n shingles: one more than may be missing, so a containing document must hold one."""
    return n - -(-percent * n // 100) + 1


def items_of(benchmark: DataFrame, percent: int, text: str = "text") -> DataFrame:
    """(iid, item_id, k, n, hashes, shingles, sketch) of each benchmark row with words.

    shingles: the distinct runs of k words (five, or all of a shorter item), joined by a blank, and their 64-bit hashes;
    sketch: the shingles of the least hashes, more for larger items, as many as make any containing document hold one.
    """
    schema = "item_id long, k int, n int, hashes array<long>, shingles array<string>, sketch array<string>"

    def run(batches):
        for b in batches:
            for part in slices(b):
                rows = []
                h, bounds = word_hashes(part.column("text"))
                for item, t, x, y in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    if x == y:
                        continue
                    k = min(K, y - x)
                    g, first = np.unique(grams(h[x:y], k), return_index=True)
                    words = split_words(t)
                    names = [b" ".join(words[i : i + k]).decode("utf-8", "replace") for i in first.tolist()]
                    rows.append((item, k, len(g), g.view(np.int64), names, names[: sketch_size(len(g), percent)]))
                cols = list(zip(*rows)) or [()] * 6
                types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item_id", "k", "n", "hashes", "shingles", "sketch"])

    made = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)
    return cut(made.withColumn("iid", F.monotonically_increasing_id()))


def prefilter(items: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """(bitmap, bits, shingle lengths): which hashes any shingle of the benchmark may have. At most 2**MOST_BITS bits."""
    total, ks = items.agg(F.sum("n"), F.sort_array(F.collect_set("k"))).first()
    bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(BITS_EACH * max(1, total or 0))))))
    slots = items.select(F.explode("hashes").alias("h")).select(F.shiftrightunsigned("h", 64 - bits).alias("slot"))
    ones = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[ones["word"].to_numpy(np.int64)] = ones["bit"].to_numpy(np.int64).view(np.uint64)
    return bitmap, bits, ks or []


def document_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(uid, doc_id, tid, hits): the documents that may hold a shingle of the benchmark, and those shingles, in one scan.

    hits: distinct shingles of the documents' own words that pass the prefilter; tid: hash of the text.
    """
    bitmap, bits, ks = prefilter(items)
    held = docs.sparkSession.sparkContext.broadcast(bitmap)
    shift = np.uint64(64 - bits)

    def run(batches):
        known = held.value
        for b in batches:
            for part in slices(b):
                h, bounds = word_hashes(part.column("text"))
                found = {}
                for k in ks:
                    g = grams(h, k) >> shift
                    at = np.flatnonzero((known[g >> np.uint64(6)] >> (g & np.uint64(63))) & np.uint64(1))
                    row = np.searchsorted(bounds, at, side="right") - 1
                    inside = at + k <= bounds[row + 1]
                    for r, i in zip(row[inside].tolist(), (at - bounds[row])[inside].tolist()):
                        found.setdefault(r, []).append((i, k))
                docs_, tids, hits = [], [], []
                for r, places in found.items():
                    words = split_words(part.column("text")[r].as_py())
                    docs_.append(part.column("doc_id")[r].as_py())
                    tids.append(part.column("tid")[r].as_py())
                    hits.append(list({b" ".join(words[i : i + k]).decode("utf-8", "replace") for i, k in places}))
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(tids, pa.int64()), pa.array(hits, pa.list_(pa.string()))], names=["doc_id", "tid", "hits"])

    return docs.select("doc_id", "tid", "text").mapInArrow(run, "doc_id long, tid long, hits array<string>").withColumn("uid", F.monotonically_increasing_id())


def _marked(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("tid"), t.alias("text"))


def _contained(docs: DataFrame, benchmark: DataFrame, percent: int, text: str) -> DataFrame:
    """(doc_id, tid, item_id, n_shingles, n_shared), checkpointed.

    Sketches of all items, spread over tasks by shingle, meet the documents' hits; only items of sizes that the number of a
    document's hits can fill go on (that is the size partition), and each (document, item) is verified on the words of all
    shingles that both hold.
    """
    with tidy(docs.sparkSession):
        items = items_of(benchmark, percent)
        hits = cut(document_hits(_marked(docs, text), items))
        sketches = items.select("iid", "n", F.explode("sketch").alias("shingle"))
        posted = hits.select("uid", F.size("hits").alias("n_hits"), F.explode("hits").alias("shingle"))
        pairs = posted.join(sketches, "shingle").where(100 * F.col("n_hits") >= percent * F.col("n")).select("uid", "iid").distinct()
        both = pairs.join(items.select("iid", "item_id", "n", "shingles"), "iid").join(hits, "uid")
        both = both.select("doc_id", "tid", "item_id", F.col("n").alias("n_shingles"), F.size(F.array_intersect("shingles", "hits")).alias("n_shared"))
        return cut(both.where(100 * F.col("n_shared") >= percent * F.col("n_shingles")))


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): items of which a document holds `percent` of the five-word shingles.

    Words are lower-cased in A-Z; items of under five words have one shingle, their whole sequence. Documents are read once; a
    bitmap of bounded size tells which of their shingles may be the benchmark's, and only those go on. An item's sketch is one
    shingle more than may be missing, so no containing document is lost, and counts are of words, not of hashes. Null and
    empty texts match nothing; repeated items or documents repeat their rows; null ids pass through; extra columns are ignored.
    """
    return _contained(docs, benchmark, percent, text).drop("tid")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """docs without the rows whose text contains an item; all columns and all other rows pass as they are.

    Up to MOST_TOLD contaminated texts are broadcast and nothing shuffles; beyond that Spark joins as it sees fit.
    """
    lost = cut(_contained(docs, benchmark, percent, text).select("tid").distinct())
    lost = F.broadcast(lost) if lost.count() <= MOST_TOLD else lost
    d = docs.select(packed(docs), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tid"))
    return unpacked(docs, d.join(lost, "tid", "left_anti"))


def query(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(ws), 5) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda p: array_to_string(ws[p:p + least(len(ws), 5) - 1], ' '))) AS s
      FROM i WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM q),
w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS s
      FROM w, ks WHERE len(ws) >= k),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN q USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, n_shared::INTEGER AS n_shared FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n
"""
