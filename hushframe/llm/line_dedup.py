"""Line dedup over range-partitioned line hashes, with run-length-compressed keep bitmaps as result."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, packed, table, text_of, unpacked


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed_lines(docs: DataFrame, text: str, least_chars: int) -> DataFrame:
    """One row for each line whose key is long enough: two hashes of the key, document, text and position."""
    d = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_of(text).alias("t"))
    d = d.select("doc_id", F.xxhash64("t").alias("text_hash"), F.posexplode(lines_of(F.col("t"))).alias("pos", "line"))
    d = d.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.length("line") >= least_chars)
    key = ascii_lower(F.col("line"))
    return d.select("doc_id", "text_hash", "pos", key.alias("key")).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")


@contextmanager
def _streaming_aggregates(spark):
    """Inside, aggregates over rows that already lie in order of their keys stream instead of building a hash table."""
    name = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def first_occurrences(lines: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, first): each document that holds a key, with the position of its first such line.

    Hashes are range-partitioned together with the document, so a key that most documents hold spreads over tasks, and lie in
    order of key, document and position; the first row of each (key, document) in that order is the one that goes on.
    """
    held = lines.select("h1", "h2", "doc_id", "pos").repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    return held.groupBy("h1", "h2", "doc_id").agg(F.first("pos").alias("first"))


def _runs(at: Column) -> Column:
    """Sorted numbers as (start, length) runs."""
    starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def keep_bitmaps(docs: DataFrame, text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, n_dropped, dropped): the documents that lose lines, and which.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys of at least `least_chars` characters in at
    least `least_docs` documents lose their lines except in the largest doc_id. `dropped` holds the zeros of the keep bitmap
    as sorted (start, length) runs, so a bitmap costs as much as it has runs; keep_runs() turns it round. Documents that keep
    every line have no row, their bitmap is all ones. Rows that repeat a doc_id count as one document; a null doc_id counts as
    none and keeps its lines. Texts are split once; what goes on are hashes, written to the shared folder.
    """
    lines = cut(_keyed_lines(docs, text, least_chars))
    with _streaming_aggregates(docs.sparkSession):
        common = first_occurrences(lines).groupBy("h1", "h2").agg(F.count("first").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs).select("h1", "h2", "last")
        common = cut(common)  # read back, the join deals both its sides anew, so Spark can split a key that most documents hold
    lost = lines.join(common, ["h1", "h2"]).where(F.col("doc_id") < F.col("last")).select("doc_id", "text_hash", "pos")
    found = lost.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return found.select("doc_id", "text_hash", F.size("at").cast("long").alias("n_dropped"), _runs(F.col("at")).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """docs with `text` cut to the kept lines, `n_lines` (before), `n_dropped` and `kept`, the keep bitmap as (start, length)
    runs of kept lines.

    Nulls become one empty line; columns of those names are replaced, all others pass.
    """
    d = docs.select(packed(docs), text_of(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    b = bitmaps.select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("h"), F.col("n_dropped").alias("n"), F.col("dropped").alias("runs"))
    d = d.join(b, (F.col("row").getField("doc_id") == F.col("doc")) & (F.col("hash") == F.col("h")), "left")
    d = d.select("row", "text", "runs", F.coalesce("n", F.lit(0).cast("long")).alias("n_dropped"), lines_of(F.col("text")).alias("lines"))
    runs, lines = F.coalesce("runs", F.array().cast("array<struct<start:int,length:int>>")), F.col("lines")
    # kept runs lie between the dropped ones; each line is touched once
    begin = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["length"]))
    end = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    between = F.zip_with(begin, end, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    d = d.select("row", "text", "lines", "n_dropped", F.filter(between, lambda r: r["length"] > 0).alias("kept"))
    parts = F.flatten(F.transform("kept", lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    cleaned = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(parts, "\n"))
    return unpacked(docs, d, **{text: cleaned, "n_lines": F.size("lines").cast("long"), "n_dropped": F.col("n_dropped"), "kept": F.col("kept")})


def query(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.array_join(F.transform("kept", lambda r: F.concat_ws(":", r["start"].cast("string"), r["length"].cast("string"))), ",")
    return apply_bitmaps(d, keep_bitmaps(d)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), kept.alias("kept_runs"))


SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, pos, line, last IS NOT NULL AND k.doc_id < last AS gone FROM k LEFT JOIN c USING (key)),
i AS (SELECT doc_id, min(pos) - 1 AS start, count(*) AS n FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM j WHERE NOT gone) GROUP BY doc_id, island),
r AS (SELECT doc_id, string_agg(start || ':' || n, ',' ORDER BY start) AS runs FROM i GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256, coalesce(any_value(runs), '') AS kept_runs
FROM j LEFT JOIN r USING (doc_id) GROUP BY doc_id
"""
