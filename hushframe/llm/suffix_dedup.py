"""Suffix-array dedup: passages repeated across documents, from a sparse suffix array at minimiser positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, grams, mix, split_words, table, tidy
from .hashing import slices

#: Words of a key; key groups up to SMALL rows are compared pair by pair, larger ones by their windows.
K, SMALL = 8, 32


def _extreme(h: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each window of w values, from block-wise prefixes and suffixes."""
    op, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, fill, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def minimisers(keys: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least key of some window of w keys.

    Equal windows choose equal keys, wherever they stand. A key equal to the one before it is left out, so a run of one
    word has one position; as windows inside runs then differ in their positions, such keys are compared by windows.
    """
    if len(keys) < w:
        return np.empty(0, np.int64)
    least = _extreme(keys, w, True)
    best = _extreme(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, False)
    chosen = best == keys
    chosen[1:] &= keys[1:] != keys[:-1]
    return np.flatnonzero(chosen)


def _positions(docs: DataFrame, least: int) -> DataFrame:
    """(key, doc_id, tid, pos, run) of each retained suffix; run: the next key is the same, so further positions were left out."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out = [[], [], [], [], []]
                for doc, tid, text in zip(*[part.column(c).to_pylist() for c in ("doc_id", "tid", "text")]):
                    words = split_words(text)
                    if len(words) < least:
                        continue
                    keys = grams(hashes.of(words), K)
                    pos = minimisers(keys, least - K + 1)
                    for o, x in zip(out, (keys[pos].view(np.int64), np.full(len(pos), doc), np.full(len(pos), tid), pos.astype(np.int32), np.append(keys[1:] == keys[:-1], False)[pos])):
                        o.append(x)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, types)], names=["key", "doc_id", "tid", "pos", "run"])

    return docs.mapInArrow(run, "key long, doc_id long, tid long, pos int, run boolean")


def _suffixes(hits: DataFrame, least: int) -> DataFrame:
    """(key, right, doc_id, pos, left): the words around each suffix position that another document may share.

    right: up to `least` word hashes from the position on; left: up to least - K before it, nearest first. Big-endian
    32-bit hashes, so that the order of the bytes is the order of the suffixes.
    """
    back = least - K

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                keys_, rights, docs_, poss, lefts = [], [], [], [], []
                for doc, text, pos in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "pos")]):
                    h = hashes.of(split_words(text))
                    keys = grams(h, K)
                    short = (h >> np.uint64(32)).astype(">u4")
                    turned = short[::-1]
                    n = len(short)
                    for p in sorted(p for p in pos if p >= 0):
                        keys_.append(keys[p])
                        rights.append(short[p : p + least].tobytes())
                        lefts.append(turned[n - p : n - p + back].tobytes())
                        docs_.append(doc)
                        poss.append(p)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys_, np.uint64).view(np.int64)), pa.array(rights, pa.binary()), pa.array(docs_, pa.int64()), pa.array(poss, pa.int32()), pa.array(lefts, pa.binary())], names=NAMES)

    return hits.select("doc_id", "text", "pos").mapInArrow(run, SUFFIX)


NAMES = ["key", "right", "doc_id", "pos", "left"]
SUFFIX = "key long, right binary, doc_id long, pos int, left binary"
SPAN = "doc_id long, start int, end int"


def _common(x: np.ndarray, i: np.ndarray, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j of x."""
    same = x[i] == x[j]
    first = np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))
    return np.minimum(first, np.minimum(sizes[i], sizes[j]))


def _matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) // 4 for r in rows])
    return np.frombuffer(b"".join(r.ljust(4 * width, b"\0") for r in rows), ">u4").reshape(-1, width).astype(np.uint32), sizes


def _matched(rows: list[tuple], least: int):
    """(doc_id, start, end) of what rows of one key share with a row of another document, if that is `least` words.

    rows: (right, doc_id, pos, left), SMALL at most; all pairs are compared.
    """
    n = len(rows)
    right, rs = _matrix([r[0] for r in rows], least)
    left, ls = _matrix([r[3] for r in rows], least - K)
    docs = np.array([r[1] for r in rows])
    i, j = np.triu_indices(n, 1)
    apart = docs[i] != docs[j]
    i, j = i[apart], j[apart]
    r, l = _common(right, i, j, rs), _common(left, i, j, ls)  # noqa: E741
    good = r + l >= least
    i, j, r, l = i[good], j[good], r[good], l[good]  # noqa: E741
    most_r, most_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for x in (i, j):
        np.maximum.at(most_r, x, r)
        np.maximum.at(most_l, x, l)
    for x in np.flatnonzero(most_r):
        yield int(docs[x]), int(rows[x][2] - most_l[x]), int(rows[x][2] + most_r[x])


def _neighbours(suffixes: DataFrame, least: int) -> DataFrame:
    """(doc_id, start, end) from suffixes sorted by key; all rows of a key lie in one partition."""

    def run(batches):
        now, rows, spans = None, [], []

        def close():
            if len(rows) > 1:
                spans.extend(_matched(rows, least))

        def out():
            cols = list(zip(*spans)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "start", "end"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for key, right, doc, pos, left in zip(*[part.column(c).to_pylist() for c in NAMES]):
                    if key != now:
                        close()
                        now, rows = key, []
                    rows.append((right, doc, pos, left))
                yield out()
                spans = []
        close()
        yield out()

    return suffixes.select(*NAMES).mapInArrow(run, SPAN)


def window_hashes(keys: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all runs of `least` words from the keys of K words."""
    n = len(keys) + K - least
    total = np.zeros(n, np.uint64)
    for at in [*range(0, least - K, K), least - K]:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + keys[at : at + n])
    return total


def _windows(texts: DataFrame, least: int) -> DataFrame:
    """(window, doc_id, start, end) of the runs of `least` words whose least key is one of the large ones of hits.

    Equal windows one word apart, as inside a run of one word, are told as one row.
    """

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for part in slices(b):
                out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]]
                for doc, text, pos in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "pos")]):
                    large = np.array([-1 - p for p in pos if p < 0], np.int64)
                    if not len(large):
                        continue
                    keys = grams(hashes.of(split_words(text)), K)
                    at = np.flatnonzero(np.isin(_extreme(keys, least - K + 1, True), keys[large]))
                    h = window_hashes(keys, least)[at]
                    first = np.ones(len(at), bool)
                    first[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
                    last = np.append(first[1:], True)
                    for o, x in zip(out, (h[first].view(np.int64), np.full(int(first.sum()), doc), at[first], at[last] + least)):
                        o.append(x)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), t) for o, t in zip(out, types)], names=["window", "doc_id", "start", "end"])

    return texts.select("doc_id", "text", "pos").mapInArrow(run, "window long, " + SPAN)


def repeated_spans(docs: DataFrame, least: int = 50, text: str = "text") -> DataFrame:
    """(doc_id, spans, n_repeat_words): for each document that has any, the passages of at least `least` words that another
    document has too, as merged [start, end) ranges of words in order.

    Words are lower-cased in A-Z; whole texts count. Equal passages hold equal minimisers (of K-word keys over windows of
    least - K + 1), so suffixes kept at those positions suffice; only keys of two or more documents go on. Keys of up to
    SMALL suffixes are brought together and compared in full: matches extend both ways as far as any window of `least` words
    around the position reaches; longer passages join from their positions. For larger keys, each window of `least` words
    whose least key it is goes by its 64-bit hash, and those of two or more documents count; no key is held in one task.
    Null and short texts have no passages; a null doc_id is no document; rows that repeat a doc_id are one document. Extra
    columns are ignored.
    """
    d = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    positions = _positions(d, least)
    with tidy(docs.sparkSession):
        keys = positions.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), F.max("run").alias("run"))
        shared = cut(keys.where("lo < hi").select("key", ((F.col("n") > SMALL) | F.col("run")).alias("large")))
        at = F.when(F.col("large"), -1 - F.col("pos")).otherwise(F.col("pos"))
        hits = cut(positions.join(shared, "key").groupBy("doc_id", "tid").agg(F.collect_set(at).alias("pos")))
        windows = _windows(d.join(hits.where(F.array_min("pos") < 0), ["doc_id", "tid"]), least)
        held = cut(windows.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("window"))
    suffixes = _suffixes(d.join(hits.where(F.array_max("pos") >= 0), ["doc_id", "tid"]), least).repartition("key").sortWithinPartitions("key", "right", "doc_id", "pos")
    spans = _neighbours(suffixes, least).unionByName(windows.join(held, "window").select("doc_id", "start", "end"))
    per = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        apart = last.isNull() | (x["start"] > last["end"])
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(apart, F.concat(acc, F.array(x))).otherwise(grown)

    per = per.select("doc_id", F.aggregate("s", none, join).alias("spans"))
    return per.select("doc_id", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]).alias("n_repeat_words"))


def query(spark, sf_dir: str) -> DataFrame:
    d = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_repeat_words", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i - 1 AS i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
r AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, i FROM g WHERE h IN (SELECT h FROM r)),
s AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c)),
m AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY doc_id, n)
SELECT doc_id, sum(b - a)::BIGINT AS n_repeat_words, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM m GROUP BY doc_id
"""
