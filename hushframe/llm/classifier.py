"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grams, packed, table, unpacked
from .hashing import slices, word_hashes

BITS = 18


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, weight) of the hashed word n-grams of a batch of texts, in order of row and slot.

    Unigrams and bigrams of lower-cased words, unigrams to trigrams of word shapes (slots from 2 on), whether a word equals
    the one before (slot 1), and a constant (slot 0). The weight of a slot is the square root of its share of the text, so
    long texts weigh no more than short ones. Texts without words have the constant alone.
    """
    words, at = word_hashes(texts)
    shapes, _ = word_hashes(texts, lower=False, shapes=True)
    n = np.diff(at)
    row_of = np.repeat(np.arange(len(n)), n)
    keys = []
    for h, k, salt in ((words, 1, 0), (words, 2, 0), *[(shapes, k, 0x5DEECE66D) for k in (1, 2, 3)]):
        g = grams(h ^ np.uint64(salt), k)
        inside = row_of[: len(g)] == row_of[k - 1 : k - 1 + len(g)]
        slots = np.maximum(g[inside] >> np.uint64(64 - bits), np.uint64(2))
        keys.append((row_of[: len(g)][inside].astype(np.uint64) << np.uint64(bits)) | slots)
    again = np.flatnonzero((words[1:] == words[:-1]) & (row_of[1:] == row_of[:-1]))
    keys.append((row_of[again].astype(np.uint64) << np.uint64(bits)) | np.uint64(1))
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    rows = (keys >> np.uint64(bits)).astype(np.int64)
    weights = np.sqrt(counts / n[rows])
    constant = np.arange(len(n))
    order = np.argsort(np.concatenate([rows, constant]), kind="stable")
    slots = np.concatenate([(keys & np.uint64((1 << bits) - 1)).astype(np.int32), np.zeros(len(n), np.int32)])
    return np.concatenate([rows, constant])[order], slots[order], np.concatenate([weights, np.ones(len(n))])[order].astype(np.float32)


def featurise(labelled: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, y, slots, weights) of labelled (doc_id, y, text), slots (int32) and weights (float32) as packed bytes."""

    def run(batches):
        for b in batches:
            for part in slices(b):
                rows, slots, weights = features(part.column("text"), bits)
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1)).tolist()
                made = [pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in (slots, weights)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *made], names=["doc_id", "y", "slots", "weights"])

    return labelled.mapInArrow(run, labelled.select("doc_id", "y").schema.add("slots", "binary").add("weights", "binary"))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, epochs: int = 4, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 7) -> np.ndarray:
    """Weights of a logistic regression by per-coordinate FTRL-proximal updates in a seeded order; no rows give zeros."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i):
        s = np.sign(z[i])
        return np.where(np.abs(z[i]) <= l1, 0.0, (s * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, x, y = rows[r]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(np.dot(w, x), -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            np.add.at(z, i, g - sigma * w)
            np.add.at(n, i, g * g)
    return weights(np.arange(1 << bits)).astype(np.float32)


def learning_rows(labels: DataFrame, held_out: Column, most: int) -> DataFrame:
    """Up to `most` labelled (doc_id, y), those of the least seeded hashes; null labels and ids and held-out rows are left out."""
    d = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out)
    d = d.groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    return d.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)


def is_held_out(c: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", most_rows: int = 6000, bits: int = BITS) -> np.ndarray:
    """Model from at most `most_rows` labelled documents; that bound also bounds what reaches the driver.

    The drawn ids (16 bytes each) are broadcast, so documents are filtered where they are read and texts never shuffle. Rows
    learn in an order that only their contents decide, so reruns agree.
    """
    drawn = F.broadcast(learning_rows(labels, is_held_out(), most_rows))
    d = docs.select("doc_id", F.col(text).alias("text")).join(drawn, "doc_id").select("doc_id", "y", "text")
    rows = featurise(d, bits).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["slots"]), bytes(r["weights"])))
    return ftrl([(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["weights"], np.float32), r["y"]) for r in rows], bits)


def _score(docs: DataFrame, model: np.ndarray, text: str, bits: int) -> Column:
    """The model's probability of label 1. Texts alone go to Python and scores alone come back; the rows wait in the JVM."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = held.value
        for texts in batches:
            out = []
            for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
                rows, slots, weights = features(part.column("text"), bits)
                total = np.bincount(rows, (w[slots] * weights).astype(np.float64), minlength=part.num_rows)
                out.append(1 / (1 + np.exp(-total)))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return run(F.col(text).cast("string"))


def score(docs: DataFrame, model: np.ndarray, text: str = "text", bits: int = BITS) -> DataFrame:
    """docs with `score`: the model's probability of label 1, from sparse dot products.

    Scores depend on the text alone. Null and empty texts get the constant's score; repeated rows the same score; a column of
    the name is replaced.
    """
    return unpacked(docs, docs.select(packed(docs), _score(docs, model, text, bits).alias("own")), score=F.col("own"))


def keep_good(docs: DataFrame, model: np.ndarray, text: str = "text", threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns as they are."""
    return docs.where(_score(docs, model, text, bits) >= threshold)


def quality_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.3, **training) -> DataFrame:
    """docs' other columns with `score` and `predicted` (1 where the score reaches the threshold), which replace their like."""
    others = docs.drop(text)
    d = docs.select(packed(others), _score(docs, train(docs, labels, text, **training), text, training.get("bits", BITS)).alias("p"))
    return unpacked(others, d, score=F.col("p"), predicted=(F.col("p") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    d = quality_classifier(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
