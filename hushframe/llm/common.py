"""What several operators share: exact text primitives, hashing, checkpoints."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that count as white space, as literal text and as a regex class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[ \t-\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that lower() may change though they are not in A-Z: all but those of caseless or lower-case classes.
_CASED = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{P}\p{Zs}\p{Nd}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that unless another cased character is there."""
    return F.when((F.octet_length(c) == F.length(c)) | ~c.rlike(_CASED), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+", -1), "")


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct `row`, so that a step's own names cannot clash with any of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(df: DataFrame, d: DataFrame, **own: Column) -> DataFrame:
    """The columns of df out of d's `row` with the step's own results, which replace columns of their names."""
    taken = {n.lower() for n in own}
    if not own:
        return d.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
    d = d.select("row", F.struct(*[c.alias(n) for n, c in own.items()]).alias("own"))
    return d.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in taken], *[F.col("own").getField(n).alias(n) for n in own])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shared-")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder, where it outlives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession):
    """Inside, Spark removes a query's shuffle files as the query ends, rather than when the driver collects garbage.

    For steps that end in cut(); frames meant to be run later, and more than once, are made outside.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to `most` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words between blanks as UTF-8; bytes.split() and bytes.lower() know ASCII blanks and A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (k at most 8) from the hashes of the words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = h[:n] * _MULTIPLIERS[0]
    for j in range(1, k):
        total = total + h[j : j + n] * _MULTIPLIERS[j]
    return mix(total ^ np.uint64(k))


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, none an empty set."""
    return np.unique(grams(h, min(k, len(h)))) if len(h) else h


def with_columns(batch: pa.RecordBatch, names: list[str], **more: pa.Array) -> pa.RecordBatch:
    """The named columns of a batch as they are, and further ones."""
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(more.values()), names=[*names, *more])
