"""The corpus pipeline: five stages from raw documents to a mixed corpus, each written and read back as Parquet.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, further
columns of any name included. Null and empty texts, null and repeated doc_ids, and empty tables have the results that each
stage states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import classifier, decontamination, line_dedup, mixing, ngram_join
from hushframe.llm.common import cut, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score reaches 0.3; the model learns from the labelled rows of its own input.

    Scores follow the text alone, so repeated rows stay or go together; null and empty texts have the score of no words.
    """
    return classifier.keep_good(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines; n_chars follows the text where lines were cut. Documents stay, even if no line is left.

    A null text becomes an empty one; a null doc_id keeps its lines; rows that repeat a doc_id are one document.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    d = docs.select("doc_id", "text", "n_chars", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("rest"))
    cleaned = line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d))
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    cleaned = cleaned.select("doc_id", "text", chars.alias("n_chars"), "rest")
    return cleaned.select(*[(F.col(c) if c in ("doc_id", "text", "n_chars") else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near duplicates; documents without words all stay.

    Rows with a null doc_id all stay, though they link others; rows that repeat a doc_id stay or go together.
    """
    return ngram_join.without(docs, cut(ngram_join.classes(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item, repeated rows alike; texts without words contain none."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken besides their columns.

    Texts without words are never taken; a null source is a source; equal rows are taken alike.
    """
    return mixing.mix_documents(docs).where("taken > 0")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix)]

#: The classifier's verdicts cannot be stated in SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Their tables go to the shared folder and are removed once the next one is written;
    the last of them stays, as the result is read from it."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _remove(spark, f"{base}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
