"""Fixed recoding plans on streams: every column transform is stateless, so a plan made on a batch serves a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Plan = dict[str, Callable[[Column], Column]]


def recode_stream(stream: DataFrame, plan: Plan) -> DataFrame:
    """The stream (or table) with planned columns replaced; nothing is kept between batches."""
    return stream.withColumns({c: f(F.col(c)) for c, f in plan.items()})


def windowed_k(stream: DataFrame, qis: list[str], time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Class sizes per tumbling window, late rows dropped after the watermark: what a k check of a stream rests on."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *qis).agg(F.count("*").alias("n"))


def protect_batches(stream: DataFrame, protect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Applies a class-based method to each micro-batch and appends the result; a batch written twice overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        protect(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
