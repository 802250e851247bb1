"""Semantic functions over streams: each micro-batch is an ordinary DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that puts every micro-batch through transform and hands the result to sink with the batch's
    number. A batch that is run again after a failure has the same number, so a sink that replaces what it wrote
    under that number has every row once; the model is asked again."""

    def run(batch: DataFrame, number: int) -> None:
        sink(transform(batch), number)

    return stream.writeStream.foreachBatch(run)


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its own under path."""
    return lambda frame, number: frame.write.mode("overwrite").parquet(f"{path}/batch={number}")
