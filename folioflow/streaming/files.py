"""The page-wise steps over a stream of table files. They hold no state: a page's rows arrive in one file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.materialize import shared_dir


def stream_of(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, name: str) -> StreamingQuery:
    """Apply a step to every micro-batch and append the result; what is there is processed, then the query ends.

    A batch seen again after a failure overwrites its own folder, so results are written once.
    """

    def one(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/streams/{name}").trigger(availableNow=True).start()
