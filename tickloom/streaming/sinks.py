"""Running streams to completion into tables of the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import shared_dir


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is available into Parquet and read it back. The file sink commits each batch once."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", path + "/_stream")
        .trigger(availableNow=True)
        .start(path + "/data")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path + "/data")


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], path: str) -> None:
    """Hand every micro-batch to ``handle(batch, batch_id)``. A batch may be handed over again after a failure, so
    ``handle`` must write by batch id or key."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", path + "/_stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
