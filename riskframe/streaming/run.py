"""Run a streaming plan over the files present and return the written result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="riskframe-stream-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(pattern)


def run_to_table(stream: DataFrame, name: str, mode: str = "append",
                 each: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None):
    """Process everything available and return (result, finished query).

    Without ``each`` the append-mode parquet sink is used (exactly once by its own log). With
    ``each`` every micro-batch is transformed and written to its own ``batch=N`` folder with
    overwrite, so a replayed batch replaces itself.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, name)
    out, log = f"{folder}/data", f"{folder}/log"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", log).outputMode(mode)
    if each is None:
        query = writer.format("parquet").start(out)
    else:
        def write(batch: DataFrame, number: int) -> None:
            each(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(out), query
