"""Conversion of streams: a converter keeps no state, so it runs on a streaming DataFrame as on any other."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def convert_stream(stream: DataFrame, column: str, convert: Callable[[Column], Column], into: str | None = None) -> DataFrame:
    return stream.withColumn(into or column, convert(F.col(column)))


def write_converted(stream: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append converted rows as Parquet, exactly once, until what is there is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a temporary folder of this machine only where all runs in one process."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared}/stream-{uuid.uuid4()}" if shared else tempfile.mkdtemp(prefix="stream-")


def convert_available(spark: SparkSession, path: str, column: str, convert: Callable[[Column], Column]) -> DataFrame:
    """The Parquet rows at ``path`` taken as a stream, converted and written, until what is there is done."""
    folder = scratch_folder(spark)
    # a stream reads folders or patterns, and the table may be one file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    write_converted(convert_stream(stream, column, convert), f"{folder}/rows", f"{folder}/log").awaitTermination()
    return spark.read.parquet(f"{folder}/rows")
