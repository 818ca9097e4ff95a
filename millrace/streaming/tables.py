"""A table's files as a stream, and streams that run over all that is there and end."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from millrace.session import table
from millrace.sources import files


def stream(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 1000) -> DataFrame:
    """The table as a file stream; a table is one file or a folder of files."""
    path, r = f"{sf_dir}/{name}.parquet", spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", str(files_a_batch))
    if os.path.isfile(path.removeprefix("file://")):
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return r.parquet(path)


def appended(df: DataFrame) -> DataFrame:
    """Runs an append-mode stream to its end into files of the shared folder, and reads them."""
    out = files.scratch(df.sparkSession, "stream")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", files.scratch(df.sparkSession, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def completed(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs an aggregating stream to its end; each batch's whole result replaces the table, so the last one stays."""
    spark, out = df.sparkSession, files.scratch(df.sparkSession, "stream")

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", files.scratch(spark, "offsets")).foreachBatch(replace).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
