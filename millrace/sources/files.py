"""File sources and sinks: Parquet, CSV and JSON with the options of the query surface, and a shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.session import at_stop, remove

CSV_OPTIONS = {"header", "sep", "delimiter", "quote", "escape", "nullValue", "compression", "inferSchema", "dateFormat", "timestampFormat"}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); only a local session without that
    setting gets a temporary folder. What is written there goes when the session stops."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        at_stop(spark, lambda: remove(spark, base))
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at_stop(spark, lambda: remove(spark, path))
    return path


def read_parquet(spark: SparkSession, *paths: str, recursive: bool = False, glob: str | None = None, where: str | None = None) -> DataFrame:
    """Files, globs, folders and Hive-partitioned folders; a filter reaches the scan."""
    r = spark.read
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.parquet(*paths)
    return df.filter(where) if where else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    unknown = options.keys() - CSV_OPTIONS
    if unknown:
        raise ValueError(f"unknown CSV options: {sorted(unknown)}")
    r = spark.read.options(**options)
    return (r.schema(schema) if schema else r).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    r = spark.read.options(**options)
    return (r.schema(schema) if schema else r).json(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> str:
    """Writes and gives the path back; fmt is parquet, csv or json."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format: {fmt}")
    w = df.write.format(fmt).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
    return path
