"""What the operators share: the shared folder, written intermediate tables, free column names, Arrow helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written so far and not yet removed, with their sessions.
_TABLES: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. A local session without it gets
    one of its own; a cluster without it is an error, as a machine-local folder would not survive an executor."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    where = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    _remember(spark, where)
    return where


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back. The files go with ``discard``, when the
    session stops, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
    _remember(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables() -> set[str]:
    """The paths of the written tables that are there."""
    return set(_TABLES)


def discard(paths: Iterable[str]) -> None:
    """Removes written tables that nothing will read again."""
    for path in list(paths):
        spark = _TABLES.pop(path, None)
        if spark is not None and spark.sparkContext._jsc is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remember(spark: SparkSession, path: str) -> None:
    """Has path removed before the session's context stops; a driver that ends without that stops it at its exit."""
    _TABLES[path] = spark
    sc = spark.sparkContext
    if not hasattr(sc, "_millrace_stop"):
        sc._millrace_stop = sc.stop

        def stop() -> None:
            if sc._jsc is not None:
                discard([k for k, v in _TABLES.items() if v.sparkContext is sc])
            sc._millrace_stop()

        sc.stop = stop
        atexit.register(lambda: sc._jsc is not None and discard([k for k, v in _TABLES.items() if v.sparkContext is sc]))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_enough(df: DataFrame, most: int) -> tuple[bool, int]:
    """Whether df has at most so many rows; counts no further than that."""
    n = df.limit(most + 1).count()
    return n <= most, n


def batches(it: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about so many bytes each, so that a few long texts don't add up."""
    for b in it:
        n = b.num_rows
        if not n:
            continue
        texts = b.column(column)
        size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        if size.sum() <= most_bytes:
            yield b
            continue
        group = np.cumsum(size) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield b.slice(a, z - a)


def bounded_array(df: DataFrame, most: int) -> np.ndarray | None:
    """The single BIGINT column of df as a sorted array if it has at most so many rows, else None."""
    ok, _ = small_enough(df, most)
    if not ok:
        return None
    return np.sort(df.toArrow().column(0).to_numpy().astype(np.int64))
