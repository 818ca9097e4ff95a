"""Session factory and table access."""

from __future__ import annotations

import atexit
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(app: str = "millrace", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (UTC, ANSI, AQE); local unless a master is configured."""
    b = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        b = b.master(f"local[{cpus or '*'}]")
    elif "spark.master" not in conf:
        b = b.master(os.environ["SPARK_MASTER"])
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_stop(spark: SparkSession, action: Callable[[], None]) -> None:
    """Runs action before the session's context stops, or at the driver's exit if nothing stops it."""
    sc = spark.sparkContext
    if not hasattr(sc, "_millrace_actions"):
        sc._millrace_actions, plain_stop = [], sc.stop

        def run() -> None:
            while sc._millrace_actions and sc._jsc is not None:
                sc._millrace_actions.pop()()

        def stop() -> None:
            run()
            plain_stop()

        sc.stop = stop
        atexit.register(run)
    sc._millrace_actions.append(action)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
