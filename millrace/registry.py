"""Registry of named queries: a builder and, where SQL can say it, the equivalent ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import TABLES, table

Builder = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Lazy attribute access to the tables of a folder: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

    def views(self, *names: str) -> SparkSession:
        """Registers temp views for SQL text and gives the session."""
        for n in names:
            getattr(self, n).createOrReplaceTempView(n)
        return self.spark


class Registry:
    """Names to builders, oracle SQL and survey ids."""

    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.oracles: dict[str, str] = {}
        self.covers: dict[str, tuple[str, ...]] = {}

    def query(self, name: str, covers: str = "", oracle: str | None = None):
        """Decorator for ``f(t: Tables) -> DataFrame``."""

        def wrap(f: Callable[[Tables], DataFrame]):
            if name in self.builders:
                raise ValueError(f"query {name} is registered twice")
            self.builders[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            self.covers[name] = tuple(covers.split())
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return wrap

    def sql(self, name: str, tables: str, spark_sql: str, covers: str = "", oracle: str | None = "same") -> None:
        """A query given as Spark SQL; ``oracle="same"`` when the text is valid ANSI SQL for both engines."""
        self.query(name, covers, spark_sql if oracle == "same" else oracle)(lambda t: t.views(*tables.split()).sql(spark_sql))


REGISTRY = Registry()
