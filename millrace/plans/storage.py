"""Sources, sinks, tables, views and the catalog: each query writes into the shared folder and reads back."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.registry import REGISTRY, Tables
from millrace.session import at_stop
from millrace.sources import files

q = REGISTRY.query
ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus"]


def some_orders(t: Tables) -> DataFrame:
    return t.orders.select(*COLUMNS)


def database(t: Tables) -> str:
    """A new database in the shared folder; it goes when the session stops."""
    name = f"db_{uuid.uuid4().hex[:12]}"
    t.spark.sql(f"CREATE DATABASE {name} LOCATION '{files.scratch(t.spark, 'db')}'")
    at_stop(t.spark, lambda: t.spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE"))
    return name


@q("k_parquet_round_trip", "K1 K4 S1", ORDERS)
def parquet_round_trip(t: Tables) -> DataFrame:
    return files.read_parquet(t.spark, files.write(some_orders(t), files.scratch(t.spark, "pq"), compression="zstd"))


@q("k_csv_round_trip", "K1 K4 S6", ORDERS)
def csv_round_trip(t: Tables) -> DataFrame:
    path = files.write(some_orders(t), files.scratch(t.spark, "csv"), "csv", header="true", sep="|", compression="gzip")
    return files.read_csv(t.spark, path, "o_orderkey long, o_custkey long, o_orderstatus string", header="true", sep="|")


@q("k_json_round_trip", "K1 S7", ORDERS)
def json_round_trip(t: Tables) -> DataFrame:
    return files.read_json(t.spark, files.write(some_orders(t), files.scratch(t.spark, "json"), "json"), "o_orderkey long, o_custkey long, o_orderstatus string")


@q("k_partitioned", "K3 S3", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partitioned(t: Tables) -> DataFrame:
    """The filter prunes folders, so only one is read."""
    path = files.write(some_orders(t), files.scratch(t.spark, "part"), partition_by=("o_orderstatus",))
    return files.read_parquet(t.spark, path, where="o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@q("k_recursive_glob", "S3", "SELECT o_orderkey FROM orders")
def recursive_glob(t: Tables) -> DataFrame:
    path = files.write(some_orders(t), files.scratch(t.spark, "deep") + "/a/b")
    return files.read_parquet(t.spark, path.removesuffix("/a/b"), recursive=True, glob="*.parquet").select("o_orderkey")


@q("k_save_modes", "K2", "SELECT o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY o_orderstatus")
def save_modes(t: Tables) -> DataFrame:
    """Written, left alone by ignore, overwritten, appended to: twice the rows."""
    d, path = some_orders(t), files.scratch(t.spark, "modes")
    for mode in ("errorifexists", "ignore", "overwrite", "append"):
        files.write(d, path, mode=mode)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@q("k_ctas_insert", "K5 K6", "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT -1, -2")
def ctas_insert(t: Tables) -> DataFrame:
    db, s = database(t), t.views("orders")
    s.sql(f"CREATE TABLE {db}.o USING parquet AS SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
    s.sql(f"CREATE TABLE IF NOT EXISTS {db}.o (x INT) USING parquet")
    s.sql(f"INSERT INTO {db}.o SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
    s.sql(f"INSERT INTO {db}.o (o_custkey, o_orderkey) VALUES (-2, -1)")
    return s.table(f"{db}.o")


@q("k_insert_overwrite", "K6 K7", "SELECT r_regionkey AS k, r_name AS v FROM region WHERE r_regionkey > 1")
def insert_overwrite(t: Tables) -> DataFrame:
    db, s = database(t), t.views("region")
    s.sql(f"CREATE TABLE {db}.r (k INT, v STRING) USING parquet")
    s.sql(f"INSERT INTO {db}.r SELECT * FROM region")
    s.sql(f"TRUNCATE TABLE {db}.r")
    s.sql(f"INSERT INTO {db}.r VALUES (99, 'gone')")
    s.sql(f"INSERT OVERWRITE {db}.r SELECT * FROM region WHERE r_regionkey > 1")
    return s.table(f"{db}.r")


@q("k_add_columns", "K8", "SELECT r_regionkey AS k, NULL::VARCHAR AS note FROM region")
def add_columns(t: Tables) -> DataFrame:
    db, s = database(t), t.views("region")
    s.sql(f"CREATE TABLE {db}.r USING parquet AS SELECT r_regionkey AS k FROM region")
    s.sql(f"ALTER TABLE {db}.r ADD COLUMNS (note STRING)")
    return s.table(f"{db}.r")


@q("k_views", "K9 dropTempView", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def views(t: Tables) -> DataFrame:
    s, name = t.views("nation"), f"v_{uuid.uuid4().hex[:12]}"
    s.sql(f"CREATE TEMP VIEW {name} AS SELECT n_nationkey FROM nation")
    s.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
    found = s.table(name)
    s.sql(f"DROP VIEW {name}")
    return found


@q("c_catalog", "tableExists databaseExists functionExists listTables listColumns listDatabases listFunctions listCatalogs getDatabase getTable getFunction currentDatabase setCurrentDatabase currentCatalog setCurrentCatalog createTable",
   "SELECT * FROM (VALUES ('columns', 'k,v'), ('current', 'true'), ('exists', 'true'), ('function', 'true'), ('listed', 'true'), ('dropped', 'false'), ('catalog', 'spark_catalog'), ('global', 'true')) t(what, answer)")
def catalog(t: Tables) -> DataFrame:
    db, c = database(t), t.spark.catalog
    c.createTable(f"{db}.made", schema=t.spark.createDataFrame([], "k int, v string").schema, source="parquet")
    before = c.currentDatabase()
    c.setCurrentDatabase(db)
    current = c.currentDatabase() == db and c.getDatabase(db).name == db
    c.setCurrentDatabase(before)
    c.setCurrentCatalog(c.currentCatalog())
    rows = [
        ("columns", ",".join(x.name for x in c.listColumns(f"{db}.made"))),
        ("current", str(current).lower()),
        ("exists", str(c.tableExists(f"{db}.made") and c.databaseExists(db) and c.getTable(f"{db}.made").name == "made").lower()),
        ("function", str(c.functionExists("upper") and c.getFunction("upper").name == "upper" and any(f.name == "upper" for f in c.listFunctions())).lower()),
        ("listed", str(any(x.name == "made" for x in c.listTables(db)) and any(x.name == db for x in c.listDatabases()) and bool(c.listCatalogs())).lower()),
    ]
    t.spark.sql(f"DROP TABLE {db}.made")
    rows += [("dropped", str(c.tableExists(f"{db}.made")).lower()), ("catalog", c.currentCatalog())]
    name = f"g_{uuid.uuid4().hex[:12]}"
    t.region.createGlobalTempView(name)
    rows.append(("global", str(c.dropGlobalTempView(name)).lower()))
    return t.spark.createDataFrame(rows, "what string, answer string")


@q("c_cache", "isCached cacheTable uncacheTable clearCache refreshTable refreshByPath recoverPartitions createExternalTable", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def cache(t: Tables) -> DataFrame:
    """An external table of partitioned files, its partitions recovered, cached and let go again."""
    db, c = database(t), t.spark.catalog
    path = files.write(some_orders(t), files.scratch(t.spark, "ext"), partition_by=("o_orderstatus",))
    t.spark.sql(f"CREATE TABLE {db}.e (o_orderkey LONG, o_custkey LONG, o_orderstatus STRING) USING parquet PARTITIONED BY (o_orderstatus) LOCATION '{path}'")
    c.recoverPartitions(f"{db}.e")
    c.cacheTable(f"{db}.e")
    if not c.isCached(f"{db}.e"):
        raise RuntimeError("the table isn't cached")
    c.uncacheTable(f"{db}.e")
    c.cacheTable(f"{db}.e")
    c.clearCache()
    if c.isCached(f"{db}.e"):
        raise RuntimeError("the cache isn't empty")
    c.refreshTable(f"{db}.e")
    c.refreshByPath(path)
    return t.spark.table(f"{db}.e").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@q("c_external_table", "createExternalTable dropTempView", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def external_table(t: Tables) -> DataFrame:
    """A table over files that are there, by the catalog's calls, and a temporary view made and dropped by them."""
    db, c = database(t), t.spark.catalog
    path = files.write(some_orders(t), files.scratch(t.spark, "ext"))
    c.createTable(f"{db}.x", path, "parquet")
    name = f"v_{uuid.uuid4().hex[:12]}"
    t.spark.table(f"{db}.x").createTempView(name)
    found = t.spark.table(name).filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    if not c.dropTempView(name) or c.dropTempView(name):
        raise RuntimeError("the view wasn't there, or still is")
    return found


@q("k_permanent_view", "K9", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def permanent_view(t: Tables) -> DataFrame:
    db, s = database(t), t.views("orders")
    s.sql(f"CREATE TABLE {db}.o USING parquet AS SELECT o_orderkey, o_orderstatus FROM orders")
    s.sql(f"CREATE VIEW {db}.v (status, n) AS SELECT o_orderstatus, count(*) AS n FROM {db}.o GROUP BY o_orderstatus")
    return s.table(f"{db}.v").withColumnRenamed("status", "o_orderstatus")


@q("k_csv_options", "K4", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name || ', \"x\"; y' END AS n_name, DATE '2024-02-29' AS d FROM nation")
def csv_options(t: Tables) -> DataFrame:
    """Quotes inside quoted fields, an escape, a NULL marker and a date format survive the round trip."""
    how = {"header": "true", "sep": ";", "quote": "'", "escape": "!", "nullValue": "NIL", "dateFormat": "dd/MM/yyyy"}
    d = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.concat("n_name", F.lit(', "x"; y'))).alias("n_name"), F.to_date(F.lit("2024-02-29")).alias("d"))
    return files.read_csv(t.spark, files.write(d, files.scratch(t.spark, "csv"), "csv", **how), "n_nationkey int, n_name string, d date", **how)


@q("k_arrow_batches", "K10 K11", "SELECT count(*) AS n, true AS shown FROM region")
def arrow_batches(t: Tables) -> DataFrame:
    """A small result as Arrow, and as show() prints it."""
    table = t.region.toArrow()
    shown = t.region._show_string(3, 8, False) if hasattr(t.region, "_show_string") else ""
    return t.spark.createDataFrame([(table.num_rows, "r_name" in shown and "only showing top 3 rows" in shown)], "n long, shown boolean")


@q("c_explain", "EXPLAIN config", "SELECT true AS pushed, true AS same_conf")
def explain(t: Tables) -> DataFrame:
    """The plan's text shows the pushed filter; settings can be set and unset."""
    s = t.views("lineitem")
    plan = s.sql("EXPLAIN FORMATTED SELECT l_orderkey FROM lineitem WHERE l_quantity > 49").first()[0]
    s.conf.set("spark.millrace.probe", "1")
    same = s.conf.get("spark.millrace.probe") == "1"
    s.conf.unset("spark.millrace.probe")
    return s.createDataFrame([("GreaterThan(l_quantity,49.0)" in plan, same and s.conf.get("spark.millrace.probe", None) is None)], "pushed boolean, same_conf boolean")
