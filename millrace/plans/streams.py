"""Streams: filters and joins with tables, tumbling, sliding and session windows with watermarks, duplicates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.registry import REGISTRY, Tables
from millrace.streaming import tables as st

q = REGISTRY.query


def events(t: Tables) -> DataFrame:
    return st.stream(t.spark, t.sf_dir, "events")


@q("st_filter_append", "stream", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 10")
def filter_append(t: Tables) -> DataFrame:
    return st.appended(events(t).filter("event_type = 'purchase' AND value > 10").select("event_id", "user_id", "value"))


@q("st_join_table", "stream", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def join_table(t: Tables) -> DataFrame:
    return st.appended(events(t).join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@q("st_tumbling", "stream window watermark", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS began, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def tumbling(t: Tables) -> DataFrame:
    g = events(t).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return st.completed(g).select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n", F.round("v", 4).alias("v"))


@q("st_sliding", "stream window", "SELECT began, count(*) AS n FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * i::INTEGER) AS began FROM events, range(2) r(i)) GROUP BY began")
def sliding(t: Tables) -> DataFrame:
    g = events(t).groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return st.completed(g).select(F.col("w.start").alias("began"), "n")


@q("st_distinct_users", "stream dropDuplicates", "SELECT DISTINCT user_id FROM events")
def distinct_users(t: Tables) -> DataFrame:
    return st.appended(events(t).select("user_id").dropDuplicates(["user_id"]))
