"""Queries of event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.plans._tables import read
from strandframe.plans.registry import register
from strandframe.streaming import windows as w


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("stream_tumbling_counts", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@register("stream_sessions", "with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, count(*) as n, min(ts) as start from s group by user_id, k")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.sessions(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes").select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"))
