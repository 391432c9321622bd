"""Embeddings of the operators' inputs in the driver's tables.

Intervals live in lineitem (contig = supplier, start = part, length = quantity), points in events (contig = user,
position = minute), depth in events per minute, and statistics in orders, lineitem and documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")


#: The same rows in SQL.
INTERVALS = "select l_suppkey as contig, l_partkey as start, l_partkey + l_quantity::bigint as end_, l_returnflag, l_linestatus, l_orderkey, l_linenumber from lineitem"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the axes of the intervals: contig 1 to 100 from the user, position from the event's number."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "event_type", (F.col("user_id") % 100 + 1).alias("contig"), (F.col("event_id") % 2000).alias("pos"), "value")


POINTS = "select event_id, event_type, user_id % 100 + 1 as contig, event_id % 2000 as pos, value from events"


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user group and minute, as depth at a one-based position."""
    e = read(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    minute = F.floor(micros / 60_000_000).cast("long")
    return e.groupBy((F.col("user_id") % 4).alias("contig"), minute.alias("pos")).agg(F.count("*").alias("depth"))


MINUTES = "select user_id % 4 as contig, epoch_us(ts) // 60000000 as pos, count(*) as depth from events group by 1, 2"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with line_id, which tells all rows apart that are not alike in every column."""
    by = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").withColumn("line_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.row_number().over(by))


LINES = "(select *, (l_orderkey * 10 + l_linenumber) * 100 + row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_linestatus, l_returnflag, l_extendedprice) as line_id from lineitem)"
