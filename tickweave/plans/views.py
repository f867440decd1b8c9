"""Two trade views over the given tables, and daily files derived from one."""

from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from ..sources.daily_files import list_files
from ..sources.tables import write_daily_files


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as trades: supplier = security, (order, line) = transaction id.

    ``(isin, tradeTime, orderkey, linenumber, part)`` is unique, so the last
    three columns break ties.
    """
    flags = (
        F.when(F.col("l_returnflag") == "R", "CANC;")
        .when(F.col("l_returnflag") == "A", "ALGO;;AMND;")
        .otherwise("ALGO;")
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("isin"),
        F.col("l_shipdate").alias("tradeTime"),
        F.col("l_shipdate").alias("publishedTime"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("bigint").alias("size"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("TVTIC"),
        F.col("l_linestatus").alias("mic"),
        flags.alias("flags"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("part"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Events as ticks: user = security, event id = transaction id."""
    flags = (
        F.when(F.col("event_type") == "error", "CANC;")
        .when(F.col("event_type") == "purchase", "ALGO;;AMND;")
        .otherwise("ALGO;")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("isin"),
        F.col("ts").alias("tradeTime"),
        F.col("ts").alias("publishedTime"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"),
        F.col("event_id").alias("TVTIC"),
        F.col("event_type").alias("mic"),
        flags.alias("flags"),
    )


def scored_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Trades with a label and a made-up score, to evaluate without a model."""
    return trades(spark, folder).select(
        "isin", "tradeTime", "orderkey", "linenumber", "part",
        F.col("flags").contains("CANC").cast("int").alias("target_label"),
        F.round(F.col("discount") + F.col("tax"), 2).alias("score"),
        F.col("price").alias("buy_price"),
        (F.col("price") * (1 + F.col("discount") - F.col("tax"))).alias("sell_price"),
    )


def daily_files(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as dirty daily files in the shared folder, then listed.

    A file holds 22:00 to 22:00 UTC of one day, is named by the day after and
    delivered in parts. Even days use one layout, odd days another one with its own
    column order, id name and a display name, which changes every ten days. Some
    sizes are no valid values; so are some times of every third day and all of the
    20th; the 13th has a bad name. Five more files hold a header only, no time
    column, no readable bytes, a compressed stream that breaks off, and a day far
    outside any calendar.
    """
    rows = table(spark, folder, "events").withColumn(
        "held", F.to_date(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd"))
    )
    day = F.dayofmonth("held")
    named = F.date_format(F.date_add("held", 1), "yyyyMMdd")
    rows = rows.withColumn("file_day", F.when(day == 13, "2024xx13").otherwise(named))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    bad_time = (F.col("event_type") == "signup") & (day % 3 == 0)
    k = F.get_json_object("props", "$.k")
    cells = {
        "isin": F.concat(F.lit("U"), "user_id"),
        "displayName": F.concat(F.lit('The "U" '), "user_id", F.lit(" "), F.floor(day / 10)),
        "tradeTime": F.when(day == 20, None).when(bad_time, F.concat(F.lit("?"), stamp)).otherwise(stamp),
        "price": F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")),
        "size": F.when(k.cast("bigint") < 5, "-").otherwise(k),
        "quotation": F.lit("MONE"),
        "currency": F.lit(" EUR "),
        "TVTIC": F.col("event_id").cast("string"),
        "orderId": F.col("event_id").cast("string"),
        "mic": F.col("event_type"),
        "flags": F.when(F.col("event_type") == "error", "CANC;").otherwise("ALGO;;AMND;"),
        "publishedTime": stamp,
    }
    layouts = {
        1: ["isin", "displayName", "tradeTime", "price", "size", "quotation", "currency", "TVTIC",
            "mic", "flags", "publishedTime"],
        0: ["publishedTime", "price", "isin", "size", "orderId", "tradeTime", "quotation",
            "currency", "mic", "flags"],
    }
    root = shared_dir(spark)
    for odd, header in layouts.items():
        place = ["file_day", "ts", "event_id"]
        part = rows.where(day % 2 == odd).repartitionByRange(*place).sortWithinPartitions(*place)
        write_daily_files(
            part.select("file_day", *[cells[name].alias(name) for name in header]), root, "file_day"
        )
    nations = table(spark, folder, "nation").coalesce(1)
    others = {
        "20240215": nations.where("false").select(*[F.lit("").alias(c) for c in layouts[1]]),
        "20240216": nations.select(F.col("n_name").alias("isin"), F.lit("1").alias("price")),
        "20350101": nations.select(
            F.col("n_name").alias("isin"), F.lit("2024-01-02T08:00:00Z").alias("tradeTime")
        ),
    }
    for name, other in others.items():
        other.write.option("header", True).option("sep", ";").csv(f"{root}/file_day={name}")
    _write_bytes(spark, f"{root}/file_day=20240219/part-0.csv.gz", b"no gzip stream")
    ids = "".join(f"{hashlib.sha256(bytes([i])).hexdigest()}\n" for i in range(256))
    stream = gzip.compress(f"tradeTime;TVTIC;displayName\n{ids}".encode(), mtime=0)
    _write_bytes(spark, f"{root}/file_day=20240220/part-0.csv.gz", stream[: len(stream) * 3 // 4])
    of_day = F.regexp_extract("path", r"file_day=([^/]*)/", 1)
    return list_files(spark, root, "*.csv*", source=F.concat(F.lit("trades_"), of_day))


def _write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).create(where)
    stream.write(bytearray(content))
    stream.close()
