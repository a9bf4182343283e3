"""The given tables seen as transactions, customers and articles."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from basketlens.functions.columns import money, name_length
from basketlens.operators.features import array_stats
from basketlens.sources.packed import PNG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a date: one per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("unit_price"),
    )


def tx_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a product: one per order line."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_extendedprice").alias("unit_price"),
    )


def tx_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines added up per order before the join, so a hot order is one row in it."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    totals = lines.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice", 2)).alias("unit_price"))
    return totals.join(orders, totals["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("unit_price"),
    )


def tx_event_some_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, a fifth of them without a date, of the customers that keep a dated one."""
    facts = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("order_date"),
        F.col("value").alias("unit_price"),
    )
    dated = facts.where("order_date is not null").select("customer_id").distinct()
    return facts.join(dated, "customer_id", "left_semi")


def tx_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a time of day."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("order_date"),
        F.col("value").alias("unit_price"),
    )


def cust_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with gaps: a null group, a group without values, missing values elsewhere."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.when(key % 11 != 0, segment).alias("grp"),
        F.when((key % 7 != 0) & (segment != "MACHINERY"), F.col("c_acctbal")).alias("x"),
    )


def cust_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incomplete customer dimension."""
    return table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 != 0)


def doc_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label where there is one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
    )


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products under their raw names, with ids that have leading zeros."""
    return table(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("article_id"),
        F.col("p_name").alias("prod_name"),
    )


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays that stand for pixels, by product."""
    return table(spark, sf_dir, "embeddings").select(
        F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("product_id"), "embedding"
    )


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers known of a product: some of every product, those of its picture only where there is one."""
    parts, vectors = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings")
    pictures = array_stats(vectors, "vec_id", "embedding")
    return parts.join(pictures, parts["p_partkey"] == pictures["vec_id"], "left").select(
        "p_partkey", "p_size", "p_retailprice", name_length("p_name").alias("name_length"), "image_mean", "image_std"
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw texts, with the faults a raw file can have."""
    key = F.col("event_id")
    date = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select(
        F.when(key % 101 == 0, F.concat(date, F.lit("?")))
        .when(key % 97 == 0, F.date_format("ts", "yyyyMMdd"))
        .otherwise(date)
        .alias("t_dat"),
        F.when(key % 53 != 0, F.col("user_id").cast("string")).alias("customer_id"),
        F.when(key % 59 != 0, key.cast("string")).alias("article_id"),
        F.when(key % 103 == 0, F.lit("12,5"))
        .when(key % 107 == 0, F.lit("NaN"))
        .when(key % 109 == 0, F.lit("1.0d"))
        .when(key % 113 == 0, F.lit("2f"))
        .when(key % 127 == 0, F.lit("Infinity"))
        .otherwise(F.col("value").cast("string"))
        .alias("price"),
    )


def _levels() -> Column:
    """An embedding as sample values from 0 to 255."""
    return F.transform(
        "embedding",
        lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 128))),
    )


def image_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays turned into decoded images: 8 x 8 gray, and 4 x 4 with alpha for odd ids."""
    odd = F.col("vec_id") % 2 == 1
    data = F.unhex(F.array_join(F.transform(_levels(), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    side = F.when(odd, 4).otherwise(8)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.struct(
            side.alias("height"),
            side.alias("width"),
            F.when(odd, 4).otherwise(1).alias("nChannels"),
            data.alias("data"),
        ).alias("image"),
    )


@F.pandas_udf(BinaryType())
def _as_png(levels: pd.Series, vec_ids: pd.Series) -> pd.Series:
    """Levels as a PNG file: 8 x 8 gray, or 4 x 4 with alpha for odd ids; every line has another filter."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    files = []
    for level, vec_id in zip(levels, vec_ids, strict=True):
        side, samples, colour = (4, 4, 6) if vec_id % 2 else (8, 1, 0)
        lines = np.asarray(level, np.uint8).reshape(side, side * samples)
        above = np.vstack([np.zeros_like(lines[:1]), lines[:-1]])
        left = np.hstack([np.zeros_like(lines[:, :samples]), lines[:, :-samples]])
        kinds = np.arange(side) % 4
        mean = ((left.astype(int) + above) // 2).astype(np.uint8)
        predicted = np.choose(kinds[:, None], [np.zeros_like(lines), left, above, mean])
        rows = np.hstack([kinds[:, None].astype(np.uint8), lines - predicted])
        header = struct.pack(">IIBBBBB", side, side, 8, colour, 0, 0, 0)
        files.append(PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b""))
    return pd.Series(files)


def packed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of image files: PNGs of the embeddings, some of them damaged, cut short, empty, missing or of another kind."""
    key = F.col("vec_id")
    file = _as_png(_levels(), key)
    content = (
        F.when(key % 41 == 0, F.lit(None).cast("binary"))
        .when(key % 43 == 0, F.lit(b"no image"))
        .when(key % 47 == 0, F.substring(file, 1, 40))
        .when(key % 53 == 0, F.unhex(F.lit("FFD8FFE000104A464946")))
        .otherwise(file)
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", content.alias("content"))
