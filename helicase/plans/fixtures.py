"""Domain shapes drawn from the test tables, in Spark and in SQL.

Both engines evaluate the same projection: hits from ``lineitem``, tracks from
``events``, alignment blocks from ``conversations`` (a conversation is a block,
a turn a row, whole texts as sequences), vectors from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = ("acgu" * 7)[:26]
LETTERS_IN = ALPHABET + ALPHABET.upper()
LETTERS_OUT = BASES + BASES.upper()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored windows: ``hit_id`` is the key of a line; positions come from the part and the quantity."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("hit_id"),
        F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")).alias("seq_id"),
        (F.col("l_partkey") * 10).alias("start"),
        (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("end"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.col("l_linenumber").cast("long").alias("n"),
        F.col("l_quantity").cast("long").alias("columns"),
        (50 + F.col("l_quantity")).alias("identity"),
        (F.round(F.col("l_discount") * 100, 0) / 10).alias("p"),
        (-F.round(F.col("l_tax") * 100, 0)).alias("z"),
        # as SQL rounds: the product in binary, not the decimal text of the quotient
        (F.round(F.col("l_extendedprice") / 100000 * 10000) / 10000).alias("sci"),
        F.col("l_extendedprice").alias("energy"),
        F.col("l_shipdate").alias("stamp"),
    )


HITS_SQL = """
    hits AS (
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS hit_id,
               concat('chr', l_suppkey) AS seq_id, l_partkey * 10 AS start, l_partkey * 10 + l_quantity::BIGINT AS "end",
               CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS columns,
               50 + l_quantity AS identity, round(l_discount * 100, 0) / 10 AS p, -round(l_tax * 100, 0) AS z,
               round(l_extendedprice / 100000, 4) AS sci, l_extendedprice AS energy, l_shipdate AS stamp
        FROM lineitem
    )"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BED track: ``event_id, seq_id, start, end, name``."""
    ev = read(spark, sf_dir, "events")
    start = F.floor(F.unix_timestamp("ts") / 60)
    return ev.select(
        "event_id", F.concat(F.lit("chr"), F.col("user_id").cast("string")).alias("seq_id"),
        start.alias("start"), (start + F.floor("value")).alias("end"), F.col("event_type").alias("name"))


TRACK_SQL = """
    track AS (
        SELECT event_id, concat('chr', user_id) AS seq_id, floor(epoch(ts) / 60)::BIGINT AS start,
               floor(epoch(ts) / 60)::BIGINT + floor(value)::BIGINT AS "end", event_type AS name
        FROM events
    )"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment blocks: one per conversation, one row per turn, padded to the longest."""
    # work on a block costs more than its shuffle: rows are dealt evenly as they are read, and stay where their block is
    c = read(spark, sf_dir, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    seq = F.regexp_replace(F.translate("text", LETTERS_IN, LETTERS_OUT), "[^ACGUacgu]", "-")
    row = F.struct(F.col("turn").alias("idx"), F.concat_ws(".", "role", F.col("conv_id").cast("string")).alias("name"), seq.alias("seq"))
    per = c.groupBy(F.col("conv_id").alias("block_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    longest = F.array_max(F.transform("rows", lambda r: F.length(r["seq"])))
    wide = per.withColumn("n_cols", longest)
    return wide.select("block_id", "n_cols", F.transform("rows", lambda r: F.struct(
        r["idx"].alias("idx"), r["name"].alias("name"), (F.col("block_id") * 10000 + r["idx"] * 10).alias("start"),
        F.when(r["idx"] % 2 == 0, "+").otherwise("-").alias("strand"),
        F.rpad(r["seq"], F.col("n_cols"), F.lit("-")).alias("seq"))).alias("rows"))


BLOCKS_SQL = f"""
    raw_rows AS (
        SELECT conv_id AS block_id, turn AS idx, concat_ws('.', role, conv_id) AS name,
               regexp_replace(translate(text, '{LETTERS_IN}', '{LETTERS_OUT}'), '[^ACGUacgu]', '-', 'g') AS raw
        FROM conversations
    ), block_rows AS (
        SELECT block_id, idx, name, block_id * 10000 + idx * 10 AS start, CASE WHEN idx % 2 = 0 THEN '+' ELSE '-' END AS strand,
               max(length(raw)) OVER (PARTITION BY block_id)::INTEGER AS n_cols,
               rpad(raw, max(length(raw)) OVER (PARTITION BY block_id)::INTEGER, '-') AS seq
        FROM raw_rows
    )"""

#: One row per cell of every block: block_id, idx, col, c (upper case).
CELLS_SQL = BLOCKS_SQL + """, cells AS (
        SELECT block_id, idx, unnest(range(n_cols)) AS col, unnest(string_split(upper(seq), '')) AS c FROM block_rows
    )"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as double features."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
