"""Scans in one total order without gathering a whole key in one task.

Rows are dealt into ranges of their order once and written; windows run within
a range, and what passes a border is a table of one row for each range: the
state that the ranges before it leave behind for the key it begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def ordered(rows: DataFrame, keys: list[str], *, parts: int | None = None) -> DataFrame:
    """``rows`` with ``_part`` and ``_no``, which rises along ``keys`` through all ranges; computed once.

    Rows that agree in ``keys`` are ranged by a hash of all their columns, so
    that many of them don't fill one range.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = rows.withColumn("_tie", F.xxhash64(*rows.columns))
    ranged = tie.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    return settled(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_no", F.monotonically_increasing_id()))


def carried(placed: DataFrame, key: str, state: Column) -> DataFrame:
    """``_part, key, _carried``: for the key that a range begins with, the greatest ``state`` of the ranges before it.

    ``state`` is an aggregate of which the greatest counts, such as a maximum, or
    the last value as a struct behind its number.  One row for a range at most.
    """
    per = placed.groupBy("_part", key).agg(state.alias("_state"))
    along = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("_part").agg(F.min_by(key, "_no").alias(key))
    return per.withColumn("_carried", F.max("_state").over(along)).join(first, ["_part", key]).where("_carried IS NOT NULL").drop("_state")


def opened(
    rows: DataFrame, *, seq: str = "seq_id", start: str = "start", end: str = "end", compat: bool = False, ties: list[str] | None = None, parts: int | None = None,
) -> DataFrame:
    """``rows`` in order with ``_open``: the start of a row that opens a run of intervals, else null.

    A row opens a run unless it starts at or before the greatest end of all
    rows before it on its sequence, or, with ``compat``, the end of the one
    just before it.
    """
    placed = ordered(rows, [seq, start, end, *(ties or [])], parts=parts)
    inside = Window.partitionBy("_part", seq).orderBy("_no")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    if compat:
        border, within, left = F.max(F.struct("_no", end)), F.lag(end).over(inside), F.col(f"_carried.{end}")
    else:
        border, within, left = F.max(end), F.max(end).over(before), F.col("_carried")
    # one row for each range
    marked = placed.join(F.broadcast(carried(placed, seq, border)), ["_part", seq], "left")
    reach = F.coalesce(within, left) if compat else F.greatest(within, left)
    marked = marked.withColumn("_reach", reach).withColumn("_open", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start)))
    return settled(marked.select(*placed.columns, "_open"))


def with_island(found: DataFrame, *, seq: str = "seq_id") -> DataFrame:
    """Rows of :func:`opened` with ``island``: the start of the row that opened their run."""
    inside = Window.partitionBy("_part", seq).orderBy("_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each range
    border = F.broadcast(carried(found, seq, F.max("_open")))
    return found.join(border, ["_part", seq], "left").withColumn(
        "island", F.coalesce(F.max("_open").over(inside), "_carried")).drop("_carried", "_part", "_no", "_open")


def numbered(found: DataFrame, *, row: str = "window_no", run: str = "locus_no") -> DataFrame:
    """Rows of :func:`opened` with consecutive numbers from 1, of rows and of runs, in their order."""
    along = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # windows over one row for each range
    counts = found.groupBy("_part").agg(F.count("*").alias("_rows"), F.count("_open").alias("_runs"))
    ahead = counts.select("_part", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in ("_rows", "_runs")])
    inside = Window.partitionBy("_part").orderBy("_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.join(F.broadcast(ahead), "_part").withColumn(row, F.col("_rows") + F.row_number().over(inside)).withColumn(
        run, F.col("_runs") + F.count("_open").over(upto)).drop("_rows", "_runs", "_part", "_no", "_open")


def number_loci(
    hits: DataFrame, *, cutoff: float = 0.5, compat: bool = False, ties: list[str] | None = None, parts: int | None = None,
) -> DataFrame:
    """Hits at or above the cutoff with ``window_id`` (``window1``, ``window2``, ...) and ``locus_id`` (``locus1``, ...).

    Numbers run through all hits in the order of sequence, start, end and
    ``ties``; ``compat`` closes a locus at the end of the hit just before.
    """
    found = numbered(opened(hits.where(F.col("p") >= cutoff), compat=compat, ties=ties, parts=parts))
    return found.withColumn("window_id", F.concat(F.lit("window"), F.col("window_no").cast("string"))).withColumn(
        "locus_id", F.concat(F.lit("locus"), F.col("locus_no").cast("string"))).drop("window_no", "locus_no")
