"""Interval joins, merges and statistics.

Positions are half open.  A sequence may hold a third of all rows, so nothing
sorts a whole sequence in one task: positions are cut into bins, windows run
within a bin, and what passes between bins is a table of one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .ordered import opened, with_island


#: A sequence with more rows than this is cut into bins; a shorter one is a bin of its own.
WHOLE_ROWS = 100_000


def islands(rows: DataFrame, *, seq: str = "seq_id", start: str = "start", end: str = "end", bin_size: int = 50_000, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """``rows`` with ``island``: the start of the run of intervals that overlap or touch.

    A row opens an island unless it starts at or before the greatest end of all
    rows before it on its sequence.  (sequence, island) names the run.  Rows
    without a sequence or start are in none and go.

    Scale: rows are dealt once, by sequence, where none has more than
    ``whole_rows`` rows; what follows by sequence needs no further exchange.
    Longer ones, of which there are few, are dealt by bins of positions, and
    what passes a border is a row for each of their bins.
    """
    placed = rows.where(F.col(seq).isNotNull() & F.col(start).isNotNull())
    # at most a row for every ``whole_rows`` rows
    long = settled(placed.groupBy(F.col(seq).alias("_long")).agg(F.count("*").alias("_n")).where(F.col("_n") > whole_rows).select("_long"))
    if long.isEmpty():
        return _opened_within(placed, [seq], start, end).withColumnRenamed("_island", "island").drop("_open")
    short = _opened_within(placed.join(F.broadcast(long), F.col(seq) == F.col("_long"), "left_anti"), [seq], start, end)
    binned = placed.join(F.broadcast(long), F.col(seq) == F.col("_long"), "left_semi").withColumn("_bin", F.floor(F.col(start) / bin_size))
    within = _opened_within(binned, [seq, "_bin"], start, end)
    along = Window.partitionBy(seq).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    # windows over one row for each bin: how far earlier bins reach, and the last island that they opened
    bins = within.groupBy(seq, "_bin").agg(F.max(end).alias("_end"), F.max("_open").alias("_last")).withColumn("_reach", F.max("_end").over(along))
    bins = bins.withColumn("_last", F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last")))
    bins = bins.select(seq, "_bin", "_reach", F.max("_last").over(along).alias("_carried"))
    # an island that starts within the reach of earlier bins goes on with theirs
    joined = within.join(bins, [seq, "_bin"]).withColumn("island", F.when(F.col("_reach").isNull() | (F.col("_island") > F.col("_reach")), F.col("_island")).otherwise(F.col("_carried")))
    return short.withColumnRenamed("_island", "island").select(*rows.columns, "island").unionByName(joined.select(*rows.columns, "island"))


def _opened_within(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``rows`` with ``_open``, the start of a row that opens a run among those of its ``keys``, and ``_island``, the start of its run."""
    inside = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_before", before).withColumn(
        "_open", F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before")), F.col(start))).drop("_before")
    return marked.withColumn("_island", F.max("_open").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def islands_by_previous(rows: DataFrame, *, seq: str = "seq_id", start: str = "start", end: str = "end", parts: int | None = None) -> DataFrame:
    """The compatible variant: a row opens an island if it starts after the end of the row just before it.

    What the row before is depends on the whole order, so rows are ranged by it.
    """
    return with_island(opened(rows, seq=seq, start=start, end=end, compat=True, parts=parts), seq=seq).select(*rows.columns, "island")


def merge_intervals(rows: DataFrame, *, seq: str = "seq_id", start: str = "start", end: str = "end", **options) -> DataFrame:
    """One row per island: ``seq, start, end, members``."""
    return islands(rows, seq=seq, start=start, end=end, **options).groupBy(seq, F.col("island").alias(start)).agg(
        F.max(end).alias(end), F.count("*").alias("members"))


#: Bins of the finest level hold 2 ** FINEST positions; a bin of each further level holds 2 ** WIDER of the level before.
FINEST, WIDER, LEVELS = 10, 4, 7
#: A bin with more rows of the left side than this is split; at most so many bins, those with most rows, are.
SPLIT_ROWS, MOST_SPLIT = 50_000, 100_000


def level_of(start: Column, end: Column) -> Column:
    """The finest level of which a bin is as long as the closed interval, so that it touches two bins at most.

    Intervals longer than a bin of the last level touch several of those.
    """
    length = F.greatest(end - start, F.lit(0)) + 1
    return sum(((length > (1 << FINEST + WIDER * l)).cast("int") for l in range(LEVELS - 1)), F.lit(0))


def bin_at(position: Column, level: Column) -> Column:
    return F.call_function("shiftright", position.cast("long"), FINEST + WIDER * level)


def _cells(start: Column, end: Column, own_kind: int, climb_kind: int, above: list[int], strict: bool) -> Column:
    """The cells (kind, level, bin) of an interval: its own bins, and those above them at the levels of the other side."""
    level = level_of(start, end)

    def bins(kind: int, at: Column) -> Column:
        return F.transform(F.sequence(bin_at(start, at), bin_at(F.greatest(start, end), at)), lambda b: F.struct(
            F.lit(kind).alias("kind"), at.cast("int").alias("level"), b.alias("bin")))

    none = F.array().cast("array<struct<kind:int,level:int,bin:bigint>>")
    climbs = [F.when(F.lit(l) > level if strict else F.lit(l) >= level, bins(climb_kind, F.lit(l))).otherwise(none) for l in above]
    return F.concat(bins(own_kind, level), *climbs)


def _surveyed(rows: DataFrame, seq: str, start: str, end: str) -> tuple[list[int], int]:
    """The levels that occur, at most LEVELS numbers, and the most rows of one sequence; a single pass."""
    level = F.call_function("shiftleft", F.lit(1), level_of(F.col(start), F.col(end)))
    got = rows.groupBy(seq).agg(F.count("*").alias("n"), F.bit_or(level).alias("levels")).agg(F.max("n").alias("n"), F.bit_or("levels").alias("levels")).first()
    return [l for l in range(LEVELS) if (got.levels or 0) >> l & 1], got.n or 0


def overlap_join(
    left: DataFrame, right: DataFrame, *, seq: str = "seq_id", start: str = "start", end: str = "end",
    split_rows: int = SPLIT_ROWS, levels: tuple[list[int], list[int]] | None = None,
) -> DataFrame:
    """Pairs of rows that share a position: columns of ``left`` and those of ``right`` with the prefix ``o_``.

    Intervals are closed at both ends here: touching counts.  Rows without a
    position match nothing.

    Bins come in levels.  An interval lies in the one or two bins of the
    finest level that is as wide as itself, and climbs to the bins above them,
    at levels that occur on the other side; so the shorter of two intervals
    meets the longer one in a bin of the longer one's level, the join is an
    equality join, and an interval makes a few rows however long it is.  A pair
    is taken in the first bin that both touch.  A bin with many rows of the left
    is split between tasks, each with a copy of the bin's rows of the right.
    ``levels``, those of both sides, spare a pass over them where known.
    """
    # no bin can be full if no sequence has so many rows
    rows_left = None
    if levels:
        mine, theirs = levels
    else:
        (mine, rows_left), (theirs, _) = _surveyed(left, seq, start, end), _surveyed(right, seq, start, end)
    other = right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns])
    o_start, o_end = f"o_{start}", f"o_{end}"
    # kind 0: the left interval is of the finer level, or of the same; kind 1: the right one is
    a = left.withColumn("_cell", F.explode(_cells(F.col(start), F.col(end), 1, 0, theirs, False)))
    b = other.withColumn("_cell", F.explode(_cells(F.col(o_start), F.col(o_end), 0, 1, mine, True))).withColumnRenamed(f"o_{seq}", "_oseq")
    if split_rows and (rows_left is None or rows_left > split_rows):
        full = a.groupBy(F.col(seq).alias("_fseq"), F.col("_cell").alias("_fcell")).agg(F.count("*").alias("_n")).where(F.col("_n") > split_rows)
        # at most MOST_SPLIT rows
        full = F.broadcast(full.orderBy(F.desc("_n")).limit(MOST_SPLIT).select("_fseq", "_fcell", F.ceil(F.col("_n") / split_rows).cast("int").alias("_splits")))
        a = a.join(full, (a[seq] == full["_fseq"]) & (a["_cell"] == full["_fcell"]), "left").withColumn(
            "_salt", F.when(F.col("_splits").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_splits"))).cast("int")).drop("_fseq", "_fcell", "_splits")
        b = b.join(full, (b["_oseq"] == full["_fseq"]) & (b["_cell"] == full["_fcell"]), "left").withColumn(
            "_osalt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))).drop("_fseq", "_fcell", "_splits")
    else:
        a, b = a.withColumn("_salt", F.lit(0)), b.withColumn("_osalt", F.lit(0))
    b = b.withColumnRenamed("_cell", "_ocell")
    both = a.join(b, (F.col(seq) == F.col("_oseq")) & (F.col("_cell") == F.col("_ocell")) & (F.col("_salt") == F.col("_osalt"))
                  & (F.col(start) <= F.col(o_end)) & (F.col(end) >= F.col(o_start))
                  & (F.col("_cell.bin") == bin_at(F.greatest(F.col(start), F.col(o_start)), F.col("_cell.level"))))
    return both.select(*left.columns, *[F.col("_oseq" if c == seq else f"o_{c}").alias(f"o_{c}") for c in right.columns])


def annotate(
    loci: DataFrame, track: DataFrame, *, key: list[str], seq: str = "seq_id", start: str = "start", end: str = "end", **options,
) -> DataFrame:
    """``loci`` with ``annotation``: the name of the overlapping interval with the smallest start (then end, name), or ``-``.

    ``key`` names the columns that tell loci apart.
    """
    best = overlap_join(loci.select(*dict.fromkeys([*key, seq, start, end])), track, seq=seq, start=start, end=end, **options).groupBy(*key).agg(
        F.min(F.struct(f"o_{start}", f"o_{end}", "o_name")).alias("_best"))
    return loci.join(best, key, "left").withColumn("annotation", F.coalesce("_best.o_name", F.lit("-"))).drop("_best")


def interval_stats(rows: DataFrame, *, seq: str = "seq_id", start: str = "start", end: str = "end") -> DataFrame:
    """One row: items, bases covered, sum, mean (rounded half up), greatest and least length."""
    length = F.col(end) - F.col(start)
    covered = merge_intervals(rows, seq=seq, start=start, end=end).agg(F.sum(F.col(end) - F.col(start)).alias("covered_bases"))
    plain = rows.agg(
        F.count("*").alias("items"), F.sum(length).alias("total_bases"),
        F.floor(F.avg(length) + 0.5).cast("long").alias("mean_length"), F.max(length).alias("max_length"), F.min(length).alias("min_length"))
    # one row each
    return plain.crossJoin(covered)


def contig_key(seq_id: Column) -> Column:
    """``Y`` of ``X.Y``; else the whole name."""
    return F.when(seq_id.contains("."), F.regexp_extract(seq_id, r"^(.*)\.(.*)$", 2)).otherwise(seq_id)
