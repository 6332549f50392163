"""Cutting alignments: by columns, by positions of a row, by features, into simple windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as sq
from .blocks import materialised
from .intervals import overlap_join


def slice_rows(rows: Column, first: Column, last: Column) -> Column:
    """Columns ``first`` to ``last`` (half open) of every row, with positions on the forward strand.

    A plus row begins after its bases before the slice; a minus row, which
    reads backwards, after its bases behind the slice.
    """
    def cut(r: Column) -> Column:
        inside = F.substring(r["seq"], first + 1, last - first)
        before, behind = F.substring(r["seq"], F.lit(1), first), F.substring(r["seq"], last + 1, F.length(r["seq"]))
        start = r["start"] + F.length(sq.ungapped(F.when(r["strand"] == "-", behind).otherwise(before)))
        size = F.length(sq.ungapped(inside)).cast("long")
        return r.withField("start", start).withField("end", start + size).withField("length", size).withField("seq", inside)

    return F.transform(rows, cut)


def slice_columns(blocks: DataFrame, first: Column, last: Column) -> DataFrame:
    """Blocks cut to columns ``first`` to ``last``, both brought into range; blocks without such columns go."""
    cut = blocks.withColumn("slice_start", F.greatest(first, F.lit(0)).cast("int")).withColumn("slice_end", F.least(last, F.col("n_cols")).cast("int"))
    cut = cut.where("slice_start < slice_end").withColumnRenamed("rows", "_all")
    cut = materialised(cut, "rows", slice_rows(F.col("_all"), F.col("slice_start"), F.col("slice_end"))).drop("_all")
    return cut.withColumn("n_cols", F.col("slice_end") - F.col("slice_start"))


def user_window(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """Columns ``first`` to ``last`` as users count them: from 1, both included."""
    return slice_columns(blocks, F.lit(first - 1), F.lit(last))


def row_end(row: Column) -> Column:
    return row["start"] + F.length(sq.ungapped(row["seq"]))


def slice_positions(blocks: DataFrame, start: Column, end: Column, *, row: int = 0) -> DataFrame:
    """Blocks cut to positions ``start`` to ``end`` (half open) of plus row ``row``, as far as it reaches; others go."""
    ref = F.get("rows", F.lit(row))
    first = F.when(start <= ref["start"], 0).otherwise(sq.position_to_column(ref["seq"], ref["start"], start))
    last = F.when(end >= row_end(ref), F.col("n_cols")).otherwise(sq.position_to_column(ref["seq"], ref["start"], end - 1) + 1)
    return slice_columns(blocks.where((start < row_end(ref)) & (end > ref["start"])), first, last)


def drop_gappy(slices: DataFrame, length: Column) -> DataFrame:
    """Rows with no more gaps than a slice has columns beyond ``length``."""
    return slices.withColumn("rows", F.filter("rows", lambda r: F.length(r["seq"]) - F.length(sq.ungapped(r["seq"])) <= F.col("n_cols") - length))


def slice_features(blocks: DataFrame, features: DataFrame, *, flank: int = 0, seq: Column | None = None) -> DataFrame:
    """A slice of the block for every feature that its first row overlaps, with flanks as far as the row reaches.

    ``features`` has ``feature_id, seq_id, start, end, strand`` (half open);
    ``seq`` names a block's sequence, by default ``chrom`` of its first row.
    Rows with more gaps than columns beyond the feature go, then slices with
    fewer than two rows.  Adds the feature's columns with the prefix ``o_`` and
    ``local_start``, its place in the ungapped first row of the slice.
    """
    ref = F.get("rows", F.lit(0))
    placed = blocks.withColumn("_seq", ref["chrom"] if seq is None else seq).withColumn("_from", ref["start"]).withColumn("_to", row_end(ref) - 1)
    # closed intervals, as the join takes them
    closed = features.select("feature_id", "strand", F.col("seq_id").alias("_seq"), F.col("start").alias("_from"), (F.col("end") - 1).alias("_to"))
    met = overlap_join(placed.where("_from <= _to"), closed.where("_from <= _to"), seq="_seq", start="_from", end="_to")
    met = met.withColumnRenamed("o__from", "o_start").withColumn("o_end", F.col("o__to") + 1).drop("o__to", "o__seq", "_seq", "_from", "_to")
    cut = slice_positions(met, F.col("o_start") - flank, F.col("o_end") + flank)
    left = drop_gappy(cut, F.col("o_end") - F.col("o_start")).where(F.size("rows") >= 2)
    return left.withColumn("local_start", F.greatest(F.col("o_start") - F.get("rows", F.lit(0))["start"], F.lit(0)))


def ragged_windows(blocks: DataFrame, *, size: int, step: int | None = None, past_end: bool = True) -> DataFrame:
    """Windows of ``size`` columns every ``step`` (``size`` if not given); the last may be shorter.

    Without ``past_end`` none begins after the first that reaches the end.
    """
    step = step or size
    n = F.col("n_cols")
    last = n - 1 if past_end else F.ceil((n - size) / step).cast("int") * step
    each = blocks.where("n_cols > 0").withColumn("_at", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))))
    return slice_columns(each, F.col("_at"), F.col("_at") + size).drop("_at")


def reverse_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks read from the other strand: rows reversed and complemented, strands flipped, positions as they are."""
    return blocks.withColumn("rows", F.transform("rows", lambda r: r.withField("seq", sq.reverse_complement_dna(r["seq"])).withField(
        "strand", sq.flip_strand(r["strand"]))))


def shuffle_pattern(letters: Column) -> Column:
    """The pattern of a column: gaps, and for every other row the first row with the same letter.

    Columns of one pattern may change places in a control that keeps gaps and
    substitutions exactly.
    """
    cells = F.split(letters, "")
    return F.array_join(F.transform(cells, lambda c: F.when(c == "-", "-").otherwise(F.array_position(cells, c).cast("string"))), ",")


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """Per column pair ``block_id, i, j, both`` (``both``: the two letters of every row): all, distinct pairing, and non-pairing ones."""
    canonical = ["AU", "UA", "GC", "CG", "UG", "GU"]
    return pairs.select(
        "block_id", "i", "j", F.size("both").alias("n_all"), F.size(F.array_distinct(F.filter("both", lambda p: p.isin(canonical)))).alias("kinds"),
        F.size(F.filter("both", lambda p: ~p.isin(*canonical, "--"))).alias("n_nonpairing"))


def with_gaps(structure: Column, seq: Column) -> Column:
    """A structure of an ungapped sequence with the gaps of ``seq`` put back in."""
    cells = F.split(seq, "")
    upto = lambda i: F.length(sq.ungapped(F.substring(seq, F.lit(1), i + 1)))
    return F.array_join(F.transform(cells, lambda c, i: F.when(c == "-", "-").otherwise(F.substring(structure, upto(i), F.lit(1)))), "")
