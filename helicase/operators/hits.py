"""Operators on scored windows (hits) and the loci that they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands, islands_by_previous

#: Whether a larger value of a sort key is the better one.
LARGER_FIRST = {
    "n": True, "columns": True, "identity": True, "sci": True, "comb_per_pair": True, "dec_value": True, "p": True,
    "seq_id": False, "start": False, "end": False, "strand": False, "z": False, "mean_mfe": False, "consensus_mfe": False,
    "energy": False, "covariance": False, "window_id": False, "locus_id": False,
}


def above_cutoff(hits: DataFrame, cutoff: float = 0.5) -> DataFrame:
    return hits.where(F.col("p") >= cutoff)


def is_rna() -> Column:
    """A window is called RNA above one half, not at it."""
    return F.col("p") > 0.5


def cluster_hits(hits: DataFrame, *, cutoff: float = 0.5, compat: bool = False) -> DataFrame:
    """Hits at or above the cutoff with their locus, named by sequence and start.

    ``compat`` compares a hit with the end of the one before it alone, as
    older screens did; by default with the greatest end so far.
    """
    kept = above_cutoff(hits, cutoff)
    found = islands_by_previous(kept) if compat else islands(kept)
    return found.withColumn("locus", F.concat_ws(":", "seq_id", F.col("island").cast("string"))).drop("island")


def locus_stats(clustered: DataFrame) -> DataFrame:
    """One row per locus: extent, members and the best of their scores."""
    return _stats(clustered)


def _stats(clustered: DataFrame, *more: Column) -> DataFrame:
    return clustered.groupBy("locus", "seq_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("windows"),
        F.max("n").alias("max_n"), F.max("identity").alias("max_identity"), F.max("p").alias("max_p"), F.min("z").alias("min_z"), *more)


def filter_hits(clustered: DataFrame, condition: str | Column) -> tuple[DataFrame, DataFrame]:
    """Hits that satisfy a Spark SQL condition over their columns, and the loci that keep one.

    ``P``, ``SCI`` and the other field names resolve without regard to case.
    """
    kept = clustered.where(condition)
    passed = F.expr(condition) if isinstance(condition, str) else condition
    return kept, _stats(clustered, F.max(F.coalesce(passed, F.lit(False))).alias("_keeps")).where("_keeps").drop("_keeps")


def count_hits(kept: DataFrame) -> DataFrame:
    """One row: loci and windows."""
    return kept.agg(F.count_distinct("locus").alias("loci"), F.count("*").alias("windows"))


def sort_key(key: str, reverse: bool = False) -> Column:
    return F.col(key).desc() if LARGER_FIRST[key] != reverse else F.col(key).asc()


def sort_hits(hits: DataFrame, key: str = "p", *, reverse: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Hits from the best to the worst; ``ties`` settle equal ones."""
    return hits.orderBy(sort_key(key, reverse), *(ties or []))


def sort_loci(clustered: DataFrame, key: str = "p", *, reverse: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Hits grouped by locus: loci by their best hit, hits of a locus by the key."""
    largest = LARGER_FIRST[key] != reverse
    best = clustered.groupBy("locus").agg((F.max(key) if largest else F.min(key)).alias("locus_best"))
    with_best = clustered.join(best, "locus")
    order = F.col("locus_best").desc() if largest else F.col("locus_best").asc()
    return with_best.orderBy(order, "locus", sort_key(key, reverse), *(ties or []))


def bin_histogram(facts: DataFrame, *, length_bin: int = 10, identity_bin: int = 5, max_length: int = 200, max_identity: int = 100) -> DataFrame:
    """Counts by bins of length and identity; values over a maximum share its overflow bin."""
    def binned(x: Column, size: int, most: int) -> Column:
        return F.when(x > most, most + 1).otherwise(F.floor((x - 1) / size) * size + 1).cast("long")

    return facts.groupBy(
        binned(F.col("length"), length_bin, max_length).alias("length_bin"),
        binned(F.col("identity"), identity_bin, max_identity).alias("identity_bin"), "n",
    ).agg(F.count("*").alias("blocks"))


def best_of_each(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each ``key`` by ``order``, such as the best similarity hit."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def renumber_blocks(blocks: DataFrame, file: str = "file_no", block: str = "block_no") -> DataFrame:
    """Blocks numbered through all files: a running offset of files plus the number within the file.

    The running sum is over files, one row each; blocks of a file are numbered
    among themselves.
    """
    sizes = blocks.groupBy(file).agg(F.count("*").alias("_n"))
    along = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(file, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(file).orderBy(block)
    return blocks.withColumn("_i", F.row_number().over(inside)).join(offsets, file).withColumn(
        "global_no", F.col("_offset") + F.col("_i")).drop("_i", "_offset")
