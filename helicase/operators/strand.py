"""Which strand of a window holds the structure, from both readings of it.

Windows are dealt over tasks by block and start before they are scored, and
both readings stay with their window, so they meet where they are: no
exchange, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import classified
from .models import STRAND_RANGES, KernelModel, scale

#: Differences forward less reverse; the number of rows and the identity are the window's.
DELTAS = ("sci", "mean_mfe", "consensus_mfe", "z")


def both_readings(scored: DataFrame, *, key: tuple[str, ...] = ("block_id", "slice_start")) -> DataFrame:
    """One row per window with ``forward`` and ``reverse``, its readings as structs; null where one is missing."""
    columns = [c for c in scored.columns if c not in key]

    def of(strand: str) -> Column:
        return F.max_by(F.struct(*columns), F.when(F.col("strand") == strand, 1))

    return scored.groupBy(*key).agg(of("+").alias("forward"), of("-").alias("reverse"))


def strand_calls(scored: DataFrame, model: KernelModel, *, key: tuple[str, ...] = ("block_id", "slice_start")) -> DataFrame:
    """``key, in_range, winner, probability, dec_value`` of windows that were scored on both strands.

    ``winner`` is ``+`` or ``-`` and ``probability`` that of the winner; both are
    null where a difference lies outside of what the model was trained on.
    ``scored`` has ``key, strand, sci, mean_mfe, consensus_mfe, z, n, identity``.
    """
    both = both_readings(scored.select(*key, "strand", *DELTAS, "n", "identity"), key=key).where("forward IS NOT NULL AND reverse IS NOT NULL")
    values = {c: F.col(f"forward.{c}") - F.col(f"reverse.{c}") for c in DELTAS} | {c: F.col(f"reverse.{c}") for c in ("n", "identity")}
    inside = F.lit(True)
    for c in DELTAS:
        inside = inside & values[c].between(*STRAND_RANGES[c])
    features = F.array(*[scale(values[c].cast("double"), *limits) for c, limits in STRAND_RANGES.items()])
    told = both.select(*key, F.coalesce(inside, F.lit(False)).alias("in_range"), F.when(inside, features).alias("_features"))
    told = told.withColumn("_c", classified(scored.sparkSession, {"strand": model}).asNondeterministic()(F.lit("strand"), F.col("_features")))
    forward = F.col("_c.p") > 0.5
    return told.select(
        *key, "in_range", F.when(forward, "+").when(~forward, "-").alias("winner"),
        F.when(forward, F.col("_c.p")).otherwise(1 - F.col("_c.p")).alias("probability"), F.col("_c.dec_value").alias("dec_value"))
