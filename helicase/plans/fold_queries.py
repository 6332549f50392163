"""Queries on folded sequences: short sequences and alignments drawn from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import folding as ops
from ..operators import models, screen as screens
from ..operators.shuffled_screen import shuffled_screen as screen_by_shuffles
from .fixtures import CELLS_SQL, blocks, read


def short_sequences(spark, sf_dir):
    """A sequence for each vector: a base for each component, by its sign and size."""
    base = lambda x: F.when(x < -0.1, "A").when(x < 0, "C").when(x < 0.1, "G").otherwise("U")
    e = read(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", F.array_join(F.transform("embedding", base), "").alias("seq"))
    # folding costs more than the shuffle, so rows are dealt evenly over tasks
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")


def small_blocks(spark, sf_dir):
    """Alignments of up to four such sequences."""
    rows = short_sequences(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("block_id"), F.struct("vec_id", "seq").alias("r"))
    return rows.groupBy("block_id").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["seq"]).alias("seqs")).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "block_id")


def fold_mfe(spark, sf_dir):
    return ops.fold_mfe(short_sequences(spark, sf_dir), F.col("seq"))


def consensus_fold(spark, sf_dir):
    return ops.consensus_fold(small_blocks(spark, sf_dir), F.col("seqs")).drop("seqs")


def zscore(spark, sf_dir):
    """Energies against twenty shuffles each."""
    return ops.z_scores(short_sequences(spark, sf_dir), F.col("seq"), samples=20)


def select_sequences(spark, sf_dir):
    chosen = ops.select_rows_udf(most=3)(F.transform("rows", lambda r: r["seq"]))
    return blocks(spark, sf_dir).select("block_id", F.size("rows").alias("n_rows"), chosen.alias("kept_rows"))


def sample_sequences(spark, sf_dir):
    """Two choices of three rows of every block."""
    out = ops.sample_rows(blocks(spark, sf_dir).where("n_cols > 0"), samples=2, most=3)
    return out.select("block_id", "sample_no", F.col("n_cols").cast("long").alias("n_cols"), F.transform("rows", lambda r: r["idx"]).alias("kept_rows"))


def shuffled_screen(spark, sf_dir):
    """Alignments of up to four sequences against a hundred shuffled copies, where they fold at all."""
    row = lambda s, i: F.struct(i.alias("idx"), F.lit(0).cast("long").alias("start"), F.lit("+").alias("strand"), s.alias("seq"))
    made = small_blocks(spark, sf_dir).select("block_id", F.length(F.get("seqs", F.lit(0))).alias("n_cols"), F.transform("seqs", row).alias("rows"))
    return screen_by_shuffles(made, samples=100, threshold=-0.01)


def shuffle_alignment(spark, sf_dir):
    """Columns of every block in other places, among those with the same gaps and the same tenth of equal pairs."""
    return ops.shuffle_blocks(blocks(spark, sf_dir).where("n_cols > 0"))


def stand_in_model() -> models.KernelModel:
    """A decision model of two vectors, in place of a published one that users hand to ``models.parse_model``."""
    ranges = models.DECISION_RANGES["di"].values()
    likely, unlikely = ([-1 + 2 * (x - low) / (high - low) for x, (low, high) in zip(row, ranges)] for row in [(-4.0, 0.9, 0.6), (0.0, 0.3, 0.6)])
    return models.KernelModel(gamma=0.5, rho=0.0, coef=[4.0, -4.0], vectors=[likely, unlikely], prob_a=-2.0, prob_b=0.0)


#: The test blocks are prose in four letters: mostly masked, far from alike and out of the models' range.
SCREEN_FILTERS = {"max_gap": 0.35, "max_masked": 1.0, "range_check": False, "min_identity": 0.0}


def screen(spark, sf_dir):
    """Every window of every block through the whole screen, both strands, without shuffles and without a cutoff."""
    found = screens.screen(blocks(spark, sf_dir), decision=stand_in_model(), background=screens.fitted_background, cutoff=0.0, filters=SCREEN_FILTERS, structures=False)
    return found.select("block_id", "slice_start", "strand", "seq_id", "start", "end", "n", "columns", "identity", "entropy", "gc", "mean_mfe", "consensus_mfe",
                        "energy", "covariance", "comb_per_pair", "z", "sci", "dec_value", "p", "locus")


QUERIES = {f.__name__: f for f in (shuffle_alignment, fold_mfe, consensus_fold, zscore, select_sequences, sample_sequences, shuffled_screen, screen)}

SQL = {
    "shuffle_alignment": f"""WITH {CELLS_SQL}, k AS MATERIALIZED (
            SELECT block_id, col, string_agg(c, '' ORDER BY idx) AS letters FROM cells GROUP BY block_id, col
        ), e AS (
            SELECT block_id, col, letters, n, n_a * (n_a - 1) + n_c * (n_c - 1) + n_g * (n_g - 1) + n_u * (n_u - 1) + n_gap * (n_gap - 1) AS equal FROM (
                SELECT *, length(letters) AS n, length(letters) - length(replace(letters, 'A', '')) AS n_a, length(letters) - length(replace(letters, 'C', '')) AS n_c, length(letters) - length(replace(letters, 'G', '')) AS n_g, length(letters) - length(replace(letters, 'U', '')) AS n_u, length(letters) - length(replace(letters, '-', '')) AS n_gap FROM k
            ) counted
        ), g AS (
            SELECT *, regexp_replace(letters, '[^-]', 'N', 'g') || ':' || CASE WHEN n > 1
                THEN floor((equal * 20 + n * (n - 1)) / (2 * n * (n - 1))::DOUBLE)::BIGINT ELSE 0 END AS kind FROM e
        ), r AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY block_id, kind ORDER BY col) AS place,
                   row_number() OVER (PARTITION BY block_id, kind ORDER BY md5(concat_ws(':', 1, block_id, col)), col) AS drawn FROM g
        )
        SELECT a.block_id, a.col, b.letters, b.col AS from_col
        FROM r a JOIN r b ON a.block_id = b.block_id AND a.kind = b.kind AND a.place = b.drawn""",
}
