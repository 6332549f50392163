"""Queries on kernel models, over the embeddings as features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import models as ops
from .fixtures import HITS_SQL, hits, vectors

GAMMA, RHO, PROB_A, PROB_B = 0.5, 0.1, -1.5, 0.05


def _centroids(spark, sf_dir):
    """A model whose vectors are the labels' mean vectors, coefficients alternating in sign."""
    parts = vectors(spark, sf_dir).select("label", F.posexplode("features").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.sum(F.round(F.col("x") * 1e9).cast("long")).alias("s"), F.count("*").alias("n"))
    per = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("n") / 1e9).alias("m")))).alias("v"))
    one = F.struct(F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("coef"), F.transform("v", lambda x: x["m"]).alias("vector"))
    return per.agg(F.sort_array(F.collect_list(one)).alias("model"))


def svm_decision(spark, sf_dir):
    scored = ops.score_against(vectors(spark, sf_dir), _centroids(spark, sf_dir), gamma=GAMMA, rho=RHO, key="vec_id", features="features")
    return scored.select("vec_id", sq.rounded(F.col("decision"), 6).alias("decision"))


def svm_probability(spark, sf_dir):
    scored = ops.score_against(vectors(spark, sf_dir), _centroids(spark, sf_dir), gamma=GAMMA, rho=RHO, key="vec_id", features="features")
    return scored.select("vec_id", sq.rounded(ops.probability(F.col("decision"), PROB_A, PROB_B), 6).alias("p"))


def scaled_features(spark, sf_dir):
    h = hits(spark, sf_dir)
    low, high = ops.DECISION_RANGES["mono"]["z"]
    return h.select("hit_id", sq.rounded(ops.scale(F.col("z"), low, high), 6).alias("z_scaled"), sq.rounded(ops.standardise(F.col("columns").cast("double"), 225.0, 114.5698), 6).alias("length_standard"))


def range_warnings(spark, sf_dir):
    return hits(spark, sf_dir).select("hit_id", F.array_join(ops.range_warnings("mono"), "; ").alias("warnings"))


def structure_conservation(spark, sf_dir):
    """Mean energies and their ratio per sequence."""
    per = hits(spark, sf_dir).groupBy("seq_id").agg(F.sum(F.col("z").cast("long")).alias("consensus"), F.sum(F.round(F.col("p") * 10).cast("long")).alias("rows"))
    return per.select("seq_id", sq.rounded(ops.structure_conservation(F.col("consensus").cast("double"), F.col("rows").cast("double")), 6).alias("sci"))


def strand_features(spark, sf_dir):
    """Sequences with both strands: differences between them, scaled."""
    h = hits(spark, sf_dir).groupBy("seq_id", "strand").agg(
        (F.sum(F.round(F.col("sci") * 10000).cast("long")) / F.count("*") / 10000).alias("sci"), F.min("z").alias("mean_mfe"), F.max("z").alias("consensus_mfe"), (F.min("z") / 2).alias("z"),
        F.max("n").alias("n"), F.max("identity").alias("identity"))
    out = ops.strand_features(h, key="seq_id")
    return out.select("seq_id", F.array_join(F.transform("features", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("features"))


QUERIES = {f.__name__: f for f in (svm_decision, svm_probability, scaled_features, range_warnings, structure_conservation, strand_features)}

_SVM = f"""
    v AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (
        SELECT label, i, sum(round(x * 1e9)::BIGINT)::BIGINT / count(*) / 1e9 AS m FROM v GROUP BY label, i), k AS (
        SELECT v.vec_id, m.label, exp(-{GAMMA} * sum((x - m) * (x - m))) AS k FROM v JOIN m USING (i) GROUP BY v.vec_id, m.label), d AS (
        SELECT vec_id, sum(CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END * k) - {RHO} AS decision FROM k GROUP BY vec_id
    )"""
SQL = {
    "svm_decision": f"WITH {_SVM} SELECT vec_id, round(decision, 6) AS decision FROM d",
    "svm_probability": f"WITH {_SVM} SELECT vec_id, round(greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp({PROB_A} * decision + {PROB_B})))), 6) AS p FROM d",
    "scaled_features": f"""WITH {HITS_SQL} SELECT hit_id, round(-1 + 2 * (z - (-7.87)) / (2.76 - (-7.87)), 6) AS z_scaled, round((columns - 225.0::DOUBLE) / 114.5698::DOUBLE, 6) AS length_standard FROM hits""",
    "range_warnings": f"""WITH {HITS_SQL} SELECT hit_id, concat_ws('; ', CASE WHEN z < -7.87 OR z > 2.76 THEN 'z out of range' END, CASE WHEN sci < 0 OR sci > 1.23 THEN 'sci out of range' END,
               CASE WHEN identity < 52.35 OR identity > 99.55 THEN 'identity out of range' END, CASE WHEN n < 2 OR n > 6 THEN 'n out of range' END) AS warnings FROM hits""",
    "structure_conservation": f"""WITH {HITS_SQL}, s AS (SELECT seq_id, sum(z::BIGINT) AS c, sum(round(p * 10)::BIGINT) AS r FROM hits GROUP BY seq_id)
        SELECT seq_id, round(CASE WHEN r = 0 THEN 0.0 ELSE c::DOUBLE / r::DOUBLE END, 6) AS sci FROM s""",
    "strand_features": f"""WITH {HITS_SQL}, s AS (
        SELECT seq_id, strand, sum(round(sci * 10000)::BIGINT)::BIGINT / count(*) / 10000 AS sci, min(z) AS lo, max(z) AS hi, max(n) AS n, max(identity) AS identity FROM hits GROUP BY seq_id, strand), d AS (
        SELECT f.seq_id, f.sci - r.sci AS sci, f.lo - r.lo AS mean_mfe, f.hi - r.hi AS cons, f.lo / 2 - r.lo / 2 AS z, greatest(f.n, r.n)::DOUBLE AS n, greatest(f.identity, r.identity) AS identity
        FROM s f JOIN s r ON f.seq_id = r.seq_id AND f.strand = '+' AND r.strand = '-')
        SELECT seq_id, CASE WHEN sci BETWEEN -0.6 AND 0.47 AND mean_mfe BETWEEN -47.9 AND 48.35 AND cons BETWEEN -64.44 AND 66.86 AND z BETWEEN -5.38 AND 5.38 THEN concat_ws(',',
            round((-1 + 2 * (sci - (-0.6)) / (0.47 - (-0.6))::DOUBLE) * 10000)::BIGINT, round((-1 + 2 * (mean_mfe - (-47.9)) / (48.35 - (-47.9))) * 10000)::BIGINT,
            round((-1 + 2 * (cons - (-64.44)) / (66.86 - (-64.44))) * 10000)::BIGINT, round((-1 + 2 * (z - (-5.38)) / (5.38 - (-5.38))) * 10000)::BIGINT,
            round((-1 + 2 * (n - 2) / (6 - 2)) * 10000)::BIGINT, round((-1 + 2 * (identity - 35.04) / (99.71 - 35.04)) * 10000)::BIGINT) END AS features FROM d""",
}
