"""Kernel models: scaling, decision values, probabilities, warnings.

A model is a table of support vectors with coefficients and a few numbers.
Prediction joins rows with the broadcast model, whose size is checked, and adds
up kernel values; nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Models have a few thousand vectors; a larger one is refused.
MAX_VECTORS = 100_000

#: Feature ranges of the decision models, for scaling to [-1, 1].
DECISION_RANGES = {
    "mono": {"z": (-7.87, 2.76), "sci": (0.0, 1.23), "identity": (52.35, 99.55), "n": (2.0, 6.0)},
    "di": {"z": (-8.15, 2.01), "sci": (0.0, 1.29), "entropy": (0.0, 1.28718)},
    "structural": {"z": (-8.13, 2.01), "sci": (0.0, 1.31), "entropy": (0.0, 1.38353)},
}
#: Feature ranges of the strand model, forward less reverse but for the last two.
STRAND_RANGES = {
    "sci": (-0.6, 0.47), "mean_mfe": (-47.9, 48.35), "consensus_mfe": (-64.44, 66.86), "z": (-5.38, 5.38),
    "n": (2.0, 6.0), "identity": (35.04, 99.71),
}


@dataclass
class KernelModel:
    """A radial-basis model: label is the sign of the decision value."""

    gamma: float
    rho: float
    coef: list[float]
    vectors: list[list[float]]
    prob_a: float | None = None
    prob_b: float | None = None
    labels: list[int] = field(default_factory=lambda: [1, -1])

    def table(self, spark: SparkSession) -> DataFrame:
        if len(self.coef) > MAX_VECTORS:
            raise ValueError(f"{len(self.coef)} support vectors; at most {MAX_VECTORS}")
        rows = [(float(c), [float(x) for x in v]) for c, v in zip(self.coef, self.vectors)]
        return spark.createDataFrame(rows, "coef double, vector array<double>")


def parse_model(text: str) -> KernelModel:
    """A model in the common text form: ``name value`` lines, then ``SV`` and ``coef index:value ...`` lines.

    Indices count from 1; a missing one means 0.
    """
    head, _, body = text.partition("\nSV\n")
    values = dict(line.split(None, 1) for line in head.splitlines() if line.strip())
    sparse = []
    for line in body.splitlines():
        cells = line.split()
        if cells:
            sparse.append((float(cells[0]), {int(k): float(v) for k, v in (c.split(":") for c in cells[1:])}))
    width = max((max(v, default=0) for _, v in sparse), default=0)
    return KernelModel(
        gamma=float(values["gamma"]), rho=float(values["rho"].split()[0]), coef=[c for c, _ in sparse],
        vectors=[[v.get(i + 1, 0.0) for i in range(width)] for _, v in sparse],
        prob_a=float(values["probA"].split()[0]) if "probA" in values else None,
        prob_b=float(values["probB"].split()[0]) if "probB" in values else None,
        labels=[int(x) for x in values.get("label", "1 -1").split()])


def scale(x: Column, low: float, high: float) -> Column:
    """Linear to [-1, 1] over a range."""
    return -1 + 2 * (x - low) / (high - low)


def standardise(x: Column, mean: float, sd: float) -> Column:
    return (x - mean) / sd


def scaled_features(model: str) -> Column:
    """The features of a decision model as an array: clamped, scaled, rounded as it was trained."""
    cells = []
    for name, (low, high) in DECISION_RANGES[model].items():
        x = F.col(name).cast("double")
        if model != "mono":
            if name == "z":
                x = F.least(F.greatest(F.bround(x, 2), F.lit(low)), F.lit(high))
            elif name == "sci":
                x = F.least(F.bround(x, 2), F.lit(high))
            x = F.bround(scale(x, low, high), 5)
        else:
            x = scale(x, low, high)
        cells.append(x)
    return F.array(*cells)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def decision_values(rows: DataFrame, model: KernelModel, *, key: str, features: str = "features") -> DataFrame:
    """(key, decision): sum of coefficient times kernel, less rho, per row.

    The model travels as one broadcast row, an array of its vectors, so a row
    is scored where it is, without a join by pairs.
    """
    table = model.table(rows.sparkSession).agg(F.collect_list(F.struct("coef", "vector")).alias("model"))
    return score_against(rows, table, gamma=model.gamma, rho=model.rho, key=key, features=features)


def score_against(rows: DataFrame, model: DataFrame, *, gamma: float, rho: float, key: str, features: str) -> DataFrame:
    """The same for a one-row table ``model`` of ``array<struct<coef, vector>>``; over MAX_VECTORS of them are an error."""
    kind = model.schema["model"].dataType.simpleString()
    checked = F.when(F.size("model") <= MAX_VECTORS, F.col("model")).otherwise(F.raise_error(F.lit(f"over {MAX_VECTORS} support vectors")).cast(kind))
    # one row of checked size
    model = model.select(checked.alias("model"))
    return rows.join(F.broadcast(model)).select(key, decision_of(F.col(features), F.col("model"), gamma=gamma, rho=rho).alias("decision"))


def decision_of(features: Column, model: Column, *, gamma: float, rho: float) -> Column:
    """Sum of coefficient times kernel, less ``rho``, for ``model`` an ``array<struct<coef, vector>>``."""
    return F.aggregate(model, F.lit(0.0), lambda s, v: s + v["coef"] * F.exp(-gamma * squared_distance(features, v["vector"]))) - rho


def probability(decision: Column, prob_a: float, prob_b: float) -> Column:
    """Platt's sigmoid, kept 1e-7 away from 0 and 1."""
    return F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), 1 / (1 + F.exp(prob_a * decision + prob_b))))


def range_warnings(model: str) -> Column:
    """Which features lie outside the decision model's range; the structural model warns of nothing."""
    if model == "structural":
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[
        F.when((F.col(name) < low) | (F.col(name) > high), F.lit(f"{name} out of range")) for name, (low, high) in DECISION_RANGES[model].items()]))


def strand_features(scored: DataFrame, *, key: str) -> DataFrame:
    """One row per window scored on both strands: the strand model's features, or null out of range.

    ``scored`` has ``key, strand, sci, mean_mfe, consensus_mfe, z, n, identity``.
    """
    def of(name: str, strand: str) -> Column:
        return F.max(F.when(F.col("strand") == strand, F.col(name)))

    delta = ["sci", "mean_mfe", "consensus_mfe", "z"]
    both = scored.groupBy(key).agg(
        F.count_distinct("strand").alias("strands"), *[(of(c, "+") - of(c, "-")).alias(c) for c in delta], F.max("n").alias("n"), F.max("identity").alias("identity"))
    inside = F.lit(True)
    for c in delta:
        low, high = STRAND_RANGES[c]
        inside = inside & F.col(c).between(low, high)
    features = F.array(*[scale(F.col(c).cast("double"), *r) for c, r in STRAND_RANGES.items()])
    return both.where("strands = 2").select(key, F.when(inside, features).alias("features"))


def structure_conservation(consensus_mfe: Column, mean_mfe: Column) -> Column:
    """Consensus energy over mean energy; 0 where the mean is 0."""
    return F.when(mean_mfe == 0, F.lit(0.0)).otherwise(consensus_mfe / F.nullif(mean_mfe, F.lit(0.0)))
