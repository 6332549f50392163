"""Background energies by regression where it holds, by shuffles elsewhere.

A sequence's composition tells whether the regression asked for was trained
on its like.  There are four kinds, two to ask for and two to fall to:

- 0: regression on shares of bases; 1: shuffles of single bases instead of it;
- 2: regression on shares of pairs of bases, one model for each band of GC
  content; 3: shuffles that keep pairs instead of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.energy import energies
from ..functions.folding import Fold, Room
from .folding import background_udf, in_batches, shuffled_bases, shuffled_pairs
from .kernels import Matrices, values_udf
from .models import KernelModel

#: Lengths and shares that the regressions were trained on.
LENGTHS = {0: (50, 400), 2: (50, 200)}
SHARES = {0: (0.25, 0.75), 2: (0.20, 0.80)}
#: Lower ends of the bands of GC content, each with a model of its own; the last band is closed at 0.8.
BANDS = (0.20, 0.30, 0.36, 0.40, 0.46, 0.50, 0.56, 0.60, 0.66, 0.70)
#: How far a pair's share may lie from that of its bases, in shares of it.
PAIR_LIMIT = 1.5
#: Mean and deviation by which the base regression scales its features (GC, A of AT, C of GC, length) and results.
BASE_SCALE = ((0.5, 0.1581213081), (0.5, 0.1581213081), (0.5, 0.1581213081), (225.0, 114.569772373))
BASE_RESULT = {"mean": (-58.60276, 45.24618), "sd": (4.098457, 1.107606)}
#: A mean over, or a deviation under these is no energy of a fold: shuffles are drawn instead.
LEAST_MEAN, LEAST_SD = -1.0, 0.1
COMPOSITION = "kind int, reliable boolean, gc double, features array<double>"


def rounded(x: float, places: int) -> float:
    """To so many places as C writes it: by the exact binary value, unlike SQL's rounding."""
    return float(f"{x:.{places}f}")


def bases_of(seq: str) -> tuple[np.ndarray, np.ndarray]:
    """Shares of A, C, G, T or U and other letters, and of the 16 pairs among all pairs."""
    code = np.full(256, 4, np.int64)
    for i, letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
        for c in letters:
            code[ord(c)] = i
    x = code[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    n = len(x)
    mono = np.bincount(x, minlength=5) / n if n else np.zeros(5)
    both = (x[:-1] < 4) & (x[1:] < 4)
    di = np.bincount(4 * x[:-1][both] + x[1:][both], minlength=16) / (n - 1) if n > 1 else np.zeros(16)
    return mono, di


def composition(seq: str, want: int, keep: bool) -> tuple[int, bool, float, list[float]]:
    """Kind, whether it was trained on such sequences, GC share, and the features of the regression asked for.

    With ``keep`` a regression stays in use beyond what it was trained on.
    """
    mono, di = bases_of(seq)
    di = np.array([rounded(x, 3) for x in di])
    exact = want == 0
    if not exact:
        mono = np.array([rounded(x, 3) for x in mono])
    fix = (lambda x: float(x)) if exact else (lambda x: rounded(x, 3))
    a, c, g, t = mono[:4]
    gc = fix(c + g)
    of_c, of_a = (fix(c / (c + g)), fix(a / (a + t))) if a + t > 0 and c + g > 0 else (0.0, 0.0)
    low, high = SHARES[want]
    shortest, longest = LENGTHS[want]
    fits = shortest <= len(seq) <= longest and all(low <= x <= high for x in (gc, of_a, of_c))
    if not exact and fits:
        expected = np.outer(mono[:4], mono[:4]).ravel()
        present = di > 0
        # the whole part is compared: models were applied so
        fits = not (np.trunc(np.abs((di[present] - expected[present]) / np.where(expected[present] > 0, expected[present], 1e-300))) > PAIR_LIMIT).any()
    kind = want if fits or keep else want + 1
    if exact:
        features = [(x - m) / s for x, (m, s) in zip((gc, of_a, of_c, len(seq)), BASE_SCALE)]
    else:
        features = [gc, of_c, of_a, *di.tolist(), rounded((len(seq) - 50) / 150, 5)]
    return kind, fits, gc, features


def composition_udf(want: int, *, keep: bool = False):
    """The same for a column of sequences without gaps; null for a null one."""
    if want not in LENGTHS:
        raise ValueError("a regression is of kind 0 (bases) or 2 (pairs of bases)")

    @F.pandas_udf(COMPOSITION)
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for seqs in batches:
            yield pd.DataFrame([composition(s, want, keep) if s is not None else (None, None, None, None) for s in seqs], columns=["kind", "reliable", "gc", "features"])

    return told


def band_of(gc: Column) -> Column:
    """The number of the GC band, from 0; null outside of all."""
    out = F.lit(None).cast("int")
    for i, low in enumerate(BANDS):
        out = F.when(gc >= low, i).otherwise(out)
    return F.when(gc <= 0.8, out)


@dataclass
class Regression:
    """Models of mean and deviation: one pair for kind 0, a pair for each band for kind 2."""

    want: int
    means: list[KernelModel]
    sds: list[KernelModel]

    def __post_init__(self):
        need = 1 if self.want == 0 else len(BANDS)
        if self.want not in LENGTHS or len(self.means) != need or len(self.sds) != need:
            raise ValueError(f"a regression of kind {self.want} needs {need} models of each, not {len(self.means)} and {len(self.sds)}")


def background(
    sequences: DataFrame, regression: Regression | None, *, want: int = 2, keep: bool = False, samples: int = 1000, parameters: str = "", seq: str = "seq",
) -> DataFrame:
    """``seq, kind, reliable, mean_mfe, sd_mfe`` of the distinct sequences, each by the way that holds for it.

    Without a regression every sequence is shuffled.  A regression that gives
    what is no energy of a fold is passed over for shuffles, ``keep`` or not.
    """
    spark = sequences.sparkSession
    want = regression.want if regression else want
    asked = sequences.select(F.col(seq).alias("seq")).where("seq IS NOT NULL").distinct()
    told = asked.withColumn("c", composition_udf(want, keep=keep and regression is not None).asNondeterministic()("seq")).select(
        "seq", (F.col("c.kind") if regression else F.lit(want + 1)).alias("kind"), "c.reliable", "c.gc", "c.features")
    parts = told
    if regression:
        pairs = {f"mean{i}": m for i, m in enumerate(regression.means)} | {f"sd{i}": m for i, m in enumerate(regression.sds)}
        value = values_udf(spark, pairs)
        band = F.lit(0) if want == 0 else band_of(F.col("gc"))
        name = lambda what: F.when(F.col("kind") == want, F.concat(F.lit(what), band.cast("string")))
        parts = told.withColumn("mean", value(name("mean"), F.col("features"))).withColumn("sd", value(name("sd"), F.col("features")))
        if want == 0:
            scaled = {c: F.col(c) * BASE_RESULT[c][1] + BASE_RESULT[c][0] for c in ("mean", "sd")}
        else:
            scaled = {"mean": F.col("mean") / 10 * F.length("seq"), "sd": F.col("sd")}
        parts = parts.select("seq", "kind", "reliable", scaled["mean"].alias("mean_mfe"), scaled["sd"].alias("sd_mfe"))
        sound = F.coalesce((F.col("mean_mfe") <= LEAST_MEAN) & (F.col("sd_mfe") >= LEAST_SD), F.lit(False))
        parts = parts.withColumn("kind", F.when((F.col("kind") == want) & ~sound, want + 1).otherwise(F.col("kind")))
    shuffled = parts.where(F.col("kind") == want + 1).select("seq", "kind", "reliable").withColumn(
        "b", background_udf(samples, pairs=want == 2, parameters=parameters).asNondeterministic()("seq")).select("seq", "kind", "reliable", "b.mean_mfe", "b.sd_mfe")
    if not regression:
        return shuffled
    return parts.where(F.col("kind") == want).select(*shuffled.columns).unionByName(shuffled)


def backs_udf(spark: SparkSession, regression: Regression, *, keep: bool = False, samples: int = 1000, parameters: str = ""):
    """A function of an alignment's ungapped sequences: mean and deviation of each and the way, ``R`` by regression or ``S`` by shuffles.

    The same as :func:`background` where the rows are, without a join: equal
    sequences of a batch are told once, those out of range are shuffled there.
    """
    want, band_ends = regression.want, np.array(BANDS)
    models = spark.sparkContext.broadcast([tuple(Matrices.of(m) for m in pair) for pair in zip(regression.means, regression.sds)])
    shuffle = shuffled_pairs if want == 2 else shuffled_bases

    def told(seqs: list[str]) -> dict[str, tuple[float, float, str]]:
        out: dict[str, tuple[float, float, str]] = {}
        made = {s: composition(s, want, keep) for s in seqs}
        bands: dict[int, list[str]] = {}
        for s, (kind, _, gc, _) in made.items():
            if kind == want and (want == 0 or band_ends[0] <= gc <= 0.8):
                bands.setdefault(0 if want == 0 else int(np.searchsorted(band_ends, gc, "right")) - 1, []).append(s)
        for band, own in bands.items():
            rows = np.array([made[s][3] for s in own])
            mean, sd = (m.values(rows) for m in models.value[band])
            for s, m, d in zip(own, mean.tolist(), sd.tolist()):
                m, d = (m * BASE_RESULT["mean"][1] + BASE_RESULT["mean"][0], d * BASE_RESULT["sd"][1] + BASE_RESULT["sd"][0]) if want == 0 else (m / 10 * len(s), d)
                if m <= LEAST_MEAN and d >= LEAST_SD:
                    out[s] = (m, d, "R")
        left, room = [s for s in seqs if s not in out], Room()
        for group in in_batches([len(s) for s in left], [1] * len(left), samples):
            drawn = []
            for i in group:
                rng = np.random.default_rng(zlib.crc32(left[i].encode()))
                drawn += [[shuffle(left[i], rng)] for _ in range(samples)]
            got = Fold(drawn, energies(parameters), room=room).energy().reshape(len(group), samples)
            for i, own in zip(group, got):
                out[left[i]] = (float(own.mean()), float(own.std(ddof=1)), "S")
        return out

    @F.pandas_udf("means array<double>, sds array<double>, ways array<string>")
    def backs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for blocks in batches:
            known = told(sorted({s for b in blocks if b is not None for s in b if s}))
            known[""] = (0.0, 0.0, "S")
            rows = [tuple(list(x) for x in zip(*[known[s] for s in b])) if b is not None and len(b) else ([], [], []) for b in blocks]
            yield pd.DataFrame(rows, columns=["means", "sds", "ways"])

    return backs


def z_score(mfe: Column, mean: Column, sd: Column) -> Column:
    """Deviations from the mean; 0 where the deviation is next to nothing."""
    return F.when(sd < 1e-5, F.lit(0.0)).otherwise((mfe - mean) / F.nullif(sd, F.lit(0.0)))
