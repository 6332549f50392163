"""The whole screen as one plan: windows, row filters, selection, both strands, folds, scores, decision, loci.

Windows are dealt evenly over tasks once; from there on every step is a column
of its window: array expressions, and three Arrow functions that fold
rows, fold the alignment and count its columns, each a batch of windows at
a time.  Nothing is shuffled again until hits meet in loci.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.energy import energies
from ..functions.folding import Fold, Room, dot_bracket
from ..session import settled
from . import models
from .backgrounds import Regression, backs_udf
from .blocks import filter_rows, materialised, reject_blocks, remove_common_gaps, slide_windows
from .folding import background_udf, consensus_udf, in_batches, select_rows_udf
from .hits import cluster_hits
from .kernels import classified
from .slices import with_gaps

#: How the published regression of one-base models scales its features (GC, A of AT, C of GC, length) and its results.
REGRESSION_SCALE = [(0.5, 0.1581213081), (0.5, 0.1581213081), (0.5, 0.1581213081), (225.0, 114.569772373)]
REGRESSION_RESULT = {"mean": (-58.60276, 45.24618), "sd": (4.098457, 1.107606)}
FOLDS = "mfes array<double>, structures array<string>"


def stats_udf():
    """A function of an alignment's rows: mean pairwise identity in per cent, and mean column entropy."""
    @F.pandas_udf("identity double, entropy double")
    def stats(blocks: pd.Series) -> pd.DataFrame:
        out = []
        for rows in blocks:
            if rows is None or not len(rows) or not len(rows[0]):
                out.append((None, None))
                continue
            cells = np.stack([np.frombuffer(r.upper().replace("T", "U").encode("latin-1", "replace"), np.uint8) for r in rows])
            same = sum((k * (k - 1) / 2).sum() for k in ((cells == x).sum(0) for x in set(cells.ravel().tolist()) - {ord("-")}))
            gaps = (cells == ord("-")).sum(0)
            pairs = len(cells) * (len(cells) - 1) / 2 * cells.shape[1] - (gaps * (gaps - 1) / 2).sum()
            counts = np.stack([(cells == x).sum(0) for x in b"ACGU"])
            p = np.vstack([counts, len(cells) - counts.sum(0)]) / len(cells)
            terms = np.where(p > 0, -p * np.log2(np.where(p > 0, p, 1)), 0.0).sum(0)
            out.append((100.0 * same / pairs if pairs else 0.0, float(terms.mean())))
        return pd.DataFrame(out, columns=["identity", "entropy"])

    return stats


def fold_rows_udf(parameters: str = "", structures: bool = True):
    """A function of sequences without gaps: the least energy and a structure of each (or null); equal ones of a batch are folded once."""
    @F.pandas_udf(FOLDS)
    def fold(blocks: pd.Series) -> pd.DataFrame:
        known = sorted({s for b in blocks if b is not None for s in b if s})
        made: dict[str, tuple[float, str]] = {"": (0.0, "")}
        room = Room()
        for group in in_batches([len(s) for s in known], [1] * len(known)):
            folded = Fold([[known[g]] for g in group], energies(parameters), room=room)
            for k, (g, mfe) in enumerate(zip(group, folded.energy())):
                made[known[g]] = float(mfe), dot_bracket(len(known[g]), folded.pairs(k)) if structures else None
        rows = [([made[s][0] for s in b], [made[s][1] for s in b]) if b is not None else (None, None) for b in blocks]
        return pd.DataFrame(rows, columns=["mfes", "structures"])

    return fold


def once(function):
    """``function`` so that the optimizer evaluates it where it stands: neither twice, nor within a filter pushed elsewhere."""
    return function.asNondeterministic()


def shares(seq: Column) -> dict[str, Column]:
    """Length of an RNA sequence without gaps, GC share, A among A and U, C among C and G."""
    a, c, g, u = (sq.count_of(seq, x) for x in "ACGU")
    return {"n": F.length(seq), "gc": sq.ratio(g + c, a + c + g + u), "a": sq.ratio(a, a + u), "c": sq.ratio(c, c + g)}


#: Our own least-squares fit of folds of random sequences: weights of the terms of :func:`fitted_background`.
MEAN_FIT = [-25.61, -67.338, 5.392, 16.198, -33.917, -42.657, 53.038, 168.5, -57.656, -24.149, 71.742, 196.956, 567.957, -91.605]
SD_FIT = [4.983, 8.326, 0.156, -1.265, 1.974, 2.398, 5.993, -0.012, 5.368, 1.609, 30.457, 17.385, 2.855, 2.709]


def fitted_background(seq: Column) -> tuple[Column, Column]:
    """Mean and deviation of the energies of random sequences like ``seq``, by a regression fitted here.

    Fitted on 24 random sequences for each of 81 compositions (shares of 0.27
    to 0.73) and lengths (50 to 130), folded with the built-in energies.  It
    misses their means by 2.4 kcal/mol and their deviations by 0.7 (root mean
    square).  Beyond that range, or where exact z-scores matter, use shuffles
    or published models.
    """
    # letters are counted once, and each share is worked out once, however often a term names it
    counts = F.struct(F.length(seq).alias("n"), *[sq.count_of(seq, x).alias(x.lower()) for x in "ACGU"])

    def centred(k: Column) -> Column:
        n, a, c, g, u = (k[x] for x in "nacgu")
        return F.struct((sq.ratio(g + c, a + c + g + u) - 0.5).alias("g"), (sq.ratio(a, a + u) - 0.5).alias("a"), (sq.ratio(c, c + g) - 0.5).alias("c"), ((n - 100) / 100).alias("n"))

    def total(weights: list[float]) -> Column:
        def of(k: Column) -> Column:
            g, a, c, n = (k[x] for x in "gacn")
            terms = [g, a, c, n, g * g, a * a, c * c, n * g, a * c, n * a * a, n * c * c, g * c * c, g * a * a]
            return sum((w * t for w, t in zip(weights[1:], terms)), F.lit(weights[0]))

        return sq.let(sq.let(counts, centred), of)

    return total(MEAN_FIT), F.greatest(total(SD_FIT), F.lit(0.5))


def regression_features(seq: Column) -> Column:
    """The four scaled features of the published one-base regression."""
    s = shares(seq)
    return F.array(*[models.standardise(x.cast("double"), *k) for x, k in zip((s["gc"], s["a"], s["c"], s["n"]), REGRESSION_SCALE)])


def regression_background(sequences: DataFrame, mean_model: models.KernelModel, sd_model: models.KernelModel, *, seq: str = "seq") -> DataFrame:
    """(seq, mean_mfe, sd_mfe) of distinct RNA sequences by two regression models, as :func:`models.parse_model` reads them."""
    rows = sequences.select(seq).distinct().withColumn("features", regression_features(F.col(seq)))
    mean, sd = (models.decision_values(rows, m, key=seq).withColumn(name, F.col("decision") * REGRESSION_RESULT[name][1] + REGRESSION_RESULT[name][0]).drop("decision")
                for name, m in (("mean", mean_model), ("sd", sd_model)))
    return mean.join(sd, seq).withColumnsRenamed({"mean": "mean_mfe", "sd": "sd_mfe"})


def windows_to_score(
    blocks: DataFrame, *, size: int = 120, step: int = 40, max_gap: float = 0.25, max_masked: float = 0.1, range_check: bool = True,
    min_rows: int = 2, max_rows: int = 6, best: float = 0.8, alike: float = 1.0, min_columns: int = 50, min_identity: float = 50.0,
) -> DataFrame:
    """Windows after the row filters, the selection of rows, the removal of common gaps, and the rejections that follow it.

    Adds ``identity`` and ``entropy``.  Windows are dealt evenly over tasks, as scoring costs far more than that shuffle.
    """
    cut = reject_blocks(filter_rows(slide_windows(blocks, size=size, step=step), max_gap=max_gap, max_masked=max_masked, range_check=range_check), min_rows=min_rows)
    cut = cut.repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block_id", "slice_start")
    seqs = F.transform("rows", lambda r: F.upper(r["seq"]))
    chosen = cut.withColumn("_kept", once(select_rows_udf(most=max_rows, best=best, alike=alike))(seqs))
    chosen = materialised(chosen.withColumnRenamed("rows", "_all"), "rows", F.filter("_all", lambda r, i: F.array_contains("_kept", i))).drop("_all", "_kept")
    left = remove_common_gaps(chosen).where((F.size("rows") >= min_rows) & (F.col("n_cols") >= min_columns))
    told = left.withColumn("_s", once(stats_udf())(seqs)).select(*left.columns, "_s.identity", "_s.entropy")
    return told.where(F.col("identity") >= min_identity)


def _by_kind(kind: Column, of: Callable[[str], Column]) -> Column:
    """What ``of`` gives for the decision model that each row's kind names; null for an unknown one."""
    first, *rest = models.DECISION_RANGES
    out = F.when(kind == first, of(first))
    for k in rest:
        out = out.when(kind == k, of(k))
    return out


def score_windows(
    windows: DataFrame, *, decision: models.KernelModel | dict[str, models.KernelModel], background: Callable[[Column], tuple[Column, Column]] | Regression | None,
    kind: str | Column = "di", strands: tuple[str, ...] = ("+", "-"), samples: int = 1000, keep: bool = False, parameters: str = "", structures: bool = True,
) -> DataFrame:
    """Every window on every strand with its folds, z-score, conservation index, decision value and probability ``p``.

    ``decision`` is one model, or one for each kind (``mono``, ``di``,
    ``structural``) that the column ``kind`` may name.  ``background`` is a
    :class:`Regression`, which leaves sequences that it wasn't trained on to
    ``samples`` shuffles (with ``keep`` none for their composition); None, for shuffles of every row; or a
    function that gives mean and deviation of a sequence's energies.  The forward strand is
    folded as DNA letters, the reverse one as RNA, as published models were trained.
    Without ``structures`` the rows' own folds are null; nothing else depends on them.
    """
    named = F.lit(kind) if isinstance(kind, str) else kind
    by_name = decision if isinstance(decision, dict) else {kind: decision} if isinstance(kind, str) else dict.fromkeys(models.DECISION_RANGES, decision)
    both = windows.withColumn("reading", F.explode(F.array(*[F.lit(s) for s in strands])))
    read = F.transform("rows", lambda r: F.when(F.col("reading") == "+", sq.as_dna(r["seq"])).otherwise(sq.reverse_complement_rna(sq.as_rna(r["seq"]))))
    both = materialised(both, "seqs", read)
    both = materialised(both, "bare", F.transform("seqs", lambda s: sq.as_rna(sq.ungapped(s))))
    folded = both.withColumn("c", once(consensus_udf(parameters))("seqs")).withColumn("f", once(fold_rows_udf(parameters, structures))("bare"))
    if background is None:
        place = ["block_id", "slice_start", "reading"]
        rows = folded.select(*place, F.posexplode("bare").alias("at", "s")).withColumn("b", background_udf(samples, pairs=kind != "mono", parameters=parameters)("s"))
        per = rows.groupBy(*place).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "b"))), lambda x: x["b"]).alias("backs"))
        folded = folded.join(per, place)
        backs, ways = F.col("backs"), F.transform("backs", lambda _: F.lit("S"))
    elif isinstance(background, Regression):
        told = backs_udf(windows.sparkSession, background, keep=keep, samples=samples, parameters=parameters)
        folded = folded.withColumn("_b", once(told)("bare"))
        backs, ways = F.zip_with("_b.means", "_b.sds", lambda m, d: F.struct(m.alias("mean_mfe"), d.alias("sd_mfe"))), F.col("_b.ways")
    else:
        backs = F.transform("bare", lambda s: F.struct(*[x.cast("double").alias(n) for x, n in zip(background(s), ("mean_mfe", "sd_mfe"))]))
        ways = F.transform("bare", lambda _: F.lit("R"))
    z_of = lambda e, b: F.when(b["sd_mfe"] < 1e-5, 0.0).otherwise((e - b["mean_mfe"]) / F.nullif(b["sd_mfe"], F.lit(0.0)))
    scored = materialised(folded.withColumn("_kind", named), "zs", F.zip_with("f.mfes", backs, z_of))

    def mean(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)

    scored = scored.select(
        "block_id", "slice_start", "slice_end", "reading", F.size("rows").alias("n"), F.col("n_cols").alias("columns"), "identity", "entropy",
        mean(F.transform("seqs", sq.gc_share)).alias("gc"), mean(F.col("f.mfes")).alias("mean_mfe"), "c.consensus_mfe", F.col("c.energy_part").alias("energy"),
        F.col("c.covariance_part").alias("covariance"), F.col("c.combinations").alias("comb_per_pair"), mean(F.col("zs")).alias("z"), F.col("c.structure").alias("structure"),
        F.get("rows", F.lit(0))["name"].alias("seq_id"), F.get("rows", F.lit(0))["start"].alias("start"),
        (F.get("rows", F.lit(0))["start"] + F.length(sq.ungapped(F.get("rows", F.lit(0))["seq"]))).alias("end"),
        F.col("reading").alias("strand"),
        F.transform("rows", lambda r, i: F.struct(
            r["name"].alias("name"), F.get("seqs", i).alias("seq"),
            F.when(F.get("f.structures", i).isNotNull(), with_gaps(F.get("f.structures", i), F.get("seqs", i))).alias("fold"),
            F.get("f.mfes", i).alias("mfe"), F.get("zs", i).alias("z"), F.get(ways, i).alias("method"))).alias("rows"), "_kind")
    scored = scored.withColumn("sci", models.structure_conservation(F.col("consensus_mfe"), F.col("mean_mfe")))
    scored = scored.withColumn("warnings", _by_kind(F.col("_kind"), models.range_warnings)).withColumn("_features", _by_kind(F.col("_kind"), models.scaled_features))
    valued = scored.withColumn("_c", once(classified(windows.sparkSession, by_name))("_kind", "_features"))
    return valued.withColumn("dec_value", F.col("_c.dec_value")).withColumn("p", F.col("_c.p")).withColumnRenamed("_kind", "decision").drop("_c", "_features")


def screen(
    blocks: DataFrame, *, decision: models.KernelModel | dict[str, models.KernelModel], background: Callable[[Column], tuple[Column, Column]] | Regression | None,
    kind: str | Column = "di", cutoff: float = 0.5, filters: dict | None = None, **options,
) -> DataFrame:
    """Scored windows of ``blocks`` with a probability of at least ``cutoff``, each with its ``locus``.

    ``filters`` go to :func:`windows_to_score`, ``options`` to
    :func:`score_windows`.  :func:`helicase.operators.hits.locus_stats` sums
    loci up.
    """
    scored = score_windows(windows_to_score(blocks, **(filters or {})), decision=decision, background=background, kind=kind, **options)
    # clustering reads its rows several times, and folds are dear
    return cluster_hits(settled(scored.where(F.col("p") >= cutoff)), cutoff=cutoff)
