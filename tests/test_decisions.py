"""Windows scored with regressions, three decision models and strand calls, on folds of a known alignment."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helicase.operators import backgrounds as bg
from helicase.operators import models, screen
from helicase.operators.models import KernelModel
from helicase.operators.strand import both_readings, strand_calls

from .test_screen import TRNA, frame, row, stand_in_model


def constant(value, width=20):
    return KernelModel(1.0, -value, [0.0], [[0.0] * width])


def plain(m, x):
    return sum(c * math.exp(-m.gamma * sum((a - b) ** 2 for a, b in zip(x, v))) for c, v in zip(m.coef, m.vectors)) - m.rho


@pytest.fixture(scope="module")
def windows(spark):
    blocks = frame(spark, *[[row(i, s) for i, s in enumerate(TRNA[:n])] for n in (4, 3, 2)])
    return screen.windows_to_score(blocks, min_identity=0.0).checkpoint()


def test_regression_in_place(spark, windows):
    regression = bg.Regression(2, [constant(-3.0)] * 10, [constant(2.0)] * 10)
    rows = screen.score_windows(windows, decision=stand_in_model(), background=regression, samples=5).collect()
    assert len(rows) == 6
    for r in rows:
        for x in r.rows:
            bare = x.seq.replace("-", "").replace("T", "U")
            kind = bg.composition(bare, 2, False)[0]
            assert x.method == ("R" if kind == 2 else "S")
            if kind == 2:
                assert x.z == pytest.approx((x.mfe + 0.3 * len(bare)) / 2.0, abs=1e-6)
    apart = {r.seq: r for r in bg.background(spark.createDataFrame([(x.seq.replace("-", "").replace("T", "U"),) for r in rows for x in r.rows], "seq string"), regression, samples=5).collect()}
    for r in rows:
        for x in r.rows:
            b = apart[x.seq.replace("-", "").replace("T", "U")]
            assert x.z == pytest.approx((x.mfe - b.mean_mfe) / b.sd_mfe if b.sd_mfe >= 1e-5 else 0.0, abs=1e-6)


def test_three_models_by_window(spark, windows):
    r = random.Random(1)
    three = {k: KernelModel(0.4, 0.1, [r.uniform(-1, 1) for _ in range(50)], [[r.uniform(-1, 1) for _ in of] for _ in range(50)], -2.0, 0.1) for k, of in models.DECISION_RANGES.items()}
    kind = F.when(F.col("block_id") == 0, "mono").when(F.col("block_id") == 1, "di").otherwise("structural")
    rows = screen.score_windows(windows, decision=three, kind=kind, background=screen.fitted_background).collect()
    assert {x.decision for x in rows} == set(three)
    for x in rows:
        limits = models.DECISION_RANGES[x.decision]
        if x.decision == "mono":
            features = [-1 + 2 * (getattr(x, c) - lo) / (hi - lo) for c, (lo, hi) in limits.items()]
        else:
            values = {"z": min(max(bg.rounded(x.z, 2), limits["z"][0]), limits["z"][1]), "sci": min(bg.rounded(x.sci, 2), limits["sci"][1]), "entropy": x.entropy}
            features = [bg.rounded(-1 + 2 * (values[c] - lo) / (hi - lo), 5) for c, (lo, hi) in limits.items()]
        d = plain(three[x.decision], features)
        assert x.dec_value == pytest.approx(d, abs=1e-4) and x.p == pytest.approx(1 / (1 + math.exp(-2 * x.dec_value + 0.1)), abs=1e-9)


def strand_model(seed=4):
    r = random.Random(seed)
    return KernelModel(0.3, 0.05, [r.uniform(-1, 1) for _ in range(80)], [[r.uniform(-1, 1) for _ in range(6)] for _ in range(80)], -3.0, 0.0)


def test_strands_of_scored_windows(spark, windows):
    scored = screen.score_windows(windows, decision=stand_in_model(), background=screen.fitted_background).checkpoint()
    got = {x.block_id: x for x in strand_calls(scored, strand_model()).collect()}
    rows = {(x.block_id, x.strand): x for x in scored.collect()}
    assert len(got) == 3
    for block, call in got.items():
        f, r = rows[block, "+"], rows[block, "-"]
        values = [f.sci - r.sci, f.mean_mfe - r.mean_mfe, f.consensus_mfe - r.consensus_mfe, f.z - r.z, r.n, r.identity]
        inside = all(lo <= v <= hi for v, (lo, hi) in zip(values[:4], models.STRAND_RANGES.values()))
        assert call.in_range == inside
        if inside:
            d = plain(strand_model(), [-1 + 2 * (v - lo) / (hi - lo) for v, (lo, hi) in zip(values, models.STRAND_RANGES.values())])
            p = 1 / (1 + math.exp(-3 * d))
            assert (call.winner, call.probability, call.dec_value) == ("+" if p > 0.5 else "-", pytest.approx(max(p, 1 - p)), pytest.approx(d))
        else:
            assert call.winner is None and call.probability is None


def test_strand_ranges_and_missing_readings(spark):
    base = {"sci": 0.5, "mean_mfe": -20.0, "consensus_mfe": -10.0, "z": -2.0, "n": 4, "identity": 80.0}
    rows = []
    for i, change in enumerate([{}, {"sci": 1.2}, {"z": 9.0}, {"mean_mfe": -90.0}, {"consensus_mfe": 99.0}]):
        rows += [(i, 0, "+", *(base | change).values()), (i, 0, "-", *base.values())]
    rows.append((9, 0, "+", *base.values()))
    frame_ = spark.createDataFrame(rows, "block_id long, slice_start int, strand string, sci double, mean_mfe double, consensus_mfe double, z double, n int, identity double")
    got = {x.block_id: x for x in strand_calls(frame_, strand_model()).collect()}
    assert {i: x.in_range for i, x in got.items()} == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert both_readings(frame_).count() == 6


def test_readings_meet_without_an_exchange(spark, windows):
    dealt = spark.range(100).select((F.col("id") % 10).alias("block_id"), (F.col("id") % 3).cast("int").alias("slice_start"), F.lit(0.5).alias("sci")).repartition(4, "block_id", "slice_start")
    read = dealt.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    for c in ("mean_mfe", "consensus_mfe", "z", "n", "identity"):
        read = read.withColumn(c, F.lit(1.0))
    plan = strand_calls(read, strand_model())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert np.isfinite(plain(strand_model(), [0.0] * 6))


def test_screen_without_structures(spark, windows):
    """Rows' own structures, which cost as much as folding, can be left out: everything else is the same."""
    with_, without = ({(r.block_id, r.reading): r.asDict(True) for r in screen.score_windows(
        windows, decision=stand_in_model(), background=screen.fitted_background, structures=s).collect()} for s in (True, False))
    for k, r in with_.items():
        assert all(x.pop("fold") for x in r["rows"]) and not any(x.pop("fold") for x in without[k]["rows"])
        assert r == without[k] and r["structure"]


def test_fitted_background_counts_letters_once(spark):
    """The same values as its formula, and a text whose length doesn't multiply with the terms."""
    seqs = ["GGCAUUUGCCAAAGC" * 6, "ACGU" * 30, "A" * 60, "", "NNN"]
    mean, sd = screen.fitted_background(F.col("seq"))
    assert str(mean).count("replace(seq") <= 10 and str(sd).count("replace(seq") <= 10
    for r in spark.createDataFrame([(s,) for s in seqs], "seq string").select("seq", mean.alias("m"), sd.alias("d")).collect():
        n_a, n_c, n_g, n_u = (r.seq.count(x) for x in "ACGU")
        share = lambda x, y: x / y if y else 0.0
        g, a, c, n = share(n_g + n_c, n_a + n_c + n_g + n_u) - 0.5, share(n_a, n_a + n_u) - 0.5, share(n_c, n_c + n_g) - 0.5, (len(r.seq) - 100) / 100
        terms = [1, g, a, c, n, g * g, a * a, c * c, n * g, a * c, n * a * a, n * c * c, g * c * c, g * a * a]
        assert r.m == pytest.approx(sum(w * t for w, t in zip(screen.MEAN_FIT, terms)))
        assert r.d == pytest.approx(max(0.5, sum(w * t for w, t in zip(screen.SD_FIT, terms))))
