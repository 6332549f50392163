"""The composed screen, slices and text forms on small known alignments."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helicase.functions import sequences as sq
from helicase.functions.energy import energies
from helicase.functions.folding import Fold, encode, pair_scores
from helicase.operators import models, screen, slices
from helicase.operators.hits import locus_stats
from helicase.plans.fold_queries import stand_in_model
from helicase.sources import alignments, reports

ROW = "struct<idx:int,name:string,org:string,chrom:string,start:bigint,end:bigint,length:bigint,full_length:bigint,strand:string,seq:string>"
# A published alignment of four sequences.
TRNA = [
    "GCCTTGTTGGCGCAATCGGTAGCGCGTATGACTCTTAATCATAAGGTTAGGGGTTCGAGCCCCCTACAGGGCT",
    "GCCTTGTTGGCGCAATCGGTAGCGCGTATGACTCTTAATCATAAGGTTAGGGGTTCGAGCCCCCTACAGGGCT",
    "GCCTTGTTGGCGCAATCGGTAGCGCGTATGACTCTTAATCATAAGGCTAGGGGTTCGAGCCCCCTACAGGGCT",
    "GCTTCAGTAGCTCAGTCGGAAGAGCGTCAGTCTCATAATCTGAAGGTCGAGAGTTCGAACCTCCCCTGGAGCA",
]


def row(i, seq, start=100, strand="+", full=5000):
    size = len(seq.replace("-", ""))
    return (i, f"o{i}.c", f"o{i}", "c", start, start + size, size, full, strand, seq)


def frame(spark, *blocks):
    rows = [(b, len(rs[0][-1]), rs) for b, rs in enumerate(blocks)]
    return spark.createDataFrame(rows, f"block_id long, n_cols int, rows array<{ROW}>")


def test_screen_of_a_known_alignment(spark):
    df = frame(spark, [row(i, s) for i, s in enumerate(TRNA)])
    got = screen.screen(df, decision=stand_in_model(), background=screen.fitted_background, cutoff=0.0).collect()
    assert sorted(r.strand for r in got) == ["+", "-"]
    r = next(r for r in got if r.strand == "+")
    assert (r.n, r.columns, r.seq_id, r.start, r.end) == (4, 73, "o0.c", 100, 173)
    # published figures
    assert round(r.identity, 2) == 80.82 and round(r.entropy, 5) == 0.31118 and round(r.gc, 5) == 0.54795
    e = energies()
    own = [float(Fold([[s.replace("T", "U")]], e).energy()[0]) for s in TRNA]
    both = float(Fold([TRNA], e, scores=pair_scores(encode(TRNA))[None]).energy()[0])
    assert [x.mfe for x in r.rows] == own and r.consensus_mfe == both and r.sci == pytest.approx(both / np.mean(own))
    assert r.z == pytest.approx(np.mean([x.z for x in r.rows])) and 0 < r.p < 1 and r.energy + r.covariance == pytest.approx(both, abs=1e-4)
    model = stand_in_model()
    x = [-1 + 2 * (min(max(v, lo), hi) - lo) / (hi - lo) for v, (lo, hi) in zip((round(r.z, 2), round(r.sci, 2), r.entropy), models.DECISION_RANGES["di"].values())]
    want = sum(c * np.exp(-model.gamma * np.square(np.array(x) - v).sum()) for c, v in zip(model.coef, model.vectors)) - model.rho
    assert r.dec_value == pytest.approx(want, abs=1e-4)
    loci = locus_stats(screen.screen(df, decision=stand_in_model(), background=screen.fitted_background, cutoff=0.0)).collect()
    assert [(x.start, x.end, x.windows) for x in loci] == [(100, 173, 2)]
    shuffled = screen.score_windows(screen.windows_to_score(df), decision=stand_in_model(), strands=("+",), background=None, samples=4).first()
    assert shuffled.z < 0 and shuffled.rows[0].method == "S"


def test_documented_decision(spark):
    """Clamping, rounding and scaling of the features, and the probability, against plain arithmetic."""
    df = spark.createDataFrame([(-1.8249, 0.974, 0.31118), (-99.0, 9.0, 0.5), (5.0, 0.2, 0.1)], "z double, sci double, entropy double")
    got = [r[0] for r in df.select(models.scaled_features("di")).collect()]
    ranges = list(models.DECISION_RANGES["di"].values())
    for have, (z, sci, entropy) in zip(got, [(-1.82, 0.97, 0.31118), (-8.15, 1.29, 0.5), (2.01, 0.2, 0.1)]):
        assert have == pytest.approx([round(-1 + 2 * (v - lo) / (hi - lo), 5) for v, (lo, hi) in zip((z, sci, entropy), ranges)], abs=1e-9)


def test_model_text(spark):
    text = "svm_type c_svc\nkernel_type rbf\ngamma 0.5\nnr_class 2\ntotal_sv 2\nrho 0.25\nlabel 1 -1\nprobA -1.5\nprobB 0.5\nnr_sv 1 1\nSV\n2 1:0.5 3:-1 \n-2 2:1 \n"
    m = models.parse_model(text)
    assert (m.gamma, m.rho, m.prob_a, m.prob_b, m.vectors) == (0.5, 0.25, -1.5, 0.5, [[0.5, 0.0, -1.0], [0.0, 1.0, 0.0]])
    df = spark.createDataFrame([(1, [0.5, 0.0, -1.0])], "k int, features array<double>")
    want = 2 - 2 * np.exp(-0.5 * (0.25 + 1 + 1)) - 0.25
    assert models.decision_values(df, m, key="k").first().decision == pytest.approx(want)
    seqs = spark.createDataFrame([("ACGU" * 20,), ("ACGU" * 20,)], "seq string")
    flat = models.KernelModel(gamma=1.0, rho=-0.5, coef=[0.0], vectors=[[0.0] * 4])
    r = screen.regression_background(seqs, flat, flat).collect()
    assert [(x.mean_mfe, x.sd_mfe) for x in r] == [pytest.approx((-58.60276 + 0.5 * 45.24618, 4.098457 + 0.5 * 1.107606))]


def test_slices(spark):
    seqs = ["AC--GTACGT", "ACGTGT--GT", "--GTGTACGT"]
    df = frame(spark, [row(0, seqs[0]), row(1, seqs[1], strand="-"), row(2, seqs[2])])
    for a, b in [(0, 10), (2, 7), (3, 4), (8, 99), (-5, 2)]:
        r = slices.slice_columns(df, F.lit(a), F.lit(b)).first()
        lo, hi = max(a, 0), min(b, 10)
        for x, s in zip(r.rows, seqs):
            bases = len(s[lo:hi].replace("-", ""))
            skipped = s[hi:] if x.strand == "-" else s[:lo]
            start = 100 + len(skipped.replace("-", ""))
            assert (x.seq, x.start, x.end) == (s[lo:hi], start, start + bases)
    assert slices.slice_columns(df, F.lit(9), F.lit(9)).count() == 0
    cut = slices.slice_positions(df, F.lit(101), F.lit(104)).first()
    assert cut.rows[0].seq == "C--GT" and (cut.rows[0].start, cut.rows[0].end) == (101, 104)
    assert slices.slice_positions(df, F.lit(500), F.lit(600)).count() == 0
    assert slices.user_window(df, 2, 4).first().rows[1].seq == "CGT"
    assert [r.n_cols for r in slices.ragged_windows(df, size=4).orderBy("slice_start").collect()] == [4, 4, 2]
    features = spark.createDataFrame([("f", "c", 102, 104, "+"), ("g", "d", 102, 104, "+"), ("h", "c", 0, 50, "-")], "feature_id string, seq_id string, start long, end long, strand string")
    got = slices.slice_features(df, features, flank=1).collect()
    assert [(r.o_feature_id, r.local_start, [x.seq for x in r.rows]) for r in got] == [("f", 1, ["C--GTA", "CGTGT-", "-GTGTA"])]
    back = slices.reverse_blocks(df).first().rows
    assert back[0].seq == "ACGTAC--GT" and back[1].strand == "+"


def test_patterns_pairs_gaps(spark):
    df = spark.createDataFrame([("AAGC",), ("GG-U",), ("CC-A",), ("----",)], "s string")
    assert [r[0] for r in df.select(slices.shuffle_pattern(F.col("s"))).collect()] == ["1,1,3,4", "1,1,-,4", "1,1,-,4", "-,-,-,-"]
    pairs = spark.createDataFrame([(1, 0, 5, ["AU", "AU", "GC", "AA", "--", "A-"])], "block_id int, i int, j int, both array<string>")
    assert tuple(slices.pair_statistics(pairs).first())[3:] == (6, 2, 2)
    one = spark.createDataFrame([("(..)", "-G-AA--C"), ("", "--")], "f string, s string")
    assert [r[0] for r in one.select(slices.with_gaps(F.col("f"), F.col("s"))).collect()] == ["-(-..--)", "--"]


REPORT = {"n": 2, "columns": 8, "direction": "reverse", "identity": 80.5, "entropy": 0.31118, "gc": 0.5, "mean_mfe": -27.25, "consensus_mfe": -26.5,
          "energy": -23.75, "covariance": -2.75, "comb_per_pair": 1.5, "z": -1.75, "sci": 0.97, "background": "dinucleotide", "decision": "sequence based alignment quality",
          "dec_value": 2.25, "p": 0.984068, "prediction": "RNA"}


def test_report_round_trip(spark, tmp_path):
    rows = [("o.c", 5, 12, "+", 900, "GG-AAACC", "((-..)).", -1.5, -2.25, "R"), ("p", None, None, "-", None, "GGAAAACC", "((....))", -1.0, 0.5, "S")]
    kinds = ", ".join(f"{n} {k}" for n, _, _, k in reports.FIELDS)
    df = spark.createDataFrame([(*REPORT.values(), rows, "GGAAAACC", "((....))")] * 2, f"{kinds}, rows array<{reports.REPORT_ROW}>, consensus string, structure string")
    path = str(tmp_path / "reports")
    alignments.write_text(df, reports.report_text(), path)
    got = reports.read_reports(spark, path).collect()
    assert len(got) == 2
    for r in got:
        assert {k: r[k] for k in REPORT} == REPORT and r.strand == "-" and (r.seq_id, r.start, r.end) == ("o.c", 5, 12)
        assert [tuple(x) for x in r.rows] == rows and (r.consensus, r.structure) == ("GGAAAACC", "((....))")
    text = spark.createDataFrame([("Sequences: 1\nReading direction: forward\n\n>a.b/10-20\nACGU\n.... ( -0.00, z-score = 0.10, R)\n",)], "value string")
    x = text.select(reports.parse_report(F.col("value")).alias("r")).first().r
    assert (x.rows[0].name, x.rows[0].start, x.rows[0].end, x.rows[0].strand, x.z) == ("a.b", 10, 20, "+", None)


def test_screen_lines_round_trip(spark, tmp_path):
    hits = spark.createDataFrame([("window2", "locus1", "s", 5, 15), ("window1", "locus1", "s", 0, 10), ("window3", "locus2", "t", 0, 9)], "window_id string, locus_id string, seq_id string, start long, end long")
    hits = hits.withColumn("strand", F.lit("+")).withColumns({c: F.lit(2).cast("long") for c in ("n", "columns")}).withColumns(
        {c: F.lit(0.5) for c in ("identity", "mean_mfe", "consensus_mfe", "energy", "covariance", "comb_per_pair", "z", "sci", "dec_value", "p", "gc")})
    loci = spark.createDataFrame([("locus2", "t", 0, 9, 2, 0.5, 0.5, 0.5), ("locus1", "s", 0, 15, 2, 0.5, 0.5, 0.5)],
                                 "locus_id string, seq_id string, start long, end long, max_n long, max_identity double, max_p double, min_z double")
    lines = [r.value for r in reports.screen_lines(hits, loci, header=True).collect()]
    assert [x.split("\t")[0] for x in lines] == ["# locusID", "# windowID", "locus1", "window1", "window2", "locus2", "window3"]
    path = str(tmp_path / "screen.txt")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    back, places = reports.read_screen(spark, path)
    assert sorted(map(tuple, back.select(*hits.columns).collect())) == sorted(map(tuple, hits.collect()))
    assert sorted(map(tuple, places.select(*loci.columns).collect())) == sorted(map(tuple, loci.collect()))


def test_sniffing(spark, tmp_path):
    texts = {"c.aln": ("CLUSTAL W\n\na/5-8  AC-GU\nb  ACCGU\n", "clustal"), "m.maf": ("# x\n\na score=1\ns o.c 1 4 + 90 AC-GU\ns p.d 2 5 - 90 ACCGU\n\n", "maf"), "u.txt": ("hello\n", "unknown")}
    for name, (text, kind) in texts.items():
        (tmp_path / name).write_text(text)
        assert alignments.sniff_format(spark, str(tmp_path / name)) == kind
    (tmp_path / "e").write_text("\n# only\n")
    with pytest.raises(ValueError):
        alignments.sniff_format(spark, str(tmp_path / "e"))
    for name in ("c.aln", "m.maf"):
        got = alignments.read_alignments(spark, str(tmp_path / name)).first()
        assert [r.seq for r in got.rows] == ["AC-GU", "ACCGU"]
    named = alignments.read_clustal(spark, str(tmp_path / "c.aln")).select(alignments.named_ranges(F.col("rows")).alias("r")).first().r
    assert [(r.name, r.start, r.end) for r in named] == [("a", 5, 8), ("b", None, None)]
    many = "".join(f"a score={i}\ns o.c {i} 3 + 90 ACG\ns p.c {i} 3 + 90 ACG\n\n" for i in range(20))
    (tmp_path / "many.maf").write_text(many)
    blocks = alignments.numbered_blocks(alignments.read_maf(spark, str(tmp_path / "many.maf")))
    assert [r.rows[0].start for r in blocks.where("block_no = 7").collect()] == [7]
