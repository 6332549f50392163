"""Folding against exhaustive enumeration, and the shuffles' invariants."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helicase.functions.energy import energies
from helicase.functions.folding import Fold, dot_bracket, encode, pair_list, pair_scores, structure_energy
from helicase.operators import folding as ops
from helicase.operators.shuffled_screen import shuffled_pattern, shuffled_screen

TRNA = [
    "GCCTTGTTGGCGCAATCGGTAGCGCGTATGACTCTTAATCATAAGGTTAGGGGTTCGAGCCCCCTACAGGGCT",
    "GCCTTGTTGGCGCAATCGGTAGCGCGTATGACTCTTAATCATAAGGTTAGGGGTTCGAGCCCCCTACAGGGCT",
    "GCCTTGTTGGCGCAATCGGTAGCGCGTATGACTCTTAATCATAAGGCTAGGGGTTCGAGCCCCCTACAGGGCT",
    "GCTTCAGTAGCTCAGTCGGAAGAGCGTCAGTCTCATAATCTGAAGGTCGAGAGTTCGAACCTCCCCTGGAGCA",
]


def structures(n: int):
    """Every structure of n bases with at least three inside a hairpin."""
    if n <= 0:
        return [""]
    out = ["." + rest for rest in structures(n - 1)]
    for j in range(4, n):
        out += ["(" + a + ")" + b for a in structures(j - 1) for b in structures(n - j - 1)]
    return out


@pytest.mark.parametrize("seq", ["GGGAAACCC", "GCGAAAGCAC", "GGCAUUUGCC", "GGUGAAACUCC"])
def test_fold_is_the_least_of_all_structures(seq):
    e = energies()
    allowed = {"CG", "GC", "GU", "UG", "AU", "UA"}
    own = [s for s in structures(len(seq)) if all(seq[i] + seq[j] in allowed for i, j in pair_list(s))]
    least = min(structure_energy(seq, s, e) if "(" in s else 0.0 for s in own)
    assert Fold([[seq]], e).energy()[0] == pytest.approx(min(least, 0.0), abs=1e-5)


def folded_energy(seq: str, structure: str) -> float:
    """Energy of a structure by a fold in which only its pairs are free, each worth more than any loop costs."""
    n, sure, pairs = len(seq), 1_000_000, pair_list(structure)
    scores = np.full((1, n, n), -10_000, np.int32)
    for i, j in pairs:
        scores[0, i, j] = sure
    return float((Fold([[seq]], energies(), scores=scores).upto[0, n] + sure * len(pairs)) / 100.0)


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_structure_energy_is_that_of_a_fold(data):
    """Any structure, of bases that pair or not: all sorts of loops, up to 30 bases in one."""
    seq = data.draw(st.text("ACGU", min_size=5, max_size=45))
    structure, opened, left = [], [], len(seq)
    for i in range(len(seq)):
        may_close = opened and i - opened[-1] > 3 and "(" not in structure[-3:]
        may_open = left - i > 2 * len(opened) + 5
        c = data.draw(st.sampled_from(["."] * 2 + ["("] * 2 * bool(may_open) + [")"] * 2 * bool(may_close)))
        structure.append(c)
        if c == "(":
            opened.append(i)
        elif c == ")":
            opened.pop()
    for i in opened:
        structure[i] = "."
    text = "".join(structure)
    assert structure_energy(seq, text, energies()) == pytest.approx(folded_energy(seq, text), abs=1e-4)


def test_structure_energy_of_long_sequences():
    import time

    n = 4000
    start = time.perf_counter()
    deep = structure_energy("G" * n + "AAAA" + "C" * n, "(" * n + "...." + ")" * n, energies())
    wide = structure_energy("GGGAAAACCC" * n, "(((....)))" * n, energies())
    assert time.perf_counter() - start < 10 and deep < -10_000 and wide < 0
    assert structure_energy("", "", energies()) == structure_energy("ACGU", "....", energies()) == 0.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ACGU", min_size=40, max_size=40), min_size=1, max_size=3))
def test_structure_has_the_energy_and_batches_agree(seqs):
    e = energies()
    both = Fold([[s] for s in seqs], e)
    for k, s in enumerate(seqs):
        assert both.energy()[k] == Fold([[s]], e).energy()[0]
        structure = dot_bracket(40, both.pairs(k))
        assert structure_energy(s, structure, e) == pytest.approx(both.energy()[k], abs=1e-5)


@pytest.mark.skipif("HELICASE_LOOP_TABLES" not in os.environ, reason="needs the measured tables of small interior loops")
def test_known_alignment():
    """Published energies; the built-in rule for small interior loops is not exact enough for them."""
    with open(os.environ["HELICASE_LOOP_TABLES"]) as f:
        e = energies(f.read())
    folded = Fold([[s.replace("T", "U")] for s in TRNA], e)
    assert folded.energy()[0] == pytest.approx(-29.2, abs=1e-4)
    assert dot_bracket(73, folded.pairs(0)) == "(((((((.(((((........))))...((((.((((....))))))))(((((....)))))).)))))))."
    scores = pair_scores(encode(TRNA))[None]
    consensus = Fold([TRNA], e, scores=scores)
    pairs = consensus.pairs(0)
    assert consensus.energy()[0] == pytest.approx(-26.5, abs=1e-4)
    assert sum(scores[0, i, j] for i, j in pairs) / 400 == pytest.approx(2.875)
    assert ops.combinations(encode(TRNA), pairs) == pytest.approx(1.43, abs=0.005)


@settings(max_examples=30, deadline=None)
@given(st.text("ACGU", min_size=1, max_size=60), st.integers(0, 1000))
def test_shuffles_keep_neighbours(seq, seed):
    rng = np.random.default_rng(seed)
    got = ops.shuffled_pairs(seq, rng)
    assert Counter(zip(got, got[1:])) == Counter(zip(seq, seq[1:])) and got[0] == seq[0]
    assert Counter(ops.shuffled_bases(seq, rng)) == Counter(seq)


def test_operators(spark):
    df = spark.createDataFrame([(1, "GGGGCUUCGGCCCC"), (2, ""), (3, None), (4, "GGGGCUUCGGCCCC")], "id int, seq string")
    got = {r["id"]: r for r in ops.z_scores(df, F.col("seq"), samples=5).collect()}
    assert got[1]["mfe"] == pytest.approx(-12.5, abs=1e-4) and got[1]["z"] == got[4]["z"] < 0
    assert got[2]["mfe"] == 0.0 and got[3]["mfe"] is None
    folded = {r["id"]: r["structure"] for r in ops.fold_mfe(df, F.col("seq")).collect()}
    assert folded == {1: "(((((....)))))", 2: "", 3: None, 4: "(((((....)))))"}
    blocks = spark.createDataFrame([(1, TRNA), (2, []), (3, None)], "b int, rows array<string>")
    made = {r["b"]: r for r in ops.consensus_fold(blocks, F.col("rows")).collect()}
    assert made[1]["consensus_mfe"] == Fold([TRNA], energies(), scores=pair_scores(encode(TRNA))[None]).energy()[0] and made[2]["structure"] is None and made[3]["n_pairs"] is None
    kept = {r["b"]: r["k"] for r in blocks.select("b", ops.select_rows_udf(most=2)("rows").alias("k")).collect()}
    assert kept == {1: [0, 3], 2: None, 3: None}


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.tuples(*[st.sampled_from("ACGU-")] * n), min_size=1, max_size=30)), st.integers(0, 99))
def test_pattern_shuffle_moves_columns_among_their_kind(columns, seed):
    rows = ["".join(r) for r in zip(*columns)]
    got = shuffled_pattern(rows, np.random.default_rng(seed))
    assert Counter(zip(*got)) == Counter(columns)
    kind = lambda col: tuple("-" if c == "-" else col.index(c) for c in col)
    assert [kind(c) for c in zip(*got)] == [kind(c) for c in columns]


def test_shuffled_screen(spark):
    rows = lambda seqs: [(i, 0, "+", s) for i, s in enumerate(seqs)]
    data = [(1, 73, rows(TRNA)), (2, 20, rows(["A" * 20, "A" * 20])), (3, 0, []), (4, 14, rows(["GGGGCUUCGGCCCC"]))]
    df = spark.createDataFrame(data, "block_id long, n_cols int, rows array<struct<idx: int, start: long, strand: string, seq: string>>")
    got = {(r.block_id, r.strand): r for r in shuffled_screen(df, samples=7, threshold=-0.01).collect()}
    assert set(got) == {(b, s) for b in (1, 2, 4) for s in "+-"}
    assert got[2, "+"].mfe == 0.0 and got[2, "+"].z is None and got[2, "-"].mean_mfe is None
    assert got[4, "+"].mfe == pytest.approx(-12.5, abs=1e-4)
    rna = [s.replace("T", "U") for s in TRNA]
    seed = zlib.crc32("\n".join(rna).encode())
    drawn = [shuffled_pattern(rna, np.random.default_rng([seed, i])) for i in range(7)]
    each = [Fold([d], energies(), scores=pair_scores(encode(d))[None]).energy()[0] for d in drawn]
    r = got[1, "+"]
    assert (r.mean_mfe, r.sd_mfe) == (pytest.approx(np.mean(each)), pytest.approx(np.std(each)))
    assert r.z == pytest.approx((r.mfe - np.mean(each)) / np.std(each)) and r.z < 0
    cut = shuffled_screen(df, size=40, step=20, samples=2, strands="+", threshold=-99).orderBy("block_id", "slice_start").collect()
    assert [(r.block_id, r.slice_start, r.slice_end) for r in cut] == [(1, 0, 40), (1, 20, 60), (1, 40, 73), (2, 0, 20), (4, 0, 14)]


def test_samples_of_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.choice(list("ACGU"), 60)
    seqs = []
    for i in range(12):
        own = base.copy()
        at = rng.choice(60, 4 + 2 * i, replace=False)
        own[at] = rng.choice(list("ACGU-"), len(at))
        seqs.append("".join(own))
    got = ops.samples_of_rows(seqs, 3, most=4, least=2, best=0.8, alike=0.95, seed=1)
    assert all(g[0] == 0 and len(g) == 4 == len(set(g)) for g in got) and len(set(map(tuple, got))) > 1
    same = ops.samples_of_rows([seqs[0]] * 5, 2, most=4, least=2, best=0.8, alike=0.95, seed=1)
    assert [len(g) for g in same] == [2, 2]
    blocks = spark.createDataFrame([(1, 60, [(i, s) for i, s in enumerate(seqs)]), (2, 0, []), (3, 3, [(0, "A-C"), (1, "A-G")])],
                                   "block_id int, n_cols int, rows array<struct<idx: int, seq: string>>")
    made = {(r.block_id, r.sample_no): r for r in ops.sample_rows(blocks, samples=2, most=4).collect()}
    assert set(made) == {(1, 1), (1, 2), (3, 1), (3, 2)}
    chosen = blocks.select(ops.select_rows_udf(most=4)(F.transform("rows", lambda r: r["seq"])).alias("k")).first()["k"]
    assert [r.idx for r in made[1, 1].rows] == chosen
    assert made[3, 1].n_cols == 2 and [r.seq for r in made[3, 1].rows] == ["AC", "AG"]


@pytest.mark.parametrize("level", [0, 1, 2])
def test_shuffled_blocks_are_those_of_columns(spark, level):
    from helicase.functions import sequences as sq

    r = random.Random(level)
    rows = [(i, n, [(k, "".join(r.choice("ACGTacgt--N") for _ in range(n))) for k in range(1 + i % 4)]) for i, n in enumerate([1, 2, 30, 57, 200])]
    blocks = spark.createDataFrame(rows, "block_id long, n_cols int, rows array<struct<idx:int,seq:string>>")
    cells = blocks.select("block_id", F.transform("rows", lambda x: F.split(sq.as_rna(F.upper(x["seq"])), "")).alias("cells"))
    columns = cells.select("block_id", F.posexplode(F.transform(F.element_at("cells", 1), lambda _, k: F.array_join(F.transform("cells", lambda x: x[k]), ""))).alias("col", "letters"))
    want = ops.shuffle_columns(columns.select("block_id", F.col("col").cast("long").alias("col"), "letters"), level=level)
    got = ops.shuffle_blocks(blocks, level=level)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("block_id", "col", "letters", F.col("from_col").cast("long").alias("from_col")).collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_structures_cost_no_more_than_a_few_fills():
    """Finding the pairs of a fold looks at each pair's loops as arrays, not size by size."""
    import random
    import time

    draw = random.Random(3)
    seqs = [["".join(draw.choices("ACGU", k=64))] for _ in range(60)]
    Fold(seqs, energies()).pairs(0)
    start = time.process_time()
    folded = Fold(seqs, energies())
    filled = time.process_time()
    for k in range(len(seqs)):
        folded.pairs(k)
    assert time.process_time() - filled < 4 * (filled - start)


def test_alignments_of_nearly_one_width_are_folded_together():
    """Windows lose columns, so no two of a batch need be of one width: they share a fold, and none changes its result."""
    draw = random.Random(8)
    blocks = [["".join(draw.choices("ACGU-", k=n)) for _ in range(3)] for n in (60, 71, 58, 66, 12)]
    assert list(ops.in_batches([len(b[0]) for b in blocks], [3] * 5)) == [[1, 3, 0, 2], [4]]
    assert list(ops.in_batches([9, 9, 9], [2, 3, 2])) == [[0, 2], [1]] and list(ops.in_batches([], [])) == []
    together = Fold(blocks, energies(), consensus=True)
    for k, b in enumerate(blocks):
        scores = pair_scores(encode(b))[None]
        own = Fold([b], energies(), scores=scores)
        pairs = own.pairs(0)
        assert together.energy()[k] == own.energy()[0] and together.pairs(k) == pairs
        assert together.scores_of(k, pairs) == [scores[0, i, j] for i, j in pairs]


@pytest.mark.parametrize("rows", [1, 2, 5, 9])
def test_short_numbers_do_for_energies_that_fit(rows):
    """Energies too low for short numbers, or too many rows: the same results in long ones."""
    draw = random.Random(rows)
    stem = "GGCGCGGCAGCGGCCGACGGCGCCAGGCCG"
    low = stem * 2 + "GAAA" + ("".join(dict(zip("ACGU", "UGCA"))[c] for c in reversed(stem))) * 2
    mild = "".join(draw.choices("ACGU", k=90))
    for seq, kind in ((low, np.int32), (mild, np.int16 if rows < 9 else np.int32)):
        block = [seq] * rows
        got = Fold([block], energies(), consensus=True)
        want = Fold([block], energies(), scores=pair_scores(encode(block))[None])
        assert got.c.dtype == kind and want.c.dtype == np.int32
        assert got.energy()[0] == want.energy()[0] and got.pairs(0) == want.pairs(0)


def test_folds_in_one_room():
    from helicase.functions.folding import Room

    draw, room = random.Random(2), Room()
    for n in (50, 90, 30, 7, 3):
        seqs = [["".join(draw.choices("ACGU", k=n))] for _ in range(4)]
        first, again = Fold(seqs, energies()), Fold(seqs, energies(), room=room)
        assert (first.energy() == again.energy()).all() and [first.pairs(k) for k in range(4)] == [again.pairs(k) for k in range(4)]
