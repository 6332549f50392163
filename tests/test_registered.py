"""Functions in SQL text against the DataFrame operators."""

import random

import pytest
from pyspark.sql import functions as F

from helicase.functions import sequences as sq
from helicase.functions.registered import register_functions
from helicase.operators import intervals, models
from helicase.operators.blocks import slide_windows
from helicase.operators.slices import slice_columns

ROW = "struct<idx:int,name:string,start:bigint,end:bigint,strand:string,seq:string>"


@pytest.fixture(scope="module")
def blocks(spark):
    assert len(register_functions(spark)) > 8
    r = random.Random(6)
    rows = []
    for i, width in enumerate([1, 39, 40, 41, 59, 60, 61, 100, 173]):
        rows.append((i, width, [(k, f"s{k}", 100 * k, 100 * k + width, r.choice("+-"), "".join(r.choice("ACGT-a.") for _ in range(width))) for k in range(3)]))
    frame = spark.createDataFrame([*rows, (99, 0, [])], f"block_id long, n_cols int, rows array<{ROW}>")
    frame.createOrReplaceTempView("blocks")
    return frame


def test_windows(spark, blocks):
    got = spark.sql("SELECT block_id, w.* FROM blocks b, LATERAL slide_windows(b.rows, b.n_cols, 40, 20) w")
    want = slide_windows(blocks, size=40, step=20).select("block_id", "slice_start", "slice_end", "n_cols", F.transform("rows", lambda r: r.dropFields("end")).alias("rows"))
    plain = got.withColumn("rows", F.transform("rows", lambda r: r.dropFields("end")))
    assert sorted(map(str, plain.collect())) == sorted(map(str, want.collect())) and got.count() > 20
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_slices(spark, blocks):
    got = spark.sql("SELECT block_id, w.* FROM blocks b, LATERAL slice_columns(b.rows, b.n_cols, 30, 50) w")
    flat = blocks.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("idx", "name", "start", "end", "strand", "seq")], (r["end"] - r["start"]).alias("length"))))
    want = slice_columns(flat, F.lit(30), F.lit(50)).select("block_id", "slice_start", "slice_end", "n_cols", F.transform("rows", lambda r: r.dropFields("length")).alias("rows"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 8


def test_scalars(spark, blocks):
    got = spark.sql("""SELECT ungapped('A-C.G') AS u, as_rna('acTg') AS r, reverse_complement('AACGu') AS c, gc_share('ACGU-n') AS g, gc_share('') AS none,
        contig_name('hg.17.chr1') AS y, contig_name('chr1') AS n, svm_probability(0.5, -2, 0.1) AS p, conservation_index(-5, -10) AS s, conservation_index(-5, 0) AS s0,
        z_score(-10, -5, 2.5) AS z, z_score(1, 0, 0) AS z0, position_of_column('A-CG', 10, 3) AS at""").first()
    want = spark.range(1).select(
        models.probability(F.lit(0.5), -2, 0.1).alias("p"), intervals.contig_key(F.lit("hg.17.chr1")).alias("y"), sq.reverse_complement_dna(F.lit("AACGu")).alias("c"), sq.gc_share(F.lit("ACGU")).alias("g")).first()
    assert (got.u, got.r, got.n, got.s, got.s0, got.z, got.z0, got["at"], got.none) == ("ACG", "ACUG", "chr1", 0.5, 0.0, -2.0, 0.0, 12, 0.0)
    assert (got.p, got.y, got.c, got.g) == (pytest.approx(want.p), want.y, want.c, want.g)
    assert [r.bin for r in spark.sql("SELECT * FROM interval_bins(5, 25, 10)").collect()] == [0, 1, 2]
