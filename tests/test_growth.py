"""What a query works on grows no faster than its answer asks for: copies, narrow ranges, small chunks."""

import pytest

from helicase.operators import block_index as bi
from helicase.operators import contigs as cg
from helicase.sources.datasource import LEAST_TASKS, register_sources

from .test_alignment_source import maf
from .test_contigs import asked, comp, genome


def test_narrow_ranges_are_read_several_to_a_task(spark, tmp_path):
    register_sources(spark)
    for k in range(3):
        (tmp_path / f"{k}.maf").write_text(maf(60, seed=k))
    total = sum(p.stat().st_size for p in tmp_path.iterdir())
    load = lambda width: spark.read.format("alignments").option("partitionBytes", width).load(str(tmp_path))
    want = sorted(str(r) for r in load(1 << 20).collect())
    narrow = load(100)
    assert total / 100 > 2 * LEAST_TASKS
    assert LEAST_TASKS <= narrow.rdd.getNumPartitions() < 2 * LEAST_TASKS
    assert sorted(str(r) for r in narrow.collect()) == want


def test_features_of_one_start_ask_once(spark, tmp_path, monkeypatch):
    """Copies and shorter features of a start don't reach the join, and the blocks are those under all of them."""
    register_sources(spark)
    (tmp_path / "x.maf").write_text(maf(40))
    index = bi.block_index(spark.read.format("alignments").load(str(tmp_path)))
    asked = []
    join = bi.overlap_join
    monkeypatch.setattr(bi, "overlap_join", lambda left, right: asked.append(left.count()) or join(left, right))
    features = [("chr1", at, at + width) for at in range(0, 900, 50) for width in (-3, 0, 1, 2, 30, 30)] + [(None, 1, 9), ("chr1", None, 9), ("chr1", 5, None)]
    got = bi.blocks_under(spark.createDataFrame(features, "seq_id string, start long, end long"), index)
    want = {(r.file, r.offset) for r in index.collect() for s, lo, hi in features
            if None not in (s, lo, hi) and r.seq_id == s and r.start < hi and lo < r.end and lo < hi and r.start < r.end}
    assert [(r.file, r.offset) for r in got.orderBy("offset").collect()] == sorted(want) and want
    assert asked == [19]  # 18 starts, and the one without a name


@pytest.mark.parametrize("width, few", [(1, 100_000), (120, 0), (1 << 12, 100_000)])
def test_loci_in_runs_of_any_width(spark, monkeypatch, width, few):
    """Loci over borders, beyond ends, empty, without a name or an end, and of names that are looked up, however few of those are sent to all tasks."""
    monkeypatch.setattr(cg, "FEW_NAMES", few)
    seqs = genome()
    chunks = cg.cut(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), size=50)
    rows = [*asked(), (200, "chr1", 990, 1300, "-"), (201, "chr1", 1200, 1400, "+"), (202, "chr1", 40, 10, "+"), (203, "chr1", 10**12, 5, "-"), (204, "nowhere", 10, 400, "+")]
    loci = spark.createDataFrame([*rows, (300, "chr1", 3, None, "+")], "id long, seq_id string, start long, end long, strand string")
    got = {r.id: (r.contig, r.sequence) for r in cg.locus_sequences(loci, chunks, key=["id"], size=50, width=width).collect()}
    want = {300: ("chr1", "")}
    for i, seq, start, end, strand in rows:
        contig = {"hg.chr1": "chr1", "mm.chr2": "chr2.fa"}.get(seq, seq)
        part = seqs.get(contig, "")[max(start, 0):end]
        want[i] = contig if contig in seqs else None, comp(part) if strand == "-" else part
    assert got == want


def test_loci_are_dealt_once(spark):
    """Loci under their contigs' own names meet the chunks and nothing else; small chunks come in runs."""
    chunks = cg.cut(spark.createDataFrame([("c1", "ACGT" * 200), ("c2", "GGCA" * 90)], "seq_id string, seq string"), size=10)
    loci = spark.range(500).selectExpr("id", "concat('c', id % 2 + 1) AS seq_id", "id AS start", "id + 12 AS end", "'+' AS strand")
    found = cg.locus_sequences(loci, chunks, key=["id"], size=10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2, plan  # loci within a run, and loci over a border
    assert {r.id: r.sequence for r in found.collect()} == {i: (("GGCA" * 90) if i % 2 else ("ACGT" * 200))[i:i + 12] for i in range(500)}
    assert cg.runs(chunks, 10)[0].count() == 2
