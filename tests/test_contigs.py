"""Chunks of contigs, and what loci read from them."""

import random

import pytest
from pyspark.sql import functions as F

from helicase.operators import contigs as cg


def genome(seed=2):
    r = random.Random(seed)
    return {"chr1": "".join(r.choice("ACGTacgtN") for _ in range(1000)), "chr2.fa": "".join(r.choice("ACGT") for _ in range(64)), "tiny": "A", "hg.chrX": "C" * 70 + "G" * 70}


def comp(s):
    return s[::-1].translate(str.maketrans("AGCTUagctu", "TCGAAtcgaa"))


def test_chunks_of_files_in_small_splits(spark, tmp_path):
    seqs = genome()
    text = "".join(f">{n} about it\n" + "".join(s[i:i + w] + "\n" for i in range(0, len(s), w)) for (n, s), w in zip(seqs.items(), (60, 7, 60, 33)))
    (tmp_path / "g.fa").write_text(text + ">empty\n>last\nACGT\n\nAC")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        chunks = cg.read_contigs(spark, str(tmp_path / "g.fa"), size=50)
        got = chunks.collect()
        assert spark.read.text(str(tmp_path / "g.fa")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    joined = {}
    for r in sorted(got, key=lambda r: (r.contig, r.chunk)):
        assert len(r.bases) <= 50
        joined[r.contig] = joined.get(r.contig, "") + r.bases
    assert joined == seqs | {"last": "ACGTAC"}
    cut = cg.cut(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), size=50)
    assert {(r.contig, r.chunk, r.bases) for r in cut.collect()} == {(r.contig, r.chunk, r.bases) for r in got if r.contig != "last"}


def asked():
    r = random.Random(3)
    rows = [(i, "chr1", a := r.randrange(0, 1000), a + r.randrange(0, 300), r.choice("+-")) for i in range(60)]
    return rows + [(100, "hg.chr1", 49, 51, "-"), (101, "mm.chr2", 0, 64, "+"), (102, "nowhere", 1, 5, "+"), (103, "chr1", 5, 5, "+"), (104, "hg.chrX", 60, 80, "-"),
                   (105, "tiny", 0, 10, "-"), (106, None, 1, 2, "+"), (107, "chr1", -5, 3, "+")]


@pytest.mark.parametrize("stored", [False, True])
def test_loci(spark, tmp_path, stored):
    seqs = genome()
    chunks = cg.cut(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), size=50)
    if stored:
        cg.write_chunks(chunks, str(tmp_path / "chunks"))
        chunks = cg.read_chunks(spark, str(tmp_path / "chunks"))
    loci = spark.createDataFrame(asked(), "id long, seq_id string, start long, end long, strand string")
    got = cg.locus_sequences(loci, chunks, key=["id"], size=50)
    rows = {r.id: (r.contig, r.sequence) for r in got.collect()}
    named = {"hg.chr1": "chr1", "mm.chr2": "chr2.fa"}
    for i, seq, start, end, strand in asked():
        contig = named.get(seq, seq)
        part = seqs.get(contig, "")[max(start, 0):end] if contig else ""
        assert rows[i] == (contig if contig in seqs else None, comp(part) if strand == "-" else part), i


def test_only_touched_zones_are_read(spark, tmp_path):
    seqs = [(f"c{k}", "ACGT" * 2000) for k in range(6)]
    cg.write_chunks(cg.cut(spark.createDataFrame(seqs, "seq_id string, seq string"), size=10), str(tmp_path / "chunks"))
    chunks = cg.read_chunks(spark, str(tmp_path / "chunks"))
    loci = spark.createDataFrame([(1, "c3", 5, 25, "+")], "id long, seq_id string, start long, end long, strand string")
    got = cg.locus_sequences(loci, chunks, key=["id"], size=10)
    assert got.first().sequence == ("ACGT" * 10)[5:25]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_fasta(spark):
    row = spark.range(1).select(cg.fasta_text(cg.locus_title(F.lit("locus1"), F.lit("hg.chr1"), F.lit(5), F.lit(9), F.lit("+")), F.lit("A" * 125)).alias("t"), cg.fasta_text(F.lit("x"), F.lit("C" * 60)).alias("u")).first()
    assert row.t == ">locus1 (hg.chr1:5..9,+)\n" + "A" * 60 + "\n" + "A" * 60 + "\nAAAAA\n"
    assert row.u == ">x\n" + "C" * 60 + "\n"
