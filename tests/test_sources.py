"""Readers, writers and the stream on small files."""

from pyspark.sql import functions as F

from helicase.sources import alignments as io
from helicase.streaming import screen as stream

MAF = """##maf version=1
a score=0
s hg16.chr1 10 5 + 100 ACG.TA
s mm6.chr2   3 6 -  50 ACGTTA

a score=1
s hg16.chr1 40 3 + 100 AC-G
"""


def test_maf_round_trip(spark, tmp_path):
    (tmp_path / "x.maf").write_text(MAF)
    got = io.read_maf(spark, str(tmp_path / "x.maf"))
    rows = got.orderBy(F.desc("n_cols")).collect()
    assert [len(r["rows"]) for r in rows] == [2, 1]
    first, second = rows[0]["rows"]
    assert (first["org"], first["chrom"], first["start"], first["seq"]) == ("hg16", "chr1", 10, "ACG-TA")
    assert (second["start"], second["end"]) == (41, 47)
    io.write_text(got, io.maf_text(F.col("rows")), str(tmp_path / "out"))
    again = io.read_maf(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.select("rows").collect())) == sorted(map(str, got.select("rows").collect()))


def test_clustal(spark, tmp_path):
    (tmp_path / "x.aln").write_text("CLUSTAL W (1.8)\n\n\nb   ACGT\na   AC.T\n    ** *\n\nb   GG\na   GC\n")
    got = io.read_clustal(spark, str(tmp_path / "x.aln"))
    assert [(r["name"], r["seq"]) for r in got.first()["rows"]] == [("b", "ACGTGG"), ("a", "AC-TGC")]
    io.write_text(got, io.clustal_text(F.col("rows"), width=4), str(tmp_path / "out"))
    again = io.read_clustal(spark, str(tmp_path / "out" / "*.txt"))
    assert again.first()["rows"] == got.first()["rows"]


def test_fasta_and_bed(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    assert {r["seq_id"]: r["seq"] for r in io.read_fasta(spark, str(tmp_path / "x.fa")).collect()} == {"one": "ACGTAC", "two": "GG"}
    (tmp_path / "x.bed").write_text("track name=x\nchr1\t5\t9\tgene\nchr2\t1\t2\n")
    got = io.read_bed(spark, str(tmp_path / "x.bed")).orderBy("start").collect()
    assert [tuple(r) for r in got] == [("chr2", 1, 2, None), ("chr1", 5, 9, "gene")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.maf").write_text(MAF)
    for _ in range(2):
        stream.screen(stream.stream_maf(spark, str(tmp_path / "in")), stream.reference_rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["seq_id"], r["start"], r["n_rows"]) for r in got] == [("hg16.chr1", 10, 2), ("hg16.chr1", 40, 1)]
