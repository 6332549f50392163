"""The alignment source, its index, and the report sink."""

import random

import pytest
from pyspark.sql import functions as F

from helicase.operators.block_index import block_index, blocks_numbered, blocks_under, fetch, file_and_place, numbered
from helicase.sources import alignments as io
from helicase.sources.datasource import format_of, register_sources
from helicase.sources.files import listed, opened, records
from helicase.sources.report_sink import write_screen
from helicase.sources.reports import HIT_COLUMNS, LOCUS_COLUMNS, read_screen

TWO = "CLUSTAL W (1.8)\n\n\nb   ACGT\na   AC.T\n    ** *\n\nb   GG\na   GC\n\n\nCLUSTAL O(1.2.4)\n\nx  TTTT 4\ny  TT-T 3\nz  TTAT\n\n"


@pytest.fixture(scope="module")
def source(spark):
    register_sources(spark)
    return spark.read.format("alignments")


def maf(n: int, seed: int = 1, organism: str = "hg") -> str:
    r = random.Random(seed)
    out = ["##maf version=1\n"]
    at = 100
    for i in range(n):
        width = r.randrange(3, 40)
        rows = [("".join(r.choice("ACGT-a") for _ in range(width))) for _ in range(r.randrange(1, 5))]
        bases = [len(x.replace("-", "")) for x in rows]
        lines = [f"s {organism if k == 0 else f'sp{k}'}.chr{1 + i % 3} {at} {b} {'+' if k == 0 else '-'} 100000 {x}\n" for k, (x, b) in enumerate(zip(rows, bases))]
        out += [f"a score={i}\n", *lines, "\n"]
        at += bases[0] + r.randrange(0, 30)
    return "".join(out)


def told(df):
    return sorted((r.file.removeprefix("file:").replace("///", "/"), str(r.rows), r.n_cols) for r in df.collect())


def test_several_alignments_of_one_file(spark, source, tmp_path):
    (tmp_path / "two.aln").write_text(TWO)
    rows = source.load(str(tmp_path / "two.aln")).orderBy("offset").collect()
    assert [[(x.name, x.seq) for x in r.rows] for r in rows] == [[("b", "ACGTGG"), ("a", "AC-TGC")], [("x", "TTTT"), ("y", "TT-T"), ("z", "TTAT")]]
    assert [(r.format, r.n_cols, r.offset) for r in rows] == [("clustal", 6, 0), ("clustal", 4, TWO.index("CLUSTAL O"))]
    text = io.read_clustal(spark, str(tmp_path / "two.aln")).collect()
    assert sorted([(x.name, x.seq) for x in r.rows] for r in text) == sorted([(x.name, x.seq) for x in r.rows] for r in rows)


@pytest.mark.parametrize("body, what", [
    ("a  ACGT\nb  ACGT\n\nb  AC\na  AC\n", "names differ"), ("a  ACGT\nb  ACG\n", "different lengths"), ("a  AC\nb  AC\n\na  AC\n", "names differ")])
def test_broken_clustal(spark, source, tmp_path, body, what):
    (tmp_path / "x.aln").write_text("CLUSTAL W\n\n" + body)
    with pytest.raises(Exception, match=what):
        io.read_clustal(spark, str(tmp_path / "x.aln")).collect()
    with pytest.raises(Exception, match=what):
        source.load(str(tmp_path / "x.aln")).collect()


def test_two_rows_of_one_name(spark, tmp_path):
    (tmp_path / "x.aln").write_text("CLUSTAL W\n\na  AC\na  GT\n\na  AA\na  CC\n")
    assert [(r.name, r.seq) for r in io.read_clustal(spark, str(tmp_path / "x.aln")).first().rows] == [("a", "ACAA"), ("a", "GTCC")]


@pytest.mark.parametrize("width", [40, 64, 500, 10_000_000])
def test_any_cut_gives_the_same_blocks(spark, source, tmp_path, width):
    (tmp_path / "x.maf").write_text(maf(12))
    (tmp_path / "y.aln").write_text(TWO)
    (tmp_path / "_hidden").write_text("nothing")
    got = spark.read.format("alignments").option("partitionBytes", width).load(str(tmp_path))
    plain = io.read_maf(spark, str(tmp_path / "x.maf"))
    assert [(r, n) for f, r, n in told(got) if f.endswith("x.maf")] == [(r, n) for _, r, n in told(plain)]
    assert sum(f.endswith("y.aln") for f, _, _ in told(got)) == 2
    if width == 64:
        assert got.rdd.getNumPartitions() > 20


def test_records_are_whole_at_every_border(tmp_path):
    (tmp_path / "x.maf").write_text(maf(4))
    size = (tmp_path / "x.maf").stat().st_size
    whole = list(records(opened(str(tmp_path / "x.maf")), b"a", 0, None))
    for cut in range(1, size):
        parts = [r for lo, hi in ((0, cut), (cut, size)) for r in records(opened(str(tmp_path / "x.maf")), b"a", lo, hi)]
        assert parts == whole


def test_gzip_and_formats(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "x.maf.gz", "wt") as f:
        f.write(maf(5))
    register_sources(spark)
    assert spark.read.format("alignments").option("partitionBytes", 50).load(str(tmp_path / "x.maf.gz")).count() == 5
    (tmp_path / "c.aln").write_text("\n# comment\nCLUSTAL W\n")
    (tmp_path / "u.txt").write_text("something\n")
    (tmp_path / "e.txt").write_text("\n\n")
    assert [format_of(str(tmp_path / n)) for n in ("x.maf.gz", "c.aln", "u.txt")] == ["maf", "clustal", "unknown"]
    with pytest.raises(ValueError):
        format_of(str(tmp_path / "e.txt"))
    with pytest.raises(FileNotFoundError):
        listed(str(tmp_path / "absent"))


def test_features_read_only_what_they_touch(spark, source, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.maf").write_text(maf(30, seed=k, organism=f"o{k}").replace(f"o{k}.chr", f"o{k}.s{k}chr"))
    blocks = source.load(str(tmp_path / "*.maf"))
    index = block_index(blocks)
    every = {(r.file, r.offset): r for r in blocks.collect()}
    features = [("s0chr1", 120, 200), ("s2chr2", 0, 10_000), ("s2chr2", 300, 310), ("none", 1, 5), ("s0chr1", 100, 100)]
    got = blocks_under(spark.createDataFrame(features, "seq_id string, start long, end long"), index).collect()
    want = {k for k, r in every.items() for s, lo, hi in features
            if r.rows[0].chrom == s and r.rows[0].start < hi and lo < r.rows[0].end and lo < hi}
    assert {(r.file, r.offset) for r in got} == want and len(got) == len(want) > 5
    assert all(str(every[r.file, r.offset]) == str(r) for r in got)
    assert {r.file for r in got} == {f for f, _ in every if f.endswith(("0.maf", "2.maf"))}
    # files that hold nothing asked for are never opened
    (tmp_path / "1.maf").unlink()
    (tmp_path / "3.maf").unlink()
    index = spark.createDataFrame(
        [(f, o, r.size, r.format, len(r.rows), r.n_cols, r.rows[0].chrom, r.rows[0].start, r.rows[0].end) for (f, o), r in every.items()], "file string, offset long, size long, format string, n_rows int, n_cols int, seq_id string, start long, end long")
    again = blocks_under(spark.createDataFrame(features, "seq_id string, start long, end long"), index)
    assert {(r.file, r.offset) for r in again.collect()} == want


def test_blocks_by_number(spark, source, tmp_path):
    for k in range(3):
        (tmp_path / f"x.{k + 1}.maf").write_text(maf(20, seed=k))
    index = numbered(block_index(source.load(str(tmp_path))))
    rows = index.orderBy("block_no").collect()
    assert [r.block_no for r in rows] == list(range(1, len(rows) + 1)) and all(r.n_rows > 1 for r in rows)
    assert [(r.file, r.offset) for r in rows] == sorted((r.file, r.offset) for r in rows)
    got = blocks_numbered(spark.createDataFrame([(3,), (3,), (30,), (1000,)], "block_no long"), index).orderBy("block_no").collect()
    assert [(r.block_no, r.file, r.offset) for r in got] == [(n, rows[n - 1].file, rows[n - 1].offset) for n in (3, 30)]
    assert fetch(index).count() == len(rows)
    places = spark.range(1, 301).select(*[c.alias(n) for c, n in zip(file_and_place(F.col("id"), 100), ("f", "p"))], "id").collect()
    assert [(r.f, r.p) for r in places] == [((i + 99) // 100, i - 100 * ((i + 99) // 100 - 1)) for i in range(1, 301)]


def hits(n: int):
    r = random.Random(4)
    rows = []
    for i in range(n):
        start = r.randrange(10_000)
        rows.append((f"window{i}", f"locus{i % 7}", f"chr{i % 7 % 3}", start, start + 50, "+", 4, 120, *[round(r.random(), 4) for _ in range(11)]))
    return rows


def test_report_sink(spark, tmp_path):
    register_sources(spark)
    kinds = ["string"] * 3 + ["long"] * 2 + ["string"] + ["long"] * 2 + ["double"] * 11
    frame = spark.createDataFrame(hits(300), ", ".join(f"{c} {k}" for c, k in zip(HIT_COLUMNS, kinds)))
    loci = frame.groupBy("locus_id", "seq_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("n").alias("max_n"), F.max("identity").alias("max_identity"),
        F.max("p").alias("max_p"), F.min("z").alias("min_z")).select(*LOCUS_COLUMNS)
    out = str(tmp_path / "report")
    write_screen(frame, loci, out, files=6)
    files = sorted((tmp_path / "report").glob("part-*"))
    assert len(files) > 4 and (tmp_path / "report" / "_SUCCESS").exists() and not list((tmp_path / "report").glob("_writing*"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert [x.startswith("#") for x in lines[:3]] == [True, True, False] and sum(x.startswith("#") for x in lines) == 2
    body = [x.split("\t") for x in lines[2:]]
    current = None
    for cells in body:
        if cells[0].startswith("locus"):
            current = cells[0]
        else:
            assert cells[1] == current
    assert [c[0] for c in body if c[0].startswith("locus")] == [r.locus_id for r in loci.orderBy("seq_id", "start", "locus_id").collect()]
    back_hits, back_loci = read_screen(spark, out + "/part-*")
    assert sorted(map(str, back_hits.select(*HIT_COLUMNS).collect())) == sorted(map(str, frame.collect()))
    assert sorted(map(str, back_loci.select(*LOCUS_COLUMNS).collect())) == sorted(map(str, loci.collect()))
    with pytest.raises(Exception, match="holds a report"):
        write_screen(frame, loci, out)
    write_screen(frame.where("locus_id = 'locus1'"), loci.where("locus_id = 'locus1'"), out, files=2, mode="overwrite", header=False)
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "report").glob("part-*")) == 1 + frame.where("locus_id = 'locus1'").count()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    register_sources(spark)
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("value"))
    out = tmp_path / "report"
    with pytest.raises(Exception, match="broken"):
        broken.write.format("screen_report").mode("append").save(str(out))
    assert list(out.iterdir()) == []


def test_reports_in_order(spark, tmp_path):
    from helicase.sources.report_sink import write_reports
    from helicase.sources.reports import FIELDS, REPORT_ROW, read_reports

    register_sources(spark)
    r = random.Random(2)
    rows = []
    for i in range(60):
        values = [i if kind == "int" else f"text {i}" if kind == "string" else round(r.uniform(-9, 9), 2) for _, _, _, kind in FIELDS]
        seq, start = f"chr{i % 3}", r.randrange(1000)
        rows.append((*values, [(seq, start, start + 8, "+", 5000, "ACGUACGU", "((....))", -1.5, -0.25, "R")], "ACGUACGU", "((....))", seq, start))
    kinds = ", ".join(f"{n} {k}" for n, _, _, k in FIELDS)
    frame = spark.createDataFrame(rows, f"{kinds}, rows array<{REPORT_ROW}>, consensus string, structure string, seq_id string, start long")
    write_reports(frame, str(tmp_path / "out"), files=5)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) > 3
    heads = [x.split()[:2] for f in files for x in f.read_text().splitlines() if x.startswith(">chr")]
    assert heads == sorted(heads, key=lambda h: (h[0], int(h[1]))) and len(heads) == 60
    back = read_reports(spark, str(tmp_path / "out" / "part-*"))
    got = sorted((x.seq_id, x.start, x.n, x.z, x.prediction) for x in back.collect())
    assert got == sorted((x[-2], x[-1], x[0], x[[n for n, *_ in FIELDS].index("z")], x[[n for n, *_ in FIELDS].index("prediction")]) for x in rows)
