"""Reading and writing alignments, sequences and interval tracks as plain text.

Readers are ``spark.read.text`` (gzip by suffix) with the record separator of
the format, so files are split, pruned and retried by Spark; parsing is
column expressions.  A block is ``rows``, an array of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A MAF block starts at a line of its own that begins with ``a``.
MAF_SEPARATOR = "\na"


def maf_rows(record: Column, *, forward: bool = True) -> Column:
    """The ``s`` lines of a MAF record; with ``forward``, starts of minus rows count from the forward strand's start.

    A line that lacks a field is an error, not a dropped row.
    """
    fields = F.transform(F.filter(F.split(record, "\n"), lambda l: l.rlike(r"^s\s")), lambda l: F.split(F.trim(l), r"\s+"))

    def row(f: Column, i: Column) -> Column:
        start, length, full = f[2].cast("long"), f[3].cast("long"), f[5].cast("long")
        minus = f[4] == "-"
        from_start = F.when(minus, full - start - length).otherwise(start) if forward else start
        dotted = f[1].contains(".")
        made = F.struct(
            i.alias("idx"), f[1].alias("name"),
            F.when(dotted, F.regexp_extract(f[1], r"^(\w+)\.(.*)$", 1)).otherwise(f[1]).alias("org"),
            F.when(dotted, F.regexp_extract(f[1], r"^(\w+)\.(.*)$", 2)).alias("chrom"),
            from_start.alias("start"), (from_start + length).alias("end"), length.alias("length"), full.alias("full_length"),
            f[4].alias("strand"), F.translate(f[6], ".", "-").alias("seq"))
        return F.when(F.size(f) == 7, made).otherwise(F.raise_error(F.concat(F.lit("not a MAF row: "), F.array_join(f, " "))).cast(
            "struct<idx:int,name:string,org:string,chrom:string,start:bigint,end:bigint,length:bigint,full_length:bigint,strand:string,seq:string>"))

    return F.transform(fields, row)


def maf_blocks(text: DataFrame, *, forward: bool = True) -> DataFrame:
    """Blocks of records in column ``value``; those without rows, such as the header, go."""
    found = text.withColumn("rows", maf_rows(F.col("value"), forward=forward)).where(F.size("rows") > 0).drop("value")
    return found.withColumn("n_cols", F.length(F.col("rows")[0]["seq"]))


def read_maf(spark: SparkSession, path: str | list[str], *, forward: bool = True) -> DataFrame:
    """``file, rows, n_cols`` of every block."""
    text = spark.read.text(path, lineSep=MAF_SEPARATOR).select("value", F.col("_metadata.file_path").alias("file"))
    return maf_blocks(text, forward=forward)


#: Every CLUSTAL alignment of a file begins with a line of its own that starts with this word.
CLUSTAL_SEPARATOR = "\nCLUSTAL"
CLUSTAL_ROW = r"^(?!//)[^\s#]+\s+[A-Za-z.-]+(\s+\d+)?\s*$"


def clustal_rows(record: Column) -> Column:
    """The rows of one CLUSTAL alignment; the rest of its header line comes first and is passed over.

    The first run of sequence lines tells how many rows there are; in every
    later chunk the same names must follow in the same order, and all rows must
    come out equally long.  Anything else is an error.
    """
    lines = F.split(record, "\n")
    below = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    is_row = lambda l: l.rlike(CLUSTAL_ROW)
    cells = F.transform(F.filter(below, is_row), lambda l: F.split(F.trim(l), r"\s+"))
    marks = F.array_join(F.transform(below, lambda l: F.when(is_row(l), "1").otherwise("0")), "")
    n = F.length(F.regexp_extract(marks, "^0*(1+)", 1))
    numbered = F.transform(cells, lambda c, i: F.struct(i.alias("i"), c[0].alias("name"), c[1].alias("part")))

    def row(i: Column) -> Column:
        own = F.filter(numbered, lambda c: c["i"] % n == i)
        return F.struct(
            i.alias("idx"), own[0]["name"].alias("name"), F.translate(F.array_join(F.transform(own, lambda c: c["part"]), ""), ".", "-").alias("seq"))

    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), row)).otherwise(F.array().cast("array<struct<idx:int,name:string,seq:string>>"))
    named = (n == 0) | F.forall(numbered, lambda c: c["name"] == numbered[c["i"] % n]["name"]) & (F.size(cells) % F.greatest(n, F.lit(1)) == 0)
    level = F.size(F.array_distinct(F.transform(rows, lambda r: F.length(r["seq"])))) <= 1

    def refused(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what} in the alignment of "), F.array_join(F.transform(rows, lambda r: r["name"]), ", "))).cast(
            "array<struct<idx:int,name:string,seq:string>>")

    return F.when(~named, refused("names differ between chunks")).when(~level, refused("rows of different lengths")).otherwise(rows)


def read_clustal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, rows, n_cols`` of every alignment, however many a file holds."""
    text = spark.read.text(path, lineSep=CLUSTAL_SEPARATOR).select("value", F.col("_metadata.file_path").alias("file"))
    blocks = text.withColumn("rows", clustal_rows(F.col("value"))).where(F.size("rows") > 0)
    return blocks.select("file", "rows", F.length(F.col("rows")[0]["seq"]).alias("n_cols"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``seq_id, seq``: a record for each header."""
    text = spark.read.text(path, lineSep="\n>")
    head = F.regexp_replace(F.split("value", "\n")[0], "^>", "")
    return text.where(F.length(F.trim("value")) > 0).select(
        F.split(head, r"\s+")[0].alias("seq_id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``seq_id, start, end, name``; lines with ``track`` and comments go."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").contains("track") & ~F.col("value").startswith("#") & (F.size(parts) >= 3))
    return lines.select(parts[0].alias("seq_id"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"), F.get(parts, F.lit(3)).alias("name"))


def maf_text(rows: Column) -> Column:
    """A block as MAF, with starts of minus rows counted from the strand's own start again."""
    def line(r: Column) -> Column:
        start = F.when(r["strand"] == "-", r["full_length"] - r["end"]).otherwise(r["start"])
        return F.concat_ws(" ", F.lit("s"), r["name"], start, r["length"], r["strand"], r["full_length"], r["seq"])

    return F.concat(F.lit("a score=0\n"), F.array_join(F.transform(rows, line), "\n"), F.lit("\n"))


def clustal_text(rows: Column, *, width: int = 60) -> Column:
    """A block as CLUSTAL: chunks of ``width`` columns, names padded to six more than the longest."""
    pad = F.array_max(F.transform(rows, lambda r: F.length(r["name"]))) + 6
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(rows[0]["seq"]) - 1) / width).cast("int")))
    body = F.transform(chunks, lambda k: F.array_join(F.transform(rows, lambda r: F.concat(
        F.rpad(r["name"], pad, F.lit(" ")), F.substring(r["seq"], k * width + 1, F.lit(width)))), "\n"))
    return F.concat(F.lit("CLUSTAL W\n\n\n"), F.array_join(body, "\n\n"), F.lit("\n"))


def write_text(df: DataFrame, value: Column, path: str, *, mode: str = "errorifexists", per_file: int = 0) -> None:
    """One record per row of ``df``; at most ``per_file`` to a file, if given."""
    writer = df.select(value.alias("value")).write.mode(mode)
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).text(path)


def sniff_format(spark: SparkSession, path: str | list[str], *, loose: bool = False) -> str:
    """``clustal``, ``maf`` or ``unknown``, by the first line of the input that is neither empty nor a comment.

    ``loose`` takes the word anywhere in the line and in any case, and any
    line that begins with ``a``.  An empty input is an error.
    """
    text = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).head(1)
    if not text:
        raise ValueError(f"{path}: empty alignment file")
    line = text[0][0]
    words = line.split()
    if "clustal" in line.lower() if loose else words[0] == "CLUSTAL":
        return "clustal"
    return "maf" if (line.startswith("a") if loose else words[0] == "a") else "unknown"


def read_alignments(spark: SparkSession, path: str | list[str], *, format: str = "auto") -> DataFrame:
    """``file, rows, n_cols`` of alignments of either format; ``auto`` looks at the first line."""
    kind = sniff_format(spark, path, loose=True) if format == "auto" else format
    readers = {"maf": read_maf, "clustal": read_clustal}
    if kind not in readers:
        raise ValueError(f"{path}: not an alignment format: {kind}")
    return readers[kind](spark, path)


def numbered_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` of one file with ``block_no``, from 0 in the file's order; to take one out, filter by it.

    Blocks are counted per partition of the file first, so none is gathered.
    """
    placed = blocks.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    first = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("_low"))
    from pyspark.sql import Window

    # one row per partition
    ahead = first.select("_part", "_low", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_ahead"))
    return placed.join(F.broadcast(ahead), "_part").withColumn("block_no", F.col("_id") - F.col("_low") + F.col("_ahead")).drop("_part", "_id", "_low", "_ahead")


def named_ranges(rows: Column) -> Column:
    """Rows of a CLUSTAL alignment whose names end in ``/start-end``, with ``name, start, end`` taken apart; null positions elsewhere."""
    part = lambda r, i: F.nullif(F.regexp_extract(r["name"], r"^(.*)/(\d+)-(\d+)$", i), F.lit(""))
    return F.transform(rows, lambda r: F.struct(
        r["idx"].alias("idx"), F.coalesce(part(r, 1), r["name"]).alias("name"), part(r, 2).cast("long").alias("start"),
        part(r, 3).cast("long").alias("end"), r["seq"].alias("seq")))
