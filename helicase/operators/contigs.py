"""Sequences of any length as chunks, and stretches of them under loci.

A contig is cut into chunks of a fixed number of bases, one row each, keyed
by contig and chunk.  A locus asks for the chunks that it touches, so a whole
contig is never copied, moved or held anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement_dna
from ..session import settled

#: Bases of a chunk, and chunks of a zone, the unit in which stored chunks are pruned.
CHUNK, ZONE = 1 << 16, 1 << 8
#: Bases of a run of small chunks, and the most names that are sent to all tasks.
RUN, FEW_NAMES = 1 << 12, 100_000


def cut(contigs: DataFrame, *, size: int = CHUNK, name: str = "seq_id", seq: str = "seq") -> DataFrame:
    """``contig, chunk, bases`` of contigs that are rows already."""
    last = F.floor((F.length(seq) - 1) / size)
    rows = contigs.where(F.length(seq) > 0).select(F.col(name).cast("string").alias("contig"), F.col(seq).alias("_seq"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return rows.select("contig", "chunk", F.substring("_seq", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("bases"))


def read_contigs(spark: SparkSession, path: str | list[str], *, size: int = CHUNK) -> DataFrame:
    """``contig, chunk, bases`` of FASTA files, however long a contig is.

    Lines are counted within each split of a file; what a split begins in the
    middle of (contig and bases so far) is carried from the splits before it,
    one row each.  So no task reads more than its split, and a line of any
    width is cut where chunks end.
    """
    text = spark.read.text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("no"), F.trim("value").alias("line"))
    head = F.when(F.col("line").startswith(">"), F.split(F.substring("line", 2, 2**31 - 1), r"\s+")[0])
    lines = lines.withColumn("head", head).withColumn("n", F.when(head.isNull(), F.length("line")).otherwise(0).cast("long"))
    along = Window.partitionBy("file", "split").orderBy("no")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # bases of the split up to the line, at its last header, and that header
    seen = lines.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "mark", F.last(F.when(F.col("head").isNotNull(), F.struct("head", F.col("upto").alias("at"))), ignorenulls=True).over(upto))
    ends = seen.groupBy("file", "split").agg(F.max_by(F.struct("upto", "mark"), "no").alias("end"))
    # windows over one row for each split of a file
    order = Window.partitionBy("file").orderBy("split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("end.upto").over(earlier), F.lit(0)))
    begun = F.when(F.col("end.mark").isNotNull(), F.struct(F.col("end.mark.head").alias("head"), (F.col("before") + F.col("end.mark.at")).alias("at")))
    ends = ends.withColumn("begun", F.last(begun, ignorenulls=True).over(earlier)).select("file", "split", "before", "begun")
    # one row for each split
    placed = seen.where("n > 0").join(F.broadcast(ends), ["file", "split"])
    own = F.when(F.col("mark").isNotNull(), F.struct(F.col("mark.head").alias("head"), (F.col("before") + F.col("mark.at")).alias("at"))).otherwise(F.col("begun"))
    placed = placed.withColumn("own", own).where("own IS NOT NULL").select(
        F.col("own.head").alias("contig"), (F.col("before") + F.col("upto") - F.col("n") - F.col("own.at")).alias("from_"), "line", "n")
    chunks = F.explode(F.sequence(F.floor(F.col("from_") / size), F.floor((F.col("from_") + F.col("n") - 1) / size)))
    pieces = placed.withColumn("chunk", chunks).withColumn("low", F.greatest(F.col("from_"), F.col("chunk") * size))
    high = F.least(F.col("from_") + F.col("n"), (F.col("chunk") + 1) * size)
    pieces = pieces.select("contig", "chunk", "low", F.substring("line", (F.col("low") - F.col("from_") + 1).cast("int"), (high - F.col("low")).cast("int")).alias("part"))
    # a chunk is at most ``size`` bases
    return pieces.groupBy("contig", "chunk").agg(F.sort_array(F.collect_list(F.struct("low", "part"))).alias("parts")).select(
        "contig", "chunk", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("bases"))


def write_chunks(chunks: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Chunks as a table whose folders are zones, so that only those that loci touch are read."""
    zoned = chunks.withColumn("zone", F.floor(F.col("chunk") / ZONE)).withColumn("key", F.pmod(F.xxhash64("contig"), F.lit(64)))
    zoned.repartition("key", "zone").sortWithinPartitions("contig", "chunk").write.partitionBy("key", "zone").mode(mode).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def candidates(name: Column) -> Column:
    """Names under which the sequence ``X.Y`` may be filed, best first: itself, ``Y``, then both with the endings of FASTA files."""
    plain = F.array_distinct(F.array_compact(F.array(name, F.nullif(F.regexp_extract(name, r"^.*\.(.*)$", 1), F.lit("")))))
    filed = F.flatten(F.transform(plain, lambda n: F.array(F.concat(n, F.lit(".fa")), F.concat(n, F.lit(".fasta")))))
    return F.concat(plain, filed)


def resolved(loci: DataFrame, chunks: DataFrame, *, seq: str = "seq_id") -> DataFrame:
    """``loci`` with ``contig``: the best of the candidates that has chunks, or null.

    A name under which chunks are filed as it is needs no lookup.  The others
    are looked up once each, not once for a locus, and only they are joined
    to the loci, which stay where they are unless there are many.
    """
    known = chunks.select("contig").distinct()
    names = loci.select(F.col(seq).alias("_name")).where("_name IS NOT NULL").distinct()
    others = settled(names.join(known, F.col("_name") == F.col("contig"), "left_anti"))
    count = others.count()
    if not count:
        return loci.withColumn("contig", F.col(seq))
    best = others.select("_name", F.posexplode(candidates(F.col("_name"))).alias("_rank", "contig")).join(known, "contig").groupBy("_name").agg(F.min_by("contig", "_rank").alias("_best"))
    best = settled(others.join(best, "_name", "left").select("_name", "_best"))
    met = loci.join(F.broadcast(best) if count <= FEW_NAMES else best, F.col(seq) == F.col("_name"), "left")
    return met.withColumn("contig", F.when(F.col("_name").isNull(), F.col(seq)).otherwise(F.col("_best"))).drop("_name", "_best")


def runs(chunks: DataFrame, size: int, width: int = RUN) -> tuple[DataFrame, int]:
    """Chunks of ``size`` bases put together in runs of up to ``width``, and the bases of a run; larger and stored ones as they are.

    The chunks of a contig follow one another without a gap.
    """
    many = width // size
    if many < 2 or "zone" in chunks.columns:
        return chunks, size
    put = chunks.groupBy("contig", F.floor(F.col("chunk") / many).alias("_run")).agg(F.sort_array(F.collect_list(F.struct("chunk", "bases"))).alias("_parts"))
    return put.select("contig", F.col("_run").alias("chunk"), F.array_join(F.transform("_parts", lambda p: p["bases"]), "").alias("bases")), many * size


def locus_sequences(
    loci: DataFrame, chunks: DataFrame, *, key: list[str], seq: str = "seq_id", start: str = "start", end: str = "end", strand: str | None = "strand", size: int = CHUNK,
    complement=reverse_complement_dna, width: int = RUN,
) -> DataFrame:
    """``key, contig, sequence`` of every locus: the bases of [start, end), reverse-complemented on the minus strand.

    ``key`` names the columns that tell loci apart.  What lies beyond a
    contig's end is missing from the sequence; an empty range, or a name
    that no contig answers to, gives an empty one (``contig`` is null then).

    Scale: small chunks become runs of ``width`` bases, so few loci touch two.
    A locus within a run is dealt once, to its run, in an equality join of
    which large keys are split.  Others make a row for each run that they
    touch; only the bases asked for go on, and are put together by locus.
    From a stored table only what loci touch is read, so there the chunks
    found are joined back to the loci.
    """
    found = resolved(loci, chunks, seq=seq)
    stored = "zone" in chunks.columns
    chunks, size = runs(chunks, size, width)
    # no end: an empty range
    low, high = F.greatest(F.col(start), F.lit(0)), F.coalesce(F.col(end), F.lit(0))
    minus = (F.col(strand) == "-") if strand else F.lit(False)
    base = found.select(*key, "contig", low.cast("long").alias("_low"), high.cast("long").alias("_high"), F.coalesce(minus, F.lit(False)).alias("_minus"))
    on, first, last = ["contig", "chunk"], F.floor(F.col("_low") / size), F.floor((F.col("_high") - 1) / size)
    each = F.explode(F.sequence(first, last))
    if stored:
        # its folders are pruned while the query runs
        asked = base.where("_high > _low AND contig IS NOT NULL").withColumn("chunk", each).withColumn(
            "zone", F.floor(F.col("chunk") / ZONE).cast(chunks.schema["zone"].dataType)).withColumn(
            "key_", F.pmod(F.xxhash64("contig"), F.lit(64)).cast(chunks.schema["key"].dataType))
        pieces = asked.join(chunks.withColumnRenamed("key", "key_"), [*on, "key_", "zone"]).select(*key, "chunk", _part(size).alias("_part"))
        told = base.select(*key, "contig", "_minus").join(_whole(pieces, key), key, "left")
    else:
        reach = F.when((F.col("_high") > F.col("_low")) & F.col("contig").isNotNull(), last).otherwise(first)
        within = base.where(reach <= first).withColumn("chunk", first).join(chunks, on, "left").select(*key, "contig", "_minus", _part(size).alias("_plain"))
        pieces = base.where(reach > first).withColumn("chunk", each).join(chunks, on, "left").select(*key, "contig", "_minus", "chunk", _part(size).alias("_part"))
        told = within.unionByName(_whole(pieces, key, "contig", "_minus"))
    plain = F.coalesce("_plain", F.lit(""))
    return told.select(*key, "contig", F.when(F.col("_minus"), complement(plain)).otherwise(plain).alias("sequence"))


def _part(size: int) -> Column:
    """What ``bases`` of a chunk hold of its locus."""
    first = F.greatest(F.col("_low") - F.col("chunk") * size, F.lit(0))
    last = F.least(F.col("_high") - F.col("chunk") * size, F.lit(size))
    return F.substring("bases", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))


def _whole(pieces: DataFrame, key: list[str], *more: str) -> DataFrame:
    """``_plain`` by key: the pieces of a locus in order, with further columns that are one for each."""
    whole = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("chunk", "_part"))).alias("_parts"), *[F.first(c).alias(c) for c in more])
    return whole.select(*key, *more, F.array_join(F.transform("_parts", lambda p: p["_part"]), "").alias("_plain"))


def fasta_text(title: Column, sequence: Column, *, width: int = 60) -> Column:
    """A FASTA record with lines of ``width`` bases."""
    return F.concat(F.lit(">"), title, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n"), F.lit("\n"))


def locus_title(name: Column, seq_id: Column, start: Column, end: Column, strand: Column) -> Column:
    """``name (seq:start..end,strand)``."""
    return F.concat(name, F.lit(" ("), seq_id, F.lit(":"), start.cast("string"), F.lit(".."), end.cast("string"), F.lit(","), strand, F.lit(")"))
