"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many tasks a single hot key is spread over in :func:`salted_join`.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary folder of this machine.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="helicase-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def staged_dir(spark: SparkSession) -> str:
    """The folder of this application's staged tables, for :func:`remove_staged` or, once it has ended, anyone to delete."""
    return f"{shared_dir(spark)}/helicase/{spark.sparkContext.applicationId}"


def remove_staged(spark: SparkSession) -> None:
    """Delete all tables that this application has staged.

    Results that aren't written yet read them, so this comes last.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Has Spark delete the shuffle files of a query once it has ended.
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, *, name: str = "stage", drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This runs the plan once, cuts its lineage and survives the loss of any
    executor, as the files don't live on one.  The table stays until
    :func:`remove_staged`.  With ``drop_shuffles`` the shuffle files of the plan go
    once it is written (else when the driver happens to collect them).
    """
    spark = df.sparkSession
    path = temp_path(spark, name)
    before = spark.conf.get(_CLEANUP_SETTING, None)
    if drop_shuffles:
        spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_CLEANUP_SETTING) if before is None else spark.conf.set(_CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, and bytes of the slices of it that a kernel sees.
BATCH_ROWS = 1000
BATCH_BYTES = 4_000_000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(df: DataFrame, kernel, schema: str) -> DataFrame:
    """``df.mapInArrow(kernel, schema)`` with batches of bounded rows, dealt to the kernel in slices of bounded bytes.

    A row larger than that comes alone.  The session's own limit of rows stays
    if it is lower.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_SETTING)) <= BATCH_ROWS:
        conf.set(_ROWS_SETTING, str(BATCH_ROWS))

    def sliced(batches):
        for b in batches:
            rows = max(1, b.num_rows * BATCH_BYTES // max(BATCH_BYTES, b.nbytes))
            for lo in range(0, b.num_rows, rows):
                yield b.slice(lo, rows)

    def run(batches):
        yield from kernel(sliced(batches))
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the machine: workers idle between tasks, and those of one executor share its limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def row_key(*columns: Column) -> Column:
    """A 64-bit hash of values, nulls told apart, that tells rows with one id (or none) from each other."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def boxed(docs: DataFrame, **helpers: Column) -> DataFrame:
    """Rows as one struct ``row`` beside helper columns, so that no helper's name can meet one of theirs.

    ``select("row.*")`` gives the rows back.
    """
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in helpers.items()])


def unused_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many marks before it as make it none of the columns' names."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``docs`` without the rows whose id and ``key`` are in ``gone`` (columns ``_id, _key``).

    Rows that a filter of bounded size clears pass straight through; only the
    others are shuffled, texts and all.
    """
    rows = boxed(docs, own_id=F.col(id_col).cast("long"), own_key=key)
    known = likely_in(rows, F.xxhash64("own_id", "own_key"), gone, F.xxhash64("_id", "_key"))
    same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_key") == F.col("_key"))
    # what goes grows with the corpus, so this is a merge join at any size
    checked = known.where("_likely").join(gone.select("_id", "_key").distinct().hint("merge"), same, "left_anti")
    return known.where("NOT _likely").unionByName(checked).select("row.*")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread, *, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``rows`` to ``table``, which has one row per ``key``, with hot keys spread.

    Each row gets a salt from ``spread`` (columns that differ between rows of
    a key).  A key's table row is copied once for every (key, salt) that
    occurs, so copies never outnumber rows and no key meets in one task.
    Nothing is broadcast.  Null keys match nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    wanted = salted.where(F.col(key).isNotNull()).select(key, "_salt").distinct()
    copies = wanted.join(table, key)
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


#: Bits of the filter that :func:`likely_in` broadcasts: 8 MB.
FILTER_BITS = 1 << 26


def likely_in(rows: DataFrame, key: Column, members: DataFrame, member_key: Column, *, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with the boolean ``_likely``: false only where ``key`` is surely not among ``members``.

    The members' hashed keys make a bitmap of at most ``bits`` bits, whatever
    their number, which is broadcast in pieces of 4 KB.  With many members
    more rows are taken for likely; none that is a member is missed.
    """
    def cell(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits)) + 1

    pieces = members.select(cell(member_key).alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("_bits"))
    spot = F.bitmap_bit_position(cell(key))
    joined = rows.withColumn("_piece", F.bitmap_bucket_number(cell(key))).join(F.broadcast(pieces), "_piece", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    hit = F.getbit(byte, F.pmod(spot, F.lit(8)).cast("int")) == 1
    return joined.withColumn("_likely", F.coalesce(hit, F.lit(False))).drop("_piece", "_bits")


def components(edges: DataFrame, *, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` as (node, label), label the least node.

    Alternates large-star and small-star steps until no edge changes, each
    a grouped minimum and a join back to it.  Both sides of the join are
    staged, so Spark splits a hub with many edges as a skewed join, and no
    plan holds another one twice.  Nodes without an edge are absent.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u <> v").distinct()
    )
    e = stage(e, name="edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = stage(least.select("u", F.least("u", "m").alias("m")), name="least")
        # only edges to larger nodes are asked for, which is what ``e`` holds turned round
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), name="large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), name="low")
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("x")).select("x.*").where("u <> v").distinct()
        e = stage(small, name="edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return labelled.unionByName(roots.join(labelled.select("node"), "node", "left_anti"))


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v", F.lit(7)).cast("decimal(38,0)")).alias("s")).first()
    return tuple(row)


def temp_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the machine that asks."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
