"""An index of alignment blocks by byte, and blocks read through it.

The index has one row per block: file, offset, size, number, and the
interval of its reference row.  Features are joined to the intervals, and only
the byte ranges of the blocks that they touch are read: files that hold none
are never opened.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from ..sources.datasource import SCHEMA, parsed
from ..sources.files import opened
from .intervals import overlap_join

#: Blocks of a file that lie closer than this are read in one go.
GAP_BYTES = 1 << 16
INDEX = ["file", "offset", "size", "format", "n_rows", "n_cols", "seq_id", "start", "end"]


def block_index(blocks: DataFrame) -> DataFrame:
    """``file, offset, size, format, n_rows, n_cols, seq_id, start, end`` of the blocks of the ``alignments`` source.

    ``seq_id`` is the reference row's chromosome, or its whole name; blocks
    without positions (CLUSTAL) have nulls there and are found by number only.
    Write it as Parquet, once for many questions.
    """
    ref = F.col("rows")[0]
    return blocks.select(
        "file", "offset", "size", "format", F.size("rows").alias("n_rows"), "n_cols",
        F.coalesce(ref["chrom"], ref["name"]).alias("seq_id"), ref["start"].alias("start"), ref["end"].alias("end"))


def numbered(index: DataFrame, *, least_rows: int = 2, parts: int | None = None) -> DataFrame:
    """``index`` with ``block_no`` from 1 through all files in order of file and offset; blocks under ``least_rows`` rows have none.

    Blocks are counted by file; within a file they are ranked by offset, so
    the largest file is the most that one task sorts, and that as index rows.
    """
    from pyspark.sql import Window

    real = index.where(F.col("n_rows") >= least_rows)
    sizes = real.groupBy("file").agg(F.count("*").alias("_n"))
    # one row per file
    ahead = sizes.select("file", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return real.withColumn("_i", F.row_number().over(Window.partitionBy("file").orderBy("offset"))).join(ahead, "file").withColumn(
        "block_no", F.col("_ahead") + F.col("_i")).drop("_i", "_ahead")


def file_and_place(block_no: Column, per_file: int) -> tuple[Column, Column]:
    """Of a number from 1 through files of ``per_file`` blocks each: the file's number and the place in it, both from 1."""
    return F.floor((block_no + per_file - 1) / per_file).cast("long"), (F.pmod(block_no - 1, F.lit(per_file)) + 1).cast("long")


def _runs(places: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """(offset, size) in order -> lists that one read covers."""
    out: list[list[tuple[int, int]]] = []
    end = None
    for offset, size in places:
        if end is None or offset > end + GAP_BYTES:
            out.append([])
            end = offset
        out[-1].append((offset, size))
        end = max(end, offset + size)
    return out


def _read(forward: bool):
    kinds = pa.struct([("idx", pa.int32()), ("name", pa.string()), ("org", pa.string()), ("chrom", pa.string())] + [
        (c, pa.int64()) for c in ("start", "end", "length", "full_length")] + [("strand", pa.string()), ("seq", pa.string())])
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("format", pa.string()), ("n_cols", pa.int32()), ("rows", pa.list_(kinds))])
    names = kinds.names if hasattr(kinds, "names") else [kinds.field(i).name for i in range(kinds.num_fields)]

    def blocks(name: str, kind: str, places: list[tuple[int, int]]):
        with opened(name) as file:
            for run in _runs(places):
                low = run[0][0]
                file.seek(low)
                data = file.read(max(o + s for o, s in run) - low)
                for offset, size in run:
                    if row := parsed(name, offset, data[offset - low:offset - low + size], kind, forward=forward):
                        yield {**dict(zip(schema.names[:5], row)), "rows": [dict(zip(names, r)) for r in row[5]]}

    def table(rows):
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        for b in batches:
            by_file: dict[tuple[str, str], list[tuple[int, int]]] = {}
            for r in b.to_pylist():
                by_file.setdefault((r["file"], r["format"]), []).append((r["offset"], r["size"]))
            for (name, kind), places in by_file.items():
                held, size = [], 0
                for row in blocks(name, kind, sorted(places)):
                    held.append(row)
                    size += row["size"]
                    if size > 4_000_000:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)

    return run


def fetch(places: DataFrame, *, forward: bool = True, parts: int | None = None) -> DataFrame:
    """The blocks at ``file, offset, size, format``, each once, as the ``alignments`` source gives them.

    Places are ranged by file and offset, so a file from which much is
    wanted is read by several tasks and neighbours are read together.
    """
    wanted = places.select("file", "offset", "size", "format").distinct()
    parts = parts or int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_read(forward), SCHEMA)


def blocks_under(features: DataFrame, index: DataFrame, *, forward: bool = True, seq: str = "seq_id", start: str = "start", end: str = "end") -> DataFrame:
    """Blocks of which the reference interval shares a position with a feature (half open: touching isn't enough).

    A feature that another one of the same start outlasts meets nothing that
    the other doesn't, so of each start the greatest end is asked for: copies
    and shorter ones go while features are read, before any exchange.
    """
    # the join takes touching for sharing, so both sides give up their last position's edge
    asked = features.select(F.col(seq).alias("seq_id"), F.col(start).alias("start"), (F.col(end) - 1).alias("end")).where("end >= start")
    asked = settled(asked.groupBy("seq_id", "start").agg(F.max("end").alias("end")))
    held = index.where("seq_id IS NOT NULL AND start IS NOT NULL AND end > start").withColumn("end", F.col("end") - 1)
    both = overlap_join(asked, held)
    return fetch(both.select(*[F.col(f"o_{c}").alias(c) for c in ("file", "offset", "size", "format")]), forward=forward)


def blocks_numbered(numbers: DataFrame, index: DataFrame, *, forward: bool = True) -> DataFrame:
    """Blocks by ``block_no`` (see :func:`numbered`), each once, with their number."""
    found = index.join(numbers.select("block_no").distinct(), "block_no", "left_semi")
    return fetch(found, forward=forward).join(found.select("file", "offset", "block_no"), ["file", "offset"])
