"""Ordered text as a Spark data sink with a commit of its own.

    lines.write.format("screen_report").option("header", "# a\\n# b\\n").mode("append").save(path)

Files are numbered by partition, so ranges of a total order stay in order
from file to file; the header stands once, at the top of the first file.  Tasks
write under a hidden name; files get theirs once all tasks have ended, and a
job that fails leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import store_of
from .reports import HIT_COLUMNS, LOCUS_COLUMNS, hit_line, locus_line, report_text


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has finished."""

    partition: int
    file: str
    rows: int


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if "path" not in options:
            raise ValueError("a report is saved to a path")
        self.path, self.header, self.overwrite = options["path"].rstrip("/"), options.get("header", ""), overwrite
        self.held = f"_writing-{uuid.uuid4().hex}"
        store, inner = store_of(self.path)
        there = store.get_file_info(inner).type != fs.FileType.NotFound
        if there and not overwrite and any(f.base_name.startswith("part-") for f in store.get_file_info(fs.FileSelector(inner))):
            raise FileExistsError(f"{self.path} holds a report already")
        store.create_dir(f"{inner}/{self.held}", recursive=True)

    def write(self, iterator: Iterator) -> Written:
        at = TaskContext.get()
        store, inner = store_of(self.path)
        name = f"{inner}/{self.held}/{at.partitionId()}-{at.attemptNumber()}-{uuid.uuid4().hex}"
        rows = 0
        with store.open_output_stream(name) as out:
            for row in iterator:
                out.write((row[0] or "").encode() + b"\n")
                rows += 1
        return Written(at.partitionId(), name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = store_of(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(inner)):
                if f.base_name.startswith(("part-", "_SUCCESS")):
                    store.delete_file(f.path)
        if self.header:
            with store.open_output_stream(f"{inner}/part-00000-header.txt") as out:
                out.write(self.header.encode())
        for m in done:
            if m.rows:
                store.move(m.file, f"{inner}/part-{m.partition + 1:05d}.txt")
        store.delete_dir(f"{inner}/{self.held}")
        with store.open_output_stream(f"{inner}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        store, inner = store_of(self.path)
        store.delete_dir(f"{inner}/{self.held}")


class ReportSink(DataSource):
    """A sink for one column of text; options ``path`` and ``header``."""

    @classmethod
    def name(cls) -> str:
        return "screen_report"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("a report is one column of text")
        return ReportWriter(self.options, overwrite)


def write_screen(hits: DataFrame, loci: DataFrame, path: str, *, header: bool = True, files: int | None = None, mode: str = "append") -> None:
    """Loci, each before its windows, over ``files`` files in order of sequence, locus start, locus and window start.

    ``hits`` has HIT_COLUMNS, ``loci`` LOCUS_COLUMNS.  The order comes from
    ranges of the whole key, window and all, so a locus of a million windows
    runs over as many files as it needs.
    """
    spark = hits.sparkSession
    order = ["seq_id", "_at", "locus_id", "_kind", "_start", "_end", "value"]
    heads = loci.select(
        "seq_id", F.col("start").alias("_at"), "locus_id", F.lit(0).alias("_kind"), F.col("start").alias("_start"), F.col("end").alias("_end"), locus_line().alias("value"))
    at = loci.select("locus_id", F.col("start").alias("_at"))
    windows = hits.join(at, "locus_id").select(
        "seq_id", "_at", "locus_id", F.lit(1).alias("_kind"), F.col("start").alias("_start"), F.col("end").alias("_end"), hit_line().alias("value"))
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = heads.unionByName(windows).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value")
    names = "".join(f"# {chr(9).join(c.values())}\n" for c in (LOCUS_COLUMNS, HIT_COLUMNS)) if header else ""
    lines.write.format("screen_report").option("header", names).mode(mode).save(path)


def write_reports(reports: DataFrame, path: str, *, files: int | None = None, mode: str = "append") -> None:
    """Reports of windows as text in order of sequence and start of their first row, over ``files`` files.

    ``reports`` has the columns that :func:`report_text` writes, ``seq_id``
    and ``start``.
    """
    parts = files or int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["seq_id", "start", "value"]
    text = reports.select("seq_id", "start", report_text().alias("value"))
    text.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value").write.format("screen_report").mode(mode).save(path)
