"""Alignment files as a Spark data source with byte offsets.

    register_sources(spark)
    blocks = spark.read.format("alignments").option("partitionBytes", 64 << 20).load(path)

A file is cut into byte ranges; the reader of a range takes the blocks that
begin in it, so any number of ranges gives the blocks that one gives.  Narrow
ranges are read several to a task, as a task costs more than a range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import listed, opened, records

ROW = "struct<idx:int,name:string,org:string,chrom:string,start:bigint,end:bigint,length:bigint,full_length:bigint,strand:string,seq:string>"
SCHEMA = f"file string, offset bigint, size bigint, format string, n_cols int, rows array<{ROW}>"
#: The line with which a block begins.
BEGINS = {"maf": b"a", "clustal": b"CLUSTAL"}
PARTITION_BYTES = 64 << 20
#: A task takes ranges up to so many bytes, as long as there are so many tasks.
TASK_BYTES, LEAST_TASKS = 4 << 20, 64
_CLUSTAL_ROW = re.compile(r"(?!//)[^\s#]+\s+[A-Za-z.-]+(\s+\d+)?\s*$")


def format_of(path: str) -> str:
    """``clustal``, ``maf`` or ``unknown``, by the first line that is neither empty nor a comment."""
    with opened(path) as file:
        for line in file:
            if line.strip() and not line.lstrip().startswith(b"#"):
                return "clustal" if line.startswith(b"CLUSTAL") else "maf" if line.split()[0] == b"a" else "unknown"
    raise ValueError(f"{path}: empty alignment file")


def maf_block(text: str, *, forward: bool = True) -> list[tuple]:
    """Rows of a MAF block; with ``forward``, starts of minus rows count from the forward strand's start."""
    rows = []
    for line in text.split("\n"):
        if not re.match(r"s\s", line):
            continue
        cells = line.split()
        if len(cells) != 7:
            raise ValueError(f"not a MAF row: {line}")
        _, name, start, length, strand, full, seq = cells
        dotted = re.fullmatch(r"(\w+)\.(.*)", name)
        org, chrom = dotted.groups() if dotted else (name, None)
        start, length, full = int(start), int(length), int(full)
        if forward and strand == "-":
            start = full - start - length
        rows.append((len(rows), name, org, chrom, start, start + length, length, full, strand, seq.replace(".", "-")))
    return rows


def clustal_block(text: str) -> list[tuple]:
    """Rows of one CLUSTAL alignment, chunk after chunk in the order of the first one's names."""
    chunks: list[list[tuple[str, str]]] = [[]]
    for line in text.split("\n")[1:]:
        if _CLUSTAL_ROW.match(line):
            chunks[-1].append(tuple(line.split()[:2]))
        elif chunks[-1]:
            chunks.append([])
    chunks = [c for c in chunks if c]
    names = [n for n, _ in chunks[0]] if chunks else []
    if any([n for n, _ in c] != names for c in chunks):
        raise ValueError(f"names differ between chunks in the alignment of {', '.join(names)}")
    seqs = ["".join(c[i][1] for c in chunks).replace(".", "-") for i in range(len(names))]
    if len({len(s) for s in seqs}) > 1:
        raise ValueError(f"rows of different lengths in the alignment of {', '.join(names)}")
    return [(i, n, *[None] * 7, s) for i, (n, s) in enumerate(zip(names, seqs))]


def parsed(file: str, offset: int, raw: bytes, kind: str, *, forward: bool = True) -> tuple | None:
    """A row of the source, or nothing for a block without rows."""
    text = raw.decode()
    rows = maf_block(text, forward=forward) if kind == "maf" else clustal_block(text)
    return (file, offset, len(raw), kind, len(rows[0][-1]), rows) if rows else None


@dataclass
class FileRange(InputPartition):
    """The blocks of ``file`` that begin in [start, end); to the end of the file without ``end``."""

    file: str
    kind: str
    start: int = 0
    end: int | None = None


@dataclass
class Ranges(InputPartition):
    """What one task reads: ranges in order of file and place."""

    ranges: list[FileRange]


def dealt(ranges: list[tuple[FileRange, int]]) -> list[Ranges]:
    """Ranges with their bytes, in order -> tasks of up to TASK_BYTES, of less while those would be under LEAST_TASKS, of one range at least."""
    most = min(TASK_BYTES, sum(size for _, size in ranges) // LEAST_TASKS)
    out: list[Ranges] = []
    held = 0
    for one, size in ranges:
        if not out or held + size > most:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(one)
        held += size
    return out


class AlignmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [options["path"]] if "path" in options else []
        if not self.paths:
            raise ValueError("alignments are loaded from a path")
        self.kind = options.get("format", "auto").lower()
        self.width = int(options.get("partitionbytes", PARTITION_BYTES))
        self.forward = options.get("forward", "true").lower() == "true"
        if self.kind not in ("auto", *BEGINS):
            raise ValueError(f"not an alignment format: {self.kind}")
        if self.width < 1:
            raise ValueError("partitionBytes must be positive")

    def partitions(self) -> list[Ranges]:
        out = []
        for path in self.paths:
            for file, size in listed(path):
                kind = format_of(file) if self.kind == "auto" else self.kind
                if kind not in BEGINS:
                    raise ValueError(f"{file}: neither MAF nor CLUSTAL")
                if file.endswith(".gz"):  # can't be entered in the middle
                    out.append((FileRange(file, kind), size))
                else:
                    ends = [(at, min(at + self.width, size)) for at in range(0, size, self.width)]
                    out += [(FileRange(file, kind, at, end), end - at) for at, end in ends]
        return dealt(out)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for one in partition.ranges:
            with opened(one.file) as file:
                for offset, raw in records(file, BEGINS[one.kind], one.start, one.end):
                    if row := parsed(one.file, offset, raw, one.kind, forward=self.forward):
                        yield row


class AlignmentSource(DataSource):
    """``file, offset, size, format, n_cols, rows`` of every block of MAF or CLUSTAL files.

    Options: ``format`` (``auto``: each file's first line tells), ``partitionBytes``,
    ``forward`` (minus rows of MAF by forward positions).
    """

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AlignmentReader:
        return AlignmentReader(self.options)


def register_sources(spark: SparkSession) -> None:
    """Make ``alignments`` and ``screen_report`` known to ``spark.read`` and ``write``, and the package to its workers."""
    from ..session import ship_package
    from .report_sink import ReportSink

    ship_package(spark)
    spark.dataSource.register(AlignmentSource)
    spark.dataSource.register(ReportSink)
