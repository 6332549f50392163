"""Token ids in binary files of patched frame-of-reference blocks.

A file holds one segment: consecutive documents in ascending id order.

    magic   8 bytes  "PFORTOK1"
    header  8 unsigned 64-bit: part, number in the part, documents, ids,
            blocks, ids per block, bytes of the document table, bytes of blocks
    documents       ids as signed 64-bit, flags (1: null id), lengths as unsigned 32-bit
    block starts    unsigned 32-bit byte positions, one more than blocks
    blocks          minimum (u32), width (u8), exceptions (u16), the packed
                    differences, positions (u16) and differences (u32) of exceptions
    a line feed

All numbers are little-endian.  A block's differences from its minimum are
packed at the width that a percentile of them needs; larger ones are zero in
the packed part and stand in the exception list.  Spark writes the files with
its own commit protocol, so any store that Spark reaches will do and a lost
executor leaves no half file behind.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, shuffle_partitions, stage, temp_path
from .packing import _grouped
from .tokens import encoder

MAGIC = b"PFORTOK1"
BLOCK = 1024
PERCENTILE = 95
#: A segment, and with it a file and the memory of a task, ends at so many ids.
SEGMENT_IDS = 1 << 21
DOCS = "doc_id long, part long, number long, position long, ids_before long, segment_ids long, n_tokens long, ids_crc32 long"


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` and where each starts (with the end)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.zeros(1, "<u4")
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    at = np.partition(diff, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.zeros(blocks, np.int64)
    for bit in range(32):
        width[at >> np.uint32(bit) > 0] = bit + 1
    limit = np.where(width >= 32, np.uint64(1) << np.uint64(32), np.uint64(1) << width.astype(np.uint64))
    outlier = diff >= limit[:, None]
    packed: list[bytes] = [b""] * blocks
    small = np.where(outlier, np.uint32(0), diff)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if not w:
            continue
        for lo in range(0, len(rows), 64):
            some = rows[lo:lo + 64]
            bits = ((small[some][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            lines = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
            for i, line in zip(some, lines):
                packed[i] = line.tobytes()
    out, starts, pos = [], np.zeros(blocks + 1, "<u4"), 0
    for i in range(blocks):
        where = np.flatnonzero(outlier[i])
        body = struct.pack("<IBH", int(low[i]), int(width[i]), len(where)) + packed[i]
        if len(where):
            body += where.astype("<u2").tobytes() + diff[i, where].astype("<u4").tobytes()
        out.append(body)
        pos += len(body)
        starts[i + 1] = pos
    return b"".join(out), starts


def decode_blocks(raw: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids that :func:`encode_blocks` packed."""
    blocks = len(starts) - 1
    out = np.zeros((max(blocks, 1), BLOCK), np.uint32)
    by_width: dict[int, list[int]] = {}
    heads = []
    for i in range(blocks):
        low, width, exceptions = struct.unpack_from("<IBH", raw, int(starts[i]))
        heads.append((low, width, exceptions))
        by_width.setdefault(width, []).append(i)
    for w, rows in by_width.items():
        if not w:
            continue
        size = BLOCK * w // 8
        for lo in range(0, len(rows), 64):
            some = rows[lo:lo + 64]
            lines = np.stack([np.frombuffer(raw, np.uint8, size, int(starts[i]) + 7) for i in some])
            bits = np.unpackbits(lines, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
            value = np.zeros((len(some), BLOCK), np.uint32)
            for bit in range(w):
                value |= bits[:, :, bit].astype(np.uint32) << np.uint32(bit)
            out[some] = value
    for i, (low, width, exceptions) in enumerate(heads):
        if exceptions:
            pos = int(starts[i]) + 7 + BLOCK * width // 8
            where = np.frombuffer(raw, "<u2", exceptions, pos)
            out[i, where] = np.frombuffer(raw, "<u4", exceptions, pos + 2 * exceptions)
        out[i] += np.uint32(low)
    return out.reshape(-1)[:n]


def write_segment(part: int, number: int, ids: list, token_bytes: list[bytes]) -> bytes:
    """One file: documents ``ids`` with their tokens as little-endian u32 bytes."""
    lengths = np.asarray([len(t) // 4 for t in token_bytes], "<u4")
    tokens = np.frombuffer(b"".join(token_bytes), "<u4")
    blocks, starts = encode_blocks(tokens)
    table = (
        np.asarray([0 if i is None else i for i in ids], "<i8").tobytes()
        + np.asarray([i is None for i in ids], "u1").tobytes() + lengths.tobytes()
    )
    head = struct.pack("<8Q", part, number, len(ids), len(tokens), len(starts) - 1, BLOCK, len(table), len(blocks))
    return MAGIC + head + table + starts.tobytes() + blocks


def read_segment(raw: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """(part, number, document ids, lengths, token ids) of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    part, number, docs, n, blocks, per, table, size = struct.unpack_from("<8Q", raw, 8)
    if per != BLOCK:
        raise ValueError(f"blocks of {per} ids")
    at = 8 + 64
    ids = np.frombuffer(raw, "<i8", docs, at)
    null = np.frombuffer(raw, "u1", docs, at + 8 * docs)
    lengths = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
    at += table
    starts = np.frombuffer(raw, "<u4", blocks + 1, at)
    at += 4 * (blocks + 1)
    tokens = decode_blocks(raw[at:at + size], starts, n)
    return part, number, [None if z else int(i) for i, z in zip(ids, null)], lengths, tokens


def _segments(vocabulary: str, end_id: int, segment_ids: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        enc, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([write_segment(part, number, ids, held)], pa.binary())], ["file"])

        for b in batches:
            docs, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _grouped(texts):
                for doc, raw in zip(docs[lo:hi], enc.encode(texts[lo:hi])):
                    ids.append(doc)
                    held.append(raw + end)
                    size += len(raw) // 4 + 1
                    if size >= segment_ids:
                        yield done()
                        ids, held, size, number = [], [], 0, number + 1
        if ids:
            yield done()

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    segment_ids: int = SEGMENT_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Encode ``docs`` and write them to files under ``path``, in ascending id order.

    Defined cases: a null or empty text is the end id alone; null ids come
    first; rows of one id are in the order of their texts' hashes; an empty
    table writes no segment.  A document longer than a segment gets one of
    its own.  Other columns are not read.

    Scale: one range shuffle by id, with the text's hash as second key, so
    that a repeated id still divides; tasks hold one segment at a time.
    """
    spark = docs.sparkSession
    mark = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), mark).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), mark)
    files = in_batches(ordered, _segments(vocabulary, end_id, segment_ids), "file binary")
    # the text writer puts the bytes as they are and ends them with a line feed
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _documents_of(batches):
    names = ["doc_id", "part", "number", "position", "ids_before", "segment_ids", "n_tokens", "ids_crc32"]
    for b in batches:
        for raw in b.column(0):
            part, number, ids, lengths, tokens = read_segment(raw.as_buffer().to_pybytes())
            data = np.ascontiguousarray(tokens, "<u4")
            cuts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            crc = [zlib.crc32(data[cuts[i]:cuts[i + 1]]) for i in range(len(ids))]
            n = len(ids)
            cols = [ids, [part] * n, [number] * n, range(n), cuts[:-1], [len(tokens)] * n, lengths.astype(np.int64), crc]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document of the files under ``path``: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it; it comes from a
    running sum over segments (one row per file, about ``SEGMENT_IDS`` ids).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 72").select("content")
    docs = stage(in_batches(files, _documents_of, DOCS), name="read-back")
    segments = docs.where("position = 0").select("part", "number", "segment_ids")
    along = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = segments.select("part", "number", F.coalesce(F.sum("segment_ids").over(along), F.lit(0)).alias("base"))
    return docs.join(base, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")


def token_files_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, temp_path(spark, "tokens"), **options))
