"""Harmonic packing of token sequences.

Class ``k`` holds pieces of which ``k`` fit a sequence: lengths up to
``capacity // k`` and above ``capacity // (k + 1)``.  A bin of class ``k`` gets
exactly ``k`` pieces.  A worker fills bins of every class on its own, as it
reads, and holds fewer than ``k`` open pieces per class.

Documents may be cut, so a piece is cut to the top of its class (``capacity //
k`` exactly), which leaves a full bin at most ``k - 1`` tokens of padding; only
a tail of up to ``min_cut`` tokens keeps its own length.  What workers leave
open is dealt anew by class, and what then remains of each class, fewer than
``k`` pieces, is packed across classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, shuffle_partitions, stage
from .tokens import encoder

PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"
PLACED = PIECE + ", class int, sequence_id long, offset long"
#: Texts are encoded in groups of at most this many characters.
GROUP_CHARS = 2_000_000
#: Leftover sequences have ids from here on.
LEFTOVER = 1 << 62


def cut_lengths(total: int, capacity: int, min_cut: int) -> list[int]:
    """Lengths of the pieces of a document of ``total`` tokens, each the top of a class but a short last one."""
    full, rest = divmod(total, capacity)
    lengths = [capacity] * full
    while rest > min_cut:
        k = -(-capacity // rest)  # the largest class top that still fits
        lengths.append(capacity // k)
        rest -= capacity // k
    if rest:
        lengths.append(rest)
    return lengths


def class_of(length: int, capacity: int) -> int:
    return capacity // length


class _Bins:
    """A worker's open bins: by class, the pieces that wait for company."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple, out: list[tuple]) -> None:
        k = class_of(piece[2], self.capacity)
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        if len(waiting) == k:
            at = 0
            for p in waiting:
                out.append((*p, k, self.next_id, at))
                at += p[2]
            self.next_id += 1
            waiting.clear()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 8
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "class", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _grouped(texts: list[str]):
    """Runs of texts of bounded size, as slices."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _tokenize_and_fill(vocabulary: str, end_id: int, capacity: int, min_cut: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        bins = _Bins(capacity, TaskContext.get().partitionId() << 36)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _grouped(texts):
                out: list[tuple] = []
                for doc, raw in zip(ids[lo:hi], enc.encode(texts[lo:hi])):
                    raw += end
                    total, at = len(raw) // 4, 0
                    for n in cut_lengths(total, capacity, min_cut):
                        bins.add((doc, at, n, total, raw[at * 4:(at + n) * 4]), out)
                        at += n
                if out:
                    yield _table(out)
        left = [(*p, k, None, None) for k, ps in bins.open.items() for p in ps]
        if left:
            yield _table(left)

    return run


def _pack_mixed(capacity: int):
    """First fit, longest first, over pieces of all classes; sequences that stay short are cut to powers of two."""

    def run(batches):
        pieces = [tuple(r.values())[:5] for b in batches for r in b.to_pylist()]
        pieces.sort(key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1], p[4]))
        bins: list[list[tuple]] = []
        room: list[int] = []
        for p in pieces:
            at = next((i for i, r in enumerate(room) if r >= p[2]), None)
            if at is None:
                bins.append([])
                room.append(capacity)
                at = len(bins) - 1
            bins[at].append(p)
            room[at] -= p[2]
        rows, seq = [], LEFTOVER + (1 << 61)
        for held in bins:
            n = sum(p[2] for p in held)
            # whole if nearly full; else as sequences of a power of two each
            sizes = [n] if n > capacity - capacity // 32 else [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]
            left, at = sizes.pop(0), 0
            for doc, start, length, total, ids in held:
                done = 0
                while done < length:
                    take = min(left, length - done)
                    rows.append((doc, start + done, take, total, ids[done * 4:(done + take) * 4], 0, seq, at))
                    done, at, left = done + take, at + take, left - take
                    if not left and sizes:
                        left, at, seq = sizes.pop(0), 0, seq + 1
            seq += 1
        if rows:
            yield _table(rows)

    return run


def pack_documents(
    docs: DataFrame,
    *,
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 0,
    capacity: int = 1024,
    min_cut: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, start, length, doc_tokens, ids,
    class, sequence_id, offset``; ``ids`` are little-endian unsigned 32-bit.
    Every document is its tokens and ``end_id``; every token lies in exactly
    one piece; pieces of a sequence follow each other without a gap.  A
    consumer pads a sequence to ``capacity`` unless its length is a power of
    two.

    Defined cases: a null or empty text is the end id alone.  A null id is
    kept as null.  Repeated rows are packed as often as they occur.  A very
    long text fills full sequences and one remainder.  An empty table gives
    no rows.  Other columns are not read.

    Scale: texts are read and encoded once and never shuffled.  A task holds
    fewer than ``k`` pieces of class ``k``, a bounded number.  Only those
    leftovers are shuffled; what is left after that is fewer than ``k``
    pieces of each class, under ``capacity`` tokens for each of the classes
    that occur (63 at most with a capacity of 1024 and ``min_cut`` 32)
    whatever the input's size, and is packed in one task.
    """
    spark = docs.sparkSession
    filled = stage(in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        _tokenize_and_fill(vocabulary, end_id, capacity, min_cut), PLACED), name="filled")
    settled = filled.where("sequence_id IS NOT NULL")
    left = filled.where("sequence_id IS NULL").drop("sequence_id", "offset")

    # leftovers of all workers by class: number them along salted parts, so
    # that a class with many leftovers is not numbered in one task
    parts = shuffle_partitions(spark)
    salted = stage(left.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(parts)).cast("int")), name="leftovers")
    along = Window.partitionBy("class").orderBy("part")
    ahead = salted.groupBy("class", "part").agg(F.count("*").alias("n")).select(
        "class", "part", (F.sum("n").over(along) - F.col("n")).alias("ahead"),
        F.sum("n").over(Window.partitionBy("class")).alias("in_class"))
    within = Window.partitionBy("class", "part").orderBy("doc_id", "start", "length", "ids")
    numbered = salted.withColumn("i", F.row_number().over(within)).join(ahead, ["class", "part"]).withColumn(
        "i", F.col("i") + F.col("ahead") - 1).withColumn("bin", F.floor(F.col("i") / F.col("class")))
    numbered = stage(numbered.withColumn("whole", (F.col("bin") + 1) * F.col("class") <= F.col("in_class")), name="numbered")
    inside = Window.partitionBy("class", "bin").orderBy("i")
    dealt = numbered.where("whole").select(
        "doc_id", "start", "length", "doc_tokens", "ids", "class",
        (F.lit(LEFTOVER) + F.col("class").cast("long") * F.lit(1 << 40) + F.col("bin")).alias("sequence_id"),
        (F.sum("length").over(inside) - F.col("length")).alias("offset"),
    )
    mixed = in_batches(numbered.where("not whole").select("doc_id", "start", "length", "doc_tokens", "ids").coalesce(1),
        _pack_mixed(capacity), PLACED)
    return settled.unionByName(dealt).unionByName(mixed)


def padding(pieces: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """One row: sequences, tokens, padding tokens, and padding as a share of all."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long") == F.col("n")
    pad = F.when(power, 0).otherwise(F.lit(capacity) - F.col("n"))
    return per.agg(
        F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"),
    ).withColumn("share", F.col("padding") / (F.col("tokens") + F.col("padding")))
