"""Exact deduplication by two passes over a Bloom filter.

Pass one builds a filter of fixed size that tells for each cell whether one or
several rows fell into it.  Pass two tests each row's hash: a hash whose cells
were not all hit several times is proven to occur once, and its row passes
straight through.  Only the possibly repeated rows are shuffled by their full
SHA-256 and grouped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, shuffle_partitions, stage

#: The filter is cut into this many blocks, which are merged independently.
BLOCKS = 256
#: Cells a hash falls into.
PROBES = 2
#: Least and most bytes of a filter whose size the caller leaves open.
FILTER_BYTES = 1 << 20, 1 << 26


def filter_size(rows: int) -> int:
    """Bytes of the filter for so many rows: the power of two from one byte a row on, within FILTER_BYTES."""
    low, high = FILTER_BYTES
    return min(high, max(low, 1 << max(rows - 1, 1).bit_length()))


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    """The PROBES cells of each hash, as a (PROBES, n) array."""
    h = h.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return np.stack([(low + np.uint64(i) * (high | np.uint64(1))) % np.uint64(cells) for i in range(PROBES)])


def _sparse_counts(column: str, cells: int):
    """Per partition: for each block of the filter, the cells hit once and those hit more often."""
    per = cells // BLOCKS

    def emit(hit: np.ndarray, often: np.ndarray):
        for block in np.unique(hit // per):
            lo, hi = np.searchsorted(hit, [block * per, (block + 1) * per])
            at, twice = (hit[lo:hi] - block * per).astype("<u4"), often[lo:hi]
            yield int(block), at[~twice].tobytes(), at[twice].tobytes()

    def run(batches):
        kept: list[np.ndarray] = []
        held = 0

        def flush():
            if not kept:
                return None
            hit, n = np.unique(np.concatenate(kept), return_counts=True)
            rows = list(emit(hit.astype(np.int64), n > 1))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([r[0] for r in rows], pa.int32()),
                "once": pa.array([r[1] for r in rows], pa.binary()),
                "often": pa.array([r[2] for r in rows], pa.binary()),
            })

        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            # a hash's own probes may coincide; they count once
            probes = np.sort(_cells(h, cells), axis=0)
            fresh = np.ones(probes.shape, bool)
            fresh[1:] = probes[1:] != probes[:-1]
            kept.append(probes[fresh])
            held += len(h)
            if held >= 1_000_000:
                yield flush()
                kept.clear()
                held = 0
        if (out := flush()) is not None:
            yield out

    return run


def _merge_blocks(per: int):
    """Sorted by block: the cells of each block that several rows hit, as bits."""

    def run(batches):
        block, seen, often = None, None, None

        def done():
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int32()),
                "bits": pa.array([np.packbits(often).tobytes()], pa.binary()),
            })

        for b in batches:
            for k, once, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != block:
                    if block is not None:
                        yield done()
                    block, seen, often = k, np.zeros(per, bool), np.zeros(per, bool)
                a, m = np.frombuffer(once, "<u4"), np.frombuffer(more, "<u4")
                often[a[seen[a]]] = True
                seen[a] = True
                seen[m] = True
                often[m] = True
        if block is not None:
            yield done()

    return run


def repeated_filter(digests: DataFrame, column: str, filter_bytes: int) -> dict[int, bytes]:
    """The merged filter: at most ``filter_bytes`` in all, whatever the input's size."""
    cells = filter_bytes * 8
    per = cells // BLOCKS
    spark = digests.sparkSession
    sparse = digests.select(column).mapInArrow(_sparse_counts(column, cells), "block int, once binary, often binary")
    merged = (
        sparse.repartition(min(BLOCKS, shuffle_partitions(spark)), "block")
        .sortWithinPartitions("block")
        .mapInArrow(_merge_blocks(per), "block int, bits binary")
    )
    return {r["block"]: r["bits"] for r in merged.collect()}


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=None,
    filter_bytes: int | None = None,
) -> DataFrame:
    """One row per document: which copy of its text stays.

    Returns ``id, keep_id, group_size, kept, text_sha256``.  Texts are equal
    when ``normalise(text)`` (default: the text itself) is; of equal texts
    the row with the largest id stays.

    Defined cases: a null text counts as empty.  A null id is never the
    largest; if all ids of a group are null, one of its rows stays and
    ``keep_id`` is null.  Of rows that agree in id and text one stays.  An
    empty table gives no rows.  Other columns are not read.

    Scale: ``filter_bytes`` bounds the filter and with it what is sent to the
    driver and broadcast; by default it grows with the rows, a byte or two for
    each, up to 64 MB.  Beyond about two hashes per byte more unique rows are
    taken for possibly repeated and join the shuffle (of 48-byte digests, not
    of texts); results don't change.  Groups are counted before
    the shuffle and joined back with salted keys.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    if normalise is not None:
        text = normalise(text)
    digests = stage(docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
    ), name="digests").withColumn("h", F.xxhash64("sha"))

    filter_bytes = filter_bytes or filter_size(digests.count())
    cells = filter_bytes * 8
    per = cells // BLOCKS
    shared = spark.sparkContext.broadcast(repeated_filter(digests, "h", filter_bytes))

    @F.pandas_udf("boolean")
    def maybe_repeated(h):
        import pandas as pd

        bits = shared.value
        cell = _cells(h.to_numpy().view(np.uint64), cells).astype(np.int64)
        out = np.ones(len(h), bool)
        for probe in cell:
            block, at = probe // per, probe % per
            got = np.zeros(len(h), bool)
            for k in np.unique(block):
                if (raw := bits.get(int(k))) is not None:
                    own = np.flatnonzero(block == k)
                    byte = np.frombuffer(raw, np.uint8)[at[own] >> 3]
                    got[own] = (byte >> (7 - (at[own] & 7)).astype(np.uint8)) & 1
            out &= got
        return pd.Series(out)

    tested = stage(digests.withColumn("maybe", maybe_repeated("h")).drop("h"), name="tested")
    alone = tested.where("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
    counted = tested.where("maybe").groupBy("sha", "id").agg(F.count("*").alias("n"))
    groups = counted.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    joined = salted_join(counted, groups, "sha", ["id"], how="inner")
    repeated = joined.select(
        "id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")
    ).select(
        "id", "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return alone.unionByName(repeated).withColumnRenamed("id", id_col)
