"""The screen without trained models: windows against shuffled copies of themselves, on both strands.

Draws of a window are dealt over rows, so that one window's shuffles run in
many tasks; their energies meet again in a grouped mean and deviation.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.energy import energies
from ..functions.folding import Fold, Room, encode
from ..session import settled
from .folding import in_batches
from .slices import ragged_windows, reverse_blocks

#: Draws that one row of the plan stands for.
DRAWS_AT_ONCE = 20


def cells_of(rows: list[str]) -> np.ndarray:
    return np.stack([np.frombuffer(r.encode("latin-1", "replace"), np.uint8) for r in rows])


def patterns(cells: np.ndarray) -> list[np.ndarray]:
    """Columns of one pattern (the same gaps, the same rows equal) together."""
    first = (cells[:, None] == cells[None]).argmax(1)  # of every cell, the first row with its letter
    first[cells == ord("-")] = -1
    kinds: dict[bytes, list[int]] = {}
    for col, kind in enumerate(first.T.copy()):
        kinds.setdefault(kind.tobytes(), []).append(col)
    return [np.array(cols) for cols in kinds.values()]


def drawn_columns(kinds: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Of every place, the column that moves there."""
    source = np.empty(sum(map(len, kinds)), np.int64)
    for cols in kinds:
        # one column stays, and takes no draw
        source[cols] = rng.permutation(cols) if len(cols) > 1 else cols
    return source


def shuffled_pattern(rows: list[str], rng: np.random.Generator) -> list[str]:
    """Columns of one pattern change places."""
    cells = cells_of(rows)
    source = drawn_columns(patterns(cells), rng)
    return [r.tobytes().decode("latin-1") for r in cells[:, source]]


def consensus_energies_udf(parameters: str = ""):
    """A function of an alignment's rows: its consensus energy."""
    @F.pandas_udf("double")
    def folded(blocks: pd.Series) -> pd.Series:
        known, got, room = [list(b) for b in blocks], np.zeros(len(blocks)), Room()
        for group in in_batches([len(b[0]) for b in known], [len(b) for b in known]):
            got[group] = Fold([known[g] for g in group], energies(parameters), consensus=True, room=room).energy()
        return pd.Series(got)

    return folded


def drawn_energies_udf(parameters: str = ""):
    """A function of an alignment's rows and a range of draws (from, to): the consensus energy of each shuffled copy."""
    @F.pandas_udf("array<double>")
    def drawn(blocks: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        known, room = [list(b) for b in blocks], Room()
        got: list = [None] * len(known)
        for group in in_batches([len(b[0]) for b in known], [len(b) for b in known], int((high - low).max()) if len(known) else 1):
            copies = []
            for g in group:
                rows, lo, hi = known[g], low[g], high[g]
                seed, kinds, codes = zlib.crc32("\n".join(rows).encode()), patterns(cells_of(rows)), encode(rows)
                at = np.stack([drawn_columns(kinds, np.random.default_rng([seed, i])) for i in range(lo, hi)])
                # narrower ones end in gaps
                made = np.zeros((hi - lo, len(rows), len(known[group[0]][0])), codes.dtype)
                made[:, :, :codes.shape[1]] = codes[:, at].transpose(1, 0, 2)
                copies.append(made)
            folded = Fold(np.concatenate(copies), energies(parameters), consensus=True, room=room).energy()
            for g, own in zip(group, np.split(folded, np.cumsum([len(c) for c in copies])[:-1])):
                got[g] = own.tolist()
        return pd.Series(got)

    return drawn


def shuffled_screen(
    blocks: DataFrame, *, size: int | None = None, step: int | None = None, samples: int = 100, threshold: float = 0.0,
    strands: str = "+-", parameters: str = "",
) -> DataFrame:
    """Consensus energy of every window and strand against shuffled copies of the window.

    Gives ``block_id, slice_start, slice_end, strand, mfe, mean_mfe, sd_mfe,
    z``, positions in columns of the forward strand.  ``size`` and ``step``
    cut windows, the last shorter; without them a block is one window.  Only
    windows of ``threshold`` kcal/mol or less are shuffled; elsewhere mean,
    deviation (of the population) and z are null.  z is 0 where copies don't
    differ.  Draws are seeded by the rows.  ``block_id`` is unique; blocks
    without columns or rows give nothing.
    """
    whole = blocks.where((F.col("n_cols") > 0) & (F.size("rows") > 0))
    if size is None:
        cut = whole.withColumn("slice_start", F.lit(0)).withColumn("slice_end", F.col("n_cols"))
    else:
        cut = ragged_windows(whole, size=size, step=step, past_end=False)
    key = ["block_id", "slice_start", "slice_end", "strand"]
    read = [(reverse_blocks(cut) if s == "-" else cut).withColumn("strand", F.lit(s)) for s in strands]
    windows = read[0]
    for other in read[1:]:
        windows = windows.unionByName(other)
    windows = windows.select(*key, F.transform("rows", lambda r: sq.as_rna(r["seq"])).alias("seqs"))
    # folding costs more than the shuffle, so windows, and then draws, are dealt evenly over tasks
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # folded once: the windows that are shuffled and the rows of the answer are the same
    native = settled(windows.repartition(tasks, *key).withColumn("mfe", consensus_energies_udf(parameters)("seqs")))
    low = native.where(F.col("mfe") <= threshold).withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(DRAWS_AT_ONCE))))
    draws = low.repartition(tasks, *key, "_from").select(*key, F.explode(
        drawn_energies_udf(parameters)("seqs", F.col("_from"), F.least(F.col("_from") + DRAWS_AT_ONCE, F.lit(samples)))).alias("_e"))
    background = draws.groupBy(*key).agg(F.avg("_e").alias("mean_mfe"), F.stddev_pop("_e").alias("sd_mfe"))
    return native.drop("seqs").join(background, key, "left").withColumn(
        "z", F.when(F.col("sd_mfe") < 1e-5, 0.0).otherwise((F.col("mfe") - F.col("mean_mfe")) / F.col("sd_mfe")))
