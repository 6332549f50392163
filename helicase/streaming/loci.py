"""Loci over a stream of hits.

The state is the open locus of each sequence.  A hit that begins behind it
closes it; so does the watermark, once nothing more may come for it.  The
checkpoint holds the state, so a restart loses and repeats nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN = "start long, end long, last_end long, windows long, max_n long, max_identity double, max_p double, min_z double, seen_ms long"
LOCUS = "seq_id string, start long, end long, windows long, max_n long, max_identity double, max_p double, min_z double"


def merged(hits: pd.DataFrame, held: tuple | None, compat: bool) -> tuple[list[tuple], tuple | None]:
    """The loci that hits in order close, and the one that stays open.

    A locus is (start, end, end of its last hit, windows, greatest n, identity
    and p, least z).
    """
    closed, now = [], held
    for h in hits.itertuples(index=False):
        if now is not None and h.start <= (now[2] if compat else now[1]):
            now = (now[0], max(now[1], h.end), h.end, now[3] + 1, max(now[4], h.n), max(now[5], h.identity), max(now[6], h.p), min(now[7], h.z))
        else:
            if now is not None:
                closed.append(now)
            now = (h.start, h.end, h.end, 1, h.n, h.identity, h.p, h.z)
    return closed, now


def stream_loci(hits: DataFrame, *, time: str = "stamp", late: str = "10 minutes", hold_ms: int = 600_000, cutoff: float = 0.5, compat: bool = False) -> DataFrame:
    """Loci of a stream of hits (``seq_id, start, end, n, identity, p, z`` and the column ``time``), each once it is closed.

    Hits of a sequence come in the order of their starts, as a screen along
    it writes them, batch after batch; within a batch any order will do.  A
    locus closes when a hit begins behind it, or when the watermark, ``late``
    behind the newest ``time``, has passed its last hit by ``hold_ms``.  The rules
    are those of the batch operator, ``compat`` included.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        rows: list[tuple] = []
        if state.hasTimedOut:
            rows = [held[:8]] if held else []
            state.remove()
        else:
            came = pd.concat(list(batches)).sort_values(["start", "end"], kind="stable")
            rows, now = merged(came, held[:8] if held else None, compat)
            newest = int(came["ms"].max())
            seen = max(newest, held[8]) if held else newest
            state.update((*[x.item() if hasattr(x, "item") else x for x in now], seen))
            state.setTimeoutTimestamp(max(seen + hold_ms, state.getCurrentWatermarkMs() + 1))
        made = [(key[0], r[0], r[1], *r[3:8]) for r in rows]
        yield pd.DataFrame(made, columns=[c.split()[0] for c in LOCUS.split(", ")])

    kept = hits.where(F.col("p") >= cutoff).select(
        "seq_id", F.col("start").cast("long"), F.col("end").cast("long"), F.col("n").cast("long"), F.col("identity").cast("double"),
        F.col("p").cast("double"), F.col("z").cast("double"), F.col(time).cast("timestamp").alias("at"))
    timed = kept.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return timed.groupBy("seq_id").applyInPandasWithState(update, LOCUS, OPEN, "append", GroupStateTimeout.EventTimeTimeout)
