"""New alignment files as a stream.

Blocks are independent of each other, so the stream needs neither time nor state.
Here a folder is watched; every block goes through the same expressions as in a
batch, so a restart from the checkpoint neither loses nor repeats one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.alignments import MAF_SEPARATOR, maf_blocks


def stream_maf(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Blocks of the MAF files that appear in ``folder``."""
    text = spark.readStream.option("lineSep", MAF_SEPARATOR).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return maf_blocks(text)


def screen(blocks: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs ``step`` on what has arrived and appends its rows to Parquet files in ``out``, then stops."""
    return step(blocks).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reference_rows(blocks: DataFrame) -> DataFrame:
    """The first row of each block as an interval."""
    r = F.col("rows")[0]
    return blocks.select(r["name"].alias("seq_id"), r["start"].alias("start"), r["end"].alias("end"), r["strand"].alias("strand"), F.size("rows").alias("n_rows"))
