"""Making the package known to a session's Python workers."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for this application: below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of this machine.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="helicase-")
        context.setCheckpointDir(found)
    return f"{found.rstrip('/')}/helicase/{context.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and checkpointed in the shared folder.

    For results that cost much, are used several times, or must not come out
    otherwise if they are computed again.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application.

    Kernels are pickled by reference, so workers must be able to import them
    wherever they run.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="helicase-")) / "helicase_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shipped(query: Callable) -> Callable:
    """``query(spark, ...)``, run after the package has been sent."""

    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship_package(spark)
        return query(spark, *args, **kwargs)

    return run
