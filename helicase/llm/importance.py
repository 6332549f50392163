"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target text (documents
labelled good) and one of the raw corpus, give each document the log of its
importance weight, ``log p_target - log p_raw``.  Adding Gumbel noise and taking
the k largest samples k documents without replacement in proportion to their
weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stage
from .words import word_hashes

BUCKETS = 1 << 14
#: At most so many labelled documents make the target model.
MAX_TARGET_DOCS = 50_000
#: Weight of the raw model in the target model's counts, per bucket.
SMOOTHING = 1.0


def ngram_buckets(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every word and every pair of neighbours."""
    h = word_hashes(raw.split())
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x7F4A7C15))
    pairs ^= pairs >> np.uint64(29)
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def _counts(target_ids, buckets: int):
    """Counts of a partition's buckets, in all its texts and in those whose ids the broadcast ``target_ids`` holds."""
    def run(batches):
        targets = target_ids.value
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            ids = b.column(0).to_pylist()
            grams = [ngram_buckets(t or b"", buckets) for t in b.column(1).cast(pa.binary()).to_pylist()]
            good = [g for i, g in zip(ids, grams) if i in targets]
            raw += np.bincount(np.concatenate(grams), minlength=buckets) if grams else 0
            target += np.bincount(np.concatenate(good), minlength=buckets) if good else 0
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    return run


def log_ratios(docs: DataFrame, target_ids: set[int], buckets: int, smoothing: float) -> np.ndarray:
    """Per bucket, the log of target over raw probability.  Counts cover all documents; the result has ``buckets`` numbers."""
    if not target_ids:
        return np.zeros(buckets)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(target_ids))
    sums = in_batches(docs, _counts(shared, buckets), "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in sums.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    # a bucket that the target lacks is as likely as in raw text, times a constant
    share = (raw + 1e-3) / (raw + 1e-3).sum()
    target += smoothing * buckets * share
    return np.log(target / target.sum()) - np.log(share)


def _scores(ratios: np.ndarray):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            grams = [ngram_buckets(t or b"", len(ratios)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            weight = [float(ratios[g].sum()) for g in grams]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(g) for g in grams], pa.int64()), pa.array(weight, pa.float64())],
                ["doc_id", "n_grams", "log_weight"])

    return run


def kth_largest(scored: DataFrame, key: str, k: int, *, parts: int = 2048, few: int = 10_000) -> float | None:
    """The k-th largest value of ``key``, found by narrowing ranges; None if there are fewer."""
    low, high = scored.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return None
    while True:
        inside = scored.where((F.col(key) >= low) & (F.col(key) <= high))
        width = (high - low) / parts
        n = inside.count()
        if n <= few or width <= 0 or low + width == low:
            rows = inside.select(key).orderBy(F.desc(key)).limit(few).collect() if n <= few else []
            return rows[k - 1][0] if k <= len(rows) else low
        part = F.least(F.floor((F.col(key) - low) / width), F.lit(parts - 1))
        counts = {r["part"]: r for r in inside.groupBy(part.alias("part")).agg(
            F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()}
        for p in sorted(counts, reverse=True):
            if counts[p]["n"] >= k:
                low, high = counts[p]["low"], counts[p]["high"]
                break
            k -= counts[p]["n"]
        else:
            return low


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    share: float | None = None,
    margin: float = 6.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    max_target_docs: int = MAX_TARGET_DOCS,
    seed: int = 11,
) -> DataFrame:
    """Sample documents in proportion to how target-like they are.

    Returns one row per document: ``id, n_grams, log_weight, key, kept``.
    ``kept`` marks the k largest keys.  k is ``share`` of the documents; by
    default, as many as have a log weight of ``-margin`` or more, that is, as
    the target model finds no less likely than the raw one but for ``margin``
    nats, which chance gives a short clean text.

    Defined cases: a null or empty text has no n-grams and weight 0 (log).
    Null ids share one Gumbel noise.  Documents that tie at the k-th key are
    all kept.  Repeated rows have equal keys.  Without a good label both
    models are the same and all weights are 0.  An empty table gives no rows.

    Scale: texts are read twice and never shuffled.  Counts cover all
    documents; only ``buckets`` sums reach the driver.  The target model takes
    the labelled documents with the ``max_target_docs`` least hashes, a bound
    on what is broadcast.
    """
    good = labels.where(F.col(quality_col) == 1).select(F.col("doc_id").cast("long").alias("i")).distinct()
    ids = {r["i"] for r in good.orderBy(F.xxhash64("i"), "i").limit(max_target_docs).collect()}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ratios = log_ratios(rows, ids, buckets, smoothing)
    digest = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")), F.lit(seed))
    u = (F.pmod(digest, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    scored = stage(in_batches(rows, _scores(ratios), "doc_id long, n_grams long, log_weight double").withColumn(
        "key", F.col("log_weight") - F.log(-F.log(u))), name="weights")
    if share is None:
        k = scored.where(F.col("log_weight") >= -margin).count()
    else:
        k = int(scored.count() * share + 0.5)
    cut = kth_largest(scored, "key", k)
    return scored.select(
        F.col("doc_id").alias(id_col), "n_grams", "log_weight", "key",
        (F.col("key") >= F.lit(cut) if cut is not None else F.lit(False)).alias("kept"))
