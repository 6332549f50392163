import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from helicase.llm.exact_dedup import exact_dedup, filter_size

from .conftest import SCHEMA, awkward, rows_of


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        seen = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(documents):
    got = sorted((tuple(r) for r in exact_dedup(documents).collect()), key=str)
    assert got == brute(awkward())


def test_full_filter_changes_nothing(documents):
    """A filter far too small takes every row for repeated; results stay."""
    got = sorted((tuple(r) for r in exact_dedup(documents, filter_bytes=32).collect()), key=str)
    assert got == brute(awkward())


def test_empty_and_normalised(spark, empty):
    assert exact_dedup(empty).count() == 0
    df = spark.createDataFrame(rows_of([(1, "A b"), (2, "a B"), (3, "c")]), SCHEMA)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(df, normalise=F.lower).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True)}


def test_large_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup(df)
    assert out.where("kept").count() == 2001
    assert out.where("group_size = 1000 AND keep_id = 2997").count() == 1000


def test_filter_size_follows_the_rows():
    assert [filter_size(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 10**7, 10**12)] == [1 << 20, 1 << 20, 1 << 20, 1 << 21, 1 << 24, 1 << 26]


def test_staged_tables_can_be_removed(spark, documents):
    import os

    from helicase.llm import common

    staged = common.stage(documents.limit(1))
    assert staged.count() == 1
    assert os.listdir(common.staged_dir(spark).removeprefix("file:"))
    common.remove_staged(spark)
    assert not os.path.exists(common.staged_dir(spark).removeprefix("file:"))
