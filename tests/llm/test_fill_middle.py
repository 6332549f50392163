"""Cuts against a plain version on Python strings, lists of offsets against the offsets themselves."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helicase.llm.fill_middle import Offsets, arrange, boundaries, fill_in_middle, restore

from .conftest import SCHEMA, awkward, prose, rows_of


def plain_version(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(t)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t, t
    pre, mid, suf = t[:a], t[a:z], t[z:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, a, z - a, out, t


def corpus() -> list[tuple]:
    texts = [(100 + i, "shared ñ text 日本 " * (1 + i % 3)) for i in range(40)]
    texts += [(200, "has <P> in it"), (201, "<S>"), (202, "x<M"), (203, "<<P"), (204, ">S>"), (205, "𝒳" * 300), (206, "aé日𝒳" * 5000), (-7, "minus")]
    texts += [(300 + i, x * 3) for i, x in enumerate(("<", "<P", "<S", "<M", ">", "P>"))]
    return awkward() + rows_of(texts) + [(None, *r[1:]) for r in rows_of([(1, "shared ñ text 日本 ")] * 3)]


def test_documents(spark):
    docs = corpus()
    got = fill_in_middle(spark.createDataFrame(docs, SCHEMA).withColumn("key", F.lit("k")).withColumn("_likely", F.lit(1)).withColumn("low", F.lit(1)))
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(plain_version(d[0], d[1]) for d in docs)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_texts_that_share_a_hash(spark, monkeypatch):
    """With one key for all texts, those that aren't the indexed one make their own lists."""
    real = F.xxhash64
    monkeypatch.setattr("helicase.llm.fill_middle.F.xxhash64", lambda *c: real(F.lit(1)) if len(c) == 1 else real(*c))
    docs = corpus()
    rows = [tuple(r) for r in fill_in_middle(spark.createDataFrame(docs, SCHEMA)).collect()]
    assert Counter(rows) == Counter(plain_version(d[0], d[1]) for d in docs)


def test_empty(spark, empty):
    assert fill_in_middle(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), unique=True, max_size=300), st.integers(0, 100_000))
def test_lists_of_offsets(offsets, more):
    offsets = sorted(offsets)
    size = (offsets[-1] + 1 if offsets else 0) + more
    packed = Offsets.of(np.array(offsets, np.int64), size)
    assert [packed.select(i) for i in range(len(offsets) + 1)] == [*offsets, size]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_boundaries(text):
    at = boundaries(text.encode())
    assert at.n == len(text)
    assert [at.select(i) for i in range(at.n + 1)] == [len(text[:i].encode()) for i in range(at.n + 1)]


@settings(max_examples=300, deadline=None)
@given(*[st.text("<>PSMx", max_size=8)] * 3, st.sampled_from(["psm", "spm", "plain"]))
def test_round_trip(prefix, middle, suffix, form):
    text = prefix + middle + suffix
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    parts = [x.encode() for x in (prefix, middle, suffix)]
    assert restore(form, arrange(form, *parts)) == text.encode()


def test_a_long_text(spark):
    text = prose(1, 200_000)
    got = fill_in_middle(spark.createDataFrame(rows_of([(1, text), (2, text), (3, text)]), SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [plain_version(i, text) for i in (1, 2, 3)]
