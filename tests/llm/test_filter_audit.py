"""Audits against all orders walked through row by row."""

import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helicase.llm.filter_audit import audit, filter_audit

from .conftest import SCHEMA, awkward, prose, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def walked(rows: list[tuple[str, set, set]], names: str) -> dict:
    """(part, order, step) -> figures, from rows of (part, failed filters, weights)."""
    out = {}
    for part in {p for p, _, _ in rows}:
        own = [(f, w) for p, f, w in rows if p == part]
        totals = defaultdict(int)
        for order in itertools.permutations(names):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(f, w) for f, w in left if x in f]
                left = [(f, w) for f, w in left if x not in f]
                totals[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for f, _ in own) - len(gone), sum(f == {x} for f, _ in own),
                    sum("good" in w for _, w in gone), sum("toxic" in w for _, w in gone), x]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = totals[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def told(df) -> dict:
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def failures(docs: list[tuple]) -> list[set]:
    """Of rows (id, text), null ids last."""
    out = []
    for i, text in docs:
        t = text or ""
        words = WORD.findall(t)
        found = set()
        if len(words) < 100:
            found.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            found.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            found.add("C")
        if set(t) & set("#$%&*|"):
            found.add("D")
        if any((y or "") == t and j is not None and (i is None or j < i) for j, y in docs):
            found.add("E")
        out.append(found)
    return out


@pytest.mark.parametrize("names", ["A", "AB", "XYZ", "ABCDE"])
def test_random_flags(spark, names):
    r = random.Random(len(names))
    rows = [(r.choice("pq"), {x for x in names if r.random() < 0.4}, {w for w in ("good", "toxic") if r.random() < 0.3}) for _ in range(200)]
    rows += [("clean", set(), set())] * 3
    flags = spark.createDataFrame(
        [(p, *[int(x in f) for x in names], int("good" in w), int("toxic" in w)) for p, f, w in rows],
        "p string, " + ", ".join(f"{x} long" for x in names) + ", good long, toxic long")
    assert told(audit(flags, "p", list(names), {"good_lost": "good", "toxic_lost": "toxic"})) == walked(rows, names)


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        audit(spark.range(1), "id", list("ABCDEFGH"), {})
    with pytest.raises(ValueError):
        audit(spark.range(1), "id", ["AB"], {})


def corpus() -> list[tuple]:
    texts = [(i, prose(i % 6, 60 + 15 * (i % 5))) for i in range(30)]
    texts += [(40, " ".join(f"w{i}" for i in range(150))), (41, "LOUD " * 120), (42, "a & b"), (43, " ".join(f"x{i}" for i in range(99)))]
    texts += [(44, "A" + "b" * 9), (45, "AA" + "b" * 8), (46, " ".join(f"y{i % 80}" for i in range(100))), (47, " ".join(f"y{i % 79}" for i in range(100)))]
    rows = [(*r[:2], "de" if r[0] % 3 else None, *r[3:]) for r in rows_of(texts)]
    rows += [(48, None, "", None, None, None, None, None), (49, "", "de", None, None, None, None, None)]
    return awkward() + rows + [(None, prose(1, 75), "xx", None, None, None, None, None)]


def test_documents(spark):
    docs = corpus()
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (3, None, 1), (4, 0, None), (41, 1, 1), (None, 1, 1), (99, 1, 1), (5, 1, 0), (16, 0, 1)]
    marks = defaultdict(set)
    for i, q, t in labels:
        marks[i] |= {w for w, v in (("good", q), ("toxic", t)) if v == 1}
    marks[None] = set()
    rows = [(d[2] or "", f, marks[d[0]]) for d, f in zip(docs, failures([d[:2] for d in docs]))]
    got = filter_audit(
        spark.createDataFrame(docs, SCHEMA).withColumn("words", F.lit(1)).withColumn("E", F.lit("x")),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert told(got) == walked(rows, "ABCDE")


def test_empty(spark, empty):
    assert filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
