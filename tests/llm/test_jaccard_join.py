import random

import pytest

from helicase.llm.jaccard_join import first_of_each, jaccard_components

from .conftest import SCHEMA, awkward, near, prose, rows_of


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([("whole", *w)])


def brute(rows, size, percent):
    sets = [shingle_set(r[1], size) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def check(spark, rows, size, percent):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in jaccard_components(df, size=size, percent=percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows, size, percent)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_awkward_documents(spark, size, percent):
    check(spark, awkward(), size, percent)


def test_chains_of_copies(spark):
    """A large group of near copies around the threshold, whose links form chains, and copies of them."""
    r = random.Random(8)
    bases = [prose(100 + i, 90) for i in range(3)]
    texts, last = [], bases[0]
    for i in range(120):
        base = r.choice(bases)
        texts.append(near(base, i, r.choice([0, 1, 1, 2, 3, 4, 6])))
        if i % 9 == 0:
            last = near(last, 500 + i, 1)
            texts.append(last)
        if i % 7 == 0:
            texts.append(r.choice(texts))
    texts += [base + " common passage of a few words at the end" for base in bases] + [prose(900 + i, 30) + " common passage of a few words at the end" for i in range(40)]
    check(spark, rows_of(list(enumerate(texts))), 3, 90)


def test_empty_and_first(spark, empty):
    assert jaccard_components(empty).count() == 0
    docs = spark.createDataFrame(rows_of([(3, prose(1)), (1, prose(1)), (2, prose(2)), (None, prose(1)), (1, prose(1))]), SCHEMA)
    left = first_of_each(docs, jaccard_components(docs))
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2"]
    assert first_of_each(empty, jaccard_components(empty)).count() == 0


def test_first_of_each_keeps_different_texts(spark, documents):
    """Over all awkward rows: one row of each group, whatever ids they share; rows without words all stay."""
    rows = awkward()
    sets = [shingle_set(r[1], 3) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = [r[1] for r, s in zip(rows, sets) if not s]
    for g in set(group):
        held = [r for r, x, s in zip(rows, group, sets) if x == g and s]
        if held:
            best = min((r[0] is None, r[0] or 0) for r in held)
            want.append({r[1] for r in held if (r[0] is None, r[0] or 0) == best})
    left = [r.text for r in first_of_each(documents, jaccard_components(documents, size=3, percent=90)).collect()]
    assert len(left) == len(want)
    for w in want:
        left.remove(w if not isinstance(w, set) else next(t for t in left if t in w))
    assert not left


def copies(m, words=150):
    base = prose(77, words)
    return rows_of([(i, near(base, i, 1 + i % 14)) for i in range(m)])


def test_pairs_grow_with_the_group(spark, monkeypatch):
    """Doubling a group of near copies no more than about doubles the pairs that are made."""
    import helicase.llm.jaccard_join as module

    made = []
    real = module.verify

    def counted(pairs, sets, percent):
        made.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(module, "verify", counted)
    totals = []
    for m in (150, 300):
        made.clear()
        jaccard_components(spark.createDataFrame(copies(m), SCHEMA), size=5, percent=80).count()
        totals.append(sum(made))
    assert totals[1] <= 3 * totals[0]


@pytest.mark.parametrize("split", [4, 512])
def test_split_groups_lose_nothing(spark, monkeypatch, split):
    """Groups split again and again give the same components as brute force."""
    monkeypatch.setattr("helicase.llm.jaccard_join.PAIRED", 6)
    monkeypatch.setattr("helicase.llm.jaccard_join.PAIRED_SPLIT", split)
    r = random.Random(4)
    second = near(prose(77, 100), 9999, 6)
    texts = [near(r.choice([prose(77, 100), second]), i, r.choice([1, 2, 3, 5, 7])) for i in range(70)]
    check(spark, rows_of(list(enumerate(texts))), 3, 90)


def test_parities_never_exceed_the_difference():
    import numpy as np

    from helicase.llm.jaccard_join import parities

    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        x, y = (np.sort(rng.choice(pool, rng.integers(0, 300), replace=False)) for _ in range(2))
        bits = sum(((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in zip(parities(x), parities(y)))
        assert bits <= len(np.setxor1d(x, y))
    assert parities(np.array([], np.uint64)) == [0, 0, 0, 0]


def test_plans_hold_no_other_plan_twice(spark, monkeypatch):
    """The driver's memory follows the plans: each that links sets or finds components exchanges rows a few times only."""
    import helicase.llm.common as common
    import helicase.llm.jaccard_join as jaccard

    exchanges, real = [], common.stage

    def counted(df, **options):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges.append((options.get("name"), plan.count("Exchange")))
        return real(df, **options)

    monkeypatch.setattr(common, "stage", counted)
    monkeypatch.setattr(jaccard, "stage", counted)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:20 + i % 3] + [f"x{i % 9}"] + words[25:]) for i in range(30)] + ["alone in here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = jaccard_components(docs, size=3, percent=80).collect()
    assert len(got) == 31
    linking = {"groups", "hubs", "pairs", "verified", "edges", "least", "large", "low", "members", "held", "open", "active", "near", "labels", "labelled"}
    assert {"verified", "edges"} <= {name for name, _ in exchanges}
    assert max(n for name, n in exchanges if name in linking) <= 9
