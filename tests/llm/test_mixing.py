from helicase.llm.common import stage
from helicase.llm.mixing import mix_sources, repeat_documents

from .conftest import SCHEMA, awkward


def fill(sizes, weights, budget, most):
    """Water-filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, live = budget * sum(sizes.values()), {}, set(order)
    left = total
    while live:
        share = {s: left * w[s] / sum(w[x] for x in live) for s in live}
        full = {s for s in live if share[s] >= most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        live -= full
    return target


def words(text):
    return len((text or "").encode().split())


def test_targets_and_takes(documents):
    rows = awkward()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    want = fill(sizes, [5.0, 2.0, 1.0], 1.5, 2.0)
    got = mix_sources(documents).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    largest = {s: max(words(r[1]) for r in rows if r[3] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_reruns_and_partitions_agree(documents):
    a = sorted(map(str, mix_sources(documents).collect()))
    b = sorted(map(str, mix_sources(documents.repartition(7)).collect()))
    c = sorted(map(str, mix_sources(documents, ranges=3).collect()))
    assert a == b == c


def test_the_sorted_range_is_small_at_any_weight(spark, monkeypatch):
    """Documents of the least weight fall into as many ranges as others; no range holds over a 100th of a source."""
    import helicase.llm.mixing as mixing

    staged = {}

    def spied(df, *, name="stage"):
        staged[name] = stage(df, name=name)
        return staged[name]

    monkeypatch.setattr(mixing, "stage", spied)
    texts = ["# " * 12, "word " * 12]
    df = spark.range(6000).selectExpr("id AS doc_id", f"CASE WHEN id % 2 = 0 THEN '{texts[0]}' ELSE '{texts[1]}' END AS text",
                                      "CASE WHEN id % 2 = 0 THEN 'noise' ELSE 'prose' END AS source")
    taken = {r.source: (r.n, r.target) for r in mixing.mix_sources(df).groupBy("source").agg({"taken": "sum", "target": "max"}).toDF("source", "n", "target").collect()}
    largest = {r.source: r.n for r in staged["ranges"].groupBy("source").agg({"words": "max"}).toDF("source", "n").collect()}
    for s in ("noise", "prose"):
        assert largest[s] <= 3000 * 12 / 100
        assert abs(taken[s][0] - taken[s][1]) <= 12


def test_epochs_come_first(spark):
    df = spark.createDataFrame([(i, "w " * 10, "en", "a" if i % 10 else "b", 1, 1, "", "") for i in range(200)], SCHEMA)
    got = mix_sources(df, weights=[1.0, 9.0]).collect()
    b = [r.copies for r in got if r.source == "b"]
    assert b == [2] * 20  # filled up
    assert {r.copies for r in got if r.source == "a"} == {1, 2}


def test_repeat_and_empty(spark, documents, empty):
    assert mix_sources(empty).count() == 0
    plain = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    mixed = mix_sources(plain)
    out = repeat_documents(plain, mixed)
    assert out.columns == documents.columns
    assert out.count() == mixed.agg({"copies": "sum"}).first()[0]
