"""Work on blocks is dealt over as many tasks as a shuffle has, however few bytes they are."""

from pathlib import Path

import pytest

from helicase.plans.fixtures import blocks

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="test tables are absent")
def test_blocks_are_dealt_evenly(spark):
    sizes = blocks(spark, str(DATA)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(sizes) > 0


def test_pairs_of_columns_meet_their_block_once(spark):
    """A tile of pairs is one row beside its block's rows, whatever the number of pairs; columns that aren't there pair with nothing."""
    from helicase.operators.blocks import covariance_of_pairs

    made = spark.createDataFrame([(1, 6, [(0, "GCAAGC"), (1, "CGAACG")])], "block_id long, n_cols int, rows array<struct<idx:int,seq:string>>")
    pairs = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 3), (1, 0, 9)], "block_id long, i int, j int")
    found = covariance_of_pairs(made, pairs)
    assert {(r.i, r.j): (r.none, r.changes, r.score) for r in found.collect()} == {
        (0, 5): (0, 2, 100), (1, 4): (0, 2, 100), (2, 3): (2, 0, -10_000), (0, 9): (2, 0, -10_000)}
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def test_loci_are_dealt_once(spark):
    """Loci, and loci that keep a hit, take one exchange of the hits where no sequence is long."""
    from helicase.operators import hits as ops

    rows = spark.range(1000).selectExpr("concat('s', id % 7) AS seq_id", "id * 13 % 997 AS start", "id * 13 % 997 + 3 AS end", "id % 3 AS n", "1.0 AS identity", "0.6D AS p", "-1.0 AS z")
    found = ops.cluster_hits(rows)
    for df in (ops.locus_stats(found), ops.filter_hits(found, "N = 1")[1]):
        assert df._jdf.queryExecution().sparkPlan().toString() and df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1, plan


def test_islands_of_long_sequences_as_of_short_ones(spark):
    """Bins of 10 positions, intervals over many of them, equal rows, and a row without a start."""
    import random

    from helicase.operators.intervals import islands

    draw = random.Random(4)
    rows = [(s, a, a + draw.choice([0, 1, 3, 40]), i) for i, (s, a) in enumerate((draw.choice("aab"), draw.randrange(3000)) for _ in range(700))]
    rows += [("c", 5, 9, 1000), ("c", 9, 12, 1001), ("c", 5, 9, 1002)]
    want, state = {}, {}
    for s, a, e, i in sorted(rows):
        island, reach = state.get(s, (None, None))
        island, reach = (a, e) if reach is None or a > reach else (island, max(reach, e))
        state[s], want[i] = (island, reach), island
    df = spark.createDataFrame([*rows, ("a", None, 7, 2000)], "seq_id string, start long, end long, i long")
    for whole in (1, 300, 10_000):
        assert {r.i: r.island for r in islands(df, bin_size=10, whole_rows=whole).collect()} == want
