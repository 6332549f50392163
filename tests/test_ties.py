"""Values on a rounding border and equal matches: what queries give is what their SQL gives."""

from pathlib import Path

import duckdb
import pytest

from helicase import catalog

DATA = Path("/root/testdata/sf0.001")


def both(spark, folder, name, *tables):
    """Rows of a query and of its SQL, as sorted text."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, str(folder)).select(*columns).collect()
    return sorted(str(tuple(r)) for r in got), sorted(str(r) for r in want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="test tables are absent")
def test_scores_on_a_border_round_as_in_sql(spark, tmp_path):
    """Prices of which a hundred-thousandth lies on a border of four places as decimal text, and beside it in binary."""
    duckdb.sql(f"COPY (SELECT * REPLACE (1005 + 10.0 * (row_number() OVER ())::DOUBLE AS l_extendedprice) FROM read_parquet('{DATA}/lineitem.parquet')) TO '{tmp_path}/lineitem.parquet'")
    got, want = both(spark, tmp_path, "export_tsv", "lineitem")
    assert got == want


@pytest.mark.parametrize("name", ["block_report", "pairwise_identity_matrix"])
def test_identities_on_a_border_round_as_in_sql(spark, tmp_path, name):
    """57, 69 and 139 of 800 columns alike: on a border of four places as decimal text, and beside it in binary."""
    rows = [(conv, turn, role, "a" * same + x * (800 - same)) for conv, same in enumerate((57, 69, 139)) for turn, role, x in ((0, "user", "a"), (1, "system", "c"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    got, want = both(spark, tmp_path, name, "conversations")
    assert got == want


def test_equal_and_cut_matches_as_in_sql(spark, tmp_path):
    """9 and 10 are equally like the query 9; of 20's match with 21 a mismatch near the end would be cut off."""
    import random

    draw = random.Random(5)
    base = {"A": -0.5, "C": -0.05, "G": 0.05, "U": 0.5}
    change = dict(zip("ACGU", "CGUA"))
    seqs = {i: "".join(draw.choices("ACGU", k=64)) for i in (3, 9, 20)}
    at = seqs[9][32]
    seqs[10] = seqs[9][:32] + change[change[at]] + seqs[9][33:]
    near = seqs[20][:32] + change[seqs[20][32]] + seqs[20][33:]
    seqs[21] = near[0] + change[near[1]] + near[2:]
    rows = [(i, 0, [base[c] for c in s]) for i, s in seqs.items()]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").toPandas().to_parquet(f"{tmp_path}/embeddings.parquet")
    got, want = both(spark, tmp_path, "similarity_search", "embeddings")
    assert got == want
