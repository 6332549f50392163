"""Filter conditions in the form that screens use."""

import pytest
from pyspark.sql import functions as F

from helicase.functions.filters import FilterError, filter_column, filter_sql
from helicase.sources.reports import HIT_COLUMNS

ROWS = [
    ("window1", "locus1", "hg17.chr1", 10, 130, "+", 4, 120, 80.5, -30.0, -28.0, -20.0, -8.0, 1.4, -3.5, 0.93, 1.2, 0.95, 0.5),
    ("window2", "locus1", "hg17.chr13", 50, 170, "-", 6, 120, 95.0, -25.0, -10.0, -8.0, -2.0, 1.0, -1.0, 0.4, -0.5, 0.3, 0.4),
    ("window3", "locus2", "mm.chrX", 5, 90, "+", 2, 85, 60.0, -12.0, -11.0, -11.0, 0.0, 1.1, -4.5, 0.9, 0.9, 0.9, 0.6),
]


@pytest.fixture(scope="module")
def hits(spark):
    kinds = ["string"] * 3 + ["long"] * 2 + ["string"] + ["long"] * 2 + ["double"] * 11
    return spark.createDataFrame(ROWS, ", ".join(f"{c} {k}" for c, k in zip(HIT_COLUMNS, kinds)))


@pytest.mark.parametrize("text, want", [
    ("P > 0.9", {1}), ("P >= 0.9 and z < -4", {3}), ("P>0.9 or N==6", {1, 2}), ("not P > 0.5", {2}), ("!(P > 0.5) || SCI < 0.1", {2}),
    ("seqID =~ /chr1$/", {1}), ("seqID =~ /CHR1/i && strand eq '+'", {1}), ("seqID !~ m/chr/", set()), ("seqID !~ /^hg17\\.chr1/", {3}),
    ("COL18 > 0.5 and COL7 < 4", {3}), ("meanMFE < -20 and combPerPair >= 1.4", {1}), ("mean_mfe < -20 and COMB_PER_PAIR >= 1.4", {1}),
    ("hitID eq \"window2\"", {2}), ("locusID ne 'locus1' and windowID eq 'window3'", {3}), ("clusterID eq 'locus1'", {1, 2}),
    ("P > 0.5 or P > 0.2 and N > 100", {1, 3}), ("(P > 0.5 or P > 0.2) and N > 100", set()), ("end - start > 100 and identity != 95", {1}),
    ("z < -(2 + 1) and not (N < 3 or strand eq '-')", {1}), ("consensusMFE/meanMFE > 0.92", {1}), ("COL19 > 0.55", {3}), ("seqID eq 'it''s'", None),
    ("-z > 4 && decValue <= .9", {3}), ("P > 9e-1", {1}),
    ("not P > 0.5 && N > 3", {2, 3}), ("(not P > 0.5) && N > 3", {2}), ("N == 2 || N == 4 and P > 0.93", {1}), ("N == 2 or N == 4 and P > 0.93", {1, 3}), ("not (N == 2 || N == 4) or z < -4", {2, 3}),
])
def test_conditions(hits, text, want):
    if want is None:
        with pytest.raises(FilterError):
            filter_column(text)
        return
    assert {int(r.window_id[-1]) for r in hits.where(filter_column(text)).collect()} == want


@pytest.mark.parametrize("text, position", [
    ("P > ", 4), ("P >> 1", 3), ("Q > 1", 0), ("P > 0.5 and", 11), ("(P > 0.5", 0), ("P > 0.5)", 7), ("P 0.5", 2), ("COL20 > 1", 0), ("COL0 > 1", 0), ("seqID =~ chr", 8),
    ("seqID =~ /(/", 8), ("system('x')", 0), ("P > 0.5; N", 7), ("", 0), ("and P > 1", 0), ("P > 1 not N > 1", 6), ("`P` > 1", 0),
])
def test_errors_have_a_position(spark, text, position):
    with pytest.raises(FilterError) as problem:
        filter_sql(text)
    assert problem.value.position == position


def test_pushed_down(hits, spark, tmp_path):
    hits.write.parquet(str(tmp_path / "hits"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = spark.read.parquet(str(tmp_path / "hits")).where(filter_column("P > 0.9 and N >= 4 and strand eq '+'"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert all(x in pushed for x in ("GreaterThan(p,0.9)", "GreaterThanOrEqual(n,4)", "EqualTo(strand,+)"))
