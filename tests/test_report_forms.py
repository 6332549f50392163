"""Reports by the short way: what the formatter and a search for each field give."""

import random

import pytest
from pyspark.sql import functions as F

from helicase.operators.blocks import materialised
from helicase.sources import reports


@pytest.fixture(scope="module")
def written(spark):
    fields = {name: {"int": F.lit(3), "double": F.lit(-1.25), "string": F.lit("forward")}[kind] for name, _, _, kind in reports.FIELDS}
    row = F.struct(*[F.lit(v).alias(k) for k, v in {"name": "chr1", "start": 5, "end": 35, "strand": "+", "full_length": 900, "seq": "ACGU", "fold": "(..)", "mfe": -3.5, "z": -1.0, "method": "R"}.items()])
    rows = spark.range(1).select(*[c.alias(n) for n, c in fields.items()], F.array(row, row.withField("full_length", F.lit(None).cast("int"))).alias("rows"), F.lit("ACGU").alias("consensus"), F.lit("(..)").alias("structure"))
    return rows.select(reports.report_text().alias("text")).first().text


@pytest.mark.parametrize("form", ["%6.2f", "%2.5f", "%6f"])
def test_numbers_as_the_formatter_writes_them(spark, form):
    draw = random.Random(3)
    xs = [0.0, -0.0, -0.004, -0.005, 0.005, 1.005, -1.005, 99.0, -99.996, 999.995, 1e9, -1e12, float("nan"), float("inf"), float("-inf"), None]
    xs += [draw.uniform(-1, 1) * 10 ** draw.randint(-6, 11) for _ in range(2000)] + [draw.randint(-20000, 200000) / 1000 for _ in range(2000)]
    n = spark.createDataFrame([(x,) for x in xs], "x double")
    assert n.where(~F.format_string(form, "x").eqNullSafe(reports._shown(form, F.col("x")))).collect() == []


def test_a_written_report_is_read_by_one_expression(spark, written):
    n = len(reports.FIELDS)
    parts = spark.createDataFrame([(written,)], "text string").select(reports._groups(F.col("text"), reports._HEAD, n + 1).alias("p")).first().p
    assert len(parts) == n + 2 and parts[1] == "3" and parts[-1].count(">") == 3


def test_odd_reports_give_what_a_search_finds(spark, written):
    odd = [written, written * 2, written.replace(" Columns: 3\n", ""), written.replace("z-score:", "z-score: nan"), written.replace("Background model: ", "Background model:\t>x\ty "),
           written.replace("screen 1.0", "x > Columns: 8"), written.replace("screen", "\x01"), written.replace("\n", "\r\n"), written.replace("chr1 5 30 +", "hg.chr1/5-35"), written.replace("ACGU\n", "AC\n"),
           written.replace(">chr1", ">a (1.5, z-score = 2.0, S) b"), written.replace("R)", "Q)"), written[:300], written[40:], "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, text string")
    searched = reports._report([reports._searched(F.col("text"), label, kind) for _, label, _, kind in reports.FIELDS], F.col("text"))
    both = materialised(materialised(rows, "a", reports.parse_report(F.col("text"))), "b", searched).where("text IS NOT NULL")
    assert both.where(~F.to_json("a").eqNullSafe(F.to_json("b"))).select("i").collect() == []
    first = both.where("i = 0").first().a
    assert (first.n, first.z, first.rows[0].end, first.rows[1].start, first.rows[0].fold) == (3, -1.25, 35, None, "(..)")
