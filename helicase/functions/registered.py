"""The library's functions under names of their own in SQL text.

    register_functions(spark)
    spark.sql("SELECT w.* FROM blocks b, LATERAL slide_windows(b.rows, b.n_cols, 120, 40) w")

All are SQL functions, so Spark plans through them as through its own.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

ROW = "STRUCT<idx: INT, name: STRING, start: BIGINT, end: BIGINT, strand: STRING, seq: STRING>"
SLICED = f"slice_start INT, slice_end INT, n_cols INT, rows ARRAY<{ROW}>"

#: Name -> parameters, result, expression.
SCALARS = {
    "ungapped": ("s STRING", "STRING", "translate(s, '-.', '')"),
    "as_rna": ("s STRING", "STRING", "translate(upper(s), 'T', 'U')"),
    "reverse_complement": ("s STRING", "STRING", "reverse(translate(s, 'AGCTUagctu', 'TCGAAtcgaa'))"),
    "gc_share": ("s STRING", "DOUBLE", "coalesce((length(s) - length(translate(upper(s), 'GC', ''))) / nullif(length(s) - length(translate(upper(s), 'ACGTU', '')), 0), 0D)"),
    "contig_name": ("s STRING", "STRING", "CASE WHEN contains(s, '.') THEN regexp_extract(s, '^(.*)\\\\.(.*)$', 2) ELSE s END"),
    "svm_probability": ("decision DOUBLE, a DOUBLE, b DOUBLE", "DOUBLE", "greatest(1e-7D, least(1 - 1e-7D, 1 / (1 + exp(a * decision + b))))"),
    "conservation_index": ("consensus DOUBLE, mean DOUBLE", "DOUBLE", "coalesce(consensus / nullif(mean, 0D), 0D)"),
    "z_score": ("energy DOUBLE, mean DOUBLE, sd DOUBLE", "DOUBLE", "CASE WHEN sd < 1e-5 THEN 0D ELSE (energy - mean) / nullif(sd, 0D) END"),
    "position_of_column": ("s STRING, start BIGINT, c INT", "BIGINT", "start + length(translate(substring(s, 1, c), '-.', ''))"),
}


def _cut(first: str, last: str, *, forward: bool) -> str:
    """SQL for every row cut to columns ``first`` to ``last``; ``forward``: starts of minus rows count on the forward strand."""
    before = f"translate(substring(r.seq, 1, {first}), '-.', '')"
    behind = f"translate(substring(r.seq, {last} + 1, length(r.seq)), '-.', '')"
    inside = f"substring(r.seq, {first} + 1, {last} - {first})"
    start = f"r.start + length(CASE WHEN r.strand = '-' THEN {behind} ELSE {before} END)" if forward else f"r.start + length({before})"
    return (f"transform(rows, r -> named_struct('idx', r.idx, 'name', r.name, 'start', {start}, 'end', {start} + length(translate({inside}, '-.', '')), "
            f"'strand', r.strand, 'seq', {inside}))")


#: Name -> parameters, columns of the result, query.
TABLES = {
    "slide_windows": (
        f"rows ARRAY<{ROW}>, width INT, size INT, step INT", SLICED,
        "SELECT at AS slice_start, till AS slice_end, till - at AS n_cols, " + _cut("at", "till", forward=False) + """ AS rows FROM (
            SELECT at, CASE WHEN width <= size THEN width ELSE at + size END AS till FROM (
                SELECT explode(array_distinct(transform(sequence(0, CASE WHEN width <= size THEN 0 ELSE CAST(ceil((width - size) / step) AS INT) END),
                    k -> CASE WHEN width <= size THEN 0 ELSE least(k * step, width - size) END))) AS at)) WHERE width > 0"""),
    "slice_columns": (
        f"rows ARRAY<{ROW}>, width INT, first INT, last INT", SLICED,
        "SELECT at AS slice_start, till AS slice_end, till - at AS n_cols, " + _cut("at", "till", forward=True) + """ AS rows FROM (
            SELECT explode(array(greatest(first, 0))) AS at, least(last, width) AS till) WHERE at < till"""),
    "interval_bins": (
        "first BIGINT, last BIGINT, size BIGINT", "bin BIGINT",
        "SELECT explode(sequence(CAST(floor(first / size) AS BIGINT), CAST(floor(greatest(first, last) / size) AS BIGINT))) AS bin"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make all functions known to this session's SQL; their names."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, columns, query) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {query}")
    return [*SCALARS, *TABLES]
