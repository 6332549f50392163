"""Queries on alignment blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import blocks as ops
from ..sources.alignments import maf_text
from .fixtures import BLOCKS_SQL, CELLS_SQL, blocks


def _rows(spark, sf_dir):
    """Blocks as one row per sequence."""
    return blocks(spark, sf_dir).select("block_id", "n_cols", F.explode("rows").alias("r")).select("block_id", "n_cols", "r.*")


def mean_pairwise_identity(spark, sf_dir):
    return ops.mean_pairwise_identity(blocks(spark, sf_dir))


def column_entropy(spark, sf_dir):
    return ops.column_entropy(blocks(spark, sf_dir))


def consensus_sequence(spark, sf_dir):
    return ops.consensus(blocks(spark, sf_dir))


def conservation_score(spark, sf_dir):
    return ops.conservation(blocks(spark, sf_dir))


def pairwise_identity_matrix(spark, sf_dir):
    return ops.pairwise_identity_matrix(blocks(spark, sf_dir))


def gc_content(spark, sf_dir):
    """Mean over rows of the share of G and C."""
    share = F.round(sq.gc_share(F.col("seq")) * 1e9).cast("long")
    return _rows(spark, sf_dir).groupBy("block_id").agg(sq.rounded(F.sum(share) / F.count("*") / 1e9, 6).alias("gc"))


def dinucleotide_freq(spark, sf_dir):
    """Counts of pairs of neighbours in each ungapped row, and their share."""
    rows = ops.materialised(_rows(spark, sf_dir).select("block_id", "idx", "seq"), "s", sq.as_rna(sq.ungapped(F.col("seq"))))
    rows = ops.materialised(rows, "n", F.length("s"))
    pairs = rows.select("block_id", "idx", "n", F.explode(sq.dinucleotide_pairs(F.col("s"))).alias("pair"))
    return pairs.groupBy("block_id", "idx", "n", "pair").agg(F.count("*").alias("pairs")).withColumn(
        "share", sq.rounded(F.col("pairs") / (F.col("n") - 1), 3))


def mononucleotide_freq(spark, sf_dir):
    seq = sq.as_rna(sq.ungapped(F.col("seq")))
    return _rows(spark, sf_dir).select(
        "block_id", "idx", F.length(seq).cast("long").alias("n"), *[sq.count_of(seq, x).cast("long").alias(f"n_{x.lower()}") for x in "ACGU"])


def reverse_complement(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        "block_id", "idx", sq.reverse_complement_rna(sq.as_rna(F.col("seq"))).alias("rna"),
        sq.reverse_complement_dna(F.col("seq")).alias("dna"), sq.flip_strand(F.col("strand")).alias("strand"))


def both_strands(spark, sf_dir):
    """Every row forward and reversed."""
    turned = _rows(spark, sf_dir).withColumn("reading", F.explode(F.array(F.lit("+"), F.lit("-"))))
    return turned.select("block_id", "idx", "reading", F.when(F.col("reading") == "+", sq.as_rna(F.col("seq"))).otherwise(
        sq.reverse_complement_rna(sq.as_rna(F.col("seq")))).alias("seq"))


def strip_gaps(spark, sf_dir):
    return _rows(spark, sf_dir).select("block_id", "idx", sq.as_dna(sq.ungapped(F.col("seq"))).alias("dna"), sq.as_rna(sq.ungapped(F.col("seq"))).alias("rna"))


def gap_filter(spark, sf_dir):
    """Rows that pass the gap filter against the reference row (index 0), with both gap shares."""
    ref = F.get("rows", F.lit(0))["seq"]
    rows = blocks(spark, sf_dir).withColumn("ref", ref).select("block_id", "n_cols", "ref", F.explode("rows").alias("r"))
    return rows.select(
        "block_id", F.col("r.idx").alias("idx"), sq.rounded(sq.gap_share_against(F.col("ref"), F.col("r.seq")), 6).alias("gap_share"),
        sq.rounded(sq.gap_share(F.col("r.seq"), F.col("n_cols")), 6).alias("own_gap_share")).where("gap_share <= 0.25")


def mask_filter(spark, sf_dir):
    return _rows(spark, sf_dir).select("block_id", "idx", sq.rounded(sq.masked_share(F.col("seq"), F.col("n_cols")), 6).alias("masked_share")).withColumn(
        "kept", F.col("masked_share") <= 0.1)


def range_check(spark, sf_dir):
    return _rows(spark, sf_dir).select("block_id", "idx", sq.range_code(F.col("seq")).alias("code"))


def remove_common_gaps(spark, sf_dir):
    out = ops.remove_common_gaps(blocks(spark, sf_dir))
    return out.select("block_id", F.col("n_cols").cast("long").alias("n_cols"), F.explode("rows").alias("r")).select("block_id", "n_cols", "r.idx", "r.seq")


def sliding_windows(spark, sf_dir):
    out = ops.slide_windows(blocks(spark, sf_dir), size=120, step=40)
    return out.select("block_id", F.col("slice_start").cast("long").alias("slice_start"), F.col("slice_end").cast("long").alias("slice_end"),
                      F.explode("rows").alias("r")).select("block_id", "slice_start", "slice_end", "r.idx", "r.start", "r.seq")


def window_screen(spark, sf_dir):
    """Windows after row filters and rejections: what goes on to scoring."""
    out = ops.reject_blocks(ops.filter_rows(ops.slide_windows(blocks(spark, sf_dir)), max_gap=0.35, max_masked=1.0, range_check=False))
    return out.select("block_id", F.col("slice_start").cast("long").alias("slice_start"), F.size("rows").cast("long").alias("n_rows"))


def whole_block_windows(spark, sf_dir):
    """The whole block as one window, rows neither filtered by gaps nor by range."""
    out = ops.slide_windows(blocks(spark, sf_dir), max_length=1 << 30)
    return out.select("block_id", F.col("slice_start").cast("long").alias("slice_start"), F.col("slice_end").cast("long").alias("slice_end"), F.size("rows").cast("long").alias("n_rows"))


def column_positions(spark, sf_dir):
    """Genomic position of the middle column of every row, gaps decided either way."""
    mid = F.floor(F.col("n_cols") / 2).cast("int")
    return _rows(spark, sf_dir).select(
        "block_id", "idx", sq.column_to_position(F.col("seq"), F.col("start"), mid).alias("after"),
        sq.column_to_position(F.col("seq"), F.col("start"), mid, after=False).alias("before"))


def position_columns(spark, sf_dir):
    """Column of the tenth base of every row."""
    return _rows(spark, sf_dir).select(
        "block_id", "idx", sq.position_to_column(F.col("seq"), F.col("start"), F.col("start") + 9).cast("long").alias("col"))


def covariance_score(spark, sf_dir):
    """Covariance of column i with its mirror image, the pairs of one long hairpin."""
    b = blocks(spark, sf_dir)
    span = F.floor((F.col("n_cols") - 4) / 2).cast("int")
    pairs = b.where(span > 0).select("block_id", "n_cols", F.explode(F.sequence(F.lit(0), span - 1)).alias("i")).select(
        "block_id", "i", (F.col("n_cols") - 1 - F.col("i")).alias("j"))
    return ops.covariance_of_pairs(b, pairs).select(
        "block_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("none").cast("long").alias("none"),
        F.col("changes").cast("long").alias("changes"), "score")


def block_stats(spark, sf_dir):
    return ops.block_statistics(blocks(spark, sf_dir)).select(
        "metric", F.col("value").cast("long").alias("value"), "blocks", "single_column")


def block_report(spark, sf_dir):
    """Totals and histograms of blocks by length, identity and organisms."""
    return ops.block_report(blocks(spark, sf_dir))


def named_rows(spark, sf_dir):
    """Coordinates of the rows whose name a pattern finds."""
    return ops.rows_named(blocks(spark, sf_dir), r"^(user|system)\.\d*[02468]$").select(
        "block_id", F.explode("rows").alias("r")).select("block_id", "r.idx", "r.name", "r.start", (F.col("r.start") + F.length(sq.ungapped(F.col("r.seq")))).alias("end"))


def organism_sets(spark, sf_dir):
    """How many blocks hold each set of row names' first parts."""
    names = F.transform("rows", lambda r: F.regexp_extract(r["name"], r"^(\w+)\.", 1))
    label = F.array_join(F.sort_array(F.array_distinct(names)), "_")
    return blocks(spark, sf_dir).groupBy(label.alias("organisms")).agg(F.count("*").alias("blocks"))


def fasta_wrap(spark, sf_dir):
    return _rows(spark, sf_dir).select("block_id", "idx", F.concat(F.lit(">"), "name", F.lit("\n"), sq.wrap(F.col("seq"))).alias("fasta"))


def maf_lines(spark, sf_dir):
    """The ``s`` lines of blocks written as MAF; minus rows count from their own strand's start."""
    size = lambda r: F.length(sq.ungapped(r["seq"]))
    row = lambda r: F.struct(
        r["name"].alias("name"), r["start"].alias("start"), (r["start"] + size(r)).alias("end"), size(r).alias("length"),
        (r["start"] + size(r) + 100).alias("full_length"), r["strand"].alias("strand"), r["seq"].alias("seq"))
    text = blocks(spark, sf_dir).select("block_id", "rows", maf_text(F.transform("rows", row)).alias("text"))
    lines = text.select("block_id", "rows", F.posexplode(F.filter(F.split("text", "\n"), lambda l: l.startswith("s "))).alias("at", "line"))
    return lines.select("block_id", F.get("rows", F.col("at"))["idx"].alias("idx"), "line")


def gtf_rows(spark, sf_dir):
    """Rows as GTF records with the block and the number of gaps as attributes."""
    gaps = sq.count_of(F.col("seq"), "-")
    size = F.length(sq.ungapped(F.col("seq")))
    return _rows(spark, sf_dir).select("block_id", "idx", F.concat_ws(
        "\t", F.concat(F.lit("chr"), F.col("block_id").cast("string")), F.lit("alignment"), F.lit("row"), (F.col("start") + 1).cast("string"),
        (F.col("start") + size).cast("string"), F.lit("."), "strand", F.lit("."),
        F.concat(F.lit('block "'), F.col("block_id").cast("string"), F.lit('"; gaps "'), gaps.cast("string"), F.lit('";'))).alias("record"))


QUERIES = {f.__name__: f for f in (
    mean_pairwise_identity, column_entropy, consensus_sequence, conservation_score, pairwise_identity_matrix, gc_content, dinucleotide_freq,
    mononucleotide_freq, reverse_complement, both_strands, strip_gaps, gap_filter, mask_filter, range_check, remove_common_gaps, sliding_windows,
    window_screen, whole_block_windows, column_positions, position_columns, covariance_score, block_stats, block_report, named_rows, organism_sets, fasta_wrap, maf_lines, gtf_rows)}

_RNA = "translate(upper(seq), 'T', 'U')"
_COUNTS = CELLS_SQL + """, counts AS (
        SELECT block_id, col, count(*) AS n, count(*) FILTER (c = 'A') AS a, count(*) FILTER (c = 'C') AS c, count(*) FILTER (c = 'G') AS g,
               count(*) FILTER (c = 'U') AS u, count(*) FILTER (c = '-') AS gap FROM cells GROUP BY block_id, col
    )"""


def _term(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN -({n} / n::DOUBLE) * ln({n} / n::DOUBLE) / ln(2.0::DOUBLE) ELSE 0.0 END"


_WINDOWS = BLOCKS_SQL + """, spans AS (
        SELECT *, unnest(CASE WHEN n_cols <= 120 THEN [0] ELSE list_distinct(list_transform(range(0, ceil((n_cols - 120) / 40.0)::INTEGER + 1), lambda k: least(k * 40, n_cols - 120))) END) AS slice_start
        FROM block_rows WHERE n_cols > 0
    ), windows AS (
        SELECT block_id, idx, slice_start::BIGINT AS slice_start, CASE WHEN n_cols <= 120 THEN n_cols ELSE slice_start + 120 END::BIGINT AS slice_end,
               start + length(replace(substr(seq, 1, slice_start::BIGINT), '-', '')) AS start,
               substr(seq, slice_start::BIGINT + 1, least(n_cols, 120)) AS seq
        FROM spans
    )"""

SQL = {
    "mean_pairwise_identity": f"""WITH {_COUNTS}
        SELECT block_id, sum((a * (a - 1) + c * (c - 1) + g * (g - 1) + u * (u - 1)) / 2)::BIGINT AS matches,
               sum((n * (n - 1) - gap * (gap - 1)) / 2)::BIGINT AS pairs,
               CASE WHEN sum((n * (n - 1) - gap * (gap - 1)) / 2) = 0 THEN 0 ELSE
                 round(100 * sum((a * (a - 1) + c * (c - 1) + g * (g - 1) + u * (u - 1)) / 2)::BIGINT / sum((n * (n - 1) - gap * (gap - 1)) / 2)::BIGINT, 4) END AS identity
        FROM counts GROUP BY block_id""",
    "column_entropy": f"""WITH {_COUNTS}
        SELECT block_id, round(sum(round(({_term('a')} + {_term('c')} + {_term('g')} + {_term('u')} + {_term('(n - a - c - g - u)')}) * 1e9)::BIGINT) / count(*) / 1e9, 5) AS entropy
        FROM counts GROUP BY block_id""",
    "consensus_sequence": f"""WITH {_COUNTS}
        SELECT block_id, string_agg(CASE greatest(a, c, g, u, gap) WHEN gap THEN '_' WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' WHEN u THEN 'U' END, '' ORDER BY col) AS consensus
        FROM counts GROUP BY block_id""",
    "conservation_score": f"""WITH {_COUNTS}
        SELECT block_id, col::INTEGER AS col, CASE greatest(a, c, g, u, gap) WHEN gap THEN '-' WHEN u THEN 'U' WHEN g THEN 'G' WHEN c THEN 'C' ELSE 'A' END AS symbol,
               round(CASE WHEN greatest(a, c, g, u, gap) = gap OR n = 1 THEN 0.0 ELSE (greatest(a, c, g, u, gap) - 1) / (n - 1)::DOUBLE END, 6) AS conservation
        FROM counts""",
    "pairwise_identity_matrix": f"""WITH {CELLS_SQL}, m AS (
        SELECT x.block_id, x.idx AS i, y.idx AS j, count(*) FILTER (x.c = y.c AND x.c <> '-') AS matches, count(*) FILTER (x.c <> '-' OR y.c <> '-') AS pairs
        FROM cells x JOIN cells y ON x.block_id = y.block_id AND x.col = y.col AND x.idx < y.idx GROUP BY ALL)
        SELECT *, CASE WHEN pairs = 0 THEN 0.0 ELSE round(matches / pairs, 4) END AS identity FROM m""",
    "gc_content": f"""WITH {BLOCKS_SQL}, r AS (
        SELECT block_id, upper(replace(seq, '-', '')) AS s FROM block_rows)
        SELECT block_id, round(sum(round(CASE WHEN length(s) = 0 THEN 0.0 ELSE (length(s) - length(translate(s, 'GC', ''))) / length(s)::DOUBLE END * 1e9)::BIGINT) / count(*) / 1e9, 6) AS gc
        FROM r GROUP BY block_id""",
    "dinucleotide_freq": f"""WITH {BLOCKS_SQL}, r AS (
        SELECT block_id, idx, upper(replace(seq, '-', '')) AS s FROM block_rows), p AS (
        SELECT block_id, idx, length(s) AS n, unnest(list_transform(range(1, length(s)), lambda k: substr(s, k, 2))) AS pair FROM r)
        SELECT block_id, idx, n::INTEGER AS n, pair, count(*) AS pairs, round(count(*) / (n - 1)::DOUBLE, 3) AS share FROM p GROUP BY block_id, idx, n, pair""",
    "mononucleotide_freq": f"""WITH {BLOCKS_SQL}, r AS (
        SELECT block_id, idx, upper(replace(seq, '-', '')) AS s FROM block_rows)
        SELECT block_id, idx, length(s) AS n, length(s) - length(replace(s, 'A', '')) AS n_a, length(s) - length(replace(s, 'C', '')) AS n_c,
               length(s) - length(replace(s, 'G', '')) AS n_g, length(s) - length(replace(s, 'U', '')) AS n_u FROM r""",
    "reverse_complement": f"""WITH {BLOCKS_SQL}
        SELECT block_id, idx, reverse(translate({_RNA}, 'ACGTU', 'UGCAA')) AS rna, reverse(translate(seq, 'AGCTUagctu', 'TCGAAtcgaa')) AS dna,
               CASE strand WHEN '+' THEN '-' ELSE '+' END AS strand FROM block_rows""",
    "both_strands": f"""WITH {BLOCKS_SQL}
        SELECT block_id, idx, '+' AS reading, {_RNA} AS seq FROM block_rows UNION ALL
        SELECT block_id, idx, '-' AS reading, reverse(translate({_RNA}, 'ACGTU', 'UGCAA')) AS seq FROM block_rows""",
    "strip_gaps": f"""WITH {BLOCKS_SQL}
        SELECT block_id, idx, translate(upper(replace(seq, '-', '')), 'U', 'T') AS dna, upper(replace(seq, '-', '')) AS rna FROM block_rows""",
    "gap_filter": f"""WITH {CELLS_SQL}, g AS (
        SELECT y.block_id, y.idx, count(*) FILTER ((x.c = '-') <> (y.c = '-')) AS one, count(*) FILTER (x.c <> '-' OR y.c <> '-') AS any_, count(*) FILTER (y.c = '-') AS own, count(*) AS n
        FROM cells y JOIN cells x ON x.block_id = y.block_id AND x.col = y.col AND x.idx = 0 GROUP BY ALL)
        SELECT block_id, idx, round(CASE WHEN any_ = 0 THEN 0.0 ELSE one / any_::DOUBLE END, 6) AS gap_share, round(own / n::DOUBLE, 6) AS own_gap_share FROM g
        WHERE round(CASE WHEN any_ = 0 THEN 0.0 ELSE one / any_::DOUBLE END, 6) <= 0.25""",
    "mask_filter": f"""WITH {BLOCKS_SQL}, m AS (
        SELECT block_id, idx, round(length(regexp_replace(seq, '[^a-z]', '', 'g')) / n_cols::DOUBLE, 6) AS masked_share FROM block_rows)
        SELECT *, masked_share <= 0.1 AS kept FROM m""",
    "range_check": f"""WITH {BLOCKS_SQL}, r AS (
        SELECT block_id, idx, upper(replace(seq, '-', '')) AS s FROM block_rows), k AS (
        SELECT block_id, idx, length(s) AS n, length(s) - length(replace(s, 'A', '')) AS a, length(s) - length(replace(s, 'C', '')) AS c,
               length(s) - length(replace(s, 'G', '')) AS g, length(s) - length(replace(s, 'U', '')) AS u FROM r), f AS (
        SELECT block_id, idx, n, coalesce((g + c) / nullif(a + c + g + u, 0), 0) AS gc, coalesce(a / nullif(a + u, 0), 0) AS ar, coalesce(c / nullif(c + g, 0), 0) AS cr FROM k)
        SELECT block_id, idx, (CASE WHEN n = 0 THEN 1 ELSE (n < 50 OR n > 400)::INTEGER
               + 2 * (gc < 0.25 OR gc > 0.75 OR ar < 0.25 OR ar > 0.75 OR cr < 0.25 OR cr > 0.75)::INTEGER END)::INTEGER AS code FROM f""",
    "remove_common_gaps": f"""WITH {CELLS_SQL}, k AS (
        SELECT *, max(CASE WHEN c <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY block_id, col) AS used,
               substr(b.seq, cells.col::BIGINT + 1, 1) AS raw_c FROM cells JOIN block_rows b USING (block_id, idx))
        SELECT block_id, count(*) AS n_cols, idx, string_agg(raw_c, '' ORDER BY col) AS seq FROM k WHERE used = 1 GROUP BY block_id, idx""",
    "sliding_windows": f"WITH {_WINDOWS} SELECT * FROM windows",
    "window_screen": f"""WITH {_WINDOWS}, w AS (
        SELECT block_id, idx, slice_start, slice_end, unnest(range(length(seq))) AS col, unnest(string_split(seq, '')) AS c FROM windows), g AS (
        SELECT y.block_id, y.slice_start, y.idx, count(*) FILTER ((x.c = '-') <> (y.c = '-')) AS one, count(*) FILTER (x.c <> '-' OR y.c <> '-') AS any_, count(*) FILTER (y.c = '-') AS own, count(*) AS n
        FROM w y JOIN w x ON x.block_id = y.block_id AND x.slice_start = y.slice_start AND x.col = y.col AND x.idx = 0 GROUP BY ALL), k AS (
        SELECT * FROM g WHERE CASE WHEN idx = 0 THEN own / n::DOUBLE WHEN any_ = 0 THEN 0.0 ELSE one / any_::DOUBLE END <= 0.35)
        SELECT block_id, slice_start, count(*) AS n_rows FROM k GROUP BY block_id, slice_start HAVING count(*) >= 2 AND min(idx) = 0""",
    "whole_block_windows": f"""WITH {BLOCKS_SQL}
        SELECT block_id, 0::BIGINT AS slice_start, n_cols::BIGINT AS slice_end, count(*) AS n_rows FROM block_rows WHERE n_cols > 0 GROUP BY block_id, n_cols""",
    "column_positions": f"""WITH {BLOCKS_SQL}, m AS (SELECT *, n_cols // 2 AS col, length(seq) - length(ltrim(seq, '-')) AS lead_ FROM block_rows)
        SELECT block_id, idx,
               CASE WHEN replace(seq, '-', '') = '' OR col < lead_ THEN start ELSE start + length(replace(substr(seq, 1, col + 1), '-', '')) - 1 + (substr(seq, col + 1, 1) = '-')::INTEGER END AS after,
               CASE WHEN replace(seq, '-', '') = '' OR col < lead_ THEN start ELSE start + length(replace(substr(seq, 1, col + 1), '-', '')) - 1 END AS before
        FROM m""",
    "position_columns": f"""WITH {CELLS_SQL}, n AS (
        SELECT block_id, idx, col, row_number() OVER (PARTITION BY block_id, idx ORDER BY col) AS k FROM cells WHERE c <> '-')
        SELECT b.block_id, b.idx, n.col FROM block_rows b LEFT JOIN n ON n.block_id = b.block_id AND n.idx = b.idx AND n.k = 10""",
    "covariance_score": f"""WITH {CELLS_SQL}, p AS (
        SELECT x.block_id, x.col AS i, y.col AS j, x.c || y.c AS both_ FROM cells x JOIN block_rows b ON b.block_id = x.block_id AND b.idx = x.idx
        JOIN cells y ON y.block_id = x.block_id AND y.idx = x.idx AND y.col = b.n_cols - 1 - x.col
        WHERE x.col < (b.n_cols - 4) // 2), k AS (
        SELECT block_id, i, j, count(*) AS n, count(*) FILTER (both_ = '--') AS gaps, count(*) FILTER (both_ = 'CG') AS cg, count(*) FILTER (both_ = 'GC') AS gc,
               count(*) FILTER (both_ = 'GU') AS gu, count(*) FILTER (both_ = 'UG') AS ug, count(*) FILTER (both_ = 'AU') AS au, count(*) FILTER (both_ = 'UA') AS ua FROM p GROUP BY ALL), s AS (
        SELECT block_id, i, j, n, gaps, n - gaps - cg - gc - gu - ug - au - ua AS none,
               2 * cg * gc + 2 * cg * gu + cg * ug + 2 * cg * au + 2 * cg * ua + gc * gu + 2 * gc * ug + 2 * gc * au + 2 * gc * ua
               + 2 * gu * ug + gu * au + 2 * gu * ua + 2 * ug * au + ug * ua + 2 * au * ua AS changes FROM k)
        SELECT block_id, i, j, none, changes, CASE WHEN none * 2 <= n THEN (100 * changes) // n - 100 * none - 25 * gaps ELSE -10000 END AS score FROM s""",
    "block_stats": f"""WITH {BLOCKS_SQL}, f AS (SELECT block_id, count(*) AS n_rows, any_value(n_cols) AS n_cols FROM block_rows GROUP BY block_id)
        SELECT CASE WHEN grouping(n_rows) = 0 THEN 'n_rows' WHEN grouping(n_cols) = 0 THEN 'n_cols' ELSE 'total' END AS metric,
               coalesce(n_rows, n_cols, 0)::BIGINT AS value, count(*) AS blocks, sum(CASE WHEN n_cols = 1 THEN 1 ELSE 0 END)::BIGINT AS single_column
        FROM f GROUP BY GROUPING SETS ((n_rows), (n_cols), ())""",
    "organism_sets": f"""WITH {BLOCKS_SQL}, o AS (SELECT block_id, string_agg(DISTINCT regexp_extract(name, '^(\\w+)\\.', 1), '_' ORDER BY regexp_extract(name, '^(\\w+)\\.', 1)) AS organisms FROM block_rows GROUP BY block_id)
        SELECT organisms, count(*) AS blocks FROM o GROUP BY organisms""",
    "fasta_wrap": f"""WITH {BLOCKS_SQL}
        SELECT block_id, idx, '>' || name || chr(10) || regexp_replace(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS fasta FROM block_rows""",
    "maf_lines": f"""WITH {BLOCKS_SQL}
        SELECT block_id, idx, concat_ws(' ', 's', name, if(strand = '-', 100, start), length(replace(seq, '-', '')), strand, start + length(replace(seq, '-', '')) + 100, seq) AS line FROM block_rows""",
    "gtf_rows": f"""WITH {BLOCKS_SQL}
        SELECT block_id, idx, concat_ws(chr(9), 'chr' || block_id, 'alignment', 'row', start + 1, start + length(replace(seq, '-', '')), '.', strand, '.',
               'block "' || block_id || '"; gaps "' || (length(seq) - length(replace(seq, '-', ''))) || '";') AS record FROM block_rows""",
    "block_report": f"""WITH {CELLS_SQL}, per AS (
            SELECT block_id, col, count(*) AS n, c FROM cells GROUP BY block_id, col, c
        ), f AS (
            SELECT block_id, sum(CASE WHEN c <> '-' THEN n * (n - 1) / 2 ELSE 0 END) AS matches, sum(CASE WHEN c = '-' THEN n * (n - 1) / 2 ELSE 0 END) AS gaps FROM per GROUP BY block_id
        ), b AS (
            SELECT block_id, count(*) AS n, any_value(n_cols) AS n_cols, list_sort(list_distinct(list(regexp_extract(name, '^([^.]*)', 1)))) AS orgs FROM block_rows GROUP BY block_id
        ), k AS (
            SELECT b.*, matches, n_cols * (n * (n - 1) / 2) - gaps AS pairs FROM b LEFT JOIN f USING (block_id)
        ), m AS (
            SELECT unnest(CASE WHEN n < 2 THEN [('total', ''), ('reference_only', '')] WHEN n_cols <= 1 THEN [('total', ''), ('single_column', '')] ELSE
                [('total', ''), ('used', ''), ('length', n_cols::VARCHAR), ('identity', printf('%.2f', 100 * round(coalesce(matches / nullif(pairs, 0), 0), 4))),
                 ('organisms', len(orgs)::VARCHAR), ('label', array_to_string(orgs, '_'))] END) AS c FROM k
        )
        SELECT c[1] AS metric, c[2] AS value, count(*) AS blocks FROM m GROUP BY ALL""",
    "named_rows": f"""WITH {BLOCKS_SQL} SELECT block_id, idx, name, start, start + length(replace(seq, '-', '')) AS "end" FROM block_rows
        WHERE regexp_matches(name, '^(user|system)\\.\\d*[02468]$')""",
}
