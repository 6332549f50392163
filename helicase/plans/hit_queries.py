"""Queries on hits, loci and interval tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import hits as ops
from ..operators import intervals as iv
from ..sources import reports
from .fixtures import HITS_SQL, TRACK_SQL, hits, read, track

TIES = ["hit_id", "energy", "stamp"]


def cluster_hits(spark, sf_dir):
    return ops.cluster_hits(hits(spark, sf_dir)).select("hit_id", "seq_id", "start", "end", "locus")


def cluster_hits_compat(spark, sf_dir):
    """Loci closed at the end of the hit before; hits of one start and end count as one."""
    spans = hits(spark, sf_dir).select("seq_id", "start", "end", "p").distinct().groupBy("seq_id", "start", "end").agg(F.max("p").alias("p"))
    return ops.cluster_hits(spans, compat=True).select("seq_id", "start", "end", "locus")


def locus_stats(spark, sf_dir):
    return ops.locus_stats(ops.cluster_hits(hits(spark, sf_dir)))


def filter_hits(spark, sf_dir):
    """Windows that satisfy an expression."""
    kept, _ = ops.filter_hits(ops.cluster_hits(hits(spark, sf_dir)), "P > 0.7 AND (z < -4 OR N >= 6) AND SCI > 0.2 AND seq_id RLIKE '^chr[0-9]+$'")
    return kept.select("hit_id", "locus", "p", "z", "n")


def filter_loci(spark, sf_dir):
    """Loci that keep a window."""
    return ops.filter_hits(ops.cluster_hits(hits(spark, sf_dir)), "P > 0.7 AND (z < -4 OR N >= 6)")[1].select("locus", "seq_id", "start", "end", "windows")


def count_hits(spark, sf_dir):
    return ops.count_hits(ops.filter_hits(ops.cluster_hits(hits(spark, sf_dir)), "P > 0.7 AND (z < -4 OR N >= 6)")[0])


def rna_calls(spark, sf_dir):
    """Windows called RNA, per sequence."""
    return hits(spark, sf_dir).groupBy("seq_id", "strand").agg(
        F.sum(F.when(ops.is_rna(), 1).otherwise(0)).alias("rna"), F.count("*").alias("windows"))


def sort_hits(spark, sf_dir):
    return ops.sort_hits(hits(spark, sf_dir), "z", ties=TIES).select("hit_id", "z", "p")


def sort_loci(spark, sf_dir):
    return ops.sort_loci(ops.cluster_hits(hits(spark, sf_dir)), "p", ties=TIES).select("hit_id", "locus", "locus_best", "p")


def annotate_overlap(spark, sf_dir):
    """Loci with the name of the first track interval that they overlap, or a dash."""
    loci = ops.locus_stats(ops.cluster_hits(hits(spark, sf_dir))).select("locus", "seq_id", "start", "end")
    near = track(spark, sf_dir).select("seq_id", F.pmod("start", F.lit(200_000)).alias("start"), (F.pmod("start", F.lit(200_000)) + F.col("end") - F.col("start")).alias("end"), "name")
    return iv.annotate(loci, near, key=["locus"])


def interval_join(spark, sf_dir):
    """Loci and track intervals that share a position."""
    loci = ops.locus_stats(ops.cluster_hits(hits(spark, sf_dir))).select("locus", "seq_id", "start", "end")
    near = track(spark, sf_dir).select("event_id", "seq_id", F.pmod("start", F.lit(200_000)).alias("start"), (F.pmod("start", F.lit(200_000)) + F.col("end") - F.col("start")).alias("end"))
    return iv.overlap_join(loci, near).select("locus", F.col("o_event_id").alias("event_id"), F.col("o_start").alias("o_start"), F.col("o_end").alias("o_end"))


def bed_sort(spark, sf_dir):
    return track(spark, sf_dir).orderBy("seq_id", "start", "event_id")


def bed_stats(spark, sf_dir):
    return iv.interval_stats(track(spark, sf_dir))


def merge_intervals(spark, sf_dir):
    return iv.merge_intervals(track(spark, sf_dir))


def export_bed(spark, sf_dir):
    return hits(spark, sf_dir).select("hit_id", F.concat_ws(
        "\t", iv.contig_key(F.col("seq_id")), F.col("start").cast("string"), F.col("end").cast("string"), "hit_id", sq.track_score(F.col("p")).cast("string")).alias("line"))


def export_gff(spark, sf_dir):
    """GFF counts from one."""
    return hits(spark, sf_dir).select("hit_id", F.concat_ws(
        "\t", "seq_id", F.lit("screen"), F.lit("window"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"),
        sq.track_score(F.col("p")).cast("string"), "strand", F.lit("."), F.concat(F.lit('id "'), "hit_id", F.lit('"'))).alias("line"))


def export_tsv(spark, sf_dir):
    """All 19 columns of a hit line."""
    h = hits(spark, sf_dir)
    whole = h.select("hit_id", "stamp", F.col("hit_id").alias("window_id"), F.concat(F.lit("locus"), F.col("n").cast("string")).alias("locus_id"), "seq_id", "start", "end", "strand", "n", "columns",
                     F.col("identity").cast("long").alias("identity"), F.col("z").cast("long").alias("mean_mfe"), (F.col("z") * 2).cast("long").alias("consensus_mfe"), F.lit(None).cast("double").alias("energy"),
                     F.lit(0).alias("covariance"), F.lit(1).alias("comb_per_pair"), F.col("z").cast("long").alias("z"), "sci", (-F.col("n")).alias("dec_value"), "p", F.lit(0.5).alias("gc"))
    return whole.select("hit_id", "stamp", reports.hit_line().alias("line"))


def bin_histogram(spark, sf_dir):
    facts = hits(spark, sf_dir).select(F.col("columns").alias("length"), "identity", "n")
    return ops.bin_histogram(facts, length_bin=10, identity_bin=5, max_length=45, max_identity=90)


def best_hits(spark, sf_dir):
    """The best window of every sequence."""
    return ops.best_of_each(hits(spark, sf_dir), ["seq_id"], [F.col("p").desc(), F.col("z"), *[F.col(c) for c in TIES]]).select("seq_id", "hit_id", "p", "z")


def renumber_blocks(spark, sf_dir):
    """Orders numbered through files of a customer's nation."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return ops.renumber_blocks(orders.select(F.col("c_nationkey").alias("file_no"), F.col("o_orderkey").alias("block_no")))


def thousands(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", sq.thousands(F.col("o_orderkey") * 12345).alias("nice"))


QUERIES = {f.__name__: f for f in (
    cluster_hits, cluster_hits_compat, locus_stats, filter_hits, filter_loci, count_hits, rna_calls, sort_hits, sort_loci, annotate_overlap, interval_join,
    bed_sort, bed_stats, merge_intervals, export_bed, export_gff, export_tsv, bin_histogram, best_hits, renumber_blocks, thousands)}

_CLUSTERED = HITS_SQL + """, kept AS (SELECT * FROM hits WHERE p >= 0.5), reach AS (
        SELECT *, max("end") OVER (PARTITION BY seq_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM kept), opened AS (
        SELECT *, CASE WHEN before_ IS NULL OR start > before_ THEN start END AS open_ FROM reach), clustered AS (
        SELECT * EXCLUDE (before_, open_), seq_id || ':' || max(open_) OVER (PARTITION BY seq_id ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS locus FROM opened
    )"""
_LOCI = _CLUSTERED + """, loci AS (
        SELECT locus, seq_id, min(start) AS start, max("end") AS "end", count(*) AS windows, max(n) AS max_n, max(identity) AS max_identity, max(p) AS max_p, min(z) AS min_z
        FROM clustered GROUP BY locus, seq_id
    )"""
_NEAR = TRACK_SQL + """, near AS (SELECT event_id, seq_id, start % 200000 AS start, start % 200000 + "end" - start AS "end", name FROM track)"""
_MERGED = TRACK_SQL + """, reach AS (
        SELECT *, max("end") OVER (PARTITION BY seq_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM track), opened AS (
        SELECT *, CASE WHEN before_ IS NULL OR start > before_ THEN start END AS open_ FROM reach), grouped AS (
        SELECT seq_id, "end", max(open_) OVER (PARTITION BY seq_id ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS start FROM opened), merged AS (
        SELECT seq_id, start, max("end") AS "end", count(*) AS members FROM grouped GROUP BY seq_id, start
    )"""

SQL = {
    "cluster_hits": f"""WITH {_CLUSTERED} SELECT hit_id, seq_id, start, "end", locus FROM clustered""",
    "cluster_hits_compat": f"""WITH {HITS_SQL}, spans AS (SELECT seq_id, start, "end", max(p) AS p FROM hits GROUP BY ALL), reach AS (
        SELECT *, lag("end") OVER (PARTITION BY seq_id ORDER BY start, "end") AS before_ FROM spans WHERE p >= 0.5), opened AS (
        SELECT *, CASE WHEN before_ IS NULL OR start > before_ THEN start END AS open_ FROM reach)
        SELECT seq_id, start, "end", seq_id || ':' || max(open_) OVER (PARTITION BY seq_id ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS locus FROM opened""",
    "locus_stats": f"WITH {_LOCI} SELECT * FROM loci",
    "filter_hits": f"""WITH {_CLUSTERED} SELECT hit_id, locus, p, z, n FROM clustered WHERE p > 0.7 AND (z < -4 OR n >= 6) AND sci > 0.2 AND regexp_matches(seq_id, '^chr[0-9]+$')""",
    "filter_loci": f"""WITH {_LOCI} SELECT locus, seq_id, start, "end", windows FROM loci WHERE locus IN (SELECT locus FROM clustered WHERE p > 0.7 AND (z < -4 OR n >= 6))""",
    "count_hits": f"WITH {_CLUSTERED} SELECT count(DISTINCT locus) AS loci, count(*) AS windows FROM clustered WHERE p > 0.7 AND (z < -4 OR n >= 6)",
    "rna_calls": f"WITH {HITS_SQL} SELECT seq_id, strand, sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END)::BIGINT AS rna, count(*) AS windows FROM hits GROUP BY seq_id, strand",
    "sort_hits": f"WITH {HITS_SQL} SELECT hit_id, z, p FROM hits ORDER BY z, hit_id, energy, stamp",
    "sort_loci": f"""WITH {_CLUSTERED} SELECT hit_id, locus, max(p) OVER (PARTITION BY locus) AS locus_best, p FROM clustered ORDER BY locus_best DESC, locus, p DESC, hit_id, energy, stamp""",
    "annotate_overlap": f"""WITH {_LOCI}, {_NEAR}, best AS (
        SELECT l.locus, min((t.start, t."end", t.name)) AS b FROM loci l JOIN near t ON l.seq_id = t.seq_id AND l.start <= t."end" AND l."end" >= t.start GROUP BY l.locus)
        SELECT l.locus, l.seq_id, l.start, l."end", coalesce(b[3], '-') AS annotation FROM loci l LEFT JOIN best USING (locus)""",
    "interval_join": f"""WITH {_LOCI}, {_NEAR}
        SELECT l.locus, t.event_id, t.start AS o_start, t."end" AS o_end FROM loci l JOIN near t ON l.seq_id = t.seq_id AND l.start <= t."end" AND l."end" >= t.start""",
    "bed_sort": f"WITH {TRACK_SQL} SELECT * FROM track ORDER BY seq_id, start, event_id",
    "bed_stats": f"""WITH {_MERGED}
        SELECT count(*) AS items, sum("end" - start)::BIGINT AS total_bases, floor(avg("end" - start) + 0.5)::BIGINT AS mean_length,
               max("end" - start) AS max_length, min("end" - start) AS min_length, (SELECT sum("end" - start)::BIGINT FROM merged) AS covered_bases FROM track""",
    "merge_intervals": f"WITH {_MERGED} SELECT * FROM merged",
    "export_bed": f"""WITH {HITS_SQL} SELECT hit_id, concat_ws(chr(9), seq_id, start, "end", hit_id, floor(p * 1000)::INTEGER) AS line FROM hits""",
    "export_gff": f"""WITH {HITS_SQL} SELECT hit_id, concat_ws(chr(9), seq_id, 'screen', 'window', start + 1, "end", floor(p * 1000)::INTEGER, strand, '.', 'id "' || hit_id || '"') AS line FROM hits""",
    "export_tsv": f"""WITH {HITS_SQL} SELECT hit_id, stamp, concat_ws(chr(9), hit_id, 'locus' || n, seq_id, start, "end", strand, n, columns, identity::BIGINT, z::BIGINT, (z * 2)::BIGINT, '', 0, 1,
               z::BIGINT, sci, -n, p, 0.5) AS line FROM hits""",
    "bin_histogram": f"""WITH {HITS_SQL} SELECT CASE WHEN columns > 45 THEN 46 ELSE floor((columns - 1) / 10.0) * 10 + 1 END::BIGINT AS length_bin,
               CASE WHEN identity > 90 THEN 91 ELSE floor((identity - 1) / 5.0) * 5 + 1 END::BIGINT AS identity_bin, n, count(*) AS blocks FROM hits GROUP BY ALL""",
    "best_hits": f"""WITH {HITS_SQL} SELECT seq_id, hit_id, p, z FROM hits QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY p DESC, z, hit_id, energy, stamp) = 1""",
    "renumber_blocks": """SELECT c_nationkey AS file_no, o_orderkey AS block_no, row_number() OVER (ORDER BY c_nationkey, o_orderkey) AS global_no
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "thousands": "SELECT o_orderkey, format('{:,}', o_orderkey * 12345) AS nice FROM orders",
}
