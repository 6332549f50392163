"""The training-data operators bound to the test tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents"))


#: The rules that the test query asks for.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    judged = filter_urls(_read(spark, sf_dir, "pages"), HOST_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance_resample

    return importance_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(_read(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json", end_id=0, capacity=1024)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(_read(spark, sf_dir, "pages"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(_read(spark, sf_dir, "documents"), weights=[5.0, 2.0, 1.0], budget=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup, without_lines

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    left = without_lines(docs, line_dedup(docs, min_words=1))
    return left.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files_round_trip

    return token_files_round_trip(_read(spark, sf_dir, "documents"), vocabulary="word_bpe_49k.json", end_id=2)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle

    return fill_in_middle(_read(spark, sf_dir, "documents"), seed=1).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(_read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def queries() -> dict:
    return {
        "op10_token_files": op10_token_files,
        "op2_filter_urls": op2_filter_urls,
        "op3_quality_rules": op3_quality_rules,
        "op4_importance_resample": op4_importance_resample,
        "op5_pack_documents": op5_pack_documents,
        "op6_extract_text": op6_extract_text,
        "op7_mix_sources": op7_mix_sources,
        "op8_dedup_lines": op8_dedup_lines,
        "op9_jaccard_join": op9_jaccard_join,
        "op1_exact_dedup": op1_exact_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_fill_middle": op12_fill_middle,
        "op13_katz_scores": op13_katz_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, text_sha256
            FROM d WINDOW g AS (PARTITION BY text_sha256)
        """,
        "op2_filter_urls": r"""
            WITH p AS (
                SELECT page_id, url, coalesce(strpos(url, '://') > 0, false) AS placed,
                       CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
                       coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS low
                FROM pages
            ), h AS (
                SELECT page_id, placed, low,
                       coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                       coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
                FROM p
            ), r AS (
                SELECT *, CASE
                    WHEN placed AND (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                    WHEN placed AND (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                    WHEN placed AND (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                    WHEN placed AND (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
                FROM h
            )
            SELECT page_id, host, path, rule, CASE
                WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
                WHEN rule IS NOT NULL THEN 'block'
                WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?(edu|gov)([^a-z0-9]|$)') OR regexp_matches(low, '(^|[^a-z0-9])(sex[^a-z0-9]education|health)([^a-z0-9]|$)') THEN 'allow'
                WHEN regexp_matches(low, '(^|[^a-z0-9])(adult|porn|xxx|sex|escort|casino|poker|bets|betting|pills|viagra|pharma[^a-z0-9]cheap|spam|phishing|malware|warez|torrent|ads|adserver|doubleclick|popunder|click[^a-z0-9]farm|free[^a-z0-9]money|payday[^a-z0-9]loan)([^a-z0-9]|$)') THEN 'block'
                ELSE 'allow' END AS verdict
            FROM r
        """,
        "op7_mix_sources": r"""
            WITH d AS (
                SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                       length(translate(text, '#*$%&|<>{}[]~^=_\', ''))::DOUBLE / greatest(length(text), 1) AS share,
                       (('0x' || substr(md5(concat('17:', coalesce(doc_id::VARCHAR, 'null'))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
                FROM documents
            ), k AS (
                SELECT doc_id, source, size, -ln(u) / coalesce(greatest(share * share * share * share, 0.05), 1.0) AS key FROM d
            ), s AS (
                SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
            ), r AS (
                SELECT source, source_size,
                       [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w FROM s
            ), f AS (
                SELECT *, source_size * 2.0::DOUBLE AS cap,
                       sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE - coalesce(sum(source_size) OVER (
                           ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT, 0) * 2.0::DOUBLE AS left_,
                       sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
                FROM r
            ), g AS (SELECT *, cap * w_left <= left_ * w AS is_full FROM f
            ), l AS (SELECT left_ AS l, w_left AS wl FROM g WHERE NOT is_full ORDER BY cap / w, left_, w_left LIMIT 1
            ), t AS (
                SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * l / wl END AS target FROM g LEFT JOIN l ON true
            ), e AS (
                SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
            ), o AS (
                SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
                       sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
                FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
            )
            SELECT doc_id, size, source_size, target,
                   (epochs + CASE WHEN upto * 2 - size <= rest * 2 THEN 1 ELSE 0 END) * size AS taken
            FROM o
        """,
        "op11_filter_audit": r"""
            WITH d AS (
                SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
            ), f AS (
                SELECT part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
                       100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text) AS c,
                       regexp_matches(text, '[#$%&*|]') AS d,
                       coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text) IS NOT NULL) AS e,
                       doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
                       doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
                FROM d
            ), g AS (
                SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS fails,
                       count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM f GROUP BY ALL
            ), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
            ), o AS (
                SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM l p, l q, l r, l s, l t
                WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
            ), k AS (
                SELECT filter_order, step::INTEGER AS step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier
                FROM o, range(1, 6) AS i(step)
            ), w AS (
                SELECT part, filter_order, step, filter,
                       sum(if(translate(fails, earlier || filter, '') = fails, n, 0))::BIGINT AS kept,
                       sum(if(translate(fails, earlier, '') = fails AND contains(fails, filter), n, 0))::BIGINT AS removed,
                       sum(if(translate(fails, earlier, '') <> fails AND contains(fails, filter), n, 0))::BIGINT AS redundant,
                       sum(if(fails = filter, n, 0))::BIGINT AS unique_fails,
                       sum(if(translate(fails, earlier, '') = fails AND contains(fails, filter), n_good, 0))::BIGINT AS good_lost,
                       sum(if(translate(fails, earlier, '') = fails AND contains(fails, filter), n_toxic, 0))::BIGINT AS toxic_lost
                FROM k, g GROUP BY ALL
            )
            SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
                   sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
            FROM w
        """,
        "op12_fill_middle": """
            WITH d AS (
                SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
            ), c AS (
                SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
                       CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                                 OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                            WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
            ), p AS (
                SELECT *, least(x, y) AS a, substr(text, 1, least(x, y)) AS pre, substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid,
                       substr(text, greatest(x, y) + 1) AS suf FROM c
            )
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
                   CASE WHEN form <> 'plain' THEN greatest(x, y) - a END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                          ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
                   sha256(text) AS restored_sha256
            FROM p
        """,
        "op13_katz_scores": r"""
            WITH d AS (
                SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
                       coalesce(xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
                           list_reduce([1::BIGINT, 2, 3, 4, 5, 6, 7, 8], lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(c, b)), 4294967295::BIGINT)) % 7 = 2, false) AS held_out
                FROM documents
            ), t AS (SELECT doc_id, held_out, list_concat(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ['END ']) AS ws FROM d
            ), k AS (SELECT doc_id, held_out, unnest(ws) AS w, unnest(list_concat(['START '], ws[:len(ws) - 1])) AS u FROM t
            ), one AS (SELECT w, count(*) AS n FROM k WHERE NOT held_out GROUP BY w
            ), two AS (SELECT u, w, count(*) AS n FROM k WHERE NOT held_out GROUP BY u, w
            ), f AS (SELECT coalesce(sum(n), 0)::BIGINT AS tokens, count(*) AS types FROM one
            ), r1 AS (SELECT n AS r, count(*) AS m FROM one GROUP BY n
            ), r2 AS (SELECT n AS r, count(*) AS m FROM two GROUP BY n
            ), s1 AS (SELECT least(CASE WHEN count(*) > 1 THEN regr_slope(ln(m), ln(r)) ELSE -2 END, -1.05) AS slope FROM r1 WHERE r <= 6
            ), s2 AS (SELECT least(CASE WHEN count(*) > 1 THEN regr_slope(ln(m), ln(r)) ELSE -2 END, -1.05) AS slope FROM r2 WHERE r <= 6
            ), d1 AS (
                SELECT a.r, a.m, CASE WHEN a.r <= 5 AND b.m > 0 AND (a.r + 1) * b.m < a.r * a.m THEN (a.r + 1) * b.m / (a.r * a.m)::DOUBLE
                                      ELSE pow(1 + 1 / a.r::DOUBLE, slope + 1) END AS d FROM r1 a LEFT JOIN r1 b ON b.r = a.r + 1, s1
            ), d2 AS (
                SELECT a.r, CASE WHEN a.r <= 5 AND b.m > 0 AND (a.r + 1) * b.m < a.r * a.m THEN (a.r + 1) * b.m / (a.r * a.m)::DOUBLE
                                 ELSE pow(1 + 1 / a.r::DOUBLE, slope + 1) END AS d FROM r2 a LEFT JOIN r2 b ON b.r = a.r + 1, s2
            ), un AS (SELECT coalesce(sum((1 - d) * r * m) / max(tokens), 1) AS unknown FROM d1, f
            ), p1 AS (SELECT w, n, d * n / tokens AS p FROM one JOIN d1 ON n = r, f
            ), p2 AS (SELECT u, w, n, d FROM two JOIN d2 ON n = r
            ), c AS (
                SELECT u, log10(sum((1 - d) * p2.n) / sum(p2.n) / (1 - sum(p))) + log10(sum(p2.n)) AS weight FROM p2 JOIN p1 USING (w) GROUP BY u
            )
            SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(p1.n) AS n_known, any_value(tokens) AS train_tokens,
                   sum(round(log10((coalesce(p1.n, 0) + 1) / (tokens + types + 1)::DOUBLE) * 1e10)::BIGINT)::BIGINT / 1e10 AS base_score,
                   sum(coalesce(-round(log10(p1.n::DOUBLE) * 1e8)::BIGINT, 0) + CASE WHEN p2.n > 0 THEN round(log10(p2.d * p2.n) * 1e8)::BIGINT
                       ELSE round(log10(coalesce(p, unknown)) * 1e8)::BIGINT + coalesce(round(weight * 1e8)::BIGINT, 0) END)::BIGINT / 1e8 AS score
            FROM k LEFT JOIN p1 USING (w) LEFT JOIN p2 ON p2.u = k.u AND p2.w = k.w LEFT JOIN c ON c.u = k.u, f, un
            GROUP BY doc_id
        """,
    }
