"""One query per operator over the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import bpe_digests
from .common import read
from .conversation_repair import damaged, repair_conversations
from .exact_dedup import exact_dedup
from .importance_sampling import resample
from .line_dedup import dedup_lines
from .ngram_join import jaccard_components
from .packing import pack_documents
from .personal_data import fit_span_model, personal_data_digests
from .quality import quality_scores
from .secret_scan import fit_secret_model, labelled_findings, scan_secrets
from .suffix_dedup import suffix_dedup
from .warc import archive_round_trip


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return nearest(vectors, vectors.where("id % 50 = 0"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"), fit_secret_model(labelled_findings(spark)))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), width=3, percent=90)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_round_trip(spark, read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digests(read(spark, sf_dir, "documents"), fit_span_model(spark))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(read(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cross_polytope_ann": op1_cross_polytope_ann,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_ranking": op9_quality_ranking,
    "op10_bpe": op10_bpe,
    "op11_personal_data": op11_personal_data,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_repair": op13_conversation_repair,
}

#: CRC-32 of a text's UTF-8 bytes: {text} is replaced, ``entries`` comes from crc_table.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries)"""
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({text})),
    lambda i: ('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, strlen(html) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)),
                 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
    "op12_importance_resampling": f"""
        WITH {CRC_TABLE},
        found AS (
            SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word
            FROM documents
            UNION ALL
            SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'))
            FROM benchmark),
        named AS (SELECT word, CAST({CRC.format(text="word")} AS BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT word FROM found), crc_table),
        counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM found JOIN named USING (word) GROUP BY bucket),
        sums AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts),
        gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, sums),
        weights AS (SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM found JOIN named USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
        scored AS (
            SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM documents LEFT JOIN weights ON id = doc_id),
        ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
        FROM ranked
    """,
    "op13_conversation_repair": f"""
        WITH RECURSIVE {CRC_TABLE},
        drawn AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
        keyed AS (SELECT name, CAST({CRC.format(text="name")} AS BIGINT) % 20 AS d FROM (SELECT DISTINCT name FROM drawn), crc_table),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                   CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM drawn JOIN keyed USING (name)),
        placed AS (
            SELECT *, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time
            FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        marked AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN time > 1 THEN 2
                           WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
                   substr(role, 1, 1) AS c
            FROM placed),
        facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
                   count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM marked GROUP BY conv_id),
        -- from the end: for each state (nothing, s, u, a) the least of cost and letters as one text, and the lines;
        -- e: before inserts, f: after one, then two of them
        walk AS (
            SELECT conv_id, n AS i, {{'k': '10000005I', 'l': ['assistant:']}} AS u, {{'k': '10000000', 'l': []::VARCHAR[]}} AS a,
                   {{'k': '10000000', 'l': []::VARCHAR[]}} AS o, {{'k': '10000010II', 'l': ['user:', 'assistant:']}} AS s
            FROM facts
            UNION ALL
            SELECT conv_id, i - 1, least(eu, {{'k': CAST(CAST(ea.k[:8] AS BIGINT) + 5 AS VARCHAR) || 'I' || ea.k[9:], 'l': list_prepend('assistant:', ea.l)}}),
                   least(ea, {{'k': CAST(CAST(fu.k[:8] AS BIGINT) + 5 AS VARCHAR) || 'I' || fu.k[9:], 'l': list_prepend('user:', fu.l)}}),
                   least(eo, {{'k': CAST(CAST(fu.k[:8] AS BIGINT) + 5 AS VARCHAR) || 'I' || fu.k[9:], 'l': list_prepend('user:', fu.l)}}),
                   least(es, {{'k': CAST(CAST(fu.k[:8] AS BIGINT) + 5 AS VARCHAR) || 'I' || fu.k[9:], 'l': list_prepend('user:', fu.l)}})
            FROM (SELECT *, least(eu, {{'k': CAST(CAST(ea.k[:8] AS BIGINT) + 5 AS VARCHAR) || 'I' || ea.k[9:], 'l': list_prepend('assistant:', ea.l)}}) AS fu
                  FROM (
                    SELECT w.conv_id, w.i,
                           least(du, CASE WHEN ok AND c = 'a' THEN {{'k': CAST(CAST(a.k[:8] AS BIGINT) + more AS VARCHAR) || 'K' || a.k[9:], 'l': list_prepend(line, a.l)}} END,
                                 CASE WHEN ok THEN {{'k': CAST(CAST(a.k[:8] AS BIGINT) + 1 + more AS VARCHAR) || 'R' || a.k[9:], 'l': list_prepend('assistant:' || text, a.l)}} END) AS eu,
                           least(da, ku, ru) AS ea, least(es0, ku, ru) AS es, least(do0, ku, ru, CASE WHEN ok AND c = 's' THEN {{'k': CAST(CAST(s.k[:8] AS BIGINT) + more AS VARCHAR) || 'K' || s.k[9:], 'l': list_prepend(line, s.l)}} END) AS eo
                    FROM (
                        SELECT w.*, m.text, m.c, m.role || ':' || m.text AS line, fault IN (0, 3) AS ok, CASE fault WHEN 3 THEN 5 ELSE 0 END AS more,
                               {{'k': CAST(CAST(u.k[:8] AS BIGINT) + 2 AS VARCHAR) || 'D' || u.k[9:], 'l': u.l}} AS du, {{'k': CAST(CAST(a.k[:8] AS BIGINT) + 2 AS VARCHAR) || 'D' || a.k[9:], 'l': a.l}} AS da,
                               {{'k': CAST(CAST(s.k[:8] AS BIGINT) + 2 AS VARCHAR) || 'D' || s.k[9:], 'l': s.l}} AS es0, {{'k': CAST(CAST(o.k[:8] AS BIGINT) + 2 AS VARCHAR) || 'D' || o.k[9:], 'l': o.l}} AS do0,
                               CASE WHEN ok AND c = 'u' THEN {{'k': CAST(CAST(u.k[:8] AS BIGINT) + more AS VARCHAR) || 'K' || u.k[9:], 'l': list_prepend(line, u.l)}} END AS ku,
                               CASE WHEN ok THEN {{'k': CAST(CAST(u.k[:8] AS BIGINT) + 1 + more AS VARCHAR) || 'R' || u.k[9:], 'l': list_prepend('user:' || m.text, u.l)}} END AS ru
                        FROM walk w JOIN marked m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND w.i = m.i WHERE w.i > 0) w)))
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(CAST(o.k[:8] AS BIGINT) - 10000000, 0) AS cost, coalesce(o.k[9:], '') AS audit, sha256(coalesce(array_to_string(o.l, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 0
    """,
}
