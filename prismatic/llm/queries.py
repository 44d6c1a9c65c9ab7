"""One query for each operator, over its whole table, by the operator and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, hmm_lm, near_dedup, packing, secrets, sentence_dedup, toxicity, vafile
from .shared import documents


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = secrets.judged(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decided(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.scored(documents(spark, sf_dir), by=7, held=2)


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_dedup.deduplicated(documents(spark, sf_dir))
    return found.withColumn("kept_chars", F.char_length("clean_text").cast("long"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    rows = chat.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(chat.turns(more))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat.read_back(chat.masked(rows, path, public_tokenizers.PATTERN), path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, window=1024, end=0)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), w=3, num=85, den=100)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), by=5, held=0)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def queries() -> dict:
    own = (op1_secret_scans, op2_exact_dedup, op3_hmm_scoring, op4_sentence_spans, op5_bpe_round_trip, op6_chat_format, op7_packing, op8_near_dedup, op9_toxicity, op10_exact_top_k)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scans": r"""
            WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
            patterns(kind, name, p, g) AS (
                VALUES (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
                       (1, 'access', '(AKIA[A-Z0-9]+)', 1), (2, 'hex', '([0-9a-f]+)', 1), (3, 'owner', '([A-Za-z0-9+/_-]+)', 1)),
            m AS (
                SELECT doc_id, owner, repo, kind, name, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(v) AS v, unnest(b[1:len(m)]) AS b
                FROM (SELECT *, CASE g WHEN 2 THEN regexp_extract_all(t, p, 2) ELSE regexp_extract_all(t, p, 1) END AS v,
                             regexp_extract_all(t, p) AS m, regexp_split_to_array(t, p) AS b FROM d, patterns)),
            s AS MATERIALIZED (
                SELECT doc_id, owner, repo, kind, name, v, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e, length(m) AS n FROM m
                QUALIFY length(v) >= CASE kind WHEN 0 THEN 6 WHEN 2 THEN 24 ELSE 20 END
                    AND (kind < 3 OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))),
            live AS (SELECT v, count(DISTINCT owner) <= 1 AND count(DISTINCT (owner, repo)) <= 2 AS live FROM s GROUP BY v),
            l AS (SELECT doc_id, kind, live, e - n AS a, name || ':' || (e - n) || ':' || e AS span FROM s JOIN live USING (v))
            SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                   sha256(coalesce(string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256,
                   coalesce(string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3 OR live), '') AS spans,
                   count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
            FROM d LEFT JOIN l USING (doc_id) GROUP BY doc_id""",
        "op2_exact_dedup": r"""
            WITH d AS (
                SELECT doc_id, length(coalesce(text, '')) AS size,
                       sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
                FROM documents),
            r AS (
                SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
                       count(*) OVER (PARTITION BY text_sha256) AS group_size
                FROM d)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
        "op4_sentence_spans": r"""
            WITH cut AS (
                SELECT coalesce(doc_id, -9223372036854775808) AS doc_id,
                       regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?…][ \t]+)', '\1' || chr(57344), 'g'),
                           chr(57344) || '([\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)', '\1', 'g'),
                           '(\n+)', '\1' || chr(57344), 'g'), chr(57344)) AS s
                FROM documents),
            every AS MATERIALIZED (
                SELECT doc_id, k, s, list_filter(regexp_split_to_array(s, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS w
                FROM (SELECT doc_id, unnest(range(len(s))) AS k, unnest(s) AS s FROM (SELECT doc_id, list_filter(s, lambda x: x <> '') AS s FROM cut))),
            filled AS MATERIALIZED (
                SELECT doc_id, k, row_number() OVER o AS f, sum(len(w)) OVER o - len(w) AS a, sum(len(w)) OVER o AS b, array_to_string(w, ' ') AS t
                FROM every WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
            texts AS MATERIALIZED (SELECT doc_id, list(t ORDER BY f) AS t FROM filled GROUP BY doc_id),
            bounds AS (
                SELECT x.doc_id, x.f AS a, y.f AS b, x.k AS first, y.k AS last FROM filled x ASOF JOIN filled y ON x.doc_id = y.doc_id AND x.a + 15 <= y.b
                UNION
                SELECT x.doc_id, x.f, y.f, x.k, y.k FROM filled y ASOF JOIN filled x ON x.doc_id = y.doc_id AND y.b - 15 >= x.a),
            runs AS MATERIALIZED (SELECT doc_id, a, b, first, last, array_to_string(t[a:b], chr(31)) AS t FROM bounds JOIN texts USING (doc_id)),
            gone AS (
                SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS k
                FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, a, b) > 1)),
            kept AS MATERIALIZED (SELECT e.doc_id, e.k, e.s, g.k IS NOT NULL AS dead FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k),
            islands AS (
                SELECT doc_id, min(k) AS a, max(k) AS b
                FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM kept WHERE dead) GROUP BY doc_id, i),
            removed AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS r FROM islands GROUP BY doc_id),
            whole AS (
                SELECT doc_id, count(*) AS n, count(*) FILTER (dead) AS d, coalesce(string_agg(s, '' ORDER BY k) FILTER (NOT dead), '') AS c FROM kept GROUP BY doc_id)
            SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(d, 0) AS n_removed, coalesce(r, '') AS removed_spans,
                   coalesce(c, '') AS clean_text, length(coalesce(c, '')) AS kept_chars
            FROM documents d LEFT JOIN whole w ON w.doc_id = d.doc_id LEFT JOIN removed r ON r.doc_id = d.doc_id""",
        "op6_chat_format": r"""
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(4 + length(regexp_replace(role, '\\|###|</turn>|:', '\\\0', 'g')) + 2
                       + length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g')) + 9)::BIGINT AS formatted_chars
            FROM t GROUP BY conv_id""",
        "op8_near_dedup": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
                FROM documents),
            s AS MATERIALIZED (
                SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
                FROM w),
            e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
            shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS m, any_value(b.n) AS n FROM e a JOIN e b USING (h) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
            l AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * k >= 85 * (m + n - k) UNION ALL SELECT b, a FROM shared WHERE 100 * k >= 85 * (m + n - k)),
            r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
            SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id""",
        "op10_exact_top_k": r"""
            WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings),
            s AS (
                SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
                FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    }
