"""The registered queries of this package, and DuckDB SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import bpe, crosstok, html_extract, langid, linededup, neardup, negatives, packing, pitman, quality, suffixdedup, topk, warc
from pagetide.llm.common import read, shuffle_partitions


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), with_ids=False)
    return packing.pack(pieces)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).drop("cleaned_text")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeated_strings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(read(spark, sf_dir, "pages"))
    records = warc.read_records(index.repartition(shuffle_partitions(spark), "archive"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(read(spark, sf_dir, "documents"), size=4)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pitman.score(docs, pitman.fit(docs))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = [_vocabulary(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    return crosstok.digest(read(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_bpe_round_trip": op3_bpe_round_trip,
        "op4_language_id": op4_language_id,
        "op5_line_dedup": op5_line_dedup,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_quality_rules": op7_quality_rules,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_warc_archives": op9_warc_archives,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_lm_scoring": op11_lm_scoring,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_cross_tokenizer": op13_cross_tokenizer,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": OP5_SQL,
        "op6_exact_top_k": OP6_SQL,
        "op7_quality_rules": OP7_SQL,
        "op12_hard_negatives": OP12_SQL,
    }


# Every run of lines with ten words that stands earlier goes. The shortest such runs
# from each line on (c) and up to each line (c2) cover all longer ones.
OP5_SQL = r"""
WITH a AS (SELECT doc_id, text, u.i AS no, regexp_replace(string_split(text, chr(10))[u.i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s
           FROM documents, LATERAL unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
b AS (SELECT doc_id, list(s ORDER BY no) AS s, list(no ORDER BY no) AS no, list(len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) ORDER BY no) AS w
      FROM a WHERE s <> '' GROUP BY doc_id),
c AS (SELECT doc_id, s, no, u.i AS i, list_filter(range(1, 11), lambda n: u.i + n - 1 <= len(s) AND list_sum(w[u.i : u.i + n - 1]) >= 10)[1] AS n
      FROM b, LATERAL unnest(range(1, len(s) + 1)) AS u(i)),
c2 AS (SELECT doc_id, s, no, u.i AS j, list_filter(range(1, 11), lambda n: u.i - n >= 0 AND list_sum(w[u.i - n + 1 : u.i]) >= 10)[1] AS n
       FROM b, LATERAL unnest(range(1, len(s) + 1)) AS u(i)),
r AS (SELECT doc_id, s, no, i, n FROM c WHERE n IS NOT NULL UNION SELECT doc_id, s, no, j - n + 1, n FROM c2 WHERE n IS NOT NULL),
d AS (SELECT doc_id, no, i, n, row_number() OVER (PARTITION BY s[i : i + n - 1] ORDER BY doc_id, i) AS copy FROM r),
e AS (SELECT doc_id, list(DISTINCT no[i + u.k]) AS gone FROM d, LATERAL unnest(range(0, n)) AS u(k) WHERE copy > 1 GROUP BY doc_id),
f AS (SELECT t.doc_id, CAST(coalesce(len(b.s), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(e.gone), 0) AS BIGINT) AS n_removed,
             CASE WHEN e.gone IS NULL THEN text ELSE
               coalesce(array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda k: NOT list_contains(e.gone, k)), lambda k: string_split(text, chr(10))[k]), chr(10)), '') END AS left_text
      FROM documents t LEFT JOIN b ON t.doc_id = b.doc_id LEFT JOIN e ON t.doc_id = e.doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(left_text) AS BIGINT) AS n_chars_left, md5(left_text) AS text_md5 FROM f
"""

OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM d, LATERAL unnest(range(1, len(w) - 3)) AS u(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, LATERAL unnest(range(0, 5)) AS u(k) WHERE n >= 2 GROUP BY doc_id),
s AS (SELECT d.doc_id, t, l, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (SELECT doc_id, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x FROM s, LATERAL unnest(wl) AS u(line)),
f AS (SELECT doc_id, CAST(sum(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))) AS BIGINT) AS lost
      FROM (SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM b)
      WHERE NOT regexp_matches(x, '\p{L}') OR (NOT regexp_matches(x, '[.!?…。！？؟।:;]') AND n < 30)
        OR (n < 4 AND NOT regexp_matches(x, '[.!?…。！？؟।:;]["''”’»)\]]*$'))
        OR length(x) - length(translate(x, '#*$%&|<>', '')) > 0.2 * length(x)
        OR (n < 30 AND regexp_matches(x, '(?:[|»›•·→>].*){2,}'))
        OR (n < 30 AND regexp_matches(x, '(?i)\b(?:all rights reserved|cookie policy|enable javascript|javascript is disabled|lorem ipsum|privacy policy|read more|share this|sign in|sign up|skip to content|subscribe to|terms of (?:use|service)|click here|use of cookies)\b'))
      GROUP BY doc_id)
SELECT s.doc_id, n_words, word_chars, n_symbols, CAST(len(wl) - len(list_distinct(wl)) AS BIGINT) AS n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars - coalesce(f.lost, 0) >= 0.5 * word_chars AS kept
FROM s LEFT JOIN f ON s.doc_id = f.doc_id
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
