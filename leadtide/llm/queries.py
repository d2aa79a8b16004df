"""The queries of this subpackage's operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_tree import bpe_round_trip
from .common import read
from .exact_dedup import exact_dedup
from .filter_audit import few_words, filter_audit, holds_any, many_capitals, repeated_words
from .html_text import html_text
from .jaccard_join import jaccard_components
from .language_id import language_id
from .packing import best_fit_packing
from .phrases import collocations
from .sharding import shard_digests
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .topk import top_k
from .warc import warc_round_trip


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(read(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"), least=200)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digests(read(spark, sf_dir, "documents"), shards=40)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {
        "A": lambda text, words: few_words(words, 200),
        "B": lambda text, words: repeated_words(words, 50),
        "C": lambda text, words: many_capitals(text, 2),
        "D": lambda text, words: holds_any(text, "[#$%&*|]"),
    }
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), conditions, copies="E")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"), least=30, most_words=4, scale=2_000_000, inside=80, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_topk": op5_topk,
    "op6_packing": op6_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_sharding": op11_sharding,
    "op12_filter_audit": op12_filter_audit,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id, strlen(html) AS n FROM p),
             r AS (SELECT *, n >= 100 AND first_id <> page_id AS again FROM d)
        SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_id END AS refers_to
        FROM r""",
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                   FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
             w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
             l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
             m AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                          concat(CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
                                 CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END,
                                 CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END) AS fails
                   FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
             f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
             o AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM f a, f b, f c, f d, f e
                   WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
             s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k:k] AS own, filter_order[1:k - 1] AS before FROM o, range(1, 6) t(k)),
             g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
             x AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS bad, length(translate(fails, before, '')) = length(fails) AS here FROM g, s),
             r AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (here AND NOT bad), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND bad), 0) AS BIGINT) AS removed,
                          CAST(coalesce(sum(n) FILTER (bad AND NOT here), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
                          CAST(coalesce(sum(good) FILTER (here AND bad), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (here AND bad), 0) AS BIGINT) AS toxic_lost
                   FROM x GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op13_phrases": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
             w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
             g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
             c AS (SELECT lang, k, ws[i:i + k - 1] AS ph, count(*) AS f FROM g GROUP BY ALL),
             t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
             a AS (SELECT * FROM c WHERE f >= 30),
             u AS (SELECT lang, k, ph, f, unnest(range(1, k)) AS j FROM a WHERE k > 1),
             s AS (SELECT u.lang, u.ph, u.k, u.f AS a, j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * u.f) // (x.f + y.f) AS BIGINT) AS score
                   FROM u JOIN a x ON x.lang = u.lang AND x.ph = u.ph[1:j] JOIN a y ON y.lang = u.lang AND y.ph = u.ph[j + 1:]),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
             h AS (SELECT lang, q, max(f) AS f FROM (SELECT lang, f, unnest(list_transform(range(1, k - m + 2), lambda z: ph[z:z + m - 1])) AS q FROM a, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY ALL),
             e AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN h ON h.lang = b.lang AND h.q = b.ph WHERE h.f IS NULL OR 100 * h.f < 80 * a),
             v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
        SELECT v.lang, rank, phrase, a, l, r, n, score FROM v JOIN t ON t.lang = v.lang WHERE rank <= 2000""",
}
