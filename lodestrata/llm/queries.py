"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, html_text, line_dedup, minhash_dedup, mixing, packing, pii, prefix_trie, quality_classifier, quality_rules, token_counts, warc
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("_row.doc_id", "n_lines", "n_removed", F.col("clean_text").alias("text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy drawn, in its shuffled place, with its text."""
    drawn = mixing.mix(table(spark, sf_dir, "documents"))
    return drawn.select("_row.doc_id", "_row.source", "_row.text", F.col("_copy").alias("copy"), F.round("_place", 9).alias("place"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents")).drop("_digest", "_label")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = prefix_trie.replanted(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(turns, members).drop("preorder", "subtree_end", "symbol")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


_ALL = (op1_quality_classifier, op2_pii, op3_line_dedup, op4_quality_rules, op5_exact_dedup, op6_packing, op7_warc, op8_html_extraction, op9_mixing, op10_minhash_dedup, op11_token_counts, op12_prefix_trie, op13_tokenizer_alignment)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
        ),
        worded AS (SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        windows AS (
            SELECT doc_id, k, [line, lead(line) OVER w, lead(line, 2) OVER w] AS window_lines, lead(line, 2) OVER w IS NOT NULL AS whole
            FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY k)
        ),
        later AS (SELECT doc_id, k FROM windows WHERE whole QUALIFY row_number() OVER (PARTITION BY window_lines ORDER BY doc_id, k) > 1),
        gone AS (SELECT DISTINCT w.doc_id, w.n FROM worded w JOIN (SELECT doc_id, unnest([k, k + 1, k + 2]) AS k FROM later) x ON w.doc_id = x.doc_id AND w.k = x.k)
        SELECT l.doc_id, count(*)::INTEGER AS n_lines, count(g.n)::INTEGER AS n_removed,
               coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE g.n IS NULL), '') AS text
        FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id
    """.replace("\\\\", "\\"),
    "op7_warc": """
        WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
        f AS (SELECT page_id, url, body, min(page_id) OVER (PARTITION BY body) AS first_id, unhex(sha1(body)) AS digest FROM p)
        SELECT page_id, octet_length(body) AS payload_bytes, url, refers_to, record_type, payload_digest FROM (
            SELECT *, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
                   array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (bits[i * 5 + 1:i * 5 + 5])::BIT::INTEGER + 1, 1)), '') AS payload_digest
            FROM (SELECT *, digest::BIT::VARCHAR AS bits FROM f)
        )
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_mixing": """
        WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        means AS (SELECT source, round(sum(n) OVER () * sqrt(n) / sum(sqrt(n)) OVER () / n, 12) AS mean FROM sizes),
        cdf AS (
            SELECT source, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS total FROM means
            UNION ALL
            SELECT source, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) FROM cdf
            WHERE k < mean + 12 * sqrt(mean) + 40
        ),
        drawn AS (
            SELECT doc_id, source, text, ('0x' || substr(md5('mix-1:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
        ),
        counted AS (
            SELECT doc_id, d.source, any_value(text) AS text, count(*) FILTER (WHERE c.total <= u) AS n
            FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY doc_id, d.source
        ),
        copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1))::INTEGER AS copy FROM counted)
        SELECT doc_id, source, text, copy,
               round(('0x' || substr(md5('mix-1:place:' || doc_id || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0, 9) AS place
        FROM copies
    """,
    "op12_prefix_trie": """
        WITH turns AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        convs AS (
            SELECT c, n, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, k: xor(b >> 1, 3988292384::BIGINT * (b & 1)))
            ), 4294967295::BIGINT) % 6 AS h
            FROM (SELECT c, max(d) AS n FROM turns GROUP BY c)
        ),
        heads AS (SELECT v.c, v.h, v.n, least(v.h, coalesce(b.n, 0)) AS k FROM convs v LEFT JOIN convs b ON b.c = v.c - v.c % 100),
        rebuilt AS (
            SELECT h.c, k + d - h.h AS d, role, txt FROM heads h JOIN turns t ON t.c = h.c AND t.d > h.h
            UNION ALL
            SELECT h.c, d, role, txt FROM heads h JOIN turns t ON t.c = h.c - h.c % 100 AND t.d <= h.h
        ),
        paths AS (SELECT h.c, coalesce(list({'r': role, 't': txt} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS path FROM heads h LEFT JOIN rebuilt r ON r.c = h.c GROUP BY h.c),
        steps AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths),
        nodes AS (
            SELECT path[1:d] AS node, d, min(c) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(path) = d), '')) AS ends_sha256
            FROM steps GROUP BY ALL
        ),
        kept AS (
            SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.node[n.d].t) END AS own
            FROM nodes n LEFT JOIN nodes p ON n.d = p.d + 1 AND n.node[1:n.d - 1] = p.node
            LEFT JOIN (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL) k ON n.node = k.node
        ),
        above AS (SELECT node[1:a] AS node, n_children, own FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM kept)),
        sums AS (SELECT node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM above GROUP BY node)
        SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM kept JOIN sums USING (node)
    """,
}
