"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxrates.llm.common import table
from boxrates.llm.exact_dedup import copies
from boxrates.llm.license_scans import licenses
from boxrates.llm.mixing import mixed
from boxrates.llm.near_dedup import near_classes
from boxrates.llm.packing import packed
from boxrates.llm.prefix_trie import prefix_nodes
from boxrates.llm.secret_scans import base_only, count_kind, joined_spans, scan_versions
from boxrates.llm.segment_search import top_k
from boxrates.llm.spelling import variants, word_counts
from boxrates.llm.suffix_repeats import without_repeats
from boxrates.llm.token_counts import token_counts
from boxrates.llm.toxicity import scored_documents
from boxrates.llm.warc_zip import archived
from boxrates.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark, sf_dir):
    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark, sf_dir):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, tokenizer, work_dir(spark, "token-cache"))


def op3_secret_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_versions(docs, work_dir(spark, "secret-ledger"))
    spans = F.col("findings")
    return found.select(
        "doc_id",
        *[count_kind(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined_spans(base_only(spans)), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
    )


def op4_warc_zip(spark, sf_dir):
    return archived(table(spark, sf_dir, "pages"))


def op5_segment_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_exact_dedup(spark, sf_dir):
    found = copies(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op7_near_dedup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_license_scans(spark, sf_dir):
    found = licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("expressions", F.array_join("expressions", "\n"))


def op9_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark, sf_dir):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packed(table(spark, sf_dir, "documents"), tokenizer)


def op11_spelling(spark, sf_dir):
    return variants(word_counts(table(spark, sf_dir, "documents")))


def op12_suffix_repeats(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_nodes(table(spark, sf_dir, "conversations"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scans": op3_secret_scans,
    "op4_warc_zip": op4_warc_zip,
    "op5_segment_search": op5_segment_search,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_license_scans": op8_license_scans,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_suffix_repeats": op12_suffix_repeats,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

#: CRC-32 of a list of bytes ``{}``, bit by bit; 0xEDB88320 is the polynomial, reversed.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {}), lambda crc, b:
            list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, bit:
                xor(c >> 1, 3988292384 * (c & 1)))))"""
_BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
_CRC_OF = _CRC.format(_BYTES)

ORACLES: dict[str, str] = {
    "op4_warc_zip": """
        WITH p AS (
            SELECT page_id, sha256(coalesce(html, '')) AS digest,
                   octet_length(encode(coalesce(html, ''))) AS n
            FROM pages
        ), f AS (
            SELECT page_id, digest, n, min(page_id) OVER (PARTITION BY digest) AS first FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to,
               true AS intact
        FROM f
    """,
    "op5_segment_search": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
            WHERE a.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, vec_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op6_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents
        ), g AS (
            SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM g
    """,
    # The level closes in one step: sources by their cap per weight, clamped up to the first
    # that the rest can't fill.
    "op9_mixing": r"""
        WITH d AS (
            SELECT doc_id, source,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
            FROM d GROUP BY source
        ), o AS (
            SELECT *, sum(source_size) OVER () AS total,
                   coalesce(sum(3 * source_size) OVER before, 0) AS filled,
                   sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free
            FROM s
            WINDOW before AS (ORDER BY 3.0 * source_size / weight, source IS NULL, source
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (
            SELECT arg_min(CAST(total - filled AS DOUBLE) / CAST(free AS DOUBLE),
                           3.0 * source_size / weight) AS level
            FROM o
            WHERE CAST(total - filled AS DOUBLE) / CAST(free AS DOUBLE) * weight <= 3 * source_size
        ), t AS (
            SELECT source, source_size,
                   least(CAST(3 * source_size AS DOUBLE), weight * coalesce(level, 1e300)) AS target
            FROM s CROSS JOIN l
        )
        SELECT d.doc_id, d.size, t.source_size, t.target,
               CAST(least(floor(
                   (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END) * d.size
                   + CAST(('0x' || substr(md5(concat('17:', coalesce(CAST(d.doc_id AS VARCHAR), 'null'))), 1, 12)) AS BIGINT)
                     / 281474976710656.0), 3 * d.size) AS BIGINT) AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    """,
    # Words one edit apart share what is left after leaving out one code point.
    "op11_spelling": rf"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                   unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
            FROM documents
        ), distinct_runs AS (
            SELECT id, run, count(*) AS times, id || ':' || run AS named
            FROM runs WHERE len(run) >= 7 GROUP BY id, run
        ), hashed AS (
            SELECT run, times, {_CRC_OF.format("named")} AS h FROM distinct_runs
        ), words AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % len(run) AS BIGINT))
                             || substr(run, CAST(h % len(run) AS BIGINT) + 2) ELSE run END AS word,
                   CAST(sum(times) AS BIGINT) AS n
            FROM hashed GROUP BY 1 HAVING len(word) >= 7 AND n >= 2
        ), shorter AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM words, unnest(range(len(word))) AS u(i)
        ), pairs AS (
            SELECT DISTINCT a.word, b.word AS other, b.n AS m
            FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT w.word, s.word, s.n FROM words w JOIN shorter s ON w.word = s.rest
            UNION SELECT s.word, w.word, w.n FROM words w JOIN shorter s ON w.word = s.rest
        ), near AS (
            SELECT word, count(*) AS n_near, max(m) AS most,
                   arg_min(other, (-m, other)) AS best
            FROM pairs GROUP BY word
        ), formed AS (
            SELECT w.word, n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN most >= 10 * n THEN best END AS form,
                   CASE WHEN most >= 10 * n THEN most END AS form_n
            FROM words w LEFT JOIN near USING (word)
        ), steps AS (
            SELECT word, word AS root, form AS next FROM formed
            UNION ALL
            SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON s.next = f.word
        )
        SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n
        FROM formed f JOIN steps s ON f.word = s.word AND s.next IS NULL
    """,
    "op13_prefix_trie": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS n
            FROM (
                SELECT conv_id, turn, substr(sha256(concat(len(r), ':', r, ':', x)), 1, 32) AS key,
                       len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
                FROM t
            )
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base,
                   {_CRC_OF.format("CAST(conv_id AS VARCHAR)")} % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM t)
        ), turns AS (
            SELECT c.conv_id, 0 AS part, o.n, o.key, o.words
            FROM c JOIN own o ON o.conv_id = c.base AND o.n <= c.h
            UNION ALL
            SELECT c.conv_id, 1, o.n, o.key, o.words
            FROM c JOIN own o ON o.conv_id = c.conv_id AND o.n > c.h
        ), paths AS (
            SELECT c.conv_id,
                   coalesce(list(key ORDER BY part, n) FILTER (key IS NOT NULL), []) AS p,
                   list(words ORDER BY part, n) AS w
            FROM c LEFT JOIN turns USING (conv_id) GROUP BY c.conv_id
        ), members AS (
            SELECT conv_id, d, array_to_string(p[1:d], ',') AS node, len(p) = d AS ends,
                   CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words
            FROM paths, unnest(range(len(p) + 1)) AS u(d)
        ), nodes AS (
            SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
                   CASE WHEN d > 0 THEN array_to_string(string_split(node, ',')[1:d - 1], ',') END AS parent,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                                   FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY d, node
        ), kids AS (
            SELECT d - 1 AS d, parent AS node, count(*) AS n_children
            FROM nodes WHERE d > 0 GROUP BY ALL
        ), counted AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children
            FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.node = k.node
        ), sums AS (
            SELECT u.d, array_to_string(string_split(node, ',')[1:u.d], ',') AS node,
                   count(*) FILTER (n_children = 0) AS n_leaves,
                   sum((n_convs - 1) * words) AS saved_tokens
            FROM counted, unnest(range(counted.d + 1)) AS u(d) GROUP BY 1, 2
        )
        SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children,
               s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
        FROM counted a JOIN sums s ON a.d = s.d AND a.node = s.node
        LEFT JOIN counted p ON p.d = a.d - 1 AND p.node = a.parent
    """,
}
