"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.binary import token_shards
from tessera.llm.centroids import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED, cluster_vectors
from tessera.llm.common import conversations, documents, embeddings, pages
from tessera.llm.digest_index import index_documents
from tessera.llm.langid import identify
from tessera.llm.mixing import mix
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.prefix_trie import prefix_trie
from tessera.llm.quality import judge
from tessera.llm.sketches import fingerprints
from tessera.llm.suffix_tree import score_documents
from tessera.llm.urls import judge_urls
from tessera.llm.warc import archive_pages


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(pages(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(pages(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_documents(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(documents(spark, sf_dir))


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), scan=True)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(embeddings(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(conversations(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_fingerprints": op2_fingerprints,
    "op3_url_filter": op3_url_filter,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_minhash": op8_minhash,
    "op9_quality": op9_quality,
    "op10_token_ids": op10_token_ids,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_centroids": op12_centroids,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest
            FROM documents)
        SELECT doc_id,
               min(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY digest ORDER BY doc_id NULLS LAST, row) = 1 AS kept,
               digest AS text_sha256
        FROM d WINDOW g AS (PARTITION BY digest)
    """,
    "op8_minhash": r"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i
                  FROM w WHERE len(words) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n
            HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach AS (
            SELECT doc_id, doc_id AS least FROM documents
            UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.least) AS component_id,
               d.doc_id = min(r.least) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id)
        GROUP BY d.doc_id, n.n
    """,
}


def _clustering_sql() -> str:
    """Every round spelled out: all distances, the nearest, exact floors of the means."""
    parts = [f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id,
                   list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = {DIMENSIONS}
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS cluster, v
            FROM kept QUALIFY cluster < {CLUSTERS})"""]
    for k in range(ROUNDS + 1):
        parts.append(f"""
        a{k} AS MATERIALIZED (
            SELECT row, vec_id, kept.v, c.cluster,
                   list_sum(list_transform(range(1, {DIMENSIONS} + 1),
                       lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i])))::BIGINT AS distance
            FROM kept, c{k} c
            QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if k < ROUNDS:
            parts.append(f"""
        m{k} AS MATERIALIZED (
            SELECT cluster, list(f ORDER BY i) AS v FROM (
                SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS f
                FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {DIMENSIONS} + 1)) AS i FROM a{k})
                GROUP BY cluster, i)
            GROUP BY cluster),
        c{k + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (cluster))""")
    return ",".join(parts) + f"""
        SELECT vec_id, a.cluster::INT AS cluster, distance,
               (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)
    """


ORACLES["op12_centroids"] = _clustering_sql()
ORACLES["op13_prefix_trie"] = r"""
    WITH turns AS MATERIALIZED (
        SELECT conv_id, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS mark,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS r
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS MATERIALIZED (
        SELECT conv_id, xor(list_reduce(
            list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda a, b: list_reduce([xor(a, b)] || range(8), lambda s, z:
                CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END),
            4294967295::BIGINT), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM turns)),
    steps AS MATERIALIZED (
        SELECT c.conv_id, 0 AS whose, t.r, mark, words
        FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.r <= c.h
        UNION ALL
        SELECT c.conv_id, 1, t.r, mark, words
        FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.r > c.h),
    paths AS MATERIALIZED (
        SELECT conv_id, words, row_number() OVER w AS depth,
               sha256(string_agg(mark, '') OVER w) AS node
        FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY whose, r
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    members AS MATERIALIZED (
        SELECT conv_id, depth, words, node,
               coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent
        FROM paths
        UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs),
    nodes AS MATERIALIZED (
        SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, any_value(parent) AS parent,
               count(*) AS n, (count(*) - 1) * min(words) AS saved
        FROM members GROUP BY node),
    born AS MATERIALIZED (SELECT parent AS node, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    sums AS MATERIALIZED (
        SELECT m.node, sum(n.saved) AS saved, sum((b.k IS NULL)::INT) AS leaves
        FROM nodes n LEFT JOIN born b ON b.node = n.node
        JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node),
    ends AS MATERIALIZED (
        SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, node FROM members QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1)
        GROUP BY node)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs,
           coalesce(b.k, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
           s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM nodes n JOIN sums s USING (node) LEFT JOIN born b ON b.node = n.node
    LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN ends e ON e.node = n.node
"""
