"""The registered queries op1 to op10 and `pipeline`: whole tables, production parameters, contract columns."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import table

from . import ann, bpe, centroids, common, exact_dedup, lexical, line_dedup, packing, quality, simhash, sstable, substring_dedup, token_counts, url_filter
from .wordcodes import Vocabulary


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Vocabulary("words", public_tokenizers.path("word_bpe_49k.json"), added=True)
    return packing.pack_documents(table(spark, sf_dir, "documents"), words, end_id=1, capacity=2048).placed()


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = Vocabulary("bytes", public_tokenizers.path("byte_bpe_50k.json"), added=True)
    manifest = sstable.write(table(spark, sf_dir, "documents"), tokens, end_id=0)
    return sstable.digests(manifest)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, threshold=0.3).select("doc_id", F.coalesce(quality.fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4, seed=42)
    return found.select("doc_id", "fingerprint", "component_id")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), Vocabulary("tiktoken", path, public_tokenizers.PATTERN), path)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = Vocabulary("bytes", public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokens, end_id=50256)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"), min_documents=10, min_points=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.Clustering(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, salt="2:").report()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Writes a query's rows to the shared folder and deletes the scratch tables and files that they came from."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with common.recording([]) as paths:
            found = query(spark, sf_dir)
        kept = common.stage_table(found, query.__name__)
        common.release(spark, paths)
        return kept

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": _tidy(op1_substring_dedup),
    "op2_packing": _tidy(op2_packing),
    "op3_exact_dedup": _tidy(op3_exact_dedup),
    "op4_token_shards": _tidy(op4_token_shards),
    "op5_quality_classifier": op5_quality_classifier,
    "op6_simhash_near_dedup": _tidy(op6_simhash_near_dedup),
    "op7_nearest_neighbours": _tidy(op7_nearest_neighbours),
    "op8_byte_bpe": _tidy(op8_byte_bpe),
    "op9_token_counts": _tidy(op9_token_counts),
    "op10_url_filter": op10_url_filter,
    "op11_line_dedup": _tidy(op11_line_dedup),
    "op12_lexical_search": _tidy(op12_lexical_search),
    "op13_centroid_clusters": _tidy(op13_centroid_clusters),
    "pipeline": pipeline,
}

def _rounds_sql(k: int, rounds: int) -> str:
    """The twin of op13: each round a pair of common table expressions."""
    away = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [
        """v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, x AS c FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(struct_pack(d := d, cluster := cluster)) AS best FROM (SELECT vec_id, x, cluster, {away} AS d FROM v, c{r}) GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT cluster, dim, sum(value) AS s, count(*) AS n FROM (SELECT best.cluster AS cluster, unnest(x) AS value, unnest(range(1, 65)) AS dim FROM a{r}) GROUP BY cluster, dim),
            m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY dim) AS c FROM s{r} GROUP BY cluster),
            c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.d AS distance,
               CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON best.cluster = c{rounds}.cluster"""


ORACLE_SQL: dict[str, str] = {
    "op13_centroid_clusters": _rounds_sql(40, 5),
    "op1_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents),
        starts AS (
            SELECT doc_id, unnest(range(1, len(words) - 48)) AS p, words FROM d WHERE len(words) >= 50),
        windows AS (SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS win FROM starts),
        least AS (SELECT win, min(doc_id) AS lo FROM windows GROUP BY win),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p
            FROM windows JOIN least USING (win) WHERE lo < doc_id),
        lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        out AS (
            SELECT d.doc_id, d.words, coalesce(l.ps, []) AS ps FROM d LEFT JOIN lists l ON d.doc_id = l.doc_id)
        SELECT doc_id, len(words) AS n_words, len(ps) AS n_removed,
               sha256(coalesce(array_to_string(list_filter(words, lambda w, i: NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
        FROM out
    """,
    "op12_lexical_search": r"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
        all_docs AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM len),
        df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        w AS (SELECT item_id, term, count(*) * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM q JOIN df USING (term), all_docs GROUP BY item_id, term, docs, df),
        s AS (
            SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
            FROM w JOIN p USING (term) JOIN len USING (doc_id), all_docs GROUP BY item_id, doc_id),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
    """,
    "op11_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos, len(lines) AS n_lines FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, any_value(n_lines) AS n_lines, count(*) FILTER (often.key IS NOT NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (often.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN often USING (key) GROUP BY doc_id
    """,
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER best = 1 AS kept,
               text_sha256
        FROM n WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
}
