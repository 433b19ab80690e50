"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, dart_minhash, decontam, langid, line_dedup, mixing, sharding, token_files, url_templates, warc

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_quality(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.url_verdicts(table(spark, sf_dir, "pages"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op6_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).drop("path")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_mixture(table(spark, sf_dir, "documents"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.temperature_mix(table(spark, sf_dir, "documents"))


def op9_line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_decisions(table(spark, sf_dir, "documents")).drop("text_hash")
    return found.withColumn("removed_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ","))


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_bands, op2_token_files, op3_url_templates, op4_dart_minhash, op5_vector_sharding, op6_warc_records,
        op7_language_mixture, op8_temperature_mixing, op9_line_similarity, op10_suffix_automaton,
    )
}

ORACLE: dict[str, str] = {
    "op9_line_similarity": r"""
        WITH line AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
                      FROM (SELECT doc_id, string_split(replace(text, chr(9), ' '), chr(10)) AS l FROM documents WHERE text IS NOT NULL))
                      WHERE trim(l[i]) <> ''),
        first AS (SELECT line, min({'d': doc_id, 'l': line_no}) AS p FROM line GROUP BY line),
        word AS (SELECT line, unnest(list_distinct(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS w FROM first),
        df AS (SELECT w, count(*) AS f FROM word GROUP BY w),
        ordered AS (SELECT line, w, row_number() OVER (PARTITION BY line ORDER BY f, w) AS r, count(*) OVER (PARTITION BY line) AS n FROM word JOIN df USING (w)),
        prefix AS (SELECT * FROM ordered WHERE r <= n - (4 * n + 4) // 5 + 1),
        pair AS (SELECT DISTINCT x.line AS x, y.line AS y FROM prefix x JOIN prefix y ON x.w = y.w AND x.line <> y.line AND least(x.n, y.n) * 5 >= greatest(x.n, y.n) * 4),
        sets AS (SELECT line, list(w) AS s FROM word GROUP BY line),
        alike AS (SELECT x, y FROM pair JOIN sets a ON a.line = x JOIN sets b ON b.line = y
                  WHERE len(list_intersect(a.s, b.s)) * 5 >= (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) * 4),
        near AS (SELECT DISTINCT x AS line FROM alike JOIN first a ON a.line = x JOIN first b ON b.line = y WHERE b.p < a.p),
        judged AS (SELECT doc_id, line_no, p <> {'d': doc_id, 'l': line_no} AS again, near.line IS NOT NULL AS near FROM line JOIN first USING (line) LEFT JOIN near USING (line)),
        by_doc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE again OR near) AS n_removed, count(*) FILTER (WHERE near AND NOT again) AS n_near,
                   list(line_no ORDER BY line_no) FILTER (WHERE again OR near) AS removed_lines FROM judged GROUP BY doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near,
               coalesce(array_to_string(removed_lines, ','), '') AS removed_lines FROM documents LEFT JOIN by_doc USING (doc_id)""",
    "op10_suffix_automaton": r"""
        WITH item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
                      FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
                    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
        doc AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes)),
        found AS (SELECT r, i, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
}
