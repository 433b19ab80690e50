"""Queries over the test tables, one or more for each operator, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CleanupOptions, NearOptions, ScanOptions
from ..functions import audio, bits, color, hashing, paths, text
from ..operators import banding, cleanup, exact, incremental, near, stats
from ..sources import corpus
from ..streaming import dedupe as streaming
from ..tables import materialise, shared_path

#: Events in a track of audio samples.
TRACK = 16384

# What documents are as files, in SQL.
FILES = """
    files AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.' || lang AS path, doc_id || '.' || lang AS name,
              CAST(octet_length(encode(text)) AS BIGINT) AS size, '.' || lang AS extension, (doc_id * 7919) % 1000003 AS mtime,
              CAST(doc_id % 4 AS INTEGER) AS depth, '/' || source AS source_root, doc_id, text, sha256(text) AS content_hash FROM documents)"""
GROUPS = f"""{FILES},
    dup AS (SELECT content_hash, min(size) AS size, count(*) AS n_files, min(size) * (count(*) - 1) AS wasted_space,
            count(DISTINCT source_root) > 1 AS is_cross_directory FROM files GROUP BY content_hash HAVING count(*) > 1)"""
MEMBERS = f"""{GROUPS}, members AS (SELECT files.*, n_files, wasted_space, is_cross_directory FROM files JOIN dup USING (content_hash))"""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents_as_files(spark, sf_dir)


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.hashed_documents(spark, sf_dir)


# Scans, totals and filters


@query(f"WITH {FILES} SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size FROM files")
def scan_totals(spark, sf_dir):
    return stats.scan_totals(documents(spark, sf_dir))


@query(f"WITH {FILES} SELECT extension, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY extension")
def ext_stats(spark, sf_dir):
    return stats.extension_stats(documents(spark, sf_dir))


@query(f"""WITH {FILES}, s AS (SELECT extension, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY extension)
    SELECT extension, n_files, total_size, round(total_size * 100.0 / sum(total_size) OVER (), 2) AS share FROM s ORDER BY total_size DESC, extension LIMIT 10""")
def ext_share_top10(spark, sf_dir):
    return stats.top_extensions(documents(spark, sf_dir))


@query(f"WITH {FILES} SELECT path, name, size, extension, mtime, depth, source_root FROM files WHERE size >= 500 AND size <= 5000 AND extension IN ('.en', '.fr')")
def scan_filter_size_ext(spark, sf_dir):
    files = stats.scan_filter(documents(spark, sf_dir), ScanOptions(500, 5000, ("en", ".FR")))
    return files.select("path", "name", "size", "extension", "mtime", "depth", "source_root")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages),
    e AS (SELECT page_id, coalesce(nullif(lower(regexp_extract(regexp_extract(u, '[^/]*$'), '^.+(\\.[^.]*)$', 1)), ''), '(no extension)') AS extension FROM p)
    SELECT page_id, extension, CASE WHEN extension IN ('.html', '.css', '.js', '.txt', '.json', '.xml', '.md') THEN 'text' WHEN extension IN ('.png', '.jpg', '.gif') THEN 'image' ELSE 'other' END AS media_type FROM e""")
def media_type_classify(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ext = paths.extension(F.regexp_replace("url", "[?#].*$", ""))
    return p.select("page_id", ext.alias("extension"), paths.media_type(ext).alias("media_type"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_replace(url, '/[^/]*$', '') AS folder,
    CAST(len(string_split(url, '/')) - 3 AS INTEGER) AS depth, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages""")
def page_paths(spark, sf_dir):
    p = corpus.pages_as_files(spark, sf_dir)
    return p.select("page_id", paths.basename(F.col("path")).alias("name"), paths.dirname(F.col("path")).alias("folder"), (F.size(F.split("path", "/")) - 3).alias("depth"), "size")


@query(f"WITH {FILES} SELECT size, count(*) AS n_files FROM files GROUP BY size")
def size_groups(spark, sf_dir):
    return stats.size_groups(documents(spark, sf_dir))


@query(f"WITH {FILES} SELECT path, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)")
def size_groups_candidates(spark, sf_dir):
    return stats.same_size(documents(spark, sf_dir)).select("path", "size")


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN CAST(CAST(n AS INTEGER) AS VARCHAR) || ' B' ELSE regexp_replace(printf('%.2f', round(n / 1024.0, 2)), '\\.?0+$', '') || ' KB' END AS shown
    FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)""")
def format_bytes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", paths.format_bytes(F.col("size")).alias("shown"))


@query(f"""WITH {FILES}, r AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '/even' ELSE '/odd' END AS r FROM files)
    SELECT r AS source_root, extension, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size FROM r GROUP BY ALL""")
def federated_union(spark, sf_dir):
    d = documents(spark, sf_dir)
    even, odd = (d.where(F.col("doc_id") % 2 == k).withColumn("source_root", F.lit(root)) for k, root in ((0, "/even"), (1, "/odd")))
    return even.unionByName(odd).groupBy("source_root", "extension").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_size"))


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT regexp_matches(path, '^/src1[0-9]*/') OR regexp_matches(path, '^/src1/en/')")
def ignore_rules(spark, sf_dir):
    from ..sources.ignore import IgnoreRules

    rules = IgnoreRules(["/src1?/", "/src1/*", "!/src1/en"])
    return documents(spark, sf_dir).where(~rules.column(F.substr("path", F.lit(2)))).select("path")


# Hashes and exact groups


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def content_hash_all(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", *(hashing.content_hash(F.col("text"), a).alias(a) for a in ("sha256", "md5", "sha1")))


@query("SELECT doc_id, sha256(unhex(substring(hex(encode(text)), 1, 8192))) AS quick FROM documents")
def quick_hash(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", hashing.quick_hash(F.col("text")).alias("quick"))


@query(f"WITH {GROUPS} SELECT * FROM dup")
def exact_groups(spark, sf_dir):
    return exact.duplicate_hashes(hashed(spark, sf_dir))


@query(f"WITH {GROUPS} SELECT content_hash, size, n_files, wasted_space, is_cross_directory FROM dup")
def find_duplicates(spark, sf_dir):
    return exact.find_duplicates(corpus.documents_as_files(spark, sf_dir, True), "text")


@query(f"""WITH {GROUPS} SELECT count(*) AS n_groups, CAST(coalesce(sum(n_files), 0) AS BIGINT) AS total_duplicate_files, CAST(coalesce(sum(wasted_space), 0) AS BIGINT) AS total_wasted_space,
    CAST(coalesce(sum(wasted_space) FILTER (WHERE is_cross_directory), 0) AS BIGINT) AS cross_directory_wasted_space,
    CAST(coalesce(sum(wasted_space) FILTER (WHERE NOT is_cross_directory), 0) AS BIGINT) AS intra_directory_wasted_space FROM dup""")
def exact_summary(spark, sf_dir):
    return exact.exact_summary(exact.duplicate_hashes(hashed(spark, sf_dir)))


@query(f"""WITH {MEMBERS} SELECT content_hash, path, mtime, n_files, wasted_space, is_cross_directory,
    CAST(row_number() OVER (PARTITION BY content_hash ORDER BY mtime, path) AS INTEGER) AS rank FROM members""")
def exact_members_ranked(spark, sf_dir):
    return exact.duplicate_members(hashed(spark, sf_dir)).select("content_hash", "path", "mtime", "n_files", "wasted_space", "is_cross_directory", "rank")


@query(f"WITH {GROUPS} SELECT path, size, extension FROM files WHERE content_hash NOT IN (SELECT content_hash FROM dup)")
def exclude_exact(spark, sf_dir):
    return exact.without_duplicates(hashed(spark, sf_dir)).select("path", "size", "extension")


@query(f"WITH {GROUPS} SELECT content_hash, size, n_files, wasted_space, is_cross_directory FROM dup")
def streaming_exact(spark, sf_dir):
    """The documents as a stream of files, merged into a state batch by batch."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/documents.parquet").schema).parquet(stream_folder(sf_dir))
    files = stream.select(F.octet_length("text").cast("bigint").alias("size"), F.concat(F.lit("/"), "source").alias("source_root"), F.sha2("text", 256).alias("content_hash"))
    run = streaming.StreamingDedupe(spark, shared_path(spark, "stream"))
    run.run(files)
    return run.groups()


def stream_folder(sf_dir: str) -> str:
    """A stream's source is a folder or a pattern; a table may be a file or a folder of files."""
    return f"{sf_dir}/documents.parq*"


# Keep rules and plans

KEEP_ORDER = {
    "mtime_newest": "mtime DESC", "mtime_oldest": "mtime", "depth_shallowest": "depth", "path_shortest": "length(path)",
    "name_pattern": "(contains(lower(name), '1') OR contains(lower(name), '7')) DESC, mtime DESC",
    "prefer_dir": "(lower(source_root) = '/src1' OR starts_with(lower(path), '/src1')) DESC, mtime DESC",
}


def keep_query(rule: str):
    def run(spark, sf_dir):
        members = exact.duplicate_members(hashed(spark, sf_dir))
        kept = cleanup.kept_files(members, CleanupOptions(rule, "/src1", ("1", "7")))
        return kept.select("content_hash", "path", "mtime", "depth")

    run.__name__ = f"keep_{rule}"
    query(f"""WITH {MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY {KEEP_ORDER[rule]}, path) AS k FROM members)
        SELECT content_hash, path, mtime, depth FROM r WHERE k = 1""")(run)


for _rule in KEEP_ORDER:
    keep_query(_rule)

PLAN = f"""{MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY mtime DESC, path) AS k FROM members),
    plan AS (SELECT content_hash, first_value(path) OVER (PARTITION BY content_hash ORDER BY k) AS keep_path, path, size, k FROM r)"""


@query(f"WITH {PLAN} SELECT content_hash, keep_path, path, size FROM plan WHERE k > 1")
def cleanup_plan(spark, sf_dir):
    return cleanup.cleanup_plan(exact.duplicate_members(hashed(spark, sf_dir)))


@query(f"WITH {PLAN} SELECT content_hash, keep_path, count(*) - 1 AS n_delete, CAST(sum(size) - max(size) AS BIGINT) AS recoverable_space FROM plan GROUP BY ALL")
def cleanup_plan_groups(spark, sf_dir):
    return cleanup.plan_groups(exact.duplicate_members(hashed(spark, sf_dir)))


@query(f"WITH {PLAN} SELECT count(*) AS deleted_count, CAST(sum(size) AS BIGINT) AS recovered_space FROM plan WHERE k > 1")
def cleanup_dry_run_totals(spark, sf_dir):
    return cleanup.plan_totals(cleanup.execute(cleanup.cleanup_plan(exact.duplicate_members(hashed(spark, sf_dir)))))


# Bands, blocks and pairs


def bands_sql(tolerance: str, files: str = "files") -> str:
    return f"""anchors(a) AS (SELECT min(size) FROM {files} UNION ALL
        SELECT (SELECT min(size) FROM {files} WHERE CAST(size AS DOUBLE) > a * CAST({tolerance} AS DOUBLE)) FROM anchors WHERE a IS NOT NULL),
    banded AS (SELECT *, (SELECT max(a) FROM anchors WHERE a <= size) AS band FROM {files})"""


@query(f"WITH RECURSIVE {FILES}, {bands_sql('1.2')} SELECT path, size, band FROM banded")
def size_bands_20(spark, sf_dir):
    return banding.with_bands(documents(spark, sf_dir), 0.2).select("path", "size", "band")


@query(f"WITH RECURSIVE {FILES}, {bands_sql('1.3')} SELECT path, size, band FROM banded")
def size_bands_30(spark, sf_dir):
    return banding.with_bands(documents(spark, sf_dir), 0.3).select("path", "size", "band")


@query(f"""WITH RECURSIVE {FILES}, {bands_sql('1.2')} SELECT band, extension, count(*) AS n_files, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_pairs FROM banded GROUP BY ALL""")
def candidate_pairs_count(spark, sf_dir):
    return near.pair_counts(banding.with_bands(documents(spark, sf_dir), 0.2), ["band", "extension"])


@query(f"""WITH RECURSIVE {FILES}, {bands_sql('1.3')} SELECT band, count(*) AS n_files, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_pairs FROM banded GROUP BY ALL""")
def media_pairs_count(spark, sf_dir):
    return near.pair_counts(banding.with_bands(documents(spark, sf_dir), 0.3), ["band"])


JACCARD = r"""words AS (SELECT path, band, extension, text, list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x <> '')) AS w FROM banded),
    pairing AS (SELECT a.path AS file1, b.path AS file2, a.text AS x, b.text AS y, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS n, len(b.w) AS m
             FROM words a JOIN words b ON a.band = b.band AND a.extension = b.extension AND a.path < b.path
             WHERE least(len(a.w), len(b.w)) >= 0.62 * greatest(len(a.w), len(b.w))),
    scored AS (SELECT *, CASE WHEN n + m = 0 THEN 1.0 ELSE CAST(c AS DOUBLE) / greatest(n + m - c, 1) END AS words FROM pairing)"""


@query(f"WITH RECURSIVE {FILES}, {bands_sql('1.2')}, {JACCARD} SELECT file1, file2, round(words, 6) AS words FROM scored WHERE words >= 0.625 - 1e-9")
def word_jaccard_pairs(spark, sf_dir):
    d = banding.with_bands(corpus.documents_as_files(spark, sf_dir, True), 0.2)
    return near.text_candidates(d, 0.85).select("file1", "file2", F.round("words", 6).alias("words"))


# The SQL engine measures edit distances in bytes: the letters beyond ASCII that the documents have become control characters first.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
CONTROLS = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32)][: len(LETTERS)])
REST = f"""{GROUPS}, rest AS (SELECT * FROM files WHERE content_hash NOT IN (SELECT content_hash FROM dup))"""
NEAR = rf"""{REST}, {bands_sql('1.2', 'rest')}, {JACCARD},
    flat AS (SELECT file1, file2, words, translate(trim(regexp_replace(x, '\s+', ' ', 'g')), '{LETTERS}', {CONTROLS}) AS x, translate(trim(regexp_replace(y, '\s+', ' ', 'g')), '{LETTERS}', {CONTROLS}) AS y FROM scored WHERE words >= 0.625 - 1e-9),
    near AS (SELECT file1, file2, 0.6 * (1 - CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y))) + 0.4 * words AS similarity FROM flat),
    pairs AS (SELECT * FROM near WHERE similarity >= 0.85 - 1e-9)"""
REACH = f"""{NEAR}, edges AS (SELECT file1 AS a, file2 AS b FROM pairs UNION SELECT file2, file1 FROM pairs),
    reach AS (SELECT a AS path, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.path),
    labels AS (SELECT path, min(root) AS group_root FROM reach GROUP BY path),
    ends AS (SELECT file1 AS path, similarity FROM pairs UNION ALL SELECT file2, similarity FROM pairs),
    best AS (SELECT path, max(similarity) AS best FROM ends GROUP BY path),
    edge AS (SELECT group_root, avg(similarity) AS edge FROM pairs JOIN labels ON path = file1 GROUP BY group_root),
    sized AS (SELECT group_root, count(*) AS n_files FROM labels GROUP BY group_root)"""


def document_pairs(spark, sf_dir):
    """As in a run: without the members of exact groups; the extensions are those that the table has."""
    left = exact.without_duplicates(corpus.documents_as_files(spark, sf_dir, True).withColumn("content_hash", F.sha2("text", 256)))
    extensions = tuple(r.extension for r in documents(spark, sf_dir).select("extension").distinct().collect() if r.extension)
    return near.text_pairs(left, NearOptions(text_extensions=extensions))


def document_members(spark, sf_dir):
    return near.near_members(materialise(document_pairs(spark, sf_dir), "near-pairs"), "text")


@query(f"WITH RECURSIVE {NEAR} SELECT file1, file2, round(similarity, 6) AS similarity, 'combined' AS algorithm FROM pairs")
def near_text_pairs(spark, sf_dir):
    return document_pairs(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {REACH} SELECT group_root, 'text' AS type, path, CAST(1.0 AS DOUBLE) AS similarity, round(best, 6) AS max_edge_similarity, n_files, round(edge, 6) AS avg_edge_similarity
    FROM labels JOIN best USING (path) JOIN edge USING (group_root) JOIN sized USING (group_root)""")
def near_text_groups(spark, sf_dir):
    return document_members(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("max_edge_similarity", "avg_edge_similarity")})


@query(f"WITH RECURSIVE {REACH} SELECT 'text' AS type, count(DISTINCT group_root) AS n_groups, count(*) AS n_files FROM labels HAVING count(*) > 0")
def near_summary(spark, sf_dir):
    return near.near_summary(document_members(spark, sf_dir))


@query(f"""WITH RECURSIVE {REACH} SELECT 'text-' || row_number() OVER (ORDER BY group_root) AS id, 'text' AS type, string_agg(path, ' ' ORDER BY path) AS paths, count(*) AS n_files,
    CAST(1.0 AS DOUBLE) AS avg_similarity, round(min(edge), 6) AS avg_edge_similarity FROM labels JOIN edge USING (group_root) GROUP BY group_root""")
def near_groups(spark, sf_dir):
    found = near.near_groups(document_members(spark, sf_dir), documents(spark, sf_dir))
    paths_ = F.array_join(F.transform("files", lambda f: f["path"]), " ")
    return found.select("id", "type", paths_.alias("paths"), F.size("files").cast("bigint").alias("n_files"), "avg_similarity", F.round("avg_edge_similarity", 6).alias("avg_edge_similarity"))


# Hash cache

CACHE = f"""{FILES}, cache AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size, mtime, content_hash FROM files WHERE doc_id % 10 <> 0),
    found AS (SELECT f.path, f.size, f.mtime, c.path IS NOT NULL AS hit, f.content_hash FROM files f LEFT JOIN cache c ON f.path = c.path AND f.size = c.size AND f.mtime = c.mtime)"""


def cache_lookup(spark, sf_dir):
    d = corpus.documents_as_files(spark, sf_dir, True).withColumnRenamed("mtime", "mtime_ms")
    old = hashed(spark, sf_dir).where("doc_id % 10 <> 0")
    none = F.lit(None).cast("string")
    entries = old.select(
        "path", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", "content_hash", none.alias("approximate_fingerprint"),
        none.alias("media_fingerprint"), F.lit(0).cast("bigint").alias("indexed_at"),
    )
    return entries, incremental.hashed(incremental.lookup(d, entries), "text")


@query(f"WITH {CACHE} SELECT path, size, hit, content_hash FROM found")
def index_incremental(spark, sf_dir):
    return cache_lookup(spark, sf_dir)[1].select("path", "size", "hit", "content_hash")


@query(f"WITH {CACHE} SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM found")
def index_hit_counts(spark, sf_dir):
    return incremental.hit_counts(cache_lookup(spark, sf_dir)[1])


@query(f"WITH {FILES} SELECT path, size, mtime, content_hash, CAST(1000 AS BIGINT) AS indexed_at FROM files")
def index_merged(spark, sf_dir):
    entries, done = cache_lookup(spark, sf_dir)
    return incremental.merged(entries, done, 1000).select("path", "size", "mtime", "content_hash", "indexed_at")


# Fingerprints


def grids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("g"), "label")


GRID = "grid AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS g FROM embeddings)"


@query(f"""WITH {GRID} SELECT vec_id, array_to_string(list_transform(g, lambda x: CASE WHEN x >= list_sum(g) / len(g) THEN '1' ELSE '0' END), '') AS bits FROM grid""")
def ahash_bits(spark, sf_dir):
    return grids(spark, sf_dir).select("vec_id", bits.average_hash(F.col("g")).alias("bits"))


DHASH = f"""{GRID}, dh AS (SELECT vec_id, array_to_string(list_transform(list_filter(range(0, 64), lambda i: i % 8 < 7), lambda i: CASE WHEN g[i + 1] < g[i + 2] THEN '1' ELSE '0' END), '') AS bits FROM grid)"""


@query(f"WITH {DHASH} SELECT vec_id, bits FROM dh")
def dhash_bits(spark, sf_dir):
    return grids(spark, sf_dir).select("vec_id", bits.difference_hash(F.col("g"), 8, 8).alias("bits"))


@query(f"""WITH {DHASH}, q AS (SELECT * FROM dh WHERE vec_id % 50 = 0)
    SELECT q.vec_id AS query_id, dh.vec_id AS vec_id, CAST(hamming(q.bits, dh.bits) AS INTEGER) AS distance,
           round(1 - hamming(q.bits, dh.bits) / 56.0, 6) AS similarity FROM q JOIN dh ON q.vec_id <> dh.vec_id AND hamming(q.bits, dh.bits) <= 20""")
def hash_hamming_pairs(spark, sf_dir):
    """Every fiftieth image against all, those whose hashes of 56 bits differ in 20 at most."""
    d = grids(spark, sf_dir).select(F.col("vec_id").alias("id"), bits.packed(F.rpad(bits.difference_hash(F.col("g"), 8, 8), 64, "0")).alias("packed"))
    q = d.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("packed").alias("query"))
    found = near.hamming_search(q, d, 20).where("query_id <> id").withColumnRenamed("id", "vec_id")
    return found.withColumn("similarity", F.round(1 - F.col("distance") / 56.0, 6))


IMAGE = f"""{GRID}, im AS (SELECT vec_id, '.x' || label AS extension, array_to_string(list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) >= list_sum(g) / len(g) THEN '1' ELSE '0' END), '') AS bits,
    128 + 50 * g[1] AS r, 128 + 50 * g[2] AS gr, 128 + 50 * g[3] AS b, abs(g[4]) / 4 AS v FROM grid JOIN embeddings USING (vec_id))"""


@query(f"""WITH {IMAGE}, n AS (SELECT least(CAST(x.vec_id AS VARCHAR), CAST(y.vec_id AS VARCHAR)) AS file1, greatest(CAST(x.vec_id AS VARCHAR), CAST(y.vec_id AS VARCHAR)) AS file2,
        sqrt((x.r - y.r) * (x.r - y.r) + (x.gr - y.gr) * (x.gr - y.gr) + (x.b - y.b) * (x.b - y.b)) / 441.67 AS far, x.v, y.v AS w, hamming(x.bits, y.bits) / 64.0 AS h
        FROM im x JOIN im y ON x.extension = y.extension AND x.vec_id < y.vec_id),
    m AS (SELECT *, greatest(0.1, greatest(v, w) / 0.05 * 0.5) AS k FROM n),
    t AS (SELECT file1, file2, far, CASE WHEN v < 0.02 AND w < 0.02 THEN 1 - far WHEN v < 0.05 OR w < 0.05 THEN least((1 - h) * k + (1 - far) * (1 - k), 1 - far + 0.1)
          ELSE 0.6 * (1 - h) + 0.4 * (1 - far) END AS s FROM m),
    u AS (SELECT file1, file2, greatest(0, least(1, CASE WHEN far > 0.2 THEN least(s, 1 - 0.8 * far) ELSE s END)) AS similarity FROM t)
    SELECT file1, file2, round(similarity, 6) AS similarity, 'combined' AS algorithm FROM u WHERE similarity >= 0.7""")
def image_pairs(spark, sf_dir):
    """Grids as images, with hashes of 64 bits and colours from their values; the label is the extension."""
    g = F.col("g")
    s = F.struct((128 + 50 * g[0]).alias("r"), (128 + 50 * g[1]).alias("g"), (128 + 50 * g[2]).alias("b"), (F.abs(g[3]) / 4).alias("variance"))
    d = grids(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), F.concat(F.lit(".x"), "label").alias("extension"), bits.average_hash(g).alias("hash"), s.alias("signature"))
    return near.image_pairs(d, 0.7).withColumn("similarity", F.round("similarity", 6))


def media_query(kind: str, odd: int):
    def run(spark, sf_dir):
        mark = bits.video_fingerprint(F.array(bits.difference_hash(F.col("g"), 8, 8)), F.lit(5))
        kinds = F.when(F.col("label") % 2 == 0, "video").otherwise("audio")
        d = grids(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), (1000 + F.col("vec_id") * 7919 % 5003).alias("size"), kinds.alias("media_type"), mark.alias("media_fingerprint"))
        return near.media_pairs(d, kind, 0.65).withColumn("similarity", F.round("similarity", 6))

    run.__name__ = f"{kind}_pairs"
    query(f"""WITH RECURSIVE {DHASH}, files AS (SELECT CAST(vec_id AS VARCHAR) AS path, 1000 + vec_id * 7919 % 5003 AS size, bits FROM dh JOIN embeddings USING (vec_id) WHERE label % 2 = {odd}), {bands_sql('1.3')},
        n AS (SELECT x.path AS file1, y.path AS file2, 1 - hamming(x.bits, y.bits) / 56.0 AS similarity FROM banded x JOIN banded y ON x.band = y.band AND x.path < y.path)
        SELECT file1, file2, round(similarity, 6) AS similarity, '{kind}-fingerprint' AS algorithm, '{kind}' AS media_type FROM n WHERE similarity >= 0.65""")(run)


for _kind, _odd in (("video", 0), ("audio", 1)):
    media_query(_kind, _odd)


@query(f"""WITH {DHASH}, f AS (SELECT vec_id, bits, 'v1:5:' || bits || ':' || substring(sha256(bits), 1, 16) AS mark FROM dh),
    n AS (SELECT a.vec_id, a.mark, hamming(a.bits, b.bits) AS d FROM f a JOIN f b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, mark, round(1 - d / 56.0, 6) AS similarity FROM n""")
def media_fingerprint_neighbours(spark, sf_dir):
    d = grids(spark, sf_dir).select("vec_id", bits.video_fingerprint(F.array(bits.difference_hash(F.col("g"), 8, 8)), F.lit(5)).alias("mark"))
    n = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("mark").alias("next"))
    return d.join(n, "vec_id").select("vec_id", "mark", F.round(bits.fingerprint_similarity(F.col("mark"), F.col("next")), 6).alias("similarity"))


@query(f"""WITH {GRID}, s AS (SELECT vec_id, 128 + 50 * g[1] AS r, 128 + 50 * g[2] AS gr, 128 + 50 * g[3] AS b, abs(g[4]) / 4 AS v FROM grid),
    n AS (SELECT x.vec_id, sqrt((x.r - y.r) * (x.r - y.r) + (x.gr - y.gr) * (x.gr - y.gr) + (x.b - y.b) * (x.b - y.b)) / 441.67 AS far, x.v, y.v AS w, (x.vec_id % 20) / 64.0 AS h FROM s x JOIN s y ON y.vec_id = x.vec_id + 1),
    m AS (SELECT *, greatest(0.1, greatest(v, w) / 0.05 * 0.5) AS k FROM n),
    t AS (SELECT vec_id, far, CASE WHEN v < 0.02 AND w < 0.02 THEN 1 - far WHEN v < 0.05 OR w < 0.05 THEN least((1 - h) * k + (1 - far) * (1 - k), 1 - far + 0.1)
          ELSE 0.6 * (1 - h) + 0.4 * (1 - far) END AS s FROM m)
    SELECT vec_id, round(far, 6) AS distance, round(greatest(0, least(1, CASE WHEN far > 0.2 THEN least(s, 1 - 0.8 * far) ELSE s END)), 6) AS similarity FROM t""")
def color_similarity_rules(spark, sf_dir):
    g = F.col("g")
    s = F.struct((128 + 50 * g[0]).alias("r"), (128 + 50 * g[1]).alias("g"), (128 + 50 * g[2]).alias("b"), (F.abs(g[3]) / 4).alias("variance"))
    d = grids(spark, sf_dir).select("vec_id", s.alias("s"))
    n = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"))
    near_by = color.image_similarity(F.col("vec_id") % 20, F.col("s"), F.col("t"))
    return d.join(n, "vec_id").select("vec_id", F.round(color.color_distance(F.col("s"), F.col("t")), 6).alias("distance"), F.round(near_by, 6).alias("similarity"))


@query("""WITH e AS (SELECT event_id // 1024 AS w, (event_id % 1024) // 16 AS b, sum(abs(trunc(value))) FILTER (WHERE event_id % 2 = 0) / 16 AS e, count(*) AS n FROM events GROUP BY ALL),
    f AS (SELECT w, b, e, avg(e) OVER (PARTITION BY w) AS m, sum(n) OVER (PARTITION BY w) AS n FROM e)
    SELECT w AS window_id, string_agg(CASE WHEN e >= m THEN '1' ELSE '0' END, '' ORDER BY b) AS bits FROM f WHERE n = 1024 GROUP BY w""")
def audio_energy_bits(spark, sf_dir):
    """Events as samples: the windows of 1024 that are whole."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.floor(F.abs("value")).alias("v"))
    w = e.groupBy(F.floor(F.col("event_id") / audio.WINDOW).alias("window_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "v"))).alias("s"))
    return w.where(F.size("s") == audio.WINDOW).select("window_id", audio.window_bits(F.transform("s", lambda x: x["v"])).alias("bits"))


@query("""WITH d AS (SELECT vec_id, (vec_id % 200) / 10.0 AS duration FROM embeddings), n AS (SELECT *, least(5, greatest(1, CAST(floor(duration / 2) AS INTEGER))) AS n FROM d)
    SELECT vec_id, CAST(i AS INTEGER) AS nth, round(CAST(duration AS DOUBLE) / (n + 1) * i, 6) AS seconds FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n)""")
def frame_schedule(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", ((F.col("vec_id") % 200) / 10.0).alias("duration"))
    times = v.select("vec_id", F.posexplode(bits.frame_schedule(F.col("duration"))).alias("nth", "seconds"))
    return times.select("vec_id", (F.col("nth") + 1).alias("nth"), F.round("seconds", 6).alias("seconds"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS n,
        list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x <> '')) AS w FROM documents)
    SELECT doc_id, sha256(n) AS normalised, CAST(len(w) AS INTEGER) AS n_words, array_to_string(list_sort(w), ' ') AS words FROM t""")
def text_normalise_words(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = text.word_set(F.col("text"))
    return d.select("doc_id", F.sha2(text.normalise(F.col("text")), 256).alias("normalised"), F.size(w).alias("n_words"), F.array_join(F.array_sort(w), " ").alias("words"))


@query()
def audio_fingerprints(spark, sf_dir):
    """Events as 16-bit samples; each TRACK event ids in a row are a track."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = e.groupBy(F.floor(F.col("event_id") / TRACK).alias("track")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("value").cast("smallint").alias("v")))).alias("s"))
    return s.select("track", audio.audio_fingerprint(F.transform("s", lambda x: x["v"])).alias("mark"))


@query()
def report_json(spark, sf_dir):
    """All groups, as a JSON report has them; ranked by ranges of the order, so no task has all of them."""
    order = (F.desc("wasted_space"), F.asc("content_hash"))
    groups = exact.exact_groups(hashed(spark, sf_dir)).repartitionByRange(64, *order).withColumn("part", F.spark_partition_id())
    groups = materialise(groups, "report-groups")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    json = F.to_json(F.struct("content_hash", "size", "n_files", "wasted_space", "is_cross_directory", "files"))
    return groups.join(F.broadcast(starts), "part").select(rank.alias("rank"), json.alias("json"))
