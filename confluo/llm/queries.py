"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import ready
from . import kernel as K
from . import language_id, toxicity
from .alignment import align_tokens
from .centroids import cluster
from .decontaminate import find_contamination
from .exact_dedup import exact_duplicates
from .html_extract import extract_pages
from .line_dedup import dedup_lines
from .media_copies import image_copies, picture
from .minhash_dedup import near_duplicates
from .packing import pack_documents
from .sharding import shuffle_into_shards
from .substring_dedup import dedup_substrings


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_documents(spark, sf_dir))
    kept = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\n+", "\n"), "^\n|\n$", "")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer_path(), capacity=2048, end_id=0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    docs = _documents(spark, sf_dir).select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(docs, shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = language_id.fold("doc_id", 4) == 2
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), held_out=held)
    out = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), toxicity.scores(model, F.col("text")).alias("found"))
    return out.select("doc_id", "held_out", "found.score", (F.col("found.score") >= 0.3).cast("int").alias("predicted"), F.size("found.spans").alias("n_offending"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = language_id.fold("doc_id", 5) == 0
    model = language_id.fit(docs, held_out=F.coalesce(held, F.lit(True)))
    out = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), language_id.labels(model, F.col("text")).alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", F.size("found.spans").alias("n_spans"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op4_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images; the pictures are drawn from the vectors of ``embeddings``."""
    rows = ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return image_copies(rows, id_col="vec_id", image=F.arrow_udf(K.lean_column(picture), "binary")("embedding"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), width=5, percent=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_tokens(_documents(spark, sf_dir), a, b, digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dims=64, scale=64)


def _clustering_sql(k: int, rounds: int, dims: int, scale: int) -> str:
    parts = [f"""
v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT (row_number() OVER (ORDER BY h))::INT - 1 AS cluster, v AS c FROM (
    SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {k})
)"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS (
  SELECT rid, (min({{'d': d, 'k': cluster}}))['d'] AS distance, (min({{'d': d, 'k': cluster}}))['k'] AS cluster
  FROM (SELECT rid, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r})
  GROUP BY rid
)""")
        if r < rounds:
            parts.append(f"""
s{r} AS (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS i FROM v JOIN a{r} USING (rid)) GROUP BY cluster, i
), m{r} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster
), c{r + 1} AS (
  SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster)
)""")
    return f"""
WITH {','.join(parts)}
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (rid) JOIN c{rounds} c ON a.cluster = c.cluster
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op10_sharding": op10_sharding,
    "op3_toxicity": op3_toxicity,
    "op6_language_id": op6_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op4_media_copies": op4_media_copies,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op12_centroid_clustering": _clustering_sql(16, 3, 64, 64),
    "op13_exact_dedup": r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
""",
    "op2_line_dedup": """
WITH lines AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents
), placed AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM lines
), windows AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n
    FROM windows WHERE c IS NOT NULL
  ) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(3) AS r(k)
), kept AS (
  SELECT p.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
}
