"""Queries over the given tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tallyshelf.llm import exact_dedup, importance, language, mixing, near_dedup, norm_search, packing, personal_data, quality, repeats, secret_scan, toxicity, whitening
from tallyshelf.llm.common import held_out

QUERIES = {"pipeline": corpus_pipeline.run}
ORACLES = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates among all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op2_norm_bucketed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest inner products for every vector whose id is divisible by 20."""
    return norm_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


ORACLES["op2_norm_bucketed_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled rows that are not held out."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.toxicity(docs, labels, held_out(F.col("doc_id"), 4, 2), at_least=0.3)


@query
def op4_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op4_chunk_recipes"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("found")


@query
def op7_weak_labels_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data.scan(table(spark, sf_dir, "documents")).drop("found")


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' weights; documents of known good quality are drawn earlier, of bad later."""
    return mixing.mix(mixing.weighed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLES["op8_source_mix"] = r"""
WITH w AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(sha256('mix' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key
  FROM documents LEFT JOIN w USING (doc_id)
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
),
b AS (
  SELECT *, 3 * source_size / weight AS bound,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (
  SELECT source, source_size, round(least(weight * (SELECT level FROM b WHERE level <= bound ORDER BY bound, source LIMIT 1), 3 * source_size), 6) AS target FROM b
),
c AS (
  SELECT doc_id, size, source_size, target, least(floor(floor(target) / greatest(source_size, 1)), 3) AS epochs,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t USING (source)
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM c
"""


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 400 bytes that occur twice."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query
def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from rows with a language that are not held out."""
    return language.identify(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 3, 1))


@query
def op11_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their 32 leading components, with unit variance."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), 32)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labelled rows that are not held out."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.quality(docs, labels, held_out(F.col("doc_id"), 3, 1), at_least=0.5)


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed and, for the best twentieth, ranked by their likeness to the benchmark."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
