"""Registered queries of the corpus operators, one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (
    alignment, digests, language, masked_lm, mixing, packing, periodic, quality, simhash, token_prefix, toxicity, vptree, warc,
)
from sightline.llm.common import crc_mod, read_table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_with_next(read_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: Quotients of all sources are listed and ranked; shard quotas and circular runs follow in arithmetic.
OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM src
), levels AS (
  SELECT *, most / weight AS ratio,
    ((SELECT sum(size) FROM sized)::DOUBLE - coalesce(sum(most) OVER before, 0))
      / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, rank, source_size,
    least(most, weight * coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio), 0)) AS target,
    ceil(source_size / {mixing.BLOCK}::DOUBLE)::BIGINT AS blocks
  FROM weighed
), claims AS (
  SELECT rank, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank, k) AS place
  FROM targets, LATERAL (SELECT unnest(generate_series(1, 3 * blocks)) AS k)
  WHERE target > 0
), won AS (
  SELECT rank, count(*) AS quota FROM claims
  WHERE place <= (SELECT round_even(sum(size) / {mixing.BLOCK}::DOUBLE, 0) FROM sized) GROUP BY rank
), plan AS (
  SELECT t.*, coalesce(quota, 0) AS quota,
    ((rank * 7919 + {mixing.SEED}) * 2654435761) % 4294967296 % greatest(blocks, 1) AS first_block
  FROM targets t LEFT JOIN won USING (rank)
), placed AS (
  SELECT d.doc_id, d.size, p.*,
    coalesce(sum(d.size) OVER (PARTITION BY p.rank ORDER BY md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), runs AS (
  SELECT *, a + size AS b, first_block * {mixing.BLOCK} AS run_a, (first_block + quota % greatest(blocks, 1)) AS run_end FROM placed
)
SELECT doc_id, size, source_size, target,
  ((quota // greatest(blocks, 1)) * size
    + greatest(0, least(b, least(least(run_end, blocks) * {mixing.BLOCK}, source_size)) - greatest(a, run_a))
    + greatest(0, least(b, (run_end - blocks) * {mixing.BLOCK}) - a))::BIGINT AS taken
FROM runs
"""

def _label(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select("doc_id", F.col(name).alias("label"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit(docs, _label(spark, sf_dir, "toxic"), crc_mod("doc_id", 4) != 2)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.fit(docs, _label(spark, sf_dir, "quality"), crc_mod("doc_id", 5) != 0)


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(read_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scores.select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score(read_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scores.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = masked_lm.encoded(read_table(spark, sf_dir, "documents"))
    return masked_lm.score_words(words, masked_lm.train_words(words))


def op7_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefix.token_counts(read_table(spark, sf_dir, "documents"))


def op9_language_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"), crc_mod("doc_id", 5) != 0)
    found = language.predict(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = f"""
WITH v AS (
  SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {vptree.NEIGHBOURS}
"""


def op11_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(read_table(spark, sf_dir, "documents"), repeat_tails=True)


def op13_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


OP13_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), l AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p
), t AS (
  SELECT *, payload_bytes >= {warc.LEAST_SHARED} AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM l
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN last END AS refers_to
FROM t
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_simhash_near_dedup, op3_source_mixing, op4_toxicity_grammar,
        op5_quality_compression, op6_masked_pseudo_likelihood, op7_best_two_fit_packing,
        op8_prefix_token_counts, op9_language_unigrams, op10_vantage_point_trees,
        op11_fragment_alignment, op12_periodic_runs, op13_warc_normaliser,
    )
}

ORACLE: dict[str, str] = {"op3_source_mixing": OP3_SQL, "op10_vantage_point_trees": OP10_SQL, "op13_warc_normaliser": OP13_SQL}
