"""Queries of the corpus operators, by name, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact_dedup, lm, mixing, near_dedup, packing, pii, quality, secrets, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_pack_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_lm_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = secrets.train(secrets.labelled_samples(spark, docs))
    return secrets.digest(secrets.scan(docs, model))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_nearest": op2_nearest,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_pack_sequences": op5_pack_sequences,
    "op6_lm_score": op6_lm_score,
    "op7_mix_sources": op7_mix_sources,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL = {
    "op1_warc_round_trip": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS best,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1) for i in range(32)], '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM b""",
    "op8_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op9_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS words FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]) END AS grams FROM w
), n AS (SELECT doc_id, len(grams) AS n_shingles FROM g),
s AS (SELECT doc_id, unnest(grams) AS gram FROM g),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n_shingles + b.n_shingles - common)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.doc_id = n.doc_id""",
}
