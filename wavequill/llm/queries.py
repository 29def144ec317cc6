"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import warc
from ._common import Scratch, table
from .ann import search
from .jaccard import similar_classes
from .licenses import scan
from .media import media_digests
from .mixing import mix, mix_sql
from .packing import pack
from .quality import quality
from .tokens import count_tokens
from .toxicity import severity

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = similar_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "n_links")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))[0]


def op7_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").path("archive")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_additive_quantisation": op1_additive_quantisation,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_media_chunks": op6_media_chunks,
    "op7_warc_shards": op7_warc_shards,
    "op8_mix_sources": op8_mix_sources,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_crf": op10_quality_crf,
    "pipeline": pipeline,
}
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS head, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS place FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND place > 1 THEN head END AS refers_to
FROM f
"""

ORACLE_SQL: dict[str, str] = {"op7_warc_shards": WARC_SQL, "op8_mix_sources": mix_sql()}
