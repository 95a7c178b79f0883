"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, best_fit, disclosure, fertility, hilbert_pack, histogram_sort, latent, line_chunks, ownership, simhash, url_bloom, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_digest(_table(spark, sf_dir, "documents"))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(_table(spark, sf_dir, "documents"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shards_digest(_table(spark, sf_dir, "documents"))


def op4_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return latent.contaminated(docs, _table(spark, sf_dir, "benchmark"))


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.personal_digest(_table(spark, sf_dir, "documents"))


def op6_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.secrets_digest(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_digest(_table(spark, sf_dir, "documents"))


def op8_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_bloom.urls_digest(_table(spark, sf_dir, "pages"))


def op9_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pieces_digest(_table(spark, sf_dir, "documents"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.passages_digest(_table(spark, sf_dir, "documents"))


def op11_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_digest(_table(spark, sf_dir, "embeddings"))


def op12_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archives_digest(_table(spark, sf_dir, "pages"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_fertility, op2_best_fit, op3_histogram_sort, op4_latent, op5_disclosure, op6_ownership, op7_simhash, op8_url_bloom, op9_hilbert_pack, op10_line_chunks, op11_lanczos, op12_revisits, op13_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_bloom": url_bloom.DIGEST_SQL, "op10_line_chunks": line_chunks.DIGEST_SQL}
