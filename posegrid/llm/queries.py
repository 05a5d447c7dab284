"""The registered queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, infill, language_id, language_model, main_text, minhash, neighbours, packing, paragraphs, pieces, pii, ranked_search, suffix_dedup
from .common import crc_mod, documents


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; it is an input of the operators, not part of this repository."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.fit(docs.filter(~held_out).select("text", "lang", F.col("doc_id").alias("pick")))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_decode(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "n_chars", "n_tokens", "ids_sha256", "round_trip")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir), crc_mod("doc_id", 7) != 2, tokenizer_file("piece_bpe_32k.model"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build(documents(spark, sf_dir))
    return ranked_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_fingerprints, op3_suffix_dedup, op4_sentencepiece, op5_minhash, op6_pii, op7_neighbours, op8_paragraph_dedup, op9_packing, op10_lattice, op11_infill, op12_ranked_search, op13_main_text)}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator over whole tables; tests hold the others against brute force."""
    return {"op11_infill": infill.digest_sql("documents"), "op12_ranked_search": ranked_search.search_sql("documents", "benchmark")}
