"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Each stage gets all that the one before kept, and returns the columns of documents; the last one
returns the packed pieces. Nothing but exact copies, near-duplicates, documents without an
identifiable language, repeated passages and personal data is taken out.
"""

from __future__ import annotations

import uuid

from posegrid.llm import language_id, minhash, packing, pii, suffix_dedup
from posegrid.llm.common import cut, shared_dir
from posegrid.llm.queries import tokenizer_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The least share of letters that the predicted language must have.
MIN_SCORE = 0.3
#: Bytes that a repeated passage has at least: fifty words of four letters and a blank. Its anchors are grams of ``GRAM`` bytes.
PASSAGE, GRAM = 250, 32


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language stay; those without a letter, or with no language above MIN_SCORE, go."""
    model = language_id.fit(docs.select("text", "lang", F.col("doc_id").alias("pick")))
    found = language_id.identify(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text"), model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest id; of repeats of it one, and ids come before none.

    Rows are numbered, and the numbered table is written, so that numbers don't change between readings.
    """
    rows = cut(docs.withColumn("_number", F.monotonically_increasing_id()))
    found = minhash.near_duplicates(rows.select(F.col("_number").alias("id"), "text")).select(F.col("id").alias("_number"), "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_number"))
    keep = found.join(rows.select("_number", "doc_id"), "_number").groupBy("component").agg(first.alias("first")).select(F.col("first._number").alias("_number"))
    return rows.join(keep, "_number", "left_semi").drop("_number")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages that stand more than once the first stays (smallest id, then place), the others are taken out of the texts; all documents stay."""
    return _counted(suffix_dedup.strip(docs, PASSAGE, GRAM, keep_first=True))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    found = pii.find_pii(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text"))
    return _counted(found.select(*[F.col("masked").alias(c) if c == "text" else F.col(f"_row.{c}").alias(c) for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed. Workers go on to other stages, so they keep a small memo of words."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), memo_words=150_000)


STAGES = [("language id", identify_language), ("near-dedup", drop_near_duplicates), ("suffix-array dedup", remove_repeats), ("pii", mask_personal_data), ("packing", pack)]

#: No stage can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
