"""Fill-in-middle transformation of whole texts by DuckDB, one Arrow batch at a time.

Each batch is registered as a table of an in-process DuckDB; its SQL cuts the texts into lines,
deals the lines to prefix, middle and suffix by a hash of the id, writes the training form and
rebuilds the text from it. No row passes through Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What DuckDB may hold for one batch; it has no folder to spill to.
MEMORY = "1GB"


def transform_sql(source: str, seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """DuckDB SQL over ``source`` (doc_id, text): the form of each text, its output and the text rebuilt from output and form.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of them suffix first. A null id counts as an empty one.
    """
    h = [f"('0x' || substr(digest, {8 * i + 1}, 8))::BIGINT" for i in range(4)]
    # after the first marker each output is two parts with one marker between and <M> before the last
    parts = lambda second: f"string_split(substr(output, {len(PREFIX) + 1}), '{second}')"
    tail = lambda second: f"string_split({parts(second)}[2], '{MIDDLE}')"
    return f"""
    WITH hashed AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM {source}
    ), units AS (
      SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS unit, {h[0]} AS h1, {h[1]} AS h2, {h[2]} AS h3, {h[3]} AS h4 FROM hashed
    ), cuts AS (
      SELECT *, len(unit) AS n, least(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS a, greatest(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {rate} THEN 'plain'
             WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM units
    ), pieces AS (
      SELECT doc_id, text, n, form, array_to_string(list_slice(unit, 1, a), '') AS prefix, array_to_string(list_slice(unit, a + 1, b), '') AS middle,
        array_to_string(list_slice(unit, b + 1, n), '') AS suffix FROM cuts
    ), written AS (
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                  WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END AS output FROM pieces
    )
    SELECT doc_id, n::BIGINT AS n, form, prefix_chars::BIGINT AS prefix_chars, middle_chars::BIGINT AS middle_chars, output,
      CASE form WHEN 'psm' THEN {parts(SUFFIX)}[1] || {tail(SUFFIX)}[2] || {tail(SUFFIX)}[1]
                WHEN 'spm' THEN {tail(PREFIX)}[1] || {tail(PREFIX)}[2] || {parts(PREFIX)}[1] ELSE output END AS restored FROM written"""


def digest_sql(source: str, **settings: int) -> str:
    """The contract's columns, with hashes in place of output and rebuilt text."""
    return f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({transform_sql(source, **settings)})"


def _in_duckdb(docs: DataFrame, sql: str, schema: str) -> DataFrame:
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as db:
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                yield from db.sql(sql).to_arrow_table().to_batches()
                db.unregister("batch")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Each text of ``docs`` (doc_id, text) as a fill-in-middle example: doc_id, n (lines), form, prefix_chars, middle_chars, output, restored.

    One row per row, no shuffle; lines end behind their line feed. Null and empty texts, and texts
    that hold one of the three markers, stay as they are (``plain``, without counts); a null id
    hashes like an empty one, so all such rows are cut by the same numbers. Equal rows give equal
    rows, an empty table none; other columns aren't carried.
    """
    return _in_duckdb(docs, transform_sql("batch", seed, rate, spm), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; hashes are taken in DuckDB as well, so texts don't come back."""
    return _in_duckdb(docs, digest_sql("batch"), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
