"""Repeated passages across documents: MinHash banding tuned for recall, exact Jaccard, components.

Two kinds of units are compared:

- Paragraphs: lines with at least ``MIN_WORDS`` words, white space at their ends left out.
- Windows of ``WINDOW`` words, for passages inside or across lines. They start at anchors: of ``REACH`` shingles in a
  row the one with the least hash is an anchor, so any run of ``REACH`` - 1 + ``WINDOW`` = 51 equal words holds the
  same whole window in both documents. Windows are made only of anchors that stand elsewhere too, and not where they
  touch a line that stands elsewhere as a whole, which is found as a paragraph.

Shorter lines are no units: phrases that recur in clean documents are of that size (51 of 100 repeated lines of five
words or more have under twenty). Bands of two rows let through 99.9 of 100 pairs at the threshold; every link is
confirmed on the full shingle sets. Of each component the unit with the smallest (doc_id, place) stays, the others are removals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, leftmost_least, mix64, small_batches, text_blocks, utf8, words
from .minhash import DESCRIBED, describe, linked_classes
from .shingles import shingle_hashes, word_hashes
from .suffix_dedup import cut_out

BANDS, ROWS = 8, 2
MIN_WORDS = 20
WINDOW, REACH = 24, 28


def lines(data: np.ndarray, starts: np.ndarray, row: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each line with at least ``min_words`` words."""
    line = np.searchsorted(np.flatnonzero(data == 0x0A), starts)
    edge = np.flatnonzero((np.diff(line) != 0) | (np.diff(row) != 0))
    first, last = np.concatenate([[0], edge + 1]), np.append(edge, len(starts) - 1)
    keep = last - first + 1 >= min_words
    return first[keep], last[keep]


def anchors(hashes: np.ndarray, row: np.ndarray, rows: int, window: int = WINDOW, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each anchor that has a whole window of words behind it in its row."""
    grams, word, begin = shingle_hashes(hashes, row, rows)
    if len(grams) < reach:
        return word[:0], grams[:0]
    least = leftmost_least(grams, reach)
    of = np.searchsorted(begin, np.arange(len(least)), "right") - 1
    least = np.unique(least[np.arange(len(least)) + reach <= begin[of + 1]])
    end = np.cumsum(np.bincount(row, minlength=rows))
    least = least[word[least] + window <= end[row[word[least]]]]
    return word[least], grams[least]


def _marks(min_words: int, window: int, reach: int):
    """Hashes of all paragraphs and anchors with their places: (mark, doc_id, th, start, end, paragraph)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_blocks(batch.column("text")):
                starts, ends, row, hashes = word_hashes(data, offsets)
                if not len(starts):
                    continue
                first, last = lines(data, starts, row, min_words)
                # the words of all lines one after the other, each with its place in its line
                size = last - first + 1
                begin = np.cumsum(size) - size
                place = np.arange(size.sum()) - np.repeat(begin, size)
                marked = mix64(hashes[np.repeat(first, size) + place] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                whole = np.add.reduceat(marked, begin) if len(begin) else marked
                word, grams = anchors(hashes, row, to - at, window, reach)
                a, b = np.concatenate([first, word]), np.concatenate([last, word + window - 1])
                origin = offsets[row[a]]
                take = pa.array(row[a])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([mix64(whole), grams]).view(np.int64)), batch.column("doc_id").slice(at, to - at).take(take), batch.column("th").slice(at, to - at).take(take),
                        pa.array((starts[a] - origin).astype(np.int32)), pa.array((ends[b] - origin).astype(np.int32)), pa.array(np.arange(len(a)) < len(first)),
                    ],
                    ["mark", "doc_id", "th", "start", "end", "paragraph"],
                )

    return run


def _units(bands: int, rows: int, min_words: int):
    """Descriptions of each document's paragraphs, and of its windows at places that ``spots`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_blocks(batch.column("text")):
                starts, ends, row = words(data, offsets)
                if not len(starts):
                    continue
                first, last = lines(data, starts, row, min_words)
                place = set(zip(row[first].tolist(), starts[first].tolist(), ends[last].tolist(), strict=True))
                covered = np.zeros(len(data) + 1, bool)
                for i, spots in enumerate(batch.column("spots").slice(at, to - at).to_pylist()):
                    if not spots:
                        continue
                    begin = int(offsets[i])
                    for s in spots:
                        if s["paragraph"]:
                            covered[begin + s["start"] : begin + s["end"]] = True
                    windows = ((begin + s["start"], begin + s["end"]) for s in spots if not s["paragraph"])
                    place.update((i, s, e) for s, e in windows if not covered[s:e].any())
                if not place:
                    continue
                of, a, b = (np.array(c) for c in zip(*sorted(place), strict=True))
                texts = pa.array([data[s:e].tobytes() for s, e in zip(a.tolist(), b.tolist(), strict=True)], pa.large_binary())
                take = pa.array(of)
                units = [batch.column("doc_id").slice(at, to - at).take(take), batch.column("th").slice(at, to - at).take(take), pa.array((a - offsets[of]).astype(np.int32)), pa.array((b - offsets[of]).astype(np.int32))]
                yield from describe(pa.RecordBatch.from_arrays(units, ["doc_id", "th", "start", "end"]), texts, bands, rows)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        classes, texts = [], []
        for i, places in enumerate(batch.column("places").to_pylist()):
            classes += [p["class"] for p in places]
            texts += [data[offsets[i] + p["start"] : offsets[i] + p["end"]].tobytes().decode() for p in places]
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(texts, pa.string())], ["class", "text"])


def repeated_paragraphs(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, min_words: int = MIN_WORDS, window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """(doc_id, th, start, end, component_doc, component_start, kept) for each unit of ``docs`` (doc_id, text) that has a near-duplicate.

    start and end are UTF-8 bytes (end exclusive), th is the text's hash. A unit counts as repeated if its component
    reaches another document or a place of its own that it doesn't overlap. Null ids, null, empty and shorter
    texts give no rows; rows that repeat an id and text count once; rows that repeat an id with another text are apart.
    """
    small_batches(docs)
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    marks = cut(docs.mapInArrow(_marks(min_words, window, reach), "mark long, doc_id long, th long, start int, end int, paragraph boolean"))
    # written first, so that the join's sides are plain tables and Spark can split the partitions of very common marks
    shared = cut(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark"))
    spots = cut(marks.join(shared, "mark").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end", "paragraph")).alias("spots")))
    discard(marks, shared)
    spotted = docs.join(spots, ["doc_id", "th"], "left").dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "text", "spots")
    described = cut(spotted.mapInArrow(_units(bands, rows, min_words), f"doc_id long, th long, start int, end int, {DESCRIBED}"))
    discard(spots)

    def fetch(wanted: DataFrame) -> DataFrame:
        by_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("class", "start", "end")).alias("places"))
        return docs.join(by_doc, ["doc_id", "th"]).select("text", "places").mapInArrow(_read, "class long, text string").dropDuplicates(["class"])

    place = ["doc_id", "start", "th", "end"]
    classes, joined = linked_classes(described, place, fetch)
    component = classes.select("s1", "s2", "class", "n").join(joined, "class", "left").filter("n > 1 or component is not null").select("s1", "s2", F.coalesce("component", "class").alias("component"))
    units = cut(described.select("s1", "s2", *place).join(component, ["s1", "s2"]).select("component", *place))
    discard(described, classes, joined)
    doc = F.struct("doc_id", "th")
    found = units.groupBy("component").agg(F.min(F.struct(*place)).alias("least"), F.min(doc).alias("a"), F.max(doc).alias("b"), F.min("end").alias("end"), F.max("start").alias("start"))
    # written first, so that Spark can split the partition of a very large component when its units are joined
    found = cut(found.filter("a <> b or start >= end").select("component", "least"))
    own = F.struct(*place) == F.col("least")
    return units.join(found, "component").select("doc_id", "th", "start", "end", F.col("least.doc_id").alias("component_doc"), F.col("least.start").alias("component_start"), own.alias("kept"))


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with all removals taken out of ``text``: of each set of near-duplicate units one stays. Other columns and null texts pass through."""
    gone = repeated_paragraphs(docs).filter("not kept").groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("start", "end")).alias("_gone"))
    joined = docs.join(gone, (docs["doc_id"] == gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_th"]), "left")
    return joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(cut_out("text", "_gone"))).select(*docs.columns)


__all__ = ["anchors", "lines", "remove", "repeated_paragraphs"]
