"""Document fingerprints from prefix polynomial hashes, and how alike two of them are.

Any span's hash comes from two look-ups in the prefix arrays, so all overlapping grams of a text
cost one pass. A fingerprint holds the hash of the whole text and the least ``SKETCH`` gram hashes;
their agreement estimates the Jaccard likeness of the gram sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, small_batches
from .prefix_hash import PrefixHash

GRAM = 16
SKETCH = 64
LEAST_KEY = -(1 << 63)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def sketches(texts: list[str], gram: int = GRAM, size: int = SKETCH) -> list[tuple[int, np.ndarray]]:
    """(hash of the whole text, its least gram hashes in order) of each text; a text shorter than a gram is one gram."""
    codes, offsets = _codes(texts)
    prefix = PrefixHash(codes)
    length = np.diff(offsets)
    whole = mix64(prefix.spans(offsets[:-1], offsets[1:]) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64))
    many = np.where(length >= gram, length - gram + 1, np.minimum(length, 1))
    begin = np.concatenate([[0], np.cumsum(many)])
    start = np.repeat(offsets[:-1] - begin[:-1], many) + np.arange(begin[-1])
    end = start + np.repeat(np.minimum(length, gram), many)
    grams = (mix64(prefix.spans(start, end)) >> np.uint64(32)).astype(np.uint32)
    out = []
    for i in range(len(texts)):
        own = grams[begin[i] : begin[i + 1]]
        least = None
        if len(own) > 8 * size:
            # well over ``size`` of evenly spread values lie below this; if not, all are looked at
            least = np.unique(own[own < np.uint32(min(0xFFFFFFFF, (3 * size << 32) // len(own)))])
        if least is None or len(least) < size:
            least = np.unique(own)
        out.append((int(whole[i]), least[:size]))
    return out


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], size: int = SKETCH) -> float:
    """0 to 1: agreement among the least hashes of both; 1 for equal texts, 0 if one is empty."""
    if a[0] == b[0]:
        return 1.0
    if not len(a[1]) or not len(b[1]):
        return 0.0
    both = np.union1d(a[1], b[1])[:size]
    return float((np.isin(both, a[1], assume_unique=True) & np.isin(both, b[1], assume_unique=True)).sum() / len(both))


def written(sketch: tuple[int, np.ndarray]) -> str:
    return f"{sketch[0]:016x}:" + sketch[1].astype(">u4").tobytes().hex()


def edit(text: str, after: str) -> str:
    """The text with its last third replaced by the start of the next one."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in descending id; each bucket ends with a copy of the row that follows it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    held = None  # (bucket, doc_id, text, sketch)
    for batch in batches:
        buckets, ids, tails, texts = (batch.column(c).to_pylist() for c in ("bucket", "doc_id", "tail", "text"))
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 500_000):
                size += len(texts[to])
                to += 1
            rows = [] if held is None else [held]
            rows += [(buckets[i], ids[i], texts[i], s, tails[i]) for i, s in zip(range(at, to), sketches(texts[at:to]), strict=True)]
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[4]]
            edited = [edit(a[2], b[2]) for a, b in pairs]
            own = sketches(edited)
            # both texts lie in one array, so that extensions are compared in place
            codes, offsets = _codes([t for (a, _), e in zip(pairs, edited, strict=True) for t in (a[2], e)])
            common = PrefixHash(codes).common_extension(offsets[:-1:2], offsets[1::2], np.minimum(np.diff(offsets)[::2], np.diff(offsets)[1::2])) if pairs else []
            out = [
                (a[1], len(a[2]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), written(a[3]), written(s), likeness(a[3], s), likeness(a[3], b[3]), int(c))
                for (a, b), e, s, c in zip(pairs, edited, own, common, strict=True)
            ]
            held = rows[-1]
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"}), preserve_index=False)
            at = to


def _ranges(docs: DataFrame, buckets: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Keys at which a new range begins, and for each key that fills whole ranges the text hashes at which it is cut."""
    cuts = docs.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("q")).first()["q"] or []
    keys, many = np.unique(np.array(cuts, np.int64), return_counts=True)
    hot = {int(k): np.array([(j << 64) // int(n) - (1 << 63) for j in range(1, int(n))], np.int64) for k, n in zip(keys, many, strict=True) if n > 1}
    # a key that is cut has its own ranges, so another begins behind it
    return np.unique(np.concatenate([keys, np.array([k + 1 for k in hot if k < (1 << 63) - 1], np.int64)])), hot


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document of ``docs`` (doc_id, text) and of its edit with the next one, by descending doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    and common_prefix (longest common extension of both texts from their starts). Null text is
    empty; null ids come last; rows that repeat an id follow one another by descending text hash; after the
    last comes the first; one row alone is its own next; an empty table gives no rows. Documents are
    dealt out by ranges of ids, and each range gets a copy of the one row that follows it. An id (or null)
    that many rows share is cut into ranges of text hashes.
    """
    spark = docs.sparkSession
    small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(LEAST_KEY))).withColumn("th", F.xxhash64("text"))
    keys, hot = _ranges(docs, 4 * partitions(spark))

    @F.pandas_udf("long")
    def bucket(key: pd.Series, th: pd.Series) -> pd.Series:
        key, th = key.to_numpy(), th.to_numpy()
        out = np.searchsorted(keys, key, "right")
        for k, hashes in hot.items():
            # ranges behind this key move up by those that it has more than one
            own = key == k
            out = out + np.where(key > k, len(hashes), np.where(own, np.searchsorted(hashes, th, "right"), 0))
        return pd.Series(out)

    dealt = docs.withColumn("bucket", bucket("key", "th"))
    # one row for each range: bounded by the number of ranges
    heads = sorted((r["bucket"], *r["head"]) for r in dealt.groupBy("bucket").agg(F.max(F.struct("key", "th")).alias("head")).collect())
    follows = [(key, th, heads[(i + 1) % len(heads)][0]) for i, (_, key, th) in enumerate(heads)]
    follows = F.broadcast(spark.createDataFrame(follows, "key long, th long, bucket long"))
    tails = docs.join(follows, ["key", "th"]).groupBy("key", "th", "bucket").agg(F.min(F.struct("text", "doc_id")).alias("r"))
    tails = tails.select(F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"), "key", "th", "bucket", F.lit(1).alias("tail"))
    rows = dealt.withColumn("tail", F.lit(0)).unionByName(tails)
    rows = rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "tail", F.col("key").desc(), F.col("th").desc(), "text")
    return rows.select("bucket", "doc_id", "tail", "text").mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    )


__all__ = ["edit", "fingerprint_edits", "likeness", "sketches"]
