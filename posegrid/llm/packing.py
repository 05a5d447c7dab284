"""Packing token sequences by first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised where they lie; only small piece descriptions are shuffled, by a
random group number. Each group is packed alone, so its size (a parameter) bounds every task,
and a document with very many tokens spreads its pieces over all groups.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, small_batches

CAPACITY = 4096
GROUP_PIECES = 20_000
MEMO_WORDS = 1_000_000


class WordEncoder(WordMemo):
    """word -> its token ids as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words one after the other; each distinct word is encoded once, as long as it is remembered.
    """

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core already
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_file(path)
        self.mark_id, self.mark = next((i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()))

    def fill(self, words: set[str]) -> None:
        new = self.unknown(words)
        # many words go to the tokenizer as one string, between two of them a special token that none holds
        odd = [w for w in new if self.mark in w]
        todo = [w for w in new if self.mark not in w] if odd else new
        for start in range(0, len(todo), 5000):
            part = todo[start : start + 5000]
            joined = [self.mark.join(part[i : i + 50]) for i in range(0, len(part), 50)]
            encoded = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            ids = np.concatenate([np.append(np.frombuffer(e, "<u4"), self.mark_id) for e in encoded]) if encoded else np.zeros(0, "<u4")
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            at = 0
            for word, end in zip(part, ends, strict=True):
                self[word] = raw[at:end]
                at = end + 4
        for word in odd:
            self[word] = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        # only blanks that the tokenizer itself drops are cut at
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        self.fill(set().union(*map(set, split)) if split else set())
        return [b"".join(map(self.__getitem__, words)) for words in split]


@functools.cache
def encoder(path: str, limit: int) -> WordEncoder:
    """One for each worker process, so that later tasks find the memo filled."""
    return WordEncoder(path, limit)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items go, largest first (ties: as given), to the leftmost bin with room.

    ``tree`` is a tournament: each node holds the largest free capacity below it, so the leftmost
    fitting bin is found on one walk from the root.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    leaves = 1 << (n - 1).bit_length() if n > 1 else 1
    tree = [capacity] * (2 * leaves)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and how many equal pieces came shortly before it. A document is cut only each ``capacity`` tokens."""
    small_batches(docs)
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(tokenizer_path, memo_words)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                rows, seen = [], Counter()
                for doc_id, none, ids in zip(part["doc_id"], part["none"], words.encode(part["text"].tolist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        own = ids[4 * start : 4 * (start + capacity)]
                        piece = (doc_id, none, start, len(own) // 4, zlib.crc32(own), total)
                        rows.append((*piece, seen[piece]))
                        seen[piece] += 1
                yield pd.DataFrame(rows, columns=["doc_id", "none", "start", "length", "ids_crc32", "doc_tokens", "repeat"])

    slim = _without_nulls(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    return _with_nulls(slim.mapInPandas(pieces, "doc_id long, none boolean, start long, length long, ids_crc32 long, doc_tokens long, repeat long"))


def _without_nulls(df: DataFrame) -> DataFrame:
    """Null ids as 0 beside the column ``none``: pandas would turn all ids of a batch with a null into doubles."""
    return df.withColumns({"doc_id": F.coalesce("doc_id", F.lit(0).cast("long")), "none": F.col("doc_id").isNull()})


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Pack every document's tokens (+ ``end_id``) into sequences of at most ``capacity``.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null or empty texts are one token, the end; an empty table gives no rows; repeated rows are
    packed each by itself and spread over the groups; a null doc_id stays null. The same files give the same packing. ``memo_words``
    bounds the words that a worker process remembers (about 0.25 KB each), and only its speed.
    """
    # A token has one byte at least, so this bounds the number of pieces before anything is tokenised.
    bound = docs.agg((F.count(F.lit(1)) + F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / capacity).alias("n")).first()["n"] or 0
    groups = max(1, -(-int(bound) // group_pieces))
    stride = 1 << 40

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        out = rows.assign(sequence_id=rows["grp"] * stride + bins, offset=offsets)
        return out[["doc_id", "none", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, memo_words)
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "repeat"), F.lit(groups)).cast("long"))
    packed = _without_nulls(grouped).groupBy("grp").applyInPandas(
        pack_group, "doc_id long, none boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return _with_nulls(packed)
