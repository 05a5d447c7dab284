"""Subword lattice likelihood: the probability of a text over all its segmentations into pieces.

A word is written with a mark before it; its probability is the sum, over all ways to cut it into
vocabulary pieces, of the products of piece weights. A forward recursion in log space gives that sum
for all words of a length together. The vocabulary is given; its weights start from its own order
(Zipf's law over the ranks that are its scores) and one round of expectation-maximisation over all
training words turns them into probabilities.

The add-one base counts whole words. Both need the corpus's word table, which stays distributed: the
``HEAD`` most frequent words go to every task (a fixed bound), all other tokens are joined to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, small_batches, text_blocks, utf8, words
from .pieces import MARK, Vocabulary
from .prefix_hash import PrefixHash

HEAD = 200_000
LOG10 = math.log(10)
FIELDS = ["doc_id", "uid", "train", "word", "n", "known", "base", "log"]


def _pick(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as strings; starts are ascending and spans don't overlap."""
    if not len(starts):
        return pa.array([], pa.large_string())
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return whole.take(pa.array(np.arange(0, len(edges), 2))).cast(pa.large_string())


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for at, to, data, offsets in text_blocks(column):
        data = LOWER[data]
        starts, ends, row = words(data, offsets)
        yield at, to, data, starts, ends, row, PrefixHash(data).spans(starts, ends) * np.uint64(2) + np.uint64(1)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``docs``; counted by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, names = [], [], []
            for _, _, data, starts, ends, _, hashes in _tokens(batch.column("text")):
                key, first, n = np.unique(hashes, return_index=True, return_counts=True)
                order = np.argsort(first)
                first = first[order]
                keys.append(key[order])
                counts.append(n[order])
                names.append(_pick(data, starts[first], ends[first]))
            if keys:
                key, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
                n = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
                word = pa.concat_arrays(names).take(pa.array(first))
                yield pa.RecordBatch.from_arrays([word.cast(pa.string()), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lattice:
    """Piece weights (natural logs) over a vocabulary, and log-space forward and backward recursions."""

    def __init__(self, vocabulary: Vocabulary, logs: np.ndarray):
        self.vocabulary, self.logs = vocabulary, logs

    @staticmethod
    def zipf(vocabulary: Vocabulary) -> Lattice:
        """Weights that fall with the piece's rank, best score first; bytes and the end share the last rank's."""
        n = len(vocabulary.pieces)
        rank = np.full(n, float(len(vocabulary.ids)))
        rank[vocabulary.ids[np.argsort(-vocabulary.scores[vocabulary.ids], kind="stable")]] = np.arange(len(vocabulary.ids))
        weight = 1.0 / (rank + 50)
        return Lattice(vocabulary, np.log(weight / weight.sum()))

    def _groups(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, matrix of code points with the mark first) for words of equal length."""
        marked = [MARK + w for w in column.to_pylist()]
        lengths = np.array([len(w) for w in marked])
        for n in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == n)
            step = max(1, 200_000 // n)
            for s in range(0, len(same), step):
                own = same[s : s + step]
                yield own, np.frombuffer("".join(marked[i] for i in own.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)

    def _arcs(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each piece length: ids and log weights by word and start; single characters outside the vocabulary weigh as their bytes."""
        arcs = []
        for l, ids in enumerate(self.vocabulary.substrings(codes), 1):
            logs = np.where(ids >= 0, self.logs[ids], -np.inf)
            if l == 1 and (ids < 0).any():
                width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
                logs = np.where(ids >= 0, logs, width * self.logs[self.vocabulary.bytes[0]])
            arcs.append((ids, logs))
        return arcs

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        stack = np.stack(terms)
        top = stack.max(0)
        top = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return top + np.log(np.exp(stack - top).sum(0))

    def _forward(self, arcs: list, m: int, n: int) -> np.ndarray:
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0
        for j in range(1, n + 1):
            alpha[j] = self._sum([alpha[j - l] + arcs[l - 1][1][:, j - l] for l in range(1, min(j, len(arcs)) + 1)])
        return alpha

    def score(self, column: pa.Array) -> np.ndarray:
        """Natural log of each word's probability over all its segmentations."""
        out = np.zeros(len(column))
        for rows, codes in self._groups(column):
            out[rows] = self._forward(self._arcs(codes), *codes.shape)[-1]
        return out

    def expect(self, column: pa.Array, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, words counted ``weight`` times; index len(pieces) holds the bytes."""
        total = np.zeros(len(self.logs) + 1)
        for rows, codes in self._groups(column):
            m, n = codes.shape
            arcs = self._arcs(codes)
            alpha = self._forward(arcs, m, n)
            beta = np.full((n + 1, m), -np.inf)
            beta[n] = 0
            for i in range(n - 1, -1, -1):
                beta[i] = self._sum([arcs[l - 1][1][:, i] + beta[i + l] for l in range(1, min(n - i, len(arcs)) + 1)])
            for l, (ids, logs) in enumerate(arcs, 1):
                share = np.exp(alpha[: n - l + 1].T + logs + beta[l:].T - alpha[n][:, None]) * weight[rows][:, None]
                total += np.bincount(np.where(ids >= 0, ids, len(self.logs)).ravel(), weights=share.ravel(), minlength=len(total))
        return total


def learn(counts: DataFrame, n_docs: int, model_path: str) -> np.ndarray:
    """Piece weights after one round of expectation-maximisation over the word table; one row for each used piece reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice.zipf(Vocabulary(model_path)), None
        for batch in batches:
            got = lattice.expect(batch.column("word"), batch.column("n").to_numpy().astype(float))
            total = got if total is None else total + got
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    vocabulary = Vocabulary(model_path)
    n = np.zeros(len(vocabulary.pieces) + 1)
    for r in counts.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).orderBy("piece").collect():
        n[r["piece"]] = r["n"]
    n[vocabulary.end] += n_docs
    weight = n[:-1] + 0.5
    weight[vocabulary.bytes] = n[-1] / 256 + 0.5
    return np.log(weight / weight.sum())


def score(docs: DataFrame, training, model_path: str, head: int = HEAD) -> DataFrame:
    """Score each row of ``docs`` (doc_id, text), learning from those where the column ``training`` holds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Null text is empty:
    one token, the end. A null ``training`` counts as false. Without training rows nothing is known, the
    base is 0 and weights are those of the vocabulary's order. Rows that repeat a doc_id are scored each by
    itself if their texts differ.
    """
    small_batches(docs)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    counts = cut(count_words(docs.filter("train")))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_docs = docs.filter("train").count()
    total, kinds = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    logs = learn(counts, n_docs, model_path) if n_docs else Lattice.zipf(Vocabulary(model_path)).logs
    below = math.log10(total + kinds + 1)
    end_base = math.log10((n_docs if n_docs else 0) + 1) - below

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(Vocabulary(model_path), logs)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(lattice.score(batch.column("word")) / LOG10)], ["word", "n", "log"])

    table = cut(counts.mapInArrow(weigh, "word string, n long, log double"))
    end_log = float(logs[Vocabulary(model_path).end]) / LOG10
    # the fixed number of most frequent words, as arrays by hash
    top = table.orderBy(F.col("n").desc(), "word").limit(head).toArrow()
    data, offsets = utf8(top.column("word"))
    keys = PrefixHash(data[offsets[0] : offsets[-1]]).spans(offsets[:-1] - offsets[0], offsets[1:] - offsets[0]) * np.uint64(2) + np.uint64(1)
    order = np.argsort(keys)
    keys, top_base, top_log = keys[order], np.log10(top.column("n").to_numpy()[order] + 1.0) - below, top.column("log").to_numpy()[order]
    shared = docs.sparkSession.sparkContext.broadcast((keys, top_base, top_log))

    # Each document gives one row with the sums over frequent words, and a row for each other word.
    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, top_base, top_log = shared.value
        for batch in batches:
            for at, to, data, starts, ends, row, hashes in _tokens(batch.column("text")):
                n = to - at
                place = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                hit = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
                got = [np.bincount(row[hit], weights=w[place[hit]], minlength=n).astype(float) for w in (top_base, top_log)]
                known = np.bincount(row[hit], minlength=n)
                all_ = np.bincount(row, minlength=n)
                # other words, once for each document
                miss = np.flatnonzero(~hit)
                group = np.lexsort((miss, hashes[miss], row[miss]))
                miss = miss[group]
                new = np.ones(len(miss), bool)
                new[1:] = (hashes[miss[1:]] != hashes[miss[:-1]]) | (row[miss[1:]] != row[miss[:-1]])
                head_at = np.flatnonzero(new)
                times = np.diff(np.append(head_at, len(miss)))
                word_at = miss[head_at]
                by_place = np.argsort(word_at)
                word_at, times = word_at[by_place], times[by_place]
                name = _pick(data, starts[word_at], ends[word_at]).cast(pa.string())
                ids, uid, train = (batch.column(c).slice(at, n) for c in ("doc_id", "uid", "train"))
                of = pa.array(row[word_at])
                k = len(word_at)
                yield pa.RecordBatch.from_arrays([ids, uid, train, pa.nulls(n, pa.string()), pa.array(all_), pa.array(known), pa.array(got[0]), pa.array(got[1])], FIELDS)
                if k:
                    zero = pa.array(np.zeros(k))
                    yield pa.RecordBatch.from_arrays([ids.take(of), uid.take(of), train.take(of), name, pa.array(times), pa.array(np.zeros(k, np.int64)), zero, zero], FIELDS)

    schema = "doc_id long, uid long, train boolean, word string, n long, known long, base double, log double"
    parts = docs.withColumn("uid", F.xxhash64("text")).mapInArrow(first_pass, schema)
    parts = cut(parts)
    rare = parts.filter("word is not null").select("doc_id", "uid", "word", "n").join(table.select("word", F.col("n").alias("c"), F.col("log").alias("l")), "word", "left")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(Vocabulary(model_path), logs)
        for batch in batches:
            n, c = batch.column("n").to_numpy(), batch.column("c").fill_null(0).to_numpy(zero_copy_only=False)
            log = batch.column("l").fill_null(0.0).to_numpy(zero_copy_only=False).copy()
            new = np.flatnonzero(c == 0)
            if len(new):
                coded = batch.column("word").take(pa.array(new)).dictionary_encode()
                log[new] = (lattice.score(coded.dictionary) / LOG10)[coded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(np.where(c > 0, n, 0)), pa.array(n * (np.log10(c + 1.0) - below)), pa.array(n * log)], ["doc_id", "uid", "known", "base", "log"])

    joined = rare.select("doc_id", "uid", "word", "n", "c", "l").mapInArrow(second_pass, "doc_id long, uid long, known long, base double, log double")
    summed = joined.groupBy("doc_id", "uid").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("log").alias("more_log"))
    # a row that comes m times has its rare words m times in the sums
    whole = parts.filter("word is null").groupBy("doc_id", "uid", "train", "n", "known", "base", "log").agg(F.count(F.lit(1)).alias("times"))
    both = whole.withColumnRenamed("doc_id", "d").withColumnRenamed("uid", "u").join(summed, F.expr("d <=> doc_id and u = uid"), "left")
    copies = F.sum("times").over(Window.partitionBy("d", "u"))
    share = both.withColumn("copies", copies).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("copies")
    return share.select(
        F.col("d").alias("doc_id"),
        (~F.col("train")).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + zero("more_known").cast("long") + (1 if n_docs else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") + F.lit(end_base)).alias("base_score"),
        (F.col("log") + zero("more_log") + F.lit(end_log)).alias("score"),
    )


__all__ = ["Lattice", "count_words", "learn", "score"]
