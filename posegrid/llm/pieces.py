"""A SentencePiece vocabulary as sorted substring hashes, and batched numpy Viterbi over it.

Words of equal length form one matrix and advance together: all their substrings of up to the
longest piece are hashed from prefix arrays, the hashes probe the sorted piece keys, and each step
takes a vectorised maximum over the pieces that end there.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordMemo, small_batches
from .prefix_hash import PrefixHash

MARK = "▁"
MEMO_WORDS = 1_000_000
#: What a character outside the vocabulary costs more than the worst piece, for each of its bytes.
BYTE_COST = 10.0
#: A unit is a run of blanks with the word after it, or one line feed; no piece goes across its end.
UNIT = re.compile(r" *[^ \n]+| +|\n")
PLAIN = -1e9


class Vocabulary:
    """Pieces of a SentencePiece model file, found by hash; byte pieces stand for other characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int32)
        normal = []
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(self.pieces[i][3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in (self.pieces[i] for i in normal)):
            raise ValueError("pieces that go across words aren't supported")
        self.end = model.eos_id()
        self.longest = max(len(self.pieces[i]) for i in normal)
        codes = np.frombuffer("".join(self.pieces[i] for i in normal).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(self.pieces[i]) for i in normal])
        keys = PrefixHash(codes).spans(np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        # rows of blanks have a score of their own in the file, far below all others
        score = np.array([model.get_score(i) for i in range(n)], np.float64)
        usable = score[normal][score[normal] > PLAIN]
        self.floor = float(usable.min())
        self.scores = np.where(score <= PLAIN, self.floor, score)
        self.surface = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id for each hash, -1 where there is none."""
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[place] == hashes, self.ids[place], -1)

    def substrings(self, codes: np.ndarray) -> list[np.ndarray]:
        """For words as rows of ``codes`` (words, length): element l - 1 holds the piece ids of all substrings of length l, by start."""
        m, n = codes.shape
        prefix = PrefixHash(codes.ravel())
        base = np.arange(m)[:, None] * n
        return [self.lookup(prefix.spans(base + np.arange(n - l + 1), base + np.arange(l, n + 1))) for l in range(1, min(n, self.longest) + 1)]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Best segmentation of each word: the greatest sum of scores; of equal ones, that whose last pieces are longest."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths[lengths > 0]).tolist():
            same = np.flatnonzero(lengths == n)
            for s in range(0, len(same), max(1, 400_000 // n)):
                own = same[s : s + max(1, 400_000 // n)]
                for i, ids in zip(own.tolist(), self._encode(["".join(words[i]) for i in own.tolist()], n), strict=True):
                    out[i] = ids
        return out

    def _encode(self, words: list[str], n: int) -> list[np.ndarray]:
        m = len(words)
        # a mark in the text itself is written as bytes, so that decoding gives it back
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        own_mark = codes == ord(MARK)
        found = self.substrings(np.where(own_mark, np.uint32(0x10FFFF), np.where(codes == 0x20, np.uint32(ord(MARK)), codes)))
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        other = width * (self.floor - BYTE_COST)
        best, back = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int16)
        best[0] = 0
        for j in range(1, n + 1):
            for l in range(min(j, self.longest), 0, -1):
                ids = found[l - 1][:, j - l]
                gain = np.where(ids >= 0, self.scores[ids], other[:, j - 1] if l == 1 else -np.inf)
                score = best[j - l] + gain
                better = score > best[j]
                best[j] = np.where(better, score, best[j])
                back[j] = np.where(better, l, back[j])
        # all words step back together; their pieces come last to first
        rows, ends, steps = [], [], []
        at = np.full(m, n)
        alive = np.arange(m)
        while len(alive):
            l = back[at[alive], alive].astype(np.int64)
            rows.append(alive)
            ends.append(at[alive])
            steps.append(l)
            at[alive] -= l
            alive = alive[at[alive] > 0]
        row, end, step = np.concatenate(rows), np.concatenate(ends), np.concatenate(steps)
        order = np.lexsort((end, row))
        row, end, step = row[order], end[order], step[order]
        ids = np.zeros(len(row), np.int32)
        for l in np.unique(step).tolist():
            k = step == l
            ids[k] = found[l - 1][row[k], end[k] - l]
        if (ids < 0).any():
            # characters outside the vocabulary become their bytes
            many = np.where(ids < 0, width[row, end - 1], 1)
            flat = np.repeat(ids, many)
            flat[np.repeat(ids < 0, many)] = self.bytes[np.frombuffer("".join(map(chr, codes[row[ids < 0], end[ids < 0] - 1].tolist())).encode("utf-8", "surrogatepass"), np.uint8)]
            count = np.bincount(row, weights=many, minlength=m).astype(np.int64)
        else:
            flat, count = ids, np.bincount(row, minlength=m)
        ends = np.cumsum(count).tolist()
        return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str], memo: WordMemo | None = None) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with a blank put before it; an empty text has none."""
        memo = WordMemo(MEMO_WORDS) if memo is None else memo
        split = [UNIT.findall(" " + t) if t else [] for t in texts]
        new = memo.unknown(set().union(*map(set, split)) if split else set())
        for w, ids in zip(new, self.encode_words(new), strict=True):
            memo[w] = ids.astype("<i4").tobytes()
        return [b"".join(map(memo.__getitem__, units)) for units in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text again; exact for ids that ``encode`` made."""
        return b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


@functools.cache
def remembered(path: str) -> tuple[Vocabulary, WordMemo]:
    """A vocabulary and its memo of words, one for each worker process."""
    return Vocabulary(path), WordMemo(MEMO_WORDS)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids, ids_sha256 (over little-endian 32-bit ids) and round_trip for each row of ``docs`` (doc_id, text).

    round_trip says whether decoding the ids gave the text back. Null text is empty and has no ids; a null
    doc_id stays null. No shuffle; other columns aren't read.
    """
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, memo = remembered(model_path)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column("text").to_pylist()]
                coded = vocabulary.encode(texts, memo)
                ids = [np.frombuffer(c, "<i4") for c in coded]
                sizes = np.array([len(i) for i in ids])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"))),
                        pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([vocabulary.decode(i) == t for i, t in zip(ids, texts, strict=True)]),
                    ],
                    ["doc_id", "n_chars", "n_tokens", "ids", "ids_sha256", "round_trip"],
                )

    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return slim.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean")
