"""Language identification: scripts narrow the candidates, words are scored, Viterbi labels spans.

A word's score for a language is the sum of smoothed log frequencies of its letter trigrams (word
ends count as a letter). Languages that hardly use the word's script are ruled out. A Viterbi path
over the words, with a penalty for each change of language, labels spans of mixed text; a document
gets the language with most letters on that path, and their share as score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNKNOWN = "und"
#: Expected number of labelled documents of each language that the model is fitted on, at most.
SAMPLE_DOCS = 4000
BUCKETS = 1 << 16
PENALTY = 8.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01
# fixed values: first and last code point of the letters of common scripts
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x3134F),
)
NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]

_tables: list[np.ndarray] = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter (0: no letter), and the number of its script."""
    if not _tables:
        fold = np.zeros(0x110000, np.uint32)
        script = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        for name, a, b in SCRIPTS:
            script[a : b + 1] = NAMES.index(name)
        _tables.extend([fold, script])
    return _tables[0], _tables[1]


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded letters with 0 elsewhere, code points, offsets): texts one after the other, each followed by one blank."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return letter_tables()[0][codes], codes, offsets


def _grams(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    before, after = letters[at - 1] * (at > 0), letters[at + 1]
    h = before * np.uint32(0x9E3779B1) + letters[at] * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(16)


@dataclass(frozen=True)
class Model:
    """languages, (buckets, languages) log frequencies and (scripts, languages) candidates; at most a few MB."""

    languages: list[str]
    logs: np.ndarray
    candidate: np.ndarray


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on ``labelled`` (text, lang, pick): about ``sample_docs`` documents a language, those with the least hashes of ``pick``.

    Rows with null text or lang are left out. What reaches the driver is a table of languages by
    trigram buckets, whatever the number of documents.
    """
    labelled = labelled.filter("text is not null and lang is not null")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(rows)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_docs / rows[k]))])
    picked = labelled.filter((F.pmod(F.xxhash64("pick"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((len(languages), BUCKETS + len(NAMES)), np.int64)
        place = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                letters, codes, _ = _letters([text])
                at = np.flatnonzero(letters)
                got[place[lang], :BUCKETS] += np.bincount(_grams(letters, at), minlength=BUCKETS)
                got[place[lang], BUCKETS:] += np.bincount(letter_tables()[1][codes[at]], minlength=len(NAMES))
        lang, index = np.nonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(index), pa.array(got[lang, index])], ["lang", "idx", "n"])

    counts = np.zeros((len(languages), BUCKETS + len(NAMES)))
    for r in picked.mapInArrow(count, "lang long, idx long, n long").groupBy("lang", "idx").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"], r["idx"]] = r["n"]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    seen = max(1, int((grams.sum(0) > 0).sum()))
    logs = np.log((grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * seen))
    candidate = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(languages, np.ascontiguousarray(logs.T), candidate.T & (scripts.T > 0))


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each word; the words of document i are the next counts[i] rows. All documents advance together."""
    n, labels = scores.shape
    path, back = np.zeros(n, np.int64), np.zeros((n, labels), np.int16)
    order = np.argsort(-counts, kind="stable")
    first, size = (np.cumsum(counts) - counts)[order], counts[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")
    best, every = np.zeros((len(size), labels)), np.arange(labels)
    for t in range(longest):
        a = active[t]
        at = first[:a] + t
        if t:
            top = best[:a].argmax(1)
            change = best[:a][np.arange(a), top] - penalty
            stay = best[:a] >= change[:, None]
            back[at] = np.where(stay, every, top[:, None])
            best[:a] = np.where(stay, best[:a], change[:, None])
        best[:a] += scores[at]
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        at = first[: active[t]] + t
        path[at] = state[: active[t]]
        state[: active[t]] = back[at, path[at]]
    return path


def label(texts: list[str], model: Model, penalty: float = PENALTY) -> tuple[list, np.ndarray, pa.Array]:
    """Language, score and spans (start, end, lang in code points) of each text."""
    n, kinds = len(texts), len(model.languages)
    letters, codes, offsets = _letters(texts)
    is_letter = letters > 0
    first = is_letter.copy()
    first[1:] &= ~is_letter[:-1]
    last = is_letter.copy()
    last[:-1] &= ~is_letter[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    spans = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    if not kinds or not len(start):
        return [UNKNOWN] * n, np.zeros(n), pa.array([[]] * n, pa.list_(spans))
    at = np.flatnonzero(is_letter)
    length = end - start
    scores = np.add.reduceat(model.logs[_grams(letters, at)], np.cumsum(length) - length, axis=0)
    allowed = model.candidate[letter_tables()[1][codes[start]]]
    scores = np.where(allowed | ~allowed.any(1)[:, None], scores, scores.min(1)[:, None] - 1e4)
    row = np.searchsorted(offsets, start, "right") - 1
    counts = np.bincount(row, minlength=n)
    path = viterbi(scores, counts, penalty)
    votes = np.bincount(row * kinds + path, weights=length, minlength=n * kinds).reshape(n, kinds)
    total = votes.sum(1)
    best = votes.argmax(1)
    named = [model.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist(), strict=True)]
    share = votes[np.arange(n), best] / np.maximum(total, 1)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(path)) - 1
    found = pa.StructArray.from_arrays(
        [pa.array(start[head] - offsets[row[head]], pa.int32()), pa.array(end[tail] - offsets[row[head]], pa.int32()), pa.array(np.array(model.languages, object)[path[head]], pa.string())], fields=list(spans)
    )
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[head], minlength=n))]), pa.int32()), found)
    return named, share, lists


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """lang_pred, score (0 to 1) and spans for each row of ``docs`` (text); no shuffle, no other column is read.

    Null text, or text without a letter: ``und``, 0.0 and no span; so is all text if the model has
    learned nothing. Other columns pass through; columns of the three names are replaced.
    """
    small_batches(docs)
    docs = docs.drop("lang_pred", "score", "spans")

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def run(column: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in column]
        # texts of like length go together, so that few of them run on alone
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        named, share, lists = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        at = 0
        while at < len(order):
            to, size = at, 0
            while to < len(order) and (to == at or size + len(texts[order[to]]) <= 300_000):
                size += len(texts[order[to]]) + 1
                to += 1
            got, score, spans = label([texts[i] for i in order[at:to]], model, penalty)
            for i, a, b, c in zip(order[at:to], got, score.tolist(), spans.to_pylist(), strict=True):
                named[i], share[i], lists[i] = a, b, c
            at = to
        return pd.DataFrame({"lang_pred": named, "score": share, "spans": lists})

    return docs.withColumn("_lang", run(F.col("text"))).select(*docs.columns, "_lang.lang_pred", "_lang.score", "_lang.spans")


__all__ = ["Model", "fit", "identify", "label", "viterbi"]
