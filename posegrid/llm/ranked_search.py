"""Ranked lexical search over a two-level quantised index.

Documents are indexed in blocks of a few megabytes of text. The first level of a block holds, for
each of its terms, the documents with the term and their impacts, rounded up to a byte; the second
level holds the exact counts. Sums of byte impacts bound every document's score from above and
below. The k-th largest lower bound of an item, over all blocks, is a floor that each of its best k
documents reaches; every document whose upper bound reaches it is scored again in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, discard, small_batches, text_blocks, words

#: A term is a run of what isn't an ASCII sign or control character; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: One byte of impact; an exact impact is below a million, so 250 such steps reach it.
STEP = 4000
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1 << 16
#: (item, term) pairs that are looked up in one pass over the index, and cells of a table of bounds.
PASS_PAIRS, CELLS = 200_000, 1 << 21
INDEX = "doc_id array<long>, n array<long>, term array<string>, df array<int>, doc binary, tf binary"


@dataclass
class Index:
    """The written blocks (``INDEX`` and ``impact``), the number of documents with a term, and that of all their terms."""

    blocks: DataFrame
    documents: int
    terms: int


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, and the term and the row of each occurrence."""
    starts, ends, row = words(data, offsets, BETWEEN)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    text = LOWER[data[~BETWEEN[data]]]
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(text)).dictionary_encode()
    return found.dictionary.cast(pa.string()), found.indices.to_numpy(), row


def _narrow(values: np.ndarray) -> bytes:
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _list(kind: pa.DataType, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, BLOCK_DOCS):
            batch = whole.slice(first, BLOCK_DOCS)
            for at, to, data, offsets in text_blocks(batch.column("text"), limit):
                vocabulary, code, row = _terms(data, offsets)
                n = np.bincount(row, minlength=to - at)
                held = np.flatnonzero(n)
                if not len(held):
                    continue
                number = np.cumsum(n > 0) - 1
                pair, tf = np.unique(code.astype(np.int64) * len(held) + number[row], return_counts=True)
                ids = batch.column("doc_id").slice(at, to - at).take(pa.array(held))
                yield pa.RecordBatch.from_arrays(
                    [
                        _list(pa.int64(), ids), _list(pa.int64(), n[held]), _list(pa.string(), vocabulary), _list(pa.int32(), np.bincount(pair // len(held), minlength=len(vocabulary))),
                        pa.array([(pair % len(held)).astype("<u2").tobytes()]), pa.array([_narrow(tf)]),
                    ],
                    ["doc_id", "n", "term", "df", "doc", "tf"],
                )


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Each document's m, from its number of terms: 100 for one of mean length."""
    if 75 * int(n.max(initial=0)) * documents < 1 << 63:
        return 25 + 75 * n.astype(np.int64) * documents // terms
    return np.array([25 + 75 * int(x) * documents // terms for x in n], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's exact share of a score, before its weight; below a million."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Block:
    """One row of the index, as arrays. Postings are sorted by term, then document."""

    def __init__(self, row: dict):
        self.term, self.ids = row["term"].values, row["doc_id"].values
        self.df = row["df"].values.to_numpy()
        self.start = np.concatenate([[0], np.cumsum(self.df)])
        self.doc = np.frombuffer(row["doc"].as_py(), "<u2").astype(np.int64)
        self.size = len(self.ids)
        self.impact = np.frombuffer(row["impact"].as_py(), "<u1").astype(np.int64) if "impact" in row else None
        if "tf" in row:
            tf = row["tf"].as_py()
            self.tf = np.frombuffer(tf, f"<u{len(tf) // len(self.doc)}").astype(np.int64)
            self.n = row["n"].values.to_numpy()

    @staticmethod
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield Block({name: batch.column(name)[i] for name in batch.schema.names})


def build(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> Index:
    """Index every row of ``docs`` (doc_id, text) that has a term, whole; the blocks are written to the shared folder.

    Tasks cut their own rows into blocks of ``block_bytes`` of text, or one longer text, without a
    shuffle; impacts follow once the mean length is known. Null and empty texts aren't indexed;
    rows that repeat an id, or have none, are documents of their own; other columns aren't carried.
    """
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = cut(rows.mapInArrow(lambda batches: _blocks(batches, block_bytes), INDEX))
    total = lambda of: F.coalesce(F.sum(of), F.lit(0))
    sums = counted.agg(total(F.size("n")).alias("documents"), total(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
    documents, terms = sums["documents"], sums["terms"]

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in Block.read(iter([batch])):
                exact = impact(block.tf, lengths(block.n, documents, terms)[block.doc])
                found.append((-(-exact // STEP)).astype("<u1").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "impact"])

    blocks = cut(counted.mapInArrow(quantise, f"{INDEX}, impact binary"))
    discard(counted)
    return Index(blocks, documents, terms)


def item_weights(index: Index, items: DataFrame) -> DataFrame:
    """One row per row of ``items`` (item_id, text) with its terms that the index holds and their weights, times their occurrences in it."""
    lower = F.translate("text", UPPER, SMALL)
    numbered = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id())
    asked = cut(numbered.select("item_id", "item", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")))
    asked_counts = asked.groupBy("item_id", "item", "term").count()
    held = index.blocks.select(F.explode(F.arrays_zip("term", "df")).alias("t")).select("t.term", "t.df")
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.documents + 2) / (2 * F.col("df") + 1))) * F.col("count")
    return asked_counts.join(df, "term").groupBy("item_id", "item").agg(F.collect_list(F.struct("term", weight.cast("long").alias("weight"))).alias("terms"))


class Items:
    """The items of one pass: terms by place, and for each term the items with it, sorted by item, and their weights."""

    def __init__(self, rows: list, cells: int = CELLS):
        self.cells = cells
        pairs = [(t["term"], i, t["weight"]) for i, r in enumerate(rows) for t in r["terms"]]
        self.size, self.vocabulary = len(rows), sorted({t for t, _, _ in pairs})
        place = {t: k for k, t in enumerate(self.vocabulary)}
        term, item, weight = (np.array(x, np.int64) for x in zip(*[(place[t], i, w) for t, i, w in pairs], strict=True))
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        by_item = np.lexsort((term, item))
        self.terms, self.own_weight = term[by_item], weight[by_item]
        self.own_start = np.searchsorted(item[by_item], np.arange(len(rows) + 1))

    def places(self, block: Block) -> np.ndarray:
        """Where the block has each term of the vocabulary; -1: nowhere."""
        found = pc.index_in(block.term, value_set=pa.array(self.vocabulary, pa.string()))
        held = np.flatnonzero(found.is_valid())
        out = np.full(len(self.vocabulary), -1, np.int64)
        out[found.drop_null().to_numpy()] = held
        return out

    def bounds(self, block: Block, places: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first item, lower bounds, upper bounds) by item and document, for a range of items after the other."""
        step = max(1, self.cells // block.size)
        for low in range(0, self.size, step):
            rows = min(step, self.size - low)
            upper, gap = np.zeros((rows, block.size), np.int64), np.zeros((rows, block.size), np.int64)
            for t in np.flatnonzero(places >= 0).tolist():
                s, e = self.start[t], self.start[t + 1]
                if rows < self.size:
                    s, e = s + np.searchsorted(self.item[s:e], [low, low + rows])
                if s == e:
                    continue
                own = slice(block.start[places[t]], block.start[places[t] + 1])
                cells = np.ix_(self.item[s:e] - low, block.doc[own])
                weight = self.weight[s:e, None]
                upper[cells] += weight * block.impact[own]
                # an impact of 0 is exact, others may be up to a step too large
                gap[cells] += weight * np.minimum(block.impact[own], 1)
            yield low, (upper - gap) * STEP, upper * STEP

    def rescore(self, block: Block, places: np.ndarray, m: np.ndarray, item: int, docs: np.ndarray) -> np.ndarray:
        """Exact scores of ``docs`` for one item."""
        own = slice(self.own_start[item], self.own_start[item + 1])
        place, weight = places[self.terms[own]], self.own_weight[own]
        place, weight = place[place >= 0], weight[place >= 0]
        out = np.zeros(len(docs), np.int64)
        for p, w in zip(place.tolist(), weight.tolist(), strict=True):
            s, e = block.start[p], block.start[p + 1]
            at = np.minimum(s + np.searchsorted(block.doc[s:e], docs), e - 1)
            tf = np.where(block.doc[at] == docs, block.tf[at], 0)
            out += w * impact(tf, m)
        return out


def _floors(index: Index, items: Items, k: int) -> np.ndarray:
    """Each item's k-th largest lower bound over all documents, 1 at least (a score of 0 is no match)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((items.size, k), np.int64)
        for block in Block.read(batches):
            for low, lower, _ in items.bounds(block, items.places(block)):
                both = np.concatenate([best[low : low + len(lower)], lower], axis=1)
                best[low : low + len(lower)] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        item, place = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[item, place])], ["item", "bound"])

    found = index.blocks.select("doc_id", "term", "df", "doc", "impact").mapInArrow(run, "item long, bound long")
    number = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc()))
    floors = np.ones(items.size, np.int64)
    for r in found.withColumn("number", number).filter(F.col("number") <= k).filter(F.col("number") == k).collect():
        floors[r["item"]] = r["bound"]
    return floors


def _pass(index: Index, rows: list, k: int, cells: int) -> DataFrame:
    items = Items(rows, cells)
    floors = _floors(index, items, k)
    keys, ids = np.array([r["item"] for r in rows], np.int64), [r["item_id"] for r in rows]
    documents, terms = index.documents, index.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in Block.read(batches):
            places, m = items.places(block), lengths(block.n, documents, terms)
            for low, _, upper in items.bounds(block, places):
                for i in np.flatnonzero((upper >= floors[low : low + len(upper), None]).any(axis=1)).tolist():
                    docs = np.flatnonzero(upper[i] >= floors[low + i])
                    score = items.rescore(block, places, m[docs], low + i, docs)
                    docs, score = docs[score > 0], score[score > 0]
                    item = pa.array(np.full(len(docs), keys[low + i])), pa.array([ids[low + i]] * len(docs), pa.int64())
                    yield pa.RecordBatch.from_arrays([*item, block.ids.take(pa.array(docs)), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return index.blocks.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 10, pass_pairs: int = PASS_PAIRS, cells: int = CELLS) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Equal scores go by ascending doc_id, null ids last; repeated rows are documents, and items, of
    their own. Items without a term that the index holds, null and empty ones among them, give no rows.
    Items are handled in passes of at most ``pass_pairs`` (item, term) pairs, or one larger item, so
    that no task and no driver holds more of them at once; a table of bounds has ``cells`` cells, or
    one item's.
    """
    found, rows, pairs = [], [], 0
    for r in cut(item_weights(index, items)).toLocalIterator(prefetchPartitions=False):
        if rows and pairs + len(r["terms"]) > pass_pairs:
            found.append(_pass(index, rows, k, cells))
            rows, pairs = [], 0
        rows.append(r)
        pairs += len(r["terms"])
    if rows:
        found.append(_pass(index, rows, k, cells))
    if not found:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    scored = found[0]
    for more in found[1:]:
        scored = scored.unionAll(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_sql(documents: str, items: str, k: int = 10) -> str:
    """DuckDB SQL for :func:`search` over an index of ``documents``."""
    terms = f"regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{TERM}')"
    return f"""
    WITH d AS (SELECT * FROM (SELECT doc_id, row_number() OVER () AS doc, {terms} AS terms FROM {documents}) WHERE len(terms) > 0),
    sums AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
    p AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
    q AS (SELECT item, item_id, term, count(*) AS qtf FROM (SELECT item_id, row_number() OVER () AS item, unnest({terms}) AS term FROM {items}) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2.0 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, sums WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
    s AS (SELECT item, item_id, doc, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term), sums GROUP BY ALL)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
