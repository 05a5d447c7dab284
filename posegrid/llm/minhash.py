"""Near-duplicate units (documents or paragraphs) by circulant MinHash, banding and exact Jaccard.

Two permutations make the whole signature: ``sigma`` scatters the shingles once, and coordinate k is
the least ``pi`` of the scattered shingle shifted circularly by k (Li & Li, C-MinHash, 2022). Units
that agree on a whole band meet in a bucket. Links are confirmed on full shingle sets in two steps
that never emit all pairs of a bucket:

1. Each unit against the least unit of its buckets (a star). Verified stars are joined into components.
2. Buckets that still hold several components are compared completely, in blocks bounded by bytes;
   pairs that are connected already are passed over, so only links that join components come out.

Units with equal shingle sets are one unit throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, mix64, per_row, small_batches, spread
from .components import components
from .shingles import shingle_sets

NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 32, 4
STAR = 512
BLOCK_BYTES = 8 << 20
GATHERED_BYTES = 1 << 20
_U = np.uint32


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A fixed permutation of the 32-bit integers."""
    x = x ^ (x >> _U(16))
    x *= _U(a)
    x ^= x >> _U(15)
    x *= _U(b)
    x ^= x >> _U(16)
    return x


def signatures(hashes: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """(rows, length) circulant MinHash signatures; rows without shingles get all ones."""
    n = len(offsets) - 1
    out = np.full((n, length), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if not len(full):
        return out
    scattered = _permute((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    chunk = 1 << 14
    # whole rows in pieces that stay in the processor's cache
    bounds, at = [0], 0
    ends = offsets[1:][full]
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(ends, offsets[full[at]] + chunk, "right")))
        bounds.append(to)
        at = to
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        lo, hi = offsets[full[a]], offsets[full[b - 1] + 1]
        x, starts = scattered[lo:hi], offsets[full[a:b]] - lo
        for k in range(length):
            out[full[a:b], k] = np.minimum.reduceat(_permute(x + _U(k), 0x7FEB352D, 0x846CA68B), starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(units, bands) 64-bit keys; the band's number is part of its key."""
    keys = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        keys[:, b] = k
    return keys


def describe(batch: pa.RecordBatch, text: pa.Array, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The columns of ``batch`` with n_shingles, n_bytes, s1, s2 and bands of ``text``; s1 and s2 stand for the whole set, bands is null for an empty one."""
    n_bytes = pa.compute.binary_length(text.cast(pa.large_string())).cast(pa.int64()).fill_null(0)
    for at, to, hashes, offsets in shingle_sets(text):
        size = np.diff(offsets)
        keys = band_keys(signatures(hashes, offsets, bands * rows), bands, rows)
        s1 = per_row(mix64(hashes), offsets)
        s2 = per_row(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), offsets)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (to - at + 1) * bands, bands), pa.int32()), pa.array(keys.ravel().view(np.int64)), mask=pa.array(size == 0))
        own = [pa.array(size), n_bytes.slice(at, to - at), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists]
        yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns), *own], [*batch.schema.names, "n_shingles", "n_bytes", "s1", "s2", "bands"])


DESCRIBED = "n_shingles long, n_bytes long, s1 long, s2 long, bands array<long>"


def similar(inter, a, b):
    """The link test in whole numbers: Jaccard of at least 0.75."""
    return DENOMINATOR * inter >= NUMERATOR * (a + b - inter)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    place = np.searchsorted(b, a)
    return int((b[np.minimum(place, len(b) - 1)] == a).sum())


def _verify_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hub and salt, the hub's own row first; yields the (u, v) that pass."""
    hub = None
    for batch in batches:
        hubs, ids, member = batch.column("hub").to_numpy(), batch.column("id").to_numpy(), batch.column("member").to_numpy()
        found: list[tuple[int, int]] = []
        for at, to, hashes, offsets in shingle_sets(batch.column("text")):
            for i in range(at, to):
                own = hashes[offsets[i - at] : offsets[i - at + 1]]
                if not member[i]:
                    hub = own
                    continue
                if similar(_shared(own, hub), len(own), len(hub)):
                    found.append((ids[i], hubs[i]))
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _forest(ids: np.ndarray, block: np.ndarray, component: np.ndarray, parts: list[np.ndarray], apart: bool) -> list[tuple[int, int]]:
    """Links that join different components among the rows of one bucket block; with ``apart`` only between its two blocks."""
    n, sizes, out = len(ids), np.array([len(p) for p in parts]), []
    _, label = np.unique(component, return_inverse=True)
    many = n > 16
    if many:
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        _, code = np.unique(np.concatenate(parts), return_inverse=True)
        marked = np.zeros(int(code.max()) + 1, np.int64)
    for i in range(n - 1):
        other = label != label[i]
        other[: i + 1] = False
        if apart:
            other &= block != block[i]
        # sizes alone rule out most of what can't reach the threshold
        other &= DENOMINATOR * np.minimum(sizes, sizes[i]) >= NUMERATOR * np.maximum(sizes, sizes[i])
        todo = np.flatnonzero(other)
        if not len(todo):
            continue
        if many:
            mine = code[offsets[i] : offsets[i + 1]]
            marked[mine] = 1
            inter = np.array([int(marked[code[offsets[j] : offsets[j + 1]]].sum()) for j in todo]) if len(todo) < 64 else np.add.reduceat(marked[code], offsets[:-1])[todo]
            marked[mine] = 0
        else:
            inter = np.array([_shared(parts[i], parts[j]) for j in todo])
        for j in todo[similar(inter, sizes[todo], sizes[i])]:
            if label[j] != label[i]:
                out.append((int(ids[j]), int(ids[i])))
                label[label == label[j]] = label[i]
    return out


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by band, x, y and id; shingles of many small buckets are made together."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        band, x, y, block, ids, component = (rows.column(c).to_numpy() for c in ("band", "x", "y", "block", "id", "component"))
        parts = [h[o[i] : o[i + 1]] for _, _, h, o in shingle_sets(rows.column("text").combine_chunks()) for i in range(len(o) - 1)]
        edges = [0, *(np.flatnonzero((np.diff(band) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist(), len(ids)]
        found = [link for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s > 1 for link in _forest(ids[s:e], block[s:e], component[s:e], parts[s:e], x[s] != y[s])]
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    key = lambda b, i: tuple(b.column(c)[i].as_py() for c in ("band", "x", "y"))
    for batch in batches:
        at = 0
        while at < len(batch):
            to = min(len(batch), at + 512)
            part = batch.slice(at, to - at)
            # what is held is compared as soon as the next rows start another bucket
            if held and sum(h.nbytes for h in held) > GATHERED_BYTES:
                last, n = key(held[-1], len(held[-1]) - 1), 0
                while n < len(part) and key(part, n) == last:
                    n += 1
                if n:
                    held.append(part.slice(0, n))
                if n < len(part):
                    yield from done(pa.Table.from_batches(held))
                    held = [part.slice(n)]
            else:
                held.append(part)
            at = to
    if held:
        yield from done(pa.Table.from_batches(held))


def linked_classes(described: DataFrame, place: list[str], fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(s1, s2, class, n and place of one of its n units) of all classes of equal sets, and (class, component) of those that are linked.

    ``described`` has, for each unit, the columns ``place`` by which it is found again, and those of ``describe``.
    ``fetch`` gets classes with their places and returns (class, text). Both tables are written, and all others deleted.
    """
    # one representative with all that is needed later, combined before the shuffle
    grouped = described.filter("bands is not null").groupBy("s1", "s2").agg(F.min(F.struct(*place)).alias("at"), F.first("bands").alias("bands"), F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
    classes = cut(grouped.withColumn("class", F.monotonically_increasing_id()))
    discard()
    keyed = classes.select("class", "n_bytes", F.explode("bands").alias("band"))
    # written first, so that the join's sides are plain tables and Spark can split the partitions of very common bands
    buckets = cut(keyed.groupBy("band").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "hub"))
    shared = cut(keyed.join(buckets, "band").select("band", "class", "hub", "n_bytes"))
    discard(buckets)
    # only the texts of classes that share a bucket are needed from here on
    texts = cut(fetch(classes.join(shared.select("class").distinct(), "class").select("class", "at.*")).select("class", "text"))
    discard()

    pairs = shared.filter("class <> hub").select("hub", "class").distinct()
    salts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("salts"))
    members = pairs.join(salts, "hub").select("hub", F.pmod(F.xxhash64("class"), "salts").alias("salt"), "class", F.lit(1).alias("member"))
    hubs = salts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("class"), F.lit(0).alias("member"))
    stars = members.unionByName(hubs).join(texts, "class").select("hub", "salt", "member", F.col("class").alias("id"), "text")
    links = cut(spread(stars, "hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(_verify_stars, "u long, v long"))
    joined = components(links)

    # the hub has been compared with all others of its buckets; what is left are buckets where those lie in several components
    labelled = shared.filter("class <> hub").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = (
        labelled.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.ceil(F.sum("n_bytes") / BLOCK_BYTES).alias("blocks")).filter("a < b").select("band", F.greatest("blocks", F.lit(1)).alias("blocks"))
    )
    other = F.col("other")
    blocked = (
        labelled.join(mixed, "band")
        .withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("band", F.least("block", other).alias("x"), F.greatest("block", other).alias("y"), "block", "component", "class")
    )
    dealt = spread(blocked.join(texts, "class").withColumnRenamed("class", "id"), "band", "x", "y").sortWithinPartitions("band", "x", "y", "id")
    more = cut(dealt.select("band", "x", "y", "block", "component", "id", "text").mapInArrow(_compare_blocks, "u long, v long"))
    if more.limit(1).count():
        before, joined = joined, components(links.union(more))
        discard(before)
    discard(shared, texts, links, more)
    named = joined.withColumnRenamed("node", "class")
    named._cut_path = joined._cut_path
    return classes, named


def near_duplicates(units: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component) for each row of ``units`` (id, text).

    component is the smallest id reachable over links, the unit's own id if there is none. Null or
    empty texts and texts without words link with nothing. Rows that repeat an id are compared each
    with its own text, and all get the id's smallest component of their own; a null id stays null and links
    with nothing. An empty table gives no rows. Other columns aren't read.
    """
    small_batches(units)
    units = units.select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from describe(batch.select(["id", "th"]), batch.column("text"), bands, rows)

    described = cut(units.mapInArrow(run, f"id long, th long, {DESCRIBED}"))
    usable = F.col("bands").isNotNull() & F.col("id").isNotNull()
    fetch = lambda wanted: units.join(wanted, ["id", "th"]).dropDuplicates(["class"])
    classes, joined = linked_classes(described.filter(usable), ["id", "th"], fetch)
    ids = classes.select("s1", "s2", "class", F.col("at.id").alias("least")).join(joined, "class", "left")
    # an unlinked class is its own component
    ids = ids.withColumn("component", F.coalesce("component", "class"))
    smallest = ids.groupBy("component").agg(F.min("least").alias("root"))
    of_class = ids.join(smallest, "component").select("s1", "s2", "root")
    linked = described.filter(usable).select("id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2"]).select("id", "n_shingles", F.col("root").alias("component"))
    alone = described.filter(~usable).select("id", "n_shingles", F.col("id").alias("component"))
    return linked.unionByName(alone)


def dedup(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document of ``docs`` (doc_id, text); see near_duplicates."""
    found = near_duplicates(docs.select(F.col("doc_id").alias("id"), "text"), bands, rows)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


__all__ = ["dedup", "describe", "linked_classes", "near_duplicates", "signatures"]
