"""Exact removal of repeated byte strings by a hash-compared suffix sort.

All suffixes of a corpus can't be sorted together, but those that can share a string of ``LENGTH``
bytes meet by content: the gram with the least hash in a window (its anchor) is the same wherever the
window's bytes stand. So only anchors are shuffled, anchors that occur once are dropped, and the suffixes
that start in the windows of a shared anchor are sorted together. Suffixes are compared by their longest
common extension, found by binary search over prefix polynomial hashes, in a bottom-up mergesort whose
merges are done by binary search too; neighbours that agree over the whole length are verified byte by byte.

Equal surroundings (whole copies) are counted once and never sorted: windows of one anchor with equal
bytes are a class, combined before anything else is moved. Members of a class are confirmed by a 128-bit
BLAKE2b digest of their bytes beside the anchor's hash, so that copies needn't be moved to be compared.
An anchor with too many classes for one task is divided: halves of its range of windows meet again by the
bytes that all windows of the half have in common, until each group is small enough to be sorted.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, discard, leftmost_least, small_batches, spread, text_blocks, utf8
from .fingerprints import LEAST_KEY
from .prefix_hash import PrefixHash

LENGTH = 400
GRAM = 64
#: Distinct surroundings of one anchor that are sorted in one task; an anchor with more is divided.
SORTED = 2048
BATCH_BYTES = 1 << 20
CONTEXT = [("ah", pa.int64()), ("m", pa.int64()), ("single", pa.bool_()), ("key", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("hi", pa.int32()), ("lo", pa.int32()), ("bytes", pa.binary())]
SPANS = "key long, th long, start int, end int"
HALF = pa.schema([
    ("ah", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("single", pa.bool_()), ("key", pa.int64()), ("th", pa.int64()),
    ("start", pa.int32()), ("hi", pa.int32()), ("lo", pa.int32()), ("bytes", pa.binary()),
])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, first window, last window, gram hash) of each anchor; places and windows as offsets into ``data``.

    Each window of ``length`` bytes that lies in one row belongs to exactly one anchor, the leftmost
    of the grams with the least hash in it.
    """
    empty = np.zeros(0, np.int64)
    n, many = len(data), length - gram + 1
    if n < length:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    prefix = PrefixHash(data)
    at = np.arange(n - gram + 1)
    hashes = prefix.spans(at, at + gram)
    starts = n - length + 1
    least = leftmost_least(hashes, many)
    window = np.arange(starts)
    row = np.searchsorted(offsets, window, "right") - 1
    inside = window + length <= offsets[row + 1]
    window, least, row = window[inside], least[inside], row[inside]
    if not len(window):
        return empty, empty, empty, empty, empty.astype(np.uint64)
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(window)) - 1
    return row[head], least[head], window[head], window[tail], hashes[least[head]]


class Suffixes:
    """Suffixes of ``data`` that end at given places, compared through prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.prefix = np.concatenate([data, np.zeros(8, np.uint8)]), PrefixHash(data)
        self.words = np.ndarray(len(data) + 1, ">u8", self.data, strides=(1,))

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self.prefix.common_extension(a, b, most)

    def compare(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: order of data[a:a_end] and data[b:b_end]; a string comes after its own beginnings."""
        most = np.minimum(a_end - a, b_end - b)
        x, y = self.words[a], self.words[b]
        out = np.where(x < y, -1, 1)
        todo = np.flatnonzero((x == y) | (most < 8))
        if len(todo):
            a, b, most = a[todo], b[todo], most[todo]
            ext = self.extension(a, b, most)
            inner = np.minimum(ext, np.maximum(most - 1, 0))
            by_end = np.sign((a_end[todo] - a) - (b_end[todo] - b))
            out[todo] = np.where(ext >= most, by_end, np.where(self.data[a + inner] < self.data[b + inner], -1, 1))
        return out

    def sort(self, starts: np.ndarray, ends: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Order that sorts the suffixes within each segment (ascending numbers).

        Bottom-up mergesort: all runs of all segments are merged at once, each element finding its rank
        in the other run by binary search.
        """
        n = len(starts)
        order = np.arange(n)
        if not n:
            return order
        head = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]]))
        size = np.diff(np.append(head, n))
        first, count = np.repeat(head, size), np.repeat(size, size)
        inner = np.arange(n) - first
        width = 1
        while width < size.max():
            active = np.flatnonzero(count > width)
            k, start, end = inner[active], first[active], first[active] + count[active]
            run = k // width
            other = start + (run ^ 1) * width
            low, high = np.minimum(other, end), np.minimum(other + width, end)
            base, right, own = low.copy(), run % 2 == 1, order[active]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                x, y = order[mid], own[open_]
                sign = self.compare(starts[x], ends[x], starts[y], ends[y])
                before = (sign < 0) | (right[open_] & (sign == 0))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            merged = order.copy()
            merged[start + (run // 2) * 2 * width + (k - run * width) + (low - base)] = own
            order = merged
            width *= 2
        return order


def _left_over(context: np.ndarray, low: np.ndarray, high: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(context, distance) of the distances from bounds[0] to bounds[1] of each context that no interval (context, low, high) covers."""
    a, b = bounds
    many = np.maximum(b - a + 1, 0)
    begin = np.concatenate([[0], np.cumsum(many)])
    # a difference array over all contexts' distances, laid one after the other
    edge = np.zeros(begin[-1] + 1, np.int64)
    low, high = np.maximum(low, a[context]), np.minimum(high, b[context])
    good = low <= high
    context, low, high = context[good], low[good], high[good]
    np.add.at(edge, begin[context] + low - a[context], 1)
    np.add.at(edge, begin[context] + high - a[context] + 1, -1)
    free = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    of = np.searchsorted(begin, free, "right") - 1
    return of, free - begin[of] + a[of]


def _later(data: np.ndarray, prefix: PrefixHash, anchor: np.ndarray, group: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the intervals ``found`` that equal one of a context with a smaller rank, as intervals."""
    context, low, high = found
    many = high - low + 1
    begin = np.cumsum(many) - many
    pair = np.unique(np.repeat(context * (length + 1) + low - begin, many) + np.arange(many.sum()))
    of, distance = pair // (length + 1), pair % (length + 1)
    place = anchor[of] - distance
    hashes = prefix.spans(place, place + length)
    by = np.lexsort((rank[of], hashes, distance, group[of]))
    of, distance, place, hashes = of[by], distance[by], place[by], hashes[by]
    new = np.ones(len(of), bool)
    new[1:] = (group[of[1:]] != group[of[:-1]]) | (distance[1:] != distance[:-1]) | (hashes[1:] != hashes[:-1])
    head = np.flatnonzero(new)
    least, later = head[np.cumsum(new) - 1], np.flatnonzero(~new)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    # equal hashes are verified byte by byte
    same = [np.all(windows[place[part]] == windows[place[least[part]]], axis=1) for part in np.array_split(later, len(later) // 8192 + 1)]
    pair = np.sort((of * (length + 1) + distance)[later[np.concatenate(same)]])
    if not len(pair):
        return pair, pair, pair
    edge = np.flatnonzero(np.diff(pair) != 1) + 1
    a, b = pair[np.concatenate([[0], edge])], pair[np.append(edge, len(pair)) - 1]
    return a // (length + 1), a % (length + 1), b % (length + 1)


def repeated_windows(contexts: list[bytes], group: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, low, high): intervals of distances from the anchor at which a context's window equals one of another context of its group.

    With ``place``, only those that equal a window of a context with a smaller place, so that of equal windows one is left out.

    Context i holds the windows that start last[i] to first[i] bytes before its anchor; windows can be equal only at
    equal distances. The suffixes that start at the anchors are sorted, to the right and (reversed) to the left.
    A context's neighbours in either order have its longest extensions R and L, and share all windows from
    length - R to L with it. What lies between the greatest R and the greatest L but in no neighbour's interval
    (seldom more than a few windows) is sorted window by window.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    begin = np.cumsum(size) - size
    anchor, end = begin + first, begin + size
    right, left = Suffixes(data), Suffixes(np.ascontiguousarray(data[::-1]))
    n = len(data)
    # the byte before place x is at n - x in the reversed array
    ways = ((right, anchor, end), (left, n - anchor, n - begin))
    order = np.argsort(group, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    reach = []
    for side, starts, ends in ways:
        rank = order[side.sort(starts[order], ends[order], group[order])]
        near = np.flatnonzero(group[rank[:-1]] == group[rank[1:]])
        i, j = rank[near], rank[near + 1]
        ext = [s.extension(a[i], a[j], np.minimum(e[i] - a[i], e[j] - a[j])) for s, a, e in ways]
        most = np.zeros(len(contexts), np.int64)
        np.maximum.at(most, i, ext[len(reach)])
        np.maximum.at(most, j, ext[len(reach)])
        reach.append(most)
        low, high = np.maximum(length - ext[0], np.maximum(last[i], last[j])), np.minimum(ext[1], np.minimum(first[i], first[j]))
        good = np.flatnonzero(low <= high)
        # equal hashes are verified byte by byte
        same = [contexts[i[g]][first[i[g]] - high[g] : first[i[g]] - low[g] + length] == contexts[j[g]][first[j[g]] - high[g] : first[j[g]] - low[g] + length] for g in good.tolist()]
        good = good[np.array(same, bool)]
        found += [(i[good], low[good], high[good]), (j[good], low[good], high[good])]
    context, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
    bounds = np.maximum(length - reach[0], last), np.minimum(reach[1], first)
    of, distance = _left_over(context, low, high, bounds)
    if len(of):
        # all windows of the group at those distances, where both sides reach far enough
        key = np.unique(group[of] * (length + 1) + distance)
        g, a = key // (length + 1), key % (length + 1)
        ends_ = np.searchsorted(group[order], g, "left"), np.searchsorted(group[order], g, "right")
        many = ends_[1] - ends_[0]
        row = order[np.repeat(ends_[0] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        dist, segment = np.repeat(a, many), np.repeat(np.arange(len(key)), many)
        keep = (dist >= bounds[0][row]) & (dist <= bounds[1][row])
        row, dist, segment = row[keep], dist[keep], segment[keep]
        places = anchor[row] - dist
        by = right.sort(places, places + length, segment)
        near = np.flatnonzero(segment[by[:-1]] == segment[by[1:]])
        x, y = by[near], by[near + 1]
        same = right.prefix.equal(places[x], places[y], np.full(len(x), length))
        x, y = x[same], y[same]
        real = np.array([data[p : p + length].tobytes() == data[q : q + length].tobytes() for p, q in zip(places[x].tolist(), places[y].tolist(), strict=True)], bool)
        hit = np.unique(np.concatenate([x[real], y[real]])) if len(x) else x
        context, low, high = np.concatenate([context, row[hit]]), np.concatenate([low, dist[hit]]), np.concatenate([high, dist[hit]])
    if place is None or not len(context):
        return context, low, high
    return _later(data, right.prefix, anchor, group, (context, low, high), place, length)


def _digest(raw: bytes, distance: int) -> bytes:
    """128 bits for the bytes around an anchor that is ``distance`` bytes from their start."""
    return hashlib.blake2b(raw, digest_size=16, salt=distance.to_bytes(4, "little")).digest()


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """Digests as two columns of 64-bit integers."""
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sorted_most: int = SORTED, keep_first: bool = False) -> DataFrame:
    """Find in ``docs`` (doc_id, text) each byte covered by a ``length``-byte string that also starts anywhere else.

    Returns key, th (id and text hash, as given by ``with_key``) and spans (start, end in UTF-8 bytes; they may
    overlap, see ``merge``) of the documents that have any. Null or short texts have none; a row that comes twice is a
    repeat; rows that share an id but not the text are apart; a null id is as good as any other.

    With ``keep_first`` each string stays where it stands first (by id, then text hash and place) and counts only
    elsewhere; rows that repeat id and text are one document then.
    """
    small_batches(docs)
    docs = with_key(docs.select("doc_id", "text")).select("key", "th", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_blocks(batch.column("text")):
                row, place, first, last, hashes = anchors(data, offsets, length, gram)
                if not len(row):
                    continue
                raw, begin = data.tobytes(), offsets[row]
                digests = _halves([_digest(raw[s:e], d) for s, e, d in zip(first.tolist(), (last + length).tolist(), (place - first).tolist(), strict=True)])
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)), *digests, batch.column("key").slice(at, to - at).take(of), batch.column("th").slice(at, to - at).take(of),
                        pa.array((place - begin).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array((place - last).astype(np.int32)),
                    ],
                    ["ah", "c1", "c2", "key", "th", "pos", "hi", "lo"],
                )

    found = cut(docs.mapInArrow(find, "ah long, c1 long, c2 long, key long, th long, pos int, hi int, lo int"))
    # written first, so that the join's sides are plain tables and Spark can split the partitions of very common anchors
    shared = cut(found.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ah"))
    every, found = found, cut(found.join(shared, "ah"))
    discard(every, shared)
    place = F.struct("key", "th", "pos", "hi", "lo")
    kind = ["ah", "c1", "c2"]
    classes = cut(found.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")))
    # whole classes of equal surroundings: every window in them is repeated
    copies = found.join(classes.filter("n > 1").select(*kind, "at"), kind).filter(place != F.col("at") if keep_first else F.lit(True))
    spans = [copies.select("key", "th", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("end"))]

    # the others are compared with one of each class of their anchor
    groups = classes.groupBy("ah").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1" if keep_first else "m > 1 and least = 1").select("ah", "m")
    wanted = classes.join(groups, "ah").select("ah", "m", (F.lit(keep_first) | (F.col("n") == 1)).alias("single"), "at.*")
    by_doc = wanted.groupBy("key", "th").agg(F.collect_list(F.struct("ah", "m", "single", "pos", "hi", "lo")).alias("places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows: list[tuple] = []
            for i, (key, th, places) in enumerate(zip(batch.column("key").to_pylist(), batch.column("th").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                for p in places:
                    s = p["pos"] - p["hi"]
                    rows.append((p["ah"], p["m"], p["single"], key, th, s, p["hi"], p["lo"], data[offsets[i] + s : offsets[i] + p["pos"] - p["lo"] + length].tobytes()))
                    if len(rows) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema(CONTEXT))
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema(CONTEXT))

    distinct = docs.dropDuplicates(["key", "th"]) if keep_first else docs
    contexts = distinct.join(by_doc, ["key", "th"]).select("key", "th", "text", "places").mapInArrow(read, "ah long, m long, single boolean, key long, th long, start int, hi int, lo int, bytes binary")
    contexts = cut(contexts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            ah, single, key, th, start, hi, lo = (np.array([r[c] for r in rows]) for c in range(7))
            rank = np.argsort(np.lexsort((start + hi, th, key))) if keep_first else None
            of, low, high = repeated_windows([r[-1] for r in rows], np.unique(ah, return_inverse=True)[1], hi, lo, length, rank)
            of, low, high = (c[single[of]] for c in (of, low, high))
            anchor = start[of] + hi[of]
            yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(th[of]), pa.array(anchor - high, pa.int32()), pa.array(anchor - low + length, pa.int32())], ["key", "th", "start", "end"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ah", "single", "key", "th", "start", "hi", "lo", "bytes")]
            for r in zip(*columns, strict=True):
                if size > BATCH_BYTES and held[-1][0] != r[0]:
                    yield from done(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[-1])
        if held:
            yield from done(held)

    few, large = [contexts.filter(F.col("m") <= sorted_most)], contexts.filter(F.col("m") > sorted_most)
    large = large.withColumn("a", F.lit(0)).withColumn("b", F.lit(length - gram))
    while not large.isEmpty():
        more, small, large = _divided(large, length, sorted_most, keep_first)
        spans.append(more)
        few.append(small)
    for part in few:
        dealt = spread(part, "ah").sortWithinPartitions("ah")
        spans.append(dealt.select("ah", "single", "key", "th", "start", "hi", "lo", "bytes").mapInArrow(compare, SPANS))
    return functools.reduce(DataFrame.unionByName, spans).groupBy("key", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _divided(contexts: DataFrame, length: int, sorted_most: int, keep_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans found, contexts in groups that can be sorted, contexts in groups that are still too large).

    Windows at distances a to b from the anchor have the bytes from a before it to ``length`` - b behind it in
    common. Each half of a group's distances is divided by those bytes, so equal windows stay together; contexts
    that are equal over all their windows in the half become one class again. A half of one distance has
    whole windows for a key, so at most as many rounds as ``length`` has binary digits are needed.
    """
    kind = "ah long, a int, b int, c1 long, c2 long, single boolean, key long, th long, start int, hi int, lo int, bytes binary"

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                middle = (r["a"] + r["b"]) // 2
                for a, b in ((r["a"], middle), (middle + 1, r["b"])):
                    lo, hi = max(a, r["lo"]), min(b, r["hi"])
                    if lo > hi:
                        continue
                    at = r["hi"]
                    own, core = r["bytes"][at - hi : at - lo + length], r["bytes"][at - a : at - b + length]
                    group = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=f"{r['ah']} {a} {b}".encode()).digest(), "little", signed=True)
                    rows.append((group, a, b, *np.frombuffer(_digest(own, hi), np.int64).tolist(), r["single"], r["key"], r["th"], r["start"] + at - hi, hi, lo, own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), HALF.types, strict=True)], schema=HALF)

    halves = cut(contexts.select("ah", "a", "b", "single", "key", "th", "start", "hi", "lo", "bytes").mapInArrow(halve, kind))
    same, place = ["ah", "c1", "c2"], F.struct("key", "th", "start", "hi", "lo")
    classes = cut(halves.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"), F.min("single").alias("alone")))
    joined = halves.join(classes, same)
    spans = joined.filter("n > 1 and single").filter(place != F.col("at") if keep_first else F.lit(True))
    spans = spans.select("key", "th", "start", (F.col("start") + F.col("hi") - F.col("lo") + length).alias("end"))
    groups = classes.groupBy("ah").agg(F.count(F.lit(1)).alias("m"), F.max(F.lit(keep_first) | ((F.col("n") == 1) & F.col("alone"))).alias("open")).filter("m > 1 and open").select("ah", "m")
    least = joined.filter(place == F.col("at")).withColumn("single", F.lit(keep_first) | (F.col("alone") & (F.col("n") == 1)))
    left = cut(least.join(groups, "ah").select("ah", "m", "single", "key", "th", "start", "hi", "lo", "bytes", "a", "b"))
    return spans, left.filter(F.col("m") <= sorted_most).drop("a", "b"), left.filter(F.col("m") > sorted_most)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def with_key(docs: DataFrame) -> DataFrame:
    """Add key (the id, the least long for null) and th (a hash of the text), and make null text empty."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_KEY))).withColumn("th", F.xxhash64("text"))


def snap(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans drawn in to whole characters, so that what is left stays valid UTF-8."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def _rows(text: pa.Array, spans: pa.Array) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Bytes and merged spans of each row, one after the other."""
    data, offsets = utf8(text)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
    flat = spans.flatten()
    start, end = (flat.field(c).to_numpy() for c in ("start", "end"))
    for i, to in enumerate(ends.tolist()):
        at = int(ends[i - 1]) if i else 0
        yield data[offsets[i] : offsets[i + 1]].tobytes(), merge(list(zip(start[at:to].tolist(), end[at:to].tolist(), strict=True)))


@F.arrow_udf(StringType())
def cut_out(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the bytes of their spans, whole characters only."""
    return pa.array([_kept(raw, snap(raw, own)).decode() for raw, own in _rows(text, spans)], pa.string())


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document; see remove_repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(raw), sum(e - s for s, e in own), len(own), hashlib.sha256(_kept(raw, own) if own else raw).hexdigest()) for raw, own in _rows(batch.column("text"), batch.column("spans"))]
            if rows:
                n, gone, many, sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "text", "key", "th")
    joined = rows.join(remove_repeats(docs, length), ["key", "th"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text``, whole characters only; null texts and other columns stay as they are. See remove_repeats."""
    spans = remove_repeats(docs, length, gram, keep_first=keep_first).select(F.col("key").alias("_key"), F.col("th").alias("_th"), F.col("spans").alias("_spans"))

    rows = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_KEY))).withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(spans, ["_key", "_th"], "left")
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut_out("text", "_spans"))).select(*docs.columns)


__all__ = ["anchors", "cut_out", "digest", "merge", "remove_repeats", "repeated_windows", "strip"]
