"""Small helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BATCH_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, which has one machine, may go without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="posegrid-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing that is still to be computed reads them.

    Spark deletes the shuffle files of finished steps only when the driver collects its garbage, so that is asked for too.
    """
    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in tables:
        path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def small_batches(df: DataFrame) -> None:
    """Texts go to Python workers a few megabytes at a time, however long they are, unless the session asks for less already."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns asked for, of the whole table."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids give -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1).cast("long"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal ``df`` out by ``keys`` to as many partitions as shuffles have."""
    return df.repartition(partitions(df.sparkSession), *keys)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offsets of its rows, without a copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def leftmost_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` values in a row, the place of the leftmost with the least scrambled upper half."""
    n = len(hashes)
    # scrambled upper bits decide, then the place; one minimum gives both
    key = ((hashes * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width + width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks, starts = padded.reshape(-1, width), max(0, n - width + 1)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def row_blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or of one longer row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def text_blocks(column: pa.Array, limit: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for each block of rows."""
    data, offsets = utf8(column)
    for at, to in row_blocks(offsets, limit):
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``, or run of bytes that aren't ``between``; words end where their row ends."""
    keep = np.zeros(len(data) + 2, bool)
    keep[1:-1] = ~between[data]
    first, last = keep[1:-1] & ~keep[:-2], keep[1:-1] & ~keep[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = keep[1:-1][inner]
    last[inner - 1] = keep[1:-1][inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def per_row(values: np.ndarray, starts: np.ndarray, ufunc: np.ufunc = np.add, empty=0) -> np.ndarray:
    """ufunc over values[starts[i]:starts[i + 1]] for each row; rows without values give ``empty``."""
    n = len(starts) - 1
    out = np.full(n, empty, dtype=values.dtype if ufunc is not np.add or values.dtype != bool else np.int64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values if values.dtype != bool else values.astype(np.int64), starts[full])
    return out


class WordMemo(dict):
    """What has been worked out for each word, for at most ``limit`` words. When it is full, only words that were asked for again stay."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.again = limit, set()

    def unknown(self, words: set[str]) -> list[str]:
        """The words that are still to be worked out; all others of ``words`` are kept."""
        known = words & self.keys()
        new = words - known
        self.again |= known
        if len(self) + len(new) > self.limit:
            stay = {w: self[w] for w in (self.again if len(self.again) < self.limit // 2 else known)}
            self.clear()
            self.update(stay)
            self.again = set(known)
        return list(new)
