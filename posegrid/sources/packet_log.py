"""A binary log of records as a Spark data source: spark.read.format("packetlog").load(path), df.write.format("packetlog").save(path).

A file is a 12-byte header (magic, version, flags) and records of kind (u8), length (u32, little-endian) and
payload. Doubles keep their bits. Reading goes record by record, so a file needn't fit in memory; a bad
header, a truncated record or a size that doesn't fit raises. Files are opened through pyarrow's file
systems where the path names one (s3, hdfs, gs), else as local or mounted paths.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# fixed values: header and record layout
MAGIC, VERSION = b"PGLOG\x00\x00\x01", 1
HEADER, RECORD = struct.Struct("<8sHH"), struct.Struct("<BI")
KINDS = {1: "keyframe", 2: "gnss", 3: "loop"}
POSE = struct.Struct("<qq7d")
SCHEMA = "kind string, id long, stamp_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
VALUES = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


class PacketLogError(ValueError):
    pass


def file_system(path: str):
    """(file system, path in it); local or mounted paths need no scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def encode(rows: Iterator) -> Iterator[bytes]:
    yield HEADER.pack(MAGIC, VERSION, 0)
    numbers = {v: k for k, v in KINDS.items()}
    for r in rows:
        payload = POSE.pack(r["id"], r["stamp_ns"], *(r[c] for c in VALUES))
        yield RECORD.pack(numbers[r["kind"]], len(payload)) + payload


def decode(stream) -> Iterator[tuple]:
    head = stream.read(HEADER.size)
    if len(head) < HEADER.size:
        raise PacketLogError("truncated header")
    magic, version, _ = HEADER.unpack(head)
    if magic != MAGIC:
        raise PacketLogError("bad magic")
    if version != VERSION:
        raise PacketLogError(f"unknown version {version}")
    while head := stream.read(RECORD.size):
        if len(head) < RECORD.size:
            raise PacketLogError("truncated record")
        kind, size = RECORD.unpack(head)
        if kind not in KINDS or size != POSE.size:
            raise PacketLogError("record of unknown kind or size")
        payload = stream.read(size)
        if len(payload) < size:
            raise PacketLogError("truncated record")
        yield (KINDS[kind], *POSE.unpack(payload))


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [File(self.path)]
        found = system.get_file_info(fs.FileSelector(path))
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [File(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".plog")]

    def read(self, partition: File) -> Iterator[tuple]:
        system, path = file_system(partition.path)
        with system.open_input_stream(path) as stream:
            yield from decode(stream)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        name = f"{path}/part-{uuid.uuid4().hex}"
        # a task that fails leaves no file that readers take
        with system.open_output_stream(name + ".tmp") as out:
            for piece in encode(rows):
                out.write(piece)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if self.overwrite else []
        for m in messages:
            if m and m.path:
                system.move(m.path + ".tmp", m.path + ".plog")
        # what was there before goes once the new files are all in place
        for f in found:
            if f.path.endswith(".plog"):
                system.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m and m.path:
                system.delete_file(m.path + ".tmp")


class PacketLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packetlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)
