"""Media columns: payloads kept as images in archive files, behind a Spark data source of our own.

A payload (UTF-8 text padded with zero bytes to a multiple of 64) is stored as the 8-bit grey samples of a PNG, 64 samples in
a row, rows unfiltered. An archive file holds members one after the other, then a directory in blocks (Arrow streams: id, offset,
length, CRC-32, unpadded size), one for the members that start in each RANGE_BYTES of the file, then a short list of the blocks
and a fixed footer that says where that list is. The folder's _archives.json, written when the whole job
commits, names the archives that count, so files of failed attempts don't.

Reading: the driver sees names and sizes only, and plans byte ranges over them. A task reads the blocks of the directory
that its range needs, takes the members that start in it, streams them in batches of bounded size, and checks each against its CRC; one that fails
is read again by its own offset, the file opened anew, before the task is given up.

Defined results: a null or empty text is 64 zero bytes; null and repeated doc_ids are kept as they are; an empty table gives
archives without members. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from loomspan.llm.common import BATCH_BYTES, Store, small_batches, work_folder
from loomspan.sources.tables import table

WIDTH = 64
#: Bytes of an archive that one partition reads, and attempts for each member.
RANGE_BYTES, ATTEMPTS = 32 << 20, 3
#: The file signature of PNG; our footer is the offset and length of the list of blocks, then a mark.
SIGNATURE, MARK, FOOTER = b"\x89PNG\r\n\x1a\n", b"LOOMARC2", struct.Struct("<QQ8s")
LIST = "_archives.json"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """An image of WIDTH grey samples a row; payload is a positive multiple of WIDTH bytes."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png made; a damaged one raises ValueError."""
    if media[:8] != SIGNATURE:
        raise ValueError("not an image of this kind")
    at, width, data = 8, 0, []
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4:at + 8]
        body = media[at + 8:at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows aren't read here")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean sample and an average hash: of 8 by 8 cells, those brighter than the whole."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    h, total = len(x), int(x.sum(dtype=np.int64))
    cum = np.concatenate((np.zeros((1, 8), np.int64), np.cumsum(x.reshape(h, 8, WIDTH // 8).sum(axis=2, dtype=np.int64), axis=0)))
    edge = np.arange(9) * h // 8
    cells, n = cum[edge[1:]] - cum[edge[:-1]], (edge[1:] - edge[:-1])[:, None] * (WIDTH // 8)
    bits = (cells.astype(object) * x.size > total * n.astype(object)).astype(bool).reshape(-1)
    return f"{h}x{WIDTH}:{total // x.size}:{np.packbits(bits).tobytes().hex()}"


@dataclass
class _Range(InputPartition):
    name: str
    start: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    name: str
    size: int
    members: int


def read_member(store: Store, name: str, offset: int, length: int, crc: int, attempts: int = ATTEMPTS, held: dict | None = None) -> bytes:
    """One member by its offset. A failed read or a wrong CRC opens the file anew and tries again."""
    held = {} if held is None else held
    for k in range(attempts):
        try:
            if "f" not in held:
                held["f"] = store.open(name)
            held["f"].seek(offset)
            data = bytes(held["f"].read(length))
            if len(data) == length and zlib.crc32(data) == crc:
                return data
            error = ValueError(f"{name}: the member at {offset} doesn't match its CRC")
        except OSError as e:
            error = e
        if f := held.pop("f", None):
            f.close()
    raise error


def directory(store: Store, name: str, start: int = 0, end: int | None = None) -> pa.Table:
    """The entries of an archive's members that start in [start, end): only the blocks that hold them are read."""
    with store.open(name) as f:
        f.seek(0, 2)
        f.seek(f.tell() - FOOTER.size)
        at, n, mark = FOOTER.unpack(bytes(f.read(FOOTER.size)))
        if mark != MARK:
            raise ValueError(f"{name} is no archive")
        f.seek(at)
        blocks, parts = json.loads(bytes(f.read(n))), []
        for k, (low, block, size) in enumerate(blocks):
            if (end is None or low < end) and (k + 1 == len(blocks) or blocks[k + 1][0] > start):
                f.seek(block)
                parts.append(pa.ipc.open_stream(bytes(f.read(size))).read_all())
        rows = pa.concat_tables(parts)
        offset = rows["offset"].to_numpy()
        a = int(np.searchsorted(offset, start))
        return rows.slice(a, (len(rows) if end is None else int(np.searchsorted(offset, end))) - a)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.range = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self):
        with Store(self.root).open(LIST) as f:
            listed = json.loads(bytes(f.read()))["archives"]
        return [_Range(name, a, a + self.range) for name, size in listed for a in range(0, max(size, 1), self.range)] or [_Range("", 0, 0)]

    def read(self, partition):
        if not partition.name:
            return
        store, held = Store(self.root), {}
        own = directory(store, partition.name, partition.start, partition.end)
        rows, media, size = 0, [], 0
        for o, n, c in zip(own["offset"].to_pylist(), own["length"].to_pylist(), own["crc"].to_pylist()):
            media.append(read_member(store, partition.name, o, n, c, held=held))
            size += n
            if size >= BATCH_BYTES:
                yield self._batch(own, rows, media)
                rows, media, size = rows + len(media), [], 0
        if media:
            yield self._batch(own, rows, media)
        if "f" in held:
            held["f"].close()

    @staticmethod
    def _batch(own: pa.Table, at: int, media: list[bytes]) -> pa.RecordBatch:
        part = own.slice(at, len(media)).combine_chunks()
        return pa.RecordBatch.from_arrays([part["id"].combine_chunks(), part["n_bytes"].combine_chunks(), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.root, self.ddl, self.overwrite = options["path"], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]):
        name, entries, at = f"{uuid.uuid4().hex}.arc", [], 0

        def parts():
            nonlocal at
            for b in iterator:
                media = b.column(2).to_pylist()
                lengths = np.array([len(x) for x in media], np.int64)
                offsets = at + np.cumsum(lengths) - lengths
                entries.append(pa.RecordBatch.from_arrays([b.column(0), pa.array(offsets), pa.array(lengths), pa.array([zlib.crc32(x) for x in media], pa.int64()), b.column(1)], names=["id", "offset", "length", "crc", "n_bytes"]))
                at += int(lengths.sum())
                yield from media
            place, blocks = at, []
            if entries:
                rows = pa.Table.from_batches(entries)
                block = rows["offset"].to_numpy() // RANGE_BYTES
                first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(rows) else np.zeros(1, np.int64)
                for a, z in zip(first.tolist(), [*first[1:].tolist(), len(rows)]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema) as w:
                        w.write_table(rows.slice(a, z - a))
                    data = sink.getvalue().to_pybytes()
                    blocks.append([int(block[a]) * RANGE_BYTES if len(rows) else 0, place, len(data)])
                    place += len(data)
                    yield data
            index = json.dumps(blocks).encode()
            yield index
            yield FOOTER.pack(place, len(index), MARK)

        Store(self.root).write(name, parts())
        return _Written(name, at, sum(len(e) for e in entries))

    def commit(self, messages):
        store, listed = Store(self.root), []
        if not self.overwrite:
            try:
                with store.open(LIST) as f:
                    listed = json.loads(bytes(f.read()))["archives"]
            except FileNotFoundError:
                pass
        listed += [[m.name, m.size] for m in messages if m is not None and m.members]
        store.write(LIST, [json.dumps({"schema": self.ddl, "archives": listed}).encode()])

    def abort(self, messages):
        """Files of a failed job aren't listed, and so are never read."""


class MediaArchive(DataSource):
    """format("media_archive"): columns doc_id (of any plain type), n_bytes long, media binary. Options: path, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self):
        with Store(self.options["path"]).open(LIST) as f:
            return json.loads(bytes(f.read()))["schema"]

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media for each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            data = [(t or "").encode() for t in b.column(1).to_pylist()]
            media = [to_png(x + bytes(-len(x) % WIDTH if x else WIDTH)) for x in data]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What is computed from the stored bytes as read back."""

    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for m in b.column(2).to_pylist():
                x = from_png(m)
                for k, v in zip(rows, (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), feature(x))):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in rows.items())], names=["doc_id", "n_bytes", *rows])

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media_archive(spark: SparkSession, root: str) -> DataFrame:
    """All documents as images in archives in the shared folder, read back by byte ranges; null texts count as empty ones."""
    spark.dataSource.register(MediaArchive)
    at = work_folder(spark, "media")
    to_media(table(spark, root, "documents")).write.format("media_archive").mode("append").option("path", at).save()
    return features(spark.read.format("media_archive").option("path", at).load())
