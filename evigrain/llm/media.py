"""Media columns: payloads kept as image members of archives, read by a Spark data source of their own.

``media_archive`` writes rows ``(member, media)`` into ZIP archives of bounded size, a few for each
task, and lists those of committed tasks in a manifest, so archives of lost or repeated tasks are
never read. Its reader plans byte ranges over the archives; a task reads the archive directory at
the end of its file, takes the members whose headers begin in its range, streams them in Arrow
batches, and tries each member again by its own offset when reading or its checksum fails.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from evigrain.llm.staging import new_path

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
TRIES = 4
MANIFEST = "_manifest.json"
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_image(data: bytes) -> bytes:
    """``data``, padded with zeros to a positive multiple of 64, as rows of an 8-bit grey PNG; its length is a text chunk."""
    height = max(1, -(-len(data) // WIDTH))
    padded = np.zeros((height, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    padded[:, 1:] = np.frombuffer(data.ljust(height * WIDTH, b"\0"), np.uint8).reshape(height, WIDTH)
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)), (b"tEXt", b"Bytes\0%d" % len(data)), (b"IDAT", zlib.compress(padded.tobytes(), 3)), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(x)) + kind + x + struct.pack(">I", binascii.crc32(kind + x)) for kind, x in chunks)


def decode_image(media: bytes) -> tuple[bytes, int]:
    """The padded payload and its length without padding."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, found = 8, {}
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        found[kind] = found.get(kind, b"") + media[at + 8 : at + 8 + size]
        at += 12 + size
    width, height = struct.unpack_from(">II", found[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only rows with filter type 0 are supported")
    return rows[:, 1:].tobytes(), int(found[b"tEXt"].split(b"\0")[1])


def features(payload: bytes) -> str:
    """Mean, standard deviation, range, entropy in bits and number of distinct values of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = len(payload), np.arange(256)
    mean = float(counts @ values) / n
    deviation = max(0.0, float(counts @ (values * values)) / n - mean * mean) ** 0.5
    there = np.flatnonzero(counts)
    share = counts[there] / n
    return f"mean={mean:.6f};std={deviation:.6f};min={there[0]};max={there[-1]};entropy={float(-(share * np.log2(share)).sum()):.6f};distinct={len(there)}"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Written(WriterCommitMessage):
    archives: list


@dataclass
class _Range(InputPartition):
    archive: str
    begin: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        archives, out, used = [], None, 0
        for batch in iterator:
            for member, media in zip(batch.column("member"), batch.column("media"), strict=True):
                if out is None or used > ARCHIVE_BYTES:
                    if out:
                        out.close()
                        stream.close()
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
                    stream, used = files.open_output_stream(f"{root}/{name}"), 0
                    out = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    archives.append(name)
                data = media.as_py()
                out.writestr(zipfile.ZipInfo(member.as_py()), data)
                used += len(data) + 100
        if out:
            out.close()
            stream.close()
        return _Written([(name, files.get_file_info(f"{root}/{name}").size) for name in archives])

    def commit(self, messages: list) -> None:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list) -> None:
        files, root = _filesystem(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                files.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        files, root = _filesystem(self.path)
        if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with files.open_input_stream(f"{root}/{MANIFEST}") as f:
                archives = json.loads(f.read())
        else:
            archives = [(x.base_name, x.size) for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".zip")]
        return [_Range(name, at, at + self.range_bytes) for name, size in archives for at in range(0, size, self.range_bytes)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, root = _filesystem(self.path)
        opened = lambda: files.open_input_file(f"{root}/{partition.archive}")
        stream = opened()
        with zipfile.ZipFile(stream) as archive:
            members = sorted((m for m in archive.infolist() if partition.begin <= m.header_offset < partition.end), key=lambda m: m.header_offset)
        rows, held = [], 0
        for m in members:
            for attempt in range(TRIES):
                try:
                    data = _member_at(stream, m)
                    break
                except (OSError, ValueError, struct.error):
                    if attempt == TRIES - 1:
                        raise
                    time.sleep(0.1 * 2**attempt)
                    stream = opened()
            rows.append((m.filename, partition.archive, m.header_offset, data))
            held += len(data)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _member_at(stream: pa.NativeFile, member: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes, read at its offset and held against its checksum."""
    stream.seek(member.header_offset)
    head = stream.read(30)
    name, extra = struct.unpack_from("<HH", head, 26)
    stream.seek(member.header_offset + 30 + name + extra)
    data = stream.read(member.compress_size)
    if len(data) != member.compress_size or binascii.crc32(data) != member.CRC:
        raise ValueError(f"{member.filename} at {member.header_offset} is damaged")
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    member, archive, offset, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(member), pa.array(archive), pa.array(offset, pa.int64()), pa.array(media, pa.binary())], names=["member", "archive", "offset", "media"])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(path)``; options: ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member string, archive string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def store_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image member below ``path`` and return the archives' rows, read back.

    A null text counts as empty. A row's member is named by its id (``null`` for none), so the
    archives hold as many members as ``df`` has rows, repeated rows too.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names = ["null" if i is None else str(i) for i in part.column(0).to_pylist()]
                media = [encode_image((t or "").encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["member", "media"])

    spark = df.sparkSession
    spark.dataSource.register(MediaArchive)
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(encoded, "member string, media binary")
    rows.write.format("media_archive").mode("append").save(path)
    return spark.read.format("media_archive").load(path)


def media_features(members: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths, digests, checksum and sample features of each member's payload, as decoded."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, size = decode_image(media)
                rows.append((None if name == "null" else int(name), size, len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    n, s = pa.int64(), pa.string()
    kinds, names = [n, n, n, s, n, n, s, s], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = ", ".join(f"`{x}` {'long' if k == n else 'string'}" for x, k in zip(names, kinds, strict=True))
    return members.select("member", "media").mapInArrow(decoded, schema)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts in archives in the shared folder, read them back and describe them: one row per row of ``df``.

    Null and empty texts are one row of 64 zero bytes with ``n_bytes`` 0; texts of any length are
    whole; repeated rows give repeated, equal rows; other columns aren't read; an empty table gives
    an empty result.
    """
    return media_features(store_texts(df, new_path(df.sparkSession, "media"), id_col, text_col), id_col)
