"""Media columns: texts as images in archives, read back by a Spark data source over byte ranges.

Writers put each payload as an 8-bit grey PNG, 192 samples a row, into ZIP archives in the shared folder; a manifest names the
archives of the attempts that succeeded. The source plans byte ranges over those archives. A task takes the members
whose header lies in its range, one batch at a time, and reads a member again, by its offset, when it comes broken.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_folder, ship

WIDTH = 192
#: An archive is closed at this size; bounds a writer's memory.
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
#: Ranges grow rather than that there are more tasks than this to plan in the driver.
MOST_TASKS = 50_000
RETRIES = 4
SCHEMA = "doc_id long, archive string, member_offset long, n_bytes long, payload binary, media binary"
MAGIC = b"\x89PNG\r\n\x1a\n"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with blanks up to a positive multiple of the width."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(n_bytes: int, data: bytes) -> bytes:
    """A PNG of the payload; the length before padding is in a text chunk."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[int, bytes]:
    """Length before padding, and the samples; ValueError if anything is broken."""
    if media[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, n, lines = 8, None, b""
    while at + 12 <= len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"broken chunk {kind!r}")
        if kind == b"tEXt":
            n = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            lines += data
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(lines), np.uint8).reshape(-1, WIDTH + 1)
    if n is None or rows[:, 0].any():
        raise ValueError("not one of ours")
    return n, rows[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit difference hash of their column and row means."""
    a = np.frombuffer(data, np.uint8)
    p = np.bincount(a, minlength=256) / len(a)
    p = p[p > 0]
    cells = a.reshape(-1, WIDTH).mean(axis=0).reshape(64, 3).mean(axis=1)
    bits = np.packbits(cells > np.roll(cells, 1)).tobytes().hex()
    return f"{a.mean():.4f}:{a.std():.4f}:{-(p * np.log2(p)).sum():.4f}:{bits}"


def write(docs: DataFrame, folder: str) -> int:
    """Writes the texts of docs into archives in folder, then their manifest; number of members."""
    ship(docs.sparkSession)
    kind = pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])
    system, path = place(folder)
    system.create_dir(path, recursive=True)

    def run(batches):
        system, path = place(folder)
        buffer, archive, members = io.BytesIO(), None, 0

        def close():
            archive.close()
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(buffer.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([buffer.tell()], pa.int64()), pa.array([members], pa.int64())], schema=kind)

        for batch in batches:
            for i in range(batch.num_rows):
                if archive is None:
                    buffer, members = io.BytesIO(), 0
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                archive.writestr(zipfile.ZipInfo(f"{'' if doc_id is None else doc_id}~{members}.png"), encode(*payload(text)))
                members += 1
                if buffer.tell() >= ARCHIVE_BYTES:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    rows = docs.select("doc_id", "text").mapInArrow(run, "archive string, bytes long, members long").collect()  # one row an archive
    with system.open_output_stream(f"{path}/_manifest") as out:
        out.write(json.dumps([[r.archive, r.bytes] for r in rows]).encode())
    return sum(r.members for r in rows)


class Ranges(InputPartition):
    """(archive, start, end) of what one task reads."""

    def __init__(self, pieces: list[tuple[str, int, int]]) -> None:
        super().__init__(pieces)
        self.pieces = pieces


def planned(archives: list[tuple[str, int]], step: int, most: int = MOST_TASKS) -> list[list[tuple[str, int, int]]]:
    """Byte ranges of archives, laid end to end and cut every step bytes, or wider so that there are no more than most."""
    step = max(step, -(-sum(size for _, size in archives) // most))
    out: list[list[tuple[str, int, int]]] = []
    left = 0
    for name, size in archives:
        at = 0
        while at < size:
            if not left:
                out.append([])
                left = step
            n = min(left, size - at)
            out[-1].append((name, at, at + n))
            at, left = at + n, left - n
    return out


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.step = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        system, path = place(self.folder)
        with system.open_input_stream(f"{path}/_manifest") as f:
            archives = json.loads(f.read())
        return [Ranges(pieces) for pieces in planned(archives, self.step)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, path = place(self.folder)
        for archive, start, end in partition.pieces:
            yield from read_range(system, f"{path}/{archive}", archive, start, end)


def read_range(system: fs.FileSystem, name: str, archive: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """The members whose header lies in a range of an archive."""
    opener = lambda: system.open_input_file(name)
    with opener() as f, zipfile.ZipFile(f) as z:
        members = [(m.header_offset, m.filename, m.compress_size, m.CRC) for m in z.infolist() if start <= m.header_offset < end]
    rows, held = [], 0
    with opener() as f:
        for at, member, size, crc in members:
            n, data, media = read_member(f, opener, at, size, crc)
            rows.append((int(x) if (x := member.partition("~")[0]) else None, archive, at, n, data, media))
            held += len(data) + len(media)
            if held >= BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
    if rows:
        yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("archive", pa.string()), ("member_offset", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def read_member(f, opener, at: int, size: int, crc: int, wait: float = 0.2) -> tuple[int, bytes, bytes]:
    """Length, samples and stored bytes of the member at an offset; a broken read is repeated on a file opened anew, and
    the last error is raised: members are never left out."""
    for attempt in range(RETRIES + 1):
        try:
            source = f if not attempt else opener()
            try:
                source.seek(at)
                head = source.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError(f"no member at {at}")
                source.seek(at + 30 + sum(struct.unpack_from("<HH", head, 26)))
                media = source.read(size)
                if len(media) != size or zlib.crc32(media) != crc:
                    raise ValueError(f"broken member at {at}")
                return *decode(media), media
            finally:
                if attempt:
                    source.close()
        except (OSError, ValueError, zlib.error):
            if attempt == RETRIES:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarnfield_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaSource)
    return spark.read.format("tarnfield_media").option("rangebytes", str(range_bytes)).load(folder)


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs, from what is read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature.

    Null texts are as empty ones: one row of 192 blanks. Rows without doc_id and repeated rows have members of their own.
    An empty table gives none; columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    write(docs, folder := new_folder(spark, "media"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, n, data, media in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return read(spark, folder).select("doc_id", "n_bytes", "payload", "media").mapInArrow(run, schema)
