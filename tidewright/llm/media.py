"""Texts as media: PNG images of 192 8-bit samples a row, stored in ZIP archives, and a data source that reads the archives back.

Writing: each task writes its rows to archives of ARCHIVE_BYTES in the shared folder under names of their own, and reports them; archives of
failed or repeated attempts aren't reported and hence never read. Reading: the source plans byte ranges over the archives' sizes; a
task opens its archive's directory at the end of the file, takes the members whose headers begin in its range, and
yields their payloads in bounded Arrow batches. A member that can't be read, or whose checksum differs, is fetched again by its offset alone; after
TRIES attempts the task fails, so no member is ever left out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewright.llm.core import Scratch, col, prepare

SAMPLES, LEVEL = 192, 4
RANGE_BYTES, BATCH_BYTES, TRIES = 32 << 20, 4 << 20, 3
#: A task begins another archive beyond this size: each range reads its archive's whole directory.
ARCHIVE_BYTES = 512 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- the stored form


def padded(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of SAMPLES bytes."""
    return text + b" " * (SAMPLES - len(text) % SAMPLES if len(text) % SAMPLES or not text else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """A grey image with a sample of 8 bits for each byte, SAMPLES a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, SAMPLES)
    lines = np.zeros((len(rows), SAMPLES + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png wrote; checks every chunk's checksum."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, width, packed = 8, 0, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, standard deviation and entropy of the samples, and the share of each sixteenth of their range."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / counts.sum()
    levels = np.arange(256)
    mean = float((share * levels).sum())
    deviation = float(np.sqrt((share * (levels - mean) ** 2).sum()))
    used = share[share > 0]
    entropy = float(-(used * np.log2(used)).sum())
    return f"{mean:.4f};{deviation:.4f};{entropy:.4f};" + ",".join(f"{x:.4f}" for x in share.reshape(16, 16).sum(axis=1))


# ---------------------------------------------------------------- archives


def _filesystem(uri: str):
    """A file system that Python can use, and the path in it, of a URI or path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "/", 1) if uri.startswith("file:/") else uri)


def _write(folder: str, archive_bytes: int = ARCHIVE_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _filesystem(folder)
        system.create_dir(top, recursive=True)
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        row = next(rows, None)
        while row is not None:
            path, n, held = f"{top}/{uuid.uuid4().hex}.zip", 0, 0
            with system.open_output_stream(path) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                while row is not None and held < archive_bytes:
                    raw = (row[1] or "").encode()
                    image = to_png(padded(raw))
                    archive.writestr(zipfile.ZipInfo(f"{n:09d}_{'null' if row[0] is None else row[0]}_{len(raw)}.png"), image)
                    n, held, row = n + 1, held + len(image), next(rows, None)
            size = system.get_file_info(path).size
            yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["archive", "bytes", "members"])

    return run


def _members(stream, start: int, end: int) -> list[zipfile.ZipInfo]:
    """Directory entries whose headers begin in the range."""
    with zipfile.ZipFile(stream) as archive:
        return [x for x in archive.infolist() if start <= x.header_offset < end]


def _fetch(stream, member: zipfile.ZipInfo) -> bytes:
    """A stored member's payload, by the offset of its header."""
    head = stream.read_at(30, member.header_offset)
    if len(head) < 30:
        raise OSError("a header was cut off")
    name, extra = struct.unpack("<HH", head[26:30])
    if head[:4] != b"PK\x03\x04" or member.compress_type != zipfile.ZIP_STORED:
        raise OSError("no stored member at this offset")
    data = stream.read_at(member.file_size, member.header_offset + 30 + name + extra)
    if len(data) != member.file_size or zlib.crc32(data) != member.CRC:
        raise OSError("a member's checksum differs")
    return data


def fetch(system, path: str, member: zipfile.ZipInfo, stream=None, tries: int = TRIES) -> bytes:
    """A member's payload; each attempt after the first opens the archive again and reads only this member."""
    for left in range(tries - 1, -1, -1):
        try:
            if stream is None:
                with system.open_input_file(path) as own:
                    return _fetch(own, member)
            return _fetch(stream, member)
        except (OSError, struct.error):
            if not left:
                raise
            stream = None
    raise ValueError("tries must be positive")


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range = int(options.get("rangeBytes", RANGE_BYTES))
        self.listed = options.get("list")

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, top = _filesystem(self.folder)
        files = {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.base_name.endswith(".zip")}
        if self.listed is not None:
            with system.open_input_file(f"{top}/{self.listed}") as names:
                files = {name: files[name] for name in names.read().decode().splitlines()}
        return [Range(name, size, at, min(at + self.range, size)) for name, size in sorted(files.items()) for at in range(0, size, self.range)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # without archives
            return
        system, top = _filesystem(self.folder)
        path = f"{top}/{partition.path}"
        with system.open_input_file(path) as stream:
            rows, held = [], 0
            for member in _members(stream, partition.start, partition.end):
                data = fetch(system, path, member, stream if not stream.closed else None)
                rows.append((partition.path, member.filename, member.header_offset, data))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "member", "header_offset", "payload"])


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder): archive, member, header_offset, payload of all members of the folder's ZIP files.

    Options: rangeBytes, the bytes of an archive for one task; list, a file in the folder that names the archives to read, one a line.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, header_offset long, payload binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


# ---------------------------------------------------------------- the column operators


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """archive, bytes, members: the files that now hold a member for each row of docs (null texts are empty). Runs at once."""
    prepare(docs.sparkSession)
    rows = docs.select(col(id_col), col(text_col)).mapInArrow(_write(folder), "archive string, bytes long, members long").collect()  # a row for each archive
    return docs.sparkSession.createDataFrame([tuple(r) for r in rows], "archive string, bytes long, members long")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for member, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, id_, n = member.removesuffix(".png").split("_")
            samples = from_png(data)
            out.append(
                (
                    None if id_ == "null" else int(id_),
                    int(n),
                    len(samples),
                    hashlib.sha256(samples).hexdigest(),
                    zlib.crc32(samples[-16:]),
                    len(data),
                    hashlib.sha256(data).hexdigest(),
                    feature(samples),
                )
            )
        columns = list(zip(*out, strict=True)) or [[]] * len(_DESCRIBED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DESCRIBED, strict=True)], schema=_DESCRIBED)


_DESCRIBED = pa.schema(
    [(n, pa.int64()) for n in ("id", "n_bytes", "payload_bytes")]
    + [("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature per row of docs, from the stored bytes.

    Null texts are empty ones and make one row of spaces. Ids are integers, and may be null or repeat. Equal texts have equal values.
    """
    spark = prepare(docs.sparkSession)
    folder = Scratch(spark, "media").path("archives")
    files = write_archives(docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")), folder, "id")
    system, top = _filesystem(folder)
    system.create_dir(top, recursive=True)
    with system.open_output_stream(f"{top}/archives.txt") as names:
        names.write("\n".join(sorted(r["archive"] for r in files.collect())).encode())
    spark.dataSource.register(ArchiveSource)
    stored = spark.read.format("media_archive").option("list", "archives.txt").load(folder)
    kinds = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("member", "payload").mapInArrow(_described, kinds).withColumnRenamed("id", id_col)
