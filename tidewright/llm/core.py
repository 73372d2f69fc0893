"""Shared parts of the text operators: scratch tables, Arrow batches as byte buffers, and hashes of word or byte windows.

Hashes are 64 bits wide and depend on nothing but the bytes, so any executor and any rerun gets the same ones.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import own_folder, ready

#: Rows that Spark hands to Python at once, and bytes of text that numpy works on at once.
BATCH_ROWS, SLICE_BYTES = 256, 1 << 19

#: Bytes that separate words: space, and tab to carriage return.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
#: Odd, and 3 modulo 4, so that swapping two values of a pair changes all but one bit of what is mixed.
_ODD = _U(0x9E3779B97F4A7C17)
#: What is left of 8 bytes, first byte lowest, where only so many count.
MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


# ---------------------------------------------------------------- session


def prepare(spark: SparkSession) -> SparkSession:
    """Keeps the batches that go to Python small: a batch of very long texts must fit in a worker."""
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is also the number of blocks and of hash buckets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of our own, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = own_folder(spark)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def col(name: str, of: str | None = None) -> Column:
    """The column of that name, whatever characters it has; with `of`, the field of that struct."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


class Scratch:
    """Intermediate tables in the shared folder. They cut lineage and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.top}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def tidy(self) -> None:
        """Lets Spark remove shuffle files that no plan refers to any more; else they stay until the driver happens to collect garbage."""
        for _ in range(2):  # plans are freed by the first round, what they held by the second
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- Arrow batches


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string or binary column, and each value's offset (and the end). Nulls are empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about SLICE_BYTES of text (a longer text comes alone), with their buffer and offsets."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, with zeros after the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), "<u8", padded, 0, (1,))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two in a row. Each is mixed before the next one comes, so that no sum of differences can vanish by its structure alone."""
    return mix(a * _ODD + b)


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes data[start:end] for each pair, equal for equal runs: each 8 bytes are mixed with their place in the run, then added."""
    eight, size = eights(data), ends - starts
    total = mix(eight[starts] & MASK[np.minimum(size, 8)])
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] + 7) // 8 - 1  # those after the first
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(starts[long], more) + 8 * place
        value = eight[at] & MASK[np.minimum(np.repeat(ends[long], more) - at, 8)]
        total[long] += np.add.reduceat(mix(value ^ mix(place.astype(np.uint64) * _ODD)), first)
    return mix(total + size.astype(np.uint64) * _ODD)


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of values[i:i + width] for each i where that fits; windows that span two documents are the caller's to leave out.

    Values are bytes or hashes. A window of hashes is a tree of pairs, one of bytes a chain of 8 at a time.
    """
    n = len(values) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    if values.dtype == np.uint8:
        eight = eights(values)
        out = mix((eight[:n] & MASK[min(width, 8)]) + _U(width))
        for at in [*range(8, width - 7, 8), *([width - 8] if width > 8 and width % 8 else [])]:
            out = _join(out, eight[at : at + n])
        return out
    out, at, span = None, 0, 1
    while True:
        if width & span:
            out = values[at : at + n] if out is None else _join(out, values[at : at + n])
            at += span
        span *= 2
        if span > width:
            return mix(out + _U(width))
        values = _join(values[: -(span // 2)], values[span // 2 :])


class Words:
    """The words of a run of documents: start and end bytes, hashes, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        letter = np.zeros(len(data) + 1, bool)
        letter[:-1] = ~_SEPARATOR[self.data]
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = letter[:-1]
        self.starts = np.flatnonzero(letter & (~before | border))
        self.ends = np.flatnonzero(before & (~letter | border))
        self.first = np.searchsorted(self.starts, offsets)  # document i has words first[i] .. first[i + 1] - 1
        self.hashes = range_hash(self.data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def shingles(self, width: int) -> Iterator[np.ndarray]:
        """Each document's distinct shingles, sorted: windows of width words; all words as one where there are fewer; none without words."""
        windows = window_hash(self.hashes, width)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(windows[a : b - width + 1])
            elif b > a:
                yield window_hash(self.hashes[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def text_blocks(docs: DataFrame, id_col: str, text_col: str, blocks: int, rest: bool = False) -> DataFrame:
    """block, id, text of all rows, and with `rest` a struct of the other columns. Equal (id, text) rows share a block; a block is one partition's work."""
    return docs.select(
        F.pmod(F.xxhash64(col(id_col).cast("string"), F.octet_length(col(text_col))), F.lit(blocks)).cast("int").alias("block"),
        col(id_col).alias("id"),
        col(text_col).alias("text"),
        *([F.struct(*[col(c) for c in docs.columns if c != text_col]).alias("rest")] if rest else []),
    )
