"""Byte-level BPE with the tiktoken library and a local rank file, and back to bytes.

Long texts are cut before a space that follows a character other than white space. The pattern's matches hold white space only
at their start or on their own, so a match always begins there and the cut changes no id.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.core import col, prepare

#: Characters of a text that the library gets at once, unless no safe boundary comes.
PIECE = 1 << 16
_SAFE = re.compile(r"(?<=\S) ")
_encodings: dict[tuple[str, str], object] = {}


def encoding(rank_file: str, pattern: str):
    """The encoding without special tokens; each Python worker loads a file once."""
    import tiktoken

    if (rank_file, pattern) not in _encodings:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[rank_file, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[rank_file, pattern]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of at least `size` characters, cut at safe boundaries."""
    first = 0
    while len(text) - first > size and (found := _SAFE.search(text, first + size)):
        yield text[first : found.start()]
        first = found.start()
    yield text[first:]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]), kind))


def _encode(rank_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = []
                for text in part.column(1).to_pylist():
                    parts = [own.encode_ordinary(x) for x in pieces(text or "")]
                    ids.append(np.array(parts[0] if len(parts) == 1 else [i for x in parts for i in x], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids, pa.int32())], ["id", "ids"])

    return run


def _decode(rank_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = part.column(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pa.array([None if x is None else own.decode_bytes(x) for x in ids.to_pylist()], pa.binary())],
                    ["id", "ids", "bytes"],
                )

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) per row of docs. A null text is an empty one and has no ids."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col), col(text_col)).mapInArrow(_encode(rank_file, pattern), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and bytes per row: raw bytes, as a cut between ids may fall within a character. Null ids give null bytes."""
    prepare(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(col(id_col), col(ids_col)).mapInArrow(_decode(rank_file, pattern), f"id {kind}, ids array<int>, bytes binary")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col)


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 per row of docs."""
    both = decode(encode(docs, rank_file, pattern, id_col, text_col), rank_file, pattern, id_col)
    return both.select(
        col(id_col),
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
