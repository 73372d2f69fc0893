"""Removes repeated passages of words, found through difference-cover anchors.

A perfect difference cover D of a period v holds, for any two positions p and q, some shift s < v with both p + s and q + s in D
modulo v. Two equal windows of WIDTH words hence share an equal, aligned anchor of WIDTH - v + 1 words at such a shift; so only
len(D) / v of the positions are hashed and exchanged. Where an anchor repeats, all windows of WIDTH words that hold it
are hashed in full and exchanged again, which settles the matches exactly (64-bit hashes) without listing pairs: a passage of
thousands of documents takes one hash of each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.core import Scratch, Words, col, partitions, prepare, slices, text_blocks, window_hash
from tidewright.llm.exchange import PACKED, repeated, send, split_answers, with_answers

WIDTH = 35
#: A perfect difference set: its differences modulo 21 are 0 to 20.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


def _fits(words: Words, width: int) -> np.ndarray:
    """For each word of all documents, whether a window of that width starts there."""
    n = len(words.hashes)
    last = np.repeat(words.first[1:], np.diff(words.first))
    return np.arange(n) + width <= last


def _anchors(words: Words, width: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (among all documents' words) and hashes of the windows at cover positions, counted from each document's first word."""
    fits = _fits(words, width)
    inside = np.arange(len(fits)) - np.repeat(words.first[:-1], np.diff(words.first))
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True
    at = np.flatnonzero(fits & chosen[inside % period])
    return at, window_hash(words.hashes, width)[at]


def _member(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted known ones."""
    if not len(known) or not len(hashes):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _known(answers: list[bytes]) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(answers), np.uint64))


def _send_anchors(buckets: int, width: int, period: int, cover: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from send(((batch.column(0)[0].as_py(), _anchors(Words(data, offsets), width, period, cover)[1]) for batch in batches for _, data, offsets in slices(batch)), buckets)

    return run


def _send_windows(buckets: int, width: int, period: int, cover: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from send(found(batches), buckets)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        known = None
        for block, answers, texts in split_answers(batches):
            if texts is None:
                known = None
                continue
            known = _known(answers) if known is None else known
            for _, data, offsets in slices(texts):
                words = Words(data, offsets)
                at, hashes = _anchors(words, width - period + 1, period, cover)
                at = at[_member(hashes, known)]
                if not len(at):
                    continue
                near = np.zeros(len(words.hashes) + 1, np.int32)
                np.add.at(near, np.maximum(at - period + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                chosen = np.flatnonzero((np.cumsum(near[:-1]) > 0) & _fits(words, width))
                yield block, window_hash(words.hashes, width)[chosen]

    return run


def _cut(width: int, rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for _, answers, texts in split_answers(batches):
            if texts is None:
                known = None
                continue
            known = _known(answers) if known is None else known
            for part, data, offsets in slices(texts):
                words = Words(data, offsets)
                n = len(words.hashes)
                hit = np.flatnonzero(_fits(words, width))
                hit = hit[_member(window_hash(words.hashes, width)[hit], known)] if n >= width else hit[:0]
                change = np.zeros(n + 1, np.int32)
                change[hit] += 1
                change[hit + width] -= 1  # starts are distinct, and so are ends
                gone = np.cumsum(change[:-1]) > 0
                kept = []
                raw = data.tobytes()
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    stay = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]))
                removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), words.first[:-1]) if n else np.zeros(part.num_rows, np.int64)
                removed[words.first[1:] == words.first[:-1]] = 0
                out = {
                    "id": part.column(part.schema.get_field_index("id")),
                    "n_words": pa.array(np.diff(words.first), pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_text": pa.array([x.decode() for x in kept], pa.string()),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                }
                if rest:
                    out |= {name: part.column(part.schema.get_field_index(name)) for name in ("text", "rest")}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _cut_blocks(docs: DataFrame, id_col: str, text_col: str, width: int, period: int, cover: tuple[int, ...], rest: bool) -> DataFrame:
    """id, n_words, n_removed, kept_text, kept_sha256, and with `rest` text and the other columns as a struct."""
    if not 0 < period <= width or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover has to be a difference cover of a period no longer than the width")
    spark = prepare(docs.sparkSession)
    scratch, n = Scratch(spark, "substring"), partitions(spark)
    blocks = text_blocks(docs, id_col, text_col, n)
    dealt = blocks.repartitionById(n, F.col("block"))
    anchors = dealt.mapInArrow(_send_anchors(n, width - period + 1, period, cover), PACKED)
    anchors = scratch.keep(repeated(anchors, n), "anchors")
    scratch.tidy()
    windows = with_answers(blocks, anchors, n, "binary").mapInArrow(_send_windows(n, width, period, cover), PACKED)
    windows = scratch.keep(repeated(windows, n), "windows")
    scratch.drop("anchors")
    scratch.tidy()
    last = text_blocks(docs, id_col, text_col, n, rest)
    kinds = f"id {dict(last.dtypes)['id']}, n_words long, n_removed long, kept_text string, kept_sha256 string"
    if rest:
        kinds = T.StructType([*T._parse_datatype_string(kinds).fields, last.schema["text"], last.schema["rest"]])
    return with_answers(last, windows, n, "binary").mapInArrow(_cut(width, rest), kinds)


def repeated_words_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """id, n_words, n_removed, kept_text, kept_sha256 per row of docs.

    Words are runs of bytes other than space and tab to carriage return. A word goes if a window of `width` words of its document
    covers it whose words also start at any other place, in the same document too. The rest is joined by single spaces.
    Null, empty and blank texts have no words, and the digest of nothing. Repeated rows are documents like any others, so their
    windows repeat; ids may be null or repeat.
    """
    return _cut_blocks(docs, id_col, text_col, width, period, cover, False).withColumnRenamed("id", id_col)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with what is left of each text; documents of which nothing is left go, those without words stay as they are.

    Of a passage that repeats, every occurrence goes; a text that has none stays byte for byte. Ids may be null or repeat.
    """
    cut = _cut_blocks(docs, id_col, text_col, width, PERIOD, COVER, True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select(*[text.alias(c) if c == text_col else col(c, "rest").alias(c) for c in docs.columns])
