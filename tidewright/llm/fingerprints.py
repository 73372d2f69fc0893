"""Bottom-k fingerprints: the k least hashes of a text's shingles, mergeable across parts.

Shingles are runs of WIDTH bytes of UTF-8 (a shorter text is one shingle). A fingerprint is its k, a colon, and up to k distinct hashes of 48 bits in
ascending order, 12 hex digits each. With fewer than k hashes it holds the whole set, and its estimates are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.core import col, partitions, prepare, window_hash

WIDTH, K = 12, 128
_SHIFT = np.uint64(16)


def bottom(text: bytes, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k least distinct hashes, ascending; none of an empty text."""
    if not text:
        return np.zeros(0, np.uint64)
    hashes = window_hash(np.frombuffer(text, np.uint8), min(width, len(text)))
    if len(hashes) > 16 * k:  # most often, the least hashes are well below this bound
        few = np.unique(hashes[hashes < np.uint64((1 << 64) // len(hashes) * 4 * k)] >> _SHIFT)
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes >> _SHIFT)[:k]


def written(hashes: np.ndarray, k: int = K) -> str:
    digits = hashes.astype(">u8").tobytes().hex()
    return f"{k}:" + "".join([digits[i + 4 : i + 16] for i in range(0, len(digits), 16)])


def parsed(fingerprint: str) -> tuple[int, np.ndarray]:
    k, digits = fingerprint.split(":")
    return int(k), np.array([int(digits[i : i + 12], 16) for i in range(0, len(digits), 12)], np.uint64)


def _merged(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return np.union1d(a, b)[:k]


def _resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    both = np.concatenate((a, b))
    both.sort()
    first = np.r_[True, both[1:] != both[:-1]] if len(both) else np.zeros(0, bool)
    least = both[first][:k]
    if not len(least):
        return 1.0  # two empty texts
    twice = both[1:][both[1:] == both[:-1]]
    return float(np.searchsorted(twice, least[-1], "right")) / len(least)


def merge(a: str, b: str) -> str:
    """The fingerprint of both texts' shingles together."""
    (k, x), (m, y) = parsed(a), parsed(b)
    return written(_merged(x, y, min(k, m)), min(k, m))


def resemblance(a: str, b: str) -> float:
    """Estimated shared shingles over all shingles; 1 for two empty texts."""
    (k, x), (m, y) = parsed(a), parsed(b)
    return _resemblance(x, y, min(k, m))


def distinct(a: str) -> float:
    """Estimated number of distinct shingles."""
    k, x = parsed(a)
    return float(len(x)) if len(x) < k else (k - 1) * float(1 << 48) / float(x[k - 1] + np.uint64(1))


def containment(a: str, b: str) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    own, all_ = distinct(a), distinct(merge(a, b))
    return 1.0 if not own else min(1.0, resemblance(a, b) * all_ / own)


def _fingerprints(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(bottom((t or "").encode(), k, width), k) for t in texts], pa.string())], ["id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """id and fingerprint per row of docs; a null text is an empty one."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col), col(text_col)).mapInArrow(_fingerprints(k, width), f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


@F.arrow_udf(T.DoubleType())
def resemblances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of two columns of fingerprints: resemblance() of each pair, null where one is null."""
    return pa.array([None if x is None or y is None else resemblance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def containments(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of two columns of fingerprints: containment() of each pair, null where one is null."""
    return pa.array([None if x is None or y is None else containment(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def distincts(a: pa.Array) -> pa.Array:
    """Of a column of fingerprints: distinct() of each, null where it is null."""
    return pa.array([None if x is None else distinct(x) for x in a.to_pylist()], pa.float64())


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, fingerprint): one merged row for each run of a key; a key that comes again later gets another row."""
    key, held = (), None
    for batch in batches:
        keys, out = batch.column(0).to_pylist(), []
        for own, text in zip(keys, batch.column(1).to_pylist(), strict=True):
            k, hashes = parsed(text)
            if held is not None and own == key[0]:
                least = min(k, held[0])
                held = least, _merged(held[1], hashes, least)
                continue
            if held is not None:
                out.append((key[0], written(held[1], held[0])))
            key, held = (own,), (k, hashes)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field(0).type), pa.array([r[1] for r in out], pa.string())], ["key", "fingerprint"])
        kind = batch.schema.field(0).type
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], kind), pa.array([written(held[1], held[0])], pa.string())], ["key", "fingerprint"])


def merged(parts: DataFrame, key_col: str, fingerprint_col: str = "fingerprint") -> DataFrame:
    """key and fingerprint: of all parts with one key (null is a key of its own) the fingerprint of their shingles together. Null fingerprints are passed over.

    Each task first merges what it has of a key, so a key sends one fingerprint a task, however many parts it has; then a key's are merged one by one.
    """
    rows = parts.filter(col(fingerprint_col).isNotNull()).select(col(key_col).alias("key"), col(fingerprint_col).alias("fingerprint"))
    n, kinds = partitions(prepare(parts.sparkSession)), rows.schema
    once = rows.sortWithinPartitions("key").mapInArrow(_fold, kinds)
    return once.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_fold, kinds).withColumnRenamed("key", key_col)


# ---------------------------------------------------------------- each document, its edited text and the next one


def _with_next(k: int, width: int):
    """From a bucket's rows in order, ending with the next bucket's first rows (extra): results for all rows but the extra ones."""

    def result(id_: int, text: str, own: np.ndarray, after: str, others: np.ndarray) -> tuple:
        n = len(text)
        edited = (text[: n - n // 3] + after[: n // 3]).encode()
        changed = bottom(edited, k, width)
        return id_, n, hashlib.sha256(edited).hexdigest(), written(own, k), written(changed, k), _resemblance(own, changed, k), _resemblance(own, others, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out = []
            for bucket, extra, id_, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                own = bottom(text.encode(), k, width)
                if waiting and waiting[0] == bucket:
                    out.append(result(*waiting[1:], text, own))
                waiting = None if extra else (bucket, id_, text, own)
            yield _rows(out)

    return run


_RESULT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _RESULT]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)


def _targets(bounds: list[int]):
    """Buckets of an id: those of (bounds[i - 1], bounds[i]]; a bucket's largest id also ends the one above, the largest of all the lowest one."""
    known = np.array(bounds, np.int64)
    top = len(bounds)

    @F.arrow_udf("array<struct<bucket int, extra int>>")
    def run(ids: pa.Array) -> pa.Array:
        out = []
        at = np.searchsorted(known, np.asarray(ids.fill_null(int(known[0]) if top else 0)), "left") if top else np.zeros(len(ids), int)
        for i, null, x in zip(np.minimum(at, max(top - 1, 0)).tolist(), ids.is_null().to_pylist(), ids.to_pylist(), strict=True):
            row = [{"bucket": i, "extra": 0}]
            if top and not null and x == known[i]:
                row.append({"bucket": (i + 1) % top, "extra": 1})
            elif not top:
                row.append({"bucket": 0, "extra": 1})
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([("bucket", pa.int32()), ("extra", pa.int32())])))

    return run


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of docs.

    Rows are in descending order of id, then of text, nulls last; the last row's next is the first, and a lone row's next is itself.
    n_chars counts code points. The edited text has its last floor(n_chars / 3) code points replaced by the next text's first as
    many, or all of them. Null texts are empty. Ids are cut into ranges of about equal size at ids of the table itself, so that a range
    needs one more row, the largest of the range below.
    """
    spark = prepare(docs.sparkSession)
    n = partitions(spark)
    ids = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    found = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n + 1)], 100 * n).alias("b"), F.max("id").alias("m")).first()
    bounds = sorted({*(found["b"] or []), found["m"]} - {None})
    rows = ids.withColumn("to", F.explode(_targets(bounds)("id"))).select("to.bucket", "to.extra", "id", "text")
    order = [F.col("bucket"), F.col("extra"), F.col("id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    dealt = rows.repartitionById(max(1, len(bounds)), F.col("bucket")).sortWithinPartitions(*order)
    kind = docs.schema[id_col].dataType.simpleString()
    out = dealt.mapInArrow(_with_next(k, width), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
