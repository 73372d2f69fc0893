"""A quality classifier by compression: zstandard dictionaries of good and of bad text, and the difference they make.

A text is compressed in pieces once with each dictionary. The difference of the two sizes, a byte of text, is its feature; a logistic
curve that is fitted on labelled rows other than those of the dictionaries they are compressed with, weighted to the classes' shares of all labels, turns it into a score from 0 to 1. The label, id, language and source
are no inputs. The fit takes a bounded sample (SAMPLE rows of a class, of SAMPLE_BYTES at most, in the order of a hash of the id);
all rows are scored over their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.core import col, prepare

#: Bounds of the sample that is fitted on: rows of each class, and their bytes; and the size of a dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, SHARE = 3000, 12 << 20, 1 << 17, 256
#: Long texts are compressed in pieces, so that what a dictionary adds counts throughout. PIECE, SHARE and DICTIONARY_BYTES have the highest mean AUC of a grid
#: on learnable rows alone (fitted on those whose crc32 leaves 0 and compared on those that leave 2, and the other way round). LEVEL was
#: chosen on the same rows: higher levels search the whole dictionary for matches, beyond 9 they only take longer.
PIECE, LEVEL = 128, 9


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weight: float
    bias: float


def _compressors(good: bytes, bad: bytes):
    import zstandard

    out = []
    for content in (good, bad):
        entries = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        entries.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=entries, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def feature(text: bytes, good, bad) -> float:
    """(size with the bad dictionary - size with the good one) / bytes; 0 for an empty text."""
    if not text:
        return 0.0
    total = 0
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        total += len(bad.compress(piece)) - len(good.compress(piece))
    return total / len(text)


def _dictionary(texts: list[bytes], size: int, share: int) -> bytes:
    """Up to `share` bytes from the middle of as many texts as fit in `size`, in their order: many texts matter more than long pieces."""
    out, room = [], size
    for text in texts:
        if room <= 0:
            break
        at = max(0, (len(text) - share) // 2)
        out.append(text[at : at + min(share, room)])
        room -= len(out[-1])
    return b"\n".join(out) or b" "


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weight and bias of the logistic curve, by Newton's method with the penalty of a normal prior on the slope, so that a few labels hardly move scores from the classes' shares."""
    w = np.zeros(2)
    scale = x.std() or 1.0
    z = np.c_[x / scale, np.ones(len(x))]
    penalty = np.diag([1.0, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, share: int = SHARE) -> Model:
    """Fits on rows of labels that crc32(id as text) mod 3 leaves at 0 or 2. With one class or none labelled, scores are that class's share.

    The sample has at most `sample` rows and `sample_bytes` bytes of each class; a text that no longer fits is passed over. It fills the dictionaries, up to
    dictionary_bytes each, with `share` bytes a text; each half of it, whole, calibrates with dictionaries of the other half. Scored rows are never cut. An id with both labels counts as label 0; null ids, other labels and labels without a document are passed over.
    """
    learn = labels.filter(col(id_col).isNotNull() & col(label_col).isin(0, 1) & (F.crc32(col(id_col).cast("string").cast("binary")) % 3 != 1)).select(col(id_col).alias("id"), col(label_col).alias("label"))
    sized = docs.select(col(id_col).alias("id"), F.octet_length(F.coalesce(col(text_col), F.lit(""))).alias("size"))
    chosen: dict[int, int] = {}
    all_ = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        room = sample_bytes
        rows = learn.filter(F.col("label") == label).join(sized, "id").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        for row in rows:
            if row["id"] not in chosen and row["size"] <= room:
                room -= row["size"]
                chosen[row["id"]] = label
    texts: dict[int, bytes] = {}
    if chosen:
        wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], "id long")
        for row in docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).join(F.broadcast(wanted), "id").toLocalIterator():
            texts[row["id"]] = max(texts.get(row["id"], b""), (row["text"] or "").encode())
    groups = [[texts[i] for i in chosen if chosen[i] == label and i in texts] for label in (0, 1)]
    if not all(groups):
        only = 0.5 if not any(groups) else float(bool(groups[1]))
        return Model(b" ", b" ", 0.0, float(np.clip((only - 0.5) * 20, -10, 10)))
    x, y = [], []
    for half in (0, 1):  # each half is calibrated on with dictionaries of the other one
        tools = _compressors(*(_dictionary(groups[label][half::2] or groups[label], dictionary_bytes, share) for label in (1, 0)))
        for label, group in enumerate(groups):
            held = group[1 - half :: 2]
            x += [feature(t, *tools) for t in held]
            y += [float(label)] * len(held)
    x, y = np.array(x), np.array(y)
    good, bad = (_dictionary(groups[label], dictionary_bytes, share) for label in (1, 0))
    weights = np.array([all_[label] / len(groups[label]) for label in y.astype(int).tolist()])  # the sample has as many rows of either class, the labels may not
    weight, bias = _logistic(x, y, weights * len(y) / weights.sum())
    return Model(good, bad, weight, bias)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(model.good, model.bad)
        for batch in batches:
            x = np.array([feature((t or "").encode(), *tools) for t in batch.column(1).to_pylist()], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(model.weight * x + model.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: more like label 1) per row of docs. Null and empty texts have the score of no evidence."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col), col(text_col)).mapInArrow(_score(model), f"id {kind}, score double").withColumnRenamed("id", id_col)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out (no label of such a row is learnt from), score and predicted (1 if score >= 0.5) per row of docs."""
    out = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    held = F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select(col(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text the classifier predicts to be good; null and empty texts stay if no evidence is predicted good."""
    prepare(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't be looked up
    return plain.mapInArrow(_keep(fit(docs, labels, id_col, text_col), docs.columns.index(text_col)), plain.schema).toDF(*docs.columns)


def _keep(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(model.good, model.bad)
        for batch in batches:
            x = np.array([feature((t or "").encode(), *tools) for t in batch.column(text_at).to_pylist()], dtype=float)
            yield batch.filter(pa.array(model.weight * x + model.bias >= 0))

    return run
