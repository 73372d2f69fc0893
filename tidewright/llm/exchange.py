"""Which hashes occur more than once in all the data, found without a row per hash.

Documents are dealt to blocks by their id. A block sends each bucket of the hash space one packed, sorted array of its distinct hashes,
so that a hash that a third of all rows hold is sent once per block. A bucket sends each block those of the
block's hashes that occur again elsewhere, or again in the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.core import binary

PACKED = "bucket int, block int, hashes binary, counts binary"
#: What a block learns where the number of occurrences matters: a hash, and whether it occurs more often than a limit.
COUNTED = np.dtype([("hash", "<u8"), ("many", "u1")])
#: Hashes that a bucket looks at together, and that a block gathers before it sends them; a block may send a bucket several arrays.
STEP, SEND = 1 << 20, 1 << 22


def pack(block: int, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, block, distinct sorted hashes, occurrences of each, 255 at most) for one block."""
    hashes, counts = np.unique(hashes, return_counts=True)
    counts = np.minimum(counts, 255).astype(np.uint8)
    ends = np.searchsorted(hashes, np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64))
    cuts = [0, *ends.tolist(), len(hashes)]
    full = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full, pa.int32()),
            pa.array([block] * len(full), pa.int32()),
            binary([hashes[cuts[i] : cuts[i + 1]].tobytes() for i in full]),
            binary([counts[cuts[i] : cuts[i + 1]].tobytes() for i in full]),
        ],
        ["bucket", "block", "hashes", "counts"],
    )


def send(found: Iterator[tuple[int, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """pack() of the hashes (block, hashes) of documents that come block by block, SEND at a time."""
    block, held, n = None, [], 0
    for own, hashes in found:
        if held and (own != block or n >= SEND):
            yield pack(block, np.concatenate(held), buckets)
            held, n = [], 0
        block = own
        held.append(hashes)
        n += len(hashes)
    if held:
        yield pack(block, np.concatenate(held), buckets)


def _counted(blocks: np.ndarray, hashes: np.ndarray, counts: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (ascending) and hashes, or COUNTED records, of those that occur more than once."""
    order = np.argsort(hashes, kind="stable")
    blocks, hashes, counts = blocks[order], hashes[order], counts[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    total = np.repeat(np.add.reduceat(counts.astype(np.int64), first), np.diff(np.r_[first, len(hashes)]))
    again = total > 1
    blocks, hashes, total = blocks[again], hashes[again], total[again]
    order = np.argsort(blocks, kind="stable")
    blocks, hashes, total = blocks[order], hashes[order], total[order]
    if limit is not None:
        rows = np.empty(len(hashes), COUNTED)
        rows["hash"], rows["many"] = hashes, total > limit
        hashes = rows
    return blocks, hashes


def _repeated(limit: int | None):
    """Of one or more buckets, whose rows need not be together: for each block, its hashes that occur again. Holds 9 bytes a hash, and works on STEP of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            for block, packed, times in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                rows.append((block, np.frombuffer(packed.as_buffer().to_pybytes(), np.uint64), np.frombuffer(times.as_buffer().to_pybytes(), np.uint8)))
                n += len(rows[-1][1])
        if not n:
            return
        low, high = min(int(r[1][0]) for r in rows), max(int(r[1][-1]) for r in rows)
        parts = -(-n // STEP)
        edges = np.array([low + (high - low) * i // parts for i in range(1, parts)], np.uint64)
        cuts = [np.r_[0, np.searchsorted(r[1], edges), len(r[1])] for r in rows]
        for k in range(parts):
            own = [(b, h[c[k] : c[k + 1]], t[c[k] : c[k + 1]]) for (b, h, t), c in zip(rows, cuts, strict=True) if c[k] < c[k + 1]]
            if not own:
                continue
            blocks = np.repeat(np.array([r[0] for r in own], np.int32), [len(r[1]) for r in own])
            blocks, found = _counted(blocks, np.concatenate([r[1] for r in own]), np.concatenate([r[2] for r in own]), limit)
            names, first = np.unique(blocks, return_index=True)
            ends = [*first.tolist(), len(blocks)]
            for i in range(0, len(names), 64):
                part = range(i, min(i + 64, len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 64], pa.int32()), binary([found[ends[j] : ends[j + 1]].tobytes() for j in part])], ["block", "hashes"])

    return run


def repeated(packed: DataFrame, buckets: int, limit: int | None = None) -> DataFrame:
    """(block, hashes): what pack() rows say occurs more than once, for each block that has it; with a limit, as COUNTED records."""
    return packed.repartitionById(buckets, F.col("bucket")).select("bucket", "block", "hashes", "counts").mapInArrow(_repeated(limit), "block int, hashes binary")


def with_answers(blocks: DataFrame, answers: DataFrame, n: int, kind: str) -> DataFrame:
    """Rows of blocks (block, id, text, ...) by block, each block's answers (of type `kind`) before its texts, as (block, answer, id, text, ...)."""
    kinds = {f.name: f.dataType for f in blocks.schema}
    others = [c for c in blocks.columns if c != "block"]
    first = answers.select("block", F.col(answers.columns[1]).cast(kind).alias("answer"), *[F.lit(None).cast(kinds[c]).alias(c) for c in others])
    rest = blocks.select("block", F.lit(None).cast(kind).alias("answer"), *others)
    return first.unionByName(rest).repartitionById(n, F.col("block")).sortWithinPartitions("block", F.col("answer").isNull())


def split_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], pa.RecordBatch | None]]:
    """From with_answers() rows: (block, all the block's answers, a batch of its texts), and at each block's end (block, [], None)."""
    block, answers = None, []
    for batch in batches:
        at = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if block is not None and at[a] != block:
                yield block, [], None
                answers = []
            block = int(at[a])
            part = batch.slice(a, b - a)
            n = part.num_rows - part.column(1).null_count
            answers += [x.as_py() for x in part.column(1).slice(0, n)]
            if n < part.num_rows:
                yield block, answers, part.slice(n)
    if block is not None:
        yield block, [], None
