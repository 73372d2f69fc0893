"""Exact removal of repeated byte strings, and the groups of maximal repeats, with enhanced suffix arrays.

A string of WIDTH bytes goes to the bucket of its minimizer, the least hash of its substrings of SEED bytes. A document is so cut
into segments, runs of strings with one minimizer; equal strings always meet in one bucket, and a bucket's segments are
all that it needs. Only minimizers that two documents or more share are sent at all, and equal segments of a block once,
with the smallest and largest id that have them. Each bucket builds the suffix array of its distinct segments with the common prefixes of
neighbours (both by comparing bytes), and scans these with a stack for the intervals of the common-prefix tree. Intervals whose occurrences have
different bytes on their left are the maximal repeats (the others are inside a longer one); a segment that several documents hold is one text with several
owners, so its leaf is an interval too. Over all occurrences of a maximal repeat the smallest id that has it is
painted. All bytes that go, go by such an interval: a byte goes if one that covers it also occurs in a document with a smaller id.
Segments that have one owner and share no string (by the strings' hashes) with another one can't be in any, and get no array.

repeat_groups() returns the groups themselves, with all their occurrences in all documents. A repeat longer than a segment is a chain of groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.core import MASK, Scratch, binary, col, eights, mix, partitions, prepare, range_hash, slices, text_blocks, window_hash
from tidewright.llm.exchange import PACKED, repeated, send, split_answers, with_answers

WIDTH, SEED = 50, 24
#: Strings of one segment at most, bytes of segments that one suffix array takes at about, and occurrences that are looked at together.
SEGMENT, ARRAY_BYTES, OCCURRENCES = 256, 1 << 20, 1 << 21
#: Null ids come after all others.
LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- suffix arrays


class SuffixArray:
    """The suffixes of at least `width` bytes of some strings, sorted; with common prefixes of neighbours (never past a string's end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.data, self._eight = data, eights(data)
        count = np.maximum(np.diff(offsets) - width + 1, 0)
        self.owner = np.repeat(np.arange(len(offsets) - 1), count)
        before = np.cumsum(count) - count
        at = offsets[:-1][self.owner] + np.arange(len(self.owner)) - before[self.owner]
        left = offsets[1:][self.owner] - at
        sort = self._sorted(at, left)
        self.owner, self.order, self.remaining = self.owner[sort], at[sort], left[sort]
        self.first = self.order == offsets[:-1][self.owner]
        self.common = self._common()

    def _bytes(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next 8 bytes, or as many as are left, as numbers that sort like them."""
        return (self._eight[np.minimum(at, len(self.data))] & MASK[left]).byteswap()

    def _sorted(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """An order of the suffixes: by 8 bytes, then ties by the next 8 until none is left that could be broken."""
        key = self._bytes(at, np.clip(left, 0, 8))
        sort = np.argsort(key, kind="stable")
        fresh = np.r_[True, key[sort][1:] != key[sort][:-1]][: len(at)]
        over, depth = np.zeros(len(at), bool), 8
        while True:
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            place = np.flatnonzero(tied & ~over)
            if not len(place):
                return sort
            own = sort[place]
            rest = np.clip(left[own] - depth, 0, 8)
            key, group = self._bytes(at[own] + depth, rest), np.cumsum(fresh)[place]
            turn = np.lexsort((rest, key, group))
            sort[place], key, rest, group = own[turn], key[turn], rest[turn], group[turn]
            fresh[place[1:]] |= (key[1:] != key[:-1]) | (rest[1:] != rest[:-1]) | (group[1:] != group[:-1])
            over[place] = rest < 8  # what is still tied here ends here
            depth += 8

    def _common(self) -> np.ndarray:
        a, b = self.order[:-1], self.order[1:]
        most = np.minimum(self.remaining[:-1], self.remaining[1:])
        out = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        while len(open_):
            differ = self._eight[a[open_] + out[open_]] ^ self._eight[b[open_] + out[open_]]
            lowest = differ & (~differ + np.uint64(1))
            out[open_] += np.where(differ == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(float)).astype(np.int64) // 8)
            open_ = open_[(differ == 0) & (out[open_] < most[open_])]
        return np.minimum(out, most)

    def intervals(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, first, last): the intervals of the common-prefix tree with a common prefix of `least` bytes or more, by a scan with a stack."""
        long = np.flatnonzero(self.common >= least)
        if not len(long):
            return
        cuts = np.flatnonzero(np.diff(long) > 1) + 1
        for run in np.split(long, cuts):
            stack: list[tuple[int, int]] = []
            for i, length in zip(run.tolist(), self.common[run].tolist(), strict=True):
                first = i
                while stack and stack[-1][0] > length:
                    deep, first = stack.pop()
                    yield deep, first, i
                if not stack or stack[-1][0] < length:
                    stack.append((length, first))
            end = int(run[-1]) + 1
            while stack:
                deep, first = stack.pop()
                yield deep, first, end

    def maximal(self, least: int, several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, first and last places (in order) of the intervals whose occurrences aren't all preceded by the same byte.

        A string's start has no byte before it and differs from any other. A string that has several owners is a repeat too: its leaf counts, unless
        a longer interval has all of it.
        """
        found = np.array(list(self.intervals(least)), np.int64).reshape(-1, 3)
        before = self.data[np.maximum(self.order - 1, 0)]
        change = np.zeros(len(self.order) + 1, np.int64)
        change[2:] = np.cumsum((before[1:] != before[:-1]) | self.first[1:] | self.first[:-1])
        found = found[change[found[:, 2] + 1] > change[found[:, 1] + 1]]
        if several is not None and len(self.order):
            near = np.maximum(np.r_[0, self.common], np.r_[self.common, 0])
            leaf = np.flatnonzero(self.first & several[self.owner] & (near < self.remaining))
            found = np.concatenate((found, np.stack((self.remaining[leaf], leaf, leaf), 1)))
        return tuple(found.T)

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, positions of all occurrences) of each maximal repeat of `least` bytes or more."""
        for length, first, last in zip(*(x.tolist() for x in self.maximal(least)), strict=True):
            yield length, self.order[first : last + 1]


# ---------------------------------------------------------------- segments


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` hashes in a row."""
    span = 1
    while 2 * span <= width:
        hashes = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    rest = width - span
    return np.minimum(hashes[: len(hashes) - rest], hashes[rest:]) if rest else hashes


def segments(data: np.ndarray, offsets: np.ndarray, width: int, seed: int, most: int | None = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of `width` bytes within each document: segments' minimizers (spread anew, as least values are all small), first bytes, ends and documents."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none.astype(np.uint64), none, none, none
    least = _least(window_hash(data, seed), width - seed + 1)
    sizes = np.diff(offsets)
    count = np.maximum(sizes - width + 1, 0)
    doc = np.flatnonzero(count)
    first = offsets[:-1][doc]
    total = count[doc]
    new = np.zeros(len(least) + 1, bool)
    new[1 : len(least)] = least[1:] != least[:-1]
    new[first] = True
    new[np.minimum(first + total, len(least))] = True
    inside = np.zeros(len(least) + 1, np.int32)
    inside[first] += 1
    np.subtract.at(inside, np.minimum(first + total, len(least)), 1)
    valid = np.cumsum(inside[:-1]) > 0
    starts = np.flatnonzero(new[:-1] & valid)
    ends = np.r_[starts[1:], len(least)]
    last = offsets[1:][np.searchsorted(offsets, starts, "right") - 1] - width + 1
    ends = np.minimum(ends, last)
    if most and len(starts) and int((ends - starts).max()) > most:  # long runs of one minimizer are cut
        pieces = -(-(ends - starts) // most)
        at = np.repeat(starts, pieces) + most * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        ends = np.minimum(at + most, np.repeat(ends, pieces))
        starts = at
    return mix(least[starts]), starts, ends + width - 1, np.searchsorted(offsets, starts, "right") - 1


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("id")).fill_null(int(LAST)))


def _member(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(hashes):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _send_minimizers(buckets: int, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from send(found(batches), buckets)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for _, data, offsets in slices(batch):
                minimizers, _, _, docs = segments(data, offsets, width, seed)
                order = np.lexsort((docs, minimizers))
                minimizers, docs = minimizers[order], docs[order]
                new = np.r_[True, (minimizers[1:] != minimizers[:-1]) | (docs[1:] != docs[:-1])][: len(docs)]
                yield batch.column(0)[0].as_py(), minimizers[new]  # each document's minimizers once

    return run


_SEGMENTS = "bucket int, block int, subs binary, sizes binary, lows binary, highs binary, text binary"


class _Distinct:
    """Distinct segments, known by their hashes, with the smallest and largest id of each; texts lie in one run of bytes."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]] = []
        self.held = 0

    def add(self, hashes: np.ndarray, keys: np.ndarray, lows: np.ndarray, highs: np.ndarray, sizes: np.ndarray, text: Iterator[bytes]) -> None:
        """Rows of one batch; `text` gives the bytes of a row by its place."""
        order = np.argsort(hashes, kind="stable")
        first = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]][: len(order)])
        if not len(first):
            return
        at = order[first]
        self.parts.append((hashes[at], keys[at], np.minimum.reduceat(lows[order], first), np.maximum.reduceat(highs[order], first), sizes[at], b"".join([text(i) for i in at.tolist()])))
        self.held += 1
        if self.held == 64:
            self.parts, self.held = [self.all()], 1

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Hashes (ascending), keys, lows, highs, sizes and text of the distinct segments so far."""
        if len(self.parts) == 1:
            return self.parts[0]
        hashes, keys, lows, highs, sizes = (np.concatenate([p[i] for p in self.parts]) for i in range(5))
        text = b"".join([p[5] for p in self.parts])
        ends = np.cumsum(sizes)
        order = np.argsort(hashes, kind="stable")
        first = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
        at = order[first]
        joined = b"".join([text[e - n : e] for e, n in zip(ends[at].tolist(), sizes[at].tolist(), strict=True)])
        return hashes[at], keys[at], np.minimum.reduceat(lows[order], first), np.maximum.reduceat(highs[order], first), sizes[at], joined


def _send_segments(buckets: int, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = None, _Distinct()
        for block, answers, texts in split_answers(batches):
            if texts is None:
                if found.parts:
                    yield _packed(block, found.all(), buckets)
                known, found = None, _Distinct()
                continue
            known = np.sort(np.frombuffer(b"".join(answers), np.uint64)) if known is None else known
            for part, data, offsets in slices(texts):
                minimizers, starts, ends, docs = segments(data, offsets, width, seed)
                hit = np.flatnonzero(_member(minimizers, known))
                if not len(hit):
                    continue
                starts, ends, ids, raw = starts[hit], ends[hit], _ids(part)[docs[hit]], data.tobytes()
                found.add(range_hash(data, starts, ends), minimizers[hit], ids, ids, ends - starts, lambda i, s=starts, e=ends, r=raw: r[s[i] : e[i]])

    return run


def _packed(block: int, found: tuple, buckets: int) -> pa.RecordBatch:
    _, keys, lows, highs, sizes, text = found
    edges = np.array([(i << 64) // buckets for i in range(buckets)], dtype=np.uint64)
    bucket = np.searchsorted(edges, keys, "right") - 1
    order = np.lexsort((keys, bucket))
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        held = b"".join([text[e - n : e] for e, n in zip(ends[own].tolist(), sizes[own].tolist(), strict=True)])
        rows.append((int(bucket[own[0]]), block, keys[own].astype(np.uint8).tobytes(), sizes[own].astype(np.int32).tobytes(), lows[own].tobytes(), highs[own].tobytes(), held))
    kinds = (pa.int32(), pa.int32(), *(pa.binary(),) * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _SEGMENTS.split(", ")])


def covers(data: np.ndarray, offsets: np.ndarray, lows: np.ndarray, highs: np.ndarray, width: int) -> np.ndarray:
    """Of distinct segments and their smallest and largest ids: for each byte the smallest id with a maximal repeat that covers it, LAST where there is none."""
    cover = np.full(len(data), LAST)
    array = SuffixArray(data, offsets, width)
    lengths, first, last = array.maximal(width, highs > lows)
    if not len(lengths):
        return cover
    own, high = np.append(lows[array.owner], LAST), highs[array.owner]
    least = np.minimum.reduceat(own, np.stack([first, last + 1], 1).ravel())[::2]
    levels: dict[int, np.ndarray] = {}  # level k: the smallest id for the 2**k bytes from a place on
    step = np.cumsum(last - first + 1)
    for a in range(0, int(step[-1]), OCCURRENCES):  # in turns, as a string may be in many intervals
        i, j = np.searchsorted(step, [a, a + OCCURRENCES], "right")
        n = (last - first + 1)[i:j]
        which = np.repeat(np.arange(i, j), n)
        at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        lower = high[at] > least[which]
        at, which = array.order[at[lower]], which[lower]
        size, low = lengths[which], least[which]
        level = np.log2(size).astype(np.int64)
        for k in np.unique(level).tolist():
            these = level == k
            table = levels.setdefault(k, np.full(len(data), LAST))
            np.minimum.at(table, at[these], low[these])
            np.minimum.at(table, at[these] + size[these] - (1 << k), low[these])
    for k in range(max(levels, default=0), 0, -1):
        table = levels.pop(k, None)
        if table is not None:
            below, half = levels.setdefault(k - 1, np.full(len(data), LAST)), 1 << (k - 1)
            np.minimum(below, table, out=below)
            np.minimum(below[half:], table[:-half], out=below[half:])
    return levels.get(0, cover)


def _overlapping(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Which segments share a string with another one, by the strings' hashes."""
    hashes = window_hash(data, width)
    inside = np.ones(len(data), bool)
    for j in range(1, width):
        inside[offsets[1:] - j] = False
    at = np.flatnonzero(inside)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) - width + 1)
    own = hashes[at]
    order = np.argsort(own)
    same = np.zeros(len(own), bool)
    equal = own[order][1:] == own[order][:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.zeros(len(offsets) - 1, bool)
    out[owner[order[same]]] = True
    return out


def _picked(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = offsets[which + 1] - offsets[which]
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[which] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    return data[at], np.r_[0, ends]


#: A removed run of a segment: its hash, first byte and end in it, and the smallest id that has it.
_RUN = np.dtype([("segment", "<u8"), ("start", "<i4"), ("end", "<i4"), ("low", "<i8")])


def _answer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, asked = _Distinct(), []
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(1)[i].as_py()
                subs, sizes, lows, highs = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((2, np.uint8), (3, np.int32), (4, np.int64), (5, np.int64)))
                raw = batch.column(6)[i].as_buffer().to_pybytes()
                ends = np.cumsum(sizes, dtype=np.int64)
                hashes = range_hash(np.frombuffer(raw, np.uint8), ends - sizes, ends)
                found.add(hashes, subs, lows, highs, sizes.astype(np.int64), lambda k, e=ends, n=sizes, r=raw: r[e[k] - n[k] : e[k]])
                asked.append((block, hashes, highs.copy()))
        if not asked:
            return
        hashes, subs, lows, most, sizes, text = found.all()
        del found
        data, offsets = np.frombuffer(text, np.uint8), np.r_[0, np.cumsum(sizes)]
        order = np.argsort(subs, kind="stable")
        bounds = [0, *(np.flatnonzero(np.diff(subs[order])) + 1).tolist(), len(order)]
        chunk, held, runs = [], 0, []
        for k in range(len(bounds) - 1):
            own = order[bounds[k] : bounds[k + 1]]
            picked, cuts = _picked(data, offsets, own)
            own = own[_overlapping(picked, cuts, width) | (most[own] > lows[own])]
            chunk.append(own)
            held += int(sizes[own].sum())
            if held >= ARRAY_BYTES or k == len(bounds) - 2:
                runs.append(_runs(data, offsets, hashes, lows, most, np.concatenate(chunk), width))
                chunk, held = [], 0
        runs = np.concatenate(runs)
        runs = runs[np.lexsort((runs["start"], runs["segment"]))]
        for block, own, highs in asked:
            place = np.argsort(own)
            own, highs = own[place], highs[place]
            a, b = (np.searchsorted(runs["segment"], own, side) for side in ("left", "right"))
            n = b - a
            rows = runs[np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            rows = rows[rows["low"] < np.repeat(highs, n)]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), binary([rows.tobytes()])], ["block", "runs"])

    return run


def _runs(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, lows: np.ndarray, highs: np.ndarray, which: np.ndarray, width: int) -> np.ndarray:
    """The runs of equal cover of some segments."""
    if not len(which):
        return np.zeros(0, _RUN)
    picked, cuts = _picked(data, offsets, which)
    cover = covers(picked, cuts, lows[which], highs[which], width)
    new = np.ones(len(cover), bool)
    new[1:] = cover[1:] != cover[:-1]
    new[cuts[:-1]] = True
    starts = np.flatnonzero(new)
    owner = np.searchsorted(cuts, starts, "right") - 1
    runs = np.zeros(len(starts), _RUN)
    runs["segment"], runs["low"] = hashes[which][owner], cover[starts]
    runs["start"], runs["end"] = starts - cuts[owner], np.r_[starts[1:], len(cover)] - cuts[owner]
    return runs[runs["low"] < LAST]


def _cut(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for _, answers, texts in split_answers(batches):
            if texts is None:
                known = None
                continue
            if known is None:
                known = np.sort(np.frombuffer(b"".join(answers), _RUN), order="segment", kind="stable")
            for part, data, offsets in slices(texts):
                ids = _ids(part)
                _, starts, ends, docs = segments(data, offsets, width, seed)
                hashes = range_hash(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
                a, b = (np.searchsorted(known["segment"], hashes, side) for side in ("left", "right"))
                n = b - a
                which = np.repeat(np.arange(len(starts)), n)
                rows = known[np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                gone_runs = rows["low"] < ids[docs[which]]
                at, rows = starts[which][gone_runs], rows[gone_runs]
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, at + rows["start"], 1)
                np.add.at(change, at + rows["end"], -1)
                gone = np.cumsum(change[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < offsets[1:]]
                begins[inner] = gone[inner]
                total, spans = (np.r_[0, np.cumsum(x)] for x in (gone, begins))
                kept = [data[x:y][~gone[x:y]].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("id")),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()),
                        pa.array(spans[offsets[1:]] - spans[offsets[:-1]], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                        binary(kept),
                    ],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def repeated_bytes_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) per row of docs; ids are integers.

    A byte goes if a string of `width` bytes of its document covers it that also starts in a document with a smaller id. Null texts are
    empty. Null ids come after all others. Rows that share an id are one document's, none of them before the other, so of
    repeated rows none goes by the other.
    """
    spark = prepare(docs.sparkSession)
    scratch, n = Scratch(spark, "suffix"), partitions(spark)
    blocks = text_blocks(docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")), "id", "text", n)
    shared = blocks.repartitionById(n, F.col("block")).mapInArrow(_send_minimizers(n, width, seed), PACKED)
    shared = scratch.keep(repeated(shared, n), "shared")
    scratch.tidy()
    sent = with_answers(blocks, shared, n, "binary").mapInArrow(_send_segments(n, width, seed), _SEGMENTS)
    runs = scratch.keep(sent.repartitionById(n, F.col("bucket")).mapInArrow(_answer(width), "block int, runs binary"), "runs")
    del sent
    scratch.drop("shared")
    scratch.tidy()
    kinds = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return with_answers(blocks, runs, n, "binary").mapInArrow(_cut(width, seed), kinds).withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- the groups


def _all_segments(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for _, answers, texts in split_answers(batches):
            if texts is None:
                known = None
                continue
            known = np.sort(np.frombuffer(b"".join(answers), np.uint64)) if known is None else known
            for part, data, offsets in slices(texts):
                minimizers, starts, ends, docs = segments(data, offsets, width, seed, None)
                hit = np.flatnonzero(_member(minimizers, known))
                ids, raw = part.column(part.schema.get_field_index("id")), data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(minimizers[hit].view(np.int64)),
                        ids.take(pa.array(docs[hit])),
                        pa.array(starts[hit] - offsets[docs[hit]], pa.int64()),
                        binary([raw[a:b] for a, b in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)]),
                    ],
                    ["key", "id", "start", "bytes"],
                )

    return run


def _groups(width: int):
    def found(held: dict[bytes, list[tuple]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        texts = list(held)
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
        array = SuffixArray(data, offsets, width)
        raw = data.tobytes()
        for length, first, last in zip(*(x.tolist() for x in array.maximal(width, np.array([len(held[t]) > 1 for t in texts]))), strict=True):
            at, owners = array.order[first : last + 1], array.owner[first : last + 1]
            string = raw[at[0] : at[0] + length]
            for place, owner in zip((at - offsets[owners]).tolist(), owners.tolist(), strict=True):
                rows = held[texts[owner]]
                yield pa.RecordBatch.from_arrays(
                    [binary([string] * len(rows)), pa.array([length] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] + place for r in rows], pa.int64())], ["repeat", "length", "id", "start"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    yield from found(held)
                    key, held = row[0], {}
                held.setdefault(row[3], []).append((row[1], row[2]))
        yield from found(held)

    return run


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """repeat (binary), length, id, start: a row for each occurrence, anywhere in docs, of each maximal repeat of `width` bytes or more.

    All rows with one value of repeat are its group. Repeats are maximal within segments (runs of strings with one minimizer): a
    longer one is several groups that overlap by width - 1 bytes, and any string of `width` bytes that occurs in two documents is in one.
    Strings that only one document holds, however often, have no group unless their minimizer is another's too. Null texts are empty, ids integers (null too). A task holds the distinct segments of one minimizer and the places of all that equal them.
    """
    spark = prepare(docs.sparkSession)
    scratch, n = Scratch(spark, "groups"), partitions(spark)
    blocks = text_blocks(docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")), "id", "text", n)
    shared = blocks.repartitionById(n, F.col("block")).mapInArrow(_send_minimizers(n, width, seed), PACKED)
    shared = scratch.keep(repeated(shared, n), "shared")
    rows = with_answers(blocks, shared, n, "binary").mapInArrow(_all_segments(width, seed), "key long, id long, start long, bytes binary")
    dealt = rows.repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_groups(width), "repeat binary, length long, id long, start long").distinct().withColumnRenamed("id", id_col)
