"""WARC archives of captures, and an index over them that merges each archive's sorted run.

Writing: of records with equal payloads of MIN_REVISIT bytes or more, the one with the smallest page_id is a response, the others
are revisits that refer to it and hold no payload. Each task writes one file of gzip members under a name of its own, and reports an index
run sorted by URL key and timestamp; files of failed or repeated attempts aren't reported and hence never read. Merging: the
key space is cut into ranges; each range gets its slices of all runs, holds them as Arrow batches (about 100 bytes a record, so a
range of a million records takes 100 MB) and merges them with a loser tree while it writes, so that the ranges in their order are the capture histories of all URLs. Reading: records are fetched by file and offset in the order of the index.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.core import Scratch, col, partitions, prepare
from tidewright.llm.media import _filesystem

MIN_REVISIT, LEVEL = 100, 5
#: Where pages have no time of capture, they were captured at this time plus as many seconds as their id.
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
INDEX = "run string, url_key string, captured string, page_id long, offset long, length long"


def url_key(url: str | None) -> str:
    """The host's labels in reverse order, then path and sorted query, in lower case; without scheme, www, default port and fragment."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    host = host.removeprefix("www.")
    port = f":{port}" if port and port not in (80, 443) else ""
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{query}" if query else "")


def record(page_id: int | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record: an HTTP response with the payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c >= " ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {captured}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's headers (names in lower case), its HTTP headers, and the payload that it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


class LoserTree:
    """Merges sorted iterators: a tournament whose inner nodes keep the losers, so that the next row takes one comparison a level."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads: list = [self._next(i) for i in range(len(self.runs))] + [None] * (not self.runs)
        self.tree = [-1] * self.k  # tree[0] is the winner
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.tree[node] == -1:  # the first to arrive waits for its opponent
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.heads[winner := self.tree[0]] is not None:
            yield self.heads[winner][2]
            self.heads[winner] = self._next(winner)
            self._play(winner)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _filesystem(folder)
        system.create_dir(top, recursive=True)
        name, index, offset = f"{uuid.uuid4().hex}.warc.gz", [], 0
        with system.open_output_stream(f"{top}/{name}", compression=None) as out:
            for batch in batches:
                for page_id, url, html, captured, digest, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                    data = gzip.compress(record(page_id, url, captured, (html or "").encode(), digest, refers_to, revisit), LEVEL, mtime=0)
                    out.write(data)
                    index.append((name, url_key(url), captured, page_id, offset, len(data)))
                    offset += len(data)
        if not index:
            system.delete_file(f"{top}/{name}")
        index.sort(key=lambda r: (r[1].encode(), r[2], r[3] is None, r[3] or 0, r[4]))
        yield from _index(index)

    return run


def _index(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    for i in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 4096], strict=True), kinds, strict=True)], ["run", "url_key", "captured", "page_id", "offset", "length"])


def _slice(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """A run's rows, one batch at a time."""
    for part in parts:
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key range's slices of all runs, held as Arrow batches, merged row by row."""
    runs: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        names = batch.column(0)
        cuts = [0, *(np.flatnonzero(np.asarray(pc.not_equal(names[1:], names[:-1]))) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            runs.setdefault(names[a].as_py(), []).append(batch.slice(a, b - a))
    merged = iter(LoserTree([_slice(parts) for parts in runs.values()], key=lambda r: (r[1].encode(), r[2], r[3] is None, r[3] or 0, r[0], r[4])))
    while rows := list(islice(merged, 4096)):
        yield from _index(rows)


def write(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured_col: str | None = None) -> DataFrame:
    """Writes the archives at once and returns their index runs (INDEX), each sorted by URL key, time and page."""
    prepare(pages.sparkSession)
    payload = F.coalesce(col(payload_col), F.lit(""))
    if captured_col:
        captured = F.date_format(col(captured_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        seconds = F.lit(int(EPOCH.timestamp())) + F.coalesce(col(id_col).cast("long"), F.lit(0)) % 3_000_000_000
        captured = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(col(id_col).cast("long").alias("id"), col(url_col).alias("url"), payload.alias("html"), F.coalesce(captured, F.lit("")).alias("captured"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    # Only ids and digests of large enough payloads are compared; the payloads then join by digest and id, so that the copies of one page spread.
    slim = scratch.keep(rows.filter(F.octet_length("html") >= MIN_REVISIT).select("id", "digest"), "digests")
    first = slim.filter("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max("id").alias("last"))
    # Null ids can't be referred to: a group that has no other ids only has responses.
    first = scratch.keep(first.join(slim.filter("id is null").select("digest").distinct().withColumn("nameless", F.lit(True)), "digest", "left").filter("first < last or nameless").select("digest", "first"), "first")
    later = scratch.keep(slim.join(first, "digest").filter("id is null or id > first").select("digest", F.coalesce("id", F.lit(-1)).alias("at"), F.col("id").isNull().alias("none"), "first").distinct(), "later")
    rows = rows.withColumns({"at": F.coalesce("id", F.lit(-1)), "none": F.col("id").isNull()}).join(later, ["digest", "at", "none"], "left")
    rows = rows.select("id", "url", "html", "captured", "digest", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))
    runs = scratch.keep(rows.mapInArrow(_write(scratch.path("warc")), INDEX), "runs")
    scratch.drop("digests", "first", "later")
    return runs


def merge(runs: DataFrame) -> DataFrame:
    """The runs' rows in global order: by partition, and within it by URL key, time and page."""
    order = ["url_key", "captured", F.col("page_id").asc_nulls_last()]
    n = partitions(prepare(runs.sparkSession))
    ranged = runs.repartitionByRange(n, *order, "run", "offset").sortWithinPartitions("run", *order, "offset")
    return ranged.mapInArrow(_merge, INDEX)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _filesystem(folder)
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in (0, 4, 5)), strict=True))
            found = {}
            name, stream = None, None
            for place in sorted(places):
                if place[0] != name:
                    if stream:
                        stream.close()
                    name, stream = place[0], system.open_input_file(f"{top}/{place[0]}")
                found[place] = stream.read_at(place[2], place[1])
            if stream:
                stream.close()
            out = []
            for place, key, captured in zip(places, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                headers, http, payload = parse(zlib.decompress(found[place], 31))
                digest, size, kind = headers["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]), headers["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise OSError(f"a record of {place} differs from its digest")
                number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
                out.append((number(headers["warc-record-id"]), key, captured, size, digest, kind, number(headers.get("warc-refers-to")), payload if kind == "response" else None))
            columns = list(zip(*out, strict=True)) or [[]] * len(_RECORD)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], schema=_RECORD)

    return run


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read(index: DataFrame, scratch: Scratch) -> DataFrame:
    """The records that an index names, in its order; payload is null for revisits, whose size is that of the headers they repeat."""
    prepare(index.sparkSession)
    kinds = "page_id long, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return index.mapInArrow(_read(scratch.path("warc")), kinds)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url_key and captured per row of pages, read back through the merged index.

    Null payloads are empty. Of rows that share the smallest page_id and a payload, each is a response. Null ids come after
    all others: they revisit a row with an id, and are responses where no row of the group has one. A null URL has an empty host.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    return read(merge(write(pages, scratch)), scratch).drop("payload")
