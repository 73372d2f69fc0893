"""The other operators: round trips, brute force, closed forms, edge cases and held-out accuracy."""

import gzip
import hashlib
import json
import random
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import bpe, compression_quality, fingerprints, media, source_mixing, tool_calls, warc
from tidewright.llm.core import Scratch

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "x", "Hello world's  end\n\n 12345 é漢字🙂", "a" * 300, "word " * 400, "\t\n x", "same", "same"]
SCHEMA = "doc_id long, text string, id long, size string, __size int"


def table(spark, texts=TEXTS, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, 7, "s", 3) for i, t in enumerate(texts)], SCHEMA)


# ---------------------------------------------------------------- byte-level BPE


def slow_bpe(text):
    """Merges by rank, one pair after the other."""
    import regex

    own = bpe.encoding(RANKS, PATTERN)
    ranks, out = own._mergeable_ranks, []
    for match in regex.findall(PATTERN, text):
        parts = [bytes([b]) for b in match.encode()]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_bpe_round_trip(spark):
    for r in bpe.decode(bpe.encode(table(spark), RANKS, PATTERN), RANKS, PATTERN).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == slow_bpe(text) and bytes(r["bytes"]) == text.encode()
    for r in bpe.digests(table(spark), RANKS, PATTERN).collect():
        ids = slow_bpe(TEXTS[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1'st \n\t　\x1d.é", max_size=40), st.integers(1, 6))
def test_cuts_change_no_id(text, size):
    own = bpe.encoding(RANKS, PATTERN)
    parts = list(bpe.pieces(text, size))
    assert "".join(parts) == text and [i for p in parts for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_estimate():
    rng = random.Random(2)
    a = "".join(rng.choices("abcdef ", k=3000))
    b = a[:2000] + "".join(rng.choices("abcdef ", k=1000))
    sets = [{t[i : i + 12] for i in range(len(t) - 11)} for t in (a, b)]
    x, y = (fingerprints.written(fingerprints.bottom(t.encode())) for t in (a, b))
    assert fingerprints.resemblance(x, y) == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), abs=0.13)
    assert fingerprints.distinct(x) == pytest.approx(len(sets[0]), rel=0.3)
    assert fingerprints.containment(x, y) == pytest.approx(len(sets[0] & sets[1]) / len(sets[0]), abs=0.2)
    assert fingerprints.resemblance(x, x) == 1 and fingerprints.merge(x, y) == fingerprints.merge(y, x)


def test_merged_parts_equal_the_whole():
    text = bytes(random.Random(1).choices(b"abc", k=4000))
    halves = [fingerprints.written(fingerprints.bottom(t)) for t in (text[:2011], text[2000:])]  # they overlap by a shingle less one byte
    assert fingerprints.merge(*halves) == fingerprints.written(fingerprints.bottom(text))


def test_estimates_against_sets(spark):
    """Fingerprints of fewer than k shingles hold whole sets, so that estimates are the sets' own; larger ones are near, here and merged by Spark."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 90))) for _ in range(40)] + ["".join(rng.choices("abcdefg ", k=4000)) for _ in range(4)]
    texts += [texts[i][:50] + texts[i + 1][:40] for i in range(38)]
    sets = [{t.encode()[i : i + 12] for i in range(max(1, len(t.encode()) - 11))} if t else set() for t in texts]
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(table(spark, texts)).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in (i, (i * 7 + 1) % len(texts), 44 + i % 38)]
    df = spark.createDataFrame([(i, j, prints[i], prints[j]) for i, j in pairs], "i int, j int, a string, b string")
    for r in df.select("i", "j", fingerprints.resemblances("a", "b").alias("r"), fingerprints.containments("a", "b").alias("c"), fingerprints.distincts("a").alias("d")).collect():
        a, b = sets[r["i"]], sets[r["j"]]
        exact = len(a | b) < fingerprints.K
        assert r["r"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1, abs=1e-12 if exact else 0.2)
        assert r["c"] == pytest.approx(len(a & b) / len(a) if a else 1, abs=1e-12 if exact else 0.3)
        assert r["d"] == pytest.approx(len(a), rel=1e-12 if len(a) < fingerprints.K else 0.35)
    parts = spark.createDataFrame([(None if i % 5 == 4 else i % 5, prints[i]) for i in range(len(texts))] + [(1, None)], "group int, fingerprint string").repartition(3)
    for r in fingerprints.merged(parts, "group").collect():
        own = set().union(*(sets[i] for i in range(len(texts)) if (None if i % 5 == 4 else i % 5) == r["group"]))
        assert fingerprints.distinct(r["fingerprint"]) == pytest.approx(len(own), rel=0.35)
        again = ""
        for i in range(len(texts)):
            if (None if i % 5 == 4 else i % 5) == r["group"]:
                again = fingerprints.merge(again, prints[i]) if again else prints[i]
        assert again == r["fingerprint"]


@pytest.mark.parametrize("ids", [None, [5, 5, None, 3, 9, 8, 8, 1, None, 2], [4] * 10, [None] * 10])
def test_edited_and_next(spark, ids):
    rows = [((i if ids is None else ids[i]), t) for i, t in enumerate(TEXTS)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, tuple(-b for b in (r[1] or "").encode()) + (1,)))
    expected = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        own, changed, other = (fingerprints.written(fingerprints.bottom(x.encode())) for x in (t, edited, after))
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, fingerprints.resemblance(own, changed), fingerprints.resemblance(own, other)))
    out = [tuple(r) for r in fingerprints.edited_and_next(table(spark, TEXTS, ids)).collect()]
    assert sorted(out, key=repr) == sorted(expected, key=repr)


# ---------------------------------------------------------------- media


def test_media_round_trip(spark):
    out = media.round_trip(table(spark)).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = media.to_png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == media.feature(payload)


def plain_png(data):
    """A decoder of its own: the image's chunks by their names, its rows by stride, no checks."""
    packed, at = b"", 8
    width, height, depth, colour = int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), data[24], data[25]
    while data[at + 4 : at + 8] != b"IEND":
        n = int.from_bytes(data[at : at + 4], "big")
        packed += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    raw = zlib.decompressobj().decompress(packed)
    assert (depth, colour, len(raw)) == (8, 0, height * (width + 1)) and not any(raw[:: width + 1])
    return b"".join(raw[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height)), width


def test_stored_images_by_another_decoder(spark):
    folder = Scratch(spark, "test").path("plain")
    media.write_archives(table(spark), folder).collect()
    spark.dataSource.register(media.ArchiveSource)
    seen = []
    for r in spark.read.format("media_archive").load(folder).collect():
        _, id_, n = r["member"].removesuffix(".png").split("_")
        samples, width = plain_png(bytes(r["payload"]))
        raw = (TEXTS[int(id_)] or "").encode()
        assert width == 192 and samples[: int(n)] == raw and set(samples[int(n) :]) <= {32} and len(samples) % 192 == 0 and samples
        seen.append(int(id_))
        counts = [samples.count(bytes([b])) for b in range(256)]
        mean = sum(b * c for b, c in enumerate(counts)) / len(samples)
        found = media.feature(samples).split(";")
        assert float(found[0]) == pytest.approx(mean, abs=1e-4) and [float(x) for x in found[3].split(",")] == pytest.approx([sum(counts[i : i + 16]) / len(samples) for i in range(0, 256, 16)], abs=1e-4)
    assert sorted(seen) == list(range(len(TEXTS)))


def test_archives_end_at_their_size(spark):
    folder = Scratch(spark, "test").path("small")
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["x" * 100] * 50})
    files = [b.to_pylist()[0] for b in media._write(folder, 1000)(iter([batch]))]
    assert len(files) > 3 and sum(f["members"] for f in files) == 50
    spark.dataSource.register(media.ArchiveSource)
    assert spark.read.format("media_archive").option("rangeBytes", "500").load(folder).count() == 50


def test_archives_are_read_in_ranges(spark):
    folder = Scratch(spark, "test").path("archives")
    files = media.write_archives(table(spark, [f"text {i}" for i in range(300)]).repartition(2), folder).collect()
    spark.dataSource.register(media.ArchiveSource)
    whole = spark.read.format("media_archive").load(folder)
    parts = spark.read.format("media_archive").option("rangeBytes", "1000").load(folder)
    assert parts.rdd.getNumPartitions() > 20 and sum(f["members"] for f in files) == 300
    key = lambda df: sorted((r["archive"], r["header_offset"], bytes(r["payload"])) for r in df.collect())
    assert len(key(whole)) == 300 and key(parts) == key(whole)


def test_a_member_is_fetched_again_by_its_offset(tmp_path):
    from pyarrow import fs

    path = f"{tmp_path}/a.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for i in range(3):
            archive.writestr(f"{i}.png", f"payload {i}" * 9)
    member = zipfile.ZipFile(path).infolist()[1]

    class Broken:
        def read_at(self, size, offset):
            raise OSError("lost")

    class Short:
        def read_at(self, size, offset):
            return b"PK"

    system = fs.LocalFileSystem()
    assert media.fetch(system, path, member, Short()) == b"payload 1" * 9
    assert media.fetch(system, path, member, Broken()) == b"payload 1" * 9
    with open(path, "r+b") as f:
        f.seek(member.header_offset + 40)
        f.write(b"!!")
    with pytest.raises(OSError, match="checksum"):
        media.fetch(system, path, member)


# ---------------------------------------------------------------- WARC


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=8), max_size=9))
def test_loser_tree(runs):
    merged = list(warc.LoserTree([iter(sorted(r)) for r in runs], key=lambda x: x))
    assert merged == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark):
    long, other = "<p>" + "é" * 80, "y" * 100
    pages = [(4, "http://B.example.org:80/x?b=2&a=1#f", long), (2, "https://www.a.example.org/", long), (9, None, other), (9, "http://a.org/", other), (7, "http://a.org", "short"), (8, "http://a.org", "short"), (1, "bad://[", None), (None, "http://z.org", other), (None, "http://z.org", "z" * 200), (3, "http://z.org/\r\nX: y", "")]
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string, url_key string")
    out = warc.round_trip(df).collect()
    expected = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if h == html and p is not None]
        revisit = len(raw) >= 100 and bool(same) and (page_id is None or page_id > min(same))
        expected.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=repr) == sorted(expected, key=repr)


def test_index_is_in_global_order(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i % 3}", "x" * (i % 5)) for i in range(200)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    scratch = Scratch(spark, "test-warc")
    runs = warc.write(pages, scratch)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = warc.merge(runs).collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in rows]
    assert len(rows) == 200 and keys == sorted(keys) and len({r["run"] for r in rows}) > 1


def test_records_are_gzip_members():
    data = gzip.compress(warc.record(1, "http://a.org/", "2024-01-01T00:00:00Z", b"\r\n\r\nbody", "d", None, False))
    headers, http, payload = warc.parse(gzip.decompress(data))
    assert headers["warc-type"] == "response" and http["content-length"] == "8" and payload == b"\r\n\r\nbody"
    assert warc.url_key("HTTPS://www.Example.COM:443/A?z=1&b=2#x") == "com,example)/a?b=2&z=1"


# ---------------------------------------------------------------- mixing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 100), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 90))
def test_apportionment_is_by_highest_quotients(parties, seats):
    weights, caps = [w for w, _ in parties], [c for _, c in parties]
    slow = [0] * len(weights)
    for _ in range(min(seats, sum(caps))):
        slow[max((i for i in range(len(slow)) if slow[i] < caps[i]), key=lambda i: (weights[i] / (2 * slow[i] + 1), -i))] += 1
    assert source_mixing.sainte_lague(weights, seats, caps) == slow


def test_targets():
    assert source_mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert source_mixing.targets([10, 100]) == pytest.approx([20, 145]) and source_mixing.targets([]) == [] and source_mixing.targets([0, 0]) == [0, 0]


def sources(spark, n=400):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 60, 900])) or None, rng.choice(["a", "a", "b", "ü", "Z", None]), "x", 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size string, __i int")


def test_mixture_meets_its_targets(spark):
    rows, df = sources(spark)
    out = source_mixing.mixture(df).collect()
    assert {r["doc_id"]: r["size"] for r in out} == {r[0]: len((r[1] or "").split()) for r in rows}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    source_of, taken = {r[0]: r[2] for r in rows}, {}
    for r in out:
        s = source_of[r["doc_id"]]
        taken.setdefault(s, [0, r["target"], r["source_size"]])[0] += r["taken"]
    names = [*sorted(s for s in taken if s is not None), None]
    assert [taken[s][1] for s in names] == pytest.approx(source_mixing.targets([taken[s][2] for s in names]))
    assert all(abs(t - target) <= 32 for t, target, _ in taken.values())
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, source_mixing.mixture(df.repartition(7)).collect()), key=repr)


def test_blocks_by_hand(spark):
    """The blocks of every source, one by one to the shard with the highest quotient, and each shard's in a row from its place."""
    rows, df = sources(spark, 90)
    big = [(1000 + i, "v " * 3000, "a", "x", 1) for i in range(60)]
    df = df.unionByName(spark.createDataFrame(big, df.schema))
    planned = source_mixing.plan(df, "doc_id", "text", "source", 20, ["doc_id", "source"]).collect()
    out = {r["doc_id"]: r for r in source_mixing.mixture(df).collect()}
    words = {r["row"]["doc_id"]: r["__size"] for r in planned}
    total = sum(words.values())
    names = [*sorted({r[2] for r in rows + big if r[2] is not None}), None]
    sizes = [sum(words[r[0]] for r in rows + big if r[2] == s) for s in names]
    wanted = source_mixing.targets(sizes)
    assert sum(wanted) == pytest.approx(1.5 * total) and all(w <= 2 * n + 1e-6 for w, n in zip(wanted, sizes, strict=True))
    seats, given = round(sum(wanted) / 16), [0] * len(names)
    for _ in range(seats):
        given[max(range(len(names)), key=lambda i: (wanted[i] / (2 * given[i] + 1), -i))] += 1
    for i, s in enumerate(names):
        taken = sum(out[r[0]]["taken"] for r in rows + big if r[2] == s)
        assert abs(taken - 16 * given[i]) <= 16 * 2 * max(1, -(-sizes[i] // source_mixing.SHARD_WORDS[0]))
    for r in planned:  # a document's share of a last round is one or two runs of words that don't overlap
        assert 0 <= r["__from_2"] <= r["__to_2"] <= r["__from_1"] <= r["__to_1"] <= r["__size"] or r["__from_1"] == r["__to_1"] or r["__from_2"] == r["__to_2"]


def test_mix_rows_hold_what_is_taken(spark):
    rows, df = sources(spark)
    taken = {r["doc_id"]: r["taken"] for r in source_mixing.mixture(df).collect()}
    words = {}
    for r in source_mixing.mix(df).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {d: n for d, n in taken.items() if n}


# ---------------------------------------------------------------- quality


def test_scores_of_a_plain_scorer(spark):
    """The feature, logistic curve and score, written out with the compressor's plain interface."""
    import zstandard

    good, bad = (b"the river runs to the sea and the hills " * 30), (b"BUY NOW!!! $$$ CLICK HERE >>> " * 30)
    model = compression_quality.Model(good, bad, 8.0, -0.25)
    texts = [None, "", "x", "the river runs past the hills and on to the sea " * 40, "CLICK HERE >>> BUY NOW!!! " * 40, "the sea $$$ é " * 200]
    out = {r["doc_id"]: r["score"] for r in compression_quality.score(table(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        raw, sizes = (t or "").encode(), []
        for words in (good, bad):
            own = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=compression_quality.LEVEL)
            tool = zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(tool.compress(raw[k : k + compression_quality.PIECE])) for k in range(0, len(raw), compression_quality.PIECE)))
        x = (sizes[1] - sizes[0]) / len(raw) if raw else 0.0
        assert out[i] == pytest.approx(1 / (1 + 2.718281828459045 ** -(8.0 * x - 0.25)), rel=1e-9)
    assert out[3] > out[0] > out[4]


def test_quality_learns_from_training_rows_only(spark):
    rng = random.Random(7)
    good, rows, labels = [f"{a}{b}" for a in "kmnprst" for b in ("anda", "ore", "ilu", "umbe")], [], []
    for i in range(400):
        bad = i % 4 == 0
        words = rng.choices(good, k=rng.randint(20, 120))
        rows.append((i, " ".join(f"{w.upper()}!!" if bad else w for w in words)))
        labels.append((i, (1 - int(bad)) if zlib.crc32(str(i).encode()) % 3 != 1 else int(bad), 0))  # held-out labels are wrong on purpose
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in compression_quality.scores(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [r for r in out.values() if r["held_out"] and r["doc_id"] < 400]
    assert len(out) == 402 and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert out[900]["score"] == out[901]["score"] and all(0 <= r["score"] <= 1 for r in out.values())
    none = compression_quality.scores(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}


# ---------------------------------------------------------------- tool calls


def test_tool_calls(spark):
    schema = {"t": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}
    rows = [
        (1, 5, "result", "a", None, None, "early"), (1, 6, "call", "a", "t", '{"n": 2}', None), (1, 7, None, None, None, None, "hi"), (1, 8, "call", "b", "t", '{"n": 0}', None), (1, 9, "call", "c", "t", "{", None),
        (1, 9, "call", "c", "t", "{", None), (2, 1, "result", "a", None, None, "other conversation"), (2, None, "call", None, "u", None, None), (None, 0, "call", "z", "t", '{"n":1,"m":2}', None), (2, 9000, "message", None, None, None, "late"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, kind string, call_id string, name string, arguments string, content string")
    out = sorted(tool_calls.link(df, schema).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["position"]))
    one = [r for r in out if r["conv_id"] == 1]
    assert [(r["turn"], r["kind"], r["position"]) for r in one] == [(6, "call", 0), (5, "result", 1), (7, "message", 2), (8, "call", 3), (9, "call", 4), (9, "call", 5)]
    assert [r["linked"] for r in one] == [True, True, None, False, False, False] and [r["valid"] for r in one] == [True, None, None, False, False, False]
    assert json.loads(one[0]["json"]) == {"kind": "call", "id": "a", "name": "t", "arguments": {"n": 2}, "linked": True}
    assert [(r["linked"], r["position"]) for r in out if r["conv_id"] == 2] == [(False, 0), (False, 1), (None, 2)] and out[-1]["valid"] is False


def test_calls_that_cannot_be_written_again(spark):
    rows = [(1, 1, "call", "a", "t", '{"query":"\\ud800"}', None), (1, 2, "call", "b", "t", "[" * 100_000, None), (1, 3, "call", "c", "t", "NaN", None), (1, 4, "call", "d", "t", '{"x":' + "[" * 300 + "]" * 300 + "}", None), (1, 5, "result", "a", None, None, "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, kind string, call_id string, name string, arguments string, content string")
    out = sorted(tool_calls.link(df, {"t": {}}).collect(), key=lambda r: r["position"])
    assert [r["valid"] for r in out] == [False, False, False, True, None]
    assert [json.loads(out[i]["json"])["arguments"] for i in range(3)] == [rows[i][5] for i in range(3)] and len(out[4]["json"]) > 3_000_000
    assert tool_calls.link(df.limit(0), {"t": {}}).collect() == []


def test_canonical_json_has_one_form():
    assert tool_calls.canonical(json.loads('{"b": [1, {"z":null, "a":"é"}], "a": 1.0}')) == '{"a":1.0,"b":[1,{"a":"é","z":null}]}'


def test_empty_tables(spark):
    empty = table(spark, [])
    for f in (fingerprints.fingerprints, fingerprints.edited_and_next, media.round_trip):
        assert f(empty).collect() == []
    assert bpe.digests(empty, RANKS, PATTERN).collect() == []
    nothing = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mixing.mixture(nothing).collect() == [] and source_mixing.mix(nothing).collect() == []
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert compression_quality.quality_filter(empty, spark.createDataFrame([], "doc_id long, quality int")).collect() == []
