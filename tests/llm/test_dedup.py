"""The three dedup operators against brute force, on texts made to meet their edges."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidewright.llm import minhash_dedup, substring_dedup, suffix_dedup
from tidewright.llm.core import Scratch, Words, range_hash, window_hash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id long, block int, n long"


def corpus(seed=3, n=60):
    """Unrelated texts, exact and near copies, chains of edits, a passage that many share, and edge cases."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(400)]
    passage = rng.choices(words, k=60)
    texts = []
    for i in range(n):
        text = rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 30, 80, 200]))
        if i % 5 == 0:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + passage + text[at:]
        if i % 7 == 0 and texts:
            text = list(rng.choice(texts))
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(text)
    for _ in range(25):  # a chain, each link an edit of the one before
        text = list(texts[-1])
        text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(text)
    lines = [" ".join(t).replace(" a", "\n A") for t in texts]
    return [*lines, None, "", " \t\n", "x", "X", "x y z", "ab " * 300, "   q", "Z" * 5000, lines[0], lines[0]]


def table(spark, texts):
    return spark.createDataFrame([(i, t, 7, 8, 9) for i, t in enumerate(texts)], SCHEMA)


def shingles(text, k):
    words = WORD.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(texts, k):
    sets, root = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    texts = corpus()
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(table(spark, texts), words=k).collect()}
    assert out == groups(texts, k)
    kept = {r["doc_id"] for r in minhash_dedup.near_dedup(table(spark, texts), words=k).collect()}
    assert kept == {i for i, (_, _, stays) in groups(texts, k).items() if stays}


def test_loose_group_loses_no_link(spark):
    """Edits of one text that are often unlike each other, so that stars alone don't settle the buckets."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = rng.choices(words, k=150)
    texts = []
    for _ in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(text))
    out = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(table(spark, texts), words=4).collect()}
    assert out == {i: c for i, (_, c, _) in groups(texts, 4).items()}


def cut_words(texts, width):
    lists = [WORD.findall((t or "").encode()) for t in texts]
    count = {}
    for w in lists:
        for i in range(len(w) - width + 1):
            count[tuple(w[i : i + width])] = count.get(tuple(w[i : i + width]), 0) + 1
    out = {}
    for d, w in enumerate(lists):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark):
    texts = corpus()
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeated_words_removed(table(spark, texts)).collect()}
    expected = cut_words(texts, 35)
    assert out == expected
    kept = {r["doc_id"]: r for r in substring_dedup.substring_dedup(table(spark, texts)).collect()}
    assert set(kept) == {i for i, (n, gone, _) in expected.items() if not gone or gone < n}
    assert all(kept[i]["text"] == texts[i] for i in kept if not expected[i][1]) and all(r["block"] == 8 for r in kept.values())


def cut_bytes(texts, ids, width):
    raw = [(t or "").encode() for t in texts]
    first = {}
    for b, d in zip(raw, ids, strict=True):
        for i in range(len(b) - width + 1):
            first[b[i : i + width]] = min(first.get(b[i : i + width], d), d)
    out = []
    for b, d in zip(raw, ids, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark):
    texts = [*corpus(n=40), "a" * 400, "a" * 700 + "b" * 60, "ab" * 90]
    out = suffix_dedup.repeated_bytes_removed(table(spark, texts)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=repr) == cut_bytes(texts, range(len(texts)), 50)


def test_nothing_goes_without_suffix_arrays(spark, monkeypatch):
    """Copies too are removed by intervals of a suffix array alone."""
    data, offsets = np.frombuffer(b"x" * 60 + b"abcdefghij" * 6, np.uint8), np.array([0, 60, 120])
    lows, highs = np.array([3, 5]), np.array([3, 9])
    assert (suffix_dedup.covers(data, offsets, lows, highs, 50)[60:] == 5).all()
    monkeypatch.setattr(suffix_dedup.SuffixArray, "maximal", lambda self, *a: (np.zeros(0, np.int64),) * 3)
    assert (suffix_dedup.covers(data, offsets, lows, highs, 50) == suffix_dedup.LAST).all()


def test_repeat_groups(spark):
    """Every group has all places of its string, and every string of 50 bytes that two documents hold is in a group."""
    texts = [*corpus(n=25)[:60], "ab" * 90, "ab" * 90]
    raw = [(t or "").encode() for t in texts]
    groups = {}
    for r in suffix_dedup.repeat_groups(table(spark, texts)).collect():
        groups.setdefault(bytes(r["repeat"]), []).append((r["doc_id"], r["start"]))
    covered = set()
    for string, places in groups.items():
        assert sorted(places) == [(d, i) for d, t in enumerate(raw) for i in range(len(t) - len(string) + 1) if t[i : i + len(string)] == string] and len(places) > 1
        covered |= {string[i : i + 50] for i in range(len(string) - 49)}
    owners = {}
    for d, t in enumerate(raw):
        for i in range(len(t) - 49):
            owners.setdefault(t[i : i + 50], set()).add(d)
    assert {s for s, d in owners.items() if len(d) > 1} <= covered


def test_repeated_ids_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten " * 3
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    out = sorted((r["doc_id"] or 99, r["n_removed"]) for r in suffix_dedup.repeated_bytes_removed(df).collect())
    assert out == [(1, 0), (1, 0), (2, 0), (99, len(text))]
    near = minhash_dedup.near_duplicates(df).collect()
    assert len(near) == 4 and {r["component_id"] for r in near if r["doc_id"] is None} == {None}
    assert substring_dedup.repeated_words_removed(df).count() == 4


def test_short_texts_share_a_band():
    """Hardly any pair of 4 and 5 shingles with 4 in common shares no band."""
    bins, rng = minhash_dedup.BANDS * minhash_dedup.ROWS, np.random.default_rng(5)
    probes, missed = minhash_dedup._probes(bins), 0
    for _ in range(12_000):
        x = rng.integers(0, 1 << 64, 5, np.uint64, endpoint=False)
        a, b = (minhash_dedup.sketch(np.sort(y), bins, probes).reshape(minhash_dedup.BANDS, -1) for y in (x, x[1:]))
        missed += not (a == b).all(axis=1).any()
    assert missed <= 1


def test_empty_tables(spark):
    empty = table(spark, [])
    for f in (minhash_dedup.near_duplicates, minhash_dedup.near_dedup, substring_dedup.repeated_words_removed, substring_dedup.substring_dedup, suffix_dedup.repeated_bytes_removed):
        assert f(empty).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=4, max_size=30), min_size=1, max_size=8, unique=True))
def test_maximal_repeats(texts):
    """Each group is all occurrences of a string, with different neighbours on both sides; every repeat of 4 is in one."""
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    array, seen = suffix_dedup.SuffixArray(data, offsets, 4), set()
    assert [bytes(data[i : i + r]) for i, r in zip(array.order, array.remaining, strict=True)] == sorted(t[i:] for t in raw for i in range(len(t) - 3))
    places = lambda s: {int(offsets[i]) + j for i, r in enumerate(raw) for j in range(len(r) - len(s) + 1) if r[j : j + len(s)] == s}
    for length, at in array.maximal_repeats(4):
        s = bytes(data[at[0] : at[0] + length])
        assert set(at.tolist()) == places(s) and len(at) > 1
        seen |= {s[i : i + 4] for i in range(length - 3)}
    expected = {r[i : i + 4] for r in raw for i in range(len(r) - 3) if len(places(r[i : i + 4])) > 1}
    assert seen == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=12), max_size=6))
def test_words_and_hashes(texts):
    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    found = [[bytes(words.data[a:b]) for a, b in zip(words.starts[i:j], words.ends[i:j], strict=True)] for i, j in zip(words.first[:-1], words.first[1:], strict=True)]
    assert found == [WORD.findall(r) for r in raw]


def test_hashes_agree_wherever_bytes_lie():
    data = np.frombuffer(b"xxabcdefgh--abcdefgh", np.uint8)
    windows = window_hash(data, 8)
    assert windows[2] == windows[12] and len(set(windows.tolist())) == len(windows) - 1
    a = range_hash(data, np.array([2, 12, 2]), np.array([10, 20, 9]))
    assert a[0] == a[1] != a[2]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_structured_words_stay_apart(spark, size):
    """Strings and their complements, for which hashes that are polynomials modulo a power of two agree."""
    one, other = thue_morse(size), thue_morse(size, "b", "a")
    data = np.frombuffer((one + other).encode(), np.uint8)
    a = range_hash(data, np.array([0, size]), np.array([size, 2 * size]))
    assert a[0] != a[1]
    words = np.array([5, 9], np.uint64)[[bin(i).count("1") % 2 for i in range(size)]]
    assert window_hash(words, size)[0] != window_hash(np.uint64(14) - words, size)[0]
    rest = [f"w{i}" for i in range(40)]
    texts = [" ".join([one, *rest[:34]]), " ".join([other, *rest[:34]]), one * 2, other * 2]
    out = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(table(spark, [" ".join([one] * 9), " ".join([other] * 9), *texts[2:]]), words=4).collect()}
    assert out == {i: i for i in range(4)}
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_words_removed(table(spark, texts)).collect()}
    assert removed == {i: 0 for i in range(4)}
    cut = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_bytes_removed(table(spark, texts)).collect()), key=repr)
    assert cut == cut_bytes(texts, range(4), 50)


def test_names_that_clash(spark):
    """Columns with dots, and with the names that operators use inside, come back as they were."""
    texts = corpus(n=12)[:14]
    names = ["doc.id", "te xt", "a.b", "__gone", "id", "block", "row", "n"]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)], T.StructType([T.StructField(n, T.StringType() if n == "te xt" else T.LongType()) for n in names]))
    near, cut = minhash_dedup.near_dedup(df, "doc.id", "te xt"), substring_dedup.substring_dedup(df, "doc.id", "te xt")
    assert near.columns == names and cut.columns == names
    assert {tuple(r)[2:] for r in near.collect() + cut.collect()} == {(1, 2, 3, 4, 5, 6)}
    assert len(suffix_dedup.repeated_bytes_removed(df, "doc.id", "te xt").collect()) == len(texts)


def test_tiles_find_what_all_pairs_find():
    """A tile's overlaps are those of all pairs, and its forest connects the same documents with one edge fewer than nodes."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(60)]
    found = minhash_dedup._overlaps(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(i + 1, 60))
    linked = rng.random((60, 60)) < 0.02
    linked |= linked.T
    np.fill_diagonal(linked, False)
    edges = list(minhash_dedup._forest(linked))
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        assert linked[i, j] and find(i) != find(j)
        root[find(i)] = find(j)
    assert all(find(int(i)) == find(int(j)) for i, j in zip(*np.nonzero(linked), strict=True))


def test_components_of_a_long_chain(spark):
    from tidewright.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (5, 5)], "u long, v long")
    out = {r["u"]: r["component"] for r in components(edges, Scratch(spark, "test"), "chain").collect()}
    assert out == {i: 0 for i in range(1, 41)} | {101: 100}
