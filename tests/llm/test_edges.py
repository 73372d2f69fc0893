"""Every operator and stage on null, empty, very long and repeated texts, ties, empty tables, and columns whose names clash."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import types as T
from test_dedup import cut_bytes, cut_words, groups

import corpus_pipeline
from tidewright.llm import bpe, compression_quality, exchange, fingerprints, media, minhash_dedup, source_mixing, substring_dedup, suffix_dedup, warc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
_RNG = random.Random(11)
PASSAGE = " ".join(f"p{_RNG.randrange(500)}" for _ in range(60))
#: 10 MB of words with a passage that others share, and a word of 3 MB.
LONG = " ".join(f"w{_RNG.randrange(10**7)}" for _ in range(1_180_000)) + " " + PASSAGE
TEXTS = [None, "", " \t\n", LONG, "é" * 1_500_000, f"a b c {PASSAGE}", f"{PASSAGE} x y", "same text of seven words in all", "same text of seven words in all", None, "tie", "tie"]
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "__gone", "id", "block", "row", "rest", "a.b", "key", "u", "component", "__size", "answer"]
SCHEMA = T.StructType([T.StructField(n, T.StringType() if n in ("text", "lang", "source") else T.LongType()) for n in NAMES])


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s" if i % 2 else None, len(t or ""), *range(11)) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def test_dedup_operators(spark):
    df = docs(spark)
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df, words=4).collect()}
    assert near == groups(TEXTS, 4)
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeated_words_removed(df).collect()}
    assert cut == cut_words(TEXTS, 35)
    short = [t if t is None or len(t) < 10**6 else t[-4000:] for t in TEXTS]
    gone = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_bytes_removed(docs(spark, short)).collect()), key=repr)
    assert gone == cut_bytes(short, range(len(short)), 50)
    whole = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes_removed(df).collect()}
    assert whole[3] == 0 and whole[4] == 0 and whole[7] == whole[8] == 0 and whole[6] >= len(PASSAGE)


def test_row_operators(spark):
    df = docs(spark)
    raw = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    for r in bpe.digests(df, RANKS, PATTERN).select("doc_id", "n_tokens", "decoded_sha256").collect():
        assert r["decoded_sha256"] == hashlib.sha256(raw[r["doc_id"]]).hexdigest() and (r["n_tokens"] > 0) == bool(raw[r["doc_id"]])
    for r in media.round_trip(df).collect():
        payload = raw[r["doc_id"]] + b" " * (-len(raw[r["doc_id"]]) % 192 if raw[r["doc_id"]] else 192)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    prints = {r["doc_id"]: r for r in fingerprints.edited_and_next(df).collect()}
    assert {i: r["n_chars"] for i, r in prints.items()} == {i: len(t or "") for i, t in enumerate(TEXTS)} and prints[7]["fingerprint"] == prints[8]["fingerprint"]
    out = {r["doc_id"]: r for r in source_mixing.mixture(df).collect()}
    assert {i: r["size"] for i, r in out.items()} == {i: n for i, (n, _, _) in cut_words(TEXTS, 35).items()} and all(0 <= r["taken"] <= 2 * r["size"] for r in out.values())
    pages = df.selectExpr("doc_id AS page_id", "text AS html", "concat('http://a.org/', source) AS url", "id AS digest", "block AS first", "row AS at", "`a.b`")
    found = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert {i: r["payload_digest"] for i, r in found.items()} == {i: hashlib.sha256(x).hexdigest() for i, x in raw.items()} and {r["record_type"] for r in found.values()} == {"response"}


def test_labels_that_contradict(spark):
    """An id with both labels counts as bad; labels of no document, and null ones, as nothing."""
    rows = [(i, ("good words here " if i % 2 else "BAD!! stuff ") * 30) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    plain, odd = (spark.createDataFrame(x, "doc_id long, quality int") for x in (labels, [*labels, *[(i, 1) for i in range(0, 60, 2)], (None, 1), (999, 1), (5, None), (7, 3), *labels]))
    a, b = ({r["doc_id"]: r["predicted"] for r in compression_quality.scores(df, x).collect()} for x in (plain, odd))
    assert a == b == {i: i % 2 for i in range(60)}


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    """Each stage keeps the columns, null, empty and long texts, and repeated rows as its docstring says."""
    texts = [*TEXTS, *[f"good words number {i} of a plain document about nothing much " * 4 for i in range(6)]]
    df = docs(spark, [] if empty else texts)
    spark.createDataFrame([] if empty else [(i, int(i not in (0, 2))) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        rows = out.count() if name == "encoding" else len(out.select("doc_id", "`a.b`").collect())
        assert (rows == 0) if empty else (name == "quality" or rows > 0)
        if name != "encoding":
            assert out.columns == NAMES
    if not empty:
        single = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).select("doc_id").collect()}
        assert single == {i for i, (_, _, keep) in groups(texts, 5).items() if keep}


def test_buckets_in_parts(monkeypatch):
    """What occurs again doesn't depend on how many hashes are sent or looked at together."""
    rng = random.Random(3)
    rows = [(b, exchange.np.array([rng.randrange(1 << 64) if rng.random() < 0.5 else rng.randrange(40) << 58 for _ in range(50)], exchange.np.uint64)) for b in range(6) for _ in range(3)]

    def answers():
        out = {}
        for batch in exchange._repeated(None)(iter(list(exchange.send(iter(rows), 1)))):
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.setdefault(block, set()).update(exchange.np.frombuffer(packed, exchange.np.uint64).tolist())
        return out

    whole = answers()
    monkeypatch.setattr(exchange, "STEP", 16)
    monkeypatch.setattr(exchange, "SEND", 60)
    times = {}
    for _, hashes in rows:
        for h in hashes.tolist():
            times[h] = times.get(h, 0) + 1
    assert answers() == whole == {b: {h for c, hashes in rows if c == b for h in hashes.tolist() if times[h] > 1} for b in range(6)}
