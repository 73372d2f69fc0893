"""The pipeline's stages, each on what the stage before kept, against brute force."""

import os

import pytest
from test_dedup import cut_words, groups

import corpus_pipeline
from tidewright.llm import bpe, source_mixing
from tidewright.llm.core import Scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_stages(spark):
    scratch, docs, seen = Scratch(spark, "test-pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF), name)
        seen.append(docs)
    raw = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good, single, cut, mixed, encoded = seen
    assert all(d.columns == columns for d in (good, single, cut, mixed))
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert len(kept) > 0.8 * len(raw) and all(raw[i] == t for i, t in kept.items())

    ids = sorted(kept)
    stay = {ids[i] for i, (_, _, keep) in groups([kept[i] for i in ids], 5).items() if keep}
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert set(left) == stay

    ids = sorted(left)
    expected = {ids[i]: x for i, x in cut_words([left[i] for i in ids], 35).items()}
    rest = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(rest) == {i for i, (n, gone, _) in expected.items() if not gone or gone < n}
    assert all(len(rest[i].split()) == expected[i][0] - expected[i][1] for i in rest)

    taken = {r["doc_id"]: r["taken"] for r in source_mixing.mixture(cut).collect()}
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {d: n for d, n in taken.items() if n}

    import public_tokenizers

    own = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted((r["doc_id"], own.decode(r["ids"])) for r in encoded.collect()) == sorted((r["doc_id"], r["text"]) for r in mixed.collect())
