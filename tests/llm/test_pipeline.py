"""The pipeline's stages one by one against brute force, each on its own input."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
from test_jaccard import brute as brute_components
from test_suffix_array import brute as brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from siltstone.llm import toxicity
from siltstone.llm.common import materialise


def test_stages(spark, data):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    kept = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        kept.append(materialise(stage(spark, kept[-1], data)))
        assert kept[-1].columns == columns, name
    got = [{r.doc_id: r for r in k.collect()} for k in kept]

    assert got[1].keys() == before.keys() - bad
    last = {}
    for k, r in got[1].items():
        last[r.text] = max(k, last.get(r.text, -1))
    assert got[2].keys() == set(last.values())
    assert got[3].keys() == {c for _, c in brute_components([(k, r.text) for k, r in got[2].items()]).values()}
    assert got[4].keys() == got[3].keys()
    cut = brute_repeats([(k, r.text.encode()) for k, r in got[3].items()], 200)
    for k, r in got[4].items():
        assert r.n_chars == len(r.text)
        if r.text.isascii() and got[3][k].text.isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == cut[k][0][3]

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = {}
    for r in pipeline.STAGES[-1][1](spark, kept[-1], data).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == got[4].keys()
    for k, r in got[4].items():
        ids, at = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(pieces[k], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_run(spark, data):
    assert pipeline.run(spark, data).count() > 0


def test_odd_documents(spark, data):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a word " * 100, None, None, None), (4, "a word " * 100, "en", "s", 700), (None, "no id here at all", "en", "s", 17)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{data}/documents.parquet").schema)
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, data))
    assert {r.doc_id for r in docs.collect()} == {2, 4, None}
    assert pipeline.STAGES[-1][1](spark, docs, data).count() == 3
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0


def test_clashing_columns_and_repeated_rows(spark, data):
    """Columns named like an operator's own come through; repeated rows do not multiply."""
    rows = [(1, "one two three four five six", "en", "s", 27, 7, "a"), (2, "other words that stay as they are", "en", "s", 33, 8, "b"), (2, "other words that stay as they are", "en", "s", 33, 8, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid int, text_sha256 string")
    for name, stage in pipeline.STAGES[:4]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns
        times = 1 if name == "exact_dedup" else 2  # equal rows are equal texts
        assert sorted((r.doc_id, r.uid, r.text_sha256) for r in got.collect()) == [(1, 7, "a")] + [(2, 8, "b")] * times, name
