import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing as K

PATH = P.path("byte_bpe_50k.json")
ALPHABET = ["  ", "   ", "a", "b", "the", " ", "\n", "\t", "é", "漢", "😀", "\x00", "ing", "'s", "'ll", "1", "²", "½", " ", "　", "\r", "_", "\x0b", "\x1f", "\x85", "​", "<|endoftext|>", "٣", "--", "ß"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer, spark, data):
    rng = random.Random(2)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    got = K.WordIds(PATH, P.PATTERN)(texts)
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_fill_is_best(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 65, rng.integers(1, 9)), minlength=65)
    largest = int(np.flatnonzero(counts)[-1])
    got = K.fill(counts, largest, 64)
    assert all(counts[n] >= k for n, k in got.items()) and got[largest] >= 1
    sums = {largest}
    rest = [n for n in range(65) for _ in range(counts[n] - (n == largest))]
    for n in rest:
        sums |= {s + n for s in sums if s + n <= 64}
    assert K.padding(sum(n * k for n, k in got.items()), 64) == min(K.padding(s, 64) for s in sums)


def check(pieces, docs, tokenizer, most=0.02):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert by_doc.keys() == docs.keys()
    for k, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            assert p.start == at and 1 <= p.length <= 1024 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    pad = total = 0
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        pad += K.padding(at, 1024)
        total += at
    assert pad <= most * total


def test_whole_table(spark, data, tokenizer):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    docs = {r.doc_id: r.text for r in frame.collect()}
    check(K.pack_documents(frame, PATH, P.PATTERN).collect(), docs, tokenizer)
    check(K.pack_documents(frame, PATH, P.PATTERN, shard_docs=50).collect(), docs, tokenizer, 0.05)


def test_odd_rows(spark, tokenizer):
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 30_000, 5), (4, "x", 5), (None, "y", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = K.pack_documents(frame, PATH, P.PATTERN, with_ids=True).collect()
    check(got, {r[0]: r[1] for r in rows}, tokenizer, 1)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert K.pack_documents(frame.limit(0), PATH, P.PATTERN).count() == 0
    large = [(None, "n"), (2**60 + 1, "a"), (2**60 + 3, "b"), (-(2**63), "c")]
    got = K.pack_documents(spark.createDataFrame(large, "doc_id long, text string").coalesce(1), PATH, P.PATTERN).collect()
    check(got, dict(large), tokenizer, 1)
    twice = K.pack_documents(spark.createDataFrame([(7, "again")] * 3, "doc_id long, text string"), PATH, P.PATTERN).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3
