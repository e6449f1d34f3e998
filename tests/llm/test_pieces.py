import hashlib
import random
import time

import public_tokenizers as P
import pytest
import sentencepiece

from siltstone.llm import pieces as C

PATH = P.path("piece_bpe_32k.model")
ALPHABET = ["  ", "   ", "a", "b", "the", " ", "\n", "\t", "é", "ñ", "漢", "😀", "▁", "\x00", "ing", "ß", " " * 17, " " * 40, "AAAA", "...", "--", "<s>", "<0x0A>", "́", "x" * 30, "lll", "ssss"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return C.PieceModel(PATH)


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_encoding_and_decoding(model, library):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 20))) for _ in range(1500)]
    for t, (n, ids, decoded) in zip(texts, model.digests(texts), strict=True):
        want = library.encode(t)
        assert model.encode(t) == want and (n, ids) == (len(want), digest(want))
        assert model.decode(want) == decoded == library.decode(want)


def test_digests_decode_the_ids(monkeypatch):
    """The decoded text is what the decoder makes of a document's ids, not its segments."""
    model, seen = C.PieceModel(PATH), []
    monkeypatch.setattr(model, "decode", lambda ids: seen.append(ids) or "decoded")
    texts = ["the theory  of\x00 漢字", "", "a\nb " * 50]
    assert [d[2] for d in model.digests(texts)] == ["decoded"] * 3
    assert seen == [model.encode(t) for t in texts]


def test_decoding_any_ids(model, library):
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.6 else rng.randrange(0, 259) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_whole_table(spark, data, library):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: tuple(r[1:]) for r in C.round_trip_digests(frame, PATH).collect()}
    for r in frame.collect():
        ids = library.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), digest(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_columns(spark, library):
    frame = spark.createDataFrame([(1, None, 3), (None, "a  b", 4), (2, "x" * 100_000, 5)], "doc_id long, text string, ids int")
    ids = C.encode_column(frame, PATH)
    got = ids.collect()
    assert [r.ids for r in got] == [library.encode(r.text or "") for r in got]
    assert [r.text for r in C.decode_column(ids, PATH).collect()] == [r.text or "" for r in got]
    assert C.encode_column(frame.limit(0), PATH).count() == 0
    assert C.round_trip_digests(frame, PATH).count() == 3


def test_unbroken_text_is_linear(model):
    """Backtracking over a segment without blanks costs time in proportion to its length."""
    rng = random.Random(9)
    text = "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=400_000))
    took = []
    for n in (100_000, 400_000):
        model.backtrack(text[:20_000])
        began = time.process_time()
        parts = model.backtrack(text[:n])
        took.append(time.process_time() - began)
        assert "".join(parts) == text[:n]
    assert took[1] < 8 * took[0]
