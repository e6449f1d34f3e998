import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import suffix_array as S


def brute(docs, w):
    count = Counter(b[i : i + w] for _, b in docs for i in range(len(b) - w + 1))
    out = {}
    for k, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if count[b[i : i + w]] > 1:
                gone[i : i + w] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.setdefault(k, []).append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def rows(frame):
    out = {}
    for r in frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect():
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("v", [8, 16, 32, 64])
def test_difference_cover(v):
    d = S.difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("seed", range(6))
def test_block_order(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + 1 + seed % 3, 700, np.uint8)
    text = np.concatenate([base, base[100:600], rng.integers(97, 99, 50, np.uint8), base])
    depth = 40
    at = np.arange(len(text) - depth + 1)
    block, raw = S.Block(text, depth), text.tobytes()
    order = block.sort(at)
    assert sorted(order.tolist()) == at.tolist()
    cut = [raw[i : i + depth] for i in order]
    assert cut == sorted(cut)
    many = Counter(cut)
    assert block.repeated(at).tolist() == [many[raw[i : i + depth]] > 1 for i in at]


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    common, line = say(60), say(30)
    docs = [say(rng.randint(0, 300)) for _ in range(40)]
    docs += [common + say(20) for _ in range(12)] + [say(10) + line + say(9) + line for _ in range(30)]
    docs += [docs[3]] * 5 + ["", None, "the " * 200, "ab" * 400, "x" * 199, "x" * 200, "x" * 201]
    near = docs[5].split()
    for i in range(15):
        n = list(near)
        if n:
            n[rng.randrange(len(n))] = f"edit{i}"
        docs.append(" ".join(n))
    return docs


@pytest.mark.parametrize("limit", [512, 3])
def test_against_brute_force(spark, limit):
    docs = list(enumerate(corpus(limit)))
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, uid string").repartition(5)
    got = rows(S.remove_repeats(frame, bucket_limit=limit, block_bytes=1 << 14))
    assert got == brute([(i, (t or "").encode()) for i, t in docs], 200)


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefgh ", k=2_500_000))
    docs = [(1, text), (2, text[1_048_000:1_049_500]), (3, "z" * 10)]
    got = rows(S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {k: v[0][1:3] for k, v in got.items()} == {1: (1500, 1), 2: (1500, 1), 3: (0, 0)}


def test_null_ids_repeats_and_empty(spark):
    t = "abcdefghij" * 19 + "klmnopqrstuvwxyz"
    frame = spark.createDataFrame([(None, t), (7, t), (7, t), (8, None)], "doc_id long, text string")
    got = rows(S.remove_repeats(frame))
    assert got[7] == [(206, 206, 1, hashlib.sha256(b"").hexdigest())] * 2 and got[None][0][1] == 206 and got[8][0][:3] == (0, 0, 0)
    assert S.remove_repeats(frame.limit(0)).count() == 0


def test_rows_without_or_with_one_id(spark):
    """Several rows of a null or repeated doc_id, of different, equal and near texts, are cut each by its own repeats."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    part, long_ = text(250), text(5000)
    near = long_[:4000] + "!" + long_[4001:]
    for k in (None, 4):
        docs = [(k, long_ + part), (k, part + text(60)), (k, text(300)), (k, near), (k, text(300) + part), (9, part), *[(k, "same " * 60)] * 2]
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert rows(S.remove_repeats(frame)) == brute([(i, t.encode()) for i, t in docs], 200)


def test_whole_table(spark, data):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    docs = [(r.doc_id, (r.text or "").encode()) for r in frame.collect()]
    assert rows(S.remove_repeats(frame)) == brute(docs, 200)
