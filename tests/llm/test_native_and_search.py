"""Exact dedup, chat formatting, kNN join and WARC on small fixtures."""

import hashlib
import io
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from siltstone.llm import chat, common, digest_index, knn, warc
from siltstone.llm.common import shared_dir


def test_exact_duplicates(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "a", "x"), (4, None, "x"), (5, "", "x"), (6, "A", "x"), (7, "long " * 50_000, "x"), (8, "a ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(3)
    got = {r.doc_id: r for r in digest_index.exact_duplicates(df).collect()}
    keep = {1: 3, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7, 8: 8}
    for k, text, _ in rows:
        r = got[k]
        assert (r.keep_id, r.kept, r.text_sha256) == (keep[k], keep[k] == k, hashlib.sha256((text or "").encode()).hexdigest())
        assert r.group_size == sum((t or "") == (text or "") for _, t, _ in rows)
    assert digest_index.exact_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in digest_index.keep_distinct(df).collect()) == sorted(set(keep.values()))


def test_batches_agree(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, rng.choice("abcdefgh") * rng.randint(0, 2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(tuple, digest_index.exact_duplicates(df, batches=b).collect()), key=str) for b in (1, 2, 5)]
    assert got[0] == got[1] == got[2]
    kept = digest_index.keep_distinct(df).collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = digest_index.exact_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_index_persists_and_grows(spark):
    path = shared_dir(spark)
    index = digest_index.DigestIndex(spark, path, buckets=4)
    index.add(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    again = digest_index.DigestIndex(spark, path, buckets=4)
    batch = spark.createDataFrame([(9, "a"), (10, "c"), (None, "d")], "doc_id long, text string")
    again.add(batch)
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.describe(batch).collect()}
    assert got == {9: (1, False), 10: (10, True), None: (None, True)}
    assert {(r.keep_id, r.group_size) for r in again.read().collect()} == {(1, 2), (2, 1), (10, 1), (None, 1)}
    again.add(spark.createDataFrame([(20, "a"), (21, "a"), (22, "d")], "doc_id long, text string"))
    assert {(r.keep_id, r.group_size) for r in again.read().collect()} == {(1, 4), (2, 1), (10, 1), (None, 2)}
    assert "Exchange" not in again.read()._jdf.queryExecution().executedPlan().toString()
    plan = again._table().hint("merge").join(again._table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def brute_chat(rows):
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "user", r[3] or "")):
        convs.setdefault(c, []).append((role or "user", text or ""))
    out = {}
    for c, turns in convs.items():
        longer = any(len(t) > len(turns) and t[: len(turns)] == turns for t in convs.values())
        same = [k for k, t in convs.items() if t == turns]
        if not longer and c == min(same):
            out[c] = (len(turns), len(same), "".join(f"<|{r}|>\n{t}\n" for r, t in turns) + "<|end|>")
    return out


def test_chat(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        base = rng.randrange(12)
        n = rng.randint(1, 5)
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"say {base} {i}") for i in range(n)]
    rows += [(100, 0, None, None), (101, 0, "user", ""), (102, 0, "user", "a\n1\nb"), (103, 0, "user\n1", "a"), (104, 1, "user", "x"), (104, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, conv string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_conversations(df).collect()}
    assert got == brute_chat(rows)
    assert chat.format_conversations(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, 0, "user", "hi"), (None, 5, None, "hi"), (None, 0, "user", "ho"), (None, 0, "user", "say"), (3, 0, "user", "ho"), (4, 0, "user", "say"), (4, 1, "user", "more")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.n_turns, r.n_copies) for r in chat.format_conversations(alone).collect()}
    assert got == {(None, 1, 2), (3, 1, 2), (4, 2, 1)}


def test_long_conversation(spark):
    n = 3000
    df = spark.range(2 * n).select((F.col("id") / n).cast("long").alias("conv_id"), (F.col("id") % n).alias("turn"), F.lit("user").alias("role"), (F.col("id") % n).cast("string").alias("text")).where(f"conv_id = 0 or turn < {n // 2}")
    got = chat.format_conversations(df).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in got] == [(0, n, 1)]


def brute_knn(rows, k=20):
    v = [(i, np.floor(64 * np.array(x, float)).astype(int)) for i, x in rows if i is not None and x and None not in x and np.isfinite(np.array(x, float)).all()]
    dim = max(len(x) for _, x in v)
    v = [(i, np.pad(x, (0, dim - len(x)))) for i, x in v]
    out = {}
    for q, x in v:
        if q % 20 == 0:
            out[q] = sorted(((-int(x @ y), i) for i, y in v if i != q))[:k]
    return out


@pytest.mark.parametrize("per_pivot, chunk, block", [(20, 16, 2), (4096, 8192, 2048)])
def test_knn(spark, monkeypatch, per_pivot, chunk, block):
    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", per_pivot)
    monkeypatch.setattr(knn, "DATA_CHUNK", chunk)
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.1, 8)).tolist()) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 400)] + [(1000, None), (1001, []), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, [float("inf")] * 8), (1005, [2.0] * 3), (None, [1.0] * 8), (1020, [5.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in knn.top_k(df, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
    want = brute_knn(rows)
    assert {q: [x[k] for k in sorted(x)] for q, x in got.items()} == want
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in got.values())


def test_knn_repeated_query_ids(spark, monkeypatch):
    """A query's own rows, however many, do not displace its neighbours."""
    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", 4)
    monkeypatch.setattr(knn, "DATA_CHUNK", 8)
    own = [(20, [9.0, 0.0])] * 30 + [(40, [-9.0, 0.0])] * 2
    others = [(100 * i + 1, [i / 8, 1.0]) for i in range(1, 26)]
    got = knn.top_k(spark.createDataFrame(own + others, "vec_id long, embedding array<float>").repartition(3), "vec_id % 20 = 0").collect()
    asked = dict(own)
    for q, x in asked.items():
        score = lambda v: sum(int(64 * a) * int(64 * b) for a, b in zip(x, v, strict=True))  # noqa: E731, B023
        want = sorted(((-score(v), i) for i, v in own + others if i != q))[:20]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_knn_copies_only_what_bounds_admit():
    """With vectors in clusters a query goes to few cells."""
    rng = np.random.default_rng(5)
    pivots = (rng.normal(size=(50, 16)) * 1000).astype(np.int64)
    q = pivots[:20] + rng.integers(-5, 6, (20, 16))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(20)), "v": [x.astype("<i8").tobytes() for x in q], "least": pa.array([int(x @ p) for x, p in zip(q, pivots, strict=False)], pa.int64())})
    got = list(knn._admitted(pivots, np.full(50, 20.0), np.full(50, 2))(iter([batch])))
    assert 40 <= sum(map(len, got)) < 0.1 * 20 * 50 * 2


def test_knn_odd_tables(spark):
    df = spark.createDataFrame([(20, [1.0]), (21, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn.top_k(df, "vec_id % 20 = 0").collect()] == [(20, 1, 21, 64 * 128)]
    assert knn.top_k(df.limit(0), "vec_id % 20 = 0").count() == 0
    large = spark.createDataFrame([(20, [3e6, 1.0]), (21, [2e6, 1.0])], "vec_id long, embedding array<double>")
    assert knn.top_k(large, "vec_id % 20 = 0").first().score == 192_000_000 * 128_000_000 + 4096


def test_warc_filters_that_err(spark, monkeypatch):
    """Filters of one word take nearly every digest for repeated; the result stays."""
    monkeypatch.setattr(common, "FILTER_BITS", 32)
    rows = [(i, f"http://x/{i}", f"{'p' * 120}{i // 3 if i % 2 else i}") for i in range(120)]
    got = {r.page_id: r for r in warc.classify(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    assert len(got) == 120 and all((got[i].refers_to, got[i].payload) == ((None, html) if first[html] == i else (first[html], None)) for i, _, html in rows)


def test_warc(spark):
    big, rng = "<p>" + "é" * 100, random.Random(3)
    rows = [(5, "http://a/x?y=1", big), (3, "http://b", big), (9, None, big), (1, "http://c", "small"), (2, "http://d", "small"), (4, "http://e\r\nEvil: 1", None), (6, "", ""), (None, "http://n", big)]
    rows += [(100 + i, f"http://p/{i}", "".join(rng.choices("abc <>", k=300))) for i in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    folder = shared_dir(spark)
    warc.write_archives(df, folder, archive_bytes=20_000)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert len(got) == len(rows)
    for k, _, html in rows:
        raw = (html or "").encode()
        again = html == big and k != 3
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type, got[k].refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None)
        assert got[k].payload == ("" if again else html or "")
    files = spark.read.format("binaryFile").load(folder).collect()
    assert len(files) > 3
    for f in files:
        data = bytes(f.content)
        magic, n = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"WARC-Record-ID") == len(list(warc.records_of(data)))
    empty = shared_dir(spark)
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.records_of(b"x" * 20))
