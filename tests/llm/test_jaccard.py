import random
import re

import numpy as np
import pytest

from siltstone.llm import jaccard as J
from siltstone.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def rows(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdEé", k=rng.randint(1, 5))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    common = say(40)
    docs = [say(rng.randint(0, 120)) for _ in range(60)]
    docs += [common + " " + say(rng.randint(0, 8)) for _ in range(40)]
    for base in (say(100), say(30), say(300)):
        docs += [edited(rng, base, rng.randint(0, 4)) for _ in range(25)]
    docs += [docs[3]] * 4 + ["", None, " \t\n", "One two", "one\x0btwo", "one two three", "a b c d e", "A B C D E f", "the " * 50, "the " * 7]
    got = rows(J.near_duplicates(spark.createDataFrame([(i, t, "v", 1) for i, t in enumerate(docs)], "doc_id long, text string, v string, n int").repartition(4)))
    assert got == brute(list(enumerate(docs)))


def test_sets_match_tuples():
    docs = ["A b c d e f", "", "one two", "x " * 9, "é ÀB\tc\x0bd\x0ce\rf g h"]
    raw = [d.encode() for d in docs]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    got = J.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), at)
    assert [len(s) for s in got] == [len(shingles(d)) for d in docs]


def test_level_grows_with_frequency():
    assert J.choose_level(np.ones(50), 11, 1, 8) == 1
    assert J.choose_level(np.full(50, 9.0), 11, 40, 8) > 1


def test_nulls_repeats_and_empty(spark):
    t = "one two three four five six"
    frame = spark.createDataFrame([(None, t), (5, t), (5, t), (9, t + " seven"), (3, None)], "doc_id long, text string")
    got = J.near_duplicates(frame).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted([(None, 2, None), (5, 2, None), (5, 2, None), (9, 3, 9), (3, 0, 3)], key=str)
    assert J.near_duplicates(frame.limit(0)).count() == 0
    kept = J.keep_one(spark.createDataFrame([(1, t), (2, t), (3, "x")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_rows_without_id(spark):
    """Null ids do not link different texts; of equal or near ones, one row stays."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d = say(100), say(100), say(100), say(100)
    texts = [(None, a), (None, edited(rng, a, 1)), (None, b), (None, b), (None, c), (7, c), (8, d), (9, edited(rng, d, 1)), (None, None), (None, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted([(r.doc_id, r.n_shingles > 0, r.component_id) for r in J.near_duplicates(frame).collect()], key=str)
    assert got == sorted([(None, True, None)] * 5 + [(7, True, None), (8, True, 8), (9, True, 8)] + [(None, False, None)] * 2, key=str)
    kept = [(r.doc_id, r.text) for r in J.keep_one(frame).collect()]
    assert sum(t in (texts[0][1], texts[1][1]) for _, t in kept) == 1
    assert sorted(((i, t) for i, t in kept if t not in (texts[0][1], texts[1][1])), key=str) == sorted([(None, b), (None, c), (8, d), (None, None), (None, "")], key=str)


def test_rows_of_one_id(spark):
    """As in the SQL, an id is one document, whatever texts its rows have; of near rows one stays."""
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = say(100), say(100), say(100)
    near = edited(rng, c, 1)
    texts = [(1, a), (2, edited(rng, a, 1)), (2, b), (3, edited(rng, b, 1)), (5, c), (5, near), (6, None), (6, say(20))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.near_duplicates(frame).collect()) == [(1, 1), (2, 1), (2, 1), (3, 1), (5, 5), (5, 5), (6, 6), (6, 6)]
    assert sorted(r.doc_id for r in J.keep_one(frame).collect()) == [1, 2, 5, 6, 6]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_whole_table(spark, data):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    assert rows(J.near_duplicates(frame)) == brute([(r.doc_id, r.text) for r in frame.collect()])


def test_large_group_and_common_line(spark):
    """Thousands of near copies, linked and not, and a line that many documents share, against all intersections."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    base, line = say(150), say(30)
    docs = [edited(rng, base, min(14, int(rng.expovariate(0.25)))) for _ in range(1800)]
    docs += [line + " " + say(rng.randint(1, 60)) for _ in range(600)] + [line, base]
    rng.shuffle(docs)
    sets = [shingles(t) for t in docs]
    seen = {}
    for s in sets:
        for g in s:
            seen[g] = seen.get(g, 0) + 1
    column = {g: i for i, g in enumerate(g for g, n in seen.items() if n > 1)}
    m = np.zeros((len(docs), len(column)), np.float32)
    for i, s in enumerate(sets):
        m[i, [column[g] for g in s if g in column]] = 1
    both, n = m @ m.T, np.array([len(s) for s in sets])
    links = np.argwhere(100 * both >= 80 * (n[:, None] + n[None] - both))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links.tolist():
        p, q = sorted((find(a), find(b)))
        root[q] = p
    want = {i: (int(n[i]), find(i)) for i in range(len(docs))}
    assert 500 < max(list(map(find, range(len(docs)))).count(c) for c in set(map(find, range(len(docs))))) < 2000
    assert rows(J.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4))) == want


def test_shared_passages_make_few_candidates(spark, monkeypatch):
    """Passages that 16 documents share, which a full sketch cannot tell from other words, are not joined in pairs."""
    rng = random.Random(31)
    say = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passages = [say(60) for _ in range(60)]
    docs = [" ".join(say(k := rng.randint(20, 180)) + passages[i % 60] + say(200 - k)) for i in range(960)]
    docs += [edited(rng, docs[7], 2), edited(rng, docs[90], 2)]
    made = []
    enough = J._enough
    monkeypatch.setattr(J, "SKETCH", 1 << 8)
    monkeypatch.setattr(J, "_enough", lambda met: (made.append(met.groupBy("token").count().where("count >= 16").agg({"count": "sum"}).first()[0] or 0), enough(met))[1])
    got = rows(J.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)))
    assert {i: c for i, (_, c) in got.items() if i != c} == {960: 7, 961: 90}
    assert sum(made) < 1000


def test_often_is_bounded(spark, monkeypatch):
    frame = spark.createDataFrame([(t << 20,) for t in range(40) for _ in range(4 + t)], "token long")
    ranks = J._often(frame)
    assert np.flatnonzero(ranks).tolist() == list(range(4, 40))
    assert ranks[4] == J._rank(np.array([8]))[0] < ranks[39]
    monkeypatch.setattr(J, "OFTEN_MOST", 30)
    assert np.flatnonzero(J._often(frame)).tolist() == list(range(12, 40))
