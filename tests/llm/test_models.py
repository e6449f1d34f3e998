"""Toxicity and quality: held-out accuracy, and the models against plain counting."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import quality, toxicity

DATA = "/root/testdata/sf0.1"


def outcome(spark, score, column):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    both = got.merge(labels.toPandas(), on="doc_id")
    return both[both["held_out"]]


def test_toxicity_held_out(spark):
    x = outcome(spark, toxicity.score_toxicity, "toxic")
    hit = x["predicted"] == 1
    assert (x["toxic"][hit] == 1).mean() > 0.9 and hit[x["toxic"] == 1].mean() >= 0.85
    rank = x["score"].rank()
    n1 = (x["toxic"] == 1).sum()
    auc = (rank[x["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(x) - n1))
    assert auc > 0.9


def test_quality_held_out(spark):
    x = outcome(spark, quality.score_quality, "quality")
    assert ((x["predicted"] == x["quality"]).mean()) > 0.95
    assert np.mean((x["score"] - x["quality"]) ** 2) < 0.05


def pack(s):
    codes = [0 if c == "^" else 1 if c == "$" else ord(c) for c in s]
    two = [sum(c << toxicity.BITS * k for k, c in enumerate(reversed(part))) for part in (codes[:3], codes[3:])]
    return tuple(two)


def test_grams():
    hi, lo, begin = toxicity.grams(["ab", "\U0001d5ba"])
    assert list(zip(hi.tolist(), lo.tolist(), strict=True)) == [pack(g) for g in ("^^^^^a", "^^^^ab", "^^^ab$", "^^^^^\U0001d5ba", "^^^^\U0001d5ba$")] and begin.tolist() == [0, 3]
    want = [pack("^" + g[:-1]) for g in ("^^^^^a", "^^^^ab", "^^^ab$")]
    assert [tuple(int(x[i]) for x in toxicity.context(hi, lo)) for i in range(3)] == want


class Plain:
    """The class models by counters of strings."""

    def __init__(self, corpus, taught):
        n = toxicity.ORDER
        self.levels, now = {}, {g for t in corpus for w in toxicity.words_of(t) for g in self.grams(w)}
        for order in range(n - 1, 0, -1):
            self.levels[order] = Counter(g[-order:] for g in now)
            now = set(self.levels[order])
        self.chars = len(self.levels[1])
        self.of = [[(t, toxicity.words_of(t)) for t, y in taught if y == c] for c in (0, 1)]
        self.gram = [Counter(g for _, ws in d for g in {g for w in ws for g in self.grams(w)}) for d in self.of]
        self.word = [Counter(w for _, ws in d for w in set(ws)) for d in self.of]
        self.pair = [Counter(p for _, ws in d for p in set(zip(ws, ws[1:], strict=False))) for d in self.of]

    @staticmethod
    def grams(w):
        p = "^" * (toxicity.ORDER - 1) + w + "$"
        return [p[i : i + toxicity.ORDER] for i in range(len(w) + 1)]

    @staticmethod
    def smooth(counts, gram, lower):
        rows = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        return (max(counts.get(gram, 0) - 0.75, 0) + 0.75 * len(rows) * lower) / sum(rows) if rows else lower

    def shared(self, gram):
        lower = 1 / self.chars
        for order in range(1, toxicity.ORDER):
            lower = self.smooth(self.levels[order], gram[-order:], lower)
        return max(lower, 1e-12)

    def ratio(self, w):
        low = [self.shared(g) if any(c[g] for c in self.gram) else 1e-12 for g in self.grams(w)]
        steps = [[math.log(self.smooth(c, g, x)) for g, x in zip(self.grams(w), low, strict=True)] for c in self.gram]
        r = sum(steps[1]) - sum(steps[0])
        n = [c[w] for c in self.word]
        if max(n) > 1:
            total, keep = [sum(c.values()) for c in self.word], lambda k: k - 0.75 if k > 1 else 0
            rest = [sum(x - keep(x) for x in c.values()) / t for c, t in zip(self.word, total, strict=True)]
            q = sum(map(math.log, low))
            p = [keep(n[c]) / total[c] + rest[c] * math.exp(q + c * r) for c in (0, 1)]
            r = math.log(p[1] / p[0]) - math.log(rest[1] / rest[0])
        return r

    def excess(self, u, v):
        out = []
        for c in (0, 1):
            heads = [n for (a, _), n in self.pair[c].items() if a == u]
            keep = lambda k: k - 0.75 if k > 1 else 0
            word = max(keep(self.word[c][v]), 0.5) / sum(self.word[c].values())
            out.append(math.log((keep(self.pair[c][u, v]) / word + sum(n - keep(n) for n in heads)) / sum(heads)) if heads else 0.0)
        return out[1] - out[0]

    def features(self, text, pairs):
        ws = toxicity.words_of(text)
        if not ws:
            return [0.0] * toxicity.FEATURES
        r = {w: self.ratio(w) for w in set(ws)}
        e = [r[ws[0]] / (len(ws[0]) + 1)]
        for u, v in zip(ws, ws[1:], strict=False):
            e.append(r[v] / (len(v) + 1))
            if (u, v) in pairs:
                e[-1] = max(e[-1], (r[u] + r[v] + self.excess(u, v)) / (len(u) + len(v) + 2))
        top, k = sorted(e, reverse=True), max(1, len(e) // toxicity.SHARE)
        three = top[:3] + [min(0.0, top[min(len(top), max(3, k)) - 1])] * (3 - len(top[:3]))
        return [*three, sum(e) / len(e), sum(top[:k]) / k, 1.0]


def test_toxicity_against_plain_counting(spark):
    """The whole query, over documents with one- and two-word expressions, without hashes or tables."""
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices(["ba", "do", "ki", "lu", "ma", "sé"], k=rng.randint(1, 3))) for _ in range(n))
    texts = [say(rng.randint(0, 40)) for _ in range(120)]
    bad = [rng.random() < 0.4 for _ in texts]
    texts = [f"{t} {rng.choice(['zork', 'zorkish', 'ba quux'])} {say(2)}" if b else t for t, b in zip(texts, bad, strict=True)] + ["", "1 2 !"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad[:100])], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(labels, "toxic", 1000).collect()
    assert {r.id for r in sample} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5}
    part = lambda *halves: Plain(texts, [(texts[r.id], r.toxic) for r in sample if r.half in halves])
    models = [part(0), part(1), part(0, 1)]
    pairs = {p for p, n in models[2].pair[1].items() if n >= toxicity.PAIR_DOCS}
    assert pairs
    x = np.array([models[1 - r.half].features(texts[r.id], pairs) for r in sample])
    y = np.array([r.toxic for r in sample], float)
    w = toxicity.fit_logistic(x, y)
    want = {i: toxicity.sigmoid(np.array(models[2].features(t, pairs)) @ w[:-1] + w[-1]) for i, t in enumerate(texts)}
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-3) for i in want)


def test_long_runs_of_letters(spark):
    """An insult deep in a run without blanks counts, and so does a sample too large for its bound."""
    rng = random.Random(4)
    run = lambda n: "".join(rng.choices(["ba", "do", "ki", "lu"], k=n))
    rows = [(i, run(150) + "zorkzork" * (i % 2) + run(150)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    assert np.mean([got[i] == i % 2 for i in range(300, 400)]) > 0.8
    assert toxicity.taught(docs, labels, 1000, 10_000).count() < 20
    assert {r.doc_id % 2 for r in toxicity.keep_clean(docs.where("doc_id >= 300"), labels.limit(0)).collect()} == {0, 1}


@pytest.mark.parametrize("score, column", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_odd_tables(spark, score, column):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([None, "", "  \n", "ab " * 40_000, "x", "ok words here", "!!! 12"])] + [(None, "no id", 0.1), (3, "again", 0.2)], "doc_id long, text string, score double")
    labels = lambda rows: spark.createDataFrame(rows, f"doc_id long, {column} int")
    for rows in ([], [(1, 1)], [(1, None), (None, 1)], [(i, i % 2) for i in range(9)] + [(3, 0), (3, 1)]):
        got = score(docs, labels(rows)).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert score(docs.limit(0), labels([(1, 1), (2, 0)])).count() == 0


def test_word_vectors_against_a_loop():
    text = "a b a! c b"
    data = np.frombuffer(text.encode(), np.uint8)
    slot, bounds = quality.tokens(data, np.array([0, len(data)]))
    assert bounds.tolist() == [0, 6] and slot[0] == slot[2] and slot[1] == slot[5]
    index, want = quality.index_vectors(), np.zeros((quality.SLOTS, quality.WIDTH))
    for i, s in enumerate(slot):
        for j in range(max(0, i - 2), min(6, i + 3)):
            if j != i:
                want[s] += index[slot[j]]
    import pyarrow as pa

    got = np.zeros_like(want)
    for b in quality._surroundings(iter([pa.RecordBatch.from_pydict({"text": [text]})])):
        got[b.column(0).to_numpy()] += np.stack([c.to_numpy() for c in b.columns[1:]], 1)
    assert np.array_equal(got, want)


def test_quality_against_loops(spark):
    """The whole query: vectors, pooling and scores word by word; the network itself learns from the same rows."""
    rng = random.Random(6)
    good = [" ".join(rng.choices(["the", "ship", "sails", "on", "Water", "12"], k=rng.randint(0, 30))) for _ in range(60)]
    bad = [" ".join(rng.choices(["$$", "buy", "NOW", "!!", "12"], k=rng.randint(1, 30))) for _ in range(60)]
    texts = [*good, *bad, "", " \n", "ship $$ ship"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")

    def slots(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return quality.tokens(data, np.array([0, len(data)]))[0].tolist() if text else []

    index, vectors = quality.index_vectors(), np.zeros((quality.SLOTS, quality.WIDTH))
    for s in map(slots, texts):
        for i, a in enumerate(s):
            for j in range(max(0, i - quality.NEAR), min(len(s), i + quality.NEAR + 1)):
                if i != j:
                    vectors[a] += index[s[j]]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    vectors = vectors.astype(np.float32).astype(float)

    def pooled(text):
        x = [vectors[a] for a in slots(text)]
        if not x:
            return np.zeros(3 * quality.WIDTH + 1)
        beside = [a * b for a, b in zip(x[1:], x, strict=False)]
        return np.concatenate([np.mean(x, 0), np.std(x, 0), np.sum(beside, 0) / max(1, len(x) - 1) if beside else np.zeros(quality.WIDTH), [math.log1p(len(x)) / 10]])

    sample = [(r.id, r.quality) for r in toxicity.labelled_sample(labels, "quality", 1000).collect()]
    x, y = np.array([pooled(texts[i]) for i, _ in sample]), np.array([q for _, q in sample], float)
    order = np.lexsort((*x.T[:8], y))
    network = quality.Network(x[order], y[order])
    want = network.probability(np.array([pooled(t) for t in texts]))
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == len(texts)
    assert all(got[i][0] == pytest.approx(p, abs=0.02) and got[i][1] == (got[i][0] >= 0.3) for i, p in enumerate(want))
