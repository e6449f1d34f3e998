"""Toxicity scores from class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give each word of a text its probability, in three
levels, each of which discounts what it has seen and hands the rest to the one below:

* pairs: a word after the one before it, in documents of the class;
* words: how many documents of the class hold the word;
* characters: the word's letters and its end, each after the ORDER - 1 before it. The
  highest order counts documents of the class; what is rare or new there is smoothed by
  backoff counts that both classes share: Kneser-Ney continuation counts, order by
  order, over the words of *all* documents. They grow with the corpus and stay in
  Spark; tasks get their values only for the grams of labelled documents.

An expression is a word, or a pair that several toxic documents repeat. Its evidence is
its log-likelihood ratio, toxic over ordinary, divided by its length. A document's
features are its three strongest expressions, the mean, and the mean of its strongest
share. A logistic curve, fitted on labelled documents that were scored by models of the
other half, turns them into a probability.

Labels teach by a bounded sample: at most ``sample_rows`` rows (those with the smallest
hashed ids) and SAMPLE_BYTES of text, which bounds every table that is sent to tasks.
Everything else covers all documents. Texts are read whole, however long: their grams
are counted batch by batch, and a run of letters too long for a word counts by its
strongest window. Null or wordless text has no expressions and gets the score of one
without evidence. Null labels or ids teach nothing; a document labelled twice counts
twice; repeated rows are scored each. Extra columns are ignored, by :func:`keep_clean`
carried through. Without labels of both classes every score is the share of toxic
labels (0 without any). No documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialise, mix64, release, text_or_empty

ORDER = 6
#: Bits of a character in a packed gram: all of Unicode. 0 stands before a word, 1 behind it.
BITS = 21
DISCOUNT = 0.75
#: Toxic documents that must hold a pair of words for it to be an expression.
PAIR_DOCS = 2
#: Strongest expressions: one of so many words.
SHARE = 40
#: Runs of letters beyond LONG are no words; WINDOW characters of them are held against the models at once.
LONG, WINDOW = 48, 10
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 64 << 20
CACHE_WORDS = 300_000
#: Grams that a task remembers so as not to send them twice.
RECENT_GRAMS = 500_000
_WORDS = re.compile(r"[^\W\d_]+").findall
_MASK = (1 << BITS) - 1
FEATURES = 6


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ORDER-grams that end at each character of each word and behind it, in two longs of three characters; where each word begins."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(n) - n
    codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[codes == 0] = 1
    at = np.arange(len(codes)) - np.repeat(begin, n)
    two = [np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)]
    for k in range(ORDER):
        before = np.zeros(len(codes), np.int64)
        if k < len(codes):
            before[k:] = codes[: len(codes) - k]
        two[k < 3] |= np.where(at >= k, before, 0) << (BITS * (k % 3))
    return two[0], two[1], begin


def _key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix64(hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(lo.astype(np.uint64)))


def context(hi, lo):
    """A gram without its last character, for arrays and columns alike."""
    if isinstance(hi, np.ndarray):
        return hi >> BITS, (lo >> BITS) | ((hi & _MASK) << (2 * BITS))
    return F.shiftright(hi, BITS), F.shiftright(lo, BITS).bitwiseOR(F.shiftleft(hi.bitwiseAND(F.lit(_MASK)), 2 * BITS))


def _tail(order: int):
    """The last ``order`` characters of a gram, as columns hi and lo."""
    hi = F.col("hi").bitwiseAND(F.lit((1 << BITS * (order - 3)) - 1)) if order > 3 else F.lit(0).cast("long")
    lo = F.col("lo") if order >= 3 else F.col("lo").bitwiseAND(F.lit((1 << BITS * order) - 1))
    return hi.alias("hi"), lo.alias("lo")


class Table:
    """Rows of numbers by gram, in an open-addressing table of slots."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, values: np.ndarray):
        self.hi, self.lo, self.values = hi, lo, values

    def index(self) -> None:
        """Fill the slots; they are not sent to tasks."""
        size = 1 << max(4, (4 * len(self.hi)).bit_length())
        self.mask, self.slot = np.uint64(size - 1), np.full(size, -1, np.int32)
        key, left, step = _key(self.hi, self.lo), np.arange(len(self.hi), dtype=np.int32), 0
        while len(left):
            at = (key[left] + np.uint64(step)) & self.mask
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            left, step = left[self.slot[at] != left], step + 1

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The row of each gram, or -1."""
        out, key = np.full(len(hi), -1), _key(hi, lo)
        left, step = np.arange(len(hi)), 0
        while len(left):
            row = self.slot[(key[left] + np.uint64(step)) & self.mask]
            left, row = left[row >= 0], row[row >= 0]
            hit = (self.hi[row] == hi[left]) & (self.lo[row] == lo[left])
            out[left[hit]] = row[hit]
            left, step = left[~hit], step + 1
        return out


def discounted(n):
    """What is left of a count: nothing of one, which chance explains."""
    return np.where(n > 1, n - DISCOUNT, 0.0)


class Model:
    """One of the three models (of either half of the sample, or of both): the number ``which`` picks its columns."""

    def __init__(self, parts: dict, which: int):
        self.grams, self.contexts, self.which = parts["grams"], parts["contexts"], which
        self.grams.index()
        self.contexts.index()
        self.total, self.rest = parts["total"][which], parts["rest"][which]
        self.counts = {w: c for w, c in zip(parts["words"], parts["word_counts"][which].tolist(), strict=True) if max(c) > 1}
        self.pair_ids: dict[str, int] = {}
        pairs = {}
        for w, e in zip(parts["pairs"], parts["pair_excess"][which].tolist(), strict=True):
            a, b = (self.pair_ids.setdefault(x, len(self.pair_ids)) for x in w.split(" "))
            pairs[a << 32 | b] = e
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_excess = np.array([pairs[k] for k in self.pair_keys.tolist()])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ratio, self.length, self.pair_id = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Log-likelihood ratios of new words."""
        hi, lo, begin = grams(words)
        row = self.grams.find(hi, lo)
        seen = row >= 0
        step, base = np.zeros(len(hi)), np.zeros(len(hi))
        step[seen], base[seen] = self.grams.values[row[seen], self.which], self.grams.values[row[seen], 3]
        if not seen.all():
            at = self.contexts.find(*context(hi[~seen], lo[~seen]))
            step[~seen] = np.where(at >= 0, self.contexts.values[at, self.which] if len(self.contexts.values) else 0.0, 0.0)
        ratio, shared = np.add.reduceat(step, begin), np.add.reduceat(base, begin)
        length = np.diff(np.append(begin, len(hi))).astype(float)
        for i in np.flatnonzero(length > LONG).tolist():
            total = np.concatenate([[0], np.cumsum(step[begin[i] : begin[i] + int(length[i])])])
            ratio[i], length[i] = (total[WINDOW:] - total[:-WINDOW]).max(), WINDOW
        counts = [(i, c) for i, w in enumerate(words) if (c := self.counts.get(w))]
        if counts:
            i, c = np.array([x[0] for x in counts]), np.array([x[1] for x in counts], float)
            p = discounted(c) / self.total + self.rest * np.exp(np.stack([shared[i], shared[i] + ratio[i]], 1))
            ratio[i] = np.log(p[:, 1] / p[:, 0]) - np.log(self.rest[1] / self.rest[0])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ratio, self.length = np.concatenate([self.ratio, ratio]), np.concatenate([self.length, length])
        self.pair_id = np.concatenate([self.pair_id, np.fromiter((self.pair_ids.get(w, -1) for w in words), np.int64, len(words))])

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text the three strongest expressions, the mean, the mean of the strongest share, and whether there are any."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        split = [words_of(t) for t in texts]
        new = list({w for s in split for w in s} - self.known.keys())
        if new:
            self._learn(new)
        evidence, get = self.ratio / np.maximum(self.length, 1), self.known.__getitem__
        out = np.zeros((len(texts), FEATURES))
        for row, s in zip(out, split, strict=True):
            if not s:
                continue
            at = np.fromiter(map(get, s), np.int64, len(s))
            e = evidence[at]
            if len(self.pair_keys) and len(s) > 1:
                e[1:] = np.maximum(e[1:], self._pairs(at, e[1:]))
            k = max(1, len(e) // SHARE)
            most = max(3, k)
            top = np.sort(np.partition(e, len(e) - most)[-most:] if len(e) > most else e)[::-1]
            row[:] = [*top[:3], *[min(0.0, top[-1])] * (3 - len(top[:3])), e.mean(), top[:k].mean(), 1]
        return out

    def _pairs(self, at: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        ids = self.pair_id[at]
        key = ids[:-1] << 32 | ids[1:]
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (ids[:-1] >= 0) & (ids[1:] >= 0) & (self.pair_keys[found] == key)
        whole = (self.ratio[at[:-1]] + self.ratio[at[1:]] + self.pair_excess[found]) / (self.length[at[:-1]] + self.length[at[1:]])
        return np.where(hit, whole, otherwise)


def _corpus_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of all words, each once as far as the task remembers."""
    recent = np.zeros(0, np.uint64)
    for batch in batches:
        for i in range(0, len(batch), 1024):
            words = {w for t in batch.column("text").slice(i, 1024).to_pylist() for w in words_of(t)}
            if not words:
                continue
            hi, lo, _ = grams(list(words))
            key, first = np.unique(_key(hi, lo), return_index=True)
            if len(recent):
                new = recent[np.minimum(np.searchsorted(recent, key), len(recent) - 1)] != key
                key, first = key[new], first[new]
            yield pa.RecordBatch.from_arrays([pa.array(hi[first]), pa.array(lo[first])], ["hi", "lo"])
            recent = np.sort(np.concatenate([recent, key])) if len(recent) + len(key) <= RECENT_GRAMS else key


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each labelled document, once each: its grams, its words and its pairs of words. ``cell`` is 2 * toxic + half."""
    for batch in batches:
        for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
            words = words_of(text)
            if not words:
                continue
            hi, lo, _ = grams(list(set(words)))
            _, first = np.unique(_key(hi, lo), return_index=True)
            once = [*set(words), *{f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True) if max(len(a), len(b)) <= LONG}]
            n, m = len(first), len(once)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(hi[first]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(lo[first]), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(once, pa.string())]), pa.array(np.full(n + m, 2 * toxic + half, np.int32)),
            ], ["hi", "lo", "said", "cell"])


CELLS = ("n0", "n1", "n2", "n3")
#: Of the three models: the columns that count ordinary and toxic documents.
PARTS = ((("n0",), ("n2",)), (("n1",), ("n3",)), (("n0", "n1"), ("n2", "n3")))


def _sum(columns: tuple[str, ...]):
    return sum(map(F.col, columns[1:]), F.col(columns[0]))


def shared_backoff(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(hi, lo) with ``lower``: the probability by orders 1 to ORDER - 1 over all grams of ``corpus``."""
    level, counts = corpus, {}
    for order in range(ORDER - 1, 0, -1):
        # continuation counts: how many longer grams, of those that occur at all, end in this one
        counts[order] = materialise(level.groupBy(*_tail(order)).agg(F.count(F.lit(1)).alias("n")))
        level = counts[order].select("hi", "lo")
    lower = None
    for order in range(1, ORDER):
        now = counts[order].withColumns(dict(zip(("chi", "clo"), context(F.col("hi"), F.col("lo")), strict=True)))
        contexts = now.groupBy("chi", "clo").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        now = now.join(wanted.select(*_tail(order)).distinct(), ["hi", "lo"]).join(contexts, ["chi", "clo"])
        if lower is None:
            now = now.withColumn("below", 1 / F.lit(max(1, counts[1].count())))
        else:
            now = now.withColumns({"thi": _tail(order - 1)[0], "tlo": _tail(order - 1)[1]}).join(lower.select(F.col("hi").alias("thi"), F.col("lo").alias("tlo"), F.col("lower").alias("below")), ["thi", "tlo"])
        value = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")
        lower = materialise(now.select("hi", "lo", value.alias("lower")))
    whole = wanted.withColumns({"thi": _tail(ORDER - 1)[0], "tlo": _tail(ORDER - 1)[1]})
    return whole.join(lower.select(F.col("hi").alias("thi"), F.col("lo").alias("tlo"), "lower"), ["thi", "tlo"]).drop("thi", "tlo")


def _smooth(count, total, kinds, below):
    return F.when(total > 0, (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * below) / total).otherwise(below)


def gram_tables(counted: DataFrame, corpus: DataFrame) -> tuple[Table, Table]:
    """Log ratios of the labelled documents' grams and contexts for the three models, and the log of the shared backoff."""
    with_context = counted.withColumns(dict(zip(("chi", "clo"), context(F.col("hi"), F.col("lo")), strict=True)))
    sums = {f"{k}_{m}_{c}": f for m, part in enumerate(PARTS) for c in (0, 1) for k, f in (("t", F.sum(_sum(part[c]))), ("k", F.count(F.when(_sum(part[c]) > 0, 1))))}
    contexts = materialise(with_context.groupBy("chi", "clo").agg(*(f.alias(k) for k, f in sums.items())))
    rows = with_context.join(shared_backoff(corpus, counted), ["hi", "lo", *CELLS]).join(contexts, ["chi", "clo"])
    below = F.greatest("lower", F.lit(1e-12))
    smooth = lambda m, c: _smooth(_sum(PARTS[m][c]), F.col(f"t_{m}_{c}"), F.col(f"k_{m}_{c}"), below)
    found = rows.select("hi", "lo", *(F.log(smooth(m, 1) / smooth(m, 0)).cast("float").alias(f"r{m}") for m in range(3)), F.log(below).cast("float").alias("below")).toArrow()
    part = lambda m, c: F.when(F.col(f"t_{m}_{c}") > 0, DISCOUNT * F.col(f"k_{m}_{c}") / F.col(f"t_{m}_{c}")).otherwise(1.0)
    left = contexts.select(F.col("chi").alias("hi"), F.col("clo").alias("lo"), *(F.log(part(m, 1) / part(m, 0)).cast("float").alias(f"r{m}") for m in range(3))).toArrow()
    numbers = lambda t, names: np.stack([t[c].to_numpy() for c in names], 1) if len(t) else np.zeros((0, len(names)), np.float32)
    longs = lambda t: (t["hi"].to_numpy(), t["lo"].to_numpy())
    return Table(*longs(found), numbers(found, ["r0", "r1", "r2", "below"])), Table(*longs(left), numbers(left, ["r0", "r1", "r2"]))


def said_tables(said: DataFrame) -> dict:
    """Words with their counts, and the pairs that are expressions with what they add to their two words."""
    pair = F.instr("said", " ") > 0
    words = said.where(~pair)
    names = [(m, c) for m in range(3) for c in (0, 1)]
    n = {(m, c): _sum(PARTS[m][c]) for m, c in names}
    gone = {k: F.when(x == 1, F.lit(1.0)).when(x > 1, F.lit(DISCOUNT)).otherwise(0.0) for k, x in n.items()}
    sums = words.agg(*(F.coalesce(F.sum(n[k]), F.lit(0)).alias(f"t{k[0]}{k[1]}") for k in names), *(F.coalesce(F.sum(gone[k]), F.lit(0.0)).alias(f"g{k[0]}{k[1]}") for k in names)).first()
    total = np.array([[max(1, sums[f"t{m}{c}"]) for c in (0, 1)] for m in range(3)], float)
    rest = np.array([[sums[f"g{m}{c}"] / total[m, c] or 1.0 for c in (0, 1)] for m in range(3)])
    often = words.where(F.greatest(n[2, 0], n[2, 1]) > 1).select("said", *CELLS).toArrow()
    cells = {c: often[c].to_numpy() for c in CELLS}
    counts = np.stack([np.stack([sum(cells[x] for x in PARTS[m][c]) for c in (0, 1)], 1) for m in range(3)])

    # of a pair u v in a class: (discounted count + rest of u * P(v)) / count of u, over P(v)
    first = F.split("said", " ")
    pairs = said.where(pair).withColumns({"u": first[0], "v": first[1]})
    heads = pairs.groupBy("u").agg(*(F.sum(n[k]).alias(f"t{k[0]}{k[1]}") for k in names), *(F.sum(gone[k]).alias(f"g{k[0]}{k[1]}") for k in names))
    chosen = pairs.where(n[2, 1] >= PAIR_DOCS).join(heads, "u")
    tail = words.select(F.col("said").alias("v"), *(n[k].alias(f"w{k[0]}{k[1]}") for k in names))
    chosen = chosen.join(tail, "v")

    def lift(m: int, c: int):
        count, total_u, gone_u = n[m, c], F.col(f"t{m}{c}"), F.col(f"g{m}{c}")
        word = F.greatest(F.when(F.col(f"w{m}{c}") > 1, F.col(f"w{m}{c}") - DISCOUNT).otherwise(0.5), F.lit(0.5)) / F.lit(float(total[m, c]))
        kept = F.when(count > 1, count - DISCOUNT).otherwise(0.0)
        return F.when(total_u > 0, F.log((kept / word + gone_u) / total_u)).otherwise(0.0)

    got = chosen.select("said", *(F.coalesce(lift(m, 1) - lift(m, 0), F.lit(0.0)).alias(f"e{m}") for m in range(3))).toArrow()
    excess = np.stack([got[f"e{m}"].to_numpy() for m in range(3)])
    return {"words": often["said"].to_pylist(), "word_counts": counts, "total": total, "rest": rest, "pairs": got["said"].to_pylist(), "pair_excess": excess}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last the constant) by Newton's method, on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = sigmoid(z @ w)
        slope = z.T @ (p - y) / len(y) + ridge * w
        bend = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(id, label, half) of at most ``rows`` rows that labels may be learnt from, small enough to broadcast."""
    able = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("id"), (F.col(column) > 0).cast("int").alias(column))
    return able.orderBy(F.xxhash64("id"), "id", column).limit(rows).withColumn("half", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).cast("int"))


def taught(documents: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int) -> DataFrame:
    """(id, text, toxic, half) of the sample, written; the texts make up at most ``sample_bytes`` (one text at least)."""
    sample = materialise(labelled_sample(labels, "toxic", sample_rows))
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    rows = materialise(docs.join(F.broadcast(sample), "id").select("id", "text", "toxic", "half"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sample_bytes:
        # hashed ids below a share that fits; the few rows are summed on the driver, as many as the sample has
        sizes = rows.select(F.xxhash64("id").alias("h"), F.octet_length("text").alias("n")).toArrow().to_pandas().sort_values("h")
        fits = max(1, int((sizes["n"].cumsum() <= sample_bytes).sum()))
        rows = rows.where(F.xxhash64("id") <= F.lit(int(sizes["h"].iloc[fits - 1])))
    return rows


def _features(model, which: int):
    def run(batches):
        m = Model(model.value, which)
        for batch in batches:
            for i in range(0, len(batch), 512):
                f = m.features(batch.column("text").slice(i, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, 512), pa.array(list(f), pa.list_(pa.float64()))], ["toxic", "f"])

    return run


def _score(model, weights: np.ndarray, names: list[str]):
    def run(batches):
        m = Model(model.value, 2)
        for batch in batches:
            f = np.vstack([m.features(batch.column("text").slice(i, 512).to_pylist()) for i in range(0, len(batch), 512)] or [np.zeros((0, FEATURES))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sigmoid(f @ weights[:-1] + weights[-1]))], [*names, "score"])

    return run


def _scored(documents: DataFrame, labels: DataFrame, docs: DataFrame, sample_rows: int) -> DataFrame:
    """``docs``, columns of ``documents`` and ``text``, with ``score`` instead of ``text``."""
    spark = documents.sparkSession
    rows = taught(documents, labels, sample_rows, SAMPLE_BYTES)
    names = [c for c in docs.columns if c != "text"]
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return docs.select(*names, F.lit(float(bool(seen.get(1)))).alias("score"))
    corpus = materialise(documents.select(text_or_empty().alias("text")).mapInArrow(_corpus_grams, "hi long, lo long").distinct())
    cells = [F.count(F.when(F.col("cell") == k, 1)).alias(c) for k, c in enumerate(CELLS)]
    counted = materialise(rows.mapInArrow(_class_counts, "hi long, lo long, said string, cell int").groupBy("hi", "lo", "said").agg(*cells))
    by_gram, by_context = gram_tables(counted.where("said is null").drop("said"), corpus)
    model = spark.sparkContext.broadcast({"grams": by_gram, "contexts": by_context, **said_tables(counted.where("said is not null").drop("hi", "lo"))})
    release(corpus, counted)
    del by_gram, by_context
    give_back()
    x, y = [], []
    for half in (0, 1):  # each half by the model of the other
        got = rows.where(F.col("half") == half).mapInArrow(_features(model, 1 - half), "toxic int, f array<double>").toArrow()
        x += got["f"].to_pylist()
        y += got["toxic"].to_pylist()
    x, y = np.array(x).reshape(-1, FEATURES), np.array(y, float)
    order = np.lexsort((*x.T, y))  # the same weights whatever order the rows came in
    weights = fit_logistic(x[order], y[order])
    return docs.mapInArrow(_score(model, weights, names), T.StructType([*docs.drop("text").schema, T.StructField("score", T.DoubleType())]))


def score_toxicity(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = _scored(documents, labels, docs, sample_rows)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; each row by its own text."""
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), text_or_empty().alias("text"))
    return _scored(documents, labels, docs, sample_rows).where("score < 0.5").select("row.*")
