"""Near-duplicate join: word-shingle sets with Jaccard similarity at or above a threshold.

Method: adaptive multi-match prefixes. Shingles have one global order, rare first. A
count sketch of fixed size tells only the most frequent ones, as the many shingles of a
single document fill its counters; so prefixes are chosen ORDER_ROUNDS times before,
and shingles that they hold often (counted exactly) come later from then on. Sets of x and y
shingles link if they share a(x, y) = t (x + y) / (1 + t) of them; then, for any l, they
share at least l among the first ``x - a + l`` of the one and ``y - a + l`` of the other.
A longer prefix costs more postings but admits fewer candidates, so each document picks
the l that minimises ``postings * (1 + VERIFY_COST / l)``, where postings is the sum of
its prefix's estimated frequencies; a pair is checked with the smaller l of its two
documents, and has to share that many.

Only connectivity is wanted, so pairs inside what is already known to be connected need
no proof of their own, and no group is paired with itself:

1. documents with the same set form a class; only its smallest row goes on;
2. in LEADER_ROUNDS rounds each class is verified against one leader, that of a posting
   list and a range of sizes with which it shares most. A leader has the fewest rarer
   shingles in its list, so it is the plainest of its group;
3. lists that still hold several components are joined, which loses no link: a document
   looks for smaller or equal partners, in those ranges of sizes that the position of
   the shared shingle leaves possible, and documents of a list's main component meet
   only those outside it;
4. components of all links.

Candidates are verified by their whole texts, in groups of one document with up to
GROUP others, so that a leader's text is sent once a group and not once a pair. What a
round has written is deleted when it has been used.

Null or blank text makes an empty set, linked with nothing; very long texts are read in
slices. Rows are told apart by a number that is written with them; doc_id only names the
result. A null doc_id counts as the smallest; rows without id are documents of their own.
Rows that repeat a doc_id are one document whatever their texts, so their groups are one.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, PrefixHash, filter_of, fresh, give_back, materialise, may_hold, mix64, numbered, real_id, release, safe_id, slices, string_bytes, text_or_empty
from .components import connected_components

WORDS = 5
PERCENT = 80
#: Counters of the frequency sketch (a fixed size, whatever the corpus).
SKETCH = 1 << 18
#: Rounds in which the shingles that prefixes hold often are looked for, before the prefixes that are used.
ORDER_ROUNDS = 2
#: Slots for the shingles that prefixes hold often, and how many of these are told at most.
OFTEN_SLOTS = 1 << 22
OFTEN_MOST = 1 << 20
#: The least number of postings that is often; it doubles until OFTEN_MOST suffices.
OFTEN = 8
#: What verifying one candidate costs, in postings.
VERIFY_COST = 8
#: Rounds in which documents are held against one leader per posting list, before all that is still apart is.
LEADER_ROUNDS = 2
#: Sizes whose ratio is below this share a range.
STEP = 1.08
#: Documents that one group verifies against one other.
GROUP = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes."""
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = at[:-1][np.diff(at) > 0]
    first[starts] = solid[starts]
    begin = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = at[1:][np.diff(at) > 0] - 1
    last[ends] = solid[ends]
    end = np.flatnonzero(last) + 1
    word = mix64(PrefixHash(_LOWER[data]).of(begin, end) + (end - begin).astype(np.uint64))
    bounds = np.searchsorted(begin, at)
    odd = np.uint64(0x9FB21C651E98DF25)

    def join(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            h = h * odd + p
        return mix64(h)

    n = max(0, len(word) - words + 1)
    all_ = join([word[k : k + n] for k in range(words)]) if n else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(all_[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(join([word[k : k + 1] for k in range(a, b)]) if b > a else np.zeros(0, np.uint64))
    return out


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the rows, with the sets of their texts."""
    for batch in batches:
        data, at = string_bytes(batch.column("text"))
        for i, j in slices(at, 1 << 20):
            yield batch.slice(i, j - i), shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], words)


def _signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _classes(words: int):
    """A row for each document (uid, doc, n, signature), and at the end of the task its part of the sketch."""

    def run(batches):
        sketch = np.zeros(SKETCH, np.int64)
        for rows, sets in _sets(batches, words):
            sig = np.frombuffer(b"".join(map(_signature, sets)), "<i8").reshape(-1, 2)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            sketch += np.bincount(np.concatenate(sets).astype(np.int64) & (SKETCH - 1), minlength=SKETCH)
            yield pa.RecordBatch.from_arrays([rows.column("uid"), rows.column("doc"), pa.array(n), pa.array(sig[:, 0].copy()), pa.array(sig[:, 1].copy()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())], ["uid", "doc", "n", "v", "v2", "counter", "seen"])
        at = np.flatnonzero(sketch)
        for i in range(0, len(at), 65536):
            k = at[i : i + 65536]
            none = pa.nulls(len(k), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(k.astype(np.int32)), pa.array(sketch[k])], ["uid", "doc", "n", "v", "v2", "counter", "seen"])

    return run


def required(n, percent: int):
    """The least overlap of a set of n with any set it links to."""
    return -(-n * percent // 100)


def choose_level(frequency: np.ndarray, base: int, most: int, cost: float) -> int:
    """The l in 1..most that minimises the estimated work of a prefix of base + l - 1 shingles."""
    levels = np.unique(np.minimum(2 ** np.arange(0, 13, 0.5), most).astype(np.int64))
    work = np.cumsum(frequency)[np.minimum(base + levels - 2, len(frequency) - 1)]
    return int(levels[np.argmin(work * (1 + cost / levels))])


def _rank(count: np.ndarray) -> np.ndarray:
    """Counts of one and more as eighths of octaves, from 1; less is 0."""
    return np.where(count >= 1, 1 + 8 * np.log2(np.maximum(count, 1)), 0).astype(np.uint8)


def _sketch_ranks(sketch: np.ndarray) -> np.ndarray:
    """For each counter the rank of a shingle that stands out of what others have added to it; 0 for most."""
    usual, high = np.percentile(sketch, [50, 84])
    over = sketch - usual
    return np.where(over > 4 * max(1, high - usual), _rank(over), 0).astype(np.uint8)


def _slot(token: np.ndarray) -> np.ndarray:
    """The slot of a shingle's hash, by other bits than its counter's."""
    return (token.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (OFTEN_SLOTS - 1)


def _often(postings: DataFrame) -> np.ndarray:
    """For each slot the rank of its most frequent shingle, of those that ``postings`` hold often; else 0."""
    counts = materialise(postings.groupBy("token").count().where(F.col("count") >= OFTEN))
    least = OFTEN
    sizes = {r.octave: r["count"] for r in counts.groupBy(F.floor(F.log2("count")).alias("octave")).count().collect()}
    while sum(k for octave, k in sizes.items() if 2**octave >= least) > OFTEN_MOST:
        least *= 2
    slot = F.shiftrightunsigned("token", 20).bitwiseAND(F.lit(OFTEN_SLOTS - 1)).cast("int")
    told = counts.where(F.col("count") >= least).groupBy(slot.alias("slot")).agg(F.max("count").alias("count")).toArrow()
    ranks = np.zeros(OFTEN_SLOTS, np.uint8)
    ranks[told["slot"].to_numpy()] = _rank(told["count"].to_numpy())
    release(counts)
    return ranks


def _prefixes(words: int, percent: int, sketch: np.ndarray, often: np.ndarray, only: bool = False):
    """Postings of all prefixes, by the ranks of slots and counters first, then by the counters; ``only`` the shingles."""
    ranks = _sketch_ranks(sketch)

    def run(batches):
        for _, sets in _sets(batches, words):
            token, v, n_, pos, level_ = [], [], [], [], []
            for s in sets:
                n = len(s)
                if not n:
                    continue
                counter = s.astype(np.int64) & (SKETCH - 1)
                rank = np.maximum(ranks[counter], often[_slot(s)])
                order = np.lexsort((s, sketch[counter], rank))
                seen = np.exp2(np.maximum(rank, 1) / 8 - 0.125)
                need = required(n, percent)
                # the level is chosen for partners of the same size; smaller ones need a longer prefix
                level = choose_level(seen[order], n - -(-2 * n * percent // (100 + percent)) + 1, need, VERIFY_COST)
                k = n - need + level
                token.append(s[order[:k]])
                if only:
                    continue
                v.append(np.full(k, np.frombuffer(_signature(s)[:8], "<i8")[0]))
                n_.append(np.full(k, n, np.int32))
                pos.append(np.arange(k, dtype=np.int32))
                level_.append(np.full(k, level, np.int32))
            if token and only:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64))], ["token"])
            elif token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (v, n_, pos, level_))], ["token", "v", "n", "pos", "level"])

    return run


def _overlap(n, m, percent: int):
    """The least overlap of linked sets of n and m."""
    return F.ceil((n + m) * percent / F.lit(100 + percent))


def _range(n, shift: float = 0.0):
    """The range of sizes that n belongs to."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(STEP)) + F.lit(shift)).cast("int")


def _marked(shared: DataFrame, known: DataFrame | None) -> DataFrame:
    """Postings with the component that their document is known to belong to."""
    if known is None:
        return shared.withColumn("component", F.col("v"))
    return shared.join(known.withColumnRenamed("id", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))


def _met(percent: int):
    """Whether a shared shingle of v and w lies in both prefixes, by their smaller level."""
    both, level = _overlap(F.col("n"), F.col("m"), percent), F.least("level", "level_w")
    sizes = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return sizes & (F.col("pos") < F.col("n") - both + level) & (F.col("pos_w") < F.col("m") - both + level)


def _enough(met: DataFrame) -> DataFrame:
    """Shared shingles (v, w, level, level_w) -> pairs that share enough, with how many."""
    return met.groupBy("v", "w").agg(F.count(F.lit(1)).alias("hits"), F.min(F.least("level", "level_w")).alias("least")).where("hits >= least")


def _leaders(marked: DataFrame, seed: int, percent: int) -> DataFrame:
    """pairs(a, b): each document b with the leader a that it shares most with, of those it is not connected with."""
    at = marked.withColumn("range", _range(F.col("n"), seed / LEADER_ROUNDS))
    # the plainest first; later rounds take others of equal rank
    order = F.struct("pos", F.xxhash64("v", F.lit(seed)))
    leaders = at.groupBy("token", "range").agg(F.min_by(F.struct("v", "n", "pos", "level", "component"), order).alias("lead"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    leaders = materialise(leaders.select("token", "range", *(F.col(f"lead.{c}").alias(d) for c, d in (("v", "w"), ("n", "m"), ("pos", "pos_w"), ("level", "level_w"), ("component", "other")))))
    met = at.join(leaders, ["token", "range"]).where((F.col("component") != F.col("other")) & _met(percent))
    best = _enough(met).groupBy("v").agg(F.max_by("w", F.struct("hits", "w")).alias("w"))
    pairs = materialise(best.select(F.col("w").alias("a"), F.col("v").alias("b")))
    release(leaders)
    return pairs


def _once(pairs: DataFrame, *used: DataFrame) -> DataFrame:
    """pairs(v, w), written as (a, b) without turned ones: the more frequent of two is a."""
    often = pairs.select("v", "w")
    often = often.union(often.select("w", "v")).groupBy("v").count()
    often = materialise(often)
    named = pairs.join(often.withColumnRenamed("count", "cv"), "v").join(often.select(F.col("v").alias("w"), F.col("count").alias("cw")), "w")
    first = F.struct(F.col("cv"), F.col("v")) > F.struct(F.col("cw"), F.col("w"))
    out = materialise(named.select(F.when(first, F.col("v")).otherwise(F.col("w")).alias("a"), F.when(first, F.col("w")).otherwise(F.col("v")).alias("b")).distinct())
    release(often, *used)
    return out


def _across(marked: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) of all that may link two components."""
    split = materialise(marked.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token"))
    open_ = materialise(marked.join(split, "token"))
    n, level = F.col("n"), F.col("level")
    # a partner w is no larger than v, so w's prefix is that of a partner of its own size at least
    small = open_.where(F.col("pos") < n - _overlap(n, n, percent) + level).withColumn("range", _range(n))
    main = small.groupBy("token", "range", "component").count()
    main = materialise(main.groupBy("token", "range").agg(F.max_by("component", F.struct("count", "component")).alias("main")))
    small = small.join(main, ["token", "range"]).withColumn("in_main", F.col("component") == F.col("main"))
    small = small.select("token", "range", "in_main", F.col("v").alias("w"), n.alias("m"), F.col("pos").alias("pos_w"), level.alias("level_w"), F.col("component").alias("other"))
    # the largest partner that the position leaves possible: overlap(n, m) <= n - pos - 1 + level
    most = F.floor((n - F.col("pos") - 1 + level) * F.lit((100 + percent) / percent) + F.lit(1e-9)) - n
    lo, hi = F.greatest(F.lit(1), F.ceil(n * percent / F.lit(100))), F.least(n, most)
    large = open_.where(lo <= hi).withColumn("range", F.explode(F.sequence(_range(lo), _range(hi)))).join(main, ["token", "range"])
    # those of the main component meet only others
    sides = F.when(F.col("component") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    large = large.withColumn("in_main", F.explode(sides)).drop("main")
    met = large.join(small, ["token", "range", "in_main"]).where((F.struct("m", "w") < F.struct("n", "v")) & (F.col("component") != F.col("other")) & _met(percent))
    pairs = materialise(_enough(met).select("v", "w"))
    return _once(pairs, pairs, split, open_, main)


def _similar(words: int, percent: int):
    """Rows come sorted by (a, part): the text of a first (b is null), then those of its partners."""

    def run(batches):
        now = hub = None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            i = 0
            for rows, sets in _sets([batch], words):
                for key, b, s in zip(zip(rows.column("a").to_pylist(), rows.column("part").to_pylist(), strict=True), rows.column("b").to_pylist(), sets, strict=True):
                    if b is None:
                        now, hub = key, s
                    else:
                        if key != now:
                            raise ValueError("a group without its first text")
                        both = len(np.intersect1d(hub, s, assume_unique=True))
                        keep[i] = 100 * both >= percent * (len(hub) + len(s) - both)
                    i += 1
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _verify(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """pairs(a, b), each once -> those whose sets are similar, by their whole texts."""
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).alias("parts"))
    size = materialise(size)
    spokes = pairs.join(size, "a").select(F.col("b").alias("uid"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    hubs = size.select(F.col("a").alias("uid"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    wanted = materialise(spokes.union(hubs))
    held = filter_of(wanted, "uid")  # texts that nobody wants are not shuffled
    texts = may_hold(docs, held, "uid", name="wanted").where("wanted").drop("wanted").join(wanted, "uid").select("a", "part", "b", "text")
    sorted_ = texts.repartition("a", "part").sortWithinPartitions("a", "part", "b")
    out = materialise(sorted_.mapInArrow(_similar(words, percent), "a long, b long"))
    release(size, wanted, held)
    return out


def _groups(docs: DataFrame, words: int, percent: int, by_doc: bool) -> DataFrame:
    """docs(uid, doc, text), each uid once -> uid, doc, n, node and ``best``, the row of its group with the least (doc, uid).

    Rows of one node have the same set. ``by_doc`` also links rows that share a doc, but for NULL_ID.
    """
    first = materialise(docs.mapInArrow(_classes(words), "uid long, doc long, n long, v long, v2 long, counter int, seen long"))
    sketch = np.zeros(SKETCH, np.int64)
    counters = first.where("counter is not null").groupBy("counter").agg(F.sum("seen").alias("seen")).toArrow().to_pandas()
    sketch[counters["counter"]] = counters["seen"]
    del counters
    give_back()

    members = first.where("counter is null").select("uid", "doc", "n", "v", "v2")
    classes = members.where("n > 0").groupBy("v", "v2").agg(F.min("uid").alias("rep"))
    frequent = np.zeros(OFTEN_SLOTS, np.uint8)
    for _ in range(ORDER_ROUNDS):
        found = _often(docs.mapInArrow(_prefixes(words, percent, sketch, frequent, only=True), "token long"))
        frequent = np.maximum(frequent, found)
    postings = docs.mapInArrow(_prefixes(words, percent, sketch, frequent), "token long, v long, n int, pos int, level int")
    # aggregates are written before they are joined, so that both sides are dealt anew and AQE can split a frequent token
    often = materialise(postings.groupBy("token").count().where("count > 1").select("token"))
    # copies of a text give the same postings: they are one class, and its shingles count once
    met = postings.join(often, "token").groupBy("token", "v").agg(*(F.first(c).alias(c) for c in ("n", "pos", "level")))
    met = materialise(met.join(classes.select("v", "rep"), "v").drop("v").withColumnRenamed("rep", "v"))
    lists = materialise(met.groupBy("token").count().where("count > 1").select("token"))
    shared = materialise(met.join(lists, "token"))
    release(often, met, lists)

    links, known = docs.sparkSession.createDataFrame([], "a long, b long"), None
    for find in [*(partial(_leaders, seed=k) for k in range(LEADER_ROUNDS)), _across]:
        pairs = find(_marked(shared, known), percent=percent)
        if not pairs.isEmpty():
            links = links.union(_verify(docs, pairs, words, percent))
            known = connected_components(links)
        release(pairs)
    release(shared)
    rows = materialise(members.join(classes, ["v", "v2"], "left").select("uid", "doc", "n", F.coalesce("rep", "uid").alias("node")))
    if by_doc:
        named = rows.where(F.col("doc") != NULL_ID)
        spread = materialise(named.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc", "a"))
        links = links.union(named.join(spread, "doc").select("a", F.col("node").alias("b")))
        known = connected_components(links)
    marked = materialise((rows.withColumn("component", F.col("node")) if known is None else rows.join(known.withColumnRenamed("id", "node"), "node", "left")).withColumn("component", F.coalesce("component", "node")))
    release(first, rows)
    best = materialise(marked.groupBy("component").agg(F.min(F.struct("doc", "uid", "node")).alias("best")))
    return marked.join(best, "component").select("uid", "doc", "n", "node", "best")


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = numbered(documents.select(safe_id().alias("doc"), text_or_empty().alias("text")), "uid")
    rows = _groups(docs, words, percent, True)
    return rows.select(real_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real_id("best.doc").alias("component_id"))


def keep_one(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Rows that repeat its doc_id and set are the same document and stay too, but for a null doc_id.
    """
    uid = fresh(documents, "uid")
    whole = numbered(documents, uid)
    docs = whole.select(F.col(uid).alias("uid"), safe_id().alias("doc"), text_or_empty().alias("text"))
    same = (F.col("doc") != NULL_ID) & (F.col("doc") == F.col("best.doc")) & (F.col("node") == F.col("best.node"))
    one = _groups(docs, words, percent, False).where((F.col("uid") == F.col("best.uid")) | same)
    return whole.join(one.select(F.col("uid").alias(uid)), uid, "left_semi").select(*documents.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, len(g) AS n, g FROM s),
e AS MATERIALIZED (SELECT doc_id, n, unnest(g) AS g FROM n),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * shared >= 80 * (na + nb - shared)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.root FROM r JOIN u ON r.doc_id = u.a WHERE r.root < u.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id
FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
