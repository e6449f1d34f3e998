"""Removal of repeated passages with a blockwise suffix array.

Every byte covered by a ``window``-byte string that starts at two places of the
corpus goes. The suffixes that can matter are sorted one bucket at a time:

1. *Buckets.* A string of ``window`` bytes belongs to the bucket of its smallest
   hashed k-gram (leftmost of equals), so equal strings share a bucket and
   consecutive starts share a k-gram: a run of starts is one row. Buckets with one
   row hold nothing that repeats; runs with identical context repeat as a whole.
2. *Blocks.* The contexts of the other runs are gathered bucket by bucket into
   blocks of bounded size, and the suffixes of a block are sorted by their first
   v bytes; suffixes that tie for longer are ordered by the ranks of the block's
   difference-cover sample, computed beforehand by doubling: for any two positions
   the cover has a shift below v that brings both into the sample. Neighbours in
   that order that agree on ``window`` bytes repeat.
3. *Hot buckets.* A bucket with more than ``bucket_limit`` different contexts is
   not sorted in one task: each of its strings becomes a key of its own (128-bit
   hash), counted with partial aggregation and joined back, which AQE can split.

Null text counts as empty; texts shorter than ``window`` keep all their bytes. Each row
is a document of its own, under a number that is written with it: ``doc_id``, null or
repeated, is only carried through, and rows that repeat a text repeat each other. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PrefixHash, materialise, mix64, numbered, slices, string_bytes, text_or_empty

WINDOW = 200
#: Starts that share one k-gram at most; a power of two, at most 128.
REACH = 128
#: Bytes of text that one block sorts, about.
BLOCK_BYTES = 1 << 20
#: Different contexts of a bucket that one block may hold.
BUCKET_LIMIT = 8192
PERIOD = 16


@lru_cache
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues whose differences give every residue modulo v: a run of r and every r-th."""
    r = int(np.ceil(np.sqrt(v)))
    return tuple(sorted({*range(r), *range(r - 1, v, r), v - 1}))


@lru_cache
def _shifts(v: int) -> np.ndarray:
    """shift[a, b]: the least s with a + s and b + s both in the cover, modulo v."""
    cover = np.zeros(v, bool)
    cover[list(difference_cover(v))] = True
    out = np.full((v, v), -1, np.int64)
    a, b = np.meshgrid(np.arange(v), np.arange(v), indexing="ij")
    for s in range(v):
        hit = (out < 0) & cover[(a + s) % v] & cover[(b + s) % v]
        out[hit] = s
    if (out < 0).any():
        raise ValueError(f"no difference cover modulo {v}")
    return out


class Block:
    """The suffixes of a byte string; ``depth`` bytes make a repeat."""

    def __init__(self, text: np.ndarray, depth: int = WINDOW, v: int = PERIOD):
        if v % 8:
            raise ValueError("the period must be a multiple of 8")
        self.n, self.depth, self.v = len(text), depth, v
        pad = depth + 3 * v + 16
        raw = np.concatenate([text, np.zeros(pad + (-(len(text) + pad)) % 8, np.uint8)])
        self.words = np.empty(len(raw) - 8, np.uint64)
        for k in range(8):
            self.words[k::8] = np.frombuffer(raw[k : k + 8 * ((len(raw) - 8 - k + 7) // 8)].tobytes(), ">u8")
        self.rank = self._sample_ranks()

    def _by_prefix(self, at: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The order of suffixes by their first v bytes (less if ``end`` is nearer), and where a new prefix begins."""
        keys = [self.words[at + k] for k in range(0, self.v, 8)]
        if end is not None:
            keys.append(np.minimum(end - at, self.v))
        order = np.lexsort(keys[::-1])
        new = np.ones(len(at), bool)
        if len(at) > 1:
            new[1:] = False
            for k in keys:
                k = k[order]
                new[1:] |= k[1:] != k[:-1]
        return order, new

    def _sample_ranks(self) -> np.ndarray:
        v, size = self.v, self.n + 2 * self.v
        cover = np.zeros(v, bool)
        cover[list(difference_cover(v))] = True
        at = np.flatnonzero(np.resize(cover, size))
        rank = np.zeros(size + v + 1, np.int64)
        order, new = self._by_prefix(at, size)
        rank[at[order]] = np.cumsum(new)
        h = v
        while not new.all():  # to the end: ranks that tie at some depth would not compare transitively
            key = rank[at] * (len(at) + 2) + rank[np.minimum(at + h, len(rank) - 1)]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[at[order]] = np.cumsum(new)
            h *= 2
        return rank

    def _less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix i precedes suffix j, both with the same first v bytes."""
        s = _shifts(self.v)[i % self.v, j % self.v]
        a, b = self.rank[i + s], self.rank[j + s]
        return (a < b) | ((a == b) & or_equal)

    def sort(self, at: np.ndarray) -> np.ndarray:
        """The suffixes that start at ``at``, in order."""
        order, new = self._by_prefix(at)
        out = at[order]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(out)))
        group = np.repeat(np.arange(len(first)), size)
        act = np.flatnonzero(size[group] > 1)
        width = 1
        while len(act):  # merge sort of all long ties at once, runs of `width` by binary search
            gs, gn = first[group[act]], size[group[act]]
            local = act - gs
            run = local // width
            sib = gs + (run ^ 1) * width
            lo, hi = np.minimum(sib, gs + gn), np.minimum(sib + width, gs + gn)
            base, right = lo.copy(), (run & 1).astype(bool)
            x = out[act]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                before = self._less(out[mid], x[open_], right[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            place = gs + (run & ~1) * width + (local - run * width) + (lo - base)
            merged = out.copy()
            merged[place] = x
            out = merged
            width *= 2
            act = act[gn > width]
        return out

    def repeated(self, at: np.ndarray) -> np.ndarray:
        """For each start in ``at``: whether another one has the same ``depth`` bytes."""
        order = np.sort(at) if len(at) < 2 else self.sort(at)
        i, j = order[:-1], order[1:]
        same = np.arange(len(i))
        for k in range(0, self.depth, 8):
            if k + 8 <= self.depth:
                same = same[self.words[i[same] + k] == self.words[j[same] + k]]
            else:
                keep = np.uint64(8 * (8 - (self.depth - k)))
                same = same[self.words[i[same] + k] >> keep == self.words[j[same] + k] >> keep]
        hit = np.zeros(self.n + 1, bool)
        hit[i[same]] = hit[j[same]] = True
        return hit[at]


def _runs(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The runs of starts that share a smallest k-gram: document, first start, starts, shift of the k-gram, its hash."""
    k = window - REACH + 1
    low = np.uint64((1 << 24) - 1)
    hashes = mix64(PrefixHash(data).windows(k))
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while step < REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    ok = np.zeros(len(least) + 1, np.int8)
    long_ = np.flatnonzero(np.diff(at) >= window)
    np.add.at(ok, at[long_], 1)
    np.add.at(ok, at[long_ + 1] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(ok[:-1]))
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    gram = (least[start] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, n = start[new], np.diff(np.append(new, len(start)))
    doc = np.searchsorted(at, first, "right") - 1
    return doc, first, n, gram[new] - first, hashes[gram[new]].view(np.int64)


def _pieces(at: np.ndarray, window: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the rows; a text beyond ``most`` bytes comes in pieces that overlap by window - 1: (row, begin, end)."""
    for i, j in slices(at, most):
        if at[j] - at[i] <= most or j - i > 1:
            yield np.arange(i, j), at[i:j], at[i + 1 : j + 1]
        else:
            begin = np.arange(at[i], at[j], most)
            for b in begin:
                yield np.array([i]), np.array([b]), np.array([min(b + most + window - 1, at[j])])


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = string_bytes(batch.column("text"))
            ids = batch.column("uid").to_numpy(zero_copy_only=False)
            for rows, begin, end in _pieces(at, window, 1 << 20):
                part = data[begin[0] : end[-1]]
                bounds = np.append(begin, end[-1]) - begin[0]
                if len(part) < window:
                    continue
                doc, first, n, shift, key = _runs(part, bounds, window)
                raw = part.tobytes()
                digest = xxhash.xxh3_64_intdigest
                ctx = np.fromiter((digest(raw[a : a + c + window - 1], s) for a, c, s in zip(first.tolist(), n.tolist(), shift.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
                inside = first - bounds[doc] + (begin[doc] - at[rows[doc]])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), pa.array(ids[rows[doc]]), pa.array((inside << 14) | ((n - 1) << 7) | shift)], ["key", "ctx", "uid", "span"])

    return run


def _contexts(window: int):
    """Cut the contexts of a document's runs out of its text."""

    def run(batches):
        for batch in batches:
            data, at = string_bytes(batch.column("text"))
            runs = batch.column("runs")
            sizes, inner = np.diff(runs.offsets.to_numpy()), runs.flatten()
            rows = np.repeat(np.arange(len(batch)), sizes)
            span = inner.field("span").to_numpy()
            a, n = span >> 14, ((span >> 7) & 127) + 1
            begin = at[rows] + a
            raw = data.tobytes()
            text = [raw[b : b + c + window - 1] for b, c in zip(begin.tolist(), n.tolist(), strict=True)]
            ids = batch.column("uid").to_numpy()[rows]
            for i in range(0, len(text), 8192):
                j = slice(i, i + 8192)
                yield pa.RecordBatch.from_arrays([inner.field("key")[j], pa.array(ids[j]), pa.array(span[j]), inner.field("lone")[j], inner.field("hot")[j], pa.array(text[j], pa.binary())], ["key", "uid", "span", "lone", "hot", "context"])

    return run


def _emit(uid: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Starts, in order within each context, as runs."""
    if len(start):
        new = np.flatnonzero(np.concatenate([[True], (uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + 1)]))
        n = np.diff(np.append(new, len(start)))
        yield pa.RecordBatch.from_arrays([pa.array(uid[new]), pa.array(start[new]), pa.array(n.astype(np.int64))], ["uid", "start", "n"])


def _sorted_blocks(window: int, block_bytes: int):
    """Rows come sorted by bucket; blocks of whole buckets are sorted one at a time."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size = np.fromiter((len(r[3]) for r in rows), np.int64, len(rows))
        n = size - window + 1
        row = np.repeat(np.arange(len(rows)), n)
        local = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(size) - size)[row] + local
        hit = Block(text, window).repeated(at)
        hit &= np.fromiter((r[2] for r in rows), bool, len(rows))[row]
        first = np.fromiter((r[1] >> 14 for r in rows), np.int64, len(rows))
        uid = np.fromiter((r[0] for r in rows), np.int64, len(rows))
        yield from _emit(uid[row][hit], (first[row] + local)[hit])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for key, uid, span, lone, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and size >= block_bytes:
                    yield from solve(rows)
                    rows, size = [], 0
                last = key
                rows.append((uid, span, lone, context))
                size += len(context)
        if rows:
            yield from solve(rows)

    return run


def _strings(window: int):
    """Each start of a hot bucket's contexts with the 128-bit hash of its string."""

    def run(batches):
        for batch in batches:
            for _, uid, span, lone, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = [xxhash.xxh3_128_digest(context[i : i + window]) for i in range(len(context) - window + 1)]
                d = np.frombuffer(b"".join(d), "<i8").reshape(-1, 2)
                n = len(d)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(np.full(n, uid, np.int64)), pa.array((span >> 14) + np.arange(n, dtype=np.int64)), pa.array(np.full(n, lone))], ["h1", "h2", "uid", "start", "lone"])

    return run


def repeated_starts(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """docs(uid, text), each uid once -> (uid, start, n): runs of byte offsets where a repeated string of ``window`` bytes starts."""
    if window <= REACH:
        raise ValueError(f"window must exceed {REACH}")
    runs = docs.where(F.octet_length("text") >= window).mapInArrow(_anchors(window), "key long, ctx long, uid long, span long")
    # written, so that the join below deals both sides anew: AQE can then split a frequent key
    shared = materialise(runs.groupBy("key").count().where("count > 1").select("key"))
    rows = materialise(runs.join(shared, "key"))
    contexts = materialise(rows.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("uid", "span")).alias("one")))
    whole = rows.join(contexts.where("copies > 1").select("key", "ctx"), ["key", "ctx"])
    whole = whole.select("uid", F.shiftright("span", 14).alias("start"), ((F.shiftright("span", 7).bitwiseAND(F.lit(127))) + 1).alias("n"))
    kinds = materialise(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    mixed = contexts.join(kinds, "key").select("one.uid", F.struct("key", "one.span", (F.col("copies") == 1).alias("lone"), (F.col("kinds") > bucket_limit).alias("hot")).alias("run"))
    per_doc = mixed.groupBy("uid").agg(F.collect_list("run").alias("runs"))
    # the texts are read once for all contexts, whichever way these go
    found = docs.join(per_doc, "uid").select("uid", "text", "runs")
    cuts = materialise(found.mapInArrow(_contexts(window), "key long, uid long, span long, lone boolean, hot boolean, context binary"), codec="zstd")
    columns = ("key", "uid", "span", "lone", "context")
    ordered = cuts.where("not hot").select(*columns).repartition(F.col("key")).sortWithinPartitions("key")
    blocks = ordered.mapInArrow(_sorted_blocks(window, block_bytes), "uid long, start long, n long")
    strings = cuts.where("hot").select(*columns).mapInArrow(_strings(window), "h1 long, h2 long, uid long, start long, lone boolean")
    twice = materialise(strings.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"))
    hot = strings.where("lone").join(twice, ["h1", "h2"]).select("uid", "start", F.lit(1).cast("long").alias("n"))
    return whole.unionByName(blocks).unionByName(hot)


def _cut(window: int, carried: bool):
    def run(batches):
        for batch in batches:
            data, at = string_bytes(batch.column("text"))
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")}
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                text = data[at[i] : at[i + 1]]
                edge = np.zeros(len(text) + 1, np.int32)
                if spans:
                    s = np.array([(x["start"], x["n"]) for x in spans], np.int64)
                    np.add.at(edge, s[:, 0], 1)
                    np.add.at(edge, s.sum(1) + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = text[~gone].tobytes()
                out["n_bytes"].append(len(text))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
                out["kept_text"].append(kept.decode(errors="ignore"))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            more = {"row": batch.column("row")} if carried else {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True)), *more.values()], ["doc_id", *out, *more])

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, carry: list[str] | None = None, **limits: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the bytes ``kept``, and ``kept_text``.

    ``kept_text`` is their text without characters that a cut left incomplete. ``carry``
    names columns to return as they are, in a struct ``row``.
    """
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = numbered(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more), "uid")
    spans = repeated_starts(rows.select("uid", "text"), window, **limits).groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
    if carry:
        schema = schema.add(rows.schema["row"])
    return rows.join(spans, "uid", "left").drop("uid").mapInArrow(_cut(window, bool(carry)), schema)
