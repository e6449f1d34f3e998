"""Packing of tokenised documents into sequences of bounded length: minimum bin slack.

A document's ids (and the end id) are cut into full pieces, which are sequences of
their own, and one remainder. Remainders meet in shards of about ``shard_docs``
documents, dealt by a hash of content and place, and each shard is packed alone:

* the largest remaining length opens a window;
* a bitset (one big integer: bit s is set if the sum s can be reached) takes the other
  lengths with their multiplicities, in binary parts, and stops at an exact fill;
* the best reachable sum is backtracked into counts per length, and the pattern is
  used as often as the counts allow.

Padding goes up to the capacity, except for sequences whose length is a power of two,
so a window that cannot be filled prefers such a sum. Shards hold lengths and check
sums, not ids (unless asked for), so a task's memory does not depend on the texts.

Null text counts as empty (just the end id); ids of any size, null ones among them, are
carried through as they are; rows that repeat are packed each; very long texts are many
full pieces, of which a shard holds numbers only; equal lengths go in order of arrival;
extra columns are ignored; no documents give no pieces.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

CAPACITY = 1024
#: Words whose ids a worker remembers at most.
CACHE_WORDS = 500_000
SHARD_DOCS = 4096
_LETTER, _SPACE = "A-Za-zÀ-ÖØ-öø-ɏ", " \\t\\n\\r"
#: Texts of these characters alone split alike under the standard library's expressions, which are faster.
_PLAIN = re.compile(f"[{_LETTER}{_SPACE}!-~]*")
_PLAIN_WORDS = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_STANDARD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose class regular-expression engines differ; texts with them go to the tokenizer whole.
_UNSURE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")


def _byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordIds:
    """Ids of byte-level BPE as little-endian 32-bit words, remembered by word.

    The pattern splits a text into words that the model encodes each on its own. New
    words are merged by rank where the vocabulary's ids follow its merges, which is
    checked; else, and for unusual texts (such as hold an added token's content), the
    tokenizer itself is asked.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.find = regex.compile(pattern).findall
        self.plain = re.compile(_PLAIN_WORDS).findall if pattern == _STANDARD else None
        self.known: dict[str, bytes] = {}
        self.ranks = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        import tiktoken

        with open(path) as f:
            model = json.load(f)["model"]
        names, vocab = _byte_names(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(names[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
        return tiktoken.Encoding("words", pat_str=_STANDARD, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _split(self, text: str) -> list[str] | None:
        if self.added(text):
            return None
        if self.plain and _PLAIN.fullmatch(text):
            return self.plain(text)
        return None if _UNSURE.search(text) else self.find(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        split = [self._split(t) for t in texts]
        new = {w for s in split if s for w in s} - self.known.keys()
        if self.ranks:
            single, pack = self.ranks, struct.pack
            for w in new:
                ids = single(w.encode())
                self.known[w] = pack(f"<{len(ids)}I", *ids)
        else:
            self.known.update(zip(new, self._encode(list(new)), strict=True))
        get = self.known.__getitem__
        return [self._encode([t])[0] if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


def _tokenise(path: str, pattern: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(path, pattern)
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for whole in batches:
            for i in range(0, len(whole), 128):
                batch = whole.slice(i, 128)
                got = [b + end for b in ids(batch.column("text").to_pylist())]
                crc = [[zlib.crc32(b[k : k + width]) for k in range(0, len(b), width)] for b in got]
                cols = [batch.column("doc_id"), pa.array([len(b) // 4 for b in got], pa.int64()), pa.array(crc, pa.list_(pa.int64()))]
                names = ["doc_id", "doc_tokens", "crcs"]
                if with_ids:
                    cols.append(pa.array(got, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def padding(total: int, capacity: int) -> int:
    return 0 if total & (total - 1) == 0 else capacity - total


def fill(counts: np.ndarray, largest: int, capacity: int) -> dict[int, int]:
    """The multiset of lengths, with one ``largest``, that leaves the least padding: {length: how many}."""
    room = capacity - largest
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left = min(int(counts[length]) - (length == largest), room // length)
        part = 1
        while left > 0 and not reach >> room & 1:
            k = min(part, left)
            steps.append((length, k, reach))
            reach |= reach << (k * length) & mask
            left -= k
            part *= 2
        if reach >> room & 1:
            break
    if reach >> room & 1:
        best = room
    else:
        sums = [s for s in range(room + 1) if reach >> s & 1]
        best = min(sums, key=lambda s: (padding(largest + s, capacity), -s))
    out = {largest: 1}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            best -= k * length
            out[length] = out.get(length, 0) + k
    return out


def patterns(counts: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """counts[l] remainders of length l -> (lengths in a sequence, how many such sequences)."""
    counts = counts.copy()
    largest = len(counts) - 1
    while True:
        while largest and not counts[largest]:
            largest -= 1
        if not largest:
            return
        one = fill(counts, largest, capacity)
        times = min(int(counts[n]) // k for n, k in one.items())
        for n, k in one.items():
            counts[n] -= k * times
        yield one, times


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length its sequence and offset, and the number of sequences."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    used = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sequence, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    used[0] += counts[0]
    for one, times in patterns(np.concatenate([[0], counts[1:]]), capacity):
        at = 0
        for length, k in sorted(one.items(), reverse=True):
            for _ in range(k):
                rows = order[used[length] : used[length] + times]
                used[length] += times
                sequence[rows] = n + np.arange(times)
                offset[rows] = at
                at += length
        n += times
    return sequence, offset, n


def _pack(capacity: int, with_ids: bool):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = rows["doc_tokens"].to_numpy()
        full, rest = total // capacity, total % capacity
        sequence, offset, n = place(rest, capacity)
        pieces = full + (rest > 0)
        row = np.repeat(np.arange(len(total)), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = k == full[row]
        start, length = k * capacity, np.where(last, rest[row], capacity)
        out = {
            "doc_id": rows["doc_id"].take(pa.array(row)), "start": start, "length": length, "ids_crc32": pc.list_flatten(rows["crcs"]), "doc_tokens": total[row],
            "sequence_id": (key[0].as_py() << 32) + np.where(last, sequence[row], n + np.cumsum(~last) - 1), "offset": np.where(last, offset[row], 0),
        }
        if with_ids:
            ids = rows["ids"].to_pylist()
            out["ids"] = pa.array([ids[r][4 * s : 4 * (s + m)] for r, s, m in zip(row, start, length, strict=True)], pa.binary())
        return pa.table(out)

    return run


def pack_documents(documents: DataFrame, path: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """documents(doc_id, text, ...) -> one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ``ids`` (little-endian 32-bit).
    """
    id_type = documents.schema["doc_id"].dataType
    ids = T.StructType([T.StructField("ids", T.BinaryType())] if with_ids else [])
    shards = max(1, -(-documents.count() // shard_docs))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), *ids])
    docs = documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(_tokenise(path, pattern, end_id, capacity, with_ids), schema)
    # a row's place in its file spreads rows that repeat; it is the same when a task is run again
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("crcs", F.monotonically_increasing_id()), F.lit(shards)))
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in longs), *ids])
    return docs.groupBy("shard").applyInArrow(_pack(capacity, with_ids), out)
