"""SentencePiece encoding and decoding for merge-type (BPE) models, without the library.

Encoding is exact and works by backtracking. No piece holds the space mark after a
letter, so a text falls into segments that merge on their own, and a worker remembers
their ids; the decoded text of a document comes from its ids alone. In a segment an Aho-Corasick automaton gives the longest piece at each
place; a piece is kept if it is compatible with its left neighbour, which re-merging
the two shows (remembered by pair); else shorter pieces are tried, and a bitfield marks
positions from which no way leads on. All new segments of a batch advance together, one
trial a step, as numpy arrays; the tokens, pairs and bitfields are those of the scalar
:meth:`PieceModel.backtrack`. Characters outside the vocabulary become bytes.

Pieces made of space marks alone share one score, so their merges depend on position;
a segment with two or more marks is merged by the queue rule itself (best score first,
leftmost of equals), which also serves for re-merging.

Null text is empty and has no ids; repeated rows are encoded each; other columns pass;
no rows give no rows. A very long segment costs time and memory in proportion to its
length: its bitfield is bytes that are changed in place.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_or_empty

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments that a worker remembers at most.
CACHE_SEGMENTS = 500_000
PAIR_SLOTS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """The vocabulary of a model file, and its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores = []
        for number, value in message:
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one.get(2, bytes(4)))[0])
                self.kinds.append(one.get(3, NORMAL))
        trainer = dict(_fields(next((v for n, v in message if n == 2), b"")))
        normaliser = dict(_fields(next((v for n, v in message if n == 3), b"")))
        if trainer.get(3) != 2 or normaliser.get(1) != b"identity" or normaliser.get(4, 1) or not trainer.get(35):
            raise ValueError("only merge-type models with byte fallback, identity normalisation and kept spaces are supported")
        if set(self.kinds) & {USER, UNUSED}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = MARK if normaliser.get(3, 1) else ""
        self.unk_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.byte = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        for p in self.id:
            if MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and p.strip(MARK)):
                raise ValueError("pieces must hold the space mark in front only")
        self.automaton = ahocorasick.Automaton()
        for p in (p for p in self.id if len(p) > 1):  # a single character is there anyway
            self.automaton.add_word(p, (len(p), self.id[p]))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}
        self.known: dict[str, bytes] = {}  # a segment's ids, four bytes each
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.raw = [self._raw(i) for i in range(len(self.pieces))]
        # tokens of the batch encoder: the pieces, then single characters outside the vocabulary as they come
        self.token = {p: i for p, i in self.id.items()}
        self.names = list(self.pieces)
        self.packed = [_packed([i]) for i in range(len(self.pieces))]
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.prefix_of = np.array([-1 if (q := self._shorter(p)) is None else self._token(q) for p in self.pieces], np.int64)
        self.by_code = np.full(0x110000, -1, np.int32)
        self.pair_keys = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)

    def _token(self, piece: str) -> int:
        got = self.token.get(piece)
        if got is None:  # a single character
            got = self.token[piece] = len(self.names)
            self.names.append(piece)
            self.packed.append(_packed([self.byte[b] for b in piece.encode()]))
        return got

    def _compatible_pairs(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """:meth:`compatible` for arrays of tokens (-1: nothing), through a direct-mapped table."""
        key = (last + 1 << 24) | piece
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64) & (PAIR_SLOTS - 1)
        miss = np.flatnonzero(self.pair_keys[slot] != key)
        ok = self.pair_ok[slot]
        if len(miss):
            new, where = np.unique(key[miss], return_inverse=True)
            names = self.names
            told = np.array([self.compatible(names[(k >> 24) - 1] if k >> 24 else "", names[k & 0xFFFFFF]) for k in new.tolist()], bool)
            ok[miss] = told[where]
            self.pair_keys[slot[miss]], self.pair_ok[slot[miss]] = key[miss], ok[miss]
        return ok

    def _characters(self, text: str) -> list[int]:
        """The token of each character."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        got = self.by_code[codes]
        if (got < 0).any():
            for c in np.unique(codes[got < 0]).tolist():
                self.by_code[c] = self._token(chr(c))
            got = self.by_code[codes]
        return got.tolist()

    def backtrack_many(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`backtrack` of many segments of at most 62 characters: a row of tokens each, and how many."""
        text = "\0".join(segments)
        best = self._characters(text)
        for end, (n, t) in self.automaton.iter(text):
            best[end + 1 - n] = t  # later ends are longer
        best = np.array(best, np.int64)
        size = np.append(self.size, np.ones(len(self.names) - len(self.size), np.int64))
        prefix = np.append(self.prefix_of, np.full(len(self.names) - len(self.prefix_of), -1, np.int64))
        width = np.fromiter(map(len, segments), np.int64, len(segments))
        begin = np.cumsum(width + 1) - width - 1
        at = np.zeros(len(segments), np.int64)
        open_ = np.full(len(segments), (1 << 63) - 1, np.int64)
        stack = np.full((len(segments), int(width.max()) + 1), -1, np.int64)  # column 0 stays -1: nothing
        depth = np.zeros(len(segments), np.int64)
        piece = best[begin]
        act = np.arange(len(segments))
        while len(act):
            p, last = piece[act], stack[act, depth[act]]
            end = at[act] + size[p]
            good = (open_[act] >> end & 1).astype(bool)
            good[good] = self._compatible_pairs(last[good], p[good])
            yes, no = act[good], act[~good]
            depth[yes] += 1
            stack[yes, depth[yes]] = p[good]
            at[yes] = end[good]
            more = yes[at[yes] < width[yes]]
            piece[more] = best[begin[more] + at[more]]
            less = prefix[p[~good]]
            piece[no] = less
            dead, gone = no[less < 0], last[~good][less < 0]
            if (gone < 0).any():
                raise ValueError("no encoding")
            open_[dead] &= ~(np.int64(1) << at[dead])
            at[dead] -= size[gone]
            depth[dead] -= 1
            piece[dead] = gone
            act = np.concatenate([more, no])
        return stack[:, 1:], depth

    def _learn(self, segments: list[str]) -> None:
        plain = [s for s in segments if len(s) <= 62 and not s.startswith(MARK * 2) and "\0" not in s]
        for s in set(segments).difference(plain):
            self.known[s] = _packed(self._segment(s))
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            stack, depth = self.backtrack_many(part)
            packed = self.packed.__getitem__
            for s, row, n in zip(part, stack.tolist(), depth.tolist(), strict=True):
                self.known[s] = b"".join(map(packed, row[:n]))

    def merge(self, text: str) -> list[str]:
        """The queue rule: join the neighbours whose union scores best, leftmost of equals, until none is a piece."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-s, a, b, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, both = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``a`` (or nothing) and ``b`` side by side stay as they are when merged anew."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return got

    def _shorter(self, piece: str) -> str | None:
        """The longest piece (or single character) that is a proper prefix of ``piece``."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.id), None)
        return self.shorter[piece]

    def backtrack(self, text: str) -> list[str]:
        longest = list(text)
        for end, (n, i) in self.automaton.iter(text):
            longest[end + 1 - n] = self.pieces[i]  # later ends are longer
        closed = bytearray(len(text) // 8 + 1)  # the bitfield of positions from which no way leads on
        out: list[str] = []
        at, piece = 0, longest[0] if text else None
        while piece is not None:
            last = out[-1] if out else ""
            while piece is not None:
                end = at + len(piece)
                if not closed[end >> 3] >> (end & 7) & 1 and self.compatible(last, piece):
                    out.append(piece)
                    at = end
                    piece = longest[at] if at < len(text) else None
                    break
                piece = self._shorter(piece)
            else:
                if not out:
                    raise ValueError("no encoding")
                closed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                piece = last
        return out

    def _segment(self, segment: str) -> list[int]:
        """The ids of a segment."""
        return self.to_ids(self.merge(segment) if segment.startswith(MARK * 2) else self.backtrack(segment))

    def to_ids(self, parts: list[str]) -> list[int]:
        ids = []
        for p in parts:
            i = self.id.get(p)
            ids += [i] if i is not None else [self.byte[b] for b in p.encode()]
        return ids

    def _segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self._segments(text) for i in self._segment(s)]

    def _raw(self, i: int) -> bytes:
        """What an id stands for, in UTF-8: of a byte piece one byte."""
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        return b"" if kind == CONTROL else (self.unk_text if kind == UNKNOWN else self.pieces[i].replace(MARK, " ")).encode()

    def _join(self, ids: list[int]) -> str:
        try:
            return b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # byte pieces that are no character
            pass
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                raw.append(int(self.pieces[i][1:-1], 16))
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i >= 0 and self.kinds[i] != CONTROL:
                out.append(self.unk_text if self.kinds[i] == UNKNOWN else self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._join(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        bare = first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(MARK)
        return text[1:] if self.prefix and bare else text

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, the digest of the ids, and the decoded text."""
        if len(self.known) > CACHE_SEGMENTS:
            self.known.clear()
        split = [self._segments(t) for t in texts]
        self._learn(list({s for part in split for s in part} - self.known.keys()))
        return [self._digest(part) for part in split]

    def _digest(self, segments: list[str]) -> tuple[int, str, str]:
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, segments)), "<i4").tolist()
        return len(ids), hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest(), self.decode(ids)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that belongs to no character gives one replacement character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _digests(path: str):
    def run(batches):
        model = PieceModel(path)
        for batch in batches:
            texts = batch.column("text")
            rows = [r for i in range(0, len(batch), 512) for r in model.digests(texts.slice(i, 512).to_pylist())]
            sha = [hashlib.sha256(r[2].encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array(sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str, column: str, out: str):
    def run(batches):
        model = PieceModel(path)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out])

    return run


def _decode(path: str, column: str, out: str):
    def run(batches):
        model = PieceModel(path)
        for batch in batches:
            text = [model.decode(i or []) for i in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, out])

    return run


def encode_column(df: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the ids of ``column``; a column of that name is replaced."""
    df = df.drop(out)
    return df.mapInArrow(_encode(path, column, out), T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_column(df: DataFrame, path: str, column: str = "ids", out: str = "text") -> DataFrame:
    """Adds ``out``, the text of the ids in ``column``; a column of that name is replaced."""
    df = df.drop(out)
    return df.mapInArrow(_decode(path, column, out), T.StructType([*df.schema, T.StructField(out, T.StringType())]))


def round_trip_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text."""
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return docs.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
