"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The canonical token lists of byte strings form a monoid: join(enc(a), enc(b)) = enc(ab). A text is encoded by
halving. Halves are encoded recursively and joined: the tokens next to the border are taken as a window, its bytes are
encoded anew, and the window grows to a side until the tokens outside are provably stable there. The proof rests on
this property of merges by rank: a list of tokens is canonical exactly if each adjacent pair is, that is if the bytes of
the pair encode to that pair. Tokens outside the window were canonical before, tokens inside are by construction, so
only the two pairs across the window's edges have to be looked at. At the edges of the matches of the splitting pattern
no window is needed, as each match is encoded by itself.

The property holds if merges by rank make each token of its own bytes, which is checked for a vocabulary before it is used.

Edge cases: null and empty texts have no tokens; any UTF-8 text has tokens, as each byte is one; repeated rows give
repeated results; extra columns of the input are left out, but for those asked for by `keep`.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import apart, bounded

#: Bytes of a leaf of the tree: so short a string is encoded by plain merges.
LEAF = 4
#: Most entries of each of a worker's memories, and longest key that is remembered; results don't depend on them.
MEMO, LONGEST = 600_000, 64
PACKED = [struct.Struct(f"<{n}I").pack for n in range(32)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Memory(dict):
    """Remembers what a function makes of a key. When half full it becomes the old generation, from which keys that come again are taken over, so what is frequent stays."""

    def __init__(self, make: Callable, limit: int) -> None:
        self.make, self.half, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder for one vocabulary and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, memo: int = MEMO) -> None:
        import regex

        self.ranks, self.leaf = ranks, max(1, leaf)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.split = regex.compile(pattern).findall
        self.words, self.sizes = Memory(self.packed, memo), Memory(lambda m: len(self.piece(m.encode())), memo)
        self.short, self.pairs = Memory(self.merge, memo), Memory(lambda ab: self.window(self.bytes_of[ab[0]] + self.bytes_of[ab[1]]), memo)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Plain merges: the adjacent pair of lowest rank, leftmost first, until none is left. A heap keeps long windows at n log n."""
        ranks = self.ranks
        if len(piece) <= 32:
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if best == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return tuple(ranks[p] for p in parts)
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a position; end 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if not (mid := end[i]) or mid >= n or end[mid] != stop:  # one of the two has changed since
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def window(self, piece: bytes) -> tuple[int, ...]:
        """Canonical tokens of the bytes of a window. Windows are a few tokens wide whatever the text's length."""
        if (i := self.ranks.get(piece)) is not None:
            return (i,)
        return self.short[piece] if len(piece) <= 24 else self.merge(piece)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """Tokens of the bytes of two tokens; the pair is canonical if these are the two."""
        return self.pairs[a, b]

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The canonical list of two neighbours' bytes together."""
        if not left or not right:
            return left + right
        inner = self.pair(left[-1], right[0])
        if inner == (left[-1], right[0]):
            return left + right
        i, j, of = 1, 1, self.bytes_of
        while True:
            low = i == len(left) or self.pair(x := left[-i - 1], inner[0]) == (x, inner[0])
            high = j == len(right) or self.pair(inner[-1], x := right[j]) == (inner[-1], x)
            if low and high:
                return left[: len(left) - i] + inner + right[j:]
            i, j = min(len(left), i * (2 - low)), min(len(right), j * (2 - high))
            inner = self.window(b"".join([of[t] for t in left[-i:]] + [of[t] for t in right[:j]]))

    def piece(self, raw: bytes) -> tuple[int, ...]:
        """Tokens of one match. A whole match that is a token stands for itself."""
        return (i,) if (i := self.ranks.get(raw)) is not None else self.tree(raw)

    def tree(self, raw: bytes) -> tuple[int, ...]:
        if len(raw) <= self.leaf:
            return self.window(raw)
        if len(raw) > 4096:  # a long match: its levels are lists, joined from the leaves upwards, so no deep slices are copied
            return tuple(self.reduce([self.tree(raw[i : i + 2048]) for i in range(0, len(raw), 2048)]))
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def reduce(self, level: list[tuple[int, ...]]) -> tuple[int, ...]:
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def packed(self, match: str) -> bytes:
        ids = self.piece(match.encode())
        return PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else np.array(ids, "<u4").tobytes()

    def encode_raw(self, text: str) -> bytes:
        """Tokens as little-endian unsigned 32-bit integers. Borders of matches are stable, so their lists are concatenated."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        """Number of tokens."""
        return sum(map(self.sizes.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_raw(text or ""), "<u4").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of the tokens, put together up the tree of halves; a leaf is joined at once."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def proved(path: str, pattern: str) -> bool:
    """Whether the proof holds for a vocabulary: each byte is a token, and merges by rank make each token of its own bytes."""
    own = Codec(read_ranks(path), pattern, memo=2)
    return all(bytes([b]) in own.ranks for b in range(256)) and all(own.merge(t) == (i,) for t, i in own.ranks.items())


def checked(path: str, pattern: str) -> None:
    if not proved(path, pattern):
        raise ValueError(f"{path}: a byte is no token, or merges by rank don't make some token of its bytes, so halves can't be joined")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """(id, *keep, n_tokens, ids array<int>, ids_sha256, decoded_sha256) for each row, whole texts. Without `ids`, no lists."""
    apart([id_col, *keep], ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])
    checked(path, pattern)
    picked = bounded(docs).select(id_col, *[c for c in keep if c != id_col], F.col(text_col).cast("string").alias("__text"))
    own = [f for f in picked.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", n_tokens bigint, " + "ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, lists, digests, back = [], [], [], []
                for text in batch.column(batch.num_columns - 1):
                    raw = c.encode_raw(text.as_py() or "")
                    found = np.frombuffer(raw, "<u4")
                    n.append(len(found))
                    lists.append(found.astype(np.int32) if ids else None)
                    digests.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(c.decode(found.tolist())).hexdigest())
                arrays = [*batch.columns[:-1], pa.array(n, pa.int64())]
                if ids:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]))))
                arrays += [pa.array(digests, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_tokens", *(["ids"] * ids), "ids_sha256", "decoded_sha256"])

    return picked.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from lists of ids; null lists give empty texts. Bytes that aren't UTF-8 are replaced by U+FFFD."""
    picked = encoded.select(id_col, F.col(ids_col).alias("__ids"))
    kind = picked.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return picked.mapInArrow(run, f"`{id_col}` {kind}, text string")
