"""Byte-level BPE with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself an entry costs one
probe.  Tier two merges the others with a heap of candidate pairs over linked bytes, lowest rank
first, leftmost among equals.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tokenizer_file
from .pretokens import CHUNK, pattern, plain, pre_tokens, split_spaces

#: Entries of the memo from chunk to ids that a Python worker keeps; it is emptied when full.
MEMO_ENTRIES = 700_000

_MASK = (1 << 64) - 1
_STATE: dict[str, "Codec"] = {}


class PerfectHash:
    """Minimal perfect hash: every key has a slot of its own among ``len(keys)`` slots.

    Keys fall into buckets; from the fullest bucket on, a displacement is sought that sends the
    bucket's keys to free slots.  Buckets of one key take the slots left over, which are stored
    directly (as negative displacements).
    """

    def __init__(self, keys: dict[bytes, int]):
        self.n = max(1, len(keys))
        self.buckets = max(1, self.n // 3)
        self.shift = [0] * self.buckets
        self.key: list[bytes | None] = [None] * self.n
        self.value = [-1] * self.n
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for k in keys:
            h = xxhash.xxh64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, k))
        free = bytearray(b"\1") * self.n
        order = sorted(groups, key=lambda b: (-len(groups[b]), b))
        singles = [b for b in order if len(groups[b]) == 1]
        for b in order[: len(order) - len(singles)]:
            hashes, d = [h for h, _ in groups[b]], 0
            while True:
                slots = [self.slot(h, d) for h in hashes]
                if all(map(free.__getitem__, slots)) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, k) in zip(slots, groups[b]):
                free[s], self.key[s], self.value[s] = 0, k, keys[k]
        left = (s for s in range(self.n) if free[s])
        for b, s in zip(singles, left):
            self.shift[b] = -1 - s
            self.key[s] = groups[b][0][1]
            self.value[s] = keys[self.key[s]]

    def slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & _MASK
        return (x >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -1 - d if d < 0 else self.slot(h, d)
        return self.value[s] if self.key[s] == key else -1


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.whole = PerfectHash(self.ranks)
        self.pattern = pattern()
        self.memo: dict[str, bytes | None] = {}
        self.merged: dict[str, bytes] = {}
        self.library = None
        self.tables: dict[str, bool] = {}

    def known(self, char: str) -> bool:
        """Whether the library takes a character, which is a letter or number in newer tables, for one: tried, as its tables
        can't be read.  After a letter or number ``'s`` is a pre-token of its own."""
        if char not in self.tables:
            if self.library is None:
                import tiktoken

                self.library = tiktoken.Encoding("probe", pat_str=self.pattern.pattern, mergeable_ranks=self.ranks, special_tokens={})
            self.tables[char] = self.library.encode_ordinary(char + "'s")[-1] == self.ranks[b"'s"]
        return self.tables[char]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no entry: heap over linked bytes."""
        n, rank = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the part that begins here, 0 if none does
        begin = list(range(-1, n))  # of the part that ends here
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue  # a part of the pair has been merged since
            end[i], end[j], begin[e] = e, 0, i
            if i and (r := rank(piece[begin[i] : e])) is not None:
                heapq.heappush(heap, (r, begin[i], e))
            if e < n and (r := rank(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def part(self, part: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        found = self.merged.get(part)
        if found is None:
            raw = part.encode()
            one = self.whole.get(raw)
            ids = [one] if one >= 0 else self.merge(raw)
            found = self.merged[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk: the pre-tokens' ids one after another."""
        if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self.part(chunk)
        return b"".join(map(self.part, pre_tokens(chunk, self.pattern, self.known)))

    def learn(self, pieces: Iterable[str]) -> None:
        for piece in pieces:
            self.memo[piece] = self.chunk(" " + piece) if plain(piece) else None

    def packed(self, text: str) -> bytes:
        first, *rest = split_spaces(text)
        if plain(first):
            try:
                return self.chunk(first) + b"".join(map(self.memo.__getitem__, rest))
            except TypeError:  # a piece with white space at an end
                pass
        return b"".join(map(self.chunk, CHUNK.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        new: set[str] = set()
        for text in texts:
            new.update(split_spaces(text))
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            self.merged.clear()
        self.learn(new.difference(self.memo))
        return list(map(self.packed, texts))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def codec(path: str) -> Codec:
    if path not in _STATE:
        _STATE.clear()
        _STATE[path] = Codec(path)
    return _STATE[path]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``ids`` (array of int) of every whole text; a null text has no ids.

    One pass without a shuffle.  Null ids and repeated rows stay as they are, other columns are left
    out, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 2 << 20):
            packed = codec(ranks).encode(part.column(1).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.record_batch([part.column(0), ids], names=[id_col, "ids"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ``bytes`` (binary) of every list of ids; null lists give null.  An id outside the
    vocabulary raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 2 << 20):
            out = [None if x is None else codec(ranks).decode(np.array(x, "u4")) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    rows = encoded.select(F.col(id_col), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again; per row the id, ``n_tokens`` and the
    SHA-256 of the packed ids and of the decoded bytes.  ``encode`` and ``decode`` in one pass, so that the
    ids needn't leave the Python worker.  A null text has no ids; null ids and repeated rows stay rows of their own; an empty table
    gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for part in slices(batches, 1):
            packed = own.encode(part.column(1).to_pylist())
            back = (own.decode(np.frombuffer(x, "<u4")) for x in packed)
            yield pa.record_batch(
                [part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array([hashlib.sha256(x).hexdigest() for x in back])],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to; see ``round_trip`` for special cases."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))
