"""Best-fit packing of token sequences by a configuration linear program.

Every text becomes token ids and an end id; only texts longer than a sequence are cut, into pieces.
Packing then looks at the histogram of piece lengths alone (at most ``capacity`` rows, whatever the
corpus):

1. the configuration program, min sum x_p with sum_p a(p, l) x_p >= n(l), is solved by
   multiplicative weights; patterns are priced by a knapsack dynamic program over 1..capacity;
2. the solution is rounded: every pattern is used as often as its share and the pieces left allow;
3. what is left is placed by best fit, decreasing, on runs of equal bins.

The plan is a list of runs: pieces ``first .. first + number - 1`` of a length go to these
sequences at these offsets.  It is bounded by the rounds, not by the corpus.  A piece finds its run
by its rank among the pieces of its length, which needs no task that sees a whole length: ranks are
counted in shards, and the shards' counts are summed up.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, tokenizer_file
from .pretokens import byte_string, words_of

#: Bytes of the memo from word to ids that a Python worker keeps, about; it is emptied when full.  What an entry takes besides its words.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 250

#: Pieces that a shard holds on average when ranks are counted.
SHARD_ROWS = 100_000

#: Marks that end words, and the last Latin letter that is taken for simple.
MARKS, LATIN = ".,!?;:", "\u024f"

_STATE: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts as the library gives them for a tokenizer that drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.held = 0  # bytes of both
        self.marks = {"": b""} | {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in MARKS}

    def simple(self, word: str) -> str | None:
        """The word in lower case if the tokenizer takes it as one pre-token of letters (composed Latin
        letters, whose lower case doesn't depend on their neighbours); else None."""
        if not word.isascii() and not (max(word) <= LATIN and is_normalized("NFC", word)):
            return None
        low = word.lower()
        return low if low.isalpha() else None

    def letters(self, word: str) -> bytes:
        """Ids of a pre-token of letters by the library's merges."""
        found = self.bare.get(word)
        if found is None:
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else byte_string(word))]
            found = self.bare[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def learn(self, words: set[str]) -> None:
        """Encode new words.  Words of letters share an entry with their lower case and with the same
        word before a punctuation mark, which is a pre-token of its own; others go to the library whole."""
        rest: list[str] = []
        for word in words:
            stem, last = (word[:-1], word[-1]) if word[-1] in MARKS else (word, "")
            low = self.simple(stem) if stem else None
            if low is None:
                rest.append(word)
            else:
                self.memo[word] = self.letters(low) + self.marks[last]
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.memo[word] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of every text, without an end id."""
        split = [words_of(t) for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.bare.clear()
            self.held = 0
        new = new.difference(self.memo)
        self.held += 3 * sum(map(len, new)) + ENTRY_BYTES * len(new)
        self.learn(new)
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in split]


def word_encoder(path: str) -> WordEncoder:
    if path not in _STATE:
        _STATE.clear()
        _STATE[path] = WordEncoder(path)
    return _STATE[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every whole text's ids (and ``end_id``) into pieces of at most ``capacity``.

    Returns per piece: the id, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` and, with
    ``keep_ids``, the ``ids``.  A null text is an empty text: one piece that holds the end id alone.
    Null ids and repeated rows stay as they are; an empty table gives no pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row, piece, start, length, crc, cut = [], [], [], [], [], []
            for i, packed in enumerate(word_encoder(vocabulary).encode(part.column(1).to_pylist())):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    one = packed[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(one) // 4)
                    crc.append(zlib.crc32(one))
                    if keep_ids:
                        cut.append(np.frombuffer(one, "<i4"))
            columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(cut, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


# --- the plan ---------------------------------------------------------------------------------


def knapsack(values: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: the greatest value of lengths (with repetition) that sum up to c at most.

    ``values[l]`` is the value of length l, 0 where the length doesn't occur."""
    best = np.zeros(capacity + 1)
    back = np.zeros(capacity + 1)  # best, reversed, so that both operands are contiguous
    item = values[1 : capacity + 1]
    for c in range(1, capacity + 1):
        # best[c - l] for l = 1..c lies at back[capacity - c + 1 :]
        best[c] = (back[capacity - c + 1 : capacity + 1] + item[:c]).max()
        back[capacity - c] = best[c]
    return best


def trace(best: np.ndarray, values: np.ndarray, room: int, left: np.ndarray) -> list[int]:
    """A pattern that attains best[room], longest lengths first; no length more often than ``left`` has it."""
    out: list[int] = []
    used: dict[int, int] = {}
    while room > 0 and best[room] > 0:
        ways = np.flatnonzero(best[room - np.arange(1, room + 1)] + values[1 : room + 1] >= best[room] * (1 - 1e-12)) + 1
        ways = ways[values[ways] > 0][::-1]
        for way in ways.tolist():
            if used.get(way, 0) < left[way]:
                out.append(way)
                used[way] = used.get(way, 0) + 1
                room -= way
                break
        else:
            room -= 1
    return out


def configurations(counts: np.ndarray, capacity: int, rounds: int = 120, patterns: int = 12, rate: float = 8.0) -> dict[tuple[int, ...], float]:
    """Multiplicative weights on the lengths; each round adds the best patterns for the weights.

    A round prices with one knapsack table and takes, for the ``patterns`` lengths that are covered
    least, the best pattern that holds the length.  Each pattern taken is run for an equal part of
    the bins; a length's weight falls exponentially with the share of it that is covered beyond the
    round's share.  Returns pattern -> how often.
    """
    have = np.flatnonzero(counts)
    if not len(have):
        return {}
    weight = np.zeros(capacity + 1)
    covered = np.zeros(capacity + 1)
    x: dict[tuple[int, ...], float] = {}
    bins = max(1.0, float((counts * np.arange(len(counts))).sum()) / capacity)
    step = bins / (rounds * patterns)
    for k in range(rounds):
        share = covered[have] / counts[have]
        weight[have] = have / capacity * np.exp(-rate * np.clip(share - k / rounds, -1, 1))
        best = knapsack(weight, capacity)
        for length in have[np.argsort(share, kind="stable")[:patterns]].tolist():
            pattern = tuple(sorted([length, *trace(best, weight, capacity - length, counts)], reverse=True))
            kinds, number = np.unique(pattern, return_counts=True)
            times = min(max(step, 1.0), float((counts[kinds] / number).min()))
            x[pattern] = x.get(pattern, 0.0) + times
            covered[kinds] += number * times
    return x


class Plan:
    """Runs of equal sequences: ``(first sequence, how many, [(length, number in each)], room)``."""

    def __init__(self, counts: np.ndarray, capacity: int, share: float = 0.9, **how):
        self.capacity = capacity
        left = counts.astype(np.int64).copy()
        self.groups: list[list] = []  # [multiplicity, lengths, room]
        self.lower_bound = -(-int((left * np.arange(len(left))).sum()) // capacity)
        full = int(left[capacity])
        if full:
            self.groups.append([full, [capacity], 0])
            left[capacity] = 0
        x = configurations(left, capacity, **how)
        # patterns that fill a sequence come first; then those with the larger share
        order = sorted(x, key=lambda p: (capacity - sum(p), -x[p], p))
        for p in order:
            kinds, number = np.unique(p, return_counts=True)
            times = min(int((left[kinds] // number).min()), int(x[p] * share + 0.5))
            if times:
                left[kinds] -= number * times
                self.groups.append([times, list(p), capacity - sum(p)])
        self.best_fit(left)
        at = 0
        self.runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
        rank: dict[int, int] = {}
        for times, lengths, _ in self.groups:
            offset, k = 0, 0
            while k < len(lengths):
                length, same = lengths[k], 1
                while k + same < len(lengths) and lengths[k + same] == length:
                    same += 1
                first = rank.get(length, 0)
                self.runs.setdefault(length, []).append((first, same, at, offset, times))
                rank[length] = first + same * times
                offset += same * length
                k += same
            at += times
        self.sequences = at

    def best_fit(self, left: np.ndarray) -> None:
        """Best fit, decreasing: each length goes where it leaves the least room; equal bins at once."""
        by_room: dict[int, list[list]] = {}
        for g in self.groups:
            if g[2]:
                by_room.setdefault(g[2], []).append(g)
        rooms = sorted(by_room)
        for length in np.flatnonzero(left)[::-1].tolist():
            n = int(left[length])
            while n:
                i = bisect.bisect_left(rooms, length)
                if i == len(rooms):
                    per = self.capacity // length
                    times = n // per or 1
                    group = [times, [length] * min(n, per), 0]
                    group[2] = self.capacity - length * len(group[1])
                    n -= times * len(group[1])
                    self.groups.append(group)
                else:
                    room = rooms[i]
                    group = by_room[room].pop()
                    if not by_room[room]:
                        del by_room[room]
                        rooms.pop(i)
                    if group[0] > n:  # split the run: only n of its bins get one
                        rest = [group[0] - n, list(group[1]), room]
                        self.groups.append(rest)
                        if room not in by_room:
                            bisect.insort(rooms, room)
                        by_room.setdefault(room, []).append(rest)
                        group[0] = n
                    n -= group[0]
                    group[1].append(length)
                    group[2] = room - length
                if group[2]:
                    if group[2] not in by_room:
                        bisect.insort(rooms, group[2])
                    by_room.setdefault(group[2], []).append(group)

    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: where the runs begin, and (first rank, number in each, first sequence, offset)."""
        return {k: (np.array([r[0] for r in v], np.int64), np.array([r[:4] for r in v], np.int64)) for k, v in self.runs.items()}


def place(length: np.ndarray, rank: np.ndarray, tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and rank."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for one in np.unique(length).tolist():
        at = np.flatnonzero(length == one)
        starts, runs = tables[one]
        first, same, base, shift = runs[np.searchsorted(starts, rank[at], "right") - 1].T
        k = rank[at] - first
        sequence[at] = base + k // same
        offset[at] = shift + k % same * one
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece"), **how) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, whose ``length`` is 1..capacity.

    ``pieces`` must be a written table (it is read twice).  ``order`` names columns that tell its rows
    apart; rows that are alike in them are interchangeable up to the order within their length, as
    are rows with nulls there.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # capacity rows at most
        histogram[row.length] = row["count"]
    total = int(histogram.sum())
    plan = Plan(histogram, capacity, **how)
    tables = spark.sparkContext.broadcast(plan.tables())
    shards = max(16, -(-total // SHARD_ROWS))
    rows = pieces.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "_shard").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "_shard").orderBy(*order)
    ranked = rows.withColumn("_in", F.row_number().over(within) - 1).join(counts, ["length", "_shard"])
    ranked = ranked.withColumn("_rank", F.col("_in") + F.col("_before")).select(*pieces.columns, "_rank")
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rank_at = names.index("length"), names.index("_rank")
        for b in batches:
            sequence, offset = place(b.column(at).to_numpy(), b.column(rank_at).to_numpy(), tables.value)
            columns = [b.column(i) for i in range(len(names)) if i != rank_at]
            yield pa.record_batch([*columns, pa.array(sequence), pa.array(offset)], names=[*names[:rank_at], *names[rank_at + 1 :], "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*pieces.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, keep_ids: bool = True, **how) -> DataFrame:
    """Token pieces of ``docs`` with the sequence and the offset of each; see ``token_pieces`` and ``pack``."""
    return pack(materialize(token_pieces(docs, vocabulary, capacity, keep_ids=keep_ids), "pieces"), capacity, **how)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens; see ``token_pieces`` and ``pack`` for special cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), keep_ids=False)
