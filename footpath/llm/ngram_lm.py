"""Language-model scores from an Elias-Fano n-gram trie of three levels.

Model: trigrams over bigrams over words, each level with a Dirichlet prior of the one below,

    P(w | u v) = (n(u v w) + MU3 * P(w | v)) / (n(u v) + MU3),
    P(w | v)   = (n(v w) + MU2 * P(w)) / (n(v) + MU2),

where unknown words together have the Good-Turing mass of the words that were seen once, and known ones share
the rest by their counts.  A text's tokens are its words and one end; before the first stand two starts.

Level one is the vocabulary: sorted word hashes (Elias-Fano), exact counts and quantised log
probabilities; a word's id is its rank.  Levels two and three are cut into shards by first word, frequent
first words also by second word.  A shard has its first words, their successors as one monotone sequence (rank of the first word times
the vocabulary plus word, so a successor is searched relative to its context, without pointers), and the same again from pairs to third
words.  A pair has one byte for its quantised log P(w | v) and one for the
quantised weight MU3 / (n + MU3) of the level below, a triple one for its quantised log n / MU3: their product with the weight is what the
triple adds to the weighed level below.  So no shard needs another's statistics.  Triples of pairs that
may be frequent (both words are) are spread over all shards by the third word too, so no pair makes a shard hot.

Every n-gram of the training texts is kept, no cut-off.  Texts become word ids once, in a written table.  N-grams are added up before
they travel to their shard, where levels are written once to the shared folder; then every scoring task maps them,
and looks up a batch's distinct n-grams shard by shard, in order.  A text is scored in one place and gives one row.
"""

from __future__ import annotations

import itertools
import mmap
import os
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .common import Files, materialize, slices

#: Strength of the priors of pairs and of triples, in counts.
MU2, MU3 = 200.0, 5.0

#: Training tokens of a shard on average, tokens that are counted or scored at once, and words of a vocabulary part.
SHARD_TOKENS, STEP_TOKENS, PART_WORDS = 3_000_000, 1_000_000, 1_000_000

#: Vocabularies from here on: two word ids don't fit into one number.
WIDE = 1 << 31

#: The end's spelling; no word has white space.
END = b" end"

_LEVELS: dict[str, "Vocabulary"] = {}


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in lower case (A-Z only)."""
    return text.lower().split()


def quantise(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one byte for ranges of equal width, and the mean of each code's values (multiples of 2**-20)."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(levels)
    low, width = values.min(), max((values.max() - values.min()) / levels, 1e-9)
    codes = np.minimum((values - low) / width, levels - 1).astype(np.int64)
    number = np.maximum(np.bincount(codes, minlength=levels), 1)
    book = np.bincount(codes, weights=values, minlength=levels) / number
    return codes.astype(np.uint8), np.round(book * 2**20) / 2**20


class Vocabulary:
    """Level one, mapped from its part files."""

    def __init__(self, files: list[str], stats: dict):
        self.stats = stats
        self.bits = stats["part_bits"]
        self.parts, self.base = [], [0]
        for path in files:
            if not os.path.exists(path):  # a part without words
                self.base.append(self.base[-1])
                continue
            data = elias_fano.mapped(path)
            words = elias_fano.Sequence(data)
            at = words.end
            counts = data[at : at + 8 * words.n].view("<i8")
            at += 8 * words.n
            codes = data[at : at + words.n]
            at += words.n + (-words.n % 8)
            book = data[at : at + 256 * 8].view("<f8")
            self.parts.append((len(self.base) - 1, words, counts, codes, book))
            self.base.append(self.base[-1] + words.n)
        self.size = self.base[-1]  # the start's id
        self.none = self.size + 1
        self.unknown = round(np.log10(stats["unknown"]) * 2**20) / 2**20

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by hash; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        order, at = dealt((hashes >> np.uint64(64 - self.bits)).astype(np.int64), 1 << self.bits)
        for p, words, *_ in self.parts:
            which = order[at[p] : at[p + 1]]
            found = words.find(hashes[which] & np.uint64((1 << (64 - self.bits)) - 1))
            out[which] = np.where(found >= 0, found + self.base[p], -1)
        return out

    def look(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and log10 probabilities by id; 0 and the unknown word's for -1; the start (id ``size``) counts the texts."""
        count, log = np.zeros(len(ids), np.int64), np.full(len(ids), self.unknown)
        order, at = dealt(np.searchsorted(self.base, ids, "right"), len(self.base) + 1)
        for p, _, counts, codes, book in self.parts:
            which = order[at[p + 1] : at[p + 2]]
            own = ids[which] - self.base[p]
            count[which] = counts[own]
            log[which] = book[codes[own]]
        count[ids == self.size] = self.stats["texts"]
        return count, log


def vocabulary(files: Files, stats: dict) -> Vocabulary:
    if files.path not in _LEVELS:
        _LEVELS.clear()
        _LEVELS[files.path] = Vocabulary([files.local(f"words-{p}") for p in range(1 << stats["part_bits"])], stats)
    return _LEVELS[files.path]


def changes(a: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it; the first does."""
    out = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=out[1:])
    return out


def numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's number among them."""
    order = np.argsort(a)
    a = a[order]
    new = changes(a)
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return a[new], back


def ordered(u: np.ndarray, v: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
    """Order of rows by u, v, w, all from 0 on and less than ``width``.  Single numbers sort several times as fast as rows."""
    if width >= WIDE:
        return np.lexsort((w, v, u))
    pair = u.astype(np.int64) * width + v.astype(np.int64)
    if width < 1 << 21:
        return np.argsort(pair * width + w.astype(np.int64))
    pair = numbered(pair)[1]
    pair *= width
    pair += w.astype(np.int64)
    return np.argsort(pair)


def dealt(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by their part (from 0, less than ``n``), and where each part begins; the number of rows follows."""
    order = np.argsort(part.astype(np.min_scalar_type(n)), kind="stable")  # small numbers are sorted digit by digit
    return order, np.concatenate(([0], np.cumsum(np.bincount(part, minlength=n))))


def grouped(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by u, v, w: where first words, pairs and triples begin."""
    if not len(u):
        return (np.zeros(0, np.int64),) * 3
    one = changes(u)
    two = one | changes(v)
    three = two | changes(w)
    return np.flatnonzero(one), np.flatnonzero(two), np.flatnonzero(three)


class Level:
    """Two levels of a trie: first words to second words, pairs to third words.

    ``width`` is greater than every word id; a third word of ``width`` stands for a pair without a third word."""

    @staticmethod
    def encode(u: np.ndarray, v: np.ndarray, w: np.ndarray, width: int) -> list[bytes]:
        """From distinct rows, sorted by u, v, w."""
        one, two, _ = grouped(u, v, w)
        rank1 = np.searchsorted(one, two, "right") - 1  # of the pairs
        rank2 = np.repeat(np.arange(len(two)), np.diff(np.append(two, len(u))))
        real = w < width
        return [
            elias_fano.encode(u[one], width),
            elias_fano.encode(rank1 * width + v[two], max(1, len(one)) * width),
            elias_fano.encode(rank2[real] * width + w[real], max(1, len(two)) * width),
        ]

    def __init__(self, data: np.ndarray, at: int, width: int):
        self.width = width
        self.first = elias_fano.Sequence(data, at)
        self.second = elias_fano.Sequence(data, self.first.end)
        self.third = elias_fano.Sequence(data, self.second.end)
        self.end = self.third.end

    def _successors(self, words: elias_fano.Sequence, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of words among the successors of their parents; -1 if a word isn't one or the parent is -1."""
        out = np.full(len(word), -1, np.int64)
        some = np.flatnonzero(parent >= 0)
        out[some] = words.find(parent[some] * self.width + word[some])
        return out

    def pairs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Places of pairs in level two, or -1."""
        new = changes(u)  # mostly in order
        return self._successors(self.second, self.first.find(u[new])[np.cumsum(new) - 1], v)

    def triples(self, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Places in level three of the words after pairs (given by place), or -1."""
        return self._successors(self.third, pair, w)


class Trie:
    """Levels two and three of a shard: its own pairs, and its part of the triples of frequent pairs."""

    @staticmethod
    def build(u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray, vocab: "Vocabulary", hot: int) -> list[bytes]:
        """Parts of the file, from distinct rows sorted by u, v, w; w is ``vocab.none`` in rows that count a pair alone."""
        n_first, _ = vocab.look(u)
        n_second, _ = vocab.look(v)
        spread = (np.minimum(n_first, n_second) > hot) & (w != vocab.none)
        own = ~spread
        a, b, c, n = u[own], v[own], w[own], count[own]
        _, two, _ = grouped(a, b, c)
        pair = np.add.reduceat(n, two) if len(two) else np.zeros(0, np.int64)
        _, log_word = vocab.look(b[two])
        code2, book2 = quantise(np.log10((pair + MU2 * 10**log_word) / (n_first[own][two] + MU2)))
        weight, weights = quantise(np.log10(MU3 / (pair + MU3)))
        code3, book3 = quantise(np.log10(n[c != vocab.none] / MU3))
        code4, book4 = quantise(np.log10(count[spread] / MU3))
        return [
            *Level.encode(a, b, c, vocab.none),
            *Level.encode(u[spread], v[spread], w[spread], vocab.none),
            *(x.tobytes() for x in (code2, weight, code3, code4)),
            *(x.astype("<f8").tobytes() for x in (book2, weights, book3, book4)),
        ]

    def __init__(self, path: str, none: int):
        self.data = elias_fano.mapped(path)
        self.own = Level(self.data, 0, none)
        self.spread = Level(self.data, self.own.end, none)
        at, columns = self.spread.end, []
        for n in (self.own.second.n, self.own.second.n, self.own.third.n, self.spread.third.n):
            columns.append(self.data[at : at + n])
            at += n + (-n % 8)
        books = [self.data[at + i * 2048 : at + (i + 1) * 2048].view("<f8") for i in range(4)]
        self.log2, self.weight, self.log3, self.log4 = ((c, b) for c, b in zip(columns, books))

    @staticmethod
    def _decoded(column: tuple[np.ndarray, np.ndarray], at: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(at), missing)
        some = at >= 0
        out[some] = column[1][column[0][at[some]]]
        return out

    def pairs(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs (or -1), log10 P(v | u) (or not a number), and the log10 weight of the level below after the pair."""
        at = self.own.pairs(u, v)
        return at, self._decoded(self.log2, at, np.nan), self._decoded(self.weight, at, 0.0)

    def triples(self, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 of the count over ``MU3`` of triples of pairs given by place; minus infinity for unknown triples."""
        return self._decoded(self.log3, self.own.triples(pair, w), -np.inf)

    def spread_triples(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The same of pairs that may be frequent."""
        return self._decoded(self.log4, self.spread.triples(self.spread.pairs(u, v), w), -np.inf)

    def close(self) -> None:
        """The process lets go of the pages it has read; they stay in the system's cache."""
        self.data.base._mmap.madvise(mmap.MADV_DONTNEED)


class Shards:
    """Which shard has which n-grams."""

    def __init__(self, total: int):
        self.n = max(8, -(-total // SHARD_TOKENS))
        self.hot = max(1, total // (4 * self.n))  # words beyond are frequent

    def pair(self, u: np.ndarray, v: np.ndarray, n_u: np.ndarray) -> np.ndarray:
        x = _mixed(u)
        often = n_u > self.hot
        x[often] ^= _mixed(v[often] + 1)
        return (x % np.uint64(self.n)).astype(np.int64)

    def triple(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard, and whether the pair may be frequent."""
        out, spread = self.pair(u, v, n_u), np.minimum(n_u, n_v) > self.hot
        out[spread] = (_mixed(u[spread] ^ (_mixed(v[spread]) + _mixed(_mixed(w[spread]))).view(np.int64)) % np.uint64(self.n)).astype(np.int64)
        return out, spread


def _mixed(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


def _vocabulary_files(rows: DataFrame, name: str, mapped: bool | None) -> tuple[Files, dict]:
    """Count the training words of ``rows(text, held_out)`` and write level one."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(list(found.values()), pa.int64())], names=["h", "n"])

        for part in slices(batches, 0):
            for text in part.column(0).to_pylist():
                found.update(tokens(text))
            found[END] += part.num_rows
            if len(found) > 400_000:
                yield out()
                found.clear()
        yield out()

    texts = rows.where("not held_out").select("text")
    words = materialize(texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")).first()
    end = xxhash.xxh64_intdigest(END)
    texts_n = words.where(F.col("h") == F.lit(end - (1 << 64) if end >> 63 else end)).agg(F.sum("n")).first()[0] or 0
    n, v = total.n or 0, total.v
    bits = max(1, (v // PART_WORDS).bit_length())
    unknown = ((total.once or 0) + 0.5) / (n + 1.0)
    stats = {"train_tokens": n, "types": v, "texts": texts_n, "unknown": unknown, "part_bits": bits}
    files = Files(spark, f"{name}-words", mapped)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, n_each in _whole(batches):
            for p in np.unique(part).tolist():
                h = hashes[part == p].view(np.uint64) & np.uint64((1 << (64 - bits)) - 1)
                order = np.argsort(h)
                h, own = h[order], n_each[part == p][order]
                codes, book = quantise(np.log10((1 - unknown) * own / n))
                blob = files.put(f"words-{p}", [elias_fano.encode(h, 1 << (64 - bits)), own.astype("<i8").tobytes(), codes.tobytes(), book.astype("<f8").tobytes()])
                yield pa.record_batch([pa.array([f"words-{p}"]), pa.array([blob], pa.binary())], names=["name", "blob"])

    # h >>> (64 - bits) numbers the parts; hashes are spread evenly over them
    part = F.shiftrightunsigned("h", 64 - bits).cast("int")
    files.publish(words.withColumn("part", part).select("part", "h", "n").repartition(1 << bits, "part").mapInArrow(build, "name string, blob binary"))
    return files, stats


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """All of a partition's batches as one; a partition has a bounded part of the vocabulary."""
    columns: list[list[np.ndarray]] = []
    for b in batches:
        columns.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
    if columns:
        yield [np.concatenate(c) for c in zip(*columns)]


def _planes(x: np.ndarray) -> bytes:
    """An array of integers by byte planes, which pack better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


def _steps(word: np.ndarray, begin: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each word and the two before it, ``STEP_TOKENS`` at once, for texts one after another that begin at ``begin``."""
    before = np.concatenate(([start], word[:-1]))
    before[begin] = start
    first = np.concatenate(([start], before[:-1]))
    first[begin] = start
    for at in range(0, len(word), STEP_TOKENS):
        yield first[at : at + STEP_TOKENS], before[at : at + STEP_TOKENS], word[at : at + STEP_TOKENS]


def _ids(blobs: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Word ids (-1 for unknown ones) of texts one after another, and where each text begins (none is empty)."""
    size = np.array([len(b) // np.dtype(kind).itemsize for b in blobs], np.int64)
    raw = np.frombuffer(b"".join(blobs), kind)
    return np.where(raw == np.iinfo(kind).max, -1, raw.astype(np.int64)), np.cumsum(size) - size


def _counted(u: np.ndarray, v: np.ndarray, w: np.ndarray, vocab: Vocabulary, shards: Shards, kind: str, end: int) -> Iterator[tuple[int, bytes]]:
    """Packed n-gram counts of some words and their contexts, by shard."""
    last = np.flatnonzero(w == end)  # the pair that ends a text has no third word
    u, v, w = np.concatenate((u, v[last])), np.concatenate((v, w[last])), np.concatenate((w, np.full(len(last), vocab.none)))
    order = ordered(u, v, w, vocab.none + 1)
    u, v, w = u[order], v[order], w[order]
    _, _, at = grouped(u, v, w)
    n = np.diff(np.append(at, len(u)))
    u, v, w = u[at], v[at], w[at]
    n_u, n_v = vocab.look(u)[0], vocab.look(v)[0]
    shard, spread = shards.triple(u, v, w, n_u, n_v)
    alone = w == vocab.none
    shard[alone] = shards.pair(u[alone], v[alone], n_u[alone])
    spread &= ~alone
    # pairs that may be frequent are counted in their own shard too
    a, b = u[spread], v[spread]
    _, at, _ = grouped(a, b, b)
    if len(at):
        shard = np.concatenate((shard, shards.pair(a[at], b[at], n_u[spread][at])))
        u, v = np.concatenate((u, a[at])), np.concatenate((v, b[at]))
        w, n = np.concatenate((w, np.full(len(at), vocab.none))), np.concatenate((n, np.add.reduceat(n[spread], at)))
    order, ends = dealt(shard, shards.n)
    packer = zstandard.ZstdCompressor(level=1)
    for s, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if i < j:
            own = order[i:j]
            yield s, struct.pack("<I", j - i) + packer.compress(b"".join(_planes(x[own].astype(kind)) for x in (u, v, w)) + _planes(n[own].astype("<u4")))


def _merged(blobs: list[bytes], kind: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a shard, sorted, and their counts; ``width`` is greater than every word id."""
    unpack, size, columns = zstandard.ZstdDecompressor(), np.dtype(kind).itemsize, []
    for x in blobs:
        (n,), raw = struct.unpack_from("<I", x), unpack.decompress(x[4:])
        cut = [raw[i * size * n : (i + 1) * size * n] for i in range(3)]
        columns.append([_from_planes(c, n, kind) for c in cut] + [_from_planes(raw[3 * size * n :], n, "<u4")])
    u, v, w, n = (np.concatenate(c) for c in zip(*columns))
    del columns
    order = ordered(u, v, w, width)
    u, v, w, n = u[order], v[order], w[order], n[order]
    _, _, at = grouped(u, v, w)
    return u[at].astype(np.int64), v[at].astype(np.int64), w[at].astype(np.int64), np.add.reduceat(n.astype(np.int64), at)


def _logs(first: np.ndarray, before: np.ndarray, word: np.ndarray, vocab: Vocabulary, shards: Shards, files: Files) -> np.ndarray:
    """log10 P of each word after the two before it, in multiples of 2**-20."""
    # pairs, numbered in order: each word with the one before it, and before a text's first word or where a step begins, the two before
    width, number = vocab.none + 1, None
    if width >= WIDE:  # the step's words are numbered first
        number, back = numbered(np.concatenate((first, before, word)))
        first, before, word = np.split(back, 3)
        width = len(number) + 1
    key, last = (before + 1) * width + word + 1, (first + 1) * width + before + 1
    own = np.flatnonzero(np.concatenate(([True], last[1:] != key[:-1]))) if len(word) else np.zeros(0, np.int64)
    key, back = numbered(np.concatenate((key, last[own])))
    below = back[: len(word)]
    context = np.concatenate(([0], below[:-1])) if len(word) else below
    context[own] = back[len(word) :]
    a, b = key // width - 1, key % width - 1
    if number is not None:
        a, b = number[a], number[b]
    # triples: a pair and the one that goes on from it
    triple, back = numbered(context * len(key) + below)
    context, below = triple // max(1, len(key)), triple % max(1, len(key))
    u, v, w = a[context], a[below], b[below]
    place, log2, weight, log3 = np.full(len(a), -1, np.int64), np.full(len(a), np.nan), np.zeros(len(a)), np.full(len(u), -np.inf)
    n_a = vocab.look(a)[0]
    n_u, n_v = n_a[context], n_a[below]
    pair_shard, (triple_shard, spread) = shards.pair(a, b, n_a), shards.triple(u, v, w, n_u, n_v)
    pair_shard[(a < 0) | (b < 0)] = shards.n
    triple_shard[(u < 0) | (v < 0) | (w < 0)] = shards.n
    (pair_by, pair_end), (triple_by, triple_end) = dealt(pair_shard, shards.n + 1), dealt(triple_shard, shards.n + 1)
    for s in range(shards.n):
        pairs, triples = pair_by[pair_end[s] : pair_end[s + 1]], triple_by[triple_end[s] : triple_end[s + 1]]
        path = files.local(f"grams-{s}")
        if not len(pairs) + len(triples) or not os.path.exists(path):
            continue
        trie = Trie(path, vocab.none)
        place[pairs], log2[pairs], weight[pairs] = trie.pairs(a[pairs], b[pairs])
        own, other = triples[~spread[triples]], triples[spread[triples]]
        log3[own] = trie.triples(place[context[own]], w[own])
        if len(other):
            log3[other] = trie.spread_triples(u[other], v[other], w[other])
        trie.close()
    missing = np.flatnonzero(np.isnan(log2))
    log2[missing] = vocab.look(b[missing])[1] + np.log10(MU2 / (n_a[missing] + MU2))
    return np.round((weight[context] + np.log10(10**log3 + 10 ** log2[below])) * 2**20)[back] / 2**20


def score(docs: DataFrame, held_out, name: str = "ngram-lm", mapped: bool | None = None) -> DataFrame:
    """Train on the rows of ``docs`` where ``held_out`` (a Column, not null) is false; score all whole texts.

    Returns per row: ``doc_id, held_out, n_tokens, n_known`` (tokens seen in training), ``train_tokens,
    base_score`` (add-one unigram) and ``score`` (the model), both log10.  A null text is an empty text: one
    end.  Null ids and repeated rows are rows like others; without training rows every token is unknown; an
    empty table gives an empty result.  The trie's files stay in the shared folder under ``name``; ``mapped`` false
    treats that folder as one that can't be mapped.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), held_out.alias("held_out"))
    words, stats = _vocabulary_files(rows, name, mapped)
    total, types = stats["train_tokens"], stats["types"]
    shards, grams = Shards(total), Files(spark, f"{name}-grams", mapped)
    kind = "<u4" if types < 2**32 - 3 else "<u8"
    width = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(words, stats)
        for part in slices(batches, 1, 4 << 20):
            split = [tokens(t) for t in part.column(1).to_pylist()]
            for own in split:
                own.append(END)
            size = np.fromiter(map(len, split), np.int64, len(split))
            local: dict[bytes, int] = {}  # a word's first place
            flat = np.fromiter(map(local.setdefault, itertools.chain.from_iterable(split), itertools.count()), np.int64, int(size.sum()))
            place = np.fromiter(local.values(), np.int64, len(local))
            ids = vocab.ids(np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local)))
            n, _ = vocab.look(ids)
            at = np.empty(len(flat), np.int64)
            at[place] = np.arange(len(place))
            flat, of = at[flat], np.repeat(np.arange(len(split)), size)
            base = np.bincount(of, weights=np.log10((n + 1) / (total + 1 * (types + 1)))[flat], minlength=len(split))
            known = np.bincount(of, weights=(n > 0).astype(np.float64)[flat], minlength=len(split)).astype(np.int64)
            raw = np.where(ids < 0, np.iinfo(kind).max, ids).astype(kind)[flat].tobytes()
            end = (np.cumsum(size) * width).tolist()
            blobs = [raw[a:b] for a, b in zip([0, *end[:-1]], end)]
            yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(2), pa.array(size), pa.array(known), pa.array(base), pa.array(blobs, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"
    coded = materialize(rows.mapInArrow(encode, f"{schema}, ids binary"), "word-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(words, stats)
        end = int(vocab.ids(np.array([xxhash.xxh64_intdigest(END)], np.uint64))[0])

        def out(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            for step in _steps(*_ids(held, kind), vocab.size):
                found = list(_counted(*step, vocab, shards, kind, end))
                yield pa.record_batch([pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["shard", "blob"])

        held, size = [], 0
        for part in slices(batches, 0):
            for one in part.column(0).to_pylist():
                held.append(one)
                size += len(one)
                if size >= STEP_TOKENS * width:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(words, stats)
        found: dict[int, list[bytes]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(s, []).append(x)
        for s in sorted(found):
            blob = grams.put(f"grams-{s}", Trie.build(*_merged(found.pop(s), kind, vocab.none + 1), vocab, shards.hot))
            yield pa.record_batch([pa.array([f"grams-{s}"]), pa.array([blob], pa.binary())], names=["name", "blob"])

    counted = coded.where("not held_out").select("ids").mapInArrow(count, "shard int, blob binary")
    grams.publish(counted.repartitionById(shards.n, "shard").mapInArrow(build, "name string, blob binary"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(words, stats)
        for part in slices(batches, 5, STEP_TOKENS * width):
            if part.num_rows:
                word, begin = _ids(part.column(5).to_pylist(), kind)
                logs = np.concatenate([_logs(*step, vocab, shards, grams) for step in _steps(word, begin, vocab.size)])
                sums = np.add.reduceat(logs, begin)
                yield pa.record_batch([*part.columns[:5], pa.array(sums)], names=[*part.schema.names[:5], "score"])

    scored = coded.mapInArrow(answer, f"{schema}, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_elias_fano_lm(spark, sf_dir: str) -> DataFrame:
    """The trigram model, learnt from the documents whose crc32 of the id isn't 2 modulo 7, on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return score(docs.select("doc_id", "text"), held)
