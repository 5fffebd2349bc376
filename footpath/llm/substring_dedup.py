"""Substring dedup by seed and extend.

Seeds: every window of ``window`` words picks the least hash among its k-grams (winnowing), so equal
windows pick equal anchors at equal places.  Only anchors that occur more than once can belong to a
repeat; documents are joined on these.

Extension: an anchor's occurrence stands for a run of consecutive windows; all words of the run, to both
sides of the anchor, are its block.  Occurrences with equal blocks repeat each other in full, however many
they are: all but the earliest go.  Where an anchor has different blocks, the match ends inside; the
windows of each different block (once, at its earliest place) are then compared one by one.  So no pairs
are listed, a passage that many documents share costs one row for each anchor, and the result is exact.
Overlapping repeated windows make up the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, slices

#: Words of a seed.
SEED_WORDS = 6

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """Word hashes of a text, and hashes of any of its runs of words."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n = len(words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, self.n)[:-1])))
        self.back = _powers(_INVERSE, self.n)

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start..end-1, whatever their place in the text."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def anchors(words: Words, window: int, seed: int):
    """Anchors as arrays: hash, block hash, first window, windows, and words from there to the anchor."""
    n = words.n - window + 1
    if n < 1:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    at = np.arange(words.n - seed + 1)
    gram = words.run(at, at + seed)
    seen = np.lib.stride_tricks.sliding_window_view(gram, window - seed + 1)
    pick = np.concatenate([seen[i : i + 50_000].argmin(axis=1) for i in range(0, n, 50_000)]) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
    last = np.append(first[1:], n) - 1
    lead = pick[first] - first
    block = mix(words.run(first, last + window) + lead.astype(np.uint64) * np.uint64(_BASE) + (last - first).astype(np.uint64))
    return gram[pick[first]].view(np.int64), block.view(np.int64), first, last - first + 1, lead


def again(*keys: np.ndarray) -> np.ndarray:
    """Marks rows whose keys an earlier row has."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        order = np.lexsort(keys[::-1])  # stable
        new = np.zeros(len(out), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        out[order[new]] = False
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, text``: whole texts as bytes; a row is told by its id and the hash of its text."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))


def _rows(docs: DataFrame) -> DataFrame:
    """Keys and whole texts as compressed bytes, small enough to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, 2):
            yield pa.record_batch([part.column(0), part.column(1), pa.array([packer.compress(t) for t in part.column(2).to_pylist()], pa.binary())], names=["doc_id", "copy", "packed"])

    return docs.mapInArrow(run, "doc_id long, copy long, packed binary")


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def repeated_windows(docs: DataFrame, window: int = 20, seed: int = SEED_WORDS) -> DataFrame:
    """Runs of repeated windows: ``doc_id, copy, start, windows`` (first words start .. start + windows - 1).

    ``docs`` is of ``_keyed``, without null ids."""
    seed = min(seed, window)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 4 << 20):
            h = [anchors(Words(t), window, seed)[0] for t in part.column(2).to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate(h or [np.zeros(0, np.int64)]))], names=["h"])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 4 << 20):
            rows, columns = [], [[], [], [], [], [], []]
            for text in part.column(2).to_pylist():
                h, block, first, number, lead = anchors(Words(text), window, seed)
                rows.append(len(h))
                for out, x in zip(columns, (h, block, first, number, lead, again(h, block))):
                    out.append(x)
            h, block, first, number, lead, dup = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
            of = pa.array(np.repeat(np.arange(len(rows)), rows))
            yield pa.record_batch(
                [pa.array(h), pa.array(block), part.column(0).take(of), part.column(1).take(of), pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(dup.astype(bool))],
                names=["h", "block", "doc_id", "copy", "start", "windows", "lead", "again"],
            )

    texts = docs.select("doc_id", "copy", "text")
    often = texts.mapInArrow(seeds, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    often = materialize(often, "repeated-anchors")  # so that both sides of the join are dealt out for it and hot anchors can be split
    rows = texts.mapInArrow(occurrences, "h long, block long, doc_id long, copy long, start int, windows int, lead int, again boolean")
    shared = materialize(rows.join(often, "h"), "anchors")
    first = materialize(shared.groupBy("h", "block").agg(F.min("doc_id").alias("first")), "blocks")
    several = materialize(first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "several")
    known = shared.join(first, ["h", "block"])
    whole = known.where("again or doc_id > first").select("doc_id", "copy", "start", "windows")
    # windows of different blocks of an anchor, each block at its earliest place
    open_ = known.where("not again and doc_id = first").join(several, "h", "left_semi").select("doc_id", "copy", F.struct("h", "start", "windows", "lead").alias("x")).distinct()
    open_ = materialize(open_.groupBy("doc_id", "copy").agg(F.collect_list("x").alias("xs")), "open")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(iter([b]), 2, 1 << 20):
                rows, out = [], [[], [], [], [], []]
                for packed, xs in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    words = Words(_unpack(packed))
                    xs.sort(key=lambda x: x["start"])
                    number = np.array([x["windows"] for x in xs])
                    inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                    start = np.repeat(np.array([x["start"] for x in xs]), number) + inside
                    lead = np.repeat(np.array([x["lead"] for x in xs]), number) - inside
                    h = np.repeat(np.array([x["h"] for x in xs], np.int64), number)
                    hashes = words.run(start, start + window).view(np.int64)
                    rows.append(len(h))
                    for o, x in zip(out, (h, lead, hashes, start, again(h, lead, hashes))):
                        o.append(x)
                h, lead, hashes, start, dup = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
                of = pa.array(np.repeat(np.arange(len(rows)), rows))
                yield pa.record_batch(
                    [pa.array(h), pa.array(lead.astype(np.int32)), pa.array(hashes), part.column(0).take(of), part.column(1).take(of), pa.array(start.astype(np.int32)), pa.array(dup.astype(bool))],
                    names=["h", "lead", "w", "doc_id", "copy", "start", "again"],
                )

    singles = _rows(texts).join(open_, ["doc_id", "copy"]).mapInArrow(each, "h long, lead int, w long, doc_id long, copy long, start int, again boolean")
    singles = materialize(singles, "windows")
    least = materialize(singles.groupBy("h", "lead", "w").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-windows")
    some = singles.join(least, ["h", "lead", "w"]).where("again or doc_id > first").select("doc_id", "copy", "start", F.lit(1).alias("windows"))
    return whole.unionByName(some)


def covered(n: int, spans: list, window: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    step = np.zeros(n + 1, np.int64)
    for s in spans:
        a, b = min(s["start"], n), min(s["start"] + s["windows"] - 1 + window, n)
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step[:-1]) > 0


def _spans(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """``doc_id, copy, spans`` of the rows of ``_keyed`` that have repeated windows; written."""
    found = repeated_windows(rows.where("doc_id is not null"), window, seed).distinct()
    return materialize(found.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "windows")).alias("spans")), "spans")


def _with_spans(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """doc_id, packed text and its runs of repeated windows (null if there are none)."""
    rows = _keyed(docs)
    return _rows(rows).join(_spans(rows, window, seed), ["doc_id", "copy"], "left").select("doc_id", "packed", "spans")


def repeats(docs: DataFrame, window: int = 20, seed: int = SEED_WORDS) -> DataFrame:
    """Maximal repeats ``doc_id, start, n_words`` (positions in words) of at least ``window`` words whose
    windows all occur earlier; see ``remove_repeats`` for what is earlier and for special cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 2 << 20):
            doc, start, number = [], [], []
            for one, packed, spans in zip(*(part.column(i).to_pylist() for i in range(3))):
                if spans:
                    inside = np.concatenate(([False], covered(len(_unpack(packed).split()), spans, window), [False])).astype(np.int8)
                    a, b = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
                    doc += [one] * len(a)
                    start += a.tolist()
                    number += (b - a).tolist()
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(number, pa.int64())], names=["doc_id", "start", "n_words"])

    return _with_spans(docs, window, seed).mapInArrow(run, "doc_id long, start long, n_words long")


def remove_repeats(docs: DataFrame, window: int = 20, seed: int = SEED_WORDS, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed`` and the ``text`` without words that a
    repeated window covers (with ``digest``: ``kept_sha256`` of the kept words joined by one space).

    A window is repeated if its words also start earlier: in a smaller ``doc_id``, or before in the
    same document.  Windows are judged on the input.  A text that loses nothing stays as it is, else
    the kept words are joined by one space.  Null texts count as empty; rows with a null id lose
    nothing and are no source of repeats; rows that share an id are documents of their own, of which none is earlier; texts under
    ``window`` words lose nothing; an empty table gives an empty result.
    """
    last = "kept_sha256" if digest else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 2 << 20):
            n, removed, out = [], [], []
            for packed, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                text = _unpack(packed)
                words = text.split()
                gone = covered(len(words), spans, window) if spans else np.zeros(len(words), bool)
                n.append(len(words))
                removed.append(int(gone.sum()))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if removed[-1] else b" ".join(words) if digest else text
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", last])

    return _with_spans(docs, window, seed).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")


def without_repeats(docs: DataFrame, window: int = 20, seed: int = SEED_WORDS) -> DataFrame:
    """``docs`` with the texts that ``remove_repeats`` leaves; other columns go along.

    Null texts stay null; other special rows as there.
    """
    names = docs.columns
    one, copy, other, spans = fresh(names, "span_doc", "copy", "other_copy", "spans")
    found = _spans(_keyed(docs), window, seed).select(F.col("doc_id").alias(one), F.col("copy").alias(other), F.col("spans").alias(spans))

    @F.arrow_udf("string")
    def kept(text: pa.Array, found: pa.Array) -> pa.Array:
        out = text.to_pylist()
        for i, own in enumerate(found.to_pylist()):
            if own and out[i]:
                words = out[i].encode().split()
                gone = covered(len(words), own, window).tolist()
                out[i] = b" ".join([w for w, g in zip(words, gone) if not g]).decode()
        return pa.array(out, pa.string())

    rows = docs.withColumn(copy, F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")))
    joined = rows.join(found, (F.col("doc_id").cast("long") == F.col(one)) & (F.col(copy) == F.col(other)), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(kept("text", spans))
    return joined.select(*(text.alias("text") if n == "text" else F.col(n) for n in names))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document, those removed and a digest of the rest; see ``remove_repeats`` for special cases."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20, digest=True)
