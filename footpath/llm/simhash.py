"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is split into blocks.  Two fingerprints that differ in at most ``max_bits`` bits
leave ``blocks - max_bits`` blocks alike, so they share the key of at least one choice of that many
blocks.  Keys are joined, and the Hamming distance is verified inside each key's bucket.  A bucket gives
a spanning forest of its links, never all pairs; buckets over ``BUCKET`` distinct fingerprints, which no
task should compare pair by pair, are linked through all points near a fingerprint instead,
which is exact as well and grows with the bucket's size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Files, connected_components, materialize, slices

#: Distinct fingerprints of a bucket that one task compares with each other.
BUCKET = 4096
SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every word shingle of a text in lower case (A-Z)."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    take = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    spans = zip(start[: len(found) - take + 1].tolist(), end[take - 1 :].tolist())
    return np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> bytes:
    """Eight bytes, highest bit first: the bits that are set in over half the hashes."""
    h = hashes.astype(">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 25_500):
        bits = np.unpackbits(h[at : at + 25_500].view(np.uint8)).reshape(-1, 64)
        cut = len(bits) // 255 * 255  # sums of 255 rows fit into a byte
        ones += bits[:cut].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[cut:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of a text over its word shingles; 0 for a text without words."""
    return int.from_bytes(majority(shingle_hashes(text, words)), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``fp`` (64 bits as long) of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            fp = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp long")


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - max_bits`` blocks of 64 bits."""
    cut = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(block, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(v: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what is joined by distances up to ``max_bits`` among distinct values."""
    links: list[tuple[int, int]] = []
    while len(v) > 1:
        queue, v = [v[0]], v[1:]
        while queue and len(v):
            x = queue.pop()
            near = np.bitwise_count(v ^ x) <= max_bits
            if near.any():
                found, v = v[near], v[~near]
                links += [(int(x), int(y)) for y in found]
                queue.extend(found)
    return links


def bucket_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links inside the buckets of rows that are sorted by key."""
    if not len(key):
        return []
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    two = start[size == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
    links = list(zip(fp[two].tolist(), fp[two + 1].tolist()))
    for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        links += forest(fp[a : a + n], max_bits)
    return links


def fingerprint_links(distinct: DataFrame, max_bits: int = 3, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of ``distinct.fp`` up to ``max_bits`` bits apart."""
    spark = distinct.sparkSession
    masks = block_masks(max_bits, blocks)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key")) for t, m in enumerate(masks)))
    rows = distinct.select("fp", F.inline(keys))
    # written, so that both sides of the join are dealt out for it and hot buckets can be split
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    rows = materialize(rows.join(shared, "key"), "buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            key = np.concatenate((key, b.column(0).to_numpy()))
            fp = np.concatenate((fp, b.column(1).to_numpy().view(np.uint64)))  # of signed numbers numpy counts the absolute value's bits
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            yield _batch(bucket_links(key[:cut], fp[:cut], max_bits))
            key, fp = key[cut:], fp[cut:]
        yield _batch(bucket_links(key, fp, max_bits))

    small = rows.where(F.col("n") <= bucket).select("key", "fp").repartition("key").sortWithinPartitions("key")
    links = small.mapInArrow(run, "a long, b long")
    # Of two values at most max_bits apart, some point is at most half of that (rounded down) from one and
    # the rest from the other.  All values near a point that is that near to one of them are joined.
    inner = max_bits // 2
    outer = max_bits - inner
    flips = [(t, _signed(sum(1 << i for i in c)), d) for t, m in enumerate(masks) for d in range(outer + 1) for c in combinations([i for i in range(64) if not m >> i & 1], d)]
    around = spark.createDataFrame(flips, "t int, flip long, d int")  # fixed by max_bits and blocks
    points = rows.where(F.col("n") > bucket).join(F.broadcast(around), "t").select("key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "d")
    centre = points.where(F.col("d") <= inner).groupBy("key", "point").agg(F.min("fp").alias("centre"))
    far = points.join(centre, ["key", "point"]).where("fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()
    return links.unionByName(far)


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 5, max_bits: int = 3, blocks: int = 6, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``fp`` and ``component_id``, the smallest id of the documents that links reach.

    Copies share a fingerprint and so a class without any pair.  Null and empty texts have
    fingerprint 0 and are linked like others; rows with a null id belong to a component but don't name
    it (it is null if all its ids are); repeated rows give repeated rows; an empty table gives an
    empty result.
    """
    rows = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    joined = connected_components(fingerprint_links(classes.select("fp"), max_bits, blocks, bucket), "fp-components")
    classes = materialize(classes.join(joined, classes.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c")), "classes")
    least = materialize(classes.groupBy("c").agg(F.min("first").alias("component_id")), "components")
    named = classes.join(least, "c").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


#: Words of 64 bits of a wide fingerprint, and its bits that may differ: 90 of 512 for a similarity of 0.8.
#: Fingerprints of sets with Jaccard similarity j differ in acos(2j / (1 + j)) / pi of the bits: 77 +- 8 for 0.8, 118 +- 9
#: for 0.6.
WIDE, WIDE_BITS = 8, 90

#: Share of alike bits at similarity 0.8, and share of pairs (at a given share of alike bits) that may be missed.
ALIKE, MISSED = 0.849, 0.02

#: Number of rows that the keys are made for.  Fixed, so that it doesn't depend on the other rows whether a pair is found; with more
#: rows more of them share a key by chance, which costs time but no pair.
KEY_ROWS = 2**20 - 1

#: Bits of a key's sketch, and how many of them may differ where two nodes alone share a key.
SKETCH, SKETCH_BITS = 29, 12


def wide_fingerprint(text: bytes, words: int = 5) -> bytes:
    """A fingerprint of ``WIDE`` times 64 bits over the same shingles; zeros for a text without words."""
    h = shingle_hashes(text, words)
    out = []
    for j in range(WIDE):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(x ^ (x >> np.uint64(29))))
    return b"".join(out)


def wide_choices(n: int, alike: float = ALIKE) -> list[np.ndarray]:
    """Choices of bits whose joint value is a key: several more bits than it takes to tell n fingerprints apart, so that
    few others share it, and as many choices as keep the share of missed pairs, at a share ``alike`` of alike bits, under ``MISSED``."""
    size = max(24, n.bit_length() + 4)
    bits = 64 * WIDE
    shared = np.prod((alike * bits - np.arange(size)) / (bits - np.arange(size)))  # all of a choice's bits are alike
    number = int(np.ceil(np.log(MISSED) / np.log(1 - shared)))
    rng = np.random.default_rng(SEED)
    return [rng.choice(bits, size, replace=False) for _ in range(number)]


def shared_keys(classes: DataFrame, max_bits: int = WIDE_BITS) -> DataFrame:
    """Rows ``key, node, leader, many`` of the nodes of ``classes(node, wide)`` whose key another node has as well: ``leader`` is the key's
    least node, ``many`` tells keys of three nodes or more.

    A key's 64 bits hold the chosen bits, the number of the choice, and ``SKETCH`` other bits of the fingerprint, which take no part in
    grouping: where only two nodes meet and their sketches differ in more than ``SKETCH_BITS``, they met by chance.  That may lose
    a pair at the bound with a probability of less than 0.001.  Written; of a key's rows at most two are held, as they come sorted."""
    choices = wide_choices(KEY_ROWS, 1 - max_bits / (64 * WIDE))
    rng = np.random.default_rng(SEED)
    sketches = [rng.choice(np.setdiff1d(np.arange(64 * WIDE), c), SKETCH, replace=False) for c in choices]
    low = np.uint64(SKETCH)

    def number(bits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return (bits[:, chosen] * np.left_shift(np.uint64(1), np.arange(len(chosen), dtype=np.uint64))).sum(axis=1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                node = part.column(0).to_numpy()
                bits = np.unpackbits(_words(part.column(1)).astype(">u8").view(np.uint8).reshape(len(node), -1), axis=1)
                found = [((number(bits, c) * np.uint64(2048) + np.uint64(t)) << low) + number(bits, s) for t, (c, s) in enumerate(zip(choices, sketches))]
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.tile(node, len(choices)))], names=["key", "node"])

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count((a ^ b) & np.uint64((1 << SKETCH) - 1)) <= SKETCH_BITS

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in columns], names=["key", "node", "leader", "many"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # a key of one or two rows that may go on
        going = (None, 0, 0)  # a key of more: its leader and rows so far
        for b in batches:
            full = np.concatenate((wait[0], b.column(0).to_numpy().view(np.uint64)))
            node = np.concatenate((wait[1], b.column(1).to_numpy()))
            if not len(node):
                continue
            key = full >> low
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            leader, total = node[start], size.copy()
            if key[0] == going[0]:
                leader[0], total[0] = going[1], size[0] + going[2]
            keep = total > 2
            two = np.flatnonzero(total == 2)
            keep[two] = alike(full[start[two]], full[start[two] + 1])
            cut = len(key)
            wait = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            going = (int(key[-1]), int(leader[-1]), int(total[-1]))
            if total[-1] <= 2:
                cut = int(start[-1])
                wait, going = (full[cut:], node[cut:]), (None, 0, 0)
            take = np.repeat(keep, size)[:cut]
            yield batch(*(x[:cut][take] for x in (key.view(np.int64), node, np.repeat(leader, size), np.repeat(total > 2, size))))
        if len(wait[1]) == 2 and alike(wait[0][:1], wait[0][1:])[0]:
            yield batch((wait[0] >> low).view(np.int64), wait[1], np.repeat(wait[1][:1], 2), np.zeros(2, bool))

    rows, group = classes.select("node", "wide").mapInArrow(keys, "key long, node long"), F.shiftrightunsigned("key", SKETCH)
    return materialize(rows.repartition(group).sortWithinPartitions(group, "node").mapInArrow(shared, "key long, node long, leader long, many boolean"), "wide-keys")


def _words(column: pa.Array) -> np.ndarray:
    """Wide fingerprints of an Arrow list column, one row of ``WIDE`` unsigned words each."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE)


#: Files of a ``Lookup``; a prime, so that ids that are multiples of some number are spread as well.
LOOKUP_PARTS = 61


@lru_cache(2 * LOOKUP_PARTS)
def _part(path: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.memmap(path, "<i8", "r")
    n = len(numbers) // (1 + width)
    return numbers[:n], numbers[n:].reshape(n, width)


class Lookup:
    """``width`` longs of each node of ``rows(node, longs)``, in files that tasks map: who asks for many pairs of nodes needs no row of each pair."""

    def __init__(self, rows: DataFrame, name: str, width: int):
        self.files, self.width = Files(rows.sparkSession, name), width
        files = self.files

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(-1, width)) for b in batches]
            part, node, longs = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                own = own[np.argsort(node[own])]
                blob = files.put(str(p), [node[own].astype("<i8").tobytes(), longs[own].astype("<i8").tobytes()])
                yield pa.record_batch([pa.array([str(p)]), pa.array([blob], pa.binary())], names=["name", "blob"])

        part = F.pmod("node", F.lit(LOOKUP_PARTS)).cast("long").alias("part")
        files.publish(rows.select(part, "node", "longs").repartition(LOOKUP_PARTS, "part").mapInArrow(build, "name string, blob binary"))

    def of(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each node is known, and its longs (0 if it isn't)."""
        known, out = np.zeros(len(node), bool), np.zeros((len(node), self.width), np.int64)
        part = node % LOOKUP_PARTS
        for p in np.unique(part).tolist():
            path, some = self.files.local(str(p)), np.flatnonzero(part == p)
            if os.path.exists(path):
                nodes, longs = _part(path, self.width)
                at = np.minimum(np.searchsorted(nodes, node[some]), len(nodes) - 1)
                hit = nodes[at] == node[some]
                known[some[hit]], out[some[hit]] = True, longs[at[hit]]
        return known, out


def leader_links(classes: DataFrame, keys: DataFrame, max_bits: int = WIDE_BITS) -> DataFrame:
    """Links ``a, b`` between nodes and the leaders of their keys that are within the bound; written.

    A node of a large group has nearly as many leaders as keys, so fingerprints are looked up where the pairs are,
    and a task gives only links that join what its links so far don't."""
    wide = Lookup(classes.select("node", F.col("wide").alias("longs")), "wide-nodes", WIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for b in batches:
            node, leader = (b.column(i).to_numpy() for i in range(2))
            near = np.bitwise_count((wide.of(node)[1] ^ wide.of(leader)[1]).view(np.uint64)).sum(axis=1) <= max_bits
            links = []
            for x, y in zip(node[near].tolist(), leader[near].tolist()):
                p, q = _top(root, x), _top(root, y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((x, y))
            yield _signed_batch(links)

    asked = keys.where("node <> leader").select("node", "leader").distinct()
    return materialize(asked.mapInArrow(run, "a long, b long"), "leader-links")


def mixed_keys(keys: DataFrame, found: DataFrame) -> DataFrame:
    """Keys of three nodes or more of which some aren't in the component of ``found(node, component)`` that the leader is in."""
    components = Lookup(found.select("node", F.array("component").alias("longs")), "node-components", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for i in (1, 2):
                own = b.column(i).to_numpy()
                known, c = components.of(own)
                sides.append(np.where(known, c[:, 0], own))
            yield pa.record_batch([pa.array(np.unique(b.column(0).to_numpy()[sides[0] != sides[1]]))], names=["key"])

    return keys.where("many and node <> leader").select("key", "node", "leader").mapInArrow(run, "key long").distinct()


def cross_links(classes: DataFrame, keys: DataFrame, found: DataFrame, max_bits: int = WIDE_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` between components of ``found(node, component)`` that share a key: what the leaders alone don't link.

    Distances aren't transitive, so no row can stand for another.  But rows of one component needn't be compared; so only keys of
    three nodes or more are looked at in which some node isn't in its leader's component, and there the rows outside the key's largest
    component are compared with all rows of the key.  Both are dealt out by hash in parts of about
    ``bucket`` rows, and every part of the former meets every part of the latter in a task's group.  A group gives links that
    join components, at most one a row.
    """
    mixed = materialize(mixed_keys(keys, found), "mixed-keys")
    rows = materialize(keys.join(mixed, "key").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "key-components")
    sizes = rows.groupBy("key", "c").agg(F.count("*").alias("n"))
    plan = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"))
    plan = materialize(plan.select("key", "largest", F.ceil(F.col("n") / bucket).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("most")) / bucket).cast("int").alias("rest_parts")), "key-parts")
    rows = rows.join(plan, "key")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rest = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest_parts")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = rows.select("key", "node", "c", part.alias("j"), every("rest_parts").alias("i"), F.lit(False).alias("rest"))
    there = rows.where("c <> largest").select("key", "node", "c", every("parts").alias("j"), rest.alias("i"), F.lit(True).alias("rest"))
    dealt = here.unionByName(there).select(F.xxhash64("key", "i", "j").alias("g"), "node", "c", "rest")
    dealt = materialize(dealt, "dealt-keys").join(classes.select("node", "wide"), "node")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # parts of the group that may go on

        def joined(g, node, c, rest, wide) -> list[tuple[int, int]]:
            out = []
            start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            for a, z in zip(start.tolist(), np.append(start[1:], len(g)).tolist()):
                out += _joins(node[a:z], c[a:z], rest[a:z], wide[a:z], max_bits)
            return out

        for b in batches:
            for at in range(0, b.num_rows, bucket):
                part = b.slice(at, bucket)
                held.append((*(part.column(i).to_numpy(zero_copy_only=False) for i in range(4)), _words(part.column(4))))
                if held[0][0][0] == held[-1][0][-1]:  # one group so far
                    continue
                columns = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1
                held = [tuple(x[cut:] for x in columns)]
                yield _signed_batch(joined(*(x[:cut] for x in columns)))
        if held:
            yield _signed_batch(joined(*(np.concatenate(x) for x in zip(*held))))

    dealt = dealt.select("g", "node", "c", "rest", "wide")
    return dealt.repartition("g").sortWithinPartitions("g", "rest", "node").mapInArrow(links, "a long, b long")


def _top(root: dict[int, int], x: int) -> int:
    while (up := root.get(x, x)) != x:
        root[x] = x = root.get(up, up)
    return x


def _joins(node: np.ndarray, c: np.ndarray, rest: np.ndarray, wide: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links between rows marked ``rest`` and others, by which components ``c`` become one; none between components that already are."""
    root: dict[int, int] = {}
    out, every = [], np.flatnonzero(~rest)
    for i in np.flatnonzero(rest).tolist():
        near = every[np.bitwise_count(wide[every] ^ wide[i]).sum(axis=1) <= max_bits]
        _, one = np.unique(c[near], return_index=True)
        for j in near[one].tolist():
            x, y = _top(root, int(c[i])), _top(root, int(c[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(node[i]), int(node[j])))
    return out


def wide_components(classes: DataFrame, copies: DataFrame | None = None, max_bits: int = WIDE_BITS, bucket: int = BUCKET) -> DataFrame:
    """``node, component`` (its smallest node) of the linked nodes of the written table ``classes(node, wide)``; ``copies(a, b)``
    are further links.

    Nodes are linked to the leaders of their keys first; then components that share a key are compared."""
    keys = shared_keys(classes, max_bits)
    links = leader_links(classes, keys, max_bits)
    found = materialize(connected_components(links.unionByName(copies) if copies is not None else links, "similar"), "similar")
    across = materialize(cross_links(classes, keys, found, max_bits, bucket), "cross-links")
    if across.isEmpty():
        return found
    first = lambda n: found.select(F.col("node").alias(n), F.col("component").alias(f"{n}_c"))
    across = across.join(first("a"), "a", "left").join(first("b"), "b", "left")
    ends = across.select("a", "b", F.coalesce("a_c", "a").alias("x"), F.coalesce("b_c", "b").alias("y"))
    ends = materialize(ends, "joined")
    joined = materialize(connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), "joined"), "joined")
    nodes = found.unionByName(ends.select(F.explode(F.array("x", "y")).alias("node")).distinct().select("node", F.col("node").alias("component"))).distinct()
    last = joined.select(F.col("node").alias("component"), F.col("component").alias("last"))
    return nodes.join(last, "component", "left").select("node", F.coalesce("last", "component").alias("component"))


def _signed_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])


def similar_documents(docs: DataFrame, words: int = 5, max_bits: int = WIDE_BITS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and ``component_id``, where links stand for a similarity of about 0.8 or more.

    64 bits don't tell 0.8 from 0.6, and blocks that no such pair can miss would be a few bits long.  So the fingerprint is
    eight times as wide, and keys are many choices of its bits, of which a pair at ``max_bits`` shares one with
    probability 0.98 (a nearer one nearly always); distances are verified on all bits.  Every pair that shares a key is linked or
    found to be in one component, whatever the size of the key's group.  Null texts count as
    empty; rows with a null id have a null ``component_id``; rows that share an id are linked; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 4 << 20):
            found = b"".join(wide_fingerprint(t, words) for t in part.column(1).to_pylist())
            flat = np.frombuffer(found, ">i8").astype(np.int64)
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * WIDE, pa.int32()), pa.array(flat))], names=["node", "wide"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = materialize(texts.mapInArrow(run, "node long, wide array<long>"), "wide")
    classes = materialize(rows.where("node is not null").groupBy("wide").agg(F.min("node").alias("node")), "wide-classes")
    copies = rows.join(classes.withColumnRenamed("node", "first"), "wide").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    joined = wide_components(classes, copies, max_bits, bucket)
    ids = rows.select(F.col("node").alias(id_col))
    return ids.join(joined, F.col(id_col) == joined.node, "left").select(id_col, F.coalesce("component", id_col).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, narrow: bool = False, **how) -> DataFrame:
    """Rows of ``docs`` whose id names their component; one document of each group stays.

    Groups are those of ``similar_documents``, or with ``narrow`` those of ``near_duplicates``.  Rows with
    a null id are kept.  Rows that share an id are all kept or all dropped.
    """
    found = near_duplicates(docs, **how) if narrow else similar_documents(docs, **how)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see ``near_duplicates`` for special cases."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
