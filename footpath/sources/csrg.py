"""The flat binary graph format (versions 1 and 2), read and written.

A file holds one graph of at most ``LIMIT`` nodes and edges (32-bit offsets).  Tasks pack its arrays in ranges of
nodes and write them in the shared folder, from which the file is moved; where that isn't mounted, the driver writes one range at a time.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zipfile

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scratch import local_path, shared_dir
from ..operators import packed
from ..operators.paths import Graph

# Mark, header size and largest counts that the format's types hold.
MAGIC, HEADER, LIMIT, MAX_NAMES, MAX_HIGHWAYS = b"CSRG", 32, 2**31 - 1, 2**16, 2**8

#: Mark in the header's reserved bytes; the place of the arrays in 64 bits follows it.
EXACT = b"EXACT64\0"


def _table(values: list[str]) -> bytes:
    raw = [v.encode() for v in values]
    return struct.pack("<I", len(raw)) + b"".join(struct.pack("<H", len(r)) + r for r in raw)


def _places(n: int, m: int, named: bool) -> tuple[list[tuple[str, str, int]], int]:
    """The format's arrays, where they begin, and the byte after them."""
    out, at = [], HEADER
    for column, kind, size in (("ids", "<i8", n), ("lat", "<f4", n), ("lon", "<f4", n), ("offsets", "<i4", n + 1), ("dst", "<i4", m), ("weight", "<f4", m), ("name", "<u2", m), ("highway", "u1", m)):
        if named or column not in ("name", "highway"):
            out.append((column, kind, at))
            at += size * np.dtype(kind).itemsize
    return out, at


def write(graph: Graph, path: str) -> None:
    """Write ``graph`` to a local file; version 2 if its edges have names.

    Weights and coordinates follow in 64 bits behind what the format has, which readers of the format don't look at."""
    edges = graph.number_of_edges()
    if 2 * edges > LIMIT or graph.number_of_nodes() > LIMIT:
        raise ValueError("the graph is too large for 32-bit offsets")
    tables, more = {}, {}
    if graph.has_names:
        for column, kind, most in (("name", "<u2", MAX_NAMES), ("highway", "u1", MAX_HIGHWAYS)):
            found = graph.edges.select(F.coalesce(column, F.lit(""))).distinct().limit(most + 1).collect()
            table = ["", *sorted({v for (v,) in found} - {""})]
            if len(table) > most:
                raise ValueError(f"more than {most} values in {column}")
            tables[column], more[column] = {v: i for i, v in enumerate(table)}, kind
    chunks = packed.packed(graph.nodes, graph.adj, more, tables)
    n, m, starts = packed.sizes(chunks)
    places, end = _places(n, m, graph.has_names)
    words = b"".join(_table(list(tables[c])) for c in more)
    exact = end + len(words)
    places += [("weight", "<f8", exact), ("lat", "<f8", exact + 8 * m), ("lon", "<f8", exact + 8 * (m + n))]
    spark = graph.nodes.sparkSession
    shared = local_path(f"{shared_dir(spark)}/written-{uuid.uuid4().hex}")
    own = shared or path
    os.makedirs(os.path.dirname(own) or ".", exist_ok=True)
    with open(own, "wb") as f:
        f.truncate(exact + 8 * (m + 2 * n))
        f.write(MAGIC + struct.pack("<III", 2 if graph.has_names else 1, n, m) + EXACT + struct.pack("<Q", exact))
        f.write(bytes(4 * (n + 1)) if n == 0 else b"")
        f.seek(end)
        f.write(words)
        if shared is None:
            packed.assemble(chunks, f, places, starts, (n, m), more)
    if shared is not None:
        packed.assemble_shared(chunks, own, places, starts, more)
        shutil.move(own, path)


class Words:
    """Strings by number; a slice is decoded when it is asked for."""

    def __init__(self, number: np.ndarray, table: list[str]):
        self.number, self.table = number, np.array(table, object)

    def __getitem__(self, which) -> np.ndarray:
        return self.table[self.number[which]]


class Arrays:
    """A mapped file's arrays; every size is checked against the file's."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if len(data) < HEADER or data[:4].tobytes() != MAGIC:
            raise ValueError("not a graph file")
        self.version, self.n, self.m = struct.unpack("<III", data[4:16].tobytes())
        if self.version not in (1, 2):
            raise ValueError(f"version {self.version} is not known")
        self._data, self._at = data, HEADER
        self.ids, self.lat, self.lon = self._take("<i8", self.n), self._take("<f4", self.n), self._take("<f4", self.n)
        self.offsets, self.targets, self.weights = self._take("<i4", self.n + 1), self._take("<i4", self.m), self._take("<f4", self.m)
        self.names = self.highways = None
        if self.version == 2:
            name, highway = self._take("<u2", self.m), self._take("u1", self.m)
            self.names, self.highways = Words(name, self._strings()), Words(highway, self._strings())
        self.exact = data[16:24].tobytes() == EXACT
        if self.exact:
            self._plain = {"lat": self.lat, "lon": self.lon, "weights": self.weights}
            (self._at,) = struct.unpack("<Q", data[24:32].tobytes())
            self.weights, self.lat, self.lon = self._take("<f8", self.m), self._take("<f8", self.n), self._take("<f8", self.n)

    def _take(self, kind: str, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        if self._at + size > len(self._data):
            raise ValueError("the graph file is too short")
        # from any byte on, as the format doesn't align its arrays; nothing is read before it is used
        out = np.ndarray((n,), kind, self._data, self._at)
        self._at += size
        return out

    def _strings(self) -> list[str]:
        (n,) = struct.unpack("<I", self._take("u1", 4).tobytes())
        out = []
        for _ in range(n):
            (size,) = struct.unpack("<H", self._take("u1", 2).tobytes())
            out.append(self._take("u1", size).tobytes().decode())
        return out


#: Nodes and edges of a part of a file, about.
PART = 500_000


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.parts = options["path"], options.get("table", "adj"), int(options.get("parts", "8"))

    def partitions(self):
        x = Arrays(self.path)
        n = x.n
        step = max(1, -(-n // max(self.parts, -(-(n + x.m) // PART))))
        return [_Range(a, min(n, a + step)) for a in range(0, n, step)] or [_Range(0, 0)]

    def read(self, part: _Range):
        import pyarrow as pa

        x, a, b = Arrays(self.path), part.first, part.last
        if self.table == "nodes":
            yield pa.record_batch([pa.array(x.ids[a:b]), pa.array(x.lat[a:b].astype("f8")), pa.array(x.lon[a:b].astype("f8"))], names=["osm_id", "lat", "lon"])
            return
        s = slice(int(x.offsets[a]), int(x.offsets[b]))
        src = np.repeat(x.ids[a:b], np.diff(x.offsets[a : b + 1]))
        text = lambda v: pa.array(v[s].tolist(), pa.string()) if v is not None else pa.nulls(s.stop - s.start, pa.string())
        yield pa.record_batch([pa.array(src), pa.array(x.ids[x.targets[s]]), pa.array(x.weights[s].astype("f8")), text(x.names), text(x.highways)], names=["src", "dst", "weight", "name", "highway"])


class CsrgSource(DataSource):
    """``spark.read.format("csrg").option("table", "nodes" | "adj").load(path)``, in ranges of nodes."""

    @classmethod
    def name(cls) -> str:
        return "csrg"

    def schema(self) -> str:
        if self.options.get("table", "adj") == "nodes":
            return "osm_id long, lat double, lon double"
        return "src long, dst long, weight double, name string, highway string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def read(spark: SparkSession, path: str) -> Graph:
    """A file on storage that every node mounts, as a graph (each pair of directed edges once)."""
    spark.dataSource.register(CsrgSource)
    nodes = spark.read.format("csrg").option("table", "nodes").load(path)
    adj = spark.read.format("csrg").option("table", "adj").load(path)
    loops = adj.where("src = dst").dropDuplicates(["src"])
    edges = adj.where("src < dst").unionByName(loops).withColumnsRenamed({"src": "u", "dst": "v"})
    return Graph(nodes, edges if Arrays(path).version == 2 else edges.drop("name", "highway"))


#: Arrays of an archive in the order of the flat format, and their types there.
ARCHIVE = (("node_ids", "<i8"), ("node_lats", "<f4"), ("node_lons", "<f4"), ("adj_offsets", "<i4"), ("adj_targets", "<i4"), ("adj_weights", "<f4"), ("edge_name_indices", "<u2"), ("edge_highway_indices", "u1"))

#: Arrays in 64 bits, which archives of others don't have.
EXACT_ARCHIVE = (("exact_weights", "<f8"), ("exact_lats", "<f8"), ("exact_lons", "<f8"))


def _member(z: zipfile.ZipFile, name: str, kind: str):
    """Pieces of an archive's array in another type."""
    with z.open(name + ".npy") as f:
        head = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(f) == (1, 0) else np.lib.format.read_array_header_2_0
        dtype = head(f)[2]
        while piece := f.read(dtype.itemsize * (1 << 20)):
            yield np.frombuffer(piece, dtype).astype(kind).tobytes()


def unpack_npz(archive: str, path: str) -> None:
    """A compressed archive as a file of the flat format, piece by piece; name arrays may be missing."""
    with zipfile.ZipFile(archive) as z, open(path, "wb") as f:
        names = set(z.namelist())
        named, exact = "edge_name_indices.npy" in names, "exact_weights.npy" in names
        counts = {}
        f.write(bytes(HEADER))
        for name, kind in ARCHIVE[: 8 if named else 6]:
            counts[name] = sum(f.write(piece) for piece in _member(z, name, kind)) // np.dtype(kind).itemsize
        if named:
            for name in ("name_table", "highway_table"):
                f.write(_table(b"".join(_member(z, name, "u1")).decode().split("\n")))
        place = f.tell()
        for name, kind in EXACT_ARCHIVE if exact else ():
            for piece in _member(z, name, kind):
                f.write(piece)
        f.seek(0)
        f.write(MAGIC + struct.pack("<III", 2 if named else 1, counts["node_ids"], counts["adj_targets"]) + (EXACT + struct.pack("<Q", place) if exact else bytes(16)))


def read_npz(spark: SparkSession, path: str) -> Graph:
    """A compressed archive of the same arrays, which is unpacked in the folder that driver and executors share."""
    own = local_path(f"{shared_dir(spark)}/unpacked-{uuid.uuid4().hex}")
    if own is None:
        raise ValueError("spark.checkpoint.dir must be mounted for files of this format")
    os.makedirs(os.path.dirname(own), exist_ok=True)
    unpack_npz(path, own)
    return read(spark, own)


def write_npz(graph: Graph, path: str) -> None:
    """The same arrays as a compressed archive; those in 64 bits have names of their own."""
    own = path + ".csrg"
    write(graph, own)
    x = Arrays(own)
    (lat, lon, weights) = (x._plain[c] for c in ("lat", "lon", "weights"))
    arrays = {"node_ids": x.ids, "node_lats": lat, "node_lons": lon, "adj_offsets": x.offsets, "adj_targets": x.targets, "adj_weights": weights, "exact_weights": x.weights, "exact_lats": x.lat, "exact_lons": x.lon}
    if x.version == 2:
        for values, index, table, kind in ((x.names, "edge_name_indices", "name_table", "u2"), (x.highways, "edge_highway_indices", "highway_table", "u1")):
            arrays[index] = np.asarray(values.number, kind)
            arrays[table] = np.frombuffer("\n".join(values.table).encode(), np.uint8)
    np.savez_compressed(path, **arrays)
    os.remove(own)
