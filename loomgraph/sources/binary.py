"""The single-file binary format, little-endian.

Header: magic (u32), version (u8), last id, number of vertices, number of hyperedges (u32 each). A vertex: id, length of
the payload (u32 each), payload. A hyperedge: the same, then the number of its positions and their vertex ids (u32
each). A payload, with the default codec: length of the JSON text (u64), the text, the weight (u64).
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import TYPE_CHECKING, Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.errors import HypergraphError, InvalidMagicNumberError, UnsupportedVersionError
from loomgraph.functions.frames import arrays_of
from loomgraph.plans.tables import folder_of, parts_of, stored

if TYPE_CHECKING:
    from loomgraph.graph import Hypergraph

# Fixed values of the format
MAGIC, VERSION = 0x5A504748, 1
HEADER, ITEM, JSON_LENGTH, WEIGHT = struct.Struct("<IBIII"), struct.Struct("<II"), struct.Struct("<Q"), struct.Struct("<Q")
ROWS = "kind string, id long, payload binary, members array<long>, last_id long"
#: Bytes of a chunk that is written, and of whole items that are read together.
CHUNK, PIECE = 1 << 20, 1 << 14


def json_payload(data: str | None, weight: int) -> bytes:
    raw = (data or "{}").encode()
    return JSON_LENGTH.pack(len(raw)) + raw + WEIGHT.pack(weight)


def read_json_payload(raw: bytes) -> tuple[str, int]:
    n = JSON_LENGTH.unpack_from(raw)[0]
    return raw[8 : 8 + n].decode(), WEIGHT.unpack_from(raw, 8 + n)[0]


def parse(raw: bytes) -> Iterator[tuple]:
    """(kind, id, payload, members, last_id) of a file's vertices and hyperedges, in the file's order."""
    if len(raw) < HEADER.size or HEADER.unpack_from(raw)[0] != MAGIC:
        raise InvalidMagicNumberError("not a hypergraph file")
    _, version, last_id, n_vertices, n_hyperedges = HEADER.unpack_from(raw)
    if version != VERSION:
        raise UnsupportedVersionError(f"version {version}")
    at = HEADER.size
    yield "header", 0, b"", [], last_id
    for k in range(n_vertices + n_hyperedges):
        id_, n = ITEM.unpack_from(raw, at)
        payload, at = raw[at + 8 : at + 8 + n], at + 8 + n
        members: list[int] = []
        if k >= n_vertices:
            (m,) = struct.unpack_from("<I", raw, at)
            members, at = list(struct.unpack_from(f"<{m}I", raw, at + 4)), at + 4 + 4 * m
        yield "vertex" if k < n_vertices else "hyperedge", id_, payload, members, last_id


def _as_text(df: DataFrame) -> DataFrame:
    """Payloads of other types than text as JSON."""
    return df if df.schema["data"].dataType == StringType() else df.withColumn("data", F.to_json("data"))


class RawCodec:
    """Payloads without pointers as their bytes: the fields of one fixed layout, as ``struct`` writes it, and no more.

    ``fields`` names the values of the layout in the payload; a field called ``weight`` is the weight, which is 1 without
    one. As a codec: ``save(g, path, codec.encode, vertex_codec.encode)``.
    """

    def __init__(self, layout: str, fields: list[str]) -> None:
        self.layout, self.fields = layout, fields

    def encode(self, data: str | None, weight: int) -> bytes:
        values = json.loads(data or "{}")
        return struct.pack(self.layout, *(weight if f == "weight" else values[f] for f in self.fields))

    def decode(self, raw: bytes) -> tuple[str, int]:
        values = dict(zip(self.fields, struct.unpack(self.layout, raw)))
        weight = int(values.pop("weight", 1))
        return json.dumps(values), weight


def vertex_bytes(id_: int, payload: bytes) -> bytes:
    return ITEM.pack(id_, len(payload)) + payload


def hyperedge_bytes(id_: int, payload: bytes, members: list[int] | None) -> bytes:
    members = members or []
    return vertex_bytes(id_, payload) + struct.pack(f"<I{len(members)}I", len(members), *members)


def chunks(items: Iterable[bytes], size: int = CHUNK) -> Iterator[bytes]:
    """The bytes of all items in turn, as chunks of exactly ``size`` and a rest."""
    held = bytearray()
    for x in items:
        held += x
        while len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
    if held:
        yield bytes(held)


def _copied(rows: DataFrame, items: Callable[[pa.RecordBatch], Iterator[bytes]], out: Any) -> None:
    """Has executors make ``items`` of ``rows`` by id, and the JVM copy them to ``out``. A text file takes a line break
    after each chunk, which is passed over; the last chunk is as long as the file leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(x for b in batches for x in items(b)):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary())], names=["value"])

    spark = rows.sparkSession
    path = f"{folder_of(spark)}/pieces-{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange(parts_of(rows), "id").sortWithinPartitions("id")
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(path)
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(conf)
    parts = sorted((f.getPath().getName(), f.getLen()) for f in system.listStatus(folder))
    for name, left in parts:
        if not name.startswith("part-"):
            continue
        source = system.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        try:
            while left > 0:
                n = min(CHUNK, left - 1)
                jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, n)
                if source.read() != 10:
                    raise HypergraphError(f"a piece of {path} isn't as long as it was written")
                left -= n + 1
        finally:
            source.close()
    system.delete(folder, True)


def save(graph: Hypergraph, path: str, encode: Callable[[str | None, int], bytes] = json_payload, encode_vertex: Callable[[str | None, int], bytes] | None = None) -> None:
    """Writes the graph, by id, to one file at any path that Spark can write to.

    Executors encode ranges of ids, in the shared folder; the driver only copies their bytes to the file in turn. The
    format has one file and counts in front, so this is for exchange; Parquet is the format for large graphs. A
    hyperedge's list must fit in a row. A custom codec turns (data, weight) into a payload; vertices, whose weight is 1,
    may have one of their own.
    """
    of_vertex = encode_vertex or encode
    spark = graph.spark
    vertices = _as_text(graph.vertex_frame).select("id", "data")
    edges = _as_text(graph.hyperedge_frame).join(arrays_of(graph.incidence), F.col("id") == F.col("hyperedge_id"), "left").select("id", "weight", "data", "members")
    lists = lambda b, *names: zip(*(b.column(c).to_pylist() for c in names))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    except Exception as e:
        raise HypergraphError(f"can't write {path}") from e
    try:
        out.write(HEADER.pack(MAGIC, VERSION, graph._last_id, graph.count_vertices(), graph.count_hyperedges()))
        _copied(vertices, lambda b: (vertex_bytes(i, of_vertex(d, 1)) for i, d in lists(b, "id", "data")), out)
        _copied(edges, lambda b: (hyperedge_bytes(i, encode(d, w), m) for i, w, d, m in lists(b, "id", "weight", "data", "members")), out)
    finally:
        out.close()


def pieces(f: BinaryIO, size: int = PIECE) -> Iterator[tuple[str, int, bytes, int]]:
    """(kind, items, their bytes, last_id) of a file that is read once from its beginning: whole vertices or hyperedges
    in pieces of about ``size``, and first the header."""
    head = f.read(HEADER.size)
    if len(head) < HEADER.size or HEADER.unpack(head)[0] != MAGIC:
        raise InvalidMagicNumberError("not a hypergraph file")
    _, version, last_id, n_vertices, n_hyperedges = HEADER.unpack(head)
    if version != VERSION:
        raise UnsupportedVersionError(f"version {version}")
    yield "header", 1, b"", last_id
    for kind, n in (("vertex", n_vertices), ("hyperedge", n_hyperedges)):
        held, k = bytearray(), 0
        for _ in range(n):
            item = f.read(8)
            rest = ITEM.unpack(item)[1]
            held += item + f.read(rest)
            if kind == "hyperedge":
                count = f.read(4)
                held += count + f.read(4 * struct.unpack("<I", count)[0])
            k += 1
            if len(held) >= size:
                yield kind, k, bytes(held), last_id
                held, k = bytearray(), 0
        if k:
            yield kind, k, bytes(held), last_id


def items_of(kind: str, n: int, raw: bytes) -> Iterator[tuple[int, bytes, list[int]]]:
    """(id, payload, members) of a piece."""
    at = 0
    for _ in range(n):
        id_, length = ITEM.unpack_from(raw, at)
        payload, at = raw[at + 8 : at + 8 + length], at + 8 + length
        members: list[int] = []
        if kind == "hyperedge":
            (m,) = struct.unpack_from("<I", raw, at)
            members, at = list(struct.unpack_from(f"<{m}I", raw, at + 4)), at + 4 + 4 * m
        if at > len(raw):
            raise struct.error("the file ends early")
        yield id_, payload, members


def read_rows(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[str, int]] = read_json_payload, decode_vertex: Callable[[bytes], tuple[str, int]] | None = None) -> DataFrame:
    """(kind, id, data, weight, members, last_id) of a file.

    One task cuts it into pieces of whole items, holding one at a time, and all tasks parse those. Executors open a path
    of the local file system, which they share, themselves; a file elsewhere comes as one row, of 2 GB at most.
    """
    of_vertex = decode_vertex or decode
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    here = uri.getPath() if uri.getScheme() == "file" else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64())
        for b in batches:
            for x in b.column(0).to_pylist():
                with open(here, "rb", 1 << 20) if here else io.BytesIO(x) as f:
                    found = pieces(f)
                    while part := list(islice(found, 64)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=["kind", "n", "raw", "last_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        for b in batches:
            for kind, n, raw, last_id in zip(*(b.column(c).to_pylist() for c in ("kind", "n", "raw", "last_id"))):
                if kind == "header":
                    rows = [(kind, 0, None, None, [], last_id)]
                else:
                    rows = [(kind, i, *(of_vertex if kind == "vertex" else decode)(bytes(p)), m, last_id) for i, p, m in items_of(kind, n, raw)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["kind", "id", "data", "weight", "members", "last_id"])

    source = spark.range(0, 1, 1, 1) if here else spark.read.format("binaryFile").load(path).select("content")
    whole = stored(source.mapInArrow(cut, "kind string, n long, raw binary, last_id long"), "binary-pieces")
    return whole.mapInArrow(run, "kind string, id long, data string, weight long, members array<long>, last_id long")


def load(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[str, int]] = read_json_payload, decode_vertex: Callable[[bytes], tuple[str, int]] | None = None) -> Hypergraph:
    """The graph of a file, not built. Its ids go on from the file's last one. Vertices may have a codec of their own."""
    from loomgraph.graph import Hypergraph
    from loomgraph.operators.projections import Frames

    try:
        rows = stored(read_rows(spark, path, decode, decode_vertex), "binary-file")
        last_id = rows.where("kind = 'header'").first()["last_id"]
    except Exception as e:
        for kind in (InvalidMagicNumberError, UnsupportedVersionError):
            if kind.__name__ in str(e):
                raise kind(path) from e
        raise HypergraphError(f"can't read {path}") from e
    vertices = rows.where("kind = 'vertex'").select("id", "data")
    edges = rows.where("kind = 'hyperedge'")
    incidence = edges.select(F.col("id").alias("hyperedge_id"), F.posexplode("members").alias("pos", "vertex_id")).select("hyperedge_id", F.col("pos").cast("long").alias("pos"), "vertex_id")
    return Hypergraph(spark, Frames(vertices, edges.select("id", "weight", "data"), incidence), last_id=last_id)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("loomgraph")`` read the rows of a file that every executor can open."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def __init__(self, path: str) -> None:
            self.path = path

        def read(self, partition):  # noqa: ANN001, ANN201
            with open(self.path, "rb") as f:
                yield from parse(f.read())

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "loomgraph"

        def schema(self) -> str:
            return ROWS

        def reader(self, schema):  # noqa: ANN001, ANN201
            return Reader(self.options["path"])

    spark.dataSource.register(Source)
