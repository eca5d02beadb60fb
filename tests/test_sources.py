"""Files, tables and streams."""

import struct

import pytest
from graphs import five, make

from loomgraph import errors
from loomgraph.graph import Hypergraph
from loomgraph.sources import binary
from loomgraph.streaming import incremental


def test_binary_round_trip(spark, tmp_path):
    g = five(spark)
    g.update_hyperedge(7, {"x": [1, "é"]}, weight=5)
    path = str(tmp_path / "g.bin")
    g.save(path)
    back = Hypergraph.load(path, spark)
    assert not back.is_built
    back.build()
    assert [back.get_hyperedge_vertices(h) for h in (6, 7, 8)] == [g.get_hyperedge_vertices(h) for h in (6, 7, 8)]
    assert back.get_vertex(3) == {"n": 3} and back.get_hyperedge(7) == {"x": [1, "é"]}
    assert {r["id"]: r["weight"] for r in back.hyperedge_frame.collect()} == {6: 1, 7: 5, 8: 1}
    assert back.create_vertex() == 9
    raw = (tmp_path / "g.bin").read_bytes()
    assert struct.unpack_from("<IBIII", raw) == (binary.MAGIC, 1, 8, 5, 3)
    binary.register(spark)
    assert spark.read.format("loomgraph").load(path).where("kind = 'vertex'").count() == 5


def test_bad_files(spark, tmp_path):
    for name, head, error in (("magic", (1, 1, 0, 0, 0), errors.InvalidMagicNumberError), ("version", (binary.MAGIC, 9, 0, 0, 0), errors.UnsupportedVersionError)):
        path = tmp_path / name
        path.write_bytes(binary.HEADER.pack(*head))
        with pytest.raises(error):
            Hypergraph.load(str(path), spark)
    with pytest.raises(errors.HypergraphError):
        Hypergraph.load(str(tmp_path / "none"), spark)
    with pytest.raises(errors.HypergraphError):
        five(spark).save("/proc/none/g.bin")


def test_custom_payloads(spark, tmp_path):
    g, _ = make(spark, [[1, 2]])
    path = str(tmp_path / "c.bin")
    binary.save(g, path, encode=lambda data, weight: struct.pack("<I", weight))
    back = binary.load(spark, path, decode=lambda raw: ("{}", struct.unpack("<I", raw)[0] + 1))
    assert back.hyperedge_frame.first()["weight"] == 2


def test_parquet_round_trip(spark, tmp_path):
    g = five(spark)
    g.write_parquet(str(tmp_path / "g"))
    back = Hypergraph.read_parquet(str(tmp_path / "g"), spark)
    back.build()
    assert back.bfs(1) == g.bfs(1) and back.create_vertex() == 9


def test_tables_and_arrays(spark):
    df = spark.createDataFrame([(10, 2, "b"), (10, 1, "a"), (11, 1, "c")], "e long, v long, o string")
    g = Hypergraph.from_table(df, "e", "v", ["o"])
    assert g.get_hyperedge_vertices(10) == [1, 2] and g.get_all_vertex_ids() == [1, 2]
    h = Hypergraph.from_arrays(spark.createDataFrame([(5, [3, 1, 3])], "id long, members array<long>"))
    assert h.get_hyperedge_vertices(5) == [3, 1, 3]


def test_streams(spark, tmp_path):
    for k, part in enumerate(([(1, 0, 7), (1, 1, 8)], [(2, 0, 8), (1, 2, 9)])):
        spark.createDataFrame(part, "hyperedge_id long, pos long, vertex_id long").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    stream = spark.readStream.schema("hyperedge_id long, pos long, vertex_id long, p int").parquet(str(tmp_path / "in"))
    incremental.append_to(stream.drop("p"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert incremental.read_table(spark, str(tmp_path / "out")).count() == 4
    q = incremental.running_endpoints(stream).writeStream.format("memory").queryName("ends").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from ends").collect())) == [(1, 7, 9, 3), (2, 8, 8, 1)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"n": "a"}\n{"n": "b"}\n{"n": "c"}\n')
    (tmp_path / "h.json").write_text('{"members": [2, 0, 2], "weight": 4}\n{"members": [1]}\n')
    g = Hypergraph.from_json(spark, str(tmp_path / "v.json"), str(tmp_path / "h.json"))
    assert g.get_hyperedge_vertices(4) == [3, 1, 3] and g.get_hyperedge_vertices(5) == [2]
    assert g.get_vertex(2) == {"n": "b"} and [r["weight"] for r in g.hyperedge_frame.orderBy("id").collect()] == [4, 1]


def test_raw_codecs_apart(spark, tmp_path):
    """Payloads as the bytes of a layout, vertices and hyperedges each by its own."""
    g = Hypergraph(spark)
    a, b = g.create_vertices([{"age": 3}, {"age": 4}])
    h = g.create_hyperedge({"size": 2.5}, 7)
    g.append_vertices(h, [a, b, a])
    edge, vertex = binary.RawCodec("<dq", ["size", "weight"]), binary.RawCodec("<i", ["age"])
    path = str(tmp_path / "raw.bin")
    binary.save(g, path, edge.encode, vertex.encode)
    back = binary.load(spark, path, edge.decode, vertex.decode)
    assert [back.get_vertex(v) for v in (a, b)] == [{"age": 3}, {"age": 4}] and back.get_hyperedge(h) == {"size": 2.5}
    assert back.get_hyperedge_vertices(h) == [a, b, a] and back.hyperedge_frame.first()["weight"] == 7
