"""The hypergraph object: three frames, edited in place, and every operator as a method.

Point lookups return Python values. Operators whose results grow with the graph have a ``*_frame`` method, or live in
``loomgraph.operators`` and ``loomgraph.plans``, that returns a DataFrame; the plain method of the same name collects it
and is meant for graphs whose result fits the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from loomgraph import schema
from loomgraph.errors import HyperedgeNotFoundError, IndexOutOfBoundsError, NotBuiltError, NotEnoughHyperedgesError, NotEnoughVerticesError, VertexNotFoundError
from loomgraph.fluent import HyperedgeQuery, VertexQuery
from loomgraph.functions import frames
from loomgraph.operators import edits, matrices, measures, projections, subsets
from loomgraph.operators.projections import Frames
from loomgraph.plans import ranking, structure, traversal
from loomgraph.plans.tables import stored, stored_all


#: Positions of edited lists that the driver holds at most.
OPEN_POSITIONS = 1_000_000


def _sorted_ids(df: DataFrame) -> list[int]:
    """Ids as one column of longs, sorted here: rows would take ten times the driver's memory."""
    return np.sort(df.select("id").toArrow()["id"].to_numpy()).tolist()


class Hypergraph:
    """A directed hypergraph: each hyperedge an ordered list of vertices, repeats allowed.

    Vertices and hyperedges share one counter of ids, the first is 1. Calls that need the reverse index raise
    ``NotBuiltError`` until ``build()``.
    """

    def __init__(self, spark: SparkSession | None = None, frames_: Frames | None = None, *, last_id: int | None = None) -> None:
        self.spark = spark or SparkSession.active()
        empty = lambda s: self.spark.createDataFrame([], s)
        self._vertices, self._hyperedges, self._incidence = frames_ or (empty(schema.VERTICES), empty(schema.HYPEREDGES), empty(schema.INCIDENCE))
        self._last_id = last_id if last_id is not None else (self._largest_id() if frames_ else 0)
        self._new_vertices: list[tuple] = []
        self._new_hyperedges: list[tuple] = []
        # lists that are edited on the driver until a frame is read; those of new hyperedges have no rows yet
        self._open: dict[int, list[int]] = {}
        self._rowless: set[int] = set()
        self._n_open = 0
        self._known_vertices: set[int] = set()
        self._known_hyperedges: set[int] = set()
        self._members: DataFrame | None = None
        self._pairs: DataFrame | None = None

    # Frames

    @classmethod
    def from_table(cls, df: DataFrame, edge: str, vertex: str, order: list[str], *, weight: DataFrame | None = None, vertices: DataFrame | None = None, hyperedges: DataFrame | None = None, pos: str | None = None) -> Hypergraph:
        """From a table with a row for each position. ``vertices`` (id, data) and ``hyperedges`` (id, weight, data) may
        hold more than occur, as orphans; without them those that occur are taken."""
        incidence = frames.incidence_from_table(df, edge, vertex, order, pos)
        none = F.lit(None).cast("string").alias("data")
        if vertices is None:
            vertices = incidence.select(F.col("vertex_id").alias("id")).distinct().select("id", none)
        if hyperedges is None:
            hyperedges = incidence.select(F.col("hyperedge_id").alias("id")).distinct().select("id", F.lit(1).cast("long").alias("weight"), none)
        return cls(df.sparkSession, Frames(vertices, hyperedges, incidence))

    @classmethod
    def from_arrays(cls, df: DataFrame, edge: str = "id", members: str = "members") -> Hypergraph:
        """From a table with a row for each hyperedge and an array of its vertices."""
        incidence = frames.incidence_from_arrays(df, edge, members)
        none = F.lit(None).cast("string").alias("data")
        weight = F.col("weight").cast("long") if "weight" in df.columns else F.lit(1).cast("long")
        hyperedges = df.select(F.col(edge).cast("long").alias("id"), weight.alias("weight"), none)
        return cls(df.sparkSession, Frames(incidence.select(F.col("vertex_id").alias("id")).distinct().select("id", none), hyperedges, incidence))

    @classmethod
    def from_json(cls, spark: SparkSession, vertices: str, hyperedges: str) -> Hypergraph:
        """From two folders of JSON lines: any objects as vertices, and hyperedges with ``members``, line numbers of
        vertices from 0 by file and place, and perhaps ``weight``. Ids count vertices first, then hyperedges."""
        from loomgraph.sources import json_lines

        return json_lines.read(spark, vertices, hyperedges)

    def _largest_id(self) -> int:
        return max(int(df.agg(F.max("id")).first()[0] or 0) for df in (self._vertices, self._hyperedges))

    def _flush(self) -> None:
        """Takes buffered rows into the frames, so that many single insertions make one plan node."""
        if self._new_vertices:
            self._vertices = self._vertices.unionByName(self._payload_rows(self._vertices, self._new_vertices))
            self._new_vertices = []
        if self._new_hyperedges:
            self._hyperedges = self._hyperedges.unionByName(self._payload_rows(self._hyperedges, self._new_hyperedges))
            self._new_hyperedges = []

    def _payload_rows(self, frame: DataFrame, rows: list[tuple]) -> DataFrame:
        """Rows whose last value is a payload, in the frame's own type of payloads."""
        kind = frame.schema["data"].dataType
        text = isinstance(kind, StringType)
        rows = [(*r[:-1], json.dumps({} if text and r[-1] is None else r[-1])) for r in rows]
        new = self.spark.createDataFrame(rows, StructType([StructField(c, StringType() if c == "data" else LongType(), c == "data") for c in frame.columns]))
        return new if text else new.withColumn("data", self._read_payload(F.col("data"), kind))

    @staticmethod
    def _read_payload(text: Column, kind: DataType) -> Column:
        """A payload of another type than text from its JSON."""
        inside = StructType([StructField("x", kind)])
        return F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), inside)["x"]

    @staticmethod
    def _payload_column(frame: DataFrame, data: Any) -> Column:
        kind = frame.schema["data"].dataType
        text = F.lit(json.dumps(data))
        return text if isinstance(kind, StringType) else Hypergraph._read_payload(text, kind)

    def _opened(self, hyperedge_id: int) -> list[int] | None:
        """A hyperedge's list, to be edited in place, or None if it is too long for the driver."""
        if hyperedge_id not in self._open:
            here = F.col("hyperedge_id") == hyperedge_id
            if self._incidence.where(here).limit(OPEN_POSITIONS + 1).count() > OPEN_POSITIONS:
                return None
            self._open[hyperedge_id] = [r["vertex_id"] for r in self._incidence.where(here).orderBy("pos").collect()]
            self._n_open += len(self._open[hyperedge_id])
        return self._open[hyperedge_id]

    def _grown(self, n: int) -> None:
        self._n_open += n
        if self._n_open > OPEN_POSITIONS:
            self._close_lists()

    def _close_lists(self) -> None:
        """Takes the opened lists into the incidences, as one frame."""
        if not self._open:
            return
        ids = np.repeat(np.fromiter(self._open, np.int64, len(self._open)), [len(x) for x in self._open.values()])
        places = [np.arange(len(x)) for x in self._open.values()]
        columns = {"hyperedge_id": ids, "pos": np.concatenate(places), "vertex_id": np.fromiter(chain.from_iterable(self._open.values()), np.int64, len(ids))}
        rows = self.spark.createDataFrame(pa.table({c: pa.array(x, pa.int64()) for c, x in columns.items()}), schema.INCIDENCE)
        had = [i for i in self._open if i not in self._rowless]
        self._open, self._rowless, self._n_open = {}, set(), 0
        rest = self._incidence
        if had:
            rest = rest.join(F.broadcast(self.spark.createDataFrame([(i,) for i in had], "hyperedge_id long")), "hyperedge_id", "left_anti")
        self._edited(rest.unionByName(rows))

    @property
    def vertex_frame(self) -> DataFrame:
        self._flush()
        return self._vertices

    @property
    def hyperedge_frame(self) -> DataFrame:
        self._flush()
        return self._hyperedges

    @property
    def incidence(self) -> DataFrame:
        self._close_lists()
        return self._incidence

    @property
    def frames(self) -> Frames:
        return Frames(self.vertex_frame, self.hyperedge_frame, self.incidence)

    @property
    def members(self) -> DataFrame:
        self._close_lists()
        return self._members if self._members is not None else frames.members_of(self.incidence)

    @property
    def pairs(self) -> DataFrame:
        self._close_lists()
        return self._pairs if self._pairs is not None else frames.pairs_of(self.incidence)

    @property
    def is_built(self) -> bool:
        return self._members is not None

    # Lifecycle

    def build(self) -> None:
        """Stores the frames and those derived from them; idempotent, and cuts the lineage of the edits so far."""
        incidence = self._incidence = stored(self.incidence, "incidence")
        named = {"vertices": self.vertex_frame, "hyperedges": self.hyperedge_frame, "members": frames.members_of(incidence), "pairs": frames.pairs_of(incidence)}
        self._vertices, self._hyperedges, self._members, self._pairs = stored_all(named)

    def clear(self) -> None:
        """Drops everything; ids go on from where they were."""
        last = self._last_id
        self.__init__(self.spark)
        self._last_id = last

    def clone(self) -> Hypergraph:
        """An independent copy that isn't built; its ids go on from the largest one left."""
        self._need_build()
        return Hypergraph(self.spark, self.frames)

    def save(self, path: str) -> None:
        from loomgraph.sources import binary

        binary.save(self, str(path))

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Hypergraph:
        from loomgraph.sources import binary

        return binary.load(spark or SparkSession.active(), str(path))

    def write_parquet(self, path: str) -> None:
        from loomgraph.sources import tables

        tables.write(self, path)

    @classmethod
    def read_parquet(cls, path: str, spark: SparkSession | None = None) -> Hypergraph:
        from loomgraph.sources import tables

        return tables.read(spark or SparkSession.active(), path)

    def reserve_vertices(self, n: int) -> None:
        """Nothing to do: frames have no capacity."""

    reserve_hyperedges = reserve_vertices

    def reserve_hyperedge_vertices(self, hyperedge_id: int, n: int) -> None:
        self.check_if_hyperedge_exists(hyperedge_id)

    # Checks

    def _need_build(self) -> None:
        if not self.is_built:
            raise NotBuiltError("call build() first")

    def _missing(self, df: DataFrame, ids: Sequence[int]) -> list[int]:
        wanted = sorted(set(map(int, ids)))
        found = {r["id"] for r in df.where(F.col("id").isin(wanted)).select("id").collect()}
        return [i for i in wanted if i not in found]

    def check_if_vertices_exist(self, ids: Sequence[int]) -> None:
        rest = [i for i in ids if i not in self._known_vertices]
        if rest and (missing := self._missing(self._vertices, rest)):
            raise VertexNotFoundError(f"no vertices {missing}")
        self._known_vertices.update(rest)

    def check_if_hyperedges_exist(self, ids: Sequence[int]) -> None:
        rest = [i for i in ids if i not in self._known_hyperedges]
        if rest and (missing := self._missing(self._hyperedges, rest)):
            raise HyperedgeNotFoundError(f"no hyperedges {missing}")
        self._known_hyperedges.update(rest)

    def _forget(self) -> None:
        """Before rows go: what was known of ids, and lists that are open."""
        self._flush()
        self._close_lists()
        self._known_vertices, self._known_hyperedges = set(), set()

    def check_if_vertex_exists(self, vertex_id: int) -> None:
        self.check_if_vertices_exist([vertex_id])

    def check_if_hyperedge_exists(self, hyperedge_id: int) -> None:
        self.check_if_hyperedges_exist([hyperedge_id])

    # Vertices and hyperedges

    def create_vertex(self, data: Any = None) -> int:
        return self.create_vertices([data])[0]

    def create_vertices(self, data_list: Iterable[Any]) -> list[int]:
        ids = []
        for data in data_list:
            self._last_id += 1
            ids.append(self._last_id)
            self._new_vertices.append((self._last_id, data))
            self._known_vertices.add(self._last_id)
        return ids

    def create_hyperedge(self, data: Any = None, weight: int = 1) -> int:
        return self.create_hyperedges([data], [weight])[0]

    def create_hyperedges(self, data_list: Iterable[Any], weights: Sequence[int] | None = None) -> list[int]:
        ids = []
        for k, data in enumerate(data_list):
            self._last_id += 1
            ids.append(self._last_id)
            self._new_hyperedges.append((self._last_id, int(weights[k]) if weights else 1, data))
            self._known_hyperedges.add(self._last_id)
            self._open[self._last_id] = []
            self._rowless.add(self._last_id)
        return ids

    create_vertex_assume_capacity, create_hyperedge_assume_capacity = create_vertex, create_hyperedge

    def _payload(self, df: DataFrame, id_: int) -> Any:
        value = df.where(F.col("id") == id_).select("data").first()["data"]
        return json.loads(value) if isinstance(value, str) else value.asDict(recursive=True) if hasattr(value, "asDict") else value

    def get_vertex(self, vertex_id: int) -> Any:
        self.check_if_vertex_exists(vertex_id)
        return self._payload(self.vertex_frame, vertex_id)

    def get_hyperedge(self, hyperedge_id: int) -> Any:
        self.check_if_hyperedge_exists(hyperedge_id)
        return self._payload(self.hyperedge_frame, hyperedge_id)

    def update_vertex(self, vertex_id: int, data: Any) -> None:
        self.check_if_vertex_exists(vertex_id)
        frame = self.vertex_frame
        self._vertices = frame.withColumn("data", F.when(F.col("id") == vertex_id, self._payload_column(frame, data)).otherwise(F.col("data")))

    def update_hyperedge(self, hyperedge_id: int, data: Any, weight: int | None = None) -> None:
        self.check_if_hyperedge_exists(hyperedge_id)
        here = F.col("id") == hyperedge_id
        df = self.hyperedge_frame
        df = df.withColumn("data", F.when(here, self._payload_column(df, data)).otherwise(F.col("data")))
        self._hyperedges = df if weight is None else df.withColumn("weight", F.when(here, F.lit(weight)).otherwise(F.col("weight")).cast("long"))

    def count_vertices(self) -> int:
        return self.vertex_frame.count()

    def count_hyperedges(self) -> int:
        return self.hyperedge_frame.count()

    def get_all_vertex_ids(self) -> list[int]:
        """All of them, on the driver; ``vertices().limit(n).ids()`` are the first ones only."""
        return _sorted_ids(self.vertex_frame)

    def get_all_hyperedge_ids(self) -> list[int]:
        return _sorted_ids(self.hyperedge_frame)

    # Edits of relations

    def _edited(self, incidence: DataFrame) -> None:
        """Takes new incidences; what was derived follows them, as a reverse index kept up to date."""
        self._incidence = incidence
        if self.is_built:
            self._members, self._pairs = frames.members_of(incidence), frames.pairs_of(incidence)

    def _length(self, hyperedge_id: int) -> int:
        if hyperedge_id in self._open:
            return len(self._open[hyperedge_id])
        return self._incidence.where(F.col("hyperedge_id") == hyperedge_id).count()

    def _inserted(self, hyperedge_id: int, vertex_ids: Sequence[int], index: int | None) -> None:
        """``vertex_ids`` before position ``index``, or at the end."""
        self.check_if_hyperedge_exists(hyperedge_id)
        self.check_if_vertices_exist(vertex_ids)
        members = self._opened(hyperedge_id)
        n = len(members) if members is not None else self._length(hyperedge_id)
        at = n if index is None else index
        if not 0 <= at <= n:
            raise IndexOutOfBoundsError(f"index {at}")
        if members is None:
            self._edited(edits.insert(self.incidence, hyperedge_id, vertex_ids, at))
        else:
            members[at:at] = vertex_ids
            self._grown(len(vertex_ids))

    def append_vertices(self, hyperedge_id: int, vertex_ids: Sequence[int]) -> None:
        if vertex_ids:
            self._inserted(hyperedge_id, vertex_ids, None)

    def prepend_vertices(self, hyperedge_id: int, vertex_ids: Sequence[int]) -> None:
        if vertex_ids:
            self._inserted(hyperedge_id, vertex_ids, 0)

    def insert_vertices(self, hyperedge_id: int, vertex_ids: Sequence[int], index: int) -> None:
        if not vertex_ids:
            raise NotEnoughVerticesError("no vertices to insert")
        self._inserted(hyperedge_id, vertex_ids, index)

    def append_vertex(self, hyperedge_id: int, vertex_id: int) -> None:
        self.append_vertices(hyperedge_id, [vertex_id])

    def prepend_vertex(self, hyperedge_id: int, vertex_id: int) -> None:
        self.prepend_vertices(hyperedge_id, [vertex_id])

    def insert_vertex(self, hyperedge_id: int, vertex_id: int, index: int) -> None:
        self.insert_vertices(hyperedge_id, [vertex_id], index)

    def delete_vertex_from_hyperedge(self, hyperedge_id: int, vertex_id: int) -> None:
        """Removes all occurrences."""
        self._need_build()
        self.check_if_hyperedge_exists(hyperedge_id)
        self.check_if_vertex_exists(vertex_id)
        if (members := self._opened(hyperedge_id)) is not None:
            members[:] = [v for v in members if v != vertex_id]
        else:
            self._edited(edits.remove(self.incidence, (F.col("hyperedge_id") == hyperedge_id) & (F.col("vertex_id") == vertex_id)))

    def delete_vertex_at_index(self, hyperedge_id: int, index: int) -> None:
        self._need_build()
        self.check_if_hyperedge_exists(hyperedge_id)
        members = self._opened(hyperedge_id)
        if not 0 <= index < (len(members) if members is not None else self._length(hyperedge_id)):
            raise IndexOutOfBoundsError(f"index {index}")
        if members is not None:
            del members[index]
        else:
            self._edited(edits.remove(self.incidence, (F.col("hyperedge_id") == hyperedge_id) & (F.col("pos") == index)))

    def delete_hyperedge(self, hyperedge_id: int, *, drop_vertices: bool = False) -> None:
        """``drop_vertices`` deletes all its members too, shared ones among them, from everywhere."""
        self.check_if_hyperedge_exists(hyperedge_id)
        self._forget()
        here = F.col("hyperedge_id") == hyperedge_id
        if drop_vertices:
            gone = self.incidence.where(here).select("vertex_id").distinct()
            self._vertices = self.vertex_frame.join(gone.withColumnRenamed("vertex_id", "id"), "id", "left_anti")
            self._incidence = edits.without_vertices(self._incidence, gone)
        self._hyperedges = self.hyperedge_frame.where(F.col("id") != hyperedge_id)
        self._edited(self.incidence.where(~here))

    def delete_vertex(self, vertex_id: int) -> None:
        self._need_build()
        self.check_if_vertex_exists(vertex_id)
        self._forget()
        self._vertices = self.vertex_frame.where(F.col("id") != vertex_id)
        self._edited(edits.remove(self.incidence, F.col("vertex_id") == vertex_id))

    def reverse_hyperedge(self, hyperedge_id: int) -> None:
        self.check_if_hyperedge_exists(hyperedge_id)
        if (members := self._opened(hyperedge_id)) is not None:
            members.reverse()
        else:
            self._edited(edits.reverse(self.incidence, hyperedge_id, self._length(hyperedge_id)))

    def merge_hyperedges(self, hyperedge_ids: Sequence[int]) -> None:
        """The first takes the positions of all others in turn, which are deleted."""
        if len(hyperedge_ids) < 2:
            raise NotEnoughHyperedgesError("two hyperedges at least")
        self.check_if_hyperedges_exist(hyperedge_ids)
        self._forget()
        ids = list(dict.fromkeys(hyperedge_ids))
        lengths = {r["hyperedge_id"]: r["count"] for r in self.incidence.where(F.col("hyperedge_id").isin(ids)).groupBy("hyperedge_id").count().collect()}
        self._hyperedges = self.hyperedge_frame.where(~F.col("id").isin(ids[1:]))
        self._edited(edits.merge(self.incidence, ids, [lengths.get(i, 0) for i in ids]))

    def split_hyperedge(self, hyperedge_id: int, at: int, data: Any = None) -> int:
        """Positions from ``at`` on go to a new hyperedge, whose id is returned."""
        self._need_build()
        self.check_if_hyperedge_exists(hyperedge_id)
        if not 1 <= at < self._length(hyperedge_id):
            raise IndexOutOfBoundsError(f"index {at}")
        new = self.create_hyperedge(data)
        self._edited(edits.split(self.incidence, hyperedge_id, at, new))
        return new

    def contract_hyperedge(self, hyperedge_id: int) -> None:
        """Its members give way to its last one wherever a pair ends at them, and it is deleted."""
        self._need_build()
        self.check_if_hyperedge_exists(hyperedge_id)
        n = self._length(hyperedge_id)
        if n == 0:
            raise IndexOutOfBoundsError("an empty hyperedge can't be contracted")
        self._forget()
        here = F.col("hyperedge_id") == hyperedge_id
        last = self.incidence.where(here & (F.col("pos") == n - 1)).first()["vertex_id"]
        self._hyperedges = self.hyperedge_frame.where(F.col("id") != hyperedge_id)
        self._edited(edits.contract(self.incidence, self.pairs, hyperedge_id, last))

    def merge_vertices(self, vertex_ids: Sequence[int]) -> None:
        """The first stands for all others everywhere; runs of it that this makes become one; the others are deleted."""
        self._need_build()
        if len(vertex_ids) < 2:
            raise NotEnoughVerticesError("two vertices at least")
        self.check_if_vertices_exist(vertex_ids)
        self._forget()
        others = [v for v in dict.fromkeys(vertex_ids) if v != vertex_ids[0]]
        self._vertices = self.vertex_frame.where(~F.col("id").isin(others))
        self._edited(edits.replace(self.incidence, F.col("vertex_id").isin(others), vertex_ids[0]))

    def split_vertex(self, vertex_id: int, hyperedge_ids: Sequence[int], data: Any = None) -> int:
        """A new vertex, whose id is returned, takes all its places in the given hyperedges."""
        self._need_build()
        self.check_if_vertex_exists(vertex_id)
        if not hyperedge_ids:
            raise NotEnoughHyperedgesError("one hyperedge at least")
        self.check_if_hyperedges_exist(hyperedge_ids)
        new = self.create_vertex(data)
        here = F.col("hyperedge_id").isin(list(hyperedge_ids)) & (F.col("vertex_id") == vertex_id)
        self._edited(self.incidence.withColumn("vertex_id", F.when(here, F.lit(new).cast("long")).otherwise(F.col("vertex_id"))))
        return new

    # Point queries

    def get_hyperedge_vertices(self, hyperedge_id: int) -> list[int]:
        self.check_if_hyperedge_exists(hyperedge_id)
        if hyperedge_id in self._open:
            return list(self._open[hyperedge_id])
        return [r["vertex_id"] for r in self._incidence.where(F.col("hyperedge_id") == hyperedge_id).orderBy("pos").collect()]

    def get_vertex_hyperedges(self, vertex_id: int) -> list[int]:
        self._need_build()
        self.check_if_vertex_exists(vertex_id)
        return [r["hyperedge_id"] for r in self.members.where(F.col("vertex_id") == vertex_id).orderBy("hyperedge_id").collect()]

    def get_vertex_indegree(self, vertex_id: int) -> int:
        self._need_build()
        self.check_if_vertex_exists(vertex_id)
        return self.pairs.where(F.col("dst") == vertex_id).count()

    def get_vertex_outdegree(self, vertex_id: int) -> int:
        self._need_build()
        self.check_if_vertex_exists(vertex_id)
        return self.pairs.where(F.col("src") == vertex_id).count()

    def _adjacency(self, vertex_id: int, to: bool) -> dict[int, list[int]]:
        self._need_build()
        self.check_if_vertex_exists(vertex_id)
        own = self.pairs.where(F.col("dst" if to else "src") == vertex_id)
        return {r["hyperedge_id"]: r["adjacent"] for r in measures.adjacency(own, to=to).orderBy("hyperedge_id").collect()}

    def get_vertex_adjacency_to(self, vertex_id: int) -> dict[int, list[int]]:
        return self._adjacency(vertex_id, True)

    def get_vertex_adjacency_from(self, vertex_id: int) -> dict[int, list[int]]:
        return self._adjacency(vertex_id, False)

    def get_vertex_neighborhood(self, vertex_id: int) -> list[int]:
        """Distinct co-members in the order they are met."""
        self._need_build()
        self.check_if_vertex_exists(vertex_id)
        own = self.members.where(F.col("vertex_id") == vertex_id).select("hyperedge_id")
        met = self.members.join(own, "hyperedge_id", "left_semi").where(F.col("vertex_id") != vertex_id)
        order = met.groupBy("vertex_id").agg(F.min(F.struct("hyperedge_id", "first_pos")).alias("k")).orderBy("k")
        return [r["vertex_id"] for r in order.collect()]

    def get_intersections(self, hyperedge_ids: Sequence[int]) -> list[int]:
        if len(hyperedge_ids) < 2:
            raise NotEnoughHyperedgesError("two hyperedges at least")
        self.check_if_hyperedges_exist(hyperedge_ids)
        wanted = self.spark.createDataFrame([(int(h), k) for k, h in enumerate(hyperedge_ids)], "hyperedge_id long, number long")
        return [r["vertex_id"] for r in measures.intersection(self.members, wanted).orderBy("first_pos").collect()]

    def get_hyperedges_connecting(self, v1_id: int, v2_id: int) -> list[int]:
        self._need_build()
        self.check_if_vertices_exist([v1_id, v2_id])
        return [r["hyperedge_id"] for r in measures.connecting(self.members, v1_id, v2_id).orderBy("hyperedge_id").collect()]

    def get_endpoints(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        rows = measures.endpoints(self.incidence).orderBy("hyperedge_id").collect()
        return [(r["hyperedge_id"], r["initial"]) for r in rows], [(r["hyperedge_id"], r["terminal"]) for r in rows]

    def get_orphan_hyperedges(self) -> list[int]:
        return [r["hyperedge_id"] for r in measures.orphan_hyperedges(self.hyperedge_frame, self.incidence).orderBy("hyperedge_id").collect()]

    def get_orphan_vertices(self) -> list[int]:
        self._need_build()
        return [r["vertex_id"] for r in measures.orphan_vertices(self.vertex_frame, self.incidence).orderBy("vertex_id").collect()]

    def is_k_uniform(self, k: int) -> bool:
        """Whether every hyperedge, empty ones included, has ``k`` positions."""
        self._need_build()
        lengths = measures.size_counts(self.hyperedge_frame, frames.sizes_of(self.incidence))
        return lengths.where(F.col("length") != k).isEmpty()

    # Traversal

    def _start(self, *ids: int) -> None:
        self._need_build()
        self.check_if_vertices_exist(ids)

    def weighted_pairs(self) -> DataFrame:
        return self.pairs.join(self.hyperedge_frame.select(F.col("id").alias("hyperedge_id"), "weight"), "hyperedge_id")

    def find_shortest_path(self, from_id: int, to_id: int) -> list[int] | None:
        self._start(from_id, to_id)
        if from_id == to_id:
            return [from_id]
        row = traversal.shortest_paths(self.weighted_pairs(), from_id, to_id).where(F.col("vertex_id") == to_id).first()
        return row["path"] if row else None

    def bfs(self, start_id: int) -> list[int]:
        self._start(start_id)
        return [r["vertex_id"] for r in traversal.bfs(self.pairs, start_id).orderBy("level", "place").collect()]

    def dfs(self, start_id: int) -> list[int]:
        self._start(start_id)
        return [r["vertex_id"] for r in traversal.dfs(self.pairs, start_id).orderBy("place").collect()]

    def random_walk(self, start_id: int, steps: int, seed: int = 0) -> list[int]:
        self._start(start_id)
        starts = self.spark.createDataFrame([(0, int(start_id))], "walker long, vertex_id long")
        return [r["vertex_id"] for r in traversal.random_walks(self.members, self.hyperedge_frame, starts, steps, seed).orderBy("step").collect()]

    def find_all_paths(self, from_id: int, to_id: int) -> list[list[int]]:
        self._start(from_id, to_id)
        return [r["path"] for r in traversal.all_paths(self.pairs, from_id, to_id).orderBy(F.desc("keys")).collect()]

    def is_reachable(self, from_id: int, to_id: int) -> bool:
        self._start(from_id, to_id)
        start = self.spark.createDataFrame([(int(from_id),)], "vertex_id long")
        return not traversal.reachable(self.pairs, start, to_id).where(F.col("vertex_id") == to_id).isEmpty()

    def get_transitive_closure(self, to_hyperedge: Any = None) -> Hypergraph:
        """A hypergraph with a hyperedge (u, v) for each v that a path of one step or more from u ends at; ids follow
        the largest vertex id. ``to_hyperedge``: a function of two Columns to the payload's."""
        from loomgraph.plans.tables import numbered

        self._need_build()
        base = int(self.vertex_frame.agg(F.max("id")).first()[0] or 0)
        pairs = numbered(traversal.transitive_closure(self.pairs), "src", "dst", name="id", first=base + 1)
        data = to_hyperedge(F.col("src"), F.col("dst")) if to_hyperedge else F.lit("{}")
        edges = pairs.select("id", F.lit(1).cast("long").alias("weight"), data.alias("data"))
        return self._derived(Frames(self.vertex_frame, edges, projections._listed(pairs, "src", "dst")))

    # Algorithms

    def compute_centrality(self) -> dict[int, dict[str, float]]:
        self._need_build()
        rows = ranking.centrality(self.vertex_frame, self.pairs).collect()
        return {r["vertex_id"]: {"degree": r["degree"], "closeness": r["closeness"], "betweenness": r["betweenness"]} for r in rows}

    def page_rank_frame(self, damping: float = 0.85, tolerance: float = 1e-6, max_iterations: int = 100) -> ranking.PageRank:
        self._need_build()
        return ranking.page_rank(self.vertex_frame, self.hyperedge_frame, self.members, damping=damping, tolerance=tolerance, max_iterations=max_iterations)

    def compute_page_rank(self, damping: float = 0.85, tolerance: float = 1e-6, max_iterations: int = 100) -> tuple[dict[int, float], int, bool]:
        got = self.page_rank_frame(damping, tolerance, max_iterations)
        return {r["vertex_id"]: r["score"] for r in got.scores.collect()}, got.iterations, got.converged

    def get_inclusions(self) -> list[tuple[int, int]]:
        self._need_build()
        return [(r["subset"], r["superset"]) for r in subsets.inclusions(self.members).orderBy("subset", "superset").collect()]

    def get_nestedness_profile(self) -> list[dict]:
        self._need_build()
        return [r.asDict() for r in subsets.nestedness(self.members).orderBy("size").collect()]

    def has_cycle(self) -> bool:
        self._need_build()
        return structure.has_cycle(self.vertex_frame, self.pairs)

    def topological_sort(self) -> list[int]:
        self._need_build()
        return [r["vertex_id"] for r in structure.topological_order(self.vertex_frame, self.pairs).orderBy("level", "place").collect()]

    def is_connected(self) -> bool:
        self._need_build()
        return structure.is_connected(self.vertex_frame, self.members)

    def component_frame(self) -> DataFrame:
        self._need_build()
        return structure.connected_components(self.vertex_frame, self.members)

    def get_connected_components(self) -> list[list[int]]:
        groups: dict[int, list[int]] = {}
        for r in self.component_frame().orderBy("component", "vertex_id").collect():
            groups.setdefault(r["component"], []).append(r["vertex_id"])
        return list(groups.values())

    def find_cut_vertices(self) -> list[int]:
        self._need_build()
        return [r["vertex_id"] for r in structure.cut_vertices(self.members).orderBy("vertex_id").collect()]

    # Projections

    def _derived(self, f: Frames) -> Hypergraph:
        return Hypergraph(self.spark, f)

    def get_dual(self, to_vertex: Column | None = None, to_hyperedge: Column | None = None) -> Hypergraph:
        self._need_build()
        return self._derived(projections.dual(self.frames, to_vertex, to_hyperedge))

    def get_k_skeleton(self, k: int) -> Hypergraph:
        self._need_build()
        return self._derived(projections.k_skeleton(self.frames, k))

    def expand_to_graph(self) -> Hypergraph:
        self._need_build()
        return self._derived(projections.expand_to_graph(self.frames))

    def expand_to_star(self, to_vertex: Column | None = None) -> Hypergraph:
        self._need_build()
        return self._derived(projections.expand_to_star(self.frames, to_vertex))

    def get_line_graph(self, to_vertex: Column | None = None, data: Column | None = None, weight: int = 1) -> Hypergraph:
        self._need_build()
        return self._derived(projections.line_graph(self.frames, to_vertex, data, weight))

    def _id_frame(self, ids: Sequence[int]) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")

    def get_vertex_induced_subhypergraph(self, vertex_ids: Sequence[int]) -> Hypergraph:
        self._start(*vertex_ids)
        return self._derived(projections.vertex_induced(self.frames, self._id_frame(vertex_ids)))

    def get_edge_induced_subhypergraph(self, hyperedge_ids: Sequence[int]) -> Hypergraph:
        self._need_build()
        self.check_if_hyperedges_exist(hyperedge_ids)
        return self._derived(projections.edge_induced(self.frames, self._id_frame(hyperedge_ids)))

    def get_core(self, s: int, t: int) -> Hypergraph:
        self._need_build()
        v, h = structure.core(self.members, self.hyperedge_frame, self.vertex_frame, s, t)
        kept = self.incidence.join(v, "vertex_id", "left_semi").join(h, "hyperedge_id", "left_semi")
        f = Frames(self.vertex_frame.join(v.withColumnRenamed("vertex_id", "id"), "id", "left_semi"), self.hyperedge_frame.join(h.withColumnRenamed("hyperedge_id", "id"), "id", "left_semi"), frames.reranked(kept))
        return self._derived(f)

    # Matrices

    def to_incidence_matrix_coo(self) -> dict:
        rows = matrices.incidence_coo(self.vertex_frame, self.hyperedge_frame, self.members).orderBy("col", "row").collect()
        return {"rows": [r["row"] for r in rows], "cols": [r["col"] for r in rows], "vertex_ids": self.get_all_vertex_ids(), "hyperedge_ids": self.get_all_hyperedge_ids()}

    def to_incidence_matrix(self) -> dict:
        coo = self.to_incidence_matrix_coo()
        data = [[0] * len(coo["hyperedge_ids"]) for _ in coo["vertex_ids"]]
        for r, c in zip(coo["rows"], coo["cols"]):
            data[r][c] = 1
        return {"data": data, "vertex_ids": coo["vertex_ids"], "hyperedge_ids": coo["hyperedge_ids"]}

    def laplacian_frame(self, normalized: bool = True) -> DataFrame:
        return matrices.laplacian(self.vertex_frame, self.hyperedge_frame, self.members, normalized=normalized)

    def to_laplacian(self, normalized: bool = True) -> dict:
        ids = self.get_all_vertex_ids()
        at = {v: i for i, v in enumerate(ids)}
        data = [[0.0] * len(ids) for _ in ids]
        for r in self.laplacian_frame(normalized).collect():
            data[at[r["row_id"]]][at[r["col_id"]]] = r["value"]
        return {"data": data, "vertex_ids": ids}

    # Fluent queries

    def vertices(self) -> VertexQuery:
        return VertexQuery(self)

    def hyperedges(self) -> HyperedgeQuery:
        return HyperedgeQuery(self)
