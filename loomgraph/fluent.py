"""Fluent queries over vertices and hyperedges: each call returns a new query, a terminal call runs it."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from loomgraph.graph import Hypergraph

Predicate = Column | str | Callable[[Any], bool]


def _condition(predicate: Predicate) -> Column:
    """A Column or SQL text over id and data stays with the optimiser; a function of the payload runs in Python."""
    if isinstance(predicate, Column):
        return predicate
    if isinstance(predicate, str):
        return F.expr(predicate)

    def holds(data):  # without type hints, by which Spark would choose another kind of function
        if isinstance(data, pd.DataFrame):
            values = (Row(**r) for r in data.to_dict("records"))
        else:
            values = (json.loads(x) if isinstance(x, str) else x for x in data)
        return pd.Series([bool(predicate(x)) for x in values], dtype=bool)

    return F.pandas_udf(holds, "boolean", F.PandasUDFType.SCALAR)(F.col("data"))


class _Query:
    def __init__(self, graph: Hypergraph, ids: DataFrame | None = None, predicates: tuple[Predicate, ...] = (), n: int | None = None) -> None:
        self._graph, self._ids, self._predicates, self._n = graph, ids, predicates, n

    def _with(self, **changed: Any) -> Any:
        return type(self)(self._graph, **({"ids": self._ids, "predicates": self._predicates, "n": self._n} | changed))

    def _rows(self) -> DataFrame:
        raise NotImplementedError

    def where(self, predicate: Predicate) -> Any:
        """All predicates must hold. A Column such as ``get_json_object("data", "$.age") > 30`` is pushed down."""
        return self._with(predicates=(*self._predicates, predicate))

    def limit(self, n: int) -> Any:
        """At most ``n`` rows by id; the last limit wins."""
        return self._with(n=n)

    def frame(self) -> DataFrame:
        """The matching rows, lazily."""
        df = self._rows() if self._ids is None else self._rows().join(self._ids, "id", "left_semi")
        for p in self._predicates:
            df = df.where(_condition(p))
        return df if self._n is None else df.orderBy("id").limit(self._n)

    def ids(self) -> list[int]:
        return [r["id"] for r in self.frame().select("id").orderBy("id").collect()]

    def data(self) -> list[Any]:
        return [json.loads(r["data"]) if isinstance(r["data"], str) else r["data"] for r in self.frame().orderBy("id").select("data").collect()]


class VertexQuery(_Query):
    def _rows(self) -> DataFrame:
        return self._graph.vertex_frame

    def neighbors(self) -> VertexQuery:
        """The vertices that share a hyperedge with one of the current ids; predicates so far apply after this step."""
        self._graph._need_build()
        members = self._graph.members.select("hyperedge_id", "vertex_id")
        own = members if self._ids is None else members.join(self._ids.withColumnRenamed("id", "vertex_id"), "vertex_id", "left_semi")
        met = own.withColumnRenamed("vertex_id", "from_id").join(members, "hyperedge_id").where("vertex_id <> from_id")
        return self._with(ids=met.select(F.col("vertex_id").alias("id")).distinct())


class HyperedgeQuery(_Query):
    def _rows(self) -> DataFrame:
        return self._graph.hyperedge_frame

    def containing(self, vertex_id: int) -> HyperedgeQuery:
        """Only hyperedges that hold the vertex; none if there is no such vertex. Needs no build."""
        own = self._graph.incidence.where(F.col("vertex_id") == vertex_id).select(F.col("hyperedge_id").alias("id")).distinct()
        return self._with(ids=own if self._ids is None else self._ids.join(own, "id", "left_semi"))
