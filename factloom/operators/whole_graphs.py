"""Graphs that fit in memory, many of them in one pass: no rounds over the corpus.

A pipeline or a run is nearly always a graph of some dozens of edges. Its rows meet in one task, which settles node after node:
every node counts the inputs it still waits for, an edge is read once, when its source settles, and takes one from its
target's count. Only graphs of more than ``LIMIT`` rows are left to the operators that work in rounds.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.session import growing

#: rows of a graph that one task takes into memory
LIMIT = 50_000


def divide(rows: DataFrame, by: list[str], limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """The rows of graphs of up to ``limit`` rows, and those of larger ones (None if there are none)."""
    large = rows.groupBy(*by).count().filter(F.col("count") > limit).drop("count")
    first = large.limit(1).collect()
    if not first:
        return rows, None
    if not by:
        return rows.limit(0), rows
    return rows.join(growing(large), by, "left_anti"), rows.join(growing(large), by, "left_semi")


def solve(rows: DataFrame, by: list[str], solver: Callable[[list[tuple]], Iterator[tuple]], columns: str) -> DataFrame:
    """``solver`` gives rows of ``columns`` (DDL) from the rows of one graph, as tuples without the keys; both get the keys here."""
    given = [c for c in rows.columns if c not in by]
    # The partitioning by key is all that brings a graph together; several graphs follow each other in a task.
    dealt = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, *given)
    schema = StructType([rows.schema[k] for k in by] + list(StructType.fromDDL(columns)))
    return dealt.select(*by, *given).mapInArrow(functools.partial(_solved, width=len(by), solver=solver, schema=to_arrow_schema(schema)), schema)


def _solved(batches, width: int, solver, schema: pa.Schema):
    def graphs():
        key, held = None, []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and row[:width] != key:
                    yield key, held
                    held = []
                key = row[:width]
                held.append(row[width:])
        if held:
            yield key, held

    part = []
    for key, rows in graphs():
        part.extend(key + row for row in solver(rows))
        if len(part) >= LIMIT:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def levels(rows: list[tuple]) -> Iterator[tuple]:
    """(id, depth, None, None) of settled targets of the edges (src, dst), and (None, None, src, dst) of edges on or behind a cycle."""
    below, waits = {}, {}
    for src, dst in rows:
        below.setdefault(src, []).append(dst)
        waits[dst] = waits.get(dst, 0) + 1
    frontier, depth = [n for n in below if n not in waits], {}
    while frontier:
        reached = []
        for node in frontier:
            for dst in below.pop(node, ()):
                depth[dst] = max(depth.get(dst, 0), depth.get(node, 0) + 1)
                waits[dst] -= 1
                if not waits[dst]:
                    reached.append(dst)
        frontier = reached
    for node, n in depth.items():
        if not waits[node]:
            yield node, n, None, None
    for src, targets in below.items():
        for dst in targets:
            yield None, None, src, dst


def first_ready(rows: list[tuple]) -> Iterator[tuple]:
    """(name, idx, position): always the first ready activity by idx; those on or behind a cycle last.

    ``rows``: (idx, name, None) of activities and (None, name, depends_on) of dependencies between them.
    """
    places, below, waits = {}, {}, {}
    for idx, name, above in rows:
        if idx is not None:
            places.setdefault(name, []).append(idx)
        else:
            below.setdefault(above, []).append(name)
            waits[name] = waits.get(name, 0) + 1
    ready = [(idx, name) for name, own in places.items() if name not in waits for idx in own]
    heapq.heapify(ready)
    position, left = 0, {name: len(own) for name, own in places.items()}
    while ready:
        idx, name = heapq.heappop(ready)
        position += 1
        yield name, idx, position
        left[name] -= 1
        if left[name]:
            continue
        for dst in below.get(name, ()):
            waits[dst] -= 1
            if not waits[dst]:
                for own in places[dst]:
                    heapq.heappush(ready, (own, dst))
    for idx, name in sorted((idx, name) for name, own in places.items() if left[name] for idx in own):
        position += 1
        yield name, idx, position
