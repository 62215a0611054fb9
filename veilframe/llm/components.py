"""Connected components of a graph given as a DataFrame of links, by alternating star contractions; of a graph that one task holds, in
that task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_texts, materialize

EDGES_PER_TASK = 200_000


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): label is the least id reachable.

    Large-star links every greater neighbour to the least one, small-star every lesser; both keep the components and end in
    stars. Every round is one pre-aggregated minimum and one join by id, and is checkpointed. The rounds run over as many partitions as
    the number of links asks for, so that a small graph doesn't leave thousands of tiny files. Up to ``EDGES_PER_TASK`` different links
    between numbers are a single partition; the rounds' dozens of jobs would cost the driver more than the graph, so one task takes it whole.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    parts = max(1, -(-edges.count() // EDGES_PER_TASK))
    if parts == 1 and dict(edges.dtypes) == {"a": "bigint", "b": "bigint"}:
        return materialize(map_texts(edges.coalesce(1), contract, "id long, label long"))
    while True:
        edges = edges.coalesce(parts)
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m").coalesce(parts)
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = materialize(edges.coalesce(parts))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionAll(roots)


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label) of all the links (a, b) that come."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if found:
        ids, label = least_reachable(*(np.concatenate(c) for c in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], names=["id", "label"])


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of the links, ascending, and the least id that each reaches: linked roots hang themselves on the least of their
    neighbours, and ids on their roots, until every link lies under one root."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        if np.array_equal(rx, ry):
            return ids, ids[root]
        low = np.minimum(rx, ry)
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while not np.array_equal(up := root[root], root):
            root = up
