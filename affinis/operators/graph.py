"""Connected components and cluster edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..plans.ranking import dense_ids
from ..plans.storage import stash


#: A graph of at most so many edges is finished by one task instead of in rounds.
ONE_TASK = 200_000


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every end of an edge the least one of its component."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            parent[max(x, y)] = min(x, y)
    ends = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array([find(x) for x in ends], pa.binary())], names=["at", "to"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component``, the least node of its component, for all
    nodes of an undirected edge list. Edges with a null end are left out; a self
    loop makes a component of one.

    Every round replaces a node by the one of least hash among itself and its
    neighbours and keeps the edges between the replacements, until none is left.
    Hashes make the order random, so chains shrink by a constant factor a round.
    """
    # written once, as edges that are computed again may be others
    plain = stash(edges.select(col(src).alias("a"), col(dst).alias("b")).where("a is not null and b is not null"), "plain")
    names = stash(plain.select(F.col("a").alias("n")).union(plain.select("b")).distinct(), "nodes")

    def digest(c: str) -> F.Column:
        return F.unhex(F.md5(F.col(c).cast("string")))

    ends = plain.where("a <> b").select(digest("a").alias("a"), digest("b").alias("b"))
    rest = stash(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = names.select("n", digest("n").alias("at"))
    while (left := rest.count()) > 0:
        if left <= ONE_TASK:
            least = rest.select("a", "b").coalesce(1).mapInArrow(_roots, "at binary, to binary")
        else:
            both = rest.union(rest.select("b", "a"))
            least = stash(both.groupBy(F.col("a").alias("at")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "least")
        label = stash(label.join(least, "at", "left").select("n", F.coalesce("to", "at").alias("at")), "labels")
        if left <= ONE_TASK:
            break
        x, y = least.select(F.col("at").alias("a"), F.col("to").alias("x")), least.select(F.col("at").alias("b"), F.col("to").alias("y"))
        rest = stash(rest.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    least_names = label.groupBy("at").agg(F.min("n").alias("component"))
    return label.join(least_names, "at").select(F.col("n").alias("node"), "component")


def clusters_from_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``cluster`` (from 0, by the least node) and its sorted ``nodes``."""
    found = connected_components(edges, src, dst)
    numbers = dense_ids(found, ["component"], "cluster")
    return found.join(numbers, "component").groupBy("cluster").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def edges_from_clusters(clusters: DataFrame, cluster: str = "cluster", node: str = "node") -> DataFrame:
    """All unordered pairs ``src`` < ``dst`` of distinct nodes of one cluster."""
    one = clusters.select(col(cluster).alias("c"), col(node).alias("src")).where("c is not null and src is not null").distinct()
    other = one.select("c", F.col("src").alias("dst"))
    return one.join(other, "c").where("src < dst").select(F.col("c").alias("cluster"), "src", "dst")
