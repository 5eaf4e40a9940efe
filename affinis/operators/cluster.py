"""Clustering of rows by their keys, and de-duplication by clusters.

Density clustering is relational: counts of neighbours, links, components; of
vectors no list of all near pairs is made. A single-linkage cut is the components
of the links. With average linkage and cosines, clusters are the means of their
vectors, and all pairs that are each other's nearest merge in one round. Other
agglomerative cuts are exact inside the components of the graph of pairs nearer
than the threshold, as no cluster can reach across them. HDBSCAN grows its minimum
spanning tree in rounds; the tree, of one edge a row, is read by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..functions.names import col
from ..functions.text import SEPARATOR
from ..plans import similarity
from ..plans.ranking import dense_ids
from ..plans.storage import stash
from .embed import Embedder, Encoder, Ngrams, Precomputed
from .graph import connected_components
from .linkage import LEFT, RIGHT, Keys, _listed, matches, with_row_ids

DEFAULTS = {
    "agglomerative": {"threshold": 0.5, "clustering linkage": "ward", "metric": "euclidean"},
    "HDBScan": {"min cluster size": 5, "min samples": 1},
    "SLINK": {"min cluster size": 2, "threshold": 0.1, "metric": "cosine"},
}


def parameters(cluster_type: str, given: dict | None = None) -> dict:
    """The given parameters, and the defaults of those that are missing; the
    caller's dictionary stays as it is."""
    if cluster_type not in DEFAULTS:
        raise ValueError(f"unknown clustering {cluster_type!r}; there are {sorted(DEFAULTS)}")
    return DEFAULTS[cluster_type] | (given or {})


def _least_score(eps: float, metric: str) -> float:
    """The cosine at a distance; euclidean distances are between unit vectors."""
    if metric == "cosine":
        return round(1 - eps, similarity.DIGITS)
    if metric == "euclidean":
        return round(1 - eps * eps / 2, similarity.DIGITS)
    raise ValueError(f"unknown metric {metric!r}")


def near_pairs(df: DataFrame, on: Keys, embedder: Embedder, least: float, id: str, sep: str = SEPARATOR) -> DataFrame:
    """(left_id, right_id, score) of all rows, themselves included, with a score of at least ``least``."""
    keys = _listed(on)
    a = with_row_ids(df, LEFT, id)
    b = with_row_ids(df, RIGHT, id)
    return matches(a, b, keys, keys, embedder, None, least, sep=sep)


def dbscan(pairs: DataFrame, rows: DataFrame, id: str, min_samples: int) -> DataFrame:
    """``id``, ``cluster`` from neighbour pairs (both directions, self included
    or not). A core point has ``min_samples`` neighbours with itself. Clusters
    are numbered by their least core id; a border point joins the lowest of its
    neighbours' clusters; noise is -1."""
    near = stash(pairs.where("left_id <> right_id").select("left_id", "right_id"), "near")
    core = stash(near.groupBy("left_id").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("left_id").alias("node")), "core")
    if min_samples <= 1:
        core = rows.select(col(id).alias("node")).distinct()
    inner = near.join(core.withColumnRenamed("node", "left_id"), "left_id", "left_semi").join(core.withColumnRenamed("node", "right_id"), "right_id", "left_semi")
    lone = core.select(F.col("node").alias("left_id"), F.col("node").alias("right_id"))
    component = connected_components(inner.select("left_id", "right_id").union(lone), "left_id", "right_id")
    numbers = dense_ids(component, ["component"], "cluster")
    cores = stash(component.join(numbers, "component").select("node", "cluster"), "cores")
    border = near.join(cores.select(F.col("node").alias("right_id"), "cluster"), "right_id").groupBy(F.col("left_id").alias("node")).agg(F.min("cluster").alias("border"))
    return (
        rows.select(col(id).alias("node")).distinct().join(cores, "node", "left").join(border, "node", "left")
        .select(F.col("node").alias(id), F.coalesce("cluster", "border", F.lit(-1)).cast("int").alias("cluster"))
    )


def hac(distance: np.ndarray, threshold: float, linkage: str, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of an agglomerative cut: merges at a distance below the threshold.
    ``ward`` takes euclidean distances. Of equal distances the least pair of
    members goes first. ``sizes`` are those of the clusters that there are."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label, size = np.arange(n), np.ones(n) if sizes is None else sizes.astype(float)
    # every row's nearest of those after it; only rows that a merge touches look again
    near = np.array([i + 1 + int(np.argmin(d[i, i + 1 :])) if i + 1 < n else i for i in range(n)], int)
    least = d[np.arange(n), near]
    while n > 1:
        i = int(np.argmin(least))
        j = int(near[i])
        if not least[i] < threshold:
            break
        a, b, ab = d[i], d[j], d[i, j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif linkage == "ward":
            with np.errstate(invalid="ignore"):
                new = np.sqrt(((size[i] + size) * a**2 + (size[j] + size) * b**2 - size * ab**2) / (size[i] + size[j] + size))
        else:
            raise ValueError(f"unknown linkage {linkage!r}")
        new[np.isinf(a) | np.isinf(b)] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        label[label == j] = i
        least[j] = np.inf
        again = np.flatnonzero((near == i) | (near == j))
        for k in {i, *again[again != j].tolist()}:
            if k + 1 < n:
                near[k] = k + 1 + int(np.argmin(d[k, k + 1 :]))
                least[k] = d[k, near[k]]
        closer = np.flatnonzero((d[:i, i] < least[:i]) | ((d[:i, i] == least[:i]) & (i < near[:i])))
        near[closer], least[closer] = i, d[closer, i]
    return label


def hdbscan(x: np.ndarray, min_cluster_size: int, min_samples: int) -> np.ndarray:
    """Labels by density at all scales: mutual reachability, minimum spanning
    tree, condensed tree, clusters of most excess of mass; -1 is noise."""
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)) if n <= 512 else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    near, source, done, edges = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool), []
    done[0] = True
    for _ in range(n - 1):
        near[done] = np.inf
        k = int(np.argmin(near))
        edges.append((near[k], int(source[k]), k))
        done[k] = True
        closer = (reach[k] < near) & ~done
        near[closer], source[closer] = reach[k][closer], k
    return densest(edges, n, min_cluster_size)


def densest(edges: list[tuple[float, int, int]], n: int, min_cluster_size: int) -> np.ndarray:
    """Labels from the edges (length, end, end) of a spanning tree of ``n`` rows;
    edges that close a circle are left out."""
    # single-linkage tree
    parent, node, size = list(range(2 * n - 1)), list(range(n)), [1] * n + [0] * (n - 1)
    children: dict[int, tuple[int, int, float]] = {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    k = 0
    for w, a, b in sorted(edges):
        a, b, new = find(a), find(b), n + k
        if a == b:
            continue
        k += 1
        children[new] = (a, b, w)
        size[new] = size[a] + size[b]
        parent[a] = parent[b] = new

    def leaves(top: int) -> list[int]:
        out, todo = [], [top]
        while todo:
            i = todo.pop()
            if i < n:
                out.append(i)
            else:
                todo += children[i][:2]
        return out

    # condensed tree: clusters with their birth, their node of the tree, and children
    clusters = [{"birth": 0.0, "mass": 0.0, "kids": [], "top": 2 * n - 2}]
    todo = [(2 * n - 2, 0)]
    while todo:
        top, c = todo.pop()
        while top >= n:
            a, b, w = children[top]
            level = 1 / w if w > 0 else 1e12
            big = [x for x in (a, b) if size[x] >= min_cluster_size]
            if len(big) == 2:
                clusters[c]["mass"] += size[top] * (level - clusters[c]["birth"])
                for x in big:
                    clusters.append({"birth": level, "mass": 0.0, "kids": [], "top": x})
                    clusters[c]["kids"].append(len(clusters) - 1)
                    todo.append((x, len(clusters) - 1))
                break
            if not big:
                clusters[c]["mass"] += size[top] * (level - clusters[c]["birth"])
                break
            lost = b if big[0] == a else a
            clusters[c]["mass"] += size[lost] * (level - clusters[c]["birth"])
            top = big[0]
    chosen = [False] * len(clusters)
    best = [0.0] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(best[k] for k in clusters[c]["kids"])
        chosen[c] = c > 0 and clusters[c]["mass"] >= below
        best[c] = clusters[c]["mass"] if chosen[c] else below
    label = np.full(n, -1)
    todo = [0]
    while todo:
        c = todo.pop()
        if chosen[c]:
            points = leaves(clusters[c]["top"])
            label[points] = min(points)
        else:
            todo += clusters[c]["kids"]
    return label


#: HDBSCAN of at most so many rows is done by one task.
WHOLE_ROWS = 4096
#: Neighbours of a row that the first rounds of its spanning tree go by.
LISTED = 16


def _listed_rounds(at: np.ndarray, to: np.ndarray, score: np.ndarray, n: int, samples: int) -> tuple[np.ndarray, list, np.ndarray]:
    """From every row's nearest neighbours (of best score first): the bounds of
    their reach, the edges that a component's best one can be told by, and the
    components that these make."""
    order = np.lexsort((to, -score, at))
    k = len(at) // n
    to, score = to[order].reshape(n, k), score[order].reshape(n, k)
    core = score[:, min(samples, k) - 1].copy() if samples > 0 else np.ones(n)
    reach = np.minimum(np.minimum(score, core[:, None]), core[to])
    beyond = np.minimum(score[:, -1], core) if k < n - 1 else np.full(n, -np.inf)
    root, edges, own = np.arange(n), [], np.arange(n)
    while True:
        r = np.where(root[to] != root[:, None], reach, -np.inf)
        best = r.max(1)
        end = np.where(r == best[:, None], to, n).min(1)
        order = np.lexsort((np.maximum(own, end), np.minimum(own, end), -best, root))
        first = order[np.r_[True, np.diff(root[order]) != 0]]
        bound = np.full(n, -np.inf)
        np.maximum.at(bound, root, beyond)
        first = first[best[first] > bound[root[first]]]
        if not len(first):
            return core, edges, root
        edges.append((first, end[first], best[first]))
        similarity.joined(root, [(np.concatenate([first, end[first]]), np.tile(np.arange(len(first)), 2))])


def _spanning_edges(items: DataFrame, samples: int, n: int) -> DataFrame:
    """(a, b, w) of a minimum spanning tree under mutual reachability of ``i``
    (from 0) and ``v``. The best edge out of a component belongs to it; so in every
    round all components but the largest look for theirs."""
    def state(df: DataFrame, component, core) -> DataFrame:
        return df.select(F.col("i").alias("id"), F.lit("").alias("block"), F.concat(F.array(component.cast("double"), core.cast("double")), "v").alias("v"))

    size = F.size("v") * F.lit(8)
    every = state(items, F.col("i"), F.lit(2.0))
    nearest = similarity.streamed(every, every, similarity.Reach(), size, "best", min(max(samples, LISTED), n - 1))

    def begin(part: pd.DataFrame) -> pd.DataFrame:
        core, edges, root = _listed_rounds(part["left_id"].to_numpy(), part["right_id"].to_numpy(), part["score"].to_numpy(), n, samples)
        rows = [pd.DataFrame({"a": np.arange(n), "b": root, "w": core, "edge": False})]
        return pd.concat(rows + [pd.DataFrame({"a": a, "b": b, "w": w, "edge": True}) for a, b, w in edges])

    schema = "a long, b long, w double, edge boolean"
    start = stash(nearest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda part: begin(part), schema), "spanning")
    edges = start.where("edge").select("a", "b", "w")
    known = start.where("not edge").select(F.col("a").alias("i"), F.col("b").alias("component"), F.col("w").alias("core"))
    while len(most := known.groupBy("component").count().orderBy(F.desc("count"), "component").limit(2).collect()) > 1:
        placed = items.join(known, "i")
        rights = state(placed, F.col("component"), F.col("core"))
        lefts = state(placed.where(F.col("component") != most[0]["component"]), F.col("component"), F.col("core"))
        found = similarity.streamed(lefts, rights, similarity.Reach(), size, "best", 1)
        ends = found.join(known.select(F.col("i").alias("left_id"), "component"), "left_id").join(known.select(F.col("i").alias("right_id"), F.col("component").alias("other")), "right_id")
        edge = F.struct((-F.col("score")).alias("s"), F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), "other")
        best = stash(ends.groupBy("component").agg(F.min(edge).alias("e")).select("component", "e.other", "e.a", "e.b", (-F.col("e.s")).alias("w")), "best-edges")
        edges = stash(edges.union(best.select("a", "b", "w")), "spanning")
        to = connected_components(best.select("component", "other"), "component", "other").select(F.col("node").alias("component"), F.col("component").alias("to"))
        known = stash(known.join(to, "component", "left").select("i", F.coalesce("to", "component").alias("component"), "core"), "components")
    return edges


def _whole_hdbscan(rows: DataFrame, n: int, size: int, samples: int) -> DataFrame:
    """``node`` and ``label`` of more rows than one task compares. Where distances
    are equal, as with more than one sample, the tree is another one of equal
    length than in one task, and labels that hang on such a choice may differ."""
    unit = rows.select("node", vectors.normalise(F.col("v")).alias("v"))
    items = stash(unit.join(dense_ids(rows, ["node"], "i"), "node"), "numbered")
    edges = _spanning_edges(items, samples, n)

    def read(part: pd.DataFrame) -> pd.DataFrame:
        w = np.sqrt(np.maximum(2 - 2 * part["w"].to_numpy(), 0))
        label = densest(list(zip(w.tolist(), part["a"].tolist(), part["b"].tolist())), n, size)
        return pd.DataFrame({"i": np.arange(n), "label": label.astype(str)})

    found = edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda part: read(part), "i long, label string")
    return items.select("node", "i").join(found, "i").select("node", "label")


def _vectors(df: DataFrame, on: list[str], embedder: Embedder, id: str) -> DataFrame:
    if isinstance(embedder, Precomputed):
        return df.select(col(id).alias("node"), col(embedder.column).cast("array<double>").alias("v"))
    if isinstance(embedder, Encoder):
        from ..functions.text import serialize

        return df.select(col(id).alias("node"), embedder.column(serialize(on)).alias("v"))
    raise ValueError("this clustering needs dense vectors: precomputed ones or an encoder")


def _items(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("node").alias("id"), F.lit("").alias("block"), "v")


def dense_dbscan(rows: DataFrame, least: float, min_samples: int) -> DataFrame:
    """``dbscan`` of ``node``, ``v`` without a list of near pairs: neighbours are
    counted, core points linked, and only points that are none are paired."""
    items = _items(rows)
    nodes = rows.select("node").distinct()
    if min_samples <= 2:  # every point with a neighbour is a core point
        links = stash(similarity.dense(items, items, None, least, mode="links", apart=True).select("left_id", "right_id"), "links")
        core = links.select(F.col("left_id").alias("node")).union(links.select("right_id")).distinct() if min_samples == 2 else nodes
        border = None
    else:
        counts = stash(similarity.dense(items, items, None, least, mode="count", apart=True).select(F.col("left_id").alias("id"), F.col("score").alias("n")), "counts")
        core = counts.where(F.col("n") + 1 >= min_samples).select(F.col("id").alias("node"))
        inner = items.join(core.withColumnRenamed("node", "id"), "id", "left_semi")
        links = similarity.dense(inner, inner, None, least, mode="links", apart=True).select("left_id", "right_id")
        outer = items.join(counts.where((F.col("n") > 0) & (F.col("n") + 1 < min_samples)).select("id"), "id", "left_semi")
        border = similarity.dense(outer, inner, None, least).select("left_id", F.col("right_id").alias("node"))
    lone = core.select(F.col("node").alias("left_id"), F.col("node").alias("right_id"))
    component = connected_components(links.union(lone), "left_id", "right_id")
    cores = stash(component.join(dense_ids(component, ["component"], "cluster"), "component").select("node", "cluster"), "cores")
    found = cores
    if border is not None:
        found = cores.union(border.join(cores, "node").groupBy(F.col("left_id").alias("node")).agg(F.min("cluster").alias("cluster")))
    return nodes.join(found, "node", "left").select("node", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


#: Clusters of average linkage that one task finishes.
FINISH = 4096


def _average(rows: DataFrame, threshold: float) -> DataFrame:
    """``node`` and the least node of its cluster, ``label``, by average linkage of
    cosines. The mean cosine of two clusters is the product of their mean vectors,
    and a merge brings no two clusters nearer than the nearer one was; so all pairs
    that are each other's nearest may merge at once, and a cluster without one
    nearer than the threshold is done."""
    unit = rows.withColumn("v", vectors.normalise(F.col("v")))
    # equal vectors are one cluster from the start
    label = stash(unit.select("node", F.min("node").over(Window.partitionBy("v")).alias("label"), "v"), "labels") if threshold > 0 else stash(unit.withColumn("label", F.col("node")), "labels")
    active = stash(label.groupBy("label").agg(F.count("*").cast("double").alias("n"), F.min("v").alias("v")), "clusters")
    label = label.select("node", "label")
    while (left := active.count()) > FINISH:
        items = active.select(F.col("label").alias("id"), F.lit("").alias("block"), "v")
        near = similarity.dense(items, items, 1, 1 - threshold - 1e-9, unit=False, digits=12, apart=True)
        near = stash(near.where(1 - F.col("score") < threshold), "nearest")
        back = near.select(F.col("left_id").alias("right_id"), F.col("right_id").alias("left_id"))
        pairs = near.join(back, ["left_id", "right_id"], "left_semi").where("left_id < right_id").select("left_id", "right_id")
        pairs = stash(pairs, "merges")
        if pairs.isEmpty():
            best = near.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "score")
            pairs = best.orderBy(F.desc("score"), "left_id", "right_id").limit(1).select("left_id", "right_id")
            if near.isEmpty():
                return label
        to = stash(pairs.select(F.col("right_id").alias("label"), F.col("left_id").alias("to")), "merged")
        label = stash(label.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        near = near.select(F.col("left_id").alias("label"))
        # a mean of unit vectors by the sizes of both sides
        parts = active.join(near.union(to.select("label")).union(to.select("to")).distinct(), "label", "left_semi").join(to, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        own = parts.groupBy("label").agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "v")).alias("p"))
        mean = F.when(F.size("p") == 1, F.col("p")[0]["v"]).otherwise(F.zip_with(F.col("p")[0]["v"], F.col("p")[1]["v"], lambda x, y: (x * F.col("p")[0]["n"] + y * F.col("p")[1]["n"]) / F.col("n")))
        active = stash(own.select("label", "n", mean.alias("v")), "clusters")
    if not left:
        return label

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("label")
        x = np.stack(part["v"].to_numpy())
        to = hac(1 - x @ x.T, threshold, "average", part["n"].to_numpy())
        return pd.DataFrame({"label": part["label"], "to": part["label"].to_numpy()[to]})

    kind = active.schema["label"].dataType
    schema = T.StructType([T.StructField("label", kind), T.StructField("to", kind)])
    last = stash(active.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(finish, schema), "merged")
    return label.join(last, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _numbered(labels: DataFrame, id: str) -> DataFrame:
    """Numbers clusters by their least row; ``label`` -1 is noise."""
    least = labels.where("label <> '-1'").groupBy("label").agg(F.min("node").alias("first"))
    numbers = dense_ids(least, ["first"], "cluster")
    known = least.join(numbers, "first").select("label", "cluster")
    return labels.join(known, "label", "left").select(F.col("node").alias(id), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def cluster_labels(df: DataFrame, on: Keys, embedder: Embedder, cluster_type: str, cluster_params: dict | None, id: str) -> DataFrame:
    """``id``, ``cluster`` of every row; ids are unique and not null."""
    p, keys = parameters(cluster_type, cluster_params), _listed(on)
    if cluster_type == "SLINK":
        least = _least_score(p["threshold"], p["metric"])
        if not isinstance(embedder, Ngrams):
            rows = _vectors(df, keys, embedder, id)
            return dense_dbscan(rows if isinstance(embedder, Precomputed) else stash(rows, "vectors"), least, p["min cluster size"]).withColumnRenamed("node", id)
        return dbscan(near_pairs(df, keys, embedder, least, id), df, id, p["min cluster size"])
    rows = _vectors(df, keys, embedder, id)
    if cluster_type == "HDBScan":
        size, samples = p["min cluster size"], p["min samples"]
        rows = stash(rows, "vectors")
        if (n := rows.count()) > WHOLE_ROWS:
            return _numbered(stash(_whole_hdbscan(rows, n, size, samples), "labels"), id)

        def whole(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("node")
            x = np.stack(part["v"].to_numpy())
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            return pd.DataFrame({"node": part["node"], "label": hdbscan(x, size, samples).astype(str)})

        schema = T.StructType([rows.schema["node"], T.StructField("label", T.StringType())])
        return _numbered(stash(rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(whole, schema), "labels"), id)
    linkage, metric, threshold = p["clustering linkage"], p["metric"], p["threshold"]
    if linkage == "ward" and metric != "euclidean":
        raise ValueError("ward linkage needs euclidean distances")
    if not isinstance(embedder, Precomputed):
        rows = stash(rows, "vectors")
    if linkage == "single":
        most = np.nextafter(1 - threshold if metric == "cosine" else 1 - threshold**2 / 2, np.inf)
        links = similarity.dense(_items(rows), _items(rows), None, float(most), mode="links", digits=None, apart=True).select("left_id", "right_id")
        lone = rows.select(F.col("node").alias("left_id"), F.col("node").alias("right_id"))
        return _numbered(connected_components(links.union(lone), "left_id", "right_id").select("node", F.concat(F.lit("="), F.col("component").cast("string")).alias("label")), id)
    if linkage == "average" and metric == "cosine":
        return _numbered(_average(rows, threshold).select("node", F.concat(F.lit("="), F.col("label").cast("string")).alias("label")), id)
    # slightly wider components are as valid, and rounding can't cut one
    edges = near_pairs(df, keys, embedder, _least_score(threshold * (1 + 1e-9), metric) - 2e-6, id)
    lone = rows.select(F.col("node").alias("left_id"), F.col("node").alias("right_id"))
    component = connected_components(edges.select("left_id", "right_id").union(lone), "left_id", "right_id")

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        x = np.stack(part["v"].to_numpy())
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        cosine = np.clip(x @ x.T, -1, 1)
        label = hac(1 - cosine if metric == "cosine" else np.sqrt(np.maximum(2 - 2 * cosine, 0)), threshold, linkage)
        first = part["component"].astype(str)
        return pd.DataFrame({"node": part["node"], "label": [f"{c}/{k}" for c, k in zip(first, label)]})

    schema = T.StructType([rows.schema["node"], T.StructField("label", T.StringType())])
    return _numbered(stash(rows.join(component, "node").groupBy("component").applyInPandas(cut, schema), "labels"), id)


def cluster_rows(df: DataFrame, on: Keys = None, embedder: Embedder = Ngrams(), cluster_type: str = "SLINK", cluster_params: dict | None = None, id: str | None = None) -> DataFrame:
    """``df`` with the number of each row's ``cluster``; noise is -1."""
    params = {"threshold": 0.5, "min cluster size": 2, "metric": "cosine"} if cluster_params is None else cluster_params
    name = "__row"
    rows = with_row_ids(df, name, id)
    labels = cluster_labels(rows, on, embedder, cluster_type, params, name)
    return rows.join(labels, name).drop(name)


def dedup_rows(df: DataFrame, on: Keys, embedder: Embedder = Ngrams(), cluster_type: str = "SLINK", cluster_params: dict | None = None, id: str | None = None, noise: str = "keep") -> DataFrame:
    """One row of each cluster, the one of least id, after one of each key.
    ``noise="keep"`` keeps all rows that are in no cluster; ``"collapse"`` treats
    noise as one cluster, as older callers expect, and keeps its first row."""
    if noise not in ("keep", "collapse"):
        raise ValueError("noise is 'keep' or 'collapse'")
    name, keys = "__row", _listed(on)
    rows = with_row_ids(df, name, id)
    first = Window.partitionBy(*[col(c) for c in keys]).orderBy(name)
    distinct = stash(rows.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth"), "distinct")
    params = {"threshold": 0.5, "min cluster size": 2, "metric": "cosine"} if cluster_params is None else cluster_params
    labelled = distinct.join(cluster_labels(distinct, on, embedder, cluster_type, params, name).withColumnRenamed("cluster", "__cluster"), name)
    nth = F.row_number().over(Window.partitionBy("__cluster").orderBy(name))
    if noise == "keep":
        lone, grouped = labelled.where("__cluster < 0"), labelled.where("__cluster >= 0")
        kept = grouped.withColumn("__nth", nth).where("__nth = 1").drop("__nth").unionByName(lone)
    else:
        kept = labelled.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
    return kept.drop("__cluster", name)
