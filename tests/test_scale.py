"""Plans for large tables, on small ones cut into many shares, chunks and rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import cluster, linkage
from affinis.operators.embed import Precomputed
from affinis.plans import similarity
from test_operators import brute_dbscan, naive_hac


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(similarity, "LEFT_ROWS", 40)
    monkeypatch.setattr(similarity, "RIGHT_ROWS", 23)


def blobs(n: int, seed: int, size: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(9, size))[rng.integers(0, 9, n)] + 0.5 * rng.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def labels(spark, x, kind, **params):
    out = cluster.cluster_rows(rows(spark, x), embedder=Precomputed("v"), cluster_type=kind, cluster_params=params, id="id")
    return [r.cluster for r in out.orderBy("id").collect()]


def test_average_linkage_merges_in_rounds(spark, monkeypatch):
    """one component of all rows, of which one task gets the last few clusters only."""
    x = blobs(120, 1)
    x[50:60] = x[40]  # copies
    monkeypatch.setattr(cluster, "FINISH", 6)
    params = {"threshold": 0.35, "clustering linkage": "average", "metric": "cosine"}
    got = labels(spark, x, "agglomerative", **params)
    assert got == naive_hac(1 - x @ x.T, 0.35, "average") and 6 < len(set(got)) < 60


def test_cut_of_one_large_component():
    """merges look again only at rows that they touch; all linkages as before."""
    x = blobs(60, 2)
    d = 1 - x @ x.T
    for linkage_ in ("single", "complete", "average"):
        got = cluster.hac(d, 0.3, linkage_)
        first = {}
        assert [first.setdefault(k, len(first)) for k in got] == naive_hac(d, 0.3, linkage_)
    grid = np.abs(np.arange(40)[:, None] - np.arange(40)).astype(float)  # ties everywhere
    got = cluster.hac(grid, 1.5, "complete")
    assert got.tolist() == [k - k % 2 for k in range(40)]


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.02), ("euclidean", 0.2)])
def test_single_linkage_lists_no_pairs(spark, monkeypatch, metric, threshold):
    """its clusters are the components of links, of which there are few a row."""
    x = blobs(150, 3)
    monkeypatch.setattr(cluster, "near_pairs", None)
    monkeypatch.setattr(cluster, "hac", None)
    d = 1 - x @ x.T if metric == "cosine" else np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    params = {"threshold": threshold, "clustering linkage": "single", "metric": metric}
    got = labels(spark, x, "agglomerative", **params)
    assert got == naive_hac(d, threshold, "single") and 3 < len(set(got)) < 140
    items = rows(spark, x).select("id", F.lit("").alias("block"), "v")
    assert similarity.dense(items, items, None, -1.0, mode="links", apart=True).count() < 8 * 150  # of 22,500 pairs


def test_edit_merge_of_many_shares(spark):
    """texts around the bits of a word, empty and with ties, as the JVM compares them."""
    from affinis.functions.text import edit_similarity

    rng = np.random.default_rng(4)

    def texts(n):
        return ["".join(rng.choice(list("abé"), int(rng.choice([0, 1, 2, 5, 9, 63, 64, 65, 80])))) for _ in range(n)]

    left = spark.createDataFrame(list(enumerate(texts(60))) + [(90, None)], "l int, a string")
    right = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts(70))], "r int, b string")
    score = F.round(edit_similarity(F.col("a"), F.col("b")), 6)
    pairs = left.crossJoin(right).where("a is not null and b is not null").withColumn("s", score).groupBy("l").agg(F.max_by(F.struct("r", "s"), F.struct("s", -F.col("r"))).alias("m"))
    want = sorted((x.l, x.m.r, x.m.s) for x in pairs.collect())
    got = linkage.merge_edit(left, right, "a", "b", "l", "r")
    assert sorted((x.l, x.r, x.score) for x in got.collect()) == want and len(want) == 60
    assert "levenshtein" not in linkage.merge_edit(left.where("length(a) < 9"), right, "a", "b", "l", "r")._jdf.queryExecution().toString()


def test_measures_of_groups_list_no_pairs(spark):
    """As with the list of all relevant pairs."""
    from affinis.operators import metrics

    rng = np.random.default_rng(5)
    groups = spark.createDataFrame([(i, None if i % 11 == 0 else int(rng.integers(0, 6))) for i in range(50)] + [(77, 99)], "id int, label int")
    hits = spark.createDataFrame([(q, int(c), k + 1) for q in range(45) for k, c in enumerate(rng.permutation(60)[:12])], "qid int, cid int, rank int")
    x, y = groups.select(F.col("id").alias("qid"), "label"), groups.select(F.col("id").alias("cid"), "label")
    relevant = x.join(y, "label").where("qid <> cid").select("qid", "cid")
    assert metrics.ir_metrics_of_groups(hits, groups).collect() == metrics.ir_metrics(hits, relevant).collect()
    assert metrics.matching_accuracy_of_groups(hits, groups).collect() == metrics.matching_accuracy(hits, relevant).collect()


def test_pairs_are_reduced_before_they_are_joined(spark):
    """a segment meets a supplier once, not once a customer."""
    from affinis import catalog
    from conftest import DATA

    seen = []

    def prepare(both, *rest):
        seen.append(both)
        return both

    with pytest.MonkeyPatch.context() as m:
        m.setattr(catalog.prep, "prepare_pairs", prepare)
        catalog._pairs(spark, DATA)
    both = seen[0]
    assert both.count() == both.select("c_mktsegment", "s_suppkey").distinct().count() > 0


def test_hdbscan_in_rounds(spark, monkeypatch):
    """the same labels as of one task that holds all distances."""
    x = np.vstack([blobs(150, 6), np.zeros((1, 4))])
    params = {"min cluster size": 3, "min samples": 1}
    whole = labels(spark, x, "HDBScan", **params)
    monkeypatch.setattr(cluster, "WHOLE_ROWS", 10)
    monkeypatch.setattr(cluster, "LISTED", 5)
    monkeypatch.setattr(cluster, "hdbscan", None)
    assert labels(spark, x, "HDBScan", **params) == whole and max(whole) > 2


def test_spanning_tree_of_equal_reaches(spark, monkeypatch):
    """with more samples many reaches are equal; the tree is as short as any."""
    x = blobs(90, 7)
    monkeypatch.setattr(cluster, "LISTED", 4)
    edges = cluster._spanning_edges(rows(spark, x).select(F.col("id").alias("i"), "v"), 4, 90).collect()
    s = np.round(x @ x.T, 12)
    core = np.sort(s - 9 * np.eye(90), axis=1)[:, -4]
    reach = np.minimum(np.minimum(s, core), core[:, None])

    def lengths(edges):
        root, out = list(range(90)), []
        for w, a, b in sorted(edges, reverse=True):
            if root[a] != root[b]:
                out.append(round(w, 9))
                root = [root[a] if r == root[b] else r for r in root]
        return out

    want = lengths((reach[a, b], a, b) for a in range(90) for b in range(a))
    assert lengths((e.w, e.a, e.b) for e in edges) == want and len(edges) < 200


def test_a_long_chain_of_clusters_takes_little_memory():
    """every split leaves two behind; lists of all rows below each would be quadratic."""
    n = 40_000
    edges = [(1.0, 2 * i, 2 * i + 1) for i in range(n // 2)] + [(2.0 + i * 1e-4, 2 * i, 2 * i + 2) for i in range(n // 2 - 1)]
    import tracemalloc

    tracemalloc.start()
    label = cluster.densest(edges, n, 2)
    assert tracemalloc.get_traced_memory()[1] < 2e8 and len(label) == n
    tracemalloc.stop()


def test_texts_of_many_shares_and_chunks(spark, monkeypatch):
    """postings and frequent n-grams give the counts of brute force, with ties and without partners."""
    monkeypatch.setattr(similarity, "TASK_CELLS", 50)
    rng = np.random.default_rng(8)

    def names(n):
        return [f"name{rng.integers(0, 300):04d}" if rng.random() < 0.9 else "".join(rng.choice(list("xyé"), 4)) for _ in range(n)]

    def grams(t):
        return [t[i : i + 3] for i in range(len(t) - 2)]

    x, y = names(90), names(110)
    left, right = (spark.createDataFrame([(i, "", t) for i, t in enumerate(ts)], "id int, block string, text string") for ts in (x, y))
    want = {}
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            a3, b3 = grams(a), grams(b)
            p = sum(a3.count(g) * b3.count(g) for g in set(a3))
            want[i, j] = round(p / (sum(a3.count(g) for g in a3) * sum(b3.count(g) for g in b3)) ** 0.5, 6)
    best = [(i, j, want[i, j]) for i in range(90) for j in sorted(range(110), key=lambda j: (-want[i, j], j))[:3]]
    found = similarity.sparse(left, right, 3, k=3)
    assert sorted((r.left_id, r.right_id, r.score) for r in found.collect()) == sorted(best)
    near = sorted((i, j, s) for (i, j), s in want.items() if s >= 0.4)
    for rare in (0, 10**9):  # both plans
        monkeypatch.setattr(similarity, "RARE", rare)
        assert sorted((r.left_id, r.right_id, r.score) for r in similarity.sparse(left, right, 3, threshold=0.4).collect()) == near


def test_range_of_ids_joins_nothing(spark):
    """pairs leave the search as they are; left rows without a partner too."""
    x = blobs(120, 9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 4)], "id long, v array<double>")
    options = dict(sim_threshold=0.99, embedder=Precomputed("v"), left_id="id", right_id="id")
    whole = linkage.merge_range(df, df, **options).select("id_x", "id_y", "score")
    out = linkage.merge_range(df, df, **options, ids_only=True)
    assert out.columns == whole.columns and sorted(map(str, out.collect())) == sorted(map(str, whole.collect()))
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and plan.count("Exchange hashpartitioning") == 0
    assert {r.id_x for r in linkage.merge_range(df, df.limit(0), **options, ids_only=True).collect()} == {r.id for r in df.collect()}


@pytest.mark.parametrize("mode, k, threshold", [("best", 3, None), ("links", None, 0.4), ("outer", None, 0.4)])
def test_a_share_holds_few_scores(mode, k, threshold):
    """memory of a worker, whatever the rows that pass it."""
    import tracemalloc

    import pyarrow as pa

    def batch(side, n, seed):
        x = np.random.default_rng(seed).normal(size=(n, 64))
        return pa.record_batch([pa.array(np.arange(n) + n * seed), pa.array(list(x))], names=[side, "v"])

    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("score", pa.float64())])
    chunks = ([batch("right_id", 4096, seed)] for seed in range(6))
    tracemalloc.start()
    for _ in similarity._share([batch("left_id", 2048, 9)], chunks, similarity._Vectors(True, 6), mode, k, threshold, False, schema):
        pass
    assert tracemalloc.get_traced_memory()[1] < 6e7
    tracemalloc.stop()
