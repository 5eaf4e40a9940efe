import numpy as np
import pytest

from affinis.llm import ann


def brute(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 48))
    if clustered:
        x = x * 0.3 + rng.standard_normal((30, 48))[rng.integers(0, 30, 1500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.nearest(df, sample=100).toPandas()
    true = brute(x, 10)
    got = found.groupby("vec_id")["neighbour"].apply(set)
    assert len(found) == 15_000 and np.mean([len(set(t) & got[i]) / 10 for i, t in enumerate(true)]) >= 0.9
    assert (found.sort_values(["vec_id", "rank"])["rank"].to_numpy().reshape(-1, 10) == np.arange(1, 11)).all()


def test_the_query_against_brute_force(spark):
    """Every row whose id is divisible by 20, against all rows of the real table."""
    from affinis.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    true = {ids[i]: set(ids[row]) for i, row in enumerate(brute(x, 10)) if ids[i] % 20 == 0}
    found = queries.op1_ann(spark, "/root/testdata/sf0.1").toPandas()
    got = found.groupby("vec_id")["neighbour"].apply(set)
    assert set(got.index) == set(true) and len(found) == 10 * len(true)
    assert np.mean([len(true[i] & got[i]) / 10 for i in true]) >= 0.9


def test_a_list_with_most_of_the_rows_is_split(spark, monkeypatch):
    """Copies of one vector make a list longer than a group; none is lost."""
    monkeypatch.setattr(ann, "GROUP_ROWS", 64)
    monkeypatch.setattr(ann, "TASK_QUERIES", 32)
    rng = np.random.default_rng(3)
    x = np.vstack([np.tile(rng.standard_normal(16), (300, 1)), rng.standard_normal((300, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "neighbour long, embedding array<float>")
    found = ann.nearest(df, id="neighbour", recall=1.0)
    assert found.columns == ["neighbour", "_neighbour", "cosine", "rank"]
    by = found.toPandas().groupby("neighbour")["_neighbour"].apply(list)
    assert by[0] == list(range(1, 11)) and by[299] == list(range(10))
    true = brute(x, 10)
    assert np.mean([len(set(by[i]) & set(true[i])) / 10 for i in range(300, 600)]) >= 0.97
    first, shares = ann._groups(np.array([10, 200, 30, 30, 64, 1]))
    assert first.tolist() == [0, 1, 5, 5, 6, 7] and shares.tolist() == [1, 4, 1, 1, 1, 1]


def test_small_tables_are_exact_and_ties_go_by_id(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(100, [0.0, 2.0, 0.0]), (101, [0.0, 1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.vec_id, r["rank"]): (r.neighbour, r.cosine) for r in ann.nearest(df, k=3, recall=1.0).collect()}
    assert [found[0, k][0] for k in (1, 2, 3)] == [1, 2, 3] and [found[9, k][0] for k in (1, 2, 3)] == [0, 1, 2]
    assert found[100, 1] == (101, pytest.approx(0.995037, abs=1e-6))


def test_edge_cases(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, neighbour int")
    assert sorted((r.vec_id, r.neighbour) for r in ann.nearest(df).collect()) == [(1, 2), (2, 1)]
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(one).count() == 0
    assert ann.nearest(one.limit(0)).count() == 0


def test_tests_abandon_candidates_but_hardly_neighbours():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((2000, 64)) * 0.4 + rng.standard_normal((20, 64))[rng.integers(0, 20, 2000)]).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) @ ann.rotation(64)
    d = ((x[:20, None] - x) ** 2).sum(-1)
    bound = np.sort(d, axis=1)[:, 10]
    true = {(i, j) for i, j in zip(*np.nonzero(d <= bound[:, None] - 1e-5))}
    i, j, found = ann.scan(x[:20], x, bound, 2.1)
    assert len(true & set(zip(i.tolist(), j.tolist()))) >= 0.98 * len(true)
    assert np.allclose(found, d[i, j], atol=1e-4)
    partial = ((x[:20, None, :16] - x[:, :16]) ** 2).sum(-1)
    assert (partial > bound[:, None] * 0.25 * (1 + 2.1 / 4) ** 2).mean() > 0.5  # the first block abandons some
