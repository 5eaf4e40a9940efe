import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import linkage
from affinis.operators.embed import Encoder, Ngrams, Precomputed

LEFT = [(1, "Acme Corp", "US"), (2, "Beta Limited", "UK"), (3, "Acme Corp", "FR"), (4, "", "US"), (5, None, "US"), (6, "zzz", None)]
RIGHT = [(10, "Acme Corporation", "US", 5), (11, "Beta Ltd", "UK", 6), (12, "Acme Corporation", "ES", 7), (13, None, "US", 8), (14, "Gamma", None, 9)]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(LEFT, "id long, name string, country string"), spark.createDataFrame(RIGHT, "id long, name string, country string, `size (mm)` long")


def cosine(a, b, n=3):
    def counts(t):
        t = t.lower()
        out = {}
        for i in range(max(1, len(t) - n + 1)):
            out[t[i : i + n]] = out.get(t[i : i + n], 0) + 1
        return out

    x, y = counts(a), counts(b)
    return sum(v * y.get(g, 0) for g, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def brute(k, threshold=-1):
    out = []
    for i, a, _ in LEFT:
        if a:
            scores = sorted((-round(cosine(a, b), 6), j) for j, b, *_ in RIGHT if b)
            out += [(i, j, -s) for s, j in scores[:k] if -s >= threshold]
    return sorted(out)


def ids(df):
    return sorted((r.id_x, r.id_y, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 2, 4, 9])
def test_knn_against_all_pairs(sides, k):
    found = ids(linkage.merge_knn(*sides, on="name", k=k, left_id="id", right_id="id"))
    assert [x[:2] for x in found] == [x[:2] for x in brute(k)] and np.allclose([x[2] for x in found], [x[2] for x in brute(k)])


def test_merge_is_knn_of_one_and_two_are_twice_as_many(sides):
    one = ids(linkage.merge(*sides, on="name", left_id="id", right_id="id"))
    assert one == ids(linkage.merge_knn(*sides, on="name", left_id="id", right_id="id"))
    assert len(ids(linkage.merge_knn(*sides, on="name", k=2, left_id="id", right_id="id"))) == 2 * len(one)


def test_names_suffixes_and_row_ids(sides):
    out = linkage.merge(*sides, on=["name", "country"], suffixes=("_l", "_r"), keep_row_ids=True)
    assert out.columns == ["id_lt_l", "id_lt_r", "id_l", "name_l", "country_l", "id_r", "name_r", "country_r", "size (mm)", "score"]
    assert out.count() == 6  # separators make every key a text
    assert linkage.resolve_keys(*sides)[0] == ["id", "name", "country"]


def test_errors_and_warnings(sides):
    left, right = sides
    with pytest.raises(ValueError):
        linkage.merge(left, right, on="nothing")
    with pytest.raises(ValueError):
        linkage.merge(left, right, on="name", merge_type="2:2")
    with pytest.warns(UserWarning):
        linkage.merge(left, right, on="name", merge_type="1:1", left_id="id", right_id="id")
    with pytest.raises(ValueError):
        linkage.merge_range(left, right, on="name", sim_threshold=1.5)
    with pytest.raises(ValueError):
        linkage.merge_blocking(left, right, on="name", blocking_vars=["size (mm)"])
    with pytest.raises(ValueError):
        linkage.merge_knn(left, right, on="name", k=0)


def test_range_keeps_unmatched_rows(sides):
    found = linkage.merge_range(*sides, on="name", sim_threshold=0.4, left_id="id", right_id="id").collect()
    got = sorted((r.id_x, r.id_y) for r in found if r.id_y)
    assert got == [x[:2] for x in brute(9, 0.4)]
    assert {r.id_x for r in found if r.id_y is None} == {4, 5, 6} and all(r.score is None for r in found if r.id_y is None)


def test_range_by_hand(spark):
    schema = "name string, v array<double>"
    left = spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [0.0, 1.0]), ("none", None), ("zero", [0.0, 0.0])], schema)
    right = spark.createDataFrame([("alpha inc", [1.0, 0.0]), ("alpha llc", [0.8, 0.2]), ("beta corp", [0.0, 1.0])], schema)
    found = {(r.name_x, r.name_y): r.score for r in linkage.merge_range(left, right, sim_threshold=0.01, embedder=Precomputed("v")).collect()}
    assert found == {("alpha", "alpha inc"): 1.0, ("alpha", "alpha llc"): 0.970143, ("beta", "alpha llc"): 0.242536, ("beta", "beta corp"): 1.0, ("none", None): None, ("zero", None): None}


def test_blocking(sides):
    found = linkage.merge_blocking(*sides, on="name", blocking_vars=["country"], left_id="id", right_id="id").collect()
    assert sorted((r.id_x, r.id_y) for r in found if r.score is not None) == [(1, 10), (2, 11)]
    rest = {(r.id, r.country) for r in found if r.score is None}
    assert rest == {(3, "FR"), (12, "ES")}  # the null block is dropped
    assert len(linkage.merge_blocking(*sides, on="name").collect()) == 4


@pytest.mark.parametrize("rows", [(40, 30), (1, 1), (0, 5), (5, 0)])
def test_dense_tiles_against_numpy(spark, monkeypatch, rows):
    from affinis.plans import similarity

    monkeypatch.setattr(similarity, "LEFT_ROWS", 7)
    monkeypatch.setattr(similarity, "RIGHT_ROWS", 5)
    rng = np.random.default_rng(1)
    x, y = (rng.integers(-2, 3, (n, 3)).astype(float) for n in rows)
    schema = "id long, v array<double>"
    left, right = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], schema) for m in (x, y))
    found = [(r.id_x, r.id_y, r.score) for r in linkage.merge_knn(left, right, k=4, embedder=Precomputed("v"), left_id="id", right_id="id").collect()]
    want = []
    for i, a in enumerate(x):
        scores = sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), j) for j, b in enumerate(y) if a.any() and b.any())
        want += [(i, j, -s + 0.0) for s, j in scores[:4]]
    assert sorted(found) == sorted(want)


def test_encoder_equals_ngrams(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(40)]
    grams = sorted({t[i : i + 3] for t in texts for i in range(max(1, len(t) - 2))})

    def encode(batch):
        return np.array([[sum(t[i : i + 3] == g for i in range(max(1, len(t) - 2))) for g in grams] for t in batch], float)

    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    by = [sorted((x.id_x, x.id_y, x.score) for x in linkage.merge_knn(df, df, on="t", k=3, embedder=e, left_id="id", right_id="id").collect()) for e in (Ngrams(), Encoder(encode, 16))]
    assert by[0] == by[1]


def test_pairs_and_combinations(spark):
    df = spark.createDataFrame([("abcd", "abcx"), ("abcd", ""), (None, "abc"), ("q", "abcd")], "a string, b string")
    got = [r.score for r in linkage.evaluate_pairs(df, "a", "b").collect()]
    assert got == [0.5, None, None, 0.0]
    combos = linkage.all_pair_combos_evaluate(df, "a", "b")
    assert combos.columns == ["a", "b", "score"] and combos.count() == 16
    assert combos.where("a = 'abcd' and b = 'abcd'").select("score").distinct().collect()[0].score == 1.0


def test_empty_tables(sides):
    left, right = sides
    assert linkage.merge(left.limit(0), right, on="name").count() == 0
    assert linkage.merge(left, right.limit(0), on="name").count() == 0
    assert linkage.merge_range(left, right.limit(0), on="name").count() == 6
    assert linkage.merge_edit(left, right, "name", "name", "id", "id").where(F.col("score").isNull()).count() == 0


def test_vectors_of_different_sizes_raise(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="different sizes"):
        linkage.merge_knn(df, df, embedder=Precomputed("v"), left_id="id", right_id="id").collect()


def test_prefixes_lose_no_pair(spark):
    """With one n-gram in every key, of the same counts as all pairs give."""
    import random

    r = random.Random(3)
    names = ["item " + "".join(r.choice("abcde") for _ in range(r.choice([2, 6, 12]))) for _ in range(150)]
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names[:100])] + [(990, ""), (991, None)], "l int, n string")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(names[50:])] + [(800 + i, names[60]) for i in range(20)], "r int, n string")
    every = {(x.l, x.r, x.score) for x in linkage.merge_range(left, right, on="n", sim_threshold=-1, left_id="l", right_id="r").collect() if x.r is not None}
    for least in (0.2, 0.5, 0.95):
        found = {(x.l, x.r, x.score) for x in linkage.merge_range(left, right, on="n", sim_threshold=least, left_id="l", right_id="r").collect() if x.r is not None}
        assert found == {x for x in every if x[2] >= least} and found
    top = linkage.merge_knn(left, right, on="n", k=2, drop_sim_threshold=0.5, left_id="l", right_id="r").collect()
    for i in range(100):
        best = sorted((-s, b) for a, b, s in every if a == i)[:2]
        assert sorted((-x.score, x.r) for x in top if x.l == i) == [x for x in best if -x[0] >= 0.5]


def test_a_gram_of_all_keys_brings_none_together(spark):
    from affinis.plans import similarity

    items = spark.createDataFrame([(i, "", f"common{chr(97 + i % 26)}{chr(97 + i // 26)}{i * 7919}") for i in range(300)], "id int, block string, text string")
    a, b = (similarity._counts(items, 3).select(F.col("id").alias(side + "_id"), "block", "gram", F.col("w").alias("w" + side[0]), F.col("size").alias("s" + side[0])) for side in ("left", "right"))
    assert similarity._candidates(a, b, 0.9).count() < 1500  # of 90,000


def test_ranges_in_the_left_order(spark):
    left = spark.createDataFrame([(i, f"name {9 - i}") for i in range(10)], "id int, n string").repartition(5)
    out = linkage.merge_range(left, left, on="n", sim_threshold=0.3, left_id="id", right_id="id", in_order=True)
    ids = [r.id_x for r in out.collect()]
    assert ids == sorted(ids) and len(ids) > 10 and "id_lt_x" not in out.columns
