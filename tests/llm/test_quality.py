import random

import numpy as np
import pytest

from affinis.llm import quality as Q
from affinis.llm.shared import utf8

SCHEMA = "doc_id long, text string, kept string"


def documents(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        good = i % 2
        body = [r.choice(words) for _ in range(r.randint(10, 80))]
        kind = i // 2 % 3
        if not good:
            body = [w.upper() + "!!" for w in body] if kind == 0 else [w + "$$$" for w in body] if kind == 1 else body[:3] * 20
        rows.append((i, (" ".join(body) + ".").capitalize() if good else " ".join(body), "x"))
        labels.append((i, good))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = documents(600)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = Q.fit(docs, spark.createDataFrame(labels[:300], "doc_id long, quality int"), per_class=150)
    out = {r.doc_id: r for r in Q.classify(docs, model).collect()}
    held = range(300, 600)
    assert np.mean([out[i]._kept == bool(i % 2) for i in held]) > 0.97
    assert out[0].kept == "x"


def test_scores_against_brute_force():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((300, 8)).astype(np.float32), rng.standard_normal((50, 8)).astype(np.float32)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    good = rng.integers(0, 2, 50).astype(np.float32)
    got = Q.Model(np.zeros((1, 8)), y, good).score(x, 5)
    for i in range(300):
        near = sorted(((float(x[i] @ y[j]), good[j]) for j in range(50)), reverse=True)[:5]
        near = [(s, g) for s, g in near if s > 1e-6]
        assert got[i] == pytest.approx(sum(s * g for s, g in near) / sum(s for s, _ in near), abs=1e-5)


def test_products_give_the_decomposition():
    rows, labels = documents(80)
    import pyarrow as pa

    documents_ = []
    for _, t, _ in rows:
        _, term, count = Q.terms(*utf8(pa.array([t])))
        documents_.append((term, count))
    model = Q.train(documents_, [g for _, g in labels], 10)
    a = np.zeros((80, Q.TERMS))
    for i, (t, c) in enumerate(documents_):
        a[i, t] = np.log1p(c)
    a *= np.log(81 / (1 + (a > 0).sum(0))) + 1
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    v = u[:, :10] * s[:10]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose(v @ v.T, model.labelled @ model.labelled.T, atol=1e-3)


def test_edge_cases(spark):
    rows, labels = documents(60)
    more = [(1000, None, None), (1001, "", "y"), (1002, " \n ", "y"), (1003, rows[0][1] * 5000, "y"), (1003, rows[0][1] * 5000, "y")]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    given = spark.createDataFrame([*labels, (None, 1), (5, None), (3, 0), (1000, 1), (5000, 1)], "doc_id long, quality int")
    out = Q.classify(docs, Q.fit(docs, given)).where("doc_id >= 1000").orderBy("doc_id").collect()
    assert [r.quality_score for r in out[:3]] == [None] * 3 and all(r._kept for r in out[:3])
    assert out[3] == out[4] and not out[3]._kept
    ignorant = Q.fit(docs, given.limit(0))
    assert Q.classify(docs, ignorant).where("not _kept").count() == 0
    assert Q.classify(docs.limit(0), ignorant).count() == 0
