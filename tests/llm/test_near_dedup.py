import random
import re

import numpy as np
import pytest

from affinis.llm import near_dedup as N
from affinis.llm.shared import words


def shingle_set(text):
    w = re.findall(r"[a-z0-9\u0080-￿]+", text.lower())
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows, threshold=0.5):
    """Ids that stay, by all pairs."""
    sets = {i: shingle_set(t) for i, t in rows if t}
    ids = [i for i in sets if sets[i]]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(i for i, _ in rows if i not in parent or find(i) == i)


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 30, 120, 400]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = [r.choice(vocabulary) if r.random() < 0.03 else w for w in base]
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    out = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in out.collect()) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"v{i % 50_000}" for i in range(200_000))
    rows = [(1, None, 1), (2, None, 1), (3, "", 2), (4, "", 2), (5, "?! --", 3), (6, "one", 4), (7, "One!", 4), (None, "one", 4), (8, long, 5), (9, long + " end", 5), (10, "a b", 6), (11, "a b", 6), (11, "a b", 6), (12, "b a", 6)]
    out = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, text_hash int"))
    assert out.columns == ["doc_id", "text", "text_hash"]
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 4, 5, 6, 8, 10, 12]


def test_many_copies_and_a_chain(spark):
    copies = [(i, "the same words in the same order " * 3 + ("." * (i % 7))) for i in range(500)]
    words_ = [f"u{i}" for i in range(400)]
    chain = [(1000 + k, " ".join(words_[60 * k : 60 * k + 200])) for k in range(4)]  # neighbours share 140 of 260
    out = N.near_dedup(spark.createDataFrame(copies + chain, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [0, 1000]


def test_a_hot_band_of_distinct_contents(spark):
    """20,000 distinct contents share most of their bands with one text; some
    others are similar to some of them only."""
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 60], f"x{i}", *base[i % 60 + 1 :]])) for i in range(20_000)]
    far = [*base[:30], *[f"y{i}" for i in range(22)]]  # 0.34 like the text, 0.59 like the next one
    rows += [(30_000, " ".join([*base[:44], *[f"y{i}" for i in range(10)]])), (30_001, " ".join(far)), (30_002, " ".join(f"z{i}" for i in range(40)))]
    out = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert sorted(x.doc_id for x in out.collect()) == [0, 30_002]


@pytest.mark.parametrize("limit", [8, 2048])
def test_large_buckets_and_components_give_the_same_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(N, "LIMIT", limit)
    monkeypatch.setattr(N, "BLOCK", max(4, limit // 2))
    monkeypatch.setattr(N, "SAMPLED", 1)
    r = random.Random(9)
    rows = corpus(4)
    base = [f"b{i}" for i in range(150)]
    rows += [(5000 + i, " ".join(w if r.random() > 0.01 else f"x{r.randrange(999)}" for w in base)) for i in range(60)]  # copies of one text
    half = [f"t{i}" for i in range(60)]
    rows += [(6000 + i, " ".join([*half, *[f"v{r.randrange(10**6)}" for _ in range(70)]])) for i in range(60)]  # a template, 0.29 alike
    words_ = [f"u{i}" for i in range(4000)]
    rows += [(7000 + k, " ".join(words_[40 * k : 40 * k + 200])) for k in range(60)]  # a chain, neighbours 0.66 alike
    out = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    found = sorted(x.doc_id for x in out.collect())
    assert found == brute(rows)
    assert [i for i in found if 5000 <= i < 6000] == [5000] and [i for i in found if i >= 7000] == [7000]


def test_empty_table(spark):
    assert N.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def registers(n, offset=0):
    rng = np.random.default_rng(offset)
    grams = rng.integers(0, 2**63, n, dtype=np.uint64)
    return grams, N.sketch(grams, np.array([0, n]))


def test_sketches_merge_to_the_union():
    a, x = registers(500, 1)
    b, y = registers(300, 2)
    assert (N.merge(x, y) == N.sketch(np.concatenate([a, b]), np.array([0, 800]))).all()


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(5)
    error = []
    for true in (0.2, 0.5, 0.8):
        for _ in range(30):
            n = 1000
            both = int(2 * n * true / (1 + true))
            pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = N.sketch(pool[:n], np.array([0, n])), N.sketch(pool[-n:], np.array([0, n]))
            error.append(N.similarity(a, b)[0] - true)
            assert abs(N.cardinality(a)[0] / n - 1) < 0.5
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_words_are_the_same_in_pieces(monkeypatch):
    from affinis.llm import shared

    text = ("Ab cd, éf 12 " * 2000).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, 5, 5, 7000, len(text)])
    whole = words(data, at)
    monkeypatch.setattr(shared._cuts, "__defaults__", (100,))
    pieces = words(data, at)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
