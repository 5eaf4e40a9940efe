import math
import random

import numpy as np

from affinis.llm import langid as L

SCHEMA = "doc_id long, text string, lang string, lang_id int"
SYLLABLES = {"x": "the er on an re he in ed nd ha".split(), "y": "der sch ein ich und ge ver be keit".split(), "z": "ción que os ado ar la es jo".split()}


def text(language, n, r):
    return " ".join("".join(r.choice(SYLLABLES[language]) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents(n, seed=1):
    r = random.Random(seed)
    return [(i, text("xyz"[i % 3], r.randint(15, 80), r), "xyz"[i % 3], 1) for i in range(n)]


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.createDataFrame(documents(300), SCHEMA)
    model = L.fit(docs, 60)
    r = random.Random(9)
    fresh = documents(150, 5) + [(1000 + i, "".join(chr(r.randint(0x3041, 0x3090)) for _ in range(200)), None, 1) for i in range(10)]
    found = {x.doc_id: x for x in L.identify(spark.createDataFrame(fresh, SCHEMA), model, keep=["doc_id", "lang_id"]).collect()}
    assert np.mean([found[i]._lang_id == "xyz"[i % 3] for i in range(150)]) > 0.97
    assert all(found[1000 + i]._lang_id == "und" for i in range(10)) and found[0].lang_id == 1


def brute(texts, tests, alphabet_of):
    """Interpolated Kneser-Ney, order by order, with dictionaries."""
    grams = [{} for _ in range(L.ORDER + 1)]
    for s in texts:
        for n in range(1, L.ORDER + 1):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                grams[n][g] = grams[n].get(g, 0) + 1
    counts = [{} for _ in range(L.ORDER + 1)]
    counts[L.ORDER] = grams[L.ORDER]
    for n in range(1, L.ORDER):
        for g in grams[n]:
            counts[n][g] = max(1, sum(1 for h in grams[n + 1] if h[1:] == g))

    def p(g):
        if not g:
            return 1 / alphabet_of
        n = len(g)
        inside = {h: c for h, c in counts[n].items() if h[:-1] == g[:-1]}
        total = sum(inside.values())
        if not total:
            return p(g[1:])
        return max(counts[n].get(g, 0) - L.DISCOUNT, 0) / total + L.DISCOUNT * len(inside) / total * p(g[1:])

    return [sum(math.log(p(s[max(0, i - L.ORDER + 1) : i + 1])) for i in range(len(s))) for s in tests]


def test_against_kneser_ney_by_hand():
    train = ["abra cadabra abracadabra", "a bard bards a card"]
    model = L.train({"x": [t.encode() for t in train]}, {})
    alphabet = len(set("".join(train))) + 1
    tests = ["abra", "cad bar", "zzz", "a", "drab q"]
    for s, want in zip(tests, brute(train, tests, alphabet)):
        c = L._points(s.encode())
        got = model.sums(c, np.zeros(len(c), np.int64), np.arange(len(c)), 1)[0, 0]
        assert abs(got - want) < 0.02 * abs(want) + 0.01, (s, got, want)


def test_pieces_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(documents(60), SCHEMA)
    model = L.fit(docs, 10)
    r = random.Random(3)
    long = spark.createDataFrame([(1, text("x", 60_000, r), None, 1), (2, "das", None, 1)], SCHEMA)
    out = sorted(L.identify(long, model, keep=["doc_id"]).collect())
    c = L._points(long.where("doc_id = 1").collect()[0].text.encode())
    whole = model.sums(c, np.zeros(len(c), np.int64), np.arange(len(c)), 1)[0]
    assert len(c) > L.PIECE and out[0].lang_id == "x"
    assert abs(out[0].cross_entropy + whole.max() / len(c)) < 1e-3


def test_edge_cases(spark):
    rows = documents(60)
    docs = spark.createDataFrame(rows + [(100, None, "x", 1), (101, "", "y", 1), (102, "ab", None, 1), (103, rows[0][1], None, 1), (103, rows[0][1], None, 1), (None, None, None, None)], SCHEMA)
    model = L.fit(docs, 20)
    found = {r.doc_id: r for r in L.identify(docs, model, keep=["doc_id"]).collect()}
    assert tuple(found[100])[1:] == (None, None) and tuple(found[101])[1:] == ("und", None) and found[102].lang_id is not None
    ignorant = L.fit(docs.limit(0))
    assert {r.lang_id for r in L.identify(docs, ignorant, keep=["doc_id"]).collect()} == {"und", None}
    assert L.identify(docs.limit(0), model).count() == 0


def test_an_unseen_character_costs_what_its_language_leaves():
    """Each language's own share, not that of all."""
    r = random.Random(2)
    model = L.train({"a": ["".join(r.choice("abc") for _ in range(300)).encode()], "b": [bytes(range(97, 123)) * 4]}, {})
    found = model.sums(np.array([0x3041], np.uint64), np.array([0]), np.array([0]), 1)[0]
    # at order 1 a character counts once for each one that stood before it: nine pairs of three, and 26 of 26
    for j, left in enumerate((L.DISCOUNT * 3 / 9, L.DISCOUNT * 26 / 26)):
        assert abs(found[j] - math.log(left / 27)) < 1e-5


def test_a_language_of_short_texts_has_a_model(spark):
    rows = [(i, "kort tekst", "s", 1) for i in range(20)] + documents(60)
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    assert L.fit(docs, 30).languages == ["s", "x", "y", "z"]
