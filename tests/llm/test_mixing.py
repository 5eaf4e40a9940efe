import hashlib
import math
import random

import pytest

from affinis.llm.mixing import mix_sources


def reference(rows, schedule, budget=None):
    """(doc_id, epoch, position) by numeric integration and bisection."""
    by = {}
    for i, source, n in rows:
        by.setdefault(source, []).append((hashlib.md5(f"curriculum#{i}".encode()).hexdigest(), n, i))
    supply = {s: sum(n for _, n, _ in v) for s, v in by.items()}

    def weight(s, t):
        total = sum(schedule[x](t) for x in by)
        return schedule[s](t) / total

    steps = 4000
    area = {s: [0.0] for s in by}
    for k in range(steps):
        for s in by:
            area[s].append(area[s][-1] + weight(s, (k + 0.5) / steps) / steps)
    if budget is None:
        budget = max(supply[s] / area[s][-1] for s in by if area[s][-1] > 0)
    out = []
    for s, v in by.items():
        start, epoch = 0, 0
        while supply[s] and start < budget * area[s][-1] - 1e-6:
            for _, n, i in sorted(v):
                if start >= budget * area[s][-1] - 1e-6:
                    break
                k = next((k for k in range(steps + 1) if area[s][k] * budget >= start), steps)
                out.append((i, epoch, k / steps * budget))
                start += n
            epoch += 1
    return out, budget


def test_against_numeric_integration(spark):
    r = random.Random(2)
    rows = [(i, r.choice("abc"), r.randint(1, 50)) for i in range(150)]
    docs = spark.createDataFrame([(i, s, n) for i, s, n in rows], "doc_id long, source string, size long")
    found = mix_sources(docs, {"a": [(0, 1), (1, 3)], "b": [(0, 2), (0.5, 1), (1, 1)], "c": [(0, 1)]}, tokens="size").collect()

    def line(knots):
        def at(t):
            for (p, u), (q, v) in zip(knots, knots[1:]):
                if p <= t <= q:
                    return u + (v - u) * (t - p) / (q - p)
            return knots[-1][1]
        return at

    # the library scales the weights at the knots; between them the scaled lines are linear
    knots = [0, 0.5, 1]
    raw = {"a": line([(0, 1), (1, 3)]), "b": line([(0, 2), (0.5, 1), (1, 1)]), "c": line([(0, 1), (1, 1)])}
    scaled = {s: line([(t, f(t) / sum(g(t) for g in raw.values())) for t in knots]) for s, f in raw.items()}
    want, budget = reference(rows, scaled)
    got = {(x.doc_id, x.epoch): x.position for x in found}
    assert set(got) == {(i, e) for i, e, _ in want}
    for i, e, p in want:
        assert abs(got[i, e] - p) < budget / 500


def test_default_places_every_document_and_the_range_is_sorted(spark):
    r = random.Random(3)
    rows = [(i, f"s{min(r.randrange(9), 5)}", "w" * r.randint(1, 900)) for i in range(400)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {x.doc_id for x in found} == set(range(400))
    assert [x.position for x in found] == sorted(x.position for x in found)
    assert all(x.n_tokens == math.ceil(len(x.text) / 4) for x in found)


def test_shares_follow_the_targets(spark):
    rows = [(i, "ab"[i % 2], "w" * 400) for i in range(2000)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), {"a": [(0, 3)], "b": [(0, 1)]}, budget_tokens=100_000).collect()
    a = sum(x.n_tokens for x in found if x.source == "a")
    assert abs(a - 75_000) <= 100 and abs(sum(x.n_tokens for x in found) - 100_000) <= 200


def test_edge_cases(spark):
    schema = "doc_id long, source string, text string, epoch int, Position string"
    rows = [(1, "a", "x" * 40, 7, "p"), (1, "a", "x" * 40, 7, "p"), (1, "a", "x" * 8, 7, "p"), (2, None, "y" * 40, 7, "p"), (3, "b", None, 7, "p"), (4, "b", "", 7, "p"), (None, "a", "z" * 4, None, None), (5, "c", "q" * 400_000, 7, "p")]
    out = mix_sources(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "source", "text", "epoch", "Position", "n_tokens", "_epoch", "_position"]
    found = out.collect()
    first = [x for x in found if x._epoch == 0]
    assert sorted((x.doc_id or 0, x.n_tokens) for x in first) == [(0, 1), (1, 2), (1, 10), (1, 10), (2, 10), (3, 0), (4, 0), (5, 100_000)]
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    named = mix_sources(spark.createDataFrame(rows, schema), {"a": [(0, 1)]})
    assert {x.source for x in named.collect()} == {"a"}
    with pytest.raises(ValueError):
        mix_sources(out, {"a": [(0, -1)]})
