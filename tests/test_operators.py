import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import text, vectors
from affinis.operators import cluster, embed, graph, judge, linkage, metrics, prep, rows, train
from affinis.operators.embed import Precomputed
from affinis.plans.ranking import dense_ids
from affinis.sources import tables

# text and vectors


def test_serialize(spark):
    df = spark.createDataFrame([("a", None, 3), (None, None, None)], "x string, y string, z int")
    assert [r[0] for r in df.select(text.serialize(["x", "y", "z"], "|")).collect()] == ["a||3", "||"]
    with pytest.raises(ValueError):
        text.serialize([])


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b")), vectors.euclidean(F.col("a"), F.col("b")), vectors.manhattan(F.col("a"), F.col("b")), vectors.normalise(F.col("a"))).collect()
    assert tuple(got[0])[:4] == pytest.approx((24, 0.96, 2**0.5, 2)) and got[0][4] == pytest.approx([0.6, 0.8])
    assert tuple(got[1])[:2] == (0, None) and got[1][4] == [0, 0]


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, None, 3, 9]], "k int")
    assert {(r.k, r.n) for r in dense_ids(df, ["k"], "n").collect()} == {(None, 0), (3, 1), (5, 2), (9, 3)}


# providers


def test_routing(monkeypatch):
    monkeypatch.delenv("GEMINI_API_KEY", raising=False)
    assert embed.gemini_key("g", "o") == "g" and embed.gemini_key(None, "o") == "o"
    monkeypatch.setenv("GEMINI_API_KEY", "env")
    assert embed.gemini_key(None, "o") == "env"
    monkeypatch.delenv("GEMINI_API_KEY")
    with pytest.raises(ValueError):
        embed.gemini_key()
    assert [embed.provider(m) for m in ("text-embedding-004", "text-embedding-3-small", "all-MiniLM-L6-v2")] == ["gemini", "openai", "local"]
    with pytest.raises(ValueError, match="not from both"):
        embed.retrieval("m", "text-embedding-3-small")
    with pytest.warns(UserWarning, match="no model is named"):
        assert embed.retrieval(default="text-embedding-3-small") == ("openai", "text-embedding-3-small")
    assert embed.retrieval("m") == ("local", "m") and embed.retrieval(api="gemini-embedding-001")[0] == "gemini"
    assert embed.retrieval(api="auto", gemini="g", openai="o")[0] == "gemini" and embed.retrieval(api="auto", openai="o")[0] == "openai"
    assert embed.gemini_name("x") == "models/x" == embed.gemini_name("models/x")
    assert embed.character_batches(["a" * 9, "b" * 2, "c" * 2], 4) == [["a" * 9], ["b" * 2, "c" * 2]]


# judges


@pytest.mark.parametrize(
    "answer, verdict",
    [
        ('{"is_match": true, "confidence": 0.9}', (1, 0.9)), ('{"match": "Yes", "score": "0.25"}', (1, 0.25)), ('{"label": 0, "probability": 7}', (0, 1.0)),
        ('{"label": 2}', (1, 0.0)), ('{"is_match": "no", "confidence": "x"}', (0, 0.0)), ("[1, 0.5]", (1, 0.5)), ("[0]", (0, 0.0)), ("3", (0, 0.0)),
        ("Yes, I am 0.8 sure", (1, 0.8)), ("no match 0.3 or 0.6", (1, 0.6)), ("never", (0, 0.0)), ("", (0, 0.0)), (None, (0, 0.0)),
    ],
)
def test_verdicts(answer, verdict):
    assert judge.parse_verdict(answer) == verdict


def test_judge(spark):
    a = spark.createDataFrame([(1, "Acme", "US"), (2, "Beta", None)], "id long, name string, country string")
    b = spark.createDataFrame([(1, "Acme Inc", "US"), (2, "Beta Co", "UK")], "id long, name string, country string")

    def ask(prompt, payload):
        record = json.loads(payload)
        assert set(record["left"]) == {"name", "country"}
        return json.dumps({"is_match": record["left"]["country"] == record["right"]["country"], "confidence": 0.7})

    out = judge.merge_k_judge(a, b, judge.Judge(ask), on=["name", "country"], k=2, left_id="id", right_id="id").collect()
    assert {(r.id_x, r.id_y): r.llm_is_match for r in out} == {(1, 1): 1, (1, 2): 0, (2, 1): 0, (2, 2): 0}
    assert all(0 <= r.llm_confidence <= 1 for r in out)
    none = judge.merge_k_judge(a, b, judge.Judge(ask, retries=0), on="name", k=1, confidence_threshold=0.5)
    assert none.count() == 0

    def fails(prompt, payload):
        raise OSError("down")

    with pytest.raises(RuntimeError, match="merge_knn"):
        judge.Judge(fails, retries=2, pause=0).answer("{}")
    with pytest.raises(ValueError):
        judge.judge_provider(None)
    with pytest.raises(ValueError):
        judge.judge_provider("gpt-4o", "other")
    assert judge.judge_provider("gemini-pro", keys={"gemini": "k"}) == "gemini"


# rows


def test_chunks_and_transforms(spark):
    assert rows.apply_in_chunks(list(range(7)), lambda x, o: [i * 2 for i in x], chunk_size=3) == [0, 2, 4, 6, 8, 10, 12]
    with pytest.raises(ValueError):
        rows.apply_in_chunks([1, 2], lambda x, o: [1], chunk_size=2)
    df = spark.createDataFrame([("a", "x"), (None, "y")], "text string, suffix string")
    upper = lambda x, o: [None if t is None else t.upper() for t in x]
    assert [r.transformed_text for r in rows.transform_rows(df, "text", upper).collect()] == ["A"]
    assert [r["transformed_text-suffix"] for r in rows.transform_rows(df, ["text", "suffix"], upper).collect()] == ["A</S>X", "</S>Y"]
    with pytest.raises(KeyError):
        rows.transform_column(df, "none", upper)


def test_classify(spark):
    df = spark.createDataFrame([("good",), ("bad",), ("?",)], "article string")
    answers = lambda x, o: [{"good": 1, "bad": 0}.get(t) for t in x]
    out = rows.classify_rows(df, "article", answers, 2, {"Yes": 1, "No": 0})
    assert [r.clf_preds_article for r in out.collect()] == ["Yes", "No", None]
    assert [r.clf_preds_article for r in rows.to_numbers(out, "clf_preds_article", {"Yes": 1, "No": 0}).collect()] == [1, 0, None]
    assert rows.to_numbers(out, "clf_preds_article", {"Yes": 1}).dtypes[1][1] == "string"
    with pytest.raises(ValueError):
        rows.classify_rows(df, "article", answers, 3, {"Yes": 1, "No": 0})


# graphs and clusters


@pytest.mark.parametrize("most", [0, graph.ONE_TASK])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "ONE_TASK", most)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(500, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "src long, dst long")
    assert {(x.node, x.component) for x in graph.connected_components(df).collect()} == {(n, find(n)) for n in parent}
    assert graph.connected_components(df.limit(0)).count() == 0
    clusters = graph.clusters_from_edges(spark.createDataFrame([("b", "a"), ("d", "c"), ("c", "e")], "src string, dst string")).orderBy("cluster").collect()
    assert [c.nodes for c in clusters] == [["a", "b"], ["c", "d", "e"]]


def brute_dbscan(x, eps, least):
    d = np.round(1 - x @ x.T, 6) <= round(eps, 6)
    core = d.sum(1) >= least
    label = np.full(len(x), -1)
    n = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = n
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(d[j] & core & (label < 0)):
                    label[k] = n
                    todo.append(k)
            n += 1
    out = label.copy()
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        out[i] = near.min() if len(near) else -1
    return out.tolist()


@pytest.mark.parametrize("least", [1, 2, 4])
def test_dbscan(spark, least):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    out = cluster.cluster_rows(df, embedder=Precomputed("v"), cluster_params={"threshold": 0.12, "min cluster size": least}, id="id").orderBy("id").collect()
    assert [r.cluster for r in out] == brute_dbscan(x, 0.12, least)


def naive_hac(d, threshold, linkage):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        def gap(a, b):
            part = d[np.ix_(a, b)]
            return {"single": part.min(), "complete": part.max(), "average": part.mean()}[linkage]
        best, i, j = min((gap(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if best >= threshold:
            break
        groups[i] += groups.pop(j)
    label = np.zeros(len(d), int)
    for n, g in enumerate(sorted(map(sorted, groups))):
        label[g] = n
    return label.tolist()


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_agglomerative(spark, linkage):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    params = {"threshold": 0.3, "clustering linkage": linkage, "metric": "cosine"}
    out = cluster.cluster_rows(df, embedder=Precomputed("v"), cluster_type="agglomerative", cluster_params=params, id="id").orderBy("id").collect()
    assert [r.cluster for r in out] == naive_hac(1 - x @ x.T, 0.3, linkage)


def test_ward_merges_by_variance():
    x = np.array([[0, 0], [0, 1], [5, 0], [5, 1], [20, 0]], float)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert len(set(cluster.hac(d, 2.0, "ward"))) == 3 and len(set(cluster.hac(d, 8.0, "ward"))) == 2
    assert cluster.hac(d, 8.0, "ward").tolist() == [0, 0, 0, 0, 4]


def test_hdbscan_finds_blobs():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((30, 2)) * 0.1 + c for c in ([0, 0], [5, 5], [0, 5])] + [np.array([[2.5, 2.5], [9.0, 0.0]])])
    label = cluster.hdbscan(x, 5, 3)
    assert all(len(set(label[k : k + 30])) == 1 and label[k] >= 0 for k in (0, 30, 60)) and len({label[0], label[30], label[60]}) == 3
    assert label[-1] == -1 and (cluster.hdbscan(x[:3], 5, 1) == -1).all()


def test_cluster_parameters_and_dedup(spark):
    given = {"threshold": 0.3}
    assert cluster.parameters("SLINK", given)["min cluster size"] == 2 and given == {"threshold": 0.3}
    with pytest.raises(ValueError):
        cluster.parameters("other")
    df = spark.createDataFrame([(1, "acme corp"), (2, "acme corp"), (3, "acme corp."), (4, "beta"), (5, "gamma")], "id long, name string")
    keep = cluster.dedup_rows(df, "name", cluster_params={"threshold": 0.4}, id="id")
    assert sorted(r.id for r in keep.collect()) == [1, 4, 5]
    assert sorted(r.id for r in cluster.dedup_rows(df, "name", cluster_params={"threshold": 0.4}, id="id", noise="collapse").collect()) == [1, 4]
    with pytest.raises(ValueError):
        cluster.cluster_rows(df, "name", cluster_type="agglomerative", cluster_params={"clustering linkage": "ward", "metric": "cosine"}, id="id")


# measures


def test_threshold_sweep_against_all_cuts(spark):
    r = random.Random(6)
    data = [(round(r.random(), 2), int(r.random() < 0.4)) for _ in range(300)] + [(None, 1), (None, 0), (0.5, None)]
    df = spark.createDataFrame(data, "score double, label int")
    known = [(s, y) for s, y in data if y is not None]
    positives = sum(y for _, y in known)
    cuts = []
    for t in {s for s, _ in known if s is not None}:
        said = [(s, y) for s, y in known if s is not None and s >= t]
        tp = sum(y for _, y in said)
        cuts.append((round(2 * tp / (len(said) + positives), 6), round((tp + len(known) - len(said) - positives + tp) / len(known), 6), t))
    best = metrics.best_threshold(df).collect()[0]
    assert (best.f1, best.threshold) == max((f, t) for f, _, t in cuts)
    top = metrics.best_accuracy(df).collect()[0]
    assert (top.accuracy, top.threshold) == max((a, t) for _, a, t in cuts)


def test_ir_metrics_by_hand(spark):
    hits = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("b", "y", 1), ("c", "x", 1)], "qid string, cid string, rank int")
    relevant = spark.createDataFrame([("a", "y"), ("a", "w"), ("b", "y"), ("d", "x")], "qid string, cid string")
    got = metrics.ir_metrics(hits, relevant, ks=(1, 3)).collect()[0]
    assert (got.queries, got.accuracy_1, got.accuracy_3) == (3, round(1 / 3, 6), round(2 / 3, 6))
    assert got.recall_3 == round((0.5 + 1 + 0) / 3, 6) and got.precision_3 == round((1 / 3 + 1 / 3) / 3, 6)
    assert got.mrr == 0.5 and got.map == round((0.25 + 1 + 0) / 3, 6)
    ideal = 1 + 1 / np.log2(3)
    assert got.ndcg == round((1 / np.log2(3) / ideal + 1) / 3, 6)
    assert metrics.matching_accuracy(hits, relevant).collect()[0].accuracy == round(2 / 3, 6)


def test_classification_without_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (None, 1)], "y int, p int")
    assert tuple(metrics.classification_metrics(df, "y", "p").collect()[0]) == (0.5, 0, 0, 0)
    assert tuple(metrics.classification_metrics(df.limit(0), "y", "p").collect()[0]) == (0, 0, 0, 0)


# preparation and training


def test_components_never_straddle_splits(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(f"l{r.randrange(150)}", f"r{r.randrange(150)}") for _ in range(160)], "a string, b string")
    pairs = prep.prepare_pairs(df, ["a"], ["b"])
    out = prep.linkage_data(pairs, large_val=True)
    in_train = {t for row in out["train"].collect() for t in row.texts}
    queries = {row.text for row in out["queries"].collect()}
    own = {row.text for row in out["corpus"].where("cid not like '%_train'").collect()}
    assert not in_train & queries and not in_train & own and queries
    relevant = out["relevant"].join(out["queries"].drop("text"), ["split", "qid"]).join(out["corpus"].drop("text"), ["split", "cid"])
    assert relevant.count() == out["relevant"].count()


def test_preparation_checks(spark):
    df = spark.createDataFrame([("a", "b", 1), (None, "c", 1), ("a", "b", 0), ("d", None, 1)], "x string, y string, label int")
    assert prep.prepare_pairs(df, ["x"], ["y"], label="label").count() == 1
    for arguments in ({"left_on": ["x"]}, {"cluster": ["y"], "label": "label"}):
        with pytest.raises(ValueError):
            prep.preprocess(df, **arguments)
    with pytest.raises(ValueError):
        prep.prepare_clusters(df, ["none"], ["x"])
    assert set(prep.preprocess(df, ["x"], ["y"], label="label")) == {"pairs"}
    shares = spark.range(20_000).select(prep.split_of(F.col("id")).alias("s")).groupBy("s").count().collect()
    assert {r.s: round(r["count"] / 20_000, 1) for r in shares} == {"train": 0.8, "val": 0.1, "test": 0.1}


def test_losses():
    x = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]])
    assert train.supervised_contrastive_loss(x, np.array([0, 0, 1, 1])) < 0.01 < train.supervised_contrastive_loss(x, np.array([0, 1, 0, 1]))
    assert train.online_contrastive_loss(np.array([0.1, 0.9]), np.array([1, 0])) == 0
    assert train.online_contrastive_loss(np.array([0.6, 0.1, 0.2, 0.9]), np.array([1, 1, 0, 0])) == pytest.approx(0.6**2 + 0.3**2)


def test_training(spark, tmp_path):
    r = random.Random(8)
    data = [(" ".join(r.choice(["sun", "warm", "light"] if y else ["rain", "cold", "dark"]) for _ in range(6)) + f" {i}", "ny"[y]) for i, y in ((i, i % 2) for i in range(200))]
    model, labels, measures = train.train_classifier(spark.createDataFrame(data, "t string, y string"), ["t"], "y")
    assert measures["accuracy"] == 1.0 and {r.label: r.number for r in labels.collect()} == {"n": 0, "y": 1}
    pairs = [(f"name {i}", f"name {i}!" if i % 2 else "other thing", i % 2) for i in range(200)]
    config = train.LinkageConfig(["a"], ["b"])
    config.write(str(tmp_path / "c.json"))
    assert train.LinkageConfig.read(str(tmp_path / "c.json"), n=4).n == 4
    threshold, measures = train.train_linkage(spark.createDataFrame(pairs, "a string, b string, label int"), config)
    assert 0.3 < threshold <= 1 and measures["f1"] == 1.0


# requests, models, tokens


def test_requests_fail_row_by_row(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, t string")

    def ask(messages, parameters):
        assert messages[0]["content"] == "Is the text about wine? Answer Yes or No." and parameters["temperature"] == 0.5
        if messages[1]["content"] == "bad":
            raise RuntimeError("too many")
        return "Yes" if messages[1]["content"] else "No"

    out = rows.classify_by_requests(df, "t", ask, topic="wine", parameters={"temperature": 0.5}, retries=2, pause=0)
    assert sorted(map(tuple, out.collect())) == [(1, "good", 1, None), (2, "bad", None, "RuntimeError: too many"), (3, None, 0, None)]
    strange = rows.classify_by_requests(df, "t", lambda m, p: "Maybe", topic="wine", pause=0)
    assert {r.clf_preds_t for r in strange.collect()} == {"Maybe"}  # all or nothing
    with pytest.raises(ValueError, match="topic or a prompt"):
        rows.classify_by_requests(df, "t", ask)
    with pytest.raises(ValueError, match="3 labels"):
        rows.classify_by_requests(df, "t", ask, topic="x", label_map={"a": 0, "b": 1, "c": 2})
    with pytest.warns(UserWarning, match="labels Yes and No"):
        rows.classify_by_requests(df, "t", lambda m, p: "Yes", prompt="own")


def test_a_request_is_tried_again():
    tries = []

    def ask(messages, parameters):
        tries.append(json.loads(messages[1]["content"]))
        return "[1" if len(tries) == 1 else '["a"]' if len(tries) == 2 else '["A", "B"]'

    assert rows.array_transform(ask, "capitals", pause=0)(["a", "b"], {}) == ["A", "B"] and len(tries) == 3
    with pytest.raises(ValueError, match="no array of 1"):
        rows.array_transform(lambda m, p: "[]", "x", retries=2, pause=0)(["a"], {})


def test_label_of_scores(spark):
    df = spark.createDataFrame([([0.1, 0.7],), ([0.5, 0.5],), ([],), (None,)], "s array<double>")
    assert [r.prediction for r in rows.label_of_scores(df, "s").collect()] == [1, 0, None, None]
    assert [r.prediction for r in rows.label_of_scores(df, "s", {"no": 0, "yes": 1}).collect()] == ["yes", "no", None, None]


def test_a_model_is_loaded_once_a_worker(spark):
    def counting(start):
        calls = {"loads": start}

        def encode(texts):
            calls["loads"] += 1
            return [[float(len(t)), float(calls["loads"])] for t in texts]

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 7)], "id int, t string").coalesce(1)
    out = df.withColumn("v", embed.load_encoder(counting, 0, batch_size=2).column(F.col("t"))).collect()
    assert [r.v[0] for r in out] == [1, 2, 3, 4, 5, 6] and [r.v[1] for r in out] == [1, 1, 2, 2, 3, 3]
    with pytest.raises(FileNotFoundError):
        embed.onnx_model("/nowhere")


def test_tokenize(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    out = embed.tokenize(spark.createDataFrame([("hello world",), (None,), ("word " * 50,)], "t string"), "t", path, 8).collect()
    assert all(len(r.input_ids) == len(r.attention_mask) == 8 for r in out)
    assert [sum(r.attention_mask) for r in out] == [2, 0, 8]


def test_ngram_cosine_against_counting(spark):
    import random
    from collections import Counter

    r = random.Random(1)
    texts = [("".join(r.choice("abA ") for _ in range(r.choice([0, 1, 2, 3, 9, 40]))), "".join(r.choice("ab ") for _ in range(r.choice([0, 1, 3, 20])))) for _ in range(60)]

    def grams(t):
        t = t.lower()
        return Counter(t[i : i + 3] for i in range(max(1, len(t) - 2))) if t else Counter()

    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "i int, a string, b string").withColumn("c", text.ngram_cosine(F.col("a"), F.col("b")))
    for row in df.collect():
        x, y = grams(row.a), grams(row.b)
        if not x or not y:
            assert row.c is None
        else:
            want = sum(x[g] * y[g] for g in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
            assert abs(row.c - want) < 1e-12


def test_samples_and_preview(spark):
    sample = tables.sample_tables(spark)
    assert set(sample) == {"firms_a", "firms_b", "products"} and tables.preview(sample["products"], 2).count() == 2
    found = linkage.merge(sample["firms_a"], sample["firms_b"], left_on="firm", right_on="company", left_id="id", right_id="number")
    assert {(r.id, r.number) for r in found.collect()} >= {(1, 101), (2, 102), (3, 103)}


def test_older_names_of_the_judged_merge(spark):
    left, right = spark.createDataFrame([(1, "acme")], "i int, n string"), spark.createDataFrame([(2, "acme corp")], "j int, m string")
    asking = judge.Judge(lambda prompt, payload: "yes 0.9")
    options = {"left_on": "n", "right_on": "m", "k": 1, "left_id": "i", "right_id": "j"}
    want = judge.merge_k_judge(left, right, asking, **options).collect()
    assert judge.merge_knn_with_llm(left, right, asking, **options).collect() == want and want[0].llm_is_match == 1
    with pytest.warns(DeprecationWarning, match="merge_k_judge"):
        assert judge.merge_knn_openai(left, right, asking, **options).collect() == want


def test_pairs_of_label_one(spark):
    rows_ = [("a", "x", 1), ("a", "y", 0), ("b", "z", 1), ("b", None, 1)]
    pairs = prep.prepare_pairs(spark.createDataFrame(rows_, "l string, r string, label int"), ["l"], ["r"], ["l"], ["r"], label="label")
    assert sorted(sorted(r.texts) for r in prep.positive_clusters(pairs).collect()) == [["a", "x"], ["b", "z"]]
