import duckdb
from pyspark.sql import functions as F

from affinis.llm import bpe, mixing, near_dedup, quality, queries
from affinis.llm import pipeline as P
from affinis.llm.shared import table

D = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_act(spark):
    docs = table(spark, D, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] and seen[4] >= seen[3]
    last = P.STAGES[-1][1](spark, docs, D)
    assert last.count() == seen[3] and last.where("not exact").count() == 0  # one encoding a document
    assert sorted(p for r in last.collect() for p in r.positions) == sorted(r.position for r in P._placed(docs).collect())


def test_run_equals_its_parts_by_hand(spark):
    """Against the operators' own results put together on the driver."""
    docs = table(spark, D, "documents")
    labels = table(spark, D, "labels")
    kept = quality.classify(docs, quality.fit(docs, labels)).where("kept").select(*docs.columns).toPandas()
    first = kept.sort_values("doc_id").drop_duplicates("text")
    near = near_dedup.near_dedup(spark.createDataFrame(first))
    placed = mixing.mix_sources(spark.createDataFrame(near.toPandas()))
    tokens = {r.doc_id: r.n_tokens for r in bpe.bpe_encode(near, keep=["doc_id"]).collect()}
    epochs = {r.doc_id: r.n for r in placed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert sorted((i, tokens[i], n) for i, n in epochs.items()) == sorted((r.doc_id, r.n_tokens, len(r.positions)) for r in P.run(spark, D).collect())


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, D)
        rows = sorted(map(tuple, con.sql(sql).select(*df.columns).fetchall()), key=repr)
        assert sorted(map(tuple, df.collect()), key=repr) == rows, name


def test_edge_cases(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, text_hash string, tokens int, `position` string, `a.b` int, `c``d` int, gone_id string, gone_hash int, place string, maps array<map<string, int>>"
    extra = (False, "h", 1, "p", 2, 3, "g", 4, "q", [{"x": 1}, {}])
    rows = [
        (1, None, "en", "a", None, *extra), (2, None, None, None, None, *extra), (3, "", "en", "a", 0, *extra), (4, "", "en", "b", 0, *extra),
        (5, "some plain words of an ordinary text.", "en", "a", 37, *extra), (5, "some plain words of an ordinary text.", "en", "a", 37, *extra),
        (6, "Some plain words of an ordinary text!", "en", None, 37, *extra), (None, "another text without an id.", None, "b", None, *[None] * 10),
        (7, "word " * 1000 + "x" * 100_000, "en", "b", 1, *extra),
    ]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1, 0), (5, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    found = P.run(spark, str(tmp_path)).collect()
    first = {r.doc_id: r for r in found}
    assert set(first) == {1, 2, 3, 5, 7, None} and first[1].tokens is None and first[3].tokens == [] and all(r.exact for r in found if r.tokens is not None)


def test_planted_copies_in_the_real_table(spark):
    rows = [tuple(r) for r in table(spark, D, "documents").select("doc_id", "text").collect()]
    from test_near_dedup import brute

    assert sorted(r.doc_id for r in queries.op6_near_dedup(spark, D).collect()) == brute(rows)


def test_positions_give_the_order_in_which_rows_were_written(spark, tmp_path):
    """Files of uneven size, which a plain read takes out of order."""
    rows = [(i, "en", "a", f"text {i} " * (1 if i < 20 else 300)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    docs.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 4).parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert [r.doc_id for r in read.collect()] != list(range(60))
    found = P.token_ids(spark, read, D).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.positions)] == list(range(60))
    assert sorted(r.positions for r in found) == [[i] for i in range(60)]


def test_run_keeps_the_order_of_mixing(spark, monkeypatch):
    written = []
    monkeypatch.setattr(P, "stash", lambda df, what, stash=P.stash: written.append(stash(df, what)) or written[-1])
    out = P.run(spark, D)
    docs = written[2]
    again = {}
    for r in mixing.mix_sources(docs).collect():
        again.setdefault(r.position, []).append((r.doc_id, r.epoch))
    places = [(p, r.doc_id, e) for r in out.collect() for e, p in enumerate(r.positions)]
    assert sorted(p for p, _, _ in places) == list(range(len(places)))  # every place once
    found = [(i, e) for _, i, e in sorted(places)]  # every (epoch, position)
    for ids in (again[p] for p in sorted(again)):
        some, found = found[: len(ids)], found[len(ids) :]
        assert sorted(some) == sorted(ids)
    assert found == []
