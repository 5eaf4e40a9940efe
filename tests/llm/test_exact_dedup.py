import random

from affinis.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, content_hash int, row_tie string, Bucket int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def expected(rows):
    best = {}
    for r in rows:
        if r[1] is not None:
            key = (r[0] is None, r[0] or 0)
            if r[1] not in best or key < best[r[1]][0]:
                best[r[1]] = (key, r)
    return sorted([r for _, r in best.values()] + [r for r in rows if r[1] is None], key=repr)


def test_edge_cases(spark):
    long = "x" * 3_000_000
    rows = [(3, "a", 1, "p", 1), (1, "a", 1, "p", 2), (None, "a", None, None, None), (None, "b", 2, "q", 3), (4, "", 1, "p", 1), (5, "", 1, "p", 1), (6, None, 1, "p", 1), (7, None, 1, "p", 1), (8, long, 1, "p", 1), (9, long, 1, "p", 1), (10, long + "y", 1, "p", 1), (11, "A", 1, "p", 1)]
    assert rows_of(exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)


def test_repeated_rows_become_one(spark):
    rows = [(1, "a", 1, "p", 1)] * 5 + [(None, None, None, None, None)] * 2
    assert len(exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == 3


def test_empty_table(spark):
    out = exact_dedup(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "text", "content_hash", "row_tie", "Bucket"] and out.count() == 0


def test_spilling_changes_nothing(spark):
    r = random.Random(1)
    rows = [(i, f"text {r.randrange(300)} " + "z" * r.randrange(50), 1, "p", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    small = rows_of(exact_dedup(df, memory_bytes=3000))
    assert small == rows_of(exact_dedup(df)) == expected(rows)


def test_a_text_column_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", {"k": [1]}), (2, "a", None), (3, "b", None)], "doc_id long, `my.te``xt` string, m map<string, array<int>>")
    out = exact_dedup(docs, text="my.te`xt")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_paths_of_the_cluster_are_paths_of_arrow():
    from affinis.llm.shared import file_system, file_uri

    assert [file_uri(x) for x in ("s3a://b/k", "s3n://b/k", "dbfs:/x/y", "file:/x", "/x")] == ["s3://b/k", "s3://b/k", "file:///dbfs/x/y", "file:/x", "/x"]
    assert file_system("file:///tmp/x")[1] == "/tmp/x"
