import pytest

from affinis.sources import tables
from affinis.streaming import match


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'line one\nline "two"', None), (2, "é, x", 0.5)], "id int, `a b (c)` string, z double")
    for kind in ("csv", "jsonl", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        tables.write_table(df, path)
        back = tables.read_table(spark, path).select(*[f"`{c}`" for c in df.columns])
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert tables.read_table(spark, df) is df
    (tmp_path / "one.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert tables.read_table(spark, str(tmp_path / "one.json")).count() == 2
    for bad in ("x.txt", "x.xlsx"):
        with pytest.raises(ValueError):
            tables.read_table(spark, str(tmp_path / bad))
    with pytest.raises(ValueError):
        tables.write_table(df, "x.txt")
    tables.write_label_map({"b": 1, "a": 0}, str(tmp_path / "m.json"))
    assert tables.read_label_map(str(tmp_path / "m.json")) == {"a": 0, "b": 1}


def test_stream_against_reference(spark, tmp_path):
    schema = "id long, name string, at timestamp"
    rows = spark.sql("SELECT * FROM VALUES (1L, 'Acme Corp', timestamp'2024-01-01'), (2L, 'Beta', timestamp'2024-01-01 00:01'), (2L, 'Beta', timestamp'2024-01-01 00:02') t(id, name, at)")
    rows.write.parquet(str(tmp_path / "in"))
    reference = spark.createDataFrame([(10, "Acme Corporation"), (11, "Beta Ltd"), (12, "beta")], "ref long, label string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    match.start(stream, reference, str(tmp_path / "out"), str(tmp_path / "cp"), left_on="name", right_on="label", left_id="id", right_id="ref").awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.id, r.ref) for r in found} == {(1, 10), (2, 12)}
    joined = match.exact_match(match.drop_repeats(stream, ["id"], "at", "1 hour"), reference, "name", "label")
    query = joined.writeStream.format("memory").queryName("exact").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.id, r.ref) for r in spark.table("exact").collect()) == [(1, None), (2, 12)]
