from pyspark.sql import functions as F

from lectern.operators import sessions
from lectern.sources.sinks import Table
from lectern.streaming import sessions as stream
from lectern.tables import captures

from .conftest import SMALL

SCHEMA = "user_id long, capture_id long, ts timestamp_ntz, work_id string, themes array<string>, control string"


def run(query, name, spark):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_decides_as_batch(spark, tmp_path):
    batch = captures(spark, SMALL)
    batch.withColumn("control", F.lit(None).cast("string")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = run(stream.decide(source), "decided", spark).filter("action <> 'end'")
    want = sessions.decided(batch)
    key = lambda df: sorted((r.user_id, r.capture_id, r.session, r.reason) for r in df.collect())
    assert key(got) == key(want)


def test_manual_control(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    rows = [(1, 1, at(0), "a", ["x"], None), (1, 2, at(1), None, [], "stop"), (1, 3, at(2), "a", ["x"], None), (1, 4, at(3), "a", ["x"], None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(stream.decide(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), "manual", spark).filter("action <> 'end'").orderBy("capture_id").collect()
    assert [(r.capture_id, r.reason, r.session) for r in got] == [(1, "first", 1), (3, "manual_stop", 2), (4, "same_source", 2)]


def test_windows_and_duplicates(spark, tmp_path):
    batch = captures(spark, SMALL)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    seen = run(stream.first_seen(source), "seen", spark)
    assert seen.count() == batch.count()
    counts = run(stream.windowed_counts(source), "counts", spark)
    closed = counts.agg(F.sum("n")).first()[0]
    assert 0 < closed <= batch.count()


def test_batches_into_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = Table(spark, str(tmp_path / "t"), "k int, v string", ["k"])
    stream.upsert_batches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]
