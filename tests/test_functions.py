"""Scalar functions and the streaming addition."""

from pyspark.sql import functions as F

from weftgraph.functions import scalar
from weftgraph.streaming.counts import windowed_counts


def test_titles(spark):
    df = spark.createDataFrame([("orderCreated-now_X",), ("",), (None,), ("ABC",)], "s string")
    assert [r[0] for r in df.select(scalar.title(F.col("s"))).collect()] == ["Order Created Now X", "", "", "Abc"]


def test_scores_and_names(spark):
    df = spark.createDataFrame([(True, None, "REPOSITORY"), (False, True, "SERVICE"), (False, None, "ENTITY")], "a boolean, m boolean, t string")
    assert [r[0] for r in df.select(scalar.dependency_score(F.col("a"), F.col("m"), F.col("t"))).collect()] == [0.93, 0.65, 0.55]
    e = spark.createDataFrame([("SCHEDULER", "nightlyRun", None, None, None), ("CDI_EVENT_OBSERVER", "n", None, None, "Done")], "k string, n string, m string, c string, p string")
    assert [r[0] for r in e.select(scalar.use_case_name(*map(F.col, "knmcp"))).collect()] == ["Scheduled: Nightly Run", "On Event: Done"]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    table.write.mode("overwrite").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/in")
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("counts")) == key(windowed_counts(table))
