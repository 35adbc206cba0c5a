"""Sinks and the filling of stubs: what is written is read again, also after a retry."""

from pyspark.sql import functions as F

from memlattice.sources import parsers, sinks
from memlattice.streaming import pipelines as P


def test_json_lines_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\nx"), (2, None)], "id long, t string")
    sinks.write_json_lines(df, f"{tmp_path}/j")
    good, bad = parsers.read_json_lines(spark, f"{tmp_path}/j", "id long, t string")
    assert sorted(map(tuple, good.select("id", "t").collect())) == [(1, "é\nx"), (2, None)] and bad.count() == 0
    for _ in range(2):
        sinks.append_log(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_paired_turns(spark):
    rows = [("c", 1, "hi"), ("c", 2, "hello"), ("c", 3, "bye"), ("d", 1, "x"), ("d", 2, "y"), ("d", 3, "z"), ("d", 4, "w")]
    got = parsers.paired_turns(spark.createDataFrame(rows, "key string, turn long, text string"), "key", "text")
    assert sorted((r.key, r.user, r.assistant) for r in got.collect()) == [("c", "hi", "hello"), ("d", "x", "y"), ("d", "z", "w")]


def test_a_retried_batch_is_stored_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string").repartition(2).write.parquet(f"{tmp_path}/in")
    paths = [f"{tmp_path}/{n}" for n in ("episodes", "edges", "checkpoint")]
    words = lambda batch: batch.select("id", F.explode(F.split("text", " ")).alias("o"))
    for retry in range(2):
        stream = P.event_stream(spark, f"{tmp_path}/in", "id long, text string", 1)
        P.fill_stubs(stream, words, paths[0], paths[1], f"{paths[2]}{retry}").awaitTermination()  # a new checkpoint: every batch runs again
        assert spark.read.parquet(paths[0]).count() == 2 and spark.read.parquet(paths[1]).count() == 3
