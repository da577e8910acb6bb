"""Streams give what batches give."""

from pyspark.sql import functions as F

from sparkworks.streaming import messages, sinks


def test_round_trip_and_rejects(spark):
    df = spark.createDataFrame([("hello",), ("",), ('quote " and é',)], "text string")
    decoded = messages.decode_messages(messages.encode_messages(df))
    assert {r["message"] for r in messages.accepted(decoded).collect()} == {"hello", "", 'quote " and é'}
    bad = spark.createDataFrame([("{broken",), ('{"other": 1}',), (None,)], "value string")
    assert messages.rejected(messages.decode_messages(bad)).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(50).select(F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("m"), "id")).alias("text"), F.when(F.col("id") % 7 == 0, "GET").otherwise("POST").alias("method"))
    df.write.json(source)
    stream = spark.readStream.schema("text string, method string").json(source)
    run = messages.validate_stream(stream).writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted(map(str, spark.read.schema("text string, method string, error string").json(out).collect()))
    assert got == sorted(map(str, messages.validate_stream(df).collect()))
    assert messages.validate_stream(df).filter("error is null").count() == len([k for k in range(50) if k % 5 and k % 7])


class Stopped(Exception):
    pass


def split_stream(spark, source):
    raw = spark.readStream.schema("value string").text(source)
    return messages.decode_messages(raw)


def test_a_stop_between_the_sinks_loses_and_repeats_nothing(spark, tmp_path):
    """The stream fails once after the good rows of a batch are written and before its rejects are, and once after both."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    lines = [f'{{"message": "m{k}"}}' if k % 3 else f"broken {k}" for k in range(60)]
    for part in range(4):
        spark.createDataFrame([(x,) for x in lines[15 * part : 15 * part + 15]], "value string").coalesce(1).write.mode("append").text(source)
    good = ~F.col("is_malformed")
    plain = sinks.SplitSink(out, good)
    failed = []

    def write(rows, side, batch):
        if batch == 1 and side == "rejected" and len(failed) == 0:
            failed.append("between")
            raise Stopped
        plain._replace(rows, side, batch)
        if batch == 2 and side == "rejected" and len(failed) == 1:
            failed.append("after")
            raise Stopped

    for stop in range(3):
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(source)
        run = sinks.SplitSink(out, good, write).start(messages.decode_messages(stream), checkpoint)
        if stop < 2:
            try:
                run.awaitTermination(120)
                raise AssertionError("the stream did not stop")
            except Exception as error:
                assert "Stopped" in str(error)
            if stop == 0:  # good rows of batch 1 are there, its rejects are not
                assert len({r["batch"] for r in plain.read(spark, "accepted").select("batch").collect()}) == 2
                assert len({r["batch"] for r in plain.read(spark, "rejected").select("batch").collect()}) == 1
        else:
            assert run.awaitTermination(120)
    assert failed == ["between", "after"]
    assert sorted(r["message"] for r in plain.read(spark, "accepted").collect()) == sorted(f"m{k}" for k in range(60) if k % 3)
    assert sorted(r["value"] for r in plain.read(spark, "rejected").collect()) == sorted(f"broken {k}" for k in range(60) if k % 3 == 0)
    # Later files only add to it.
    spark.createDataFrame([("late",), ('{"message": "more"}',)], "value string").coalesce(1).write.mode("append").text(source)
    run = sinks.SplitSink(out, good).start(split_stream(spark, source), checkpoint)
    assert run.awaitTermination(120)
    assert plain.read(spark, "accepted").count() == 41 and plain.read(spark, "rejected").count() == 21


def test_a_null_verdict_is_a_reject(spark, tmp_path):
    sink = sinks.SplitSink(str(tmp_path), F.col("x") > 1)
    for _ in range(2):  # the same batch again
        sink(spark.createDataFrame([(1,), (2,), (None,)], "x int"), 7)
    assert [r["x"] for r in sink.read(spark, "accepted").collect()] == [2]
    assert sink.read(spark, "rejected").count() == 2 and {r["batch"] for r in sink.read(spark, "rejected").collect()} == {7}
