"""The state of items over restarts, with late, repeated and disordered events; writing in one transaction."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from structcheck.sources import sinks
from structcheck.streaming import progress

EVENTS = "item string, id long, ts timestamp, status string, types long"


def at(minute):
    return datetime.datetime(2024, 1, 1, 10, 0) + datetime.timedelta(minutes=minute)


def test_state_of_items(spark, tmp_path):
    src, out, seen = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    os.makedirs(f"{tmp_path}/in")
    count = iter(range(100))

    def put(*events):
        n = next(count)
        spark.createDataFrame([(i, k, at(m), s, t) for i, k, m, s, t in events], EVENTS).coalesce(1).write.mode("append").parquet(f"{src}/{n:02d}")

    def run():
        """Starts the stream anew from its checkpoint and ends it when all files are read."""
        events = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
        q = progress.tracked(events, "10 minutes", 15).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive
        rows = spark.read.parquet(out)
        return {r["item"]: (r["status"], r["types"], r["n_events"], r["expired"]) for r in progress.state_of(rows).collect()}, rows.count()

    put(("a", 1, 0, "CLONING", None), ("b", 2, 1, "CLONING", None), ("a", 3, 3, "EXTRACTING", 7))
    first, _ = run()
    assert first == {"a": ("EXTRACTING", 7, 2, False), "b": ("CLONING", None, 1, False)}
    put(("a", 4, 2, "DISCOVERING", 5), ("a", 3, 3, "EXTRACTING", 7), ("b", 5, 6, "COMPLETED", None))  # out of order, repeated
    second, rows = run()
    assert second == {"a": ("EXTRACTING", 7, 2, False), "b": ("COMPLETED", None, 2, False)} and rows == 3  # what changes nothing gives no row
    put(("c", 6, 40, "CLONING", 1))  # the watermark goes to 30, beyond what a and b may be silent
    put(("e", 9, 41, "CLONING", None))  # what is late is told by the batch before
    put(("a", 7, 5, "FAILED", None), ("d", 8, 41, "CLONING", None))  # later than allowed
    third, _ = run()
    assert third["a"] == ("EXTRACTING", 7, 3, True) and third["b"] == ("COMPLETED", None, 2, False)
    assert third["c"] == ("CLONING", 1, 1, False) and third["d"] == ("CLONING", None, 1, False)
    again, _ = run()
    assert again == third


def test_events_in_any_order_give_the_same_state_as_a_batch(spark, tmp_path):
    rows = [(f"i{k % 7}", k, at(k * 37 % 50), f"S{k % 5}", k if k % 3 else None) for k in range(200)]
    os.makedirs(f"{tmp_path}/in")
    for n in range(4):
        spark.createDataFrame(rows[n::4], EVENTS).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    events = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = progress.tracked(events, "2 hours").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["item"]: (r["status"], r["types"]) for r in progress.state_of(spark.read.parquet(f"file://{tmp_path}/out")).collect()}
    want = {i: (max((t, k, s) for j, k, t, s, _ in rows if j == i)[2], max((t, k, n) for j, k, t, _, n in rows if j == i and n is not None)[2]) for i in {r[0] for r in rows}}
    assert got == want


def test_ready_needs_status_and_output(spark):
    status = spark.createDataFrame([("a", "COMPLETED"), ("b", "COMPLETED"), ("c", "FAILED"), ("d", "COMPLETED")], "item string, status string")
    outputs = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "item string, extracted boolean")
    assert [r["item"] for r in progress.ready(status, outputs).collect()] == ["a"]


def test_a_transaction_is_whole_or_nothing(spark, tmp_path):
    path, schema = f"file://{tmp_path}/out", "id long, v string"
    good = spark.range(5).select("id", F.lit("x").alias("v"))
    bad = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("task fails"))).otherwise("y").alias("v"))
    with pytest.raises(Exception, match="task fails"):
        sinks.write_once(bad, path, "k0")
    assert sinks.committed(spark, path) is None and [f for f in os.listdir(f"{tmp_path}/out") if not f.startswith(".")] == []
    assert sinks.write_once(good, path, "k1") and sinks.read_once(spark, path, schema).count() == 5
    before = sorted(os.listdir(f"{tmp_path}/out"))
    with pytest.raises(Exception, match="task fails"):
        sinks.write_once(bad, path, "k2", existing="replace")
    assert sorted(os.listdir(f"{tmp_path}/out")) == before and sinks.read_once(spark, path, schema).count() == 5
    assert not sinks.write_once(bad, path, "k1")  # done already: the rows are not even computed
    with pytest.raises(FileExistsError):
        sinks.write_once(good, path, "k3")
    assert not sinks.write_once(bad, path, "k3", existing="reuse")
    os.makedirs(f"{tmp_path}/out/_staging-k4")  # of a run that broke off
    assert sinks.write_once(good.limit(2), path, "k4", existing="replace")
    assert sinks.read_once(spark, path, schema).count() == 2 and sorted(f for f in os.listdir(f"{tmp_path}/out") if not f.startswith(".")) == ["current.txt", "v-k4"]
    for wrong in ({"key": "a/b"}, {"key": "a", "existing": "maybe"}):
        with pytest.raises(ValueError):
            sinks.write_once(good, path, **wrong)


def test_rows_as_json_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None), ("b", None, ["x"])], "name string, n int, tags array<string>")
    sinks.write_json(rows, f"file://{tmp_path}/out")
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(f"file://{tmp_path}/out").collect())) == [("a", 1, None), ("b", None, ["x"])]
    sinks.write_json(rows.limit(0), f"file://{tmp_path}/out", mode="ignore")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
