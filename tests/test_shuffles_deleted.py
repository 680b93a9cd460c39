"""The shuffle files of a step that has ended are deleted when the next one is written, while the application goes on."""

import time

from structcheck.functions import tables


def _files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_") and name.endswith(".data")}


def test_files_of_a_step_go_with_the_next(spark):
    before = _files(spark)
    made = tables.written(spark.range(0, 200_000, 1, 8).selectExpr("id % 1000 k", "id").groupBy("k").agg({"id": "max"}).repartition(5), "step")
    first = _files(spark) - before
    time.sleep(1)
    again = tables.written(made, "step")
    end = time.time() + 10
    while first & _files(spark) and time.time() < end:
        time.sleep(0.5)
    assert first and again.count() == 1000 and not first & _files(spark)
