import threading
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import runs


def _slow(spark):
    def wait(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    return spark.range(4).mapInArrow(wait, "id long")


def test_run_is_watched_and_cancelled(spark):
    seen, began = [], time.time()
    with pytest.raises(runs.Cancelled), runs.run(spark, "slow", seen.append, 0.2) as this:
        threading.Timer(4, this.cancel).start()
        _slow(spark).count()
    assert time.time() - began < 40
    assert any(p.tasks == 4 and not p.done for p in seen)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    with runs.run(spark, "quick") as this:
        assert spark.range(10).select(F.sum("id")).first()[0] == 45
    assert this.progress() == runs.Progress(0, 0, 0, 0)


def test_errors_of_a_run_that_was_not_cancelled_are_its_own(spark):
    with pytest.raises(ZeroDivisionError), runs.run(spark, "wrong"):
        1 / 0
