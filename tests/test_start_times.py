"""Restarts that no falling counter shows."""

from opsweave.operators import deltas


def test_a_new_start_time_is_a_restart(spark):
    rows = [("s", 1, 0, 100, 5), ("s", 2, 10, 100, 7), ("s", 3, 20, None, 9), ("s", 4, 30, 125, 50), ("s", 5, 40, 125, 51)]
    scrapes = spark.createDataFrame(rows, "source string, n long, ts_us long, started long, counter long")
    got = deltas.counter_deltas(scrapes, ["counter"], "started").orderBy("n").collect()
    assert [r.d_counter for r in got] == [None, 2, 2, None, 1]
    assert [r.restart for r in got] == [False, False, False, True, False]
