"""Upserts of keys whose time moves to another day."""

from opsweave.operators import tables

DAY = 86_400_000_000
SCHEMA = "ts_us long, key string, status string"


def test_a_key_that_crosses_midnight_stays_once(spark, tmp_path):
    path = str(tmp_path / "t")

    def upsert(*rows):
        tables.upsert_last_wins(spark.createDataFrame(list(rows), SCHEMA), path, ("key",), "ts_us")

    def stored():
        return sorted((r.ts_us, r.key or "", r.status) for r in spark.read.parquet(path).collect())

    upsert((DAY - 5, "a", "running"), (DAY - 4, "b", "running"), (DAY - 3, None, "running"), (3 * DAY, "c", "done"))
    upsert((DAY + 5, "a", "done"), (DAY + 6, None, "done"))
    assert stored() == [(DAY - 4, "b", "running"), (DAY + 5, "a", "done"), (DAY + 6, "", "done"), (3 * DAY, "c", "done")]
    upsert((DAY + 7, "b", "done"))  # the first day is left without rows
    assert stored() == [(DAY + 5, "a", "done"), (DAY + 6, "", "done"), (DAY + 7, "b", "done"), (3 * DAY, "c", "done")]
    upsert((2, "c", "running"))  # an older row doesn't win
    assert stored()[-1] == (3 * DAY, "c", "done") and len(stored()) == 4
