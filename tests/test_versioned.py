"""Versions of stored tables: appends, upserts, retention, purges, and writes that stop half way."""

import pytest

from opsweave.operators.versioned import DAY_US, VersionedTable

SCHEMA = "source string, ts_us long, k long, seq long, v string"


def rows(table):
    t = table.read()
    return [] if t is None else sorted(((r.source, r.ts_us, r.k, r.v) for r in t.collect()), key=str)


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ("source", "ts_us", "k"))
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert t.version() == 0 and t.read() is None and t.prune(9 * DAY_US, 1) == 0 and t.purge("a") == 0
    t.append_first_wins(make(("a", 5, 1, 2, "late"), ("a", 5, 1, 1, "first"), ("b", DAY_US + 1, 2, 3, "x"), ("a", None, 9, 4, "no time")))
    t.append_first_wins(make(("a", 5, 1, 0, "again"), ("a", 3 * DAY_US, 3, 5, "y")))
    first = [("a", 259200000000, 3, "y"), ("a", 5, 1, "first"), ("a", None, 9, "no time"), ("b", 86400000001, 2, "x")]
    assert rows(t) == first and t.version() == 2
    assert t.prune(3 * DAY_US + 1, 2) == 1  # the first day whole, the second stays from its first microsecond on
    assert t.prune(3 * DAY_US + 1, 2) == 0
    assert t.prune(3 * DAY_US + 2, 2) == 1  # one of the day of the limit
    assert rows(t) == [("a", 259200000000, 3, "y"), ("a", None, 9, "no time")]
    assert t.purge("b") == 0 and t.purge("a") == 2 and rows(t) == []
    assert sorted((r.source, r.ts_us, r.k, r.v) for r in t.read(version=2).where("ts_us is not null").collect()) == sorted(x for x in first if x[1] is not None)


def test_a_key_moves_to_another_day(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ("source", "k"))
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    t.upsert_last_wins(make(("a", 5, 1, 1, "old"), ("a", 6, 2, 1, "stays")), "seq")
    t.upsert_last_wins(make(("a", 2 * DAY_US, 1, 2, "new"), ("a", 7, 3, 2, "more")), "seq")
    assert rows(t) == [("a", 172800000000, 1, "new"), ("a", 6, 2, "stays"), ("a", 7, 3, "more")]
    t.sweep()
    assert rows(t) == [("a", 172800000000, 1, "new"), ("a", 6, 2, "stays"), ("a", 7, 3, "more")]


@pytest.mark.parametrize("step", ["_write", "commit"])
def test_a_write_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    t = VersionedTable(spark, str(tmp_path / "t"), ("source", "k"))
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    t.upsert_last_wins(make(("a", 5, 1, 1, "old")), "seq")
    own = getattr(VersionedTable, step)

    def stops(self, *args):
        if step == "_write":
            own(self, *args)
        raise OSError("lost")

    monkeypatch.setattr(VersionedTable, step, stops)
    for act in (lambda: t.upsert_last_wins(make(("a", 9 * DAY_US, 1, 2, "new")), "seq"), lambda: t.purge("a")):
        with pytest.raises(OSError):
            act()
    monkeypatch.undo()
    assert rows(t) == [("a", 5, 1, "old")] and t.version() == 1
    with pytest.raises(RuntimeError):
        t.commit(0, {})
    assert rows(t) == [("a", 5, 1, "old")]
