"""Lines are read by one match of a form: what it costs, and lines that hold the signs by which fields are told apart."""

from pyspark.sql import functions as F

from opsweave.operators import backfill, parse

KINDS = "source string, seq long, ts_us long, message string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_count_of_records_does_not_repeat_their_patterns(spark):
    """Filters below the projections named the head of a line once for each kind, and each field of the line anew."""
    lines = spark.createDataFrame([("a", 1, 1, "slot f: id 0 | task 1 | processing task")], KINDS).repartition(2)
    head, total = parse.compiled(parse.SLOT)[0][:24], parse.compiled(parse.SLOT_KINDS["total"])[0][:24]
    count = plan(parse.slot_lines(lines).agg(F.count("*")))
    assert count.count(head) <= 3 and count.count(total) <= 2
    whole = plan(parse.slot_lines(lines))
    assert whole.count(head) <= 3 and whole.count(total) <= 3


def test_lines_that_hold_the_marks(spark):
    rows = ["[req 1] error a\x01b\x02c\x02\x03", "[req 2] error plain"]
    lines = spark.createDataFrame([("a", i, i, m) for i, m in enumerate(rows)], KINDS)
    assert [(r.req_id, r.error) for r in parse.engine_n_lines(lines).orderBy("seq").collect()] == [(1, "a\x01b\x02c\x02\x03"), (2, "plain")]


def test_names_that_come_twice(spark):
    lines = spark.createDataFrame([("a", 1, 1, 'time=x level=INFO source=s msg="odd" k=1 l=2 k="3 4"')], KINDS)
    assert list(parse.go_lines(lines).first().kv.items()) == [("l", "2"), ("k", "3 4")]


def test_only_the_owners_asked_for_are_parsed(spark):
    """All lines are counted; those of other owners are neither kept nor parsed."""
    lines = spark.createDataFrame([("s", 1, 1, "slot f: id 0 | task 7 | processing task"), ("s", 2, 2, "[GIN] x"), ("s", 3, 3, "what")], "source string, seq long, ts_us long, message string")
    records, n = backfill.parsed_log(lines, ("slot", "server"))
    assert n == 3 and set(records) == {"slot", "server"}
    assert [r.count() for r in records.values()] == [1, 0]
    none, n = backfill.parsed_log(lines.where("seq = 3"), ("slot",))
    assert n == 1 and none["slot"].count() == 0
