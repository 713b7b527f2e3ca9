"""State with timers, late rows, and windows closed by a stream and by a table."""

from datetime import datetime, timedelta

import pytest

from vitrine.session import scratch_path
from vitrine.streaming import stateful, windows

T0 = datetime(2024, 1, 1)


class Parts:
    """Files handed to a stream one after the other."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path = spark, schema, scratch_path(spark, "parts")

    def add(self, rows):
        made = [tuple(T0 + timedelta(seconds=x) if i == 1 and x is not None else x for i, x in enumerate(r)) for r in rows]
        self.spark.createDataFrame(made, self.schema).write.mode("append").parquet(f"{self.path}/in")
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")

    @property
    def folders(self):
        return f"{self.path}/out", f"{self.path}/progress"


def test_a_store_that_expires(spark):
    parts = Parts(spark, "k string, t timestamp, v long")

    def run(rows):
        out = stateful.expiring_store(parts.add(rows), "k", "t", "v", "100 seconds", *parts.folders)
        return {r.k: ((r.written_at - T0).total_seconds() if r.written_at else None, r.version, r.late) for r in out.collect()}

    held = run([("a", 0, 1), ("b", 50, 2), ("b", 50, 3), ("b", 40, 9), (None, 60, None), ("a", None, 5)])
    assert held == {"a": (0, 1, 0), "b": (50, 3, 0), None: (60, None, 0)}
    # 100 s after its write an entry is still there; a later write moves the mark on.
    held = run([("c", 100, 4), ("b", 45, 8)])
    assert held == {"a": (0, 1, 0), "b": (50, 3, 0), None: (60, None, 0), "c": (100, 4, 0)}
    held = run([("c", 151, 5), ("a", -1, 6)])  # a's row is late, its entry expires; b is renewed too late
    assert held == {"a": (None, None, 1), "b": (None, None, 0), None: (60, None, 0), "c": (151, 5, 0)}
    held = run([("b", 52, 7), ("a", 30, 8), ("a", 120, 1)])
    assert held == {"a": (120, 1, 2), "b": (52, 7, 0), None: (60, None, 0), "c": (151, 5, 0)}
    state = spark.read.format("statestore").option("stateVarName", "newest").load(parts.folders[1])
    assert state.count() == 4


def test_a_renewed_entry_outlives_its_first_timer(spark):
    parts = Parts(spark, "k string, t timestamp, v long")
    run = lambda rows: {r.k: r.version for r in stateful.expiring_store(parts.add(rows), "k", "t", "v", "100 seconds", *parts.folders).collect()}
    run([("a", 0, 1)])
    run([("a", 90, 2)])
    assert run([("x", 150, 0)]) == {"a": 2, "x": 0}
    assert run([("x", 191, 0)]) == {"a": None, "x": 0}


def test_keys_are_forgotten_and_late_rows_counted(spark):
    parts = Parts(spark, "k string, t timestamp, n long")

    def run(rows):
        out = stateful.first_seen(parts.add(rows), "k", "t", "n", "20 seconds", 50_000, *parts.folders)
        return sorted(((r.k, int((r.seen_at - T0).total_seconds()), r.n) for r in out.where("seen_at IS NOT NULL").collect()), key=str), out.groupBy().sum("late", "repeated").first()

    seen, counts = run([("a", 10, 2), ("a", 10, 1), ("b", 30, 1), ("a", 5, 9)])
    assert seen == [("a", 5, 9), ("b", 30, 1)] and tuple(counts) == (0, 2)
    seen, counts = run([("c", 9, 1), ("c", 10, 2), ("a", 60, 1)])  # the mark is 10: 9 is late, a is remembered until 55
    assert seen == [("a", 5, 9), ("b", 30, 1), ("c", 10, 2)] and tuple(counts) == (1, 3)
    assert spark.read.format("statestore").option("stateVarName", "until").load(parts.folders[1]).count() == 3
    seen, counts = run([("z", 100, 1)])  # now it is 80, and all but z are forgotten
    assert spark.read.format("statestore").option("stateVarName", "until").load(parts.folders[1]).count() == 1
    seen, counts = run([("a", 90, 3), ("b", 79, 1)])
    assert seen == [("a", 5, 9), ("a", 90, 3), ("b", 30, 1), ("c", 10, 2), ("z", 100, 1)] and tuple(counts) == (2, 3)


@pytest.mark.parametrize(("width", "slide"), [("10 seconds", None), ("20 seconds", "5 seconds")])
def test_stream_and_table_close_the_same_windows(spark, width, slide):
    rows = [("ab"[i % 2], i * 3 - (i % 4) * 2, i) for i in range(60)] + [("a", None, 1)]
    parts = Parts(spark, "k string, t timestamp, v long")
    for i in range(0, 61, 20):
        out = windows.stream_windows(parts.add(rows[i : i + 20]), ["k"], "t", "v", width, "10 seconds", *parts.folders, slide)
    table = windows.closed_windows(spark.read.parquet(f"{parts.path}/in"), ["k"], "t", "v", width, "10 seconds", slide)
    got, want = (sorted(map(tuple, df.select("start", "end", "k", "rows", "highest", "lowest").collect())) for df in (out, table))
    assert got == want and len(got) > 20
    assert windows.closed_windows(spark.read.parquet(f"{parts.path}/in").limit(0), ["k"], "t", "v", width, "10 seconds").count() == 0


def test_rows_of_closed_windows_are_dropped(spark):
    parts = Parts(spark, "k string, t timestamp, v long")
    run = lambda rows: {int((r.start - T0).total_seconds()): r.rows for r in windows.stream_windows(parts.add(rows), ["k"], "t", "v", "10 seconds", "5 seconds", *parts.folders).collect()}
    assert run([("a", 1, 1), ("a", 15, 1)]) == {0: 1}
    assert run([("a", 2, 1), ("a", 11, 1), ("a", 25, 1)]) == {0: 1, 10: 2}


def test_stream_and_table_close_the_same_sessions(spark):
    rows = [("ab"[i % 2], i * i % 997, i) for i in range(90)]
    parts = Parts(spark, "k string, t timestamp, v long")
    for i in range(0, 90, 30):
        out = windows.stream_sessions(parts.add(rows[i : i + 30]), ["k"], "t", "v", "9 seconds", "990 seconds", *parts.folders)
    out = windows.stream_sessions(parts.add([("c", 1900, 0)]), ["k"], "t", "v", "9 seconds", "990 seconds", *parts.folders)
    table = windows.closed_sessions(spark.read.parquet(f"{parts.path}/in"), ["k"], "t", "v", "9 seconds", "990 seconds")
    got, want = (sorted(map(tuple, df.select("start", "end", "k", "rows", "highest", "lowest").collect())) for df in (out, table))
    assert got == want and len(got) > 20
