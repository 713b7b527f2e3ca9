"""Events along time: state with timers, windows, sessions, as-of and interval joins, ranks, bags and cubes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import bags, ranks, temporal
from vitrine.session import scratch_path
from vitrine.streaming import stateful, tables, windows

from . import views as W
from .registry import query
from .views import table, with_views

# The events as they arrive: in three parts, a third of the month each. Every seventh event comes
# a part late, every eleventh two, so times run backwards between parts.
W.SQL["arrivals"] = """
SELECT *, least(2, (ts >= TIMESTAMP '2024-01-11')::INT + (ts >= TIMESTAMP '2024-01-21')::INT
  + CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS part FROM events"""


def arrivals(spark, sf):
    late = F.when(F.col("event_id") % 11 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    third = (F.col("ts") >= "2024-01-11").cast("int") + (F.col("ts") >= "2024-01-21").cast("int")
    return table(spark, sf, "events").withColumn("part", F.least(F.lit(2), third + late))


def staged(rows, spark, run):
    """Hand the parts of ``rows`` to a stream one after the other; ``run`` works off what is there, each time with one checkpoint.

    ``run`` takes (stream, path of its output, checkpoint) and returns what is held then.
    """
    path = scratch_path(spark, "staged")
    plain = rows.drop("part")
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(plain.schema).parquet(f"{path}/in")
        out = run(stream, f"{path}/out", f"{path}/progress")
    return out


def _mark(delay_ms: int) -> str:
    """CTE ``marks``: the watermark (epoch ms) before each part, and after the last (part 3)."""
    return f"""SELECT p.part, (SELECT max(epoch_ms(ts)) - {delay_ms} FROM arrivals a WHERE a.part < p.part) AS mark FROM range(4) p(part)"""


TTL_MS = 7 * 86_400_000


@query("feature_expiry_stream", with_views("arrivals", """
SELECT w.key, CASE WHEN epoch_ms(w.last.ts) >= e.mark THEN strftime(w.last.ts, '%Y-%m-%d %H:%M:%S.%f') END AS written_at,
  CASE WHEN epoch_ms(w.last.ts) >= e.mark THEN w.last.event_id END AS version, w.late FROM (
  SELECT a.user_id AS key, max({'ts': ts, 'event_id': event_id}) FILTER (m.mark IS NULL OR epoch_ms(a.ts) >= m.mark) AS last,
    count(*) FILTER (epoch_ms(a.ts) < m.mark) AS late
  FROM arrivals a JOIN marks m ON m.part = a.part GROUP BY a.user_id) w, marks e WHERE e.part = 3""", marks=_mark(TTL_MS)))
def _(spark, sf):
    rows = arrivals(spark, sf).select(F.col("user_id").alias("key"), "ts", "event_id", "part")
    out = staged(rows, spark, lambda stream, path, progress: stateful.expiring_store(stream, "key", "ts", "event_id", "7 days", path, progress))
    return out.withColumn("written_at", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


DAY_MS = 86_400_000
KEEP_MS = 3 * DAY_MS

# What each part sights: a key's first row that is not late, unless the last sighting is still remembered.
_SIGHTED = """
SELECT a.user_id, a.part, min({{'ts': a.ts, 'event_id': a.event_id}}) AS first, count(*) AS fresh
FROM arrivals a JOIN marks m ON m.part = a.part WHERE m.mark IS NULL OR epoch_ms(a.ts) >= m.mark GROUP BY ALL""".replace("{{", "{").replace("}}", "}")


@query("stream_first_seen", with_views("arrivals", """
SELECT s.user_id, count(*) FILTER (new) AS sightings, strftime(max(ts) FILTER (new), '%Y-%m-%d %H:%M:%S.%f') AS last_seen,
  max(event_id) FILTER (new AND ts = top) AS event_id, sum(fresh)::BIGINT - count(*) FILTER (new) AS repeated,
  (SELECT count(*) FROM arrivals a JOIN marks m ON m.part = a.part WHERE a.user_id = s.user_id AND epoch_ms(a.ts) < m.mark) AS late
FROM (SELECT *, max(ts) FILTER (new) OVER (PARTITION BY user_id) AS top FROM (
  SELECT user_id, part, first.ts AS ts, first.event_id AS event_id, fresh, new FROM walked)) s GROUP BY s.user_id
UNION ALL SELECT user_id, 0, NULL, NULL, 0, count(*) FROM arrivals WHERE user_id NOT IN (SELECT user_id FROM sighted) GROUP BY user_id""",
    marks=_mark(DAY_MS), sighted=_SIGHTED, walked=f"""
SELECT user_id, part, first, fresh, true AS new, epoch_ms(first.ts) + {KEEP_MS} AS until FROM sighted s
  WHERE part = (SELECT min(part) FROM sighted t WHERE t.user_id = s.user_id)
UNION ALL SELECT s.user_id, s.part, s.first, s.fresh, w.until <= m.mark, CASE WHEN w.until <= m.mark THEN epoch_ms(s.first.ts) + {KEEP_MS} ELSE w.until END
FROM walked w JOIN sighted s ON s.user_id = w.user_id AND s.part = (SELECT min(part) FROM sighted t WHERE t.user_id = w.user_id AND t.part > w.part)
JOIN marks m ON m.part = s.part""").replace("walked AS MATERIALIZED", "walked AS"))
def _(spark, sf):
    rows = arrivals(spark, sf).select("user_id", "ts", "event_id", "part")
    out = staged(rows, spark, lambda stream, path, progress: stateful.first_seen(stream, "user_id", "ts", "event_id", "1 day", KEEP_MS, path, progress))
    per = out.groupBy("user_id").agg(
        F.count("seen_at").alias("sightings"), F.max(F.struct("seen_at", "event_id")).alias("last"), F.sum("repeated").alias("repeated"), F.sum("late").alias("late"))
    return per.select("user_id", "sightings", F.date_format("last.seen_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen"), "last.event_id", "repeated", "late")


# ── windows and sessions ─────────────────────────────────────


def shown(out):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select(*[at(c) if c in ("start", "end") else c for c in out.columns])


def _windows(kept: str, width: str, slide: str, mark: str) -> str:
    """Closed windows of the rows in ``kept``; a row falls into width / slide windows."""
    return f"""
SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(start + {width}, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS rows, max(value) AS highest, min(value) AS lowest
FROM ({kept}) WHERE epoch_ms(start + {width}) <= {mark} GROUP BY event_type, start"""


def _spread(width_hours: int, slide_hours: int, source: str = "events", more: str = "") -> str:
    return f"""SELECT event_type, value{more}, time_bucket(INTERVAL {slide_hours} HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(({slide_hours} * k)::BIGINT) AS start
  FROM {source}, range({width_hours // slide_hours}) r(k)"""


_LAST = "(SELECT max(epoch_ms(ts)) - 3600000 FROM events)"


@query("agg_tumbling_windows", _windows(_spread(6, 6), "INTERVAL 6 HOUR", "", _LAST))
def _(spark, sf):
    return shown(windows.closed_windows(table(spark, sf, "events"), ["event_type"], "ts", "value", "6 hours", "1 hour"))


@query("agg_sliding_windows", _windows(_spread(24, 6), "INTERVAL 24 HOUR", "", _LAST))
def _(spark, sf):
    return shown(windows.closed_windows(table(spark, sf, "events"), ["event_type"], "ts", "value", "24 hours", "1 hour", "6 hours"))


def _late(width_hours: int, slide_hours: int) -> str:
    """Rows of the windows that were not closed when their part came."""
    return f"""SELECT s.* FROM ({_spread(width_hours, slide_hours, "arrivals", ", part")}) s JOIN marks m ON m.part = s.part
  WHERE m.mark IS NULL OR epoch_ms(s.start + INTERVAL {width_hours} HOUR) > m.mark"""


@query("stream_tumbling_windows", with_views("arrivals", _windows(_late(6, 6), "INTERVAL 6 HOUR", "", "(SELECT mark FROM marks WHERE part = 3)"), marks=_mark(3_600_000)))
def _(spark, sf):
    run = lambda stream, path, progress: windows.stream_windows(stream, ["event_type"], "ts", "value", "6 hours", "1 hour", path, progress)
    return shown(staged(arrivals(spark, sf), spark, run))


@query("stream_sliding_windows", with_views("arrivals", _windows(_late(24, 6), "INTERVAL 24 HOUR", "", "(SELECT mark FROM marks WHERE part = 3)"), marks=_mark(3_600_000)))
def _(spark, sf):
    run = lambda stream, path, progress: windows.stream_windows(stream, ["event_type"], "ts", "value", "24 hours", "1 hour", path, progress, "6 hours")
    return shown(staged(arrivals(spark, sf), spark, run))


_SESSIONS = """
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS rows, max(value) AS highest, min(value) AS lowest FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, id"""


@query("agg_sessions", f"SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, rows, highest, lowest FROM ({_SESSIONS})")
def _(spark, sf):
    out = temporal.sessions(table(spark, sf, "events"), ["user_id"], "ts", "8 hours", "value")
    return shown(out).withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


# Twenty days are allowed, so no event is late and the sessions that are closed by then are whole.
@query("stream_sessions", f"""
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(last + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS end, rows, highest, lowest FROM ({_SESSIONS})
WHERE epoch_us(last + INTERVAL 8 HOUR) <= 1000 * (SELECT max(epoch_ms(ts)) - 20 * {DAY_MS} FROM events)""")
def _(spark, sf):
    run = lambda stream, path, progress: windows.stream_sessions(stream, ["user_id"], "ts", "value", "8 hours", "20 days", path, progress)
    return shown(staged(arrivals(spark, sf), spark, run))


# ── joins over time ──────────────────────────────────────────


@query("join_asof_log", """
SELECT e.event_id, e.user_id, e.event_type, strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS purchased_at, l.value AS paid, l.event_id AS purchase_id
FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') l ON e.user_id = l.user_id AND e.ts >= l.ts""")
def _(spark, sf):
    events = table(spark, sf, "events")
    log = events.where("event_type = 'purchase'")
    out = temporal.asof_join(events, log, ["user_id"], "ts", "ts", {"purchased_at": "ts", "paid": "value", "purchase_id": "event_id"}, tie=["event_id"])
    return out.select("event_id", "user_id", "event_type", F.date_format("purchased_at", "yyyy-MM-dd HH:mm:ss").alias("purchased_at"), "paid", "purchase_id")


# An event's effect lasts for a time that depends on its value: some seconds up to more than a day.
W.SQL["effects"] = "SELECT event_id, user_id, event_type, epoch_us(ts) AS low, epoch_us(ts) + (value * value)::BIGINT * 1000000 AS high FROM events"


def effects(spark, sf):
    low = F.unix_micros(F.col("ts").cast("timestamp"))
    long = F.round(F.col("value") * F.col("value")).cast("bigint") * 1_000_000
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", low.alias("low"), (low + long).alias("high"))


@query("join_interval_overlap", with_views("effects", """
SELECT a.event_id AS left_id, b.event_id AS right_id FROM effects a JOIN effects b ON a.user_id = b.user_id AND a.low <= b.high AND b.low <= a.high
WHERE a.event_type = 'purchase' AND b.event_type = 'view'"""))
def _(spark, sf):
    rows = effects(spark, sf)
    met = temporal.interval_join(rows.where("event_type = 'purchase'"), rows.where("event_type = 'view'"), ["user_id"], ("low", "high"), ("low", "high"), 600_000_000)
    return met.select(F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query("join_interval_points", with_views("effects", """
SELECT a.event_id AS left_id, count(*) AS inside FROM effects a JOIN effects b ON b.low BETWEEN a.low AND a.high
WHERE a.event_type = 'purchase' AND b.event_type = 'error' AND a.user_id % 10 = b.user_id % 10 GROUP BY a.event_id"""))
def _(spark, sf):
    rows = effects(spark, sf).withColumn("shop", F.col("user_id") % 10)
    met = temporal.interval_join(rows.where("event_type = 'purchase'"), rows.where("event_type = 'error'"), ["shop"], ("low", "high"), ("low", "low"), 600_000_000)
    return met.groupBy(F.col("left.event_id").alias("left_id")).agg(F.count(F.lit(1)).alias("inside"))


# ── ranks, bags, cubes ───────────────────────────────────────


@query("win_ranks", """
SELECT l_orderkey, l_linenumber, row_number() OVER w AS row_number, rank() OVER w2 AS rank, dense_rank() OVER w2 AS dense_rank,
  round(percent_rank() OVER w2, 9) AS percent_rank, round(cume_dist() OVER w2, 9) AS cume_dist, ntile(7) OVER w AS ntile,
  lag(tie, 2) OVER w AS two_back, lead(tie, 1) OVER w AS next
FROM (SELECT *, l_orderkey * 8 + l_linenumber AS tie FROM lineitem)
WINDOW w AS (ORDER BY l_quantity, tie), w2 AS (ORDER BY l_quantity)""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tie"))
    out = ranks.neighbours(ranks.ranked(rows, [], "l_quantity", "tie", 7), [], "row_number", {"two_back": ("tie", -2), "next": ("tie", 1)})
    return out.select("l_orderkey", "l_linenumber", "row_number", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"), "ntile", "two_back", "next")


@query("win_ranks_by_key", """
SELECT event_id, row_number() OVER w AS row_number, rank() OVER w2 AS rank, dense_rank() OVER w2 AS dense_rank,
  round(percent_rank() OVER w2, 9) AS percent_rank, round(cume_dist() OVER w2, 9) AS cume_dist, ntile(4) OVER w AS ntile
FROM (SELECT *, CASE WHEN event_id % 13 > 0 THEN floor(value) END AS v FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY v NULLS FIRST, event_id), w2 AS (PARTITION BY event_type ORDER BY v NULLS FIRST)""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 13 > 0, F.floor("value")).alias("v"))
    out = ranks.ranked(rows, ["event_type"], "v", "event_id")
    return out.select("event_id", "row_number", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"), "ntile")


# Two bags with repeats and nulls: what users did in the first and in the second half of the month.
W.SQL["early_bag"] = "SELECT CASE WHEN user_id % 5 > 0 THEN user_id % 40 END AS user, CASE WHEN event_id % 4 > 0 THEN event_type END AS kind FROM events WHERE ts < TIMESTAMP '2024-01-16'"
W.SQL["late_bag"] = W.SQL["early_bag"].replace("<", ">=")


def halves(spark, sf):
    rows = table(spark, sf, "events").select(F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 40).alias("user"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("kind"), "ts")
    return rows.where("ts < '2024-01-16'").drop("ts"), rows.where("ts >= '2024-01-16'").drop("ts")


@query("set_intersect_all", with_views("early_bag late_bag", "SELECT * FROM early_bag INTERSECT ALL SELECT * FROM late_bag"))
def _(spark, sf):
    return bags.intersect_all(*halves(spark, sf))


@query("set_except_all", with_views("early_bag late_bag", "SELECT * FROM early_bag EXCEPT ALL SELECT * FROM late_bag"))
def _(spark, sf):
    return bags.except_all(*halves(spark, sf))


_TOTALS = "count(*) AS rows, count(DISTINCT l_suppkey) AS distinct_count, max(l_extendedprice) AS highest, min(l_extendedprice) AS lowest FROM lineitem GROUP BY"


@query("agg_cube_distinct", f"""
SELECT l_returnflag, l_linestatus, l_linenumber, GROUPING_ID(l_returnflag, l_linestatus, l_linenumber) AS grouping_id, {_TOTALS} CUBE (l_returnflag, l_linestatus, l_linenumber)""")
def _(spark, sf):
    return bags.cube(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_suppkey", "l_extendedprice")


@query("agg_grouping_sets", f"""
SELECT l_returnflag, l_linestatus, l_linenumber, GROUPING_ID(l_returnflag, l_linestatus, l_linenumber) AS grouping_id, {_TOTALS}
GROUPING SETS ((l_returnflag, l_linenumber), (l_linestatus), ())""")
def _(spark, sf):
    return bags.grouping_sets(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [["l_returnflag", "l_linenumber"], ["l_linestatus"], []], "l_suppkey", "l_extendedprice")
