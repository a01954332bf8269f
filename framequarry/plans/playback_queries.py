"""Queries over playback: a user of `events` is a session, its events in order are ticks, puts and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import scalars as S
from ..operators import playback as B
from ..operators import sections as X
from ..operators import stores as T
from ..session import table
from ..streaming import policies as P
from .registry import registry
from .section_queries import _CUST, _of_customers

QUERIES, ORACLES, query = registry()
_USERS = "(SELECT DISTINCT user_id FROM e)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id % 500 AS f, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'seek' WHEN 'error' THEN 'pause' ELSE 'tick' END AS op,
 row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS t, false AS p, NULL::BIGINT AS us, NULL::BIGINT AS current, NULL::DOUBLE AS elapsed, '' AS op FROM {_USERS}
UNION ALL SELECT user_id, n, CASE WHEN op IN ('start', 'seek') THEN f WHEN op = 'pause' THEN now ELSE a END, CASE WHEN op IN ('start', 'seek') THEN us ELSE t END,
 CASE op WHEN 'start' THEN true WHEN 'pause' THEN false ELSE p END, us, now, CASE WHEN p THEN (us - t) / 1000000.0::DOUBLE ELSE 0.0 END, op FROM (
  SELECT e.*, s.a, s.t, s.p, CASE WHEN p THEN least(2000, a + floor((e.us - s.t) / 1000000.0::DOUBLE * 0.01::DOUBLE)::BIGINT) ELSE least(2000, a) END AS now FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id, us, current, round(elapsed, 6) AS elapsed FROM s WHERE op = 'tick'""")
def timeline_control(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "seek").when(F.col("event_type") == "error", "pause").otherwise("tick")
    log = _events(spark, d).select("user_id", "us", op.alias("op"), (F.col("event_id") % 500).alias("frame"))
    return B.timeline(log, "user_id", 0.01, 2000).withColumn("elapsed", F.round("elapsed", 6))


#: Puts and ticks of frames of 0 to 199, marks of frames that come again, and removals.
_LOG = """l AS (SELECT user_id, event_id AS seq, CASE WHEN event_type = 'click' THEN 'put' WHEN event_type = 'purchase' THEN 'evict' WHEN event_type = 'error' THEN 'invalidate' WHEN event_type = 'view' THEN 'tick'
 WHEN event_id % 2 = 0 THEN 'invalidate_from' WHEN event_id % 9 = 0 THEN 'invalidate_all' ELSE 'put' END AS op, event_id * 13 % 40 AS frame FROM events)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    t, i = F.col("event_type"), F.col("event_id")
    op = (F.when(t == "click", "put").when(t == "purchase", "evict").when(t == "error", "invalidate").when(t == "view", "tick")
          .when(i % 2 == 0, "invalidate_from").when(i % 9 == 0, "invalidate_all").otherwise("put"))
    return table(spark, d, "events").select("user_id", i.alias("seq"), op.alias("op"), (i * 13 % 40).alias("frame"))


_HELD = f"""{_LOG}, f AS (SELECT user_id, frame, max(seq) FILTER (op = 'put') AS p, max(seq) FILTER (op = 'evict') AS v, max(seq) FILTER (op = 'invalidate') AS b FROM l GROUP BY user_id, frame HAVING count(*) FILTER (op = 'put') > 0),
g AS (SELECT f.*, (SELECT max(seq) FROM l WHERE l.user_id = f.user_id AND (op = 'invalidate_all' OR op = 'invalidate_from' AND l.frame <= f.frame)) AS c,
 (SELECT max(seq) FROM l WHERE l.user_id = f.user_id AND op = 'invalidate_all') AS a FROM f),
h AS (SELECT user_id, frame, CASE WHEN b > p AND (a IS NULL OR b > a) THEN 'invalid' WHEN c > p THEN 'gone' WHEN v > p THEN 'stored' ELSE 'ready' END AS state FROM g)"""


@query(f"WITH {_HELD} SELECT * FROM h")
def buffer_holdings(spark: SparkSession, d: str) -> DataFrame:
    return T.holdings(_log(spark, d), "user_id")


@query(f"""WITH {_HELD}, m AS (SELECT unnest(['WRITE_READ', 'OFF']) AS mode) SELECT mode, user_id, frame, state,
CASE WHEN state = 'ready' THEN 'memory' WHEN state = 'stored' AND mode <> 'OFF' THEN 'disk' ELSE 'miss' END AS origin FROM h, m""")
def cache_modes(spark: SparkSession, d: str) -> DataFrame:
    held = T.holdings(_log(spark, d), "user_id")
    return T.readable(held, "WRITE_READ").withColumn("mode", F.lit("WRITE_READ")).unionByName(T.readable(held, "OFF").withColumn("mode", F.lit("OFF")))


@query(f"""WITH {_HELD}, t AS (SELECT user_id, event_id % 45 AS frame FROM events), j AS (SELECT t.user_id, h.state IN ('ready', 'stored') AS hit FROM t LEFT JOIN h ON h.user_id = t.user_id AND h.frame = t.frame)
SELECT user_id, count_if(coalesce(hit, false)) AS hits, count(*) - count_if(coalesce(hit, false)) AS misses FROM j GROUP BY user_id""")
def read_misses(spark: SparkSession, d: str) -> DataFrame:
    held = T.readable(T.holdings(_log(spark, d), "user_id"), "READ_ONLY")
    ticks = table(spark, d, "events").select("user_id", (F.col("event_id") % 45).alias("target"))
    return T.miss_counts(ticks, held, "user_id", "target", "frame")


@query("""WITH m AS (SELECT event_id AS f, value FROM events WHERE event_id % 3 = 0), s AS (SELECT event_id AS f, value + 0.5::DOUBLE AS value FROM events WHERE event_id % 2 = 0), r AS (SELECT DISTINCT event_id // 4 AS f FROM events)
SELECT f, value FROM m UNION ALL SELECT f, value FROM s WHERE f IN (SELECT f FROM r) AND f NOT IN (SELECT f FROM m)""")
def cache_back_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("f"), "value")
    reads = e.select(F.expr("f div 4").alias("f"))
    return T.back_filled(e.where("f % 3 = 0"), reads, e.where("f % 2 = 0").withColumn("value", F.col("value") + 0.5), "f")


_NEAR = f"""{_LOG}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM l WHERE op = 'put'), b AS (SELECT p.user_id, p.seq, p.frame, p.n, min(i.seq) AS bad FROM p LEFT JOIN l i ON i.user_id = p.user_id AND i.frame = p.frame AND i.op = 'invalidate' AND i.seq > p.seq GROUP BY ALL),
t AS (SELECT l.user_id, l.seq, l.frame AS target, (SELECT count(*) FROM p WHERE p.user_id = l.user_id AND p.seq < l.seq) AS k FROM l WHERE op = 'tick'),
o AS (SELECT t.user_id, t.seq, t.target, max(b.frame) AS shown FROM t LEFT JOIN b ON b.user_id = t.user_id AND b.seq < t.seq AND b.n > t.k - 6 AND b.frame <= t.target AND (b.bad IS NULL OR b.bad > t.seq) GROUP BY ALL)"""


@query(f"WITH {_NEAR} SELECT * FROM o")
def asof_recent_puts(spark: SparkSession, d: str) -> DataFrame:
    """The fallback of each tick among the last puts: six here, so that the bound is met, by default 1,024."""
    return T.latest_at_or_below(_log(spark, d), "user_id", recent=6)


@query(f"""WITH RECURSIVE {_NEAR}, k AS (SELECT user_id, seq, target, seq % 4 = 0 AS hit, shown AS fallback, seq % 11 = 0 AS paused, seq % 17 = 0 AS seek, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM o),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BIGINT AS last, NULL::BIGINT AS shown FROM (SELECT DISTINCT user_id FROM k)
UNION ALL SELECT user_id, n, seq, coalesce(new, old), CASE WHEN new IS DISTINCT FROM old THEN new END FROM (
 SELECT *, CASE WHEN hit THEN target WHEN NOT paused AND fallback IS NOT NULL AND (old IS NULL OR fallback >= old) THEN fallback END AS new FROM (
  SELECT k.*, CASE WHEN k.seek THEN NULL ELSE s.last END AS old FROM s JOIN k ON k.user_id = s.user_id AND k.n = s.n + 1)))
SELECT user_id, seq, shown FROM s WHERE shown IS NOT NULL""")
def playback_ticks(spark: SparkSession, d: str) -> DataFrame:
    t = T.latest_at_or_below(_log(spark, d), "user_id", recent=6)
    s = F.col("seq")
    ticks = t.select("user_id", "seq", "target", (s % 4 == 0).alias("hit"), F.col("shown").alias("fallback"), (s % 11 == 0).alias("paused"), (s % 17 == 0).alias("seek"))
    return B.ticks_shown(ticks, "user_id")


@query(f"""{_CUST}, q AS (SELECT event_id, user_id + 1 AS k, event_id * 7 % 15000 AS cur, CASE WHEN event_id % 5 > 0 THEN event_id * 7 % 15000 + event_id % 9 END AS dec, event_id * 7 % 15000 - 20 AS sub, event_id * 7 % 15000 + event_id % 40 - 30 AS done, event_id % 3 AS fly FROM events),
m AS (SELECT q.*, EXISTS (SELECT 1 FROM x WHERE x.k = q.k) AS chosen, EXISTS (SELECT 1 FROM x WHERE x.k = q.k AND cur BETWEEN s AND e) AS inn, (SELECT min(greatest(cur, s)) FROM x WHERE x.k = q.k AND e >= cur) AS nxt,
 least(15000, (SELECT max(e) FROM x WHERE x.k = q.k)) AS last, (SELECT min(greatest(dec, s)) FROM x WHERE x.k = q.k AND e >= dec) AS moved FROM q),
f AS (SELECT *, CASE WHEN chosen THEN moved ELSE dec END AS frame FROM m),
a AS (SELECT *, CASE WHEN chosen AND NOT inn THEN CASE WHEN nxt IS NULL THEN 'end' ELSE 'jump' END WHEN dec IS NULL THEN 'idle' WHEN cur >= last AND (done >= last OR sub >= last AND fly = 0) THEN 'end' WHEN frame IS NULL OR frame > last THEN 'idle' ELSE 'submit' END AS action FROM f)
SELECT event_id, action, CASE action WHEN 'jump' THEN nxt WHEN 'submit' THEN frame END::BIGINT AS frame, CASE WHEN action = 'submit' AND frame > sub + 1 THEN CASE WHEN chosen THEN
 coalesce((SELECT sum(greatest(0, least(e, frame - 1) - greatest(s, sub + 1) + 1)) FROM x WHERE x.k = a.k), 0) ELSE frame - sub - 1 END ELSE 0 END::BIGINT AS skipped FROM a""")
def section_submit(spark: SparkSession, d: str) -> DataFrame:
    """What a policy's decision becomes within the selection of a customer; users without orders have none."""
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", (F.col("user_id") + 1).alias("k"), (i * 7 % 15000).alias("cur"))
    e = e.join(X.as_array(_of_customers(spark, d), "k"), "k", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    cur = F.col("cur")
    r = B.submission(F.coalesce("ranges", none), cur, F.when(i % 5 > 0, cur + i % 9), F.lit(15000), cur - 20, cur + i % 40 - 30, i % 3)
    return e.select("event_id", r["action"].alias("action"), r["frame"].alias("frame"), r["skipped"].alias("skipped"))


_PRO = "p AS (SELECT user_id, event_id, event_id % 50 AS done, 300 - event_id % 60 AS remaining, CASE WHEN event_type = 'view' THEN value / 4 ELSE 0.0 END AS face, CASE WHEN event_type <> 'error' THEN value / 2 ELSE 0.0 END AS rate FROM events)"


@query(f"""WITH {_PRO}, r AS (SELECT *, CASE WHEN face > 0 THEN face ELSE rate END AS r FROM p),
h AS (SELECT *, CASE WHEN r > 0 AND done >= least(3, remaining) THEN CASE WHEN r >= 20 THEN 0 ELSE greatest(0, remaining - floor(remaining * r / 20)) END END::BIGINT AS size FROM r),
g AS (SELECT *, last_value(size IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS head_start FROM h),
o AS (SELECT *, coalesce(done >= head_start, false) OR done >= remaining AS release FROM g),
b AS (SELECT *, bool_or(release) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM o)
SELECT user_id, event_id, head_start, least(done, coalesce(head_start, remaining)) AS shown, greatest(1, coalesce(head_start, remaining)) AS goal, release FROM b WHERE NOT coalesce(over, false)""")
def buffer_release(spark: SparkSession, d: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    p = table(spark, d, "events").select(
        "user_id", "event_id", (i % 50).alias("done_ahead"), (300 - i % 60).alias("remaining"), F.when(t == "view", F.col("value") / 4).otherwise(0.0).alias("face_rate"),
        F.when(t != "error", F.col("value") / 2).otherwise(0.0).alias("rate"))
    return B.buffered(p, "user_id", "event_id", 20.0)


@query("SELECT event_id, greatest(0, event_id % 70 - event_id % 40 + 1) AS done_ahead, greatest(1, 60 - event_id % 70) AS remaining FROM events")
def buffered_ahead(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    r = B.ahead(i % 70, i % 40, F.lit(60) + i % 40 - i % 70)
    return table(spark, d, "events").select("event_id", r["done_ahead"].alias("done_ahead"), r["remaining"].alias("remaining"))


@query("""SELECT event_id, event_id % 300 - 1 AS submitted, CASE WHEN event_type = 'purchase' THEN event_id % 300 - 1 ELSE least(event_id % 200, event_id % 300 - 1) END AS completed FROM events""")
def control_resets(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "seek").otherwise("pause")
    r = B.after_control(kind, F.col("event_id") % 300, F.col("event_id") % 200)
    return table(spark, d, "events").select("event_id", r["submitted"].alias("submitted"), r["completed"].alias("completed"))


_SYNC = "q AS (SELECT event_id, event_id % 1000 AS target, event_id % 1000 - event_id % 7 AS shown, value AS video, value + (event_id % 9 - 4) / 100.0::DOUBLE AS audio, event_type <> 'error' AS playing FROM events)"


def _sync(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", (i % 1000).alias("target"), (i % 1000 - i % 7).alias("shown"), F.col("value").alias("video"),
                                            (F.col("value") + (i % 9 - 4) / F.lit(100.0)).alias("audio"), (F.col("event_type") != "error").alias("playing"))


@query(f"WITH {_SYNC} SELECT event_id, round(audio - video, 6) AS \"offset\", target - shown AS lag FROM q")
def av_offset_lag(spark: SparkSession, d: str) -> DataFrame:
    r = B.sync_lag(F.col("target"), F.col("shown"), F.col("video"), F.col("audio"))
    return _sync(spark, d).select("event_id", F.round(r["offset"], 6).alias("offset"), r["lag"].alias("lag"))


@query(f"WITH {_SYNC} SELECT event_id, printf('sync t=%.3f target=%d shown=%d video=%.3fs audio=%.3fs offset=%+.3fs lag=%df playing=%d mode=%s', event_id / 8.0::DOUBLE, target, shown, round(video, 2), round(audio, 2), round(audio - video, 2), target - shown, playing::INT, 'normal') AS line FROM q")
def sync_trace_line(spark: SparkSession, d: str) -> DataFrame:
    q = _sync(spark, d)
    return q.select("event_id", K.sync_line(F.col("event_id") / 8.0, F.col("target"), F.col("shown"), F.round("video", 2), F.round("audio", 2), F.col("playing"), F.lit("normal")).alias("line"))


@query("WITH e AS (SELECT *, epoch_us(ts) AS us, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS m FROM events) SELECT event_id, value FROM e WHERE us >= m - 108000000000")
def metrics_history(spark: SparkSession, d: str) -> DataFrame:
    """The last thirty hours of each session, its events being hours apart."""
    return B.history(_events(spark, d), ["user_id"], "us", 108_000.0).select("event_id", "value")


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS seen FROM orders GROUP BY o_custkey) SELECT o_custkey, row_number() OVER (ORDER BY seen) - 1 AS number FROM f""")
def first_seen_numbers(spark: SparkSession, d: str) -> DataFrame:
    return B.first_seen_numbers(table(spark, d, "orders"), "o_custkey", ["o_orderkey"])


@query("SELECT event_id, round(CASE WHEN event_id % 31 > 0 THEN greatest(0.0, 1 / (event_id % 31)::DOUBLE - value / 500) ELSE 0.0 END, 9) AS wait FROM events")
def rate_cap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(P.pace(F.col("value") / 500, (F.col("event_id") % 31).cast("double")), 9).alias("wait"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 61 = 0 THEN 0.1 ELSE round(greatest(0.001, 1 / (event_id % 61)::DOUBLE), 9) END AS seconds, CASE WHEN event_id % 9 > 0 THEN printf('[%d/3] %d%% (%d/%d, %s)', event_id % 3 + 1, round_even((event_id % 500) / (event_id % 9 * 500)::DOUBLE * 100, 0)::BIGINT, event_id % 500, event_id % 9 * 500, event_type) ELSE '' END AS progress,
CASE WHEN event_id * 37 >= 3600 THEN printf('%d:%02d:%02d', event_id * 37 // 3600, event_id * 37 // 60 % 60, event_id * 37 % 60) ELSE printf('%d:%02d', event_id * 37 // 60, event_id * 37 % 60) END AS clock,
CASE WHEN z < 1024 THEN printf('%d B', z) WHEN z < 1048576 THEN printf('%.1f KB', z / 1024.0::DOUBLE) WHEN z < 1073741824 THEN printf('%.1f MB', z / 1048576.0::DOUBLE) WHEN z < 1099511627776 THEN printf('%.1f GB', z / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', z / 1099511627776.0::DOUBLE) END AS size
FROM (SELECT *, event_id * event_id * event_id AS z FROM events)""")
def tick_and_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a step's progress (some without a total), of times from seconds to days, and of sizes from bytes to terabytes."""
    i = F.col("event_id")
    z = i.cast("decimal(19,0)")  # a cube leaves the range of longs from 2,097,152 on
    return table(spark, d, "events").select(
        "event_id", F.round(S.tick_seconds(F.col("event_type") != "error", (i % 61).cast("double")), 9).alias("seconds"),
        S.percent_text(i % 500, i % 9 * 500, i % 3, F.lit(3), F.col("event_type")).alias("progress"), S.clock_text(i * 37).alias("clock"), S.size_text(z * z * z).alias("size"))


@query("""SELECT p_partkey, round((p_size * 3) / 25.0::DOUBLE, 9) AS from_s, round((p_size * 3 + 10) / 25.0::DOUBLE, 9) AS to_s, (p_size * 3 - p_partkey % 90) > greatest(round_even(2 * 30.0::DOUBLE, 0), 10) AS fails FROM part""")
def seconds_and_shortfall(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("p_size") * 3
    r = S.range_seconds(z, z + 9, F.lit(25.0))
    return table(spark, d, "part").select("p_partkey", F.round(r["from_s"], 9).alias("from_s"), F.round(r["to_s"], 9).alias("to_s"), S.shortfall_fails(z, F.col("p_partkey") % 90, F.lit(30.0)).alias("fails"))
