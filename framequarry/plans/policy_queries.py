"""Replays of policies over the `events` table: a user is a session, its events in order are ticks, puts and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage as C
from ..session import table
from ..streaming import policies as P
from .registry import registry

QUERIES, ORACLES, query = registry()


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    long = lambda c: c.cast("long")
    return e.select(
        "user_id", F.col("event_id").alias("seq"), F.col("event_id").alias("target"), long(F.col("event_id") - F.col("event_id") % 40).alias("last_submitted"),
        long(F.col("event_id") - F.col("event_id") % 97).alias("last_completed"), F.col("value").alias("read_latency_ms"),
        (F.col("value") / 4).alias("process_fps"), long(F.col("event_id") % 4 + 1).alias("workers"), long(F.col("event_id") % 9).alias("outstanding"))


_TICKS = """t AS (SELECT user_id, event_id AS seq, event_id AS target, event_id - event_id % 40 AS last_submitted, event_id - event_id % 97 AS last_completed, value AS latency,
value / 4 AS rate, event_id % 4 + 1 AS workers, event_id % 9 AS outstanding, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""


def _strategy_sql(full: str, lead: str) -> str:
    """The rules of skipping as recursive SQL: `b` while in sequence, `o` after giving up, `l` the least lag, `e` ever."""
    return f"""WITH RECURSIVE {_TICKS},
s AS (SELECT user_id, 0::BIGINT AS n, false AS b, 0::BIGINT AS l, false AS o, false AS e, NULL::BIGINT AS seq, NULL::BIGINT AS frame FROM (SELECT DISTINCT user_id FROM t)
UNION ALL SELECT user_id, n, b2, l2, o2, e2, seq, CASE WHEN full_up THEN NULL WHEN NOT e2 OR b2 THEN last_submitted + 1 WHEN goal <= target + 120 THEN goal END FROM (
 SELECT *, greatest(last_submitted + 1, target + {lead}) AS goal,
  CASE WHEN full_up THEN b WHEN NOT e2 THEN false WHEN b THEN lag > 30 AND lag <= least(l, lag) + 60 WHEN o THEN false ELSE lag > 60 AND coalesce(latency, 0) > 50 END AS b2,
  CASE WHEN full_up OR NOT e2 THEN o WHEN b THEN lag > 30 AND lag > least(l, lag) + 60 WHEN o THEN lag > 30 ELSE false END AS o2,
  CASE WHEN full_up OR NOT e2 THEN l WHEN b THEN least(l, lag) ELSE lag END AS l2 FROM (
   SELECT t.*, s.b, s.l, s.o, s.e OR t.last_completed >= 0 AS e2, target - last_completed AS lag, {full} AS full_up FROM s JOIN t ON t.user_id = s.user_id AND t.n = s.n + 1)))
SELECT user_id, seq, frame AS next_frame, CASE WHEN b THEN 'lagging' ELSE 'normal' END AS mode FROM s WHERE n > 0"""


_FULL = "outstanding >= greatest(1, workers) * 2"


@query(_strategy_sql("false", "0"))
def synced_strategy_replay(spark: SparkSession, d: str) -> DataFrame:
    return P.replay(_ticks(spark, d), "user_id", P.synced())


@query(_strategy_sql(_FULL, "CASE WHEN rate > 0 THEN greatest(0, least(ceil(greatest(1, workers) * 2 * 30::DOUBLE / rate)::BIGINT, 120)) ELSE 0 END"))
def predictive_strategy_replay(spark: SparkSession, d: str) -> DataFrame:
    return P.replay(_ticks(spark, d), "user_id", P.predictive())


@query(f"""WITH {_TICKS}, f AS (SELECT *, last_submitted + CASE WHEN rate > 0 THEN greatest(1, ceil(30::DOUBLE / rate)::BIGINT) ELSE 1 END AS frame FROM t)
SELECT user_id, seq, CASE WHEN NOT ({_FULL}) AND frame <= target + 600 THEN frame END AS next_frame FROM f""")
def buffering_strategy_replay(spark: SparkSession, d: str) -> DataFrame:
    return _ticks(spark, d).select("user_id", "seq", P.buffering_frame().alias("next_frame"))


@query("""WITH r AS (SELECT user_id, event_id, (event_id * 7) % 1000 AS s, event_id // 5000 AS g FROM events),
t AS (SELECT *, max(g * 100000 + s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r)
SELECT user_id, event_id, s::BIGINT AS s, g::BIGINT AS g FROM t WHERE top IS NULL OR g * 100000 + s > top""")
def latest_wins_emit(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 1000).alias("s"), F.floor(F.col("event_id") / 5000).alias("g"))
    return P.latest_wins(done, "user_id", "event_id", "s", "g")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "take").otherwise("put").alias("op"),
                                            (F.col("event_id") % 50).alias("item"))


_STEPS = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type = 'error' AS take FROM events)"


@query(f"""WITH RECURSIVE {_STEPS}, s AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS q, NULL::BIGINT AS seq, NULL::VARCHAR AS fate FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.n, CASE WHEN e.take THEN q[2:] WHEN len(q) = 3 THEN list_append(q[2:], e.event_id) ELSE list_append(q, e.event_id) END,
 CASE WHEN e.take OR len(q) = 3 THEN q[1] END, CASE WHEN e.take THEN 'taken' ELSE 'dropped' END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1),
w AS (SELECT user_id, unnest(q) AS seq, 'waiting' AS fate FROM (SELECT user_id, arg_max(q, n) AS q FROM s GROUP BY user_id))
SELECT user_id, seq, seq % 50 AS item, fate FROM (SELECT user_id, seq, fate FROM s WHERE seq IS NOT NULL UNION ALL SELECT * FROM w)""")
def drop_oldest_queue(spark: SparkSession, d: str) -> DataFrame:
    return P.drop_oldest(_queue(spark, d), "user_id", "seq", "op", "item", 3)


@query(f"""WITH RECURSIVE {_STEPS}, s AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS w, 0::BIGINT AS a, 0::BIGINT AS d, 0::BIGINT AS o FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.n, CASE WHEN take THEN greatest(0, w - 1) ELSE least(3, w + 1) END, a + (NOT take AND w < 3)::BIGINT, d + (NOT take AND w >= 3)::BIGINT, o + (take AND w > 0)::BIGINT
 FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, arg_max(a, n) AS accepted, arg_max(d, n) AS dropped, arg_max(o, n) AS written FROM s GROUP BY user_id""")
def drop_newest_writer(spark: SparkSession, d: str) -> DataFrame:
    return P.drop_newest(_queue(spark, d), "user_id", "seq", "op", 3)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events), s AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id
UNION ALL SELECT s.user_id, min(e.us) FROM s JOIN e ON e.user_id = s.user_id AND e.us >= s.us + 86400000000 GROUP BY s.user_id) SELECT user_id, us FROM s""")
def time_throttle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return P.throttle(e, "user_id", "us", 86_400.0)


_OP = {"view": "get", "click": "put", "purchase": "put", "signup": "has", "error": "resize"}


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _OP.items())} END AS op,
 event_id % 20 AS item, CASE WHEN event_type = 'error' THEN 40 + event_id % 100 ELSE floor(value)::BIGINT + 1 END AS size FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, []::STRUCT(i BIGINT, z BIGINT)[] AS c, 300::BIGINT AS m, NULL::BIGINT AS seq, NULL::BOOLEAN AS hit FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, n, c3[list_filter(range(1, len(c3) + 2), lambda k: coalesce(list_sum(list_transform(c3[k:], lambda x: x.z)), 0) <= m2)[1]:], m2, seq, hit FROM (
 SELECT *, CASE WHEN op = 'resize' THEN size ELSE m END AS m2, CASE WHEN op IN ('get', 'has') THEN len(own) > 0 END AS hit,
  CASE WHEN op = 'get' THEN list_concat(others, own) WHEN op = 'put' AND size <= m THEN list_append(others, {{'i': item, 'z': size}}) ELSE c END AS c3 FROM (
   SELECT e.*, s.c, s.m, list_filter(s.c, lambda x: x.i = e.item) AS own, list_filter(s.c, lambda x: x.i <> e.item) AS others FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
SELECT user_id, seq, hit, coalesce(list_sum(list_transform(c, lambda x: x.z)), 0)::BIGINT AS held FROM s WHERE n > 0""")
def lru_trace(spark: SparkSession, d: str) -> DataFrame:
    op = F.create_map(*[F.lit(x) for kv in _OP.items() for x in kv])[F.col("event_type")]
    size = F.when(op == "resize", 40 + F.col("event_id") % 100).otherwise(F.floor("value") + 1)
    t = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 20).alias("item"), size.cast("long").alias("size"))
    return C.lru_trace(t, "user_id", "seq", "op", "item", "size", 300)
