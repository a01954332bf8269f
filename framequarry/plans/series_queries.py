"""Queries over the `events` stream: ticks, completions, latencies and tracks; a user is a session or target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import playback as B
from ..operators import series as X
from ..operators import timeline as L
from ..session import table
from .registry import registry

QUERIES, ORACLES, query = registry()
#: The table's events lie minutes apart; windows of seconds become windows of as many steps of this length.
STEP = 3600

_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


_W = f"OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN {3 * STEP * 1000000} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {_E}, w AS (SELECT event_id, us, count(*) {_W} AS n, min(us) {_W} AS f FROM e)
SELECT event_id, CASE WHEN n < 2 OR us = f THEN 0.0 ELSE round((n - 1) / ((us - f) / 1000000.0::DOUBLE), 9) END AS rate FROM w""")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    return X.window_rate(_events(spark, d), ["event_type"], seconds=3.0 * STEP).select("event_id", F.round("rate", 9).alias("rate"))


_WU = f"OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {3 * STEP * 1000000} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {_E}, m AS (SELECT *, event_type IN ('view', 'click') AS is_event FROM e),
w AS (SELECT *, count(CASE WHEN is_event THEN us END) {_WU} AS n, min(CASE WHEN is_event THEN us END) {_WU} AS f, max(CASE WHEN is_event THEN us END) {_WU} AS l FROM m),
k AS (SELECT *, CASE WHEN n >= 2 AND l > f THEN (n - 1) / ((l - f) / 1000000.0::DOUBLE) WHEN n >= 2 THEN 0.0 END AS live FROM w),
p AS (SELECT *, last_value(live IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS known, max(CASE WHEN is_event THEN us END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS last FROM k),
i AS (SELECT *, (us - last) / 1000000.0::DOUBLE AS idle FROM p)
SELECT event_id, round(coalesce(live, CASE WHEN last IS NULL OR idle > {30 * STEP} THEN 0.0 ELSE least(CASE WHEN known > 0 THEN known ELSE 120.0 END, CASE WHEN idle > 0 THEN 1 / idle ELSE coalesce(known, 0.0) END) END), 9) AS rate FROM i""")
def rate_with_decay(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("is_event", F.col("event_type").isin("view", "click"))
    return X.rate_with_decay(e, ["user_id"], seconds=3.0 * STEP, stall=30.0 * STEP).select("event_id", F.round("rate", 9).alias("rate"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events)
SELECT event_type, count(value) AS n, CASE WHEN count(value) < 2 THEN 0.0 ELSE round(quantile_cont(value, 0.5), 6) END AS p50, CASE WHEN count(value) < 2 THEN 0.0 ELSE round(quantile_cont(value, 0.95), 6) END AS p95
FROM r WHERE n <= 200 GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    r = X.recent_percentiles(table(spark, d, "events"), ["event_type"], "value", ["event_id"])
    return r.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(f"""WITH {_E}, v AS (SELECT * FROM e WHERE event_type = 'view'), j AS (SELECT a.event_id, b.value FROM v a JOIN v b ON a.user_id = b.user_id AND b.us <= a.us AND b.us >= a.us - {72 * STEP * 1000000})
SELECT event_id, count(*) AS n, median(value) AS median FROM j GROUP BY event_id""")
def median_latency(spark: SparkSession, d: str) -> DataFrame:
    v = _events(spark, d).where("event_type = 'view'")
    return B.recent_values(v, ["user_id"], "value", "us", 72.0 * STEP).select("event_id", "n", "median")


@query(f"WITH {_E} SELECT event_type, round(avg(value), 6) AS mean FROM e WHERE us >= (SELECT max(us) FROM e) - {72 * STEP * 1000000} GROUP BY event_type")
def mean_by_processor(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return X.mean_by(e.join(F.broadcast(e.agg(F.max("us").alias("now")))), ["event_type"], "value", "us", F.col("now"), 72.0 * STEP).select("event_type", F.round("mean", 6).alias("mean"))


@query(f"""WITH {_E}, l AS (SELECT *, floor(value * 10)::BIGINT - lag(floor(value * 10)::BIGINT) OVER w AS dc, us - lag(us) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT event_id, CASE WHEN dc IS NULL OR dt <= 0 OR dc < 0 THEN 0.0 ELSE round(dc / (dt / 1000000.0::DOUBLE), 9) END AS rate FROM l""")
def counter_rate(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("c", F.floor(F.col("value") * 10))
    return X.counter_rate(e, ["user_id"], "c").select("event_id", F.round("rate", 9).alias("rate"))


_WS = f"OVER (PARTITION BY user_id, event_type ORDER BY us RANGE BETWEEN {20 * STEP * 1000000} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {_E}, w AS (SELECT *, min(us) {_WS} AS t0, arg_min(event_id, us) {_WS} AS d0, lag(us) OVER q AS lt, lag(event_id) OVER q AS ld,
min(us) OVER (PARTITION BY user_id, event_type) AS s FROM e WINDOW q AS (PARTITION BY user_id, event_type ORDER BY us)),
v AS (SELECT *, CASE WHEN t0 = us THEN lt ELSE t0 END AS t, CASE WHEN t0 = us THEN ld ELSE d0 END AS d FROM w), r AS (SELECT *, coalesce(CASE WHEN us > t THEN (event_id - d) / ((us - t) / 1000000.0::DOUBLE) ELSE 0.0 END, 0.0) AS rate, (us - s) / 1000000.0::DOUBLE AS elapsed FROM v)
SELECT event_id, round(rate, 9) AS rate, elapsed, CASE WHEN rate > 0 AND event_id % 5 > 0 THEN round(elapsed + event_id % 5 * 100 / rate, 3) END AS expected FROM r""")
def step_rate(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("total", F.col("event_id") + F.col("event_id") % 5 * 100)
    r = X.step_rate(e, ["user_id"], "event_type", "event_id", seconds=20.0 * STEP, total="total")
    return r.select("event_id", F.round("rate", 9).alias("rate"), "elapsed", F.round("expected", 3).alias("expected"))


@query("""WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT event_id, event_type FROM l WHERE n = 1 OR event_type IS DISTINCT FROM b""")
def change_only(spark: SparkSession, d: str) -> DataFrame:
    return X.changes(table(spark, d, "events"), ["user_id"], "event_type", "event_id").select("event_id", "event_type")


@query("""WITH s AS (SELECT event_id, user_id, event_id + floor(value)::BIGINT AS shown FROM events), m AS (SELECT *, max(shown) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM s)
SELECT event_id, shown FROM m WHERE t IS NULL OR shown >= t""")
def no_backward_display(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") + F.floor("value")).alias("shown"))
    return X.never_back(e, ["user_id"], "shown", "event_id").select("event_id", "shown")


@query("SELECT event_id, greatest(0, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 0))::BIGINT AS skipped FROM events")
def skip_accounting(spark: SparkSession, d: str) -> DataFrame:
    return X.skipped(table(spark, d, "events"), ["user_id"], "event_id", "event_id").select("event_id", "skipped")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT event_id, last_value(CASE WHEN n % 5 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS carried FROM n""")
def carry_forward_detection(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, d, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1)
    return X.carry_forward(e, ["user_id"], "value", "n", 5, "carried").select("event_id", "carried")


@query("""SELECT event_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_bad,
max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_bad FROM events""")
def problem_frames_next_prev(spark: SparkSession, d: str) -> DataFrame:
    return X.next_previous(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error").select("event_id", "next_bad", "previous_bad")


@query("""WITH t AS (SELECT event_id, user_id FROM events WHERE event_type <> 'view'), c AS (SELECT event_id AS f, user_id FROM events WHERE event_type = 'view')
SELECT event_id, f AS shown FROM t ASOF LEFT JOIN c ON t.user_id = c.user_id AND t.event_id >= c.f""")
def asof_latest_at_or_below(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return X.as_of(e.where("event_type <> 'view'"), e.where("event_type = 'view'"), ["user_id"], "event_id", "event_id").select("event_id", "shown")


_TRACK = """t AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id)) * 1 + 3 * (((row_number() OVER (PARTITION BY user_id ORDER BY event_id)) - 1) // 12) AS f, value FROM events),
r AS (SELECT *, f - row_number() OVER (PARTITION BY user_id ORDER BY f) AS run FROM t), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n FROM r),
k AS (SELECT *, CASE WHEN least(9, n - (1 - n % 2)) < 3 THEN 1 ELSE least(9, n - (1 - n % 2)) END AS len FROM n)"""


@query(f"""WITH {_TRACK}, j AS (SELECT a.event_id, a.value, a.len, sum(exp(-((b.f - a.f) ** 2) / (2 * ((a.len - 1) / 2.0 / 3) ** 2)) * b.value) / sum(exp(-((b.f - a.f) ** 2) / (2 * ((a.len - 1) / 2.0 / 3) ** 2))) AS m
FROM k a JOIN k b ON a.user_id = b.user_id AND a.run = b.run AND abs(a.f - b.f) <= (a.len - 1) / 2 WHERE a.len > 1 GROUP BY a.event_id, a.value, a.len)
SELECT event_id, round(value + 0.7 * (m - value), 6) AS value FROM j UNION ALL SELECT event_id, round(value, 6) FROM k WHERE len = 1""")
def smooth_track(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    t = table(spark, d, "events").select("user_id", "event_id", "value", (n + 3 * F.floor((n - 1) / 12)).alias("f"))
    return X.smooth(t, ["user_id"], "f", ["value"], 9, 0.7).select("event_id", F.round("value", 6).alias("value"))


_WIDTH = 160


@query(f"""WITH s AS (SELECT event_id AS f, event_type AS state, event_type = 'error' AS a FROM events), t AS (SELECT max(f) + 1 AS n FROM s), c AS (SELECT n, unnest(range(0, {_WIDTH})) AS cx FROM t),
j AS (SELECT cx, state, count(*) AS c, bool_or(a) AS a FROM c JOIN s ON f >= cx * n // {_WIDTH} AND f < greatest(cx * n // {_WIDTH} + 1, (cx + 1) * n // {_WIDTH}) GROUP BY cx, state)
SELECT cx::INT AS cx, state, round(c / sum(c) OVER (PARTITION BY cx)::DOUBLE, 9) AS share, bool_or(a) OVER (PARTITION BY cx) AS any_absent FROM j""")
def state_histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("a", F.col("event_type") == "error")
    n = (e.agg(F.max("event_id").alias("last")).first().last or 0) + 1
    r = L.state_columns(e, "event_id", "event_type", n, _WIDTH, "a")
    return r.select("cx", F.col("event_type").alias("state"), F.round("share", 9).alias("share"), "any_absent")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_by_key_state(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_state(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT event_id, user_id % 4 AS generation FROM events WHERE user_id % 4 = (SELECT max(user_id % 4) FROM events WHERE event_type = 'signup')")
def generation_gate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("generation", F.col("user_id") % 4)
    return L.current_generation(e.select("event_id", "generation"), e.where("event_type = 'signup'").select("generation"))


@query("""WITH w AS (SELECT event_id AS f FROM events), m AS (SELECT event_id AS f, value FROM events WHERE event_id % 3 = 0), s AS (SELECT event_id AS f, value * 2 AS value FROM events WHERE event_id % 2 = 0), t AS (SELECT event_id AS f FROM events WHERE event_id % 10 = 0)
SELECT f, CASE WHEN t.f IS NULL THEN coalesce(m.value, s.value) END AS value, CASE WHEN t.f IS NOT NULL THEN 'miss' WHEN m.value IS NOT NULL THEN 'memory' WHEN s.value IS NOT NULL THEN 'disk' ELSE 'miss' END AS origin
FROM w LEFT JOIN m USING (f) LEFT JOIN s USING (f) LEFT JOIN t USING (f)""")
def cache_read_through(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("f"), "value")
    return L.read_through(e.select("f"), e.where("f % 3 = 0"), e.where("f % 2 = 0").withColumn("value", F.col("value") * 2), e.where("f % 10 = 0").select("f"), "f", "value")


@query("""SELECT user_id, count_if(event_type = 'view') / count(*)::DOUBLE AS hit_ratio, greatest(0, max(event_id) - arg_max(event_id - floor(value)::BIGINT, event_id)) AS frame_lag,
greatest(0, max(event_id) - arg_max(event_id + 2, event_id)) AS display_lag FROM events GROUP BY user_id""")
def buffer_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("hit"), (F.col("event_id") - F.floor("value")).alias("done"), (F.col("event_id") + 2).alias("shown"))
    return L.buffer_metrics(e, ["user_id"], "hit", "event_id", "done", "shown")


_R = "r AS (SELECT p_partkey, (p_size * 10) AS n, (p_partkey % 40)::DOUBLE AS r, (p_partkey % 31 * 2)::DOUBLE AS f FROM part)"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", (F.col("p_size") * 10).alias("n"), (F.col("p_partkey") % 40).cast("double").alias("r"), (F.col("p_partkey") % 31 * 2).cast("double").alias("f"))


@query(f"WITH {_R} SELECT p_partkey, (CASE WHEN n <= 0 THEN 0 WHEN r <= 0 OR f <= 0 THEN n WHEN r >= f THEN 0 ELSE greatest(0, n - floor(n * r / nullif(f, 0))) END)::BIGINT AS frames FROM r")
def prefill_dense(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d).select("p_partkey", S.required_prefill(F.col("n"), F.col("r"), F.col("f")).alias("frames"))


@query(f"WITH {_R} SELECT p_partkey, (CASE WHEN f <= 0 THEN 0 WHEN r >= f THEN 0 ELSE ceil(2.5 * f) END)::BIGINT AS frames FROM r")
def prefill_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d).select("p_partkey", S.sparse_prefill(F.col("f"), F.col("r"), F.lit(2.5)).alias("frames"))


@query(f"WITH {_R} SELECT p_partkey, (CASE WHEN r <= 0 OR f <= 0 THEN 0 ELSE greatest(0, least(ceil(8 * f / nullif(r, 0)), 120, floor(4.0 * f))) END)::BIGINT AS lead, (CASE WHEN r <= 0 THEN 0 ELSE least(ceil(8 * f / nullif(r, 0)), 120) END)::BIGINT AS free_lead, (CASE WHEN r <= 0 OR f <= 0 THEN 1 ELSE greatest(1, ceil(f / nullif(r, 0))) END)::BIGINT AS stride FROM r")
def predictive_lead(spark: SparkSession, d: str) -> DataFrame:
    lead = [S.predictive_lead(F.col("f"), F.col("r"), F.lit(8), F.lit(120), *cap).alias(n) for n, cap in (("lead", [F.lit(4.0)]), ("free_lead", []))]
    return _rates(spark, d).select("p_partkey", *lead, S.stride(F.col("f"), F.col("r")).alias("stride"))


@query("SELECT event_id, greatest(0, least(5000, CASE WHEN event_type <> 'error' THEN event_id % 100 + floor(value * 25.0) ELSE event_id % 100 END))::BIGINT AS frame FROM events")
def clock_to_frame(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", S.frame_at(F.col("event_id") % 100, F.col("value"), F.lit(25.0), F.lit(5000), F.col("event_type") != "error").alias("frame"))
