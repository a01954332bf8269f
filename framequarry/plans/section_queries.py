"""Queries over interval sets: each customer's orders as ranges of order keys, and the selection of one target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sections as X
from ..session import table
from .registry import registry

QUERIES, ORACLES, query = registry()

_MERGE = """, c0 AS (SELECT k, greatest(least(a, b), 0) AS s, greatest(a, b) AS e FROM p WHERE greatest(a, b) >= 0),
c1 AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c0),
c2 AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM c1),
x AS (SELECT k, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM c2 GROUP BY k, g)"""
_CUST = "WITH p AS (SELECT o_custkey AS k, o_orderkey - 3 AS a, o_orderkey + (o_orderkey % 40) AS b FROM orders)" + _MERGE
#: Ranges by priority: a few targets of many ranges each, some turned round and some partly below 0.
_PRIO = "WITH p AS (SELECT o_orderpriority AS k, o_orderkey + (o_orderkey % 5) AS a, o_orderkey - (o_orderkey % 7) - 2 AS b FROM orders WHERE o_orderkey % 3 = 0)" + _MERGE


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    return table(spark, d, "orders").where(i % 3 == 0).select(F.col("o_orderpriority").alias("k"), (i + i % 5).alias("start"), (i - i % 7 - 2).alias("end"))


def _of_customers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return X.canonical(o.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") - 3).alias("start"), (F.col("o_orderkey") + F.col("o_orderkey") % 40).alias("end")), "k")


@query(f'{_PRIO} SELECT k, s AS start, e AS "end" FROM x')
def sections_merge(spark: SparkSession, d: str) -> DataFrame:
    return X.canonical(_pairs(spark, d), "k")


@query(f'{_CUST} SELECT k, s AS start, e AS "end" FROM x')
def sections_merge_by_target(spark: SparkSession, d: str) -> DataFrame:
    return _of_customers(spark, d)


@query(f"{_CUST} SELECT k, sum(e - s + 1)::BIGINT AS frames, min(s) AS first, max(e) AS last FROM x GROUP BY k")
def sections_total(spark: SparkSession, d: str) -> DataFrame:
    return X.totals(_of_customers(spark, d), "k")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames, each asked of the set of the customer of its user's number."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") + 1).alias("k"), (F.col("event_id") * 7 % 15000).alias("f"))
    return e.join(X.as_array(_of_customers(spark, d), "k"), "k")


_ASK = _CUST + ", q AS (SELECT event_id, user_id + 1 AS k, event_id * 7 % 15000 AS f FROM events WHERE user_id + 1 IN (SELECT k FROM x))"


@query(f"{_ASK} SELECT event_id, EXISTS (SELECT 1 FROM x WHERE x.k = q.k AND f BETWEEN s AND e) AS inside FROM q")
def sections_contains(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("event_id", X.contains(F.col("ranges"), F.col("f")).alias("inside"))


@query(f"{_ASK}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i FROM x) SELECT event_id, (SELECT max(i) FROM n WHERE n.k = q.k AND f BETWEEN s AND e) AS ordinal FROM q")
def sections_index(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("event_id", X.index_of(F.col("ranges"), F.col("f")).alias("ordinal"))


@query(f"{_ASK} SELECT event_id, (SELECT min(greatest(f, s)) FROM x WHERE x.k = q.k AND e >= f) AS next_frame FROM q")
def sections_next_included(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("event_id", X.next_included(F.col("ranges"), F.col("f")).alias("next_frame"))


@query(f"{_ASK} SELECT event_id, coalesce((SELECT sum(greatest(0, least(e, f + 299) - greatest(s, f + 1) + 1)) FROM x WHERE x.k = q.k), 0)::BIGINT AS frames FROM q")
def included_between(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("event_id", X.included_between(F.col("ranges"), F.col("f"), F.col("f") + 300).alias("frames"))


@query(f'{_CUST} SELECT k, s AS start, least(e, 5000) AS "end" FROM x WHERE s <= 5000')
def sections_clamp(spark: SparkSession, d: str) -> DataFrame:
    return X.clamp(_of_customers(spark, d), 5000, "k")


@query(f'{_CUST}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i FROM x) SELECT k, s AS start, e AS "end" FROM n WHERE i <> 1')
def sections_without(spark: SparkSession, d: str) -> DataFrame:
    return X.without(_of_customers(spark, d), 1, "k")


@query("WITH p AS (SELECT o_custkey AS k, o_orderkey - 3 AS a, o_orderkey + (o_orderkey % 40) AS b FROM orders UNION ALL SELECT o_custkey, o_orderkey + 30, o_orderkey + 50 FROM orders)" + _MERGE + ' SELECT k, s AS start, e AS "end" FROM x')
def sections_union(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") + 30).alias("start"), (F.col("o_orderkey") + 50).alias("end"))
    return X.union(_of_customers(spark, d), more, "k")


@query(_CUST.replace("FROM c2 GROUP BY k, g)", "FROM c2 GROUP BY k, g), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i FROM x)").replace("WITH p AS", "WITH p0 AS")
       .replace("FROM p WHERE", "FROM p0 WHERE") + ", p AS (SELECT k, s AS a, e AS b FROM n WHERE i <> 1 UNION ALL SELECT DISTINCT k, 100, 5000 FROM n)"
       + _MERGE.replace("c0", "d0").replace("c1", "d1").replace("c2", "d2").replace("x AS", "y AS") + ' SELECT k, s AS start, e AS "end" FROM y')
def sections_replaced(spark: SparkSession, d: str) -> DataFrame:
    return X.replaced(_of_customers(spark, d), 1, 100, 5000, "k")


#: Every customer is a target of 5,000 frames; those without orders have an empty set, which means all frames.
_PLAN = f"""{_CUST}, f AS (SELECT k, unnest(range(s, least(e, 4999) + 1)) AS f FROM x WHERE s <= 4999 UNION ALL SELECT c_custkey, unnest(range(0, 5000)) FROM customer WHERE c_custkey NOT IN (SELECT k FROM x)),
pl AS (SELECT k, f AS frame_index, row_number() OVER (PARTITION BY k ORDER BY f) - 1 AS position FROM f)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(5000).cast("long").alias("total"))
    return X.frame_plan(_of_customers(spark, d), targets, "k")


@query(f"{_PLAN} SELECT k, frame_index, position FROM pl WHERE k IN (SELECT c_custkey FROM customer)")
def frame_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query(f"{_PLAN} SELECT k, frame_index, position FROM pl WHERE position % 15 = 0 AND position >= 45 AND k IN (SELECT c_custkey FROM customer)")
def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    return X.strided(_plan(spark, d), 15, 3)


@query(f"""{_CUST}, c AS (SELECT k, s, least(e, 4999) AS e FROM x WHERE s <= 4999), m AS (SELECT k, s, e FROM c UNION ALL SELECT DISTINCT k, 5000, 5000 FROM c),
l AS (SELECT k, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s) + 1, 0) AS start, s - 1 AS "end" FROM m) SELECT k, start, "end" FROM l WHERE start <= "end" """)
def section_gaps(spark: SparkSession, d: str) -> DataFrame:
    return X.gaps(_of_customers(spark, d), 5000, "k")


@query(f"{_PRIO} SELECT event_id, value FROM events WHERE EXISTS (SELECT 1 FROM x WHERE k = '1-URGENT' AND event_id BETWEEN s AND e)")
def selected_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of one target, whose selection is that of urgent orders."""
    one = X.canonical(_pairs(spark, d), "k").where("k = '1-URGENT'")
    return X.selected(table(spark, d, "events").select("event_id", "value"), one, "event_id")
