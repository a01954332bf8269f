"""Queries over caches, libraries, stages and the task queue: orders are stages and tasks, pages are library items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import jobs as J
from ..operators import storage as C
from ..operators.versions import Table, put_newest
from ..session import scratch, table
from .registry import registry

QUERIES, ORACLES, query = registry()
CAP, FRAMES = 20_000, 5


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("size"), F.max("l_shipdate").alias("used")).withColumn(
        "protected", F.col("l_orderkey") % 10 == 0)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("size_bytes"))


_ENTRIES = "e AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS size, max(l_shipdate) AS used, l_orderkey % 10 = 0 AS protected FROM lineitem GROUP BY l_orderkey)"
_DIR = "regexp_extract(url, '^(.*)/[^/]*$', 1)"


@query(f"""WITH {_ENTRIES}, r AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY used, l_orderkey) AS upto FROM e WHERE NOT protected)
SELECT l_orderkey, size, repeat(l_orderkey::VARCHAR, 20) AS note FROM r WHERE total - (upto - size) > {CAP}""")
def cache_evict_to_cap(spark: SparkSession, d: str) -> DataFrame:
    """Entries to delete, with a wide column of theirs."""
    e = _entries(spark, d).withColumn("note", F.repeat(F.col("l_orderkey").cast("string"), 20))
    return C.evict_to_cap(e, CAP, "size", "used", "l_orderkey", "protected").select("l_orderkey", "size", "note")


@query(f"WITH {_ENTRIES} SELECT l_orderkey, size FROM e WHERE NOT protected")
def cache_clear_protect(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return C.clear_but(e, table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("l_orderkey", "size")


@query(f"SELECT {_DIR} AS dir, sum(length(html))::BIGINT AS size_bytes, count(*) AS files FROM pages GROUP BY 1")
def dir_sizes(spark: SparkSession, d: str) -> DataFrame:
    return C.folder_sizes(_items(spark, d), "path", "size_bytes")


@query("""WITH n AS (SELECT count(*) AS n FROM pages), r AS (SELECT page_id, row_number() OVER (ORDER BY length(html), page_id) AS k FROM pages)
SELECT page_id, url AS path FROM r JOIN pages USING (page_id), n WHERE n.n > 30 * 1.1 AND k <= n.n - 30""")
def thumbnail_prune(spark: SparkSession, d: str) -> DataFrame:
    return C.prune_to_count(_items(spark, d), 30, "size_bytes", "page_id").select("page_id", "path")


@query("SELECT p_partkey, substr(sha256(p_name || '|' || p_brand || '|' || p_size), 1, 16) AS cache_key FROM part")
def cache_key_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.short_hash("sha256", 16, F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("cache_key"))


def _stages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stages = table(spark, d, "orders").select(F.col("o_orderkey").alias("stage"), F.lit(FRAMES).alias("total"))
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stage"), (F.col("l_linenumber") - 1).cast("long").alias("idx"))
    return stages, done


_DONE = f"d AS (SELECT DISTINCT l_orderkey AS stage, (l_linenumber - 1)::BIGINT AS idx FROM lineitem WHERE l_linenumber <= {FRAMES})"


@query(f"WITH {_DONE}, w AS (SELECT o_orderkey AS stage, unnest(range(0, {FRAMES})) AS idx FROM orders) SELECT stage, idx FROM w WHERE (stage, idx) NOT IN (SELECT (stage, idx) FROM d)")
def stage_missing(spark: SparkSession, d: str) -> DataFrame:
    return J.missing_by(*_stages(spark, d), "stage", "total")


@query(f"""WITH {_DONE}, r AS (SELECT stage, idx, row_number() OVER (PARTITION BY stage ORDER BY idx) - 1 AS n FROM d), c AS (SELECT stage, count(*) AS c FROM r WHERE n = idx GROUP BY stage)
SELECT o_orderkey AS stage, coalesce(c, 0)::BIGINT AS contiguous FROM orders LEFT JOIN c ON o_orderkey = c.stage""")
def stage_high_water(spark: SparkSession, d: str) -> DataFrame:
    return J.high_water(*_stages(spark, d), "stage", "total")


@query(f"WITH {_DONE}, c AS (SELECT stage, count(*) AS c FROM d GROUP BY stage) SELECT o_orderkey AS stage, coalesce(c, 0) = {FRAMES} AS complete FROM orders LEFT JOIN c ON o_orderkey = c.stage")
def stage_complete(spark: SparkSession, d: str) -> DataFrame:
    return J.complete(*_stages(spark, d), "stage", "total")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "PAUSED").otherwise("COMPLETED")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("order"), F.col("o_orderkey").cast("string").alias("file"), status.alias("status"))


@query("SELECT o_orderpriority AS \"order\", o_orderkey::VARCHAR AS file FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY 1, 2 LIMIT 1")
def queue_next_task(spark: SparkSession, d: str) -> DataFrame:
    """The one task that the queue takes next."""
    return J.next_task(_tasks(spark, d)).select("order", "file")


@query("""SELECT page_id, row_number() OVER (ORDER BY coalesce(nullif(length(html), 3514), -1) DESC, url) AS place FROM pages QUALIFY place <= 20 UNION ALL
SELECT page_id, -row_number() OVER (ORDER BY coalesce(CASE WHEN page_id % 3 > 0 THEN page_id::DOUBLE % 7 END, '-inf'::DOUBLE), url) FROM pages QUALIFY row_number() OVER (ORDER BY coalesce(CASE WHEN page_id % 3 > 0 THEN page_id::DOUBLE % 7 END, '-inf'::DOUBLE), url) <= 20""")
def library_sort(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest and (places below 0) the twenty oldest items, unknown sizes and times among them; top lists."""
    from pyspark.sql import Window as W

    items = _items(spark, d).withColumn("size_bytes", F.nullif("size_bytes", F.lit(3514))).withColumn("mtime", F.when(F.col("page_id") % 3 > 0, (F.col("page_id") % 7).cast("double")))
    large, old = C.sorted_library(items, "size_bytes", True).limit(20), C.sorted_library(items, "mtime").limit(20)
    place = lambda *order: F.row_number().over(W.orderBy(*order)).cast("long")
    a = large.select("page_id", place(F.coalesce("size_bytes", F.lit(-1)).desc(), "path").alias("place"))
    return a.unionAll(old.select("page_id", (-place(F.coalesce("mtime", F.lit(float("-inf"))), "path")).alias("place")))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_brand || ' ' || p_name), lower('D#1'))")
def library_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("caption", F.concat_ws(" ", "p_brand", "p_name"))
    return C.caption_filter(p, "caption", "D#1").select("p_partkey", "p_name", "p_brand")


@query("SELECT lower(regexp_extract(url, '([^/]*)$', 1)) AS name, count(*) AS n FROM pages GROUP BY 1")
def library_by_name(spark: SparkSession, d: str) -> DataFrame:
    return C.library(_items(spark, d)).groupBy("name").agg(F.count("*").alias("n"))


@query(r"WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS path, page_id, length(html)::BIGINT AS size_bytes FROM pages), q AS (SELECT * FROM p UNION ALL SELECT path, page_id + 1000000, size_bytes FROM p) SELECT path, min(page_id) AS page_id, arg_min(size_bytes, page_id) AS size_bytes FROM q GROUP BY path")
def library_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """All pages added twice, under paths without query and fragment: the first of each path stays."""
    p = _items(spark, d).withColumn("path", F.regexp_replace("path", r"[?#].*$", ""))
    return C.first_by_path(p.unionByName(p.withColumn("page_id", F.col("page_id") + 1_000_000)), "path", "page_id")


_ENDS = [f"/a.{e}" for e in (*S.VIDEO, *S.IMAGE)] + ["/A.JFIF", "/b.M2TS", "/.gif", "/a", "/a.txt", "/a.", "/a.tar.3gp", "/x.mp4/a", "..ogv"]
_EXT = r"lower(regexp_extract(path, '[^/\\]\.([^./\\]+)$', 1))"
_IN = lambda x: ", ".join(f"'{e}'" for e in x)


@query(f"""WITH p AS (SELECT page_id, url || ([{_IN(_ENDS)}])[page_id % {len(_ENDS)} + 1] AS path FROM pages), e AS (SELECT page_id, path, {_EXT} AS ext FROM p)
SELECT page_id, ext, CASE WHEN ext IN ({_IN(S.VIDEO)}) THEN 'video' WHEN ext IN ({_IN(S.IMAGE)}) THEN 'image' ELSE 'other' END AS kind,
CASE WHEN ext = 'txt' THEN 'video' WHEN ext IN ({_IN(S.IMAGE)}) THEN 'image' ELSE 'other' END AS own_kind FROM e""")
def media_kind(spark: SparkSession, d: str) -> DataFrame:
    """By the usual extensions, and with an own set for videos."""
    end = F.get(F.array(*[F.lit(x) for x in _ENDS]), (F.col("page_id") % len(_ENDS)).cast("int"))
    p = F.concat("url", end)
    return table(spark, d, "pages").select("page_id", S.extension(p).alias("ext"), S.media_kind(p).alias("kind"), S.media_kind(p, video=[".TXT"]).alias("own_kind"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def models_missing(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("length"))
    return C.missing(table(spark, d, "part"), have, "p_partkey").select("p_partkey")


@query("""WITH m AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size > 25), k AS (SELECT p_type, min(p_brand) AS p_brand FROM m GROUP BY p_type)
SELECT p_partkey, p_type, k.p_brand AS first_brand, k.p_type IS NOT NULL AS known FROM part LEFT JOIN k USING (p_type)""")
def catalogue_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts looked up by type in a catalogue that lacks some types."""
    p = table(spark, d, "part")
    known = p.where("p_size > 25").groupBy("p_type").agg(F.min("p_brand").alias("first_brand"))
    return C.looked_up(p.select("p_partkey", "p_type"), known, "p_type").select("p_partkey", "p_type", "first_brand", "known")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 3 END, CASE WHEN p_brand IN ('Brand#3', 'Brand#1') THEN '' ELSE p_brand END, lower(name), name) AS place FROM (SELECT *, p_name || p_partkey AS name FROM part)""")
def catalogue_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    return C.catalogue_entries(p, "p_brand", "name", ["Brand#3", "Brand#1"]).select("p_partkey", "place")


@query("""WITH p AS (SELECT user_id * 20 + event_id % 20 AS path, event_id AS seq FROM events) SELECT path, max(seq) AS "at", 'thumb' || max(seq) AS caption, 3 AS version FROM p GROUP BY path""")
def thumbnail_puts(spark: SparkSession, d: str) -> DataFrame:
    """Thumbnails put in three batches, each a version of the store; of each path the newest stays."""
    i = F.col("event_id")
    e = table(spark, d, "events").select((F.col("user_id") * 20 + i % 20).alias("path"), i.alias("at"), F.concat(F.lit("thumb"), i.cast("string")).alias("caption"))
    store = Table(spark, scratch(spark, "thumbnails"))
    for k in range(3):
        put_newest(store, e.where(F.col("at") % 3 == k), "path", "at")
    return store.read().withColumn("version", F.lit(store.latest()))


@query("SELECT event_id, round(10 + least(1.0, greatest(0.0, (value - 20) / 60)) * -8, 9) AS y FROM events")
def interpolated(spark: SparkSession, d: str) -> DataFrame:
    """A falling line between two values, constant beyond."""
    return table(spark, d, "events").select("event_id", F.round(V.interpolate(F.col("value"), 20.0, 80.0, 10.0, 2.0), 9).alias("y"))
