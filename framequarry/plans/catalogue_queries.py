"""Queries over catalogues of identities, geometry, parameters, keys and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import params as R
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import detections as D
from ..operators import identities as I
from ..operators import stores as T
from ..session import table
from .identity_queries import _CAT, _catalogue
from .registry import registry

QUERIES, ORACLES, query = registry()


@query(f"""WITH {_CAT}, x AS (SELECT user_id, event_id, event_type, 'p' || (user_id % 12) AS id, CASE WHEN event_id % 3 > 0 THEN 'new' || (event_id % 5) END AS v FROM events),
l AS (SELECT id, arg_max([v], event_id)[1] AS v, true AS has FROM x WHERE event_type IN ('view', 'click') GROUP BY id), g AS (SELECT DISTINCT id FROM x WHERE event_type = 'signup' AND user_id % 12 = 5)
SELECT ord, cat.id, CASE WHEN has THEN v ELSE source_path END AS source_path FROM cat LEFT JOIN l ON l.id = cat.id WHERE cat.id NOT IN (SELECT id FROM g)""")
def catalogue_edits(spark: SparkSession, d: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    op = F.when(t.isin("view", "click"), "assign").when((t == "signup") & (F.col("user_id") % 12 == 5), "remove")
    edits = table(spark, d, "events").select(i.alias("seq"), op.alias("op"), F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("id"), F.when(i % 3 > 0, F.concat(F.lit("new"), (i % 5).cast("string"))).alias("value"))
    return I.edited(_catalogue(table(spark, d, "embeddings")), edits.where("op is not null")).select("ord", "id", "source_path")


@query("""SELECT user_id, coalesce(arg_max(value, event_id) FILTER (event_type = 'view'), 0.5) AS threshold, coalesce(arg_max(CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END, event_id) FILTER (event_type = 'click') = 'on', false) AS armed,
coalesce(arg_max(CASE WHEN event_id % 3 = 0 THEN 'FIRST' ELSE 'DEFAULT' END, event_id) FILTER (event_type = 'purchase'), 'SKIP') AS policy, arg_max('s' || event_id, event_id) FILTER (event_type = 'error') AS "default" FROM events GROUP BY user_id""")
def catalogue_settings(spark: SparkSession, d: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    value = (F.when(t == "view", F.col("value").cast("string")).when(t == "click", F.when(i % 2 == 0, "on").otherwise("off"))
             .when(t == "purchase", F.when(i % 3 == 0, "FIRST").otherwise("DEFAULT")).otherwise(F.concat(F.lit("s"), i.cast("string"))))
    op = F.when(t == "view", "threshold").when(t == "click", "armed").when(t == "purchase", "unmatched").when(t == "error", "default")
    return I.settings_after(table(spark, d, "events").select("user_id", i.alias("seq"), op.alias("op"), value.alias("value")), "user_id")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, substr(sha1(label || '|' || vec_id), 1, 12) AS id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS c1, 1::BIGINT AS occurrences FROM e""")
def new_identities(spark: SparkSession, d: str) -> DataFrame:
    m = I.minted_identities(table(spark, d, "embeddings"), "embedding", [F.col("label"), F.col("vec_id")])
    return m.select("vec_id", "id", F.round(F.get("centroid", 0), 6).alias("c1"), "occurrences")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'O' THEN 'live' END ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'saved' END END AS map FROM orders""")
def map_of_task(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    r = I.map_of_task(i % 2 == 0, F.when(i % 3 > 0, "store"), F.when(F.col("o_orderstatus") == "O", "live"), F.when(i % 5 == 0, "saved"))
    return table(spark, d, "orders").select("o_orderkey", r.alias("map"))


@query(f"""WITH {_CAT}, both_ways AS (SELECT unnest([true, false]) AS multi), r AS (SELECT e.vec_id, h.source_path FROM e LEFT JOIN h ON h.vec_id = e.vec_id)
SELECT multi, vec_id, CASE WHEN NOT multi THEN 'one' WHEN source_path IN ('src1', 'src2') THEN source_path END AS source FROM both_ways, r""")
def routing_prepared(spark: SparkSession, d: str) -> DataFrame:
    """Sources without a face drop out; a model of one source only ignores the catalogue."""
    e = table(spark, d, "embeddings")
    routed = I.route(e, "vec_id", "embedding", _catalogue(e), 0.3).select("vec_id", "source")
    sources = spark.createDataFrame([("src0", 0), ("src1", 1), ("src2", 2)], "path string, faces int")
    both = [I.prepared(routed, sources, multi, "one").withColumn("multi", F.lit(multi)) for multi in (True, False)]
    return both[0].unionByName(both[1])


@query(f"""WITH {_CAT}, s1 AS (SELECT vec_id // 4 AS frame_index, vec_id % 4 AS pos, list_dot_product(q.v, c.centroid) AS sim FROM q, (SELECT centroid FROM cat WHERE ord = 3) c)
SELECT frame_index, arg_max(pos, (sim, -pos)) AS pos, round(max(sim), 5) AS sim FROM s1 GROUP BY frame_index HAVING max(sim) >= 0.1""")
def selected_face(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    faces = e.select(F.expr("vec_id div 4").alias("frame_index"), (F.col("vec_id") % 4).alias("pos"), V.normalize(F.col("embedding")).alias("v"))
    return I.best_face(faces, "frame_index", "pos", "v", _catalogue(e).where("ord = 3"), 0.1).withColumn("sim", F.round("sim", 5))


@query("SELECT user_id, count(*) AS faces, count(DISTINCT event_id // 4) AS frames FROM events GROUP BY user_id")
def geometry_coverage(spark: SparkSession, d: str) -> DataFrame:
    return D.coverage(table(spark, d, "events").withColumn("f", F.expr("event_id div 4")), "user_id", "f")


@query(f"WITH {_CAT}, f AS (SELECT label AS ord, min(vec_id) AS first_frame FROM embeddings WHERE label % 2 = 0 GROUP BY label) SELECT cat.ord, first_frame FROM cat LEFT JOIN f ON f.ord = cat.ord")
def representatives_attached(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    found = e.where("label % 2 = 0").groupBy(F.col("label").alias("ord")).agg(F.min("vec_id").alias("first_frame"))
    return I.finished(_catalogue(e), found, "ord").select("ord", "first_frame")


@query("SELECT event_id FROM events JOIN (SELECT user_id, max(event_id // 3) AS f FROM events WHERE event_type = 'view' GROUP BY user_id) s USING (user_id) WHERE event_id // 3 = f")
def stale_snapshots(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.expr("event_id div 3").alias("frame"))
    return D.same_snapshot(e, e.where("event_type = 'view'").groupBy("user_id").agg(F.max("frame").alias("frame")), "user_id", "frame").select("event_id")


@query("""SELECT vec_id, vec_id % 7 AS pos, [label::DOUBLE, 0.0, label + 4.0, 4.0] AS bbox, (vec_id % 10) / 10.0::DOUBLE AS det_score FROM embeddings""")
def display_fields(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("label").cast("double")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_index"), (F.col("vec_id") % 7).alias("pos"), F.array(x, F.lit(0.0), x + 4, F.lit(4.0)).alias("bbox"), (F.col("vec_id") % 10 / 10.0).alias("det_score"), "embedding")
    return D.display_fields(e).withColumnRenamed("frame_index", "vec_id")


@query("""SELECT c_custkey, CASE WHEN m <> 'AS_SOURCE' THEN m WHEN s IN ('M', 'F') THEN s ELSE 'BOTH' END AS sex FROM (SELECT c_custkey, ['M', 'F', 'BOTH', 'AS_SOURCE', 'AS_SOURCE'][c_custkey % 5 + 1] AS m, [NULL, 'M', 'F', 'x'][c_nationkey % 4 + 1] AS s FROM customer)""")
def resolved_sex(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, at: F.get(F.array(*[F.lit(x) for x in values]), at.cast("int"))
    m, s = pick(["M", "F", "BOTH", "AS_SOURCE", "AS_SOURCE"], F.col("c_custkey") % 5), pick([None, "M", "F", "x"], F.col("c_nationkey") % 4)
    return table(spark, d, "customer").select("c_custkey", R.resolved_sex(m, s).alias("sex"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' AND value / 50 >= 0.5 THEN value + 1 ELSE value END AS used FROM events")
def landmark_confidence(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", R.refined(v, F.when(F.col("event_type") != "error", v + 1), v / 50, F.lit(0.5)).alias("used"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(least(v[1], v[2] / 2, v[3] * 3), 6) AS first, round(list_sum(list_transform(range(1, 63), lambda i: least(v[i], v[i + 1] / 2, v[i + 2] * 3))), 5) AS total FROM e""")
def combined_masks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    m = D.combined([F.slice("v", 1, 62), F.transform(F.slice("v", 2, 62), lambda x: x / 2), F.transform(F.slice("v", 3, 62), lambda x: x * 3)])
    return e.select("vec_id", F.round(F.get(m, 0), 6).alias("first"), F.round(F.aggregate(m, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""WITH e AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x, unnest(range(1, 65)) AS i FROM embeddings),
s AS (SELECT vec_id, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS spread, median(x) FILTER (i BETWEEN 17 AND 48) AS mid FROM e GROUP BY vec_id)
SELECT vec_id, count_if(spread <= 1e-6 OR x <= mid + 0.1::DOUBLE * spread) AS visible FROM e JOIN s USING (vec_id) GROUP BY vec_id""")
def depth_visible(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    m = D.visible(F.col("v"), F.slice("v", 17, 32), 0.1)
    return e.select("vec_id", F.size(F.filter(m, lambda x: x == 1.0)).cast("long").alias("visible"))


_SIG = "c AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: substr('0123456789abcdef', (floor((x::DOUBLE > 0)::INT * 100 / 16))::INT + 1, 1)), '') AS sig, label FROM embeddings)"


@query(f"WITH {_SIG} SELECT vec_id, sig FROM c")
def content_signature(spark: SparkSession, d: str) -> DataFrame:
    luma = F.transform("embedding", lambda x: F.when(x > 0, 100).otherwise(0))
    return table(spark, d, "embeddings").select("vec_id", K.content_signature(luma).alias("sig"))


@query("WITH c AS (SELECT user_id, event_id, lower(hex(floor(value / 16)::BIGINT)) AS sig FROM events) SELECT event_id, min(event_id) OVER (PARTITION BY sig) AS mask FROM c")
def masks_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Work is done for one event of each grey level, and all of that level get its result."""
    e = table(spark, d, "events").select("event_id", "value")
    work = lambda one: one.select("_sig", F.col("event_id").alias("mask"))
    return T.by_content(e, K.content_signature(F.array("value")), work, "event_id").select("event_id", "mask")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x = 0 THEN x ELSE round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END) AS h FROM e)
SELECT vec_id, h[1] AS h1, h[4] AS h4, NULL::DOUBLE AS roll FROM s""")
def geometry_stored(spark: SparkSession, d: str) -> DataFrame:
    """All rows have a vector, not all a roll: vectors are stored in half precision, rolls aren't."""
    g = table(spark, d, "embeddings").withColumn("roll", F.when(F.col("vec_id") % 5 > 0, F.lit(1.0)))
    return D.stored(g).select("vec_id", F.get("embedding", 0).alias("h1"), F.get("embedding", 3).alias("h4"), "roll")


@query("SELECT vec_id AS frame_index, NULL::INT AS pos, 'p' || label AS identity_id, NULL::DOUBLE AS roll FROM embeddings")
def geometry_defaults(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_index"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("identity_id"), "embedding")
    return D.with_defaults(old).select("frame_index", "pos", "identity_id", "roll")


@query("""SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN value END, 1.0) AS det_score, CASE WHEN event_id % 3 > 0 THEN coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 5 = 0 THEN 7.0 END, 0.0) END AS roll FROM events""")
def mapped_metadata(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    known = F.when(i % 3 > 0, F.lit(2.0))
    m = R.shown_meta(F.when(F.col("event_type") != "error", v), F.lit("M"), F.lit(30), known, known, F.when(i % 5 == 0, F.lit(7.0)), F.when(i % 2 == 0, v))
    return table(spark, d, "events").select("event_id", m["det_score"].alias("det_score"), F.get(m["pose"], 2).alias("roll"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN p_size - 3 < 1 THEN 'detection_interval' END, CASE WHEN p_size * 4 < 64 THEN 'detection_size' END, CASE WHEN p_size * 2 > 90 THEN 'rotation_threshold_deg' END,
CASE WHEN p_size % 7 = 0 OR p_size / 40.0 > 1 THEN 'temporal_strength' END], lambda x: x IS NOT NULL)), ',') AS wrong FROM part""")
def parameter_bounds(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("p_size")
    w = R.out_of_bounds(detection_interval=z - 3, detection_size=z * 4, rotation_threshold_deg=z * 2, temporal_strength=F.when(z % 7 != 0, z / 40.0))
    return table(spark, d, "part").select("p_partkey", F.array_join(w, ",").alias("wrong"))


@query("SELECT p_partkey, p_type AS model, p_size AS upscale, p_size * 2 AS rotation_threshold_deg FROM part")
def task_parameters(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("enhancer_model"), F.col("p_size").alias("enhancer_upscale"), (F.col("p_size") * 2).alias("swapper_rotation_threshold_deg"))
    return t.select("p_partkey", R.parameters("enhancer", t.columns).alias("x")).select("p_partkey", "x.*")


_PATHS = "p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, '/in/' || page_id || '.x.mp4' AS t FROM pages)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u"), F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit(".x.mp4")).alias("t"))


@query(f"""WITH {_PATHS} SELECT page_id, substr(sha1(t), 1, 16) AS target, substr(sha256(u || '|' || t || '|png|scale=' || printf('%.4f', page_id % 4 / 4.0::DOUBLE) || '|swap|id' || page_id % 3 || '|up'), 1, 16) AS session,
'stage1-swap@8x4-' || substr(sha1(u || '|' || t || '|[(1, 2), (5, ' || page_id || ')]'), 1, 10) AS stage, substr(sha1(u || '|' || t || '|8x4|None'), 1, 12) AS chain, substr(sha256('3|' || u || '|' || page_id * 1000 || '|' || page_id || '|256'), 1, 24) AS thumbnail,
'5|yolo|640|1|' || printf('%.4f', page_id / 1024.0::DOUBLE) || '|[]' AS scan FROM p""")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    i, u, t = F.col("page_id"), F.col("u"), F.col("t")
    step = lambda n, x: F.struct(F.lit(n).alias("name"), x.alias("identity"))
    chain = F.array(step("swap", F.concat(F.lit("id"), (i % 3).cast("string"))), step("up", F.lit("")))
    r = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    ranges = K.pairs_text(F.array(r(F.lit(1), F.lit(2)), r(F.lit(5), i)))
    return p.select(
        "page_id", K.target_key(t).alias("target"), K.session_key(u, t, F.lit("png"), i % 4 / 4.0, chain).alias("session"),
        K.stage_folder(F.lit(1), F.lit("swap"), F.lit("8x4"), u, t, ranges).alias("stage"), K.chain_fingerprint(u, t, F.lit("8x4"), F.lit(None)).alias("chain"),
        K.thumbnail_key(F.lit(3), u, i * 1000, i, F.lit(256)).alias("thumbnail"),
        K.scan_signature(F.lit(5), F.lit("yolo"), F.lit(640), F.lit(True), i / 1024.0, F.lit("[]")).alias("scan"))


@query(f"""WITH {_PATHS} SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/own' ELSE (CASE WHEN page_id % 2 = 0 THEN '/out' ELSE '/in' END) || '/face+' || page_id || '.x' || CASE WHEN page_id % 3 > 0 THEN '.mp4' ELSE '' END END AS path,
'/maps/' || substr(sha1(t), 1, 16) || '.geometry.npz' AS geometry FROM p""")
def output_names(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    p = K.output_path(F.when(i % 5 == 0, "/own"), F.when(i % 2 == 0, "/out"), F.lit("/src/face.png"), F.col("t"), i % 3 > 0)
    return _pages(spark, d).select("page_id", p.alias("path"), K.sidecar(F.lit("/maps"), F.col("t"), "geometry").alias("geometry"))


@query("""WITH p AS (SELECT page_id, (['abc', 'a/b', 'a\\b', '..', 'x..y', '0f3'])[page_id % 6 + 1] || page_id AS id, page_id % 7 AS k FROM pages)
SELECT page_id, page_id % 6 IN (0, 5) AS valid, k = 0 AS inside FROM p""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    pick = lambda values: F.concat(F.get(F.array(*[F.lit(x) for x in values]), (i % len(values)).cast("int")), i.cast("string"))
    return table(spark, d, "pages").select("page_id", K.valid_id(pick(["abc", "a/b", "a\\b", "..", "x..y", "0f3"])).alias("valid"), K.inside(F.when(i % 7 == 6, "/c//").when(i % 7 == 5, "/c").otherwise(pick(["/c/x", "/c/../", "/d/", "/cc/", "/c/./", "", ""])), F.lit("/c")).alias("inside"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 3 THEN event_id END AS frame FROM events""")
def progress_lines(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    line = F.get(F.array(F.concat(F.lit("frame="), i), F.concat(F.lit("fps="), i), F.concat(F.lit("frame=N"), i), F.concat(F.lit("frame=  "), i, F.lit(" "))), (F.col("event_id") % 4).cast("int"))
    return table(spark, d, "events").select("event_id", K.progress_frame(line).alias("frame"))


@query("""SELECT c_custkey, c_name AS name, 'v' || c_custkey AS driver, CASE c_custkey % 3 WHEN 0 THEN '8.6' END AS capability FROM customer WHERE c_custkey % 5 > 0""")
def gpu_rows(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    end = F.when(i % 3 == 0, ", 8.6").when(i % 3 == 1, ", [N/A]").otherwise("")
    line = F.concat(F.when(i % 5 == 0, " ").otherwise(F.col("c_name")), F.lit(" , v"), i.cast("string"), end)
    return table(spark, d, "customer").select("c_custkey", K.gpu_row(line).alias("g")).where("g is not null").select("c_custkey", "g.*")


@query("""WITH p AS (SELECT p_partkey, p_size, (['30/1', '30000/1001', 'x', '25/0', '24'])[p_partkey % 5 + 1] AS r FROM part), f AS (SELECT *, CASE r WHEN '30000/1001' THEN 30000 / 1001::DOUBLE WHEN '24' THEN 24.0 ELSE 30.0 END AS fps FROM p)
SELECT p_partkey, round(fps, 9) AS fps, CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN floor((p_size || '.5')::DOUBLE * fps) ELSE 0 END::BIGINT AS frame_count FROM f""")
def stream_probe(spark: SparkSession, d: str) -> DataFrame:
    i, z = F.col("p_partkey"), F.col("p_size").cast("string")
    rate = F.get(F.array(*[F.lit(x) for x in ("30/1", "30000/1001", "x", "25/0", "24")]), (i % 5).cast("int"))
    p = K.stream_probe(rate, F.when(i % 3 == 0, z).when(i % 3 == 1, "N/A"), F.when(i % 3 == 1, F.concat(z, F.lit(".5"))))
    return table(spark, d, "part").select("p_partkey", F.round(p["fps"], 9).alias("fps"), p["frame_count"].alias("frame_count"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'none' WHEN p_partkey % 3 > 0 THEN 'cut' WHEN p_partkey % 2 = 0 THEN 'copy' ELSE 'encode' END AS mode, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 3 > 0 THEN
'[1:a]atrim=start=' || printf('%.6f', p_size / 8.0::DOUBLE) || ':end=' || printf('%.6f', p_size / 4.0::DOUBLE) || ',asetpts=PTS-STARTPTS[a0];[a0]concat=n=1:v=0:a=1[outa]' END AS filter FROM part""")
def audio_plan(spark: SparkSession, d: str) -> DataFrame:
    i, z = F.col("p_partkey"), F.col("p_size")
    seg = F.when(i % 3 > 0, F.array(F.struct((z / 8.0).alias("from_s"), (z / 4.0).alias("to_s"))))
    a = K.audio_plan(i % 7 > 0, seg, i % 2 == 0)
    return table(spark, d, "part").select("p_partkey", a["mode"].alias("mode"), a["filter"].alias("filter"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS newer FROM part""")
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey").cast("string")
    pick = lambda *v: F.get(F.array(*v), (F.col("p_partkey") % 5).cast("int"))
    a = pick(F.concat(F.lit("1."), i), F.concat(F.lit("v2.0."), i), F.lit("1.10"), F.lit("1.0.0"), F.lit("rc"))
    b = pick(F.concat(F.lit("1."), i, F.lit(".0")), F.lit("1.9999"), F.lit("1.9"), F.lit("1"), F.lit("0.1"))
    return table(spark, d, "part").select("p_partkey", S.is_newer(a, b).alias("newer"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round((v[37] + v[38] + v[39] + v[40] + v[41] + v[42]) / 6, 6) AS left_x, round(v[31] * 2, 6) AS nose_y, round(least(1.0, greatest(0.0, v[1] / 0.9::DOUBLE)), 6) AS score FROM e""")
def landmarks_five(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.col("embedding").cast("array<double>"), F.array(*[F.lit(0.0)] * 4))
    points = F.transform(v, lambda x: F.struct(x.alias("x"), (x * 2).alias("y")))
    e = table(spark, d, "embeddings").select("vec_id", V.landmark_five(points).alias("p"), F.get("embedding", 0).cast("double").alias("peak"))
    return e.select("vec_id", F.round(F.get("p", 0)["x"], 6).alias("left_x"), F.round(F.get("p", 2)["y"], 6).alias("nose_y"), F.round(V.interpolate(F.col("peak"), 0.0, 0.9, 0.0, 1.0), 6).alias("score"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value + 1 END, CASE WHEN event_id % 2 = 0 THEN value + 2 END, CASE WHEN event_id % 5 = 0 THEN value + 3 END, 0.0) AS roll,
greatest(32, event_id % 700 - event_id % 700 % 32) AS det_size, CASE WHEN event_id % 3 = 2 THEN value END AS yaw, CASE WHEN event_id % 3 > 0 THEN value END AS box_y FROM events""")
def roll_pose_box(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    raw = F.slice(F.array(v, v, v, v, v), 1, (i % 3 * 2 + 1).cast("int"))  # 1, 3 or 5 numbers
    some = F.slice(F.array(v, v, v, v, v), 1, (i % 3 * 2 + F.when(i % 3 == 1, 1).otherwise(0)).cast("int"))  # 0, 3 or 4
    roll = V.compute_roll(F.when(i % 4 == 0, v), F.when(i % 3 == 0, v + 1), F.when(i % 2 == 0, v + 2), F.when(i % 5 == 0, v + 3))
    pose = V.pose3(F.when(i % 3 == 2, raw))
    return table(spark, d, "events").select("event_id", roll.alias("roll"), S.det_size(i % 700).alias("det_size"), pose["yaw"].alias("yaw"), F.get(V.bbox4(F.when(i % 3 > 0, F.array_repeat(v, 5)).otherwise(some)), 1).alias("box_y"))
