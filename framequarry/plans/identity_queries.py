"""Queries over detections with vectors: the `embeddings` table, vec_id being the frame and label the true identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import detections as D
from ..operators import identities as I
from ..session import table
from .registry import registry

QUERIES, ORACLES, query = registry()
T = 0.3


def _catalogue(e: DataFrame) -> DataFrame:
    c = I.centroids(e, "label", "embedding", 64)
    src = F.when(F.col("label") % 3 != 0, F.concat(F.lit("src"), (F.col("label") % 4).cast("string")))
    return c.select(F.col("label").cast("int").alias("ord"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("id"), "centroid", src.alias("source_path"), F.col("n").alias("occurrences"))


_CAT = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY label, i),
m AS (SELECT label, list(m ORDER BY i) AS mean FROM u GROUP BY label),
cat AS (SELECT label::INT AS ord, 'p' || label AS id, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) AS centroid,
  CASE WHEN label % 3 <> 0 THEN 'src' || (label % 4) END AS source_path, (SELECT count(*) FROM e WHERE e.label = m.label) AS occurrences FROM m),
q AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
s AS (SELECT vec_id, ord, id, source_path, list_dot_product(q.v, centroid) AS sim FROM q, cat),
b AS (SELECT vec_id, arg_max(struct_pack(id, source_path, sim), (sim, -ord)) AS b FROM s GROUP BY vec_id),
h AS (SELECT vec_id, b.id AS id, b.source_path AS source_path, b.sim AS sim FROM b WHERE b.sim >= 0.3)"""


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM e""")
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = V.normalize(F.col("embedding"))
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(n, 0), 6).alias("first"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query(f"WITH {_CAT} SELECT ord, id, occurrences, round(centroid[1], 6) AS c1, round(centroid[64], 6) AS c64 FROM cat")
def identity_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = _catalogue(table(spark, d, "embeddings"))
    return c.select("ord", "id", "occurrences", F.round(F.get("centroid", 0), 6).alias("c1"), F.round(F.get("centroid", 63), 6).alias("c64"))


@query(f"WITH {_CAT} SELECT vec_id, id, round(sim, 5) AS sim FROM h")
def nearest_identity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return I.best_match(e, "vec_id", "embedding", _catalogue(e), T).select("vec_id", "id", F.round("sim", 5).alias("sim"))


@query(f"""WITH {_CAT}, r AS (SELECT vec_id, ord, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ord) AS rank FROM s)
SELECT vec_id, rank::INT AS rank, ord, round(sim, 5) AS sim FROM r WHERE rank <= 3""")
def nearest_identity_top_k(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return I.scores(e, "vec_id", "embedding", _catalogue(e), 3).withColumn("sim", F.round("sim", 5))


def _routed(policy: str):
    other = {"SKIP": "NULL", "DEFAULT": "'extra'", "FIRST": "(SELECT source_path FROM cat WHERE source_path IS NOT NULL ORDER BY ord LIMIT 1)"}[policy]

    def f(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "embeddings")
        return I.route(e, "vec_id", "embedding", _catalogue(e), T, policy, "extra").groupBy("id", "source").agg(F.count("*").alias("n"))

    f.__name__ = f"route_{policy.lower()}"
    query(f"""WITH {_CAT}, r AS (SELECT h.id, CASE WHEN h.vec_id IS NOT NULL THEN h.source_path ELSE {other} END AS source
FROM e LEFT JOIN h USING (vec_id)) SELECT id, source, count(*) AS n FROM r GROUP BY id, source""")(f)


for _p in ("SKIP", "DEFAULT", "FIRST"):
    _routed(_p)


@query(f"WITH {_CAT} SELECT source_path, min(ord)::BIGINT AS ord FROM cat WHERE source_path IS NOT NULL GROUP BY source_path UNION ALL SELECT 'extra', 4611686018427387904")
def assigned_sources(spark: SparkSession, d: str) -> DataFrame:
    return I.assigned_sources(_catalogue(table(spark, d, "embeddings")), "extra")


@query(f"WITH {_CAT} SELECT bool_or(source_path IS NOT NULL) AS active FROM cat")
def routing_active(spark: SparkSession, d: str) -> DataFrame:
    return I.is_active(_catalogue(table(spark, d, "embeddings")))


@query("""SELECT user_id, max(value) AS best_score, arg_max(event_id, (value, -event_id)) AS best_frame, min(event_id) AS first_frame, count(*) AS occurrences,
arg_max(event_type, (value, -event_id)) AS event_type, arg_min(event_type, event_id) AS first_event_type FROM events GROUP BY user_id""")
def identity_representative(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("pos", F.lit(0))
    return I.representative(e, "user_id", "value", "event_id", "pos", ("event_type",))


@query("SELECT user_id, min(event_id) AS first_frame, arg_min(value, event_id) AS first_value FROM events GROUP BY user_id")
def identity_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_frame"), F.min_by("value", "event_id").alias("first_value"))


_MORE = """, c2 AS (SELECT cat.*, f.first_frame, f.ref_frame, f.det_score FROM cat JOIN (SELECT label, min(vec_id) AS first_frame, arg_max(vec_id, (round(v[1], 6), -vec_id)) AS ref_frame,
max(round(v[1], 6)) AS det_score FROM e GROUP BY label) f ON f.label = cat.ord)"""


@query(f"""WITH {_CAT}{_MORE}, g AS (SELECT *, CASE WHEN ord % 5 < 4 THEN 'g' || (ord % 5) ELSE id END AS grp, -ord AS pos, 'box' || first_frame AS first_bbox, CASE WHEN ord % 2 = 0 THEN 'M' END AS sex FROM c2),
w AS (SELECT grp, i, sum(centroid[i] * occurrences) AS x FROM (SELECT grp, centroid, occurrences, unnest(range(1, 65)) AS i FROM g) GROUP BY grp, i),
n AS (SELECT grp, list(x ORDER BY i) AS x FROM w GROUP BY grp)
SELECT arg_min(ord, pos)::INT AS ord, arg_min(id, pos) AS id, sum(occurrences)::BIGINT AS occurrences, arg_min(source_path, pos) FILTER (source_path IS NOT NULL) AS source_path, min(first_frame) AS first_frame,
arg_min(first_bbox, (first_frame, pos)) AS first_bbox, arg_max(ref_frame, (det_score, -pos)) AS ref_frame, arg_max([sex], (det_score, -pos))[1] AS sex, max(det_score) AS det_score,
round(any_value(n.x[1] / sqrt(list_dot_product(n.x, n.x))), 6) AS c1 FROM g JOIN n USING (grp) GROUP BY grp""")
def merge_identities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    score = F.round(F.get("embedding", 0).cast("double"), 6)
    f = e.groupBy(F.col("label").cast("int").alias("ord")).agg(F.min("vec_id").alias("first_frame"), F.max(score).alias("det_score"), F.max_by("vec_id", F.struct(score, -F.col("vec_id"))).alias("ref_frame"))
    c = _catalogue(e).join(f, "ord").withColumn("first_bbox", F.concat(F.lit("box"), "first_frame")).withColumn("sex", F.when(F.col("ord") % 2 == 0, "M"))
    groups = c.where("ord % 5 < 4").select("id", (F.col("ord") % 5).alias("grp"), (-F.col("ord")).alias("pos"))
    return I.merge(c, groups, 64).select("ord", "id", "occurrences", "source_path", "first_frame", "first_bbox", "ref_frame", "sex", "det_score", F.round(F.get("centroid", 0), 6).alias("c1"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT label, vec_id % 2 AS odd, i, avg(v[i]) AS m FROM (SELECT label, vec_id, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL),
m AS (SELECT label, odd, list(m ORDER BY i) AS mean FROM u GROUP BY label, odd),
c AS (SELECT label AS ord, odd, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) AS centroid FROM m),
s AS (SELECT a.ord, arg_max(b.ord, (list_dot_product(a.centroid, b.centroid), -b.ord)) AS old, max(list_dot_product(a.centroid, b.centroid)) AS sim FROM c a, c b WHERE a.odd = 1 AND b.odd = 0 GROUP BY a.ord)
SELECT ord::INT AS ord, CASE WHEN sim >= 0.3 AND old % 3 <> 0 THEN 'src' || (old % 4) END AS source_path FROM s""")
def carry_over_assignments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    old, fresh = _catalogue(e.where("vec_id % 2 = 0")), _catalogue(e.where("vec_id % 2 = 1")).withColumn("source_path", F.lit(None).cast("string"))
    return I.carry_over(fresh, old, T).select("ord", "source_path")


def _detections(e: DataFrame) -> DataFrame:
    """Boxes and keypoints by rule: every seventh has four keypoints, every eleventh a short box."""
    k = F.when(F.col("vec_id") % 7 == 0, 4).otherwise(5)
    x = (F.col("vec_id") % 50).cast("double")
    box = F.array(x, x, x + 10, x + 20)
    return e.select("vec_id", (F.col("vec_id") % 200).alias("frame_index"), "embedding", F.sequence(F.lit(1), k).alias("kps"),
                    F.when(F.col("vec_id") % 11 == 0, F.slice(box, 1, 3)).otherwise(box).alias("bbox"))


@query(f"WITH {_CAT} SELECT vec_id, (vec_id % 200) AS frame_index, id AS identity_id, round(sim, 5) AS sim FROM h WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0")
def bake_geometry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return D.bake(_detections(e), "vec_id", "embedding", _catalogue(e), 0.5).select("vec_id", "frame_index", "identity_id", F.round("sim", 5).alias("sim"))


@query("""WITH f AS (SELECT DISTINCT vec_id // 2 AS frame_index FROM embeddings), l AS (SELECT vec_id // 2 AS frame_index, vec_id, label FROM embeddings),
g AS (SELECT frame_index, vec_id FROM l WHERE label % 2 = 0)
SELECT frame_index, vec_id, true AS baked FROM f JOIN g USING (frame_index) UNION ALL
SELECT frame_index, vec_id, false FROM f JOIN l USING (frame_index) WHERE frame_index NOT IN (SELECT frame_index FROM g)""")
def geometry_lookup_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Two vectors a frame; those of every other label are baked, all are found live."""
    live = table(spark, d, "embeddings").select(F.expr("vec_id div 2").alias("frame_index"), "vec_id", "label")
    return D.lookup(live.select("frame_index").distinct(), live.where("label % 2 = 0").drop("label"), live.drop("label"))


_BOX = "SELECT event_id, event_id // 4 AS frame_index, event_id % 4 AS pos, (event_id * 37 % 100)::DOUBLE AS x, (event_id * 53 % 80)::DOUBLE AS y, value FROM events"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    x, y = (i * 37 % 100).cast("double"), (i * 53 % 80).cast("double")
    return table(spark, d, "events").select("event_id", F.expr("event_id div 4").alias("frame_index"), (i % 4).alias("pos"), F.array(x, y, x + 30, y + 40).alias("bbox"), "value")


@query(f"""WITH b AS ({_BOX}), r AS (SELECT *, (x + 15 - 50) ** 2 + (y + 20 - 40) ** 2 AS d FROM b)
SELECT frame_index, arg_min(pos, (d, pos)) AS pos, min(d)::DOUBLE AS distance2 FROM r GROUP BY frame_index""")
def nearest_box(spark: SparkSession, d: str) -> DataFrame:
    return D.nearest_box(_boxes(spark, d), "frame_index", "pos", "bbox", F.lit(50.0), F.lit(40.0)).drop("bbox")


@query(f"WITH b AS ({_BOX}) SELECT frame_index, min(pos) AS pos FROM b WHERE 50 BETWEEN x AND x + 30 AND 40 BETWEEN y AND y + 40 GROUP BY frame_index")
def box_hit_test(spark: SparkSession, d: str) -> DataFrame:
    return D.hit_test(_boxes(spark, d), "frame_index", "pos", "bbox", F.lit(50.0), F.lit(40.0))


@query(f"WITH b AS ({_BOX}) SELECT frame_index, min(pos) AS pos, arg_min(value, pos) AS value FROM b WHERE value > 50 GROUP BY frame_index")
def first_qualifying_face(spark: SparkSession, d: str) -> DataFrame:
    return D.first_only(_boxes(spark, d), "frame_index", "pos", F.col("value") > 50, False).select("frame_index", "pos", "value")


@query(f"WITH b AS ({_BOX}) SELECT event_id, x * (1280.0 / 640) AS x1, CASE WHEN event_id % 2 = 0 THEN x + 30 ELSE (x + 30) * (1280.0 / 640) END AS x2 FROM b")
def rescale_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    whole = V.rescale(F.col("bbox"), F.lit(1280.0), F.lit(640.0))
    other = V.rescale(F.col("bbox"), F.lit(1280.0), F.when(F.col("event_id") % 2 == 0, F.lit(1280.0)).otherwise(F.lit(640.0)))
    return b.select("event_id", F.get(whole, 0).alias("x1"), F.get(other, 2).alias("x2"))


@query("""SELECT c_custkey, mode, CASE WHEN mode IN ('B', 'I') THEN true ELSE coalesce(mode = sex, false) END AS matches FROM (
SELECT c_custkey, ['B', 'I', 'M', 'F'][c_custkey % 4 + 1] AS mode, CASE c_nationkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sex FROM customer)""")
def demographic_filter(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.scalars import sex_matches

    c = table(spark, d, "customer")
    mode = F.get(F.array(*[F.lit(x) for x in "BIMF"]), (F.col("c_custkey") % 4).cast("int"))
    sex = F.when(F.col("c_nationkey") % 3 == 0, "M").when(F.col("c_nationkey") % 3 == 1, "F")
    return c.select("c_custkey", mode.alias("mode"), sex_matches(mode, sex).alias("matches"))


@query(f"WITH b AS ({_BOX}) SELECT event_id, round(degrees(atan2(y - 40, x - 50)), 6) AS roll, abs(degrees(atan2(y - 40, x - 50))) >= 30 AS turned FROM b")
def roll_angle_gate(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    r = V.roll_of_eyes(F.lit(50.0), F.lit(40.0), F.get("bbox", 0), F.get("bbox", 1))
    return b.select("event_id", F.round(r, 6).alias("roll"), (F.abs(r) >= 30).alias("turned"))


@query("""WITH p AS (SELECT p_partkey, (p_size * 37 + 101)::INT AS w, (p_size * 23 + 51)::INT AS h, (p_partkey % 20 + 1) / 16.0::DOUBLE AS s FROM part),
r AS (SELECT *, round_even(w * s, 0)::INT AS rw, round_even(h * s, 0)::INT AS rh FROM p)
SELECT p_partkey, CASE WHEN s >= 1 THEN w ELSE greatest(rw - rw % 2, 2) END AS width, CASE WHEN s >= 1 THEN h ELSE greatest(rh - rh % 2, 2) END AS height FROM r""")
def scaled_dims(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    w, h, s = (F.col("p_size") * 37 + 101).cast("int"), (F.col("p_size") * 23 + 51).cast("int"), (F.col("p_partkey") % 20 + 1) / F.lit(16.0)
    r = V.scaled_dims(w, h, s)
    return p.select("p_partkey", r["width"].alias("width"), r["height"].alias("height"))


@query()
def online_clustering(spark: SparkSession, d: str) -> DataFrame:
    """Targets of a hundred vectors each, in order of their ids. Held against plain Python in the tests."""
    e = table(spark, d, "embeddings").withColumn("target", F.expr("vec_id div 100")).withColumn("pos", F.lit(0))
    return I.online_clusters(e, "target", "vec_id", "pos", "embedding", 0.1).drop("pos")


@query(f"""WITH RECURSIVE b AS ({_BOX}), r AS (SELECT *, value / (value + 20) AS score, row_number() OVER (PARTITION BY frame_index ORDER BY value / (value + 20) DESC, pos) AS n FROM b WHERE value / (value + 20) >= 0.5),
k AS (SELECT frame_index, 0::BIGINT AS n, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept, NULL::BIGINT AS event_id FROM (SELECT DISTINCT frame_index FROM r)
UNION ALL SELECT frame_index, n, CASE WHEN hit THEN kept ELSE list_append(kept, {{'x': x, 'y': y}}) END, CASE WHEN NOT hit THEN event_id END FROM (
 SELECT r.frame_index, r.n, r.x, r.y, r.event_id, k.kept, len(list_filter(k.kept, lambda o: greatest(0, 30 - abs(o.x - r.x)) * greatest(0, 40 - abs(o.y - r.y)) > 0.4::DOUBLE * (2400 - greatest(0, 30 - abs(o.x - r.x)) * greatest(0, 40 - abs(o.y - r.y))))) > 0 AS hit
 FROM k JOIN r ON r.frame_index = k.frame_index AND r.n = k.n + 1))
SELECT event_id, frame_index FROM k WHERE event_id IS NOT NULL""")
def suppress_overlaps(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumn("score", F.col("value") / (F.col("value") + 20))
    return D.suppress(b, "frame_index", "bbox", "score", ties=("pos",)).select("event_id", "frame_index")
