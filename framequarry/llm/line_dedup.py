"""Line dedup by the number of distinct sites that show a line.

Every line with a word is hashed; HyperLogLog sketches of its sites merge in one aggregation. Where the estimate is
well above or below the threshold it decides; lines near it are counted exactly. Lines of enough sites are boilerplate
and go from every document but the first that shows them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_SITES, LG_K = 5, 12
#: Estimates within this share of the threshold (one site at least) are counted exactly; it is over six standard errors.
NEAR = 0.1


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """k1, k2 (of the document), doc_id, site, line_no (from 0), h1, h2 (of the line), for each line with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.col(site).cast("string").alias("site"), text.alias("text"))
    d = d.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2"), "doc_id", "site",
                 F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        "k1", "k2", "doc_id", "site", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first (doc_id and line_no that keep the line) of each line that at least `min_sites` sites show."""
    sketched = common.written(
        lines.groupBy("h1", "h2").agg(
            F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"),
            F.min(F.struct("doc_id", "line_no")).alias("first"))
        .where(F.col("n") >= min_sites)
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    slack = max(1.0, NEAR * min_sites)
    sure = sketched.where(F.col("sites") > min_sites + slack)
    near = sketched.where(F.abs(F.col("sites") - min_sites) <= slack)
    # one row for each near line and site before sites are counted, so that a frequent line is no large group
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").where("site is not null").select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    return sure.select("h1", "h2", "first").unionAll(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """The columns of `docs` with lines removed from `text`, `n_chars` counted anew, and `n_lines` and `n_removed`.

    Lines are the parts between newlines; parts without a word stay and count as no lines. A null site is no site; a
    null text stays null; texts may become empty but rows stay; repeated rows (equal id and text) keep the same lines;
    `n_lines` and `n_removed` of `docs` are replaced; an empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = lines_of(docs, site)
    bad = boilerplate(lines, min_sites)
    gone = lines.join(bad, ["h1", "h2"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))))
    gone = gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("line_no")).alias("dedup_gone"))
    # the row travels as one column, so that its names never meet those used here
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    d = docs.select(F.struct(*own).alias("doc"))
    d = d.select("doc", F.xxhash64("doc.doc_id", text).alias("k1"), F.xxhash64(text, F.lit(7), "doc.doc_id").alias("k2"))
    d = d.join(gone, ["k1", "k2"], "left").withColumn("dedup_lines", F.split(text, "\n"))
    # the lines between each two removed ones, so that the work grows with the lines and not with their square
    start = lambda k: F.coalesce(F.get("dedup_gone", k - 1) + 1, F.lit(0))
    end = lambda k: F.coalesce(F.get("dedup_gone", k), F.size("dedup_lines"))
    stay = F.flatten(F.transform(F.sequence(F.lit(0), F.size("dedup_gone")), lambda k: F.slice("dedup_lines", start(k) + 1, end(k) - start(k))))
    new = F.when(F.col("dedup_gone").isNull(), F.col("doc.text")).otherwise(F.array_join(stay, "\n"))
    count = F.size(F.filter("dedup_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("dedup_text", new)
    changed = {"text": F.col("dedup_text"), "n_chars": F.length("dedup_text").cast("long")}
    return d.select(
        *[changed.get(c, F.col("doc")[c]).alias(c) for c in own],
        count.cast("long").alias("n_lines"), F.coalesce(F.size("dedup_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(common.documents(spark, sf_dir))
