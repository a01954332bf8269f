"""Quality rules with thresholds that follow the data.

Each document gets counts; each rule is a ratio of two counts, as an integer. Ratios go into log-linear integer
histograms per (lang, source, rule): quantile sketches that merge by adding counts and err by at most 1/32 of a value.
The threshold of a group is its upper quartile plus `reach` times the distance between quartiles, at least the
rule's own spread. Quartiles are those of the group's own sketch with its language's added, scaled to the weight of
`prior` documents: one rule for groups of every size, by which small groups lean on their language and large ones
don't. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: rule: (numerator, denominator, scale, least spread in scaled units)
RULES = {
    "symbols": ("n_symbols", "word_chars", 10000, 50),
    "bangs": ("n_bangs", "word_chars", 10000, 100),
    "capitals": ("n_capitals", "word_chars", 10000, 400),
    "echoes": ("n_echoes", "n_words", 10000, 300),
}
REACH = 3
#: Documents that a language's sketch weighs beside the own sketch of each of its groups. Counts are kept in units of
#: 1 / WEIGHT document, so that all sums are whole numbers.
PRIOR, WEIGHT = 50, 1000
#: A language's sketch has some hundred buckets a rule; sketches of languages are broadcast up to so many rows.
MAX_BROADCAST_BUCKETS = 500_000
#: Log-linear buckets: values under 64 are exact, above that 32 buckets for each power of two.
SUB = 5
#: Thresholds are broadcast only up to this many groups (rows of four longs).
MAX_BROADCAST_GROUPS = 100_000


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    without = lambda chars: F.length(F.col("text")) - F.length(F.regexp_replace("text", f"[{chars}]+", ""))
    d = docs.select("doc_id", "lang", "source", text.alias("text"))
    d = d.select(
        "doc_id", "lang", "source", common.words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        without(r"#*$%&|<>").cast("long").alias("n_symbols"),
        without("!").cast("long").alias("n_bangs"),
        without("A-Z").cast("long").alias("n_capitals"),
    )
    w = F.col("w")
    gram = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])
    d = d.select(
        "*",
        F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), gram))
        .otherwise(F.array().cast("array<bigint>")).alias("grams"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_echoes"),
    )
    # windows that may occur twice: equal hashes; their words decide
    d = d.withColumn("again", F.size(F.array_distinct("grams")) < F.size("grams"))
    window = lambda i: F.concat_ws(" ", F.slice(w, i + 1, 5))
    d = d.withColumn("sorted", F.when(F.col("again"), F.array_sort(F.transform(
        "grams", lambda h, i: F.struct(h.alias("h"), window(i).alias("s"), i.alias("i"))))))
    s = F.col("sorted")
    twin = lambda x, k: (F.get(s, k)["h"] == x["h"]) & (F.get(s, k)["s"] == x["s"])
    hits = F.filter(s, lambda x, k: F.coalesce(twin(x, k - 1), F.lit(False)) | F.coalesce(twin(x, k + 1), F.lit(False)))
    d = d.withColumn("at", F.array_sort(F.transform(hits, lambda x: x["i"])))
    grown = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"].cast("long"),
    )
    return d.select(
        "doc_id", "lang", "source",
        size(w).alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), "n_symbols",
        (size(F.col("lines")) - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(grown, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_bangs", "n_capitals", "n_echoes",
    )


def ratio(rule: str) -> Column:
    a, b, scale, _ = RULES[rule]
    return F.expr(f"({scale} * {a}) div greatest({b}, 1L)")


def bucket(v: Column) -> Column:
    """Log-linear bucket of a non-negative integer."""
    shift = F.greatest(F.length(F.bin(v)) - (SUB + 1), F.lit(0))
    return F.when(v < 2 ** (SUB + 1), v).otherwise(
        shift.cast("long") * 2**SUB + F.floor(v / F.pow(F.lit(2.0), shift)).cast("long"))


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.floor(b / 2**SUB) - 1
    return F.when(b < 2 ** (SUB + 1), b).otherwise(
        ((b - shift * 2**SUB + 1) * F.pow(F.lit(2.0), shift)).cast("long") - 1)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): one mergeable histogram for each group and rule; rows without words don't count."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), bucket(ratio(r)).alias("bucket")) for r in RULES])
    return (
        counts.where("n_words > 0").select("lang", "source", F.explode(rules).alias("x"))
        .groupBy("lang", "source", F.col("x.rule").alias("rule"), F.col("x.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of larger groups: counts of equal buckets added."""
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartile(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, rule, total, q1, q3 (upper ends of their buckets), from the sketches alone."""
    from pyspark.sql import Window as W

    by = W.partitionBy(*keys, "rule")
    run = sketch.withColumn("up_to", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    at = lambda num: F.min(F.when(F.col("up_to") * 4 >= F.col("total") * num, F.col("bucket")))
    return run.groupBy(*keys, "rule").agg(
        F.max("total").alias("total"), bucket_top(at(1)).alias("q1"), bucket_top(at(3)).alias("q3"))


def leaning(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The sketches of (lang, source), each with its language's added, which counts as `prior` documents."""
    from pyspark.sql import Window as W

    lang = merged(sketch, "lang").withColumn("total", F.sum("n").over(W.partitionBy("lang", "rule")))
    lang = lang.select(F.col("lang").alias("l"), "rule", "bucket", F.expr(f"({prior * WEIGHT}L * n) div total").alias("n"))
    far = sketch.select("lang", "source").distinct().join(
        common.small(lang, MAX_BROADCAST_BUCKETS), F.col("lang").eqNullSafe(F.col("l"))).select("lang", "source", "rule", "bucket", "n")
    return merged(sketch.withColumn("n", F.col("n") * WEIGHT).unionByName(far), "lang", "source")


def limits(sketch: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """lang, source and the highest allowed value of each rule (null-safe keys)."""
    spread = F.create_map(*[x for r in RULES for x in (F.lit(r), F.lit(RULES[r][3]))])
    high = F.col("q3") + reach * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("rule")])
    t = quartile(leaning(sketch, prior), "lang", "source").select("lang", "source", "rule", high.alias("limit"))
    return t.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("limit"))).alias(f"max_{r}") for r in RULES])


def quality_rules(docs: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """Counts, group thresholds and verdict of every document.

    Null texts count as empty; empty texts fail the base rule; null lang or source form groups of their own; repeated
    rows each get a row and each count in the sketches; an empty table gives an empty result; further columns of
    `docs` are ignored.
    """
    counts = common.written(counted(docs))
    t = common.small(
        limits(common.written(sketches(counts)), prior, reach).select(
            F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"max_{r}" for r in RULES]),
        MAX_BROADCAST_GROUPS)
    j = counts.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.lit(True)
    for r in RULES:
        within = within & (ratio(r) <= F.coalesce(F.col(f"max_{r}"), F.lit(2**62)))
    return j.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(within).alias("kept"),
        *[ratio(r).alias(f"{r}_ratio") for r in RULES], *[f"max_{r}" for r in RULES])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.documents(spark, sf_dir))
