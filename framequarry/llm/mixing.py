"""Mixing sources to target weights by Poisson replication.

A source with n documents and weight w gets the mean repetition rate w / sum(w) * total / n. Each document's count is
the inverse Poisson distribution at a number in [0, 1) hashed from its id, its text, its number among equal rows and
the seed; it is repeated so often, and all rows go to places given by a hash of the row, that number, copy and seed.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 20
#: Rates above this are drawn as sums of equal smaller ones, so that exp(-rate) stays far from 0.
MOST_RATE = 32.0
#: Rates are broadcast up to this many sources; beyond it the join shuffles and adaptive execution splits hot sources.
MAX_BROADCAST_SOURCES = 100_000
#: Equal rows are numbered in blocks of so many, which may go to different tasks.
NUMBER_BLOCK = 10_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1), a multiple of 2**-48, from the md5 of the parts; nulls count as the word null."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array, so long that what lies beyond is under 2**-60."""
    n = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc, k):
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.array_append(acc["all"], c).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None) -> DataFrame:
    """source, rate, draws, cdf: one row for each source. Sources without a weight get none, unless no weights are given."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = F.lit(1.0)
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in kv]
        w = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("w", w.cast("double"))
    sums = sizes.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    goal = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    r = sizes.crossJoin(F.broadcast(sums)).select(  # one row beside each source
        F.col("source").alias("mix_source"),
        F.coalesce(F.try_divide(F.col("w") * goal, F.col("all_w") * F.col("n")), F.lit(0.0)).alias("mix_rate"))
    r = r.withColumn("mix_draws", F.greatest(F.ceil(F.col("mix_rate") / MOST_RATE), F.lit(1)).cast("int"))
    return r.withColumn("mix_cdf", cumulative(F.col("mix_rate") / F.col("mix_draws")))


def numbered(docs: DataFrame, own: list[str]) -> DataFrame:
    """mix_doc (the row), mix_from (its source), mix_what (id and text as one string, hashed), mix_key (the row's hash)
    and mix_no: 1, 2, ... among rows that are equal in all columns.

    Only keys are counted; rows that no other equals pass as they are. Of equal ones a single row is shuffled, with
    their number, and then repeated in blocks, so that a group of any size is no work of one task.
    """
    k1, k2 = common.row_keys(docs, own)
    text = F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    what = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    d = docs.select(F.struct(*own).alias("mix_doc"), F.col("source").alias("mix_from"), what.alias("mix_what"), k1.alias("mix_key"), k2.alias("mix_key2"))
    many = common.repeated(docs.select(k1.alias("mix_key"), k2.alias("mix_key2")), "mix_key", "mix_key2")
    row = ["mix_doc", "mix_from", "mix_what"]
    once = F.lit(1).cast("long").alias("mix_no")
    if many is None:
        return d.select(*row, "mix_key", once)
    keys = ["mix_key", "mix_key2"]
    alone = d.join(many, keys, "left_anti").select(*row, "mix_key", once)
    same = d.join(many, keys).groupBy(*keys).agg(*[F.first(c).alias(c) for c in row], F.max("n").alias("n"))
    last = (F.col("n") - 1) / NUMBER_BLOCK
    same = same.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last)))).repartition("mix_key", "block")
    first = F.col("block") * NUMBER_BLOCK + 1
    same = same.select(*row, "mix_key", F.explode(F.sequence(first, F.least(F.col("n"), first + NUMBER_BLOCK - 1))).alias("mix_no"))
    return alone.unionByName(same)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of `docs` and `copy` (from 1), each document as often as its count says, in shuffled order.

    `weights` gives the share of each source of the expected `total` rows (default: equal shares, as many rows as
    there are). Null sources are a source of their own; null texts and null ids are rows like others; every row, also of
    rows that are equal in all columns, has a draw of its own; a column that `docs` already has under the name `copy` is
    replaced; an empty table gives an empty result.
    """
    own = [c for c in docs.columns if c != "copy"]
    table = common.small(rates(docs, weights, total), MAX_BROADCAST_SOURCES)
    # the row travels as one column, so that its names never meet those used here
    j = numbered(docs, own).join(table, F.col("mix_from").eqNullSafe(F.col("mix_source")))
    # each draw's number is hashed once, before it is held against the distribution
    us = F.transform(F.sequence(F.lit(1), F.col("mix_draws")), lambda r: uniform("mix_what", "mix_no", r, F.lit(seed)))
    count = F.aggregate(us, F.lit(0), lambda acc, u: acc + F.size(F.filter("mix_cdf", lambda c: c <= u)))
    j = j.withColumn("mix_count", count).where("mix_count > 0")
    j = j.select("mix_doc", "mix_key", "mix_no", F.explode(F.sequence(F.lit(1), F.col("mix_count"))).alias("copy"))
    place = F.xxhash64("mix_key", "mix_no", "copy", F.lit(seed))
    return j.withColumn("mix_place", place).repartition("mix_place").sortWithinPartitions("mix_place").select("mix_doc.*", "copy")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))
