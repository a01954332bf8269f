"""What the operators of this subpackage share: inputs, scratch tables, bounded broadcasts, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: ASCII white space, and what splits words everywhere but in license scans.
SPACE = r"[\x20\x09-\x0D]"
WORD_GAP = SPACE + "+"
LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return table(spark, sf_dir, name)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a folder of this machine takes its place if driver and executors are one process (tests, a
    laptop); on a cluster, whose machines would each write to a disk of their own, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="framequarry-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{base.rstrip('/')}/framequarry-{uuid.uuid4().hex}"


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores behind it as long as a column of that name exists."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: lineage ends there and survives lost executors.

    The table goes when `dropped` says so, else when the application ends.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Removes tables made by `written` that nothing reads any more."""
    for df in frames:
        if df is None:
            continue
        spark = df.sparkSession
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if "/framequarry-" in folder:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                p.getFileSystem(hadoop).delete(p, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows; else unchanged, so that Spark shuffles and splits skew."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def words(text: Column) -> Column:
    """Words of a text by ASCII white space; none for null or empty texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged."""
    return F.translate(text, LOWER_FROM, LOWER_TO)


def doc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def row_keys(docs: DataFrame, columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of the columns of a row; maps count by their JSON."""
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    parts = [F.to_json(F.struct(c)) if "map<" in kind[c] or kind[c] == "variant" else F.col(c) for c in columns]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)]


def repeated(docs: DataFrame, k1: str, k2: str, max_rows: int = 500_000) -> DataFrame | None:
    """k1, k2, n of the keys that two rows or more have, ready for a join; None without any. Counts are combined before the shuffle."""
    many = written(docs.groupBy(k1, k2).agg(F.count("*").alias("n")).where("n > 1"))
    return None if many.isEmpty() else small(many, max_rows)


#: Groups over a block are broadcast up to so many.
MAX_BROADCAST_GROUPS = 500_000


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """`rows` (key, ball, cid and others) with p, q, part: the group in which two parts of a key's rows meet, and the row's own.

    Keys of up to `block` rows are one group. Larger ones are split, each ball (0: none) apart from the rest; every two
    parts meet but those of one ball, whose rows need no comparison. So a hot key is many tasks, and a hot ball in it is
    copied once for each part of the others.
    """
    per = rows.groupBy("key", "ball").agg(F.count("*").alias("g"))
    one = F.struct("ball", F.ceil(F.col("g") / block).cast("int").alias("parts"))
    big = per.groupBy("key").agg(F.sum("g").alias("all"), F.array_sort(F.collect_list(one)).alias("balls")).where(F.col("all") > block)
    before = lambda i: F.aggregate(F.slice("balls", 1, i), F.lit(0), lambda s, x: s + x["parts"])
    spans = F.transform("balls", lambda x, i: F.struct(x["ball"].alias("ball"), x["parts"].alias("parts"), before(i).alias("start")))
    big = big.select("key", spans.alias("spans"), F.aggregate("balls", F.lit(0), lambda s, x: s + x["parts"]).alias("total"))
    j = rows.join(small(written(big), MAX_BROADCAST_GROUPS), "key", "left")
    mine = F.get(F.filter("spans", lambda s: s["ball"] == F.col("ball")), 0)
    j = j.withColumn("mine", mine).withColumn("part", F.coalesce(F.col("mine.start") + F.pmod(F.xxhash64("cid", "key"), F.col("mine.parts")).cast("int"), F.lit(0)))
    own = lambda o: (F.col("ball") > 0) & (o >= F.col("mine.start")) & (o < F.col("mine.start") + F.col("mine.parts"))
    meet = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda o: ~own(o))
    meet = F.when(F.col("total").isNull(), F.array(F.lit(0))).otherwise(meet)
    j = j.withColumn("other", F.explode(meet))
    return j.select(*rows.columns, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    Input: undirected links (a, b). Output: (node, component), component being the smallest node that can be
    reached; only nodes with a link appear. Every round is two grouped minima over the edges; partial aggregation
    keeps hubs from landing in one task, and each round is written to the shared folder. Rounds end when the number of
    links and two exclusive ors of their hashes stay the same. Nulls and loops are dropped.
    """
    def marks(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(7), "u", "v"))).first())

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e)
    now = marks(e)
    for _ in range(most_rounds):
        if not now[0]:
            break
        # large-star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours are linked to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u")
        nxt = written(
            step.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        )
        dropped(e)
        before, now, e = now, marks(nxt), nxt
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v").distinct())


def lower_words_text(text: Column) -> Column:
    """A text in lower case whose ASCII letters are those of A-Z lower-casing alone.

    `lower` is fast but turns U+0130 and U+212A into text with ASCII letters; texts that hold these take the slow way.
    """
    t = F.coalesce(text, F.lit(""))
    odd = t.contains("İ") | t.contains("K")
    return F.when(odd, lower_ascii(t)).otherwise(F.lower(t))
