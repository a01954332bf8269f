"""Many rows of one id, and many equal rows, in exact dedup and in the Jaccard join."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framequarry.llm import common, jaccard_join, suffix_dedup

SCHEMA = "doc_id long, text string"


def removed(rows: list[tuple], length: int = 100) -> Counter:
    """By (id, start), null the smallest: what starts later than the earliest of its equals goes."""
    low = lambda i: -(2**63) if i is None else i
    first: dict = {}
    texts = {(i, (t or "").encode()) for i, t in rows}
    for i, b in texts:
        for k in range(len(b) - length + 1):
            part = b[k : k + length]
            first[part] = min(first.get(part, (low(i), k)), (low(i), k))
    out = {}
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (low(i), k):
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i, b] = (i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return Counter(out[i, (t or "").encode()] for i, t in rows)


@pytest.mark.parametrize("most_together", [4096, 2])
def test_dedup_texts_of_one_id(spark, most_together):
    """Texts of one id (or none) that share passages at equal and at different places, with each other and with other ids."""
    rng = random.Random(most_together)
    words = [str(rng.randrange(10**6)) for _ in range(60)]
    passage = [" ".join(rng.choice(words) for _ in range(n)) for n in (18, 25, 40, 60)]
    rows = []
    for k in range(150):
        own = lambda: " ".join(str(rng.random()) for _ in range(rng.randint(0, 8)))
        parts = [rng.choice(["", own()])] + [p for _ in range(rng.randint(0, 3)) for p in (rng.choice(passage), own())]
        rows.append((rng.choice([None, 5, 5, 7, k]), " ".join(parts)))
    rows += [rng.choice(rows) for _ in range(30)] + [(5, None), (5, ""), (None, "x" * 350), (5, "x" * 350), (None, passage[3]), (5, passage[3]), (5, passage[3] + " tail")]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA), most_together=most_together)
    assert Counter(tuple(r) for r in got.collect()) == removed(rows)


def test_dedup_many_texts_without_id(spark):
    """Each row keeps its own text, whatever the number of rows without an id; equal rows all come out."""
    d = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    same = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same words " * 20).alias("text"))
    got = suffix_dedup.suffix_dedup(d.unionAll(same), with_text=True).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("kept_sha256").alias("different"), F.countDistinct("kept_text").alias("texts")).collect()
    assert sorted((r.doc_id or 0, r.n, r.different, r.texts) for r in got) == [(0, 60_000, 60_000, 60_000), (5, 100_000, 1, 1)]


def test_jaccard_equal_rows(spark):
    """Equal rows offer their shingles once and are one class; they all come out."""
    text = " ".join(f"word{i}" for i in range(91))
    rows = [(3, text)] * 2000 + [(2, text + " more"), (9, "no words shared here at all"), (4, text)]
    docs = spark.createDataFrame(rows, SCHEMA)
    d = docs.select("doc_id", jaccard_join.row_key().alias("kd"), "text")
    table = common.written(jaccard_join.profiled(d, 4, 85))
    one = jaccard_join.one_text(d, table)
    assert one.count() == 4
    classes = table.groupBy("d1", "d2").agg(F.min("kd").alias("kd")).withColumn("cid", F.monotonically_increasing_id())
    assert jaccard_join.offered(one, classes, 4, 85).groupBy("cid", "token").count().where("count > 1").count() == 0
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in jaccard_join.jaccard_groups(docs).collect())
    assert got == {(3, 88, 2, False): 2000, (2, 89, 2, True): 1, (4, 88, 2, False): 1, (9, 3, 9, True): 1}
