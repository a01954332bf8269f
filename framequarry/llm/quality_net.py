"""A byte-level convolutional network for document quality, in numpy.

Learned filters of six bytes run over every byte of a text. Their rectified responses are max-pooled within chunks of
256 bytes that overlap by 64 and cover the whole text; a hidden layer turns a chunk's maxima into a logit, and the
logits' mean over all chunks gives one probability. Training sees a bounded sample of labelled documents, at most
`MAX_TRAIN` ids and `MAX_TRAIN_BYTES`; it reads their whole texts from a file of the driver's, as scoring does in Spark.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .arrowtext import small_batches, text_bytes

WIDTH, FILTERS, HIDDEN = 6, 24, 16
BLOCK, CHUNK_BLOCKS, STEP_BLOCKS = 64, 4, 3
MAX_TRAIN, EPOCHS, BATCH, RATE = 4000, 8, 64, 0.01
#: Bytes of all training texts together, which bounds the driver's file and its time; one text at least.
MAX_TRAIN_BYTES = 64_000_000
#: Jobs that bring the training texts, a partition at a time.
FETCHES = 16
CHUNK = BLOCK * CHUNK_BLOCKS
#: Bytes that one convolution call works on; what it needs stays within the processor's cache.
SLICE = 4096


def chunk_count(n_bytes):
    """Chunks of texts of so many bytes, one at least."""
    blocks = (np.asarray(n_bytes) + WIDTH + BLOCK - 1) // BLOCK
    return np.maximum(1, -(-(blocks - CHUNK_BLOCKS) // STEP_BLOCKS) + 1)


def train_chunks(text: bytes, most: int = 512) -> Iterator[np.ndarray]:
    """All chunks of a text in turn, padded with zeros, as rows of at most `most` at a time."""
    n = int(chunk_count(len(text)))
    for a in range(0, n, most):
        k = min(most, n - a)
        size = ((k - 1) * STEP_BLOCKS + CHUNK_BLOCKS) * BLOCK
        part = bytes(text[a * STEP_BLOCKS * BLOCK :][:size]).ljust(size, b"\0")
        yield np.lib.stride_tricks.sliding_window_view(np.frombuffer(part, np.uint8), CHUNK)[:: STEP_BLOCKS * BLOCK]


def gathered(texts: Iterator[bytes], most: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chunks, number of each chunk's text): all chunks of all texts, about `most` rows at a time."""
    held, of, rows = [], [], 0
    for i, text in enumerate(texts):
        for x in train_chunks(text, most):
            held.append(x), of.append(np.full(len(x), i))
            rows += len(x)
            if rows >= most:
                yield np.concatenate(held), np.concatenate(of)
                held, of, rows = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(of)


def empty_model() -> dict[str, np.ndarray]:
    return {"w": np.zeros((WIDTH, 256, FILTERS), np.float32), "b": np.zeros(FILTERS, np.float32), "h": np.zeros((FILTERS, HIDDEN), np.float32),
            "hb": np.zeros(HIDDEN, np.float32), "v": np.zeros(HIDDEN, np.float32), "vb": np.zeros(1, np.float32)}


def maxima(m: dict[str, np.ndarray], x: np.ndarray, t: int, some: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of each filter's highest response in each chunk; a few chunks at a time, so that they stay in the cache."""
    arg, top = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
    for s in range(0, len(x), some):
        part = x[s : s + some]
        z = m["w"][0].take(part[:, :t], 0)
        for j in range(1, WIDTH):
            z += m["w"][j].take(part[:, j : j + t], 0)
        arg[s : s + some] = z.argmax(1)
        top[s : s + some] = np.take_along_axis(z, arg[s : s + some][:, None], 1)[:, 0]
    return arg, top + m["b"]


def gradients(m: dict[str, np.ndarray], texts: Iterable[bytes], y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(probabilities, gradients of the mean log loss) of some texts over all their chunks; a max passes them at its place only.

    Of the chunks only the maxima and the bytes at their places stay.
    """
    t, filters, kept = CHUNK - WIDTH + 1, np.arange(FILTERS), []
    for x, of in gathered(texts):
        arg, top = maxima(m, x, t)
        rows = np.arange(len(x))[:, None]
        kept.append((of, top, np.stack([x[rows, arg + j] for j in range(WIDTH)])))
    of, top, seen = (np.concatenate(c, axis) for c, axis in zip(zip(*kept), (0, 0, 1)))
    pool = np.maximum(top, 0)
    hid = np.tanh(pool @ m["h"] + m["hb"])
    logit = hid @ m["v"] + m["vb"]
    share = 1 / np.bincount(of)[of]
    p = 1 / (1 + np.exp(-np.bincount(of, logit * share)))
    d = ((p - y) / len(y))[of].astype(np.float32) * share.astype(np.float32)
    dh = d[:, None] * m["v"] * (1 - hid**2)
    dp = (dh @ m["h"].T) * (top > 0)
    g = {"v": hid.T @ d, "vb": d.sum(keepdims=True), "h": pool.T @ dh, "hb": dh.sum(0), "b": dp.sum(0), "w": np.zeros_like(m["w"])}
    for j in range(WIDTH):
        g["w"][j] = np.bincount((seen[j].astype(np.int64) * FILTERS + filters).ravel(), dp.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return p, g


def train(docs: Sequence[bytes], labels: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam on the mean log loss of documents, which are read from `docs` one at a time."""
    rng = np.random.default_rng(seed)
    m = empty_model()
    if len(docs) == 0:
        return m
    for k, scale in (("w", 0.1), ("h", 0.3), ("v", 0.3)):
        m[k] += rng.normal(0, scale, m[k].shape).astype(np.float32)
    y_all = np.asarray(labels, np.float32)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            ids = order[at : at + BATCH]
            _, g = gradients(m, (docs[i] for i in ids), y_all[ids])
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k in m:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


class Scorer:
    """Scores many texts at a time; filters are kept as tables of byte pairs."""

    def __init__(self, m: dict[str, np.ndarray]):
        self.m = m
        self.pairs = [(m["w"][j][:, None] + m["w"][j + 1][None]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]
        self.pairs[0] = self.pairs[0] + m["b"]

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        size = np.diff(off)
        blocks = (size + WIDTH + BLOCK - 1) // BLOCK
        ends = np.cumsum(blocks * BLOCK)
        starts = ends - blocks * BLOCK
        x = np.zeros(int(ends[-1]) + WIDTH, np.uint8)
        for a, s, e in zip(starts, off[:-1], off[1:]):
            x[a : a + e - s] = raw[s:e]
        pair = x[:-1].astype(np.uint16) << 8
        pair |= x[1:]
        n = int(ends[-1])
        # windows that reach into the next text read zeros instead
        edge = (ends[:, None] - np.arange(1, WIDTH)[None]).ravel()
        tops = np.empty((n // BLOCK, FILTERS), np.float32)
        ids = [pair[j : j + n].copy() for j in range(0, WIDTH, 2)]
        for i in ids:
            i[edge] = 0
        for a in range(0, n, SLICE):
            z = self.pairs[0].take(ids[0][a : a + SLICE], 0)
            for p, i in zip(self.pairs[1:], ids[1:]):
                z += p.take(i[a : a + SLICE], 0)
            tops[a // BLOCK : (a + SLICE) // BLOCK] = z.reshape(-1, BLOCK, FILTERS).max(1)
        # a chunk is four blocks, one block shared with the next chunk
        n_chunks = chunk_count(size)
        of = np.repeat(np.arange(len(size)), n_chunks)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        at, last = starts[of] // BLOCK + within * STEP_BLOCKS, ends[of] // BLOCK - 1
        pool = tops[np.minimum(at, last)]
        for k in range(1, CHUNK_BLOCKS):
            pool = np.maximum(pool, tops[np.minimum(at + k, last)])
        hid = np.tanh(np.maximum(pool, 0) @ self.m["h"] + self.m["hb"])
        logit = np.bincount(of, hid @ self.m["v"] + self.m["vb"], len(size)) / n_chunks
        return 1 / (1 + np.exp(-logit))


class Texts:
    """Texts in a temporary file of this process, read one at a time."""

    def __init__(self):
        self.file, self.places = tempfile.TemporaryFile(), []

    def append(self, text: bytes) -> None:
        self.file.seek(0, 2)
        self.places.append((self.file.tell(), len(text)))
        self.file.write(text)

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> bytes:
        at, size = self.places[i]
        self.file.seek(at)
        return self.file.read(size)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int, max_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """doc_id, label_quality, text of at most `max_train` labelled ids of `docs` outside the held-out fold, by a hash of the id;
    of these the first whose whole texts have at most `max_bytes` together.

    Every id has one row: of several labels the lowest counts, of several texts the smallest; null labels don't count.
    """
    picked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (common.doc_bucket(F.col("doc_id"), 4) != 2))
    picked = picked.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label_quality"))
    picked = picked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_train)
    text = F.min(F.coalesce("text", F.lit(""))).alias("text")
    rows = common.written(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label_quality").agg(text))
    # ids and lengths of so few rows are put in order by one task
    size = rows.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    upto = F.sum("size").over(W.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    first = size.withColumn("upto", upto).where((F.col("upto") <= max_bytes) | (F.col("upto") == F.col("size"))).select("doc_id")
    return rows.join(F.broadcast(first), "doc_id")


def fitted(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict[str, np.ndarray]:
    """The network, trained on the whole texts of `training_rows`."""
    texts, rows = Texts(), []
    for r in training_rows(docs, labels, max_train).coalesce(FETCHES).toLocalIterator():
        rows.append((r.doc_id, len(texts), r.label_quality))
        texts.append(r.text.encode())
    rows.sort()
    texts.places = [texts.places[i] for _, i, _ in rows]
    return train(texts, np.array([y for *_, y in rows]))


def quality_scores(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str] | None = None, out_name: str = "net_score") -> DataFrame:
    """`keep` columns of `docs` (default doc_id) and `out_name`: the score of each whole text.

    Null and empty texts get the score of no bytes; repeated rows a row each; an empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(common.fresh("net_text", keep)))
    text_at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            if b.num_rows == 0:
                continue
            raw, off = text_bytes(b.column(text_at))
            score = np.concatenate([scorer(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in runs(off)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score, pa.float64())], names=[*keep, out_name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = StructType([d.schema[c] for c in keep] + [StructField(out_name, DoubleType())])
    return d.mapInArrow(run, out)


def runs(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def op3_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; repeated rows get a row each, an empty table none.

    Null ids are in no fold: held_out is false. Without any label the network stays untrained and all scores are 0.5.
    """
    docs, labels = common.documents(spark, sf_dir), common.documents(spark, sf_dir, "labels")
    s = quality_scores(docs, fitted(docs, labels))
    return s.select(
        "doc_id", F.coalesce(common.doc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("net_score").alias("score"),
        (F.col("net_score") >= 0.7).cast("int").alias("predicted"))
