"""Toxicity by a classifier chain.

Categories are 0/1 label columns in a fixed order.  Each has a sparse linear model over the hashed words and word
stems of a text; the model of a later category also gets the probabilities of all earlier ones, which in training come
out of fold (three folds, each predicted by a model that didn't see it) and in scoring from the models of the whole sample.

The models are fitted on the driver on at most ``SAMPLE`` labelled documents (those of smallest hash of their doc_id, so
reruns agree); features are made on the executors, one document for a label, so what the driver gets is bounded by the
sample.  A model has weights for the ``SELECTED`` of the 2**18 hashed features that tell its category best, whatever
the corpus.  The chain goes to the executors as a broadcast of fixed size; scoring reads whole texts and shuffles nothing.

Defined results: null texts are empty (the models' intercepts decide); labelled rows without a document, with a null
label or a null doc_id teach nothing, nor do rows of one doc_id whose labels differ; of documents that share a doc_id
the one with the smallest hash of its text teaches; a category with one class only is predicted as its share; repeated
rows score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, private, read_table, text_or_empty

BITS = 18
SAMPLE = 12_000
FOLDS = 3
SELECTED = 3000
EDGES = b".,;:!?\"'()[]{}*%&$#|<>-"
CACHE = 150_000


class Words:
    """Feature numbers of words: the word, its first five and first seven bytes, hashed; the cache is emptied when full."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def features(self, text: bytes) -> np.ndarray:
        known, found = self.known, set()
        for word in set(text.lower().split()):
            pair = known.get(word)
            if pair is None:
                if len(known) >= CACHE:
                    known.clear()
                core = word.strip(EDGES)
                pair = known[word] = tuple(zlib.crc32(x) & ((1 << BITS) - 1) for x in (core, b"^" + core[:5], b"^" + core[:7]))
            found.update(pair)
        return np.fromiter(found, np.int64, len(found))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in blocks(batches):
        rows = [np.sort(words.features(x.as_py() or b"")).astype(np.int32) for x in batch.column(1).cast(pa.large_binary())]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.int32())), *batch.columns[2:]], names=["doc_id", "features", *batch.schema.names[2:]])


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    chained: np.ndarray

    def probability(self, flat: np.ndarray, offsets: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(_sums(self.weights[flat], offsets) + self.bias + earlier @ self.chained)


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]

    def probabilities(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, categories) from the rows' features, laid end to end."""
        out = np.zeros((len(offsets) - 1, len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = m.probability(flat, offsets, out[:, :k])
        return out


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(flat: np.ndarray, offsets: np.ndarray, y: np.ndarray, extra: np.ndarray, l1: float = 2e-4, steps: int = 400, selected: int = SELECTED) -> Linear:
    """Logistic regression with an L1 penalty (accelerated proximal gradient) on the ``selected`` features that separate the classes best."""
    n, size = len(y), 1 << BITS
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    empty = Linear(np.zeros(size), float(np.log(share / (1 - share))), np.zeros(extra.shape[1]))
    if n < 4 or y.min() == y.max():
        return empty
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    seen, hit = np.bincount(flat, minlength=size), np.bincount(flat, weights=y[row], minlength=size)
    expected = seen * share
    z = (hit - expected) / np.sqrt(expected * (1 - share) + 1)  # evidence for the class only: its absence has no words
    z[seen < 3] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:selected])
    chosen = chosen[z[chosen] > 1]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    own = place[flat]
    row, own = row[own >= 0], own[own >= 0]
    width = len(chosen)
    dense = np.column_stack([extra, np.ones(n)])
    w, d = np.zeros(width), np.zeros(dense.shape[1])
    d[-1] = empty.bias
    per_row = np.bincount(row, minlength=n).max(initial=1) if width else 1
    step = 4.0 / (min(per_row, 400) / 4 + 1 + dense.shape[1])
    # the rarer class counts more, by the root of the odds
    weigh = np.where(y > 0.5, np.sqrt((1 - share) / share), 1.0)
    weigh /= weigh.mean()
    scale = 1 / np.sqrt(np.maximum(seen[chosen] / n, 1e-4)) ** 0.5  # rare features may move further
    vw, vd, t = w.copy(), d.copy(), 1.0
    for _ in range(steps):
        p = sigmoid(np.bincount(row, weights=(vw * scale)[own], minlength=n) + dense @ vd)
        r = weigh * (p - y) / n
        gw = np.bincount(own, weights=r[row], minlength=width) * scale
        nw = vw - step * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nd = vd - step * (dense.T @ r)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vd = nw + (t - 1) / u * (nw - w), nd + (t - 1) / u * (nd - d)
        w, d, t = nw, nd, u
    weights = np.zeros(size)
    weights[chosen] = w * scale
    return Linear(weights, float(d[-1]), d[:-1])


def fit_chain(flat: np.ndarray, offsets: np.ndarray, labels: np.ndarray, fold: np.ndarray, names: list[str]) -> Chain:
    """labels: (rows, categories) of 0/1; fold: the fold of each row."""
    n = len(offsets) - 1
    earlier, models = np.zeros((n, 0)), []
    sizes = np.diff(offsets)
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        models.append(fit_linear(flat, offsets, y, earlier))
        out = np.zeros(n)
        for f in range(FOLDS):
            learn, hold = fold != f, fold == f
            if not hold.any():
                continue
            keep = np.repeat(learn, sizes)
            part = fit_linear(flat[keep], np.concatenate([[0], np.cumsum(sizes[learn])]), y[learn], earlier[learn])
            out[hold] = part.probability(flat, offsets, earlier)[hold]
        earlier = np.column_stack([earlier, out])
    return Chain(names, models)


def one_label(labels: DataFrame, names: list[str]) -> DataFrame:
    """One row for each ``_id``; ids with a null label, or with labels that differ, have none."""
    out = labels.dropna().groupBy("_id").agg(*(F.min(n).alias(n) for n in names), *(F.max(n).alias(f"_max_{k}") for k, n in enumerate(names)))
    for k, n in enumerate(names):
        out = out.where(F.col(n) == F.col(f"_max_{k}"))
    return out.select("_id", *names)


def one_document(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, labels' columns): for each row of ``labels`` (_id, ...; a sample of bounded size, which is broadcast) the document
    of that id, the one with the smallest hash of its text."""
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(labels), F.col("doc_id") == F.col("_id")).drop("_id")
    rest = [c for c in labels.columns if c != "_id"]
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text", *rest)).alias("x"))
    return one.select("doc_id", "x.text", *(F.col(f"x.{c}") for c in rest))


def train(docs: DataFrame, labels: DataFrame, names: list[str], sample: int = SAMPLE) -> Chain:
    """A chain over the label columns ``names`` of ``labels`` (doc_id and 0/1 columns), on at most ``sample`` rows."""
    own = one_label(labels.select(F.col("doc_id").alias("_id"), *names), names)
    own = own.orderBy(F.crc32(F.concat(F.lit("chain"), F.col("_id").cast("string"))), "_id").limit(sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = one_document(docs, own).mapInArrow(_features, ", ".join([f"doc_id {kind}", "features array<int>", *(f"`{n}` {labels.schema[n].dataType.simpleString()}" for n in names)]))
    table = made.toArrow()
    rows = sorted(zip(table["doc_id"].to_pylist(), range(table.num_rows), strict=True), key=lambda x: (str(x[0]), x[1]))
    lists = table["features"].combine_chunks()
    values = [lists[k].values.to_numpy() for _, k in rows]
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *values])
    del values, lists
    order = np.array([k for _, k in rows], int)
    y = np.column_stack([table[n].to_numpy()[order] for n in names]) if len(rows) else np.zeros((0, len(names)))
    fold = np.array([zlib.crc32(str(i).encode()) // 7 % FOLDS for i, _ in rows], int)
    return fit_chain(flat, offsets, y, fold, names)


def score(docs: DataFrame, chain: Chain, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and a probability ``p_<name>`` for each category."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(chain)
    schema = docs.select(*keep).schema
    for n in chain.names:
        schema = schema.add(f"p_{n}", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = Words(), sent.value
        for batch in blocks(batches, "_text"):
            rows = [words.features(x.as_py() or b"") for x in batch.column(len(keep)).cast(pa.large_binary())]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            p = own.probabilities(np.concatenate(rows), offsets)
            yield pa.record_batch([*batch.columns[: len(keep)], *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=[*keep, *(f"p_{n}" for n in own.names)])

    return docs.select(*keep, text_or_empty(text).alias("_text")).mapInArrow(run, schema)


CATEGORIES = ["low_quality", "toxic"]


def table_labels(labels: DataFrame) -> DataFrame:
    """The two categories that ``labels`` holds, in chain order."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the chain's probabilities and toxic (p_toxic >= 0.5) of every document."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    chain = train(docs, table_labels(labels), CATEGORIES)
    return score(docs, chain, ["doc_id"]).withColumn("toxic", (F.col("p_toxic") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose p_toxic is below the threshold."""
    chain = train(docs, table_labels(labels), CATEGORIES)
    own, name = private(docs)
    return score(own, chain, own.columns, name["text"]).where(F.col("p_toxic") < threshold).select(*own.columns).toDF(*docs.columns)


SQL: dict[str, str] = {}
