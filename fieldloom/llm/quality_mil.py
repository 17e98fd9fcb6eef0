"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole text gets a vector of style ratios
and hashed words; a learned layer encodes it, a gated attention (tanh times sigmoid) weighs the passages of a bag, and
the weighted mean is scored.  Only bags have labels; attention learns which passages tell.

Vectors come from numpy over whole Arrow blocks.  The network is fitted on the driver on a bounded sample of labelled
documents, all passages of each: at most ``SAMPLE`` documents in the order of a hash of their doc_id, ending before
their passages exceed ``PASSAGES`` together.  Its parameters, about 4,000 numbers, go to the executors as a broadcast.
Scoring shuffles nothing.

Defined results: null and empty texts are a bag of one zero vector and get a score; a table without usable labels
gives 0.5 throughout; a null label or doc_id teaches nothing, nor do rows of one doc_id whose labels differ; of
documents that share a doc_id the one with the smallest hash of its text teaches; repeated rows score alike; labels,
lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bytes_of, drop_written, mix, read_table, text_or_empty, word_bounds, word_names, written
from .toxicity import one_document, one_label

PASSAGE = 96
HASHED = 48
SAMPLE = 8_000
PASSAGES = 200_000  # vectors of 250 bytes
HIDDEN = 24
THRESHOLD = 0.7

CLASSES = np.zeros((256, 7), np.float32)
CLASSES[ord("A") : ord("Z") + 1, 0] = 1
CLASSES[ord("0") : ord("9") + 1, 1] = 1
CLASSES[[ord(c) for c in "#*$%&|<>~^_=+{}[]\\@"], 2] = 1
CLASSES[[ord(c) for c in "!?"], 3] = 1
CLASSES[[ord(c) for c in ".,;:"], 4] = 1
CLASSES[128:, 5] = 1
CLASSES[ord("\n"), 6] = 1
STYLE = CLASSES.shape[1] + 7
WIDTH = STYLE + HASHED


def _per(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at, axis=0)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of a block's documents, and for each document the number of passages before it."""
    starts, ends, bounds = word_bounds(data, offsets)
    words = np.diff(bounds)
    count = np.maximum(1, -(-words // PASSAGE))
    before = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((before[-1], WIDTH), np.float32)
    if not len(starts):
        return out, before
    doc = np.repeat(np.arange(len(words)), words)
    within = np.arange(len(starts)) - bounds[:-1][doc]
    passage = before[:-1][doc] + within // PASSAGE
    at = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    rows = passage[at]
    n = np.diff(np.append(at, len(starts))).astype(np.float32)
    length = (ends - starts).astype(np.float32)
    first = starts[at]
    stop = np.append(first[1:], len(data))
    own_end = offsets[1:][doc[at]]
    stop = np.minimum(stop, own_end)
    size = np.maximum(stop - first, 1).astype(np.float32)
    for k in range(CLASSES.shape[1]):
        sums = np.concatenate([[0], np.cumsum(CLASSES[data, k], dtype=np.float64)])
        out[rows, k] = (sums[stop] - sums[first]) / size
    names = word_names(data, starts, ends)
    inside = within > 0
    again = np.zeros(len(names), np.float32)
    again[1:] = (names[1:] == names[:-1]) & inside[1:]
    grams = names.copy()
    for k in (1, 2, 3):
        grams[:-k] = mix(grams[:-k] + names[k:] * np.uint64(2 * k + 1))
    seeded = grams ^ mix(doc.astype(np.uint64) + np.uint64(1))
    _, back, copies = np.unique(seeded, return_inverse=True, return_counts=True)
    repeated = (copies[back] > 1).astype(np.float32)
    tail = np.repeat(bounds[1:], words) - np.arange(len(names)) < 4  # grams that would cross into the next document
    repeated[tail] = 0
    order = np.lexsort((names, passage))
    new = np.ones(len(names), np.float32)
    new[1:] = (names[order][1:] != names[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    base = CLASSES.shape[1]
    out[rows, base] = _per(length, at) / n / 8
    out[rows, base + 1] = np.sqrt(_per(length * length, at) / n) / 8
    out[rows, base + 2] = _per(again, at) / n
    out[rows, base + 3] = _per(repeated, at) / n
    out[rows, base + 4] = _per(new, at) / n  # the sort keeps each passage's words in its own range
    out[rows, base + 5] = _per((length <= 1).astype(np.float32), at) / n
    out[rows, base + 6] = np.log1p(words[doc[at]]) / 10
    hashed = mix(names)
    bucket = (hashed % np.uint64(HASHED)).astype(np.int64)
    sign = np.where(hashed >> np.uint64(63), 1.0, -1.0)
    flat = np.bincount(passage * HASHED + bucket, weights=sign, minlength=before[-1] * HASHED).reshape(-1, HASHED)
    total = np.bincount(passage, minlength=before[-1])[:, None]
    out[:, STYLE:] = flat / np.maximum(total, 1)
    return out, before


class Network:
    """e = tanh(hW+b); a = softmax of (tanh(eV) * sigmoid(eU)) w within the bag; score = sigmoid((sum a e) c + d)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, HIDDEN), "U": draw(HIDDEN, HIDDEN), "w": draw(HIDDEN), "c": draw(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, h: np.ndarray, bags: np.ndarray):
        p, at = self.p, bags[:-1]
        sizes = np.diff(bags)
        h = np.clip((h - self.mean) / self.scale, -6, 6)
        e = np.tanh(h @ p["W"] + p["b"])
        t, g = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        s = (t * g) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, at), sizes))
        a = s / np.repeat(np.add.reduceat(s, at), sizes)
        z = np.add.reduceat(a[:, None] * e, at, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
        return h, e, t, g, a, z, y

    def gradients(self, h: np.ndarray, bags: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes, at = self.p, np.diff(bags), bags[:-1]
        h, e, t, g, a, z, y = self.forward(h, bags)
        r = (y - target) / len(target)
        dz = np.repeat(r[:, None] * p["c"], sizes, axis=0)
        da = (dz * e).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, at), sizes))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        de = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - e * e)
        return {"W": h.T @ de, "b": de.sum(axis=0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "c": z.T @ r, "d": np.array([r.sum()])}

    def fit(self, h: np.ndarray, bags: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4) -> None:
        """Adam over shuffled batches of bags; the order is fixed by a seed."""
        self.mean, self.scale = h.mean(axis=0), np.maximum(h.std(axis=0), 1e-3)
        rng = np.random.default_rng(11)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        n, step, sizes = len(target), 0, np.diff(bags)
        total = epochs * -(-n // batch)
        for _ in range(epochs):
            order = rng.permutation(n)
            for low in range(0, n, batch):
                own = order[low : low + batch]
                edges = np.concatenate([[0], np.cumsum(sizes[own])])
                rows = np.repeat(bags[own] - edges[:-1], sizes[own]) + np.arange(edges[-1])
                step += 1
                slow = rate * (1 - step / (total + 1))
                for k, g in self.gradients(h[rows], edges, target[own]).items():
                    g = g + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, h: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(h, bags)[-1]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        vectors, before = passages(*bytes_of(batch.column(1)))
        rows = [vectors[low:high].reshape(-1) for low, high in zip(before[:-1], before[1:], strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float32())), *batch.columns[2:], pa.array(np.diff(before))], names=["doc_id", "h", *batch.schema.names[2:], "n"])


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = PASSAGES) -> Network:
    """A network for ``labels`` (doc_id, y), on at most ``sample`` documents and ``most`` passages; which rows may teach is the caller's choice."""
    own = one_label(labels.select(F.col("doc_id").alias("_id"), F.col("y").cast("double").alias("y")), ["y"])
    own = own.withColumn("o", F.crc32(F.concat(F.lit("bags"), F.col("_id").cast("string")))).orderBy("o", "_id").limit(sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = written(one_document(docs, own).mapInArrow(_vectors, f"doc_id {kind}, h array<float>, y double, o long, n long"), "bags")
    sizes = made.groupBy("o").agg(F.sum("n").alias("n")).orderBy("o").toArrow()  # ``sample`` rows at most
    fits = sizes["o"].to_numpy()[np.cumsum(sizes["n"].to_numpy()) <= most]
    table = made.where(F.col("o") <= (int(fits[-1]) if len(fits) else -1)).toArrow()
    drop_written(made)
    net = Network()
    if not table.num_rows:
        net.p["c"][:] = 0
        return net
    order = [k for _, k in sorted(zip(map(str, table["doc_id"].to_pylist()), range(table.num_rows), strict=True))]
    lists = table["h"].combine_chunks()
    bags = [lists[k].values.to_numpy().reshape(-1, WIDTH) for k in order]
    edges = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    net.fit(np.concatenate(bags).astype(np.float64), edges, table["y"].to_numpy()[order])
    return net


def score(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, score and n_passages."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.select(*keep).schema.add("score", "double").add("n_passages", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in blocks(batches, "_text"):
            h, bags = passages(*bytes_of(batch.column(len(keep))))
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(own.scores(h, bags)), pa.array(np.diff(bags))], names=[*keep, "score", "n_passages"])

    return docs.select(*keep, text_or_empty().alias("_text")).mapInArrow(run, schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every document; rows held out teach nothing."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    teach = labels.where(~held_out("doc_id")).select("doc_id", F.col("quality").alias("y"))
    out = score(docs, train(docs, teach), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


SQL: dict[str, str] = {}
