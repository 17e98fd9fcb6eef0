"""Suffix-array dedup of bytes by external induced sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or the same document
further left).  Suffixes are compared in shards, and equal strings have to meet in one.  Every string of ``length``
bytes picks its smallest-named substring of ``REACH`` bytes (the leftmost, if equal) as key; consecutive strings with one key
form a stretch.  Equal strings pick equal keys, so stretches are dealt to shards by key.

1. Keys are counted (a 32-bit name each).  Those seen twice are marked in a bit table of fixed size (8 MB), which is
   broadcast; a false mark only lets a stretch take part for nothing, a full table lets all take part.
2. Stretches with marked keys are sorted by (key, content, document, place) and read as a stream: a stretch whose
   whole content occurred earlier goes whole; equal stretches so share one suffix tuple.  Blocks settle copies among
   their own documents before the exchange.
3. Strings of one key that are equal agree on at least two thirds of their bytes around the key, those on its left or
   those on its right: a stretch has two sides, each with the name of what all its strings hold.  Sides whose name
   belongs to several contents are marked in a second table.
4. The bytes of marked sides go to their shard, one for each content; a side's name decides the shard.  There are at
   most ``SHARDS`` shards for a core, so a shard grows with the input.  It writes its strings to disk, terminated, and
   sorts all suffixes by external induced sorting (induced.py) in memory that doesn't grow with it; neighbours with a
   common prefix of ``length`` or more form groups, which are read as a stream, and all of a group but the earliest go.
   In memory a shard keeps the place and document of each string, about two bytes for a byte of text at most.
5. Spans join their documents.

Strings are judged on the input, not on what is left.

Defined results: null texts are empty; documents of under ``length`` bytes lose nothing; rows of equal doc_id are
documents in the order of a hash of their text, rows that also share the text are one document; a null doc_id comes
after all others; a document of 2**30 bytes or more raises ValueError.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_NAME, RunningHash, bit_table, blocks, bytes_of, marked, mix, private, read_table, sliding_min, text_or_empty, written
from .induced import DiskQueue, Sorter, Vector

LENGTH = 100
REACH = 32
POSITION_BITS = 30
SHARD_BYTES = 3 << 17
SHARDS = 64
SORT_LIMIT = 1 << 19


class Stretches:
    """The stretches of a block: row, key, content name, first and last start and place of the key (in the block)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.length, self.reach = length, max(1, length * REACH // LENGTH)
        n = len(data)
        if n >= 1 << POSITION_BITS:
            raise ValueError(f"a document has more than {1 << POSITION_BITS} bytes")
        self.content = RunningHash(BYTE_NAME[data])
        place = np.uint64((1 << POSITION_BITS) - 1)
        score = self.content.every(self.reach) if n >= length else np.zeros(0, np.uint64)
        score &= ~place
        score |= np.arange(len(score), dtype=np.uint64)
        best = sliding_min(score, length - self.reach + 1)[: max(0, n - length + 1)]
        # a stretch begins where the choice or the document changes; starts whose string leaves its document are left out
        new = np.ones(len(best), bool)
        new[1:] = best[1:] != best[:-1]
        first, last = offsets[:-1], offsets[1:] - length
        own = last >= first
        new[first[own]] = True
        stops = last[own] + 1
        new[stops[stops < len(new)]] = True
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(best)) - 1 if len(head) else head
        self.row = np.searchsorted(offsets, head, "right") - 1
        inside = head <= offsets[1:][self.row] - length
        head, tail, self.row = head[inside], tail[inside], self.row[inside]
        self.a, self.b = head, tail
        self.anchor = (best[head] & place).astype(np.int64)
        self.key = mix(self.content.slices(self.anchor, self.anchor + self.reach))

    def only(self, own: np.ndarray) -> Stretches:
        """Those of a selection, with the names of their contents."""
        self.row, self.key, self.a, self.b, self.anchor = (x[own] for x in (self.row, self.key, self.a, self.b, self.anchor))
        self.whole = mix(self.content.slices(self.a, self.b + self.length) + (self.anchor - self.a).astype(np.uint64))
        return self

    def sides(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For the strings with much on the key's left and for the others: whether there are any, their name, first and last start."""
        cut = self.anchor - -(-(self.length - self.reach) // 2)
        left, right = (self.a, np.minimum(self.b, cut)), (np.maximum(self.a, cut + 1), self.b)
        # left: from the last start to the key's end; right: from the key to the first string's end
        held = ((cut, self.anchor + self.reach), (self.anchor, cut + 1 + self.length))
        out = []
        for k, ((low, high), (x, y)) in enumerate(zip((left, right), held, strict=True)):
            some = low <= high
            out.append((some, mix(self.content.slices(np.where(some, x, 0), np.where(some, y, 0)) + np.uint64(k)), low, high))
        return out


def _names(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            key = Stretches(*bytes_of(batch.column(2)), length).key
            names, n = np.unique((key >> np.uint64(32)).astype(np.int64), return_counts=True)
            yield pa.record_batch({"name": names, "n": np.minimum(n, 2).astype(np.int64)})

    return run


def _ranked(batch: pa.RecordBatch) -> np.ndarray:
    """Place of each row of a block in the order of documents; rows of one document share it."""
    rows = [((x is None, x), t) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    distinct = {x: k for k, x in enumerate(sorted(set(rows), key=lambda r: (r[0][0], r[0][1] if r[0][1] is not None else 0, r[1])))}
    return np.array([distinct[x] for x in rows], np.int64)


def _firsts(key: np.ndarray, whole: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key, content and document, and which rows in it are the first of their content."""
    order = np.lexsort((place, rank, whole, key))
    key, whole = key[order], whole[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
    return order, first


def _list(length: int, sent):
    """Stretches with marked keys, the first of each content in the block with the names of its sides (-1: no such strings);
    copies behind it come as settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in blocks(batches):
            data, offsets = bytes_of(batch.column(2))
            found = Stretches(data, offsets, length)
            found.only(marked(marks, found.key))
            sides = [np.where(some, (name >> np.uint64(32)).astype(np.int64), -1) for some, name, _, _ in found.sides()]
            row, key, whole, a, n = found.row, found.key, found.whole, found.a - offsets[found.row], found.b - found.a + length
            rank = _ranked(batch)
            order, first = _firsts(key, whole, rank[row], a)
            row, key, whole, a, n, left, right = (x[order] for x in (row, key, whole, a, n, *sides))
            head = np.flatnonzero(first)
            head = head[np.cumsum(first) - 1] if len(head) else head
            again = ~first & ((a != a[head]) | (rank[row] != rank[row[head]]))  # a repeated row is the same document
            # copies in the block are settled: merged, and dealt by place
            gone = np.flatnonzero(again)
            gone = gone[np.lexsort((a[gone], row[gone]))]
            low, high = offsets[row[gone]] + a[gone], offsets[row[gone]] + a[gone] + n[gone]
            reach = np.maximum.accumulate(high) if len(gone) else high
            new = np.ones(len(gone), bool)
            new[1:] = (low[1:] > reach[:-1]) | (row[gone][1:] != row[gone][:-1])
            head = np.flatnonzero(new)
            size = (reach[np.append(head[1:], len(gone)) - 1] - low[head]) if len(gone) else low
            gone = gone[head]
            ask = np.flatnonzero(first)
            both = np.concatenate([ask, gone])
            at = pa.array(row[both])
            spread = mix(low[head].astype(np.uint64) + key[gone])
            settled = np.arange(len(both)) >= len(ask)
            yield pa.record_batch(
                {
                    "key": np.concatenate([key[ask], spread]).view(np.int64),
                    "content": whole[both].view(np.int64),
                    "doc": batch.column(0).take(at),
                    "th": batch.column(1).take(at),
                    "a": a[both].astype(np.int64),
                    "n": np.concatenate([n[ask], size]).astype(np.int32),
                    "again": settled,
                    "left": pa.array(left[both], mask=settled),
                    "right": pa.array(right[both], mask=settled),
                }
            )

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches, streamed: spans of copies (n not null), and the sides of the first stretch of each content (n null)."""
    last = None  # key, content, doc, th, a of the first row of the content that the batch before ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        key, content, a, th = (batch.column(k).to_numpy() for k in (0, 1, 4, 3))
        again, doc = batch.column(6).to_numpy(zero_copy_only=False), batch.column(2)
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        first[0] = last is None or (key[0], content[0]) != last[:2]
        head = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        same = np.zeros(len(key), bool)  # rows of one document and place, from repeated rows of the table
        inner = np.flatnonzero(~first & (head >= 0))
        near = inner[(a[inner] == a[head[inner]]) & (th[inner] == th[head[inner]])]
        same[[k for k in near if doc[int(k)].as_py() == doc[int(head[k])].as_py()]] = True
        for k in np.flatnonzero(head < 0):
            same[k] = (doc[int(k)].as_py(), th[k], a[k]) == last[2:]
        gone, new = pa.array(np.flatnonzero((~first | again) & ~same)), pa.array(np.flatnonzero(first & ~again))
        out = batch.select(["doc", "th", "a", "n", "left", "right"])
        yield out.take(gone)
        sides = out.take(new)
        yield sides.set_column(3, "n", pa.nulls(len(new), pa.int32()))
        if head[-1] >= 0:
            k = int(head[-1])
            last = (key[-1], content[-1], doc[k].as_py(), th[k], a[k])


def _bytes(length: int, sent):
    """The bytes of marked sides, the first of each content in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in blocks(batches):
            data, offsets = bytes_of(batch.column(2))
            found = Stretches(data, offsets, length)
            rank = _ranked(batch)
            for some, name, low, high in found.sides():
                own = np.flatnonzero(some & marked(marks, name))
                if not len(own):
                    continue
                row, name, low, high = found.row[own], name[own], low[own], high[own]
                whole = mix(found.content.slices(found.a[own], found.b[own] + length) + (found.anchor - found.a)[own].astype(np.uint64))
                order, first = _firsts(name, whole, rank[row], low)
                order = order[first]
                row, name, whole, low, high = (x[order] for x in (row, name, whole, low, high))
                at = pa.array(row)
                text = pa.array([data[x : y + length].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
                yield pa.record_batch({"key": name.view(np.int64), "content": whole.view(np.int64), "doc": batch.column(0).take(at), "th": batch.column(1).take(at), "a": (low - offsets[row]).astype(np.int64), "text": text})

    return run


def later_starts(text: Vector, bounds: np.ndarray, earlier: np.ndarray, place: np.ndarray, length: int, folder: str, limit: int = SORT_LIMIT) -> Iterator[np.ndarray]:
    """Positions of ``text`` whose string of ``length`` bytes also starts earlier, in order, in blocks.

    text: terminated strings (byte + 1, then 0), string k from bounds[k]; earlier[k]: the order of its document, place[k]:
    its start there.  Groups are streamed: what is known of the last one is its earliest start.
    """
    suffixes, lcp = Sorter(length, folder, limit).sort(text)
    gone, sizes = DiskQueue(1, 0, folder, limit), np.diff(bounds)
    group, kept = 0, None  # the last group, and (order of the document, start, suffix) of its earliest string
    for low, at in suffixes.blocks(limit // 4):
        # what lies between two full suffixes of a group has the common prefix too
        groups = group + np.cumsum(lcp.read(low, low + len(at)) < length)
        group = int(groups[-1])
        string = np.searchsorted(bounds, at, "right") - 1
        offset = at - bounds[string]
        full = offset + length <= sizes[string] - 1
        groups, at, when, where = groups[full], at[full], earlier[string[full]], (place[string] + offset)[full]
        if kept is not None:
            groups, when, where, at = (np.concatenate([[x], y]) for x, y in zip(kept, (groups, when, where, at), strict=True))
        if not len(at):
            continue
        order = np.lexsort((where, when, groups))
        groups, when, where, at = (x[order] for x in (groups, when, where, at))
        first = np.ones(len(groups), bool)
        first[1:] = groups[1:] != groups[:-1]
        head = np.flatnonzero(first)
        kept = tuple(int(x[head[-1]]) for x in (groups, when, where, at))
        head = head[np.cumsum(first) - 1]
        later = ~first & ((when != when[head]) | (where != where[head]))
        gone.push(at[later])
    for rows in gone.drain():
        yield rows[0].astype(np.int64)


def _sort_shard(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            docs, hashes, places, sizes, last, kind = [], [], [], [], None, None
            text = Vector(np.int16, folder, SORT_LIMIT)
            for batch in batches:  # the rows come sorted by key and content
                kind = batch.schema.field(2).type
                parts = []
                for k, c, d, t, a, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    if (k, c) != last:
                        last = (k, c)
                        docs.append(d)
                        hashes.append(t)
                        places.append(a)
                        sizes.append(len(x) + 1)
                        parts += [np.frombuffer(x, np.uint8).astype(np.int16) + np.int16(1), np.zeros(1, np.int16)]
                if parts:
                    text.append(np.concatenate(parts))
            if not sizes:
                return
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = sorted(set(zip(docs, hashes, strict=True)), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
            number = {x: i for i, x in enumerate(ids)}
            earlier = np.array([number[x] for x in zip(docs, hashes, strict=True)], np.int64)
            place = np.array(places, np.int64)
            del ids, number, places
            for gone in later_starts(text, bounds, earlier, place, length, folder):
                if not len(gone):
                    continue
                string = np.searchsorted(bounds, gone, "right") - 1
                new = np.ones(len(gone), bool)
                new[1:] = (np.diff(gone) > 1) | (string[1:] != string[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(gone)) - 1
                own = string[head]
                yield pa.record_batch(
                    {
                        "doc": pa.array([docs[k] for k in own], kind),
                        "th": pa.array([hashes[k] for k in own], pa.int64()),
                        "a": gone[head] - bounds[own] + place[own],
                        "n": (gone[tail] - gone[head] + length).astype(np.int32),
                    }
                )

    return run


def _documents(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def later_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, th, spans): byte spans (a, n) of strings that start earlier too; th: xxhash64 of the text."""
    spark, source = docs.sparkSession, _documents(docs)
    kind = source.schema["doc"].dataType.simpleString()
    twice = source.mapInArrow(_names(length), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    first = spark.sparkContext.broadcast(bit_table(twice))
    listed = source.mapInArrow(_list(length, first), f"key long, content long, doc {kind}, th long, a long, n int, again boolean, left long, right long")
    sort = ["key", "content", F.col("doc").asc_nulls_last(), "th", "a"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settled = listed.repartition(parts, "key", "content").sortWithinPartitions(*sort).mapInArrow(_settle, f"doc {kind}, th long, a long, n int, left long, right long")
    settled = written(settled, "settled")
    sides = settled.where("n is null").select(F.explode(F.array("left", "right")).alias("name")).where("name >= 0")
    shared = sides.groupBy("name").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    second = spark.sparkContext.broadcast(bit_table(shared))
    held = source.mapInArrow(_bytes(length, second), f"key long, content long, doc {kind}, th long, a long, text binary")
    size = (shared.agg(F.sum("contents")).first()[0] or 0) * (length + length // 3)
    cores = spark.sparkContext.defaultParallelism
    shards = max(cores, min(-(-size // SHARD_BYTES), SHARDS * cores))
    dealt = held.repartition(shards, "key").sortWithinPartitions(*sort)
    sorted_spans = dealt.mapInArrow(_sort_shard(length), f"doc {kind}, th long, a long, n int")
    copies = settled.where("n is not null").select("doc", "th", "a", "n")
    return copies.unionByName(sorted_spans).groupBy("doc", "th").agg(F.collect_list(F.struct("a", "n")).alias("spans"))


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row of ``docs``, columns renamed by ``private``, with a column ``_spans`` of what to remove; null where nothing is."""
    own, name = private(docs)
    spans = later_spans(docs, length).select(F.col("doc").alias("_doc"), F.col("th").alias("_th2"), F.col("spans").alias("_spans"))
    keyed = own.withColumns({"_th": F.xxhash64(text_or_empty(name["text"]))})
    return keyed.join(spans, (F.col("_th") == F.col("_th2")) & F.col(name["doc_id"]).eqNullSafe(F.col("_doc")), "left").drop("_th", "_th2", "_doc")


def kept_parts(n: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[list[tuple[int, int]], int, int]:
    """Kept ranges, removed bytes and maximal removed runs of a text of n bytes."""
    order = np.argsort(starts, kind="stable")
    low, high = starts[order], starts[order] + sizes[order]
    reach = np.maximum.accumulate(high)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > reach[:-1]
    a, b = low[new], reach[np.append(np.flatnonzero(new)[1:], len(low)) - 1]
    edges = [0, *np.stack([a, b], axis=1).reshape(-1).tolist(), n]
    return [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if y > x], int((b - a).sum()), len(a)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        spans = batch.column(2)
        edges, flat = spans.offsets.to_numpy(), spans.values
        a, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        rows = []
        for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
            own = text.as_py() or b""
            parts, removed, runs = [(0, len(own))], 0, 0
            if edges[k + 1] > edges[k]:
                parts, removed, runs = kept_parts(len(own), a[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]])
            out = hashlib.sha256()
            for x, y in parts:
                out.update(own[x:y])
            rows.append((len(own), removed, runs, out.hexdigest()))
        n_bytes, removed, runs, digest = zip(*rows, strict=True)
        yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = docs.select("doc_id", "text")
    return with_spans(docs, length).toDF("doc_id", "text", "_spans").mapInArrow(_digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``text`` as binary, without the bytes of strings that start earlier too."""
    private_docs, name = private(docs)
    schema = ", ".join(f"{f.name} {'binary' if f.name == name['text'] else f.dataType.simpleString()}" for f in private_docs.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, name["text"]):
            at = batch.schema.get_field_index(name["text"])
            spans = batch.column(batch.schema.get_field_index("_spans"))
            edges, flat = spans.offsets.to_numpy(), spans.values
            a, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            for k, own in enumerate(texts):
                if own is not None and edges[k + 1] > edges[k]:
                    texts[k] = b"".join(own[x:y] for x, y in kept_parts(len(own), a[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]])[0])
            names = [x for x in batch.schema.names if x != "_spans"]
            yield pa.record_batch([pa.array(texts, pa.binary()) if x == name["text"] else batch.column(x) for x in names], names=names)

    return with_spans(docs, length).mapInArrow(cut, schema).toDF(*docs.columns)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document under strings of 100 bytes."""
    return digest(read_table(spark, sf_dir, "documents"), LENGTH)


SQL: dict[str, str] = {}
