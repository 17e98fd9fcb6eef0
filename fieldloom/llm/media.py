"""Media columns: content-defined chunks, a deduplicated chunk store, and ordered chunk lists that rebuild verified media.

A payload is cut where a rolling 32-bit gear hash (window 32 bytes) has ``MASK_BITS`` leading zeros, between ``LEAST``
and ``MOST`` bytes, so equal stretches get equal chunks wherever they stand.  Steps:

1. *Lists.*  Every row becomes a key (SHA-256 of its payload) and the ordered list of its chunks' SHA-256.
2. *Dedup.*  Spark counts the digests.  Those seen more than once are marked in a bit table of fixed size (2 MB), which
   is broadcast; a false mark only sends a chunk the longer way, and a full table sends all of them there.
3. *Store.*  Unmarked chunks occur once in the corpus: they are written, compressed, inside their row's pack, without a
   shuffle.  Marked chunks go through an aggregation by digest into the chunk table, once each.
4. *Read back.*  Packs without gaps are rebuilt as they are scanned.  The gaps of the others are joined to the chunk
   table by digest, once for each distinct payload, and the pieces are put in the order of the list.  Every chunk is
   checked against its digest, every payload against its key.

The stored form of a payload is its list (magic, payload length, chunk count, digest and length of each chunk)
followed by the compressed chunks.

Defined results: null and empty texts are one block of padding; equal payloads share one set of values; a chunk that
is missing or differs raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_NAME, blocks, read_table, text_or_empty, written

LEAST, MOST, MASK_BITS = 1024, 16384, 12
UNIT = 192
MARK_BITS = 24
GEAR = (BYTE_NAME >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] modulo 2**32, by doubling the window; right from the 32nd byte on."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h = np.concatenate([h[:step], h[step:] + (h[:-step] << np.uint32(step))])
    return h


def cuts(data: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each payload data[bounds[k]:bounds[k+1]] the positions where its chunks end."""
    marks = (np.flatnonzero(gear(data) >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends = []
        while high - low > LEAST:
            at = bisect_left(marks, low + LEAST)
            low = min(marks[at] if at < len(marks) else high, low + MOST, high)
            ends.append(low)
        if not ends or ends[-1] < high:
            ends.append(high)
        out.append(ends)
    return out


def pad(text: bytes, unit: int = UNIT) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return text + b" " * (-len(text) % unit or (0 if text else unit))


def _chunked(batch: pa.RecordBatch, column: int, unit: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Row, payload and chunks."""
    payloads = [pad(x.as_py() or b"", unit) for x in batch.column(column).cast(pa.large_binary())]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in payloads])]).astype(np.int64)
    for k, ends in enumerate(cuts(np.frombuffer(b"".join(payloads), np.uint8), bounds)):
        edges = [int(bounds[k]), *ends]
        own = payloads[k]
        yield k, own, [own[a - edges[0] : b - edges[0]] for a, b in zip(edges, edges[1:], strict=False)]


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _packer():
    import zstandard

    return zstandard.ZstdCompressor(level=3)


def _lists(unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            keys, sizes, lists = [], [], []
            for k, payload, chunks in _chunked(batch, 1, unit):
                keys.append(digest(payload))
                sizes.append(len(batch.column(1)[k].as_py().encode()))
                lists.append([digest(c) for c in chunks])
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.binary()), "digests": pa.array(lists, pa.list_(pa.binary()))})

    return run


def _place(name: bytes) -> int:
    return int.from_bytes(name[:4], "big") >> (32 - MARK_BITS)


def _marked(marks: np.ndarray, name: bytes) -> bool:
    at = _place(name)
    return bool(marks[at >> 6] >> np.uint64(at & 63) & np.uint64(1))


def _packs(unit: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, marks = _packer(), sent.value
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("z", pa.binary())]))
        for batch in blocks(batches):
            seen, keys, pieces, whole = set(), [], [], []
            for _, payload, chunks in _chunked(batch, 0, unit):
                key = digest(payload)
                names = [digest(c) for c in chunks]
                gaps = [_marked(marks, n) for n in names]
                if all(gaps) and key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                whole.append(not any(gaps))
                pieces.append([{"digest": n, "z": None if gap else pack.compress(c)} for n, gap, c in zip(names, gaps, chunks, strict=True)])
            yield pa.record_batch({"key": pa.array(keys, pa.binary()), "whole": pa.array(whole, pa.bool_()), "pieces": pa.array(pieces, kind)})

    return run


def _shared(unit: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, marks = _packer(), sent.value
        for batch in blocks(batches):
            found = {}
            for _, _, chunks in _chunked(batch, 0, unit):
                for c in chunks:
                    name = digest(c)
                    if name not in found and _marked(marks, name):
                        found[name] = pack.compress(c)
            yield pa.record_batch({"digest": pa.array(list(found), pa.binary()), "z": pa.array(list(found.values()), pa.binary())})

    return run


def feature(payload: bytes, chunks: int) -> str:
    """Chunks, mean byte in thousandths and the share of bytes in eight ranges in thousandths."""
    data = np.frombuffer(payload, np.uint8)
    ranges = np.bincount(data >> 5, minlength=8) * 1000 // len(data)
    return f"chunks={chunks};mean={int(data.sum(dtype=np.int64)) * 1000 // len(data)};ranges=" + ",".join(map(str, ranges.tolist()))


def rebuild(key: bytes, pieces: list[tuple[bytes, bytes | None]]) -> tuple[bytes, bytes]:
    """Payload and stored form from the ordered (digest, compressed chunk) pieces; all are verified."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    chunks = []
    for name, z in pieces:
        if z is None or digest(c := unpack.decompress(z)) != name:
            raise ValueError(f"chunk {name.hex()} of {key.hex()} is missing or damaged")
        chunks.append(c)
    payload = b"".join(chunks)
    if digest(payload) != key:
        raise ValueError(f"payload {key.hex()} is damaged")
    head = b"CDC1" + struct.pack("<QI", len(payload), len(chunks)) + b"".join(n + struct.pack("<I", len(c)) for (n, _), c in zip(pieces, chunks, strict=True))
    return payload, head + b"".join(z for _, z in pieces)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, pieces in zip(batch.column(0), batch.column(1), strict=True):
            name, parts = key.as_py(), [(p["digest"], p["z"]) for p in pieces.as_py()]
            payload, stored = rebuild(name, parts)
            rows.append({"key": name, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature(payload, len(parts))})
        yield pa.RecordBatch.from_pylist(rows, VALUES)


VALUES = pa.schema([("key", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
VALUES_SQL = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class Store:
    """lists: (doc_id, n_bytes, key, digests) of every row; packs: (key, whole, pieces); shared: (digest, z)."""

    def __init__(self, docs: DataFrame, unit: int = UNIT):
        spark = docs.sparkSession
        kind = docs.schema["doc_id"].dataType.simpleString()
        text = docs.select("doc_id", text_or_empty().alias("text"))
        self.lists = written(text.mapInArrow(_lists(unit), f"doc_id {kind}, n_bytes long, key binary, digests array<binary>"), "lists")
        repeated = self.lists.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        place = F.shiftrightunsigned(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - MARK_BITS)
        bits = repeated.select(place.alias("p")).selectExpr("shiftright(p, 6) AS word", "shiftleft(1L, CAST(p & 63 AS INT)) AS bit")
        rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**18 words at most
        marks = np.zeros(1 << MARK_BITS - 6, np.uint64)
        marks[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast(marks)
        text = text.select("text")
        self.packs = written(text.mapInArrow(_packs(unit, sent), "key binary, whole boolean, pieces array<struct<digest:binary,z:binary>>"), "packs")
        self.shared = written(text.mapInArrow(_shared(unit, sent), "digest binary, z binary").groupBy("digest").agg(F.first("z").alias("z")), "chunks")

    def values(self) -> DataFrame:
        """(key, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every distinct payload, read back."""
        whole = self.packs.where("whole").select("key", "pieces").mapInArrow(_read, VALUES_SQL)
        parts = self.packs.where("not whole").select("key", F.posexplode("pieces").alias("seq", "piece")).select("key", "seq", "piece.digest", "piece.z")
        held = parts.where("z is not null")
        asked = parts.where("z is null").select("key", "seq", "digest").distinct()
        filled = asked.join(self.shared, "digest").select("key", "seq", "digest", "z").unionByName(held)
        ordered = filled.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "z"))).alias("x"))
        pieces = F.transform("x", lambda p: F.struct(p["digest"].alias("digest"), p["z"].alias("z")))
        return whole.unionByName(ordered.select("key", pieces.alias("pieces")).mapInArrow(_read, VALUES_SQL))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    store = Store(read_table(spark, sf_dir, "documents"))
    return store.lists.select("doc_id", "n_bytes", "key").join(store.values(), "key").drop("key")


SQL: dict[str, str] = {}
