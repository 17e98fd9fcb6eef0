"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: bit counts over XXH64 of word shingles, made per document in Arrow batches.  Equal fingerprints collapse
before any comparison.  Two fingerprints within the radius agree on all but ``radius`` of the bands, so with four
bands and radius 2 they share a bucket of two bands (32 equal bits).  A bucket of more than ``LIMIT`` fingerprints is
cut again by pairs of bands of its 32 free bits, which leaves 16 free bits: no bucket can hold more than 65,536
distinct fingerprints, whatever the data, and no pair within the radius is lost.

In a bucket the fingerprints are stored vertically, one bit plane for each bit.  A block of queries is compared with
all lanes at once: planes are XORed with the query's bit and added to carry-save counters of two bits and an overflow
mask; a block is abandoned as soon as all its lanes exceed the radius.  Buckets emit the edges of a spanning forest
and never all pairs; components follow by star rounds (graph.py).

Defined results: null or empty texts have fingerprint 0; rows with equal doc_id are documents of their own; a null
doc_id is never the smallest unless a group has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bytes_of, mix, private, read_table, spread_join, text_or_empty, written
from .graph import components

RADIUS = 2
LIMIT = 4096
LIMIT_BYTES = 1 << 26  # shingle hashes of a block, which the exact comparison may hold at once
WIDE = 24  # bits; candidates for Jaccard 0.8, whose sets differ in ten bits on average
BLOCK_KEYS = 4  # band, key and the two parts of a block
SEED = 42


def shingles(text: bytes, size: int) -> list[bytes]:
    """Word shingles of the text in lower case, repeats included; the whole sequence if it is shorter."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[k:] for k in range(size)), strict=False)]


def fingerprint(text: bytes, size: int = 3) -> int:
    own = shingles(text, size)
    if not own:
        return 0
    return _fold(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in own), np.uint64, len(own)))


def _fold(digests: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the digests."""
    total, n = np.zeros(64, np.int64), len(digests)
    for low in range(0, n, 1 << 16):
        bits = np.unpackbits(digests[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = batch.column(1).cast(pa.large_binary())
            prints = np.fromiter((fingerprint(x.as_py() or b"", size) for x in texts), np.uint64, batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": prints.view(np.int64)})

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_fingerprints(size), f"doc_id {kind}, fp long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of lanes, 64 lanes to a word."""
    lanes = -(-len(prints) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def over_radius(planes: np.ndarray, queries: np.ndarray | None, radius: int) -> np.ndarray:
    """Masks of lanes that differ from a query in more than ``radius`` bits: (queries, words).  Without queries the planes hold XORs already."""
    shape = (1 if queries is None else len(queries), planes.shape[1])
    digits = radius.bit_length()
    counters = [np.zeros(shape, np.uint64) for _ in range(digits)]
    over = np.zeros(shape, np.uint64)
    full = ~np.uint64(0)
    for bit in range(64):
        carry = planes[bit][None, :]
        if queries is not None:
            carry = carry ^ np.where(queries >> np.uint64(bit) & np.uint64(1), full, np.uint64(0))[:, None]
        for k in range(digits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if bit % 16 == 15 and (_above(counters, over, radius) == full).all():
            return np.full(shape, full)
    return _above(counters, over, radius)


def _above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius or has overflowed, by comparing the binary digits from the highest."""
    above, level = over.copy(), np.full_like(over, ~np.uint64(0))
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            level &= counters[k]
        else:
            above |= level & counters[k]
            level &= ~counters[k]
    return above


def _lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(mask.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the linked groups in one bucket of distinct fingerprints: breadth first, every fingerprint a query once."""
    n, planes = len(prints), bit_planes(prints)
    free, members, roots = np.ones(n, bool), [], []
    while free.any():
        root = int(np.argmax(free))
        free[root] = False
        frontier = np.array([root])
        while len(frontier) and free.any():
            found = np.zeros(n, bool)
            step = max(1, (1 << 18) // n)
            for low in range(0, len(frontier), step):
                linked = ~over_radius(planes, prints[frontier[low : low + step]], radius)
                found |= _lanes(np.bitwise_or.reduce(linked, axis=0), n)
            frontier = np.flatnonzero(found & free)
            free[frontier] = False
            members.append(frontier)
            roots.append(np.full(len(frontier), root))
    none = np.zeros(0, int)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def small_forests(prints: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small buckets (sorted) at once: lanes are the pairs at a distance of k rows in one bucket."""
    links: list[tuple[np.ndarray, np.ndarray]] = []
    k = 1
    while True:
        at = np.flatnonzero(bucket[k:] == bucket[:-k])
        if not len(at):
            break
        planes = bit_planes(prints[at] ^ prints[at + k])
        near = ~_lanes(over_radius(planes, None, radius)[0], len(at))
        links.append((at[near], at[near] + k))
        k += 1
    if not links:
        return np.zeros(0, int), np.zeros(0, int)
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    members = np.array(sorted(parent), int)
    return members, np.array([find(x) for x in members.tolist()], int)


def _compare(radius: int):
    small = 96

    def edges(prints: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(cuts, len(bucket)))
        of = np.repeat(sizes, sizes)
        u, v = [], []
        few = of <= small
        if few.any():
            a, b = small_forests(prints[few], bucket[few], radius)
            u.append(prints[few][a])
            v.append(prints[few][b])
        for low, size in zip(cuts[sizes > small], sizes[sizes > small], strict=True):
            a, b = forest(prints[low : low + size], radius)
            u.append(prints[low : low + size][a])
            v.append(prints[low : low + size][b])
        join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
        return pa.record_batch({"u": join(u), "v": join(v)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_p, kept_b = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = batch.column(2).to_numpy().view(np.uint64)
            keys = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)
            prints, keys = np.concatenate([kept_p, prints]), np.concatenate([kept_b, keys])
            new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
            last = int(np.flatnonzero(new)[-1])  # the last bucket may go on in the next batch
            kept_p, kept_b = prints[last:], keys[last:]
            if last:
                yield edges(prints[:last], np.cumsum(new[:last]))
        if len(kept_p):
            yield edges(kept_p, np.zeros(len(kept_p), np.int64))

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) of a forest over distinct fingerprints ``fp`` that has the components of 'at most ``radius`` bits differ'."""
    if not 0 <= radius <= 2:
        raise ValueError("four bands, two of them equal, are complete up to radius 2")
    masks = [(0xFFFF << 16 * a) | (0xFFFF << 16 * b) for a, b in combinations(range(4), 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda mask: F.col("fp").bitwiseAND(F.lit(signed(mask)))
    table = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("band"), key(m).alias("key")) for k, m in enumerate(masks)))).alias("x")).select("x.band", "x.key", "fp")
    sizes = table.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = table.join(sizes, ["band", "key"])
    once = sized.where(F.col("n") <= LIMIT).select("band", "key", "fp")
    # the 32 free bits of a large bucket in four bands of 8, two of them equal as well
    finer = []
    for k, (a, b) in enumerate(combinations(range(4), 2)):
        free = [8 * (2 * c + h) for c in range(4) if c not in (a, b) for h in range(2)]
        finer += [(k, 6 * (k + 1) + j, masks[k] | (0xFF << free[c]) | (0xFF << free[d])) for j, (c, d) in enumerate(combinations(range(4), 2))]
    large = sized.where(F.col("n") > LIMIT)
    by_band = [F.when(F.col("band") == k, F.array(*(F.struct(F.lit(band).alias("band"), key(mask).alias("key")) for own, band, mask in finer if own == k))) for k in range(len(masks))]
    again = large.select("fp", F.explode(F.coalesce(*by_band)).alias("x")).select("x.band", "x.key", "fp")
    return _compared(once.unionByName(again), radius)


def _compared(buckets: DataFrame, radius: int) -> DataFrame:
    """Edges found in the buckets (band, key, fp).  The number of partitions is the session's: few bytes make much work
    here, so partitions are not to be merged by size."""
    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = buckets.repartition(n, "band", "key").sortWithinPartitions("band", "key", "fp")
    return dealt.mapInArrow(_compare(radius), "u long, v long").distinct()


def _classes(prints: DataFrame, edges: DataFrame, node: str = "fp") -> DataFrame:
    """(doc_id, fp, component_id) of the rows of ``prints`` under edges between values of ``node``."""
    each = prints.groupBy(F.col(node).alias("_own")).agg(F.min("doc_id").alias("least"))
    found = components(edges)
    classed = each.join(found, each["_own"] == found["node"], "left").select("_own", "least", F.coalesce("root", "_own").alias("root"))
    named = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(classed, named, ["root"]).select("_own", "component_id")  # a root may have any number of members
    return spread_join(prints.withColumn("_own", F.col(node)), named, ["_own"]).select("doc_id", "fp", "component_id")  # a node any number of rows


def near_classes(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: components of 'at most ``radius`` (0 to 2) bits differ', complete."""
    prints = written(fingerprints(docs, size), "fingerprints")
    return _classes(prints, links(prints.select("fp").distinct(), radius))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    own = shingles(text, size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in own), np.uint64, len(own)))


def _name(own: np.ndarray) -> int:
    """Texts of one shingle set share this 64-bit name."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def _blocked(size: int, tables: int):
    factors = mix(np.arange(1, tables + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            n = batch.num_rows
            prints, names, least, held = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, tables), np.uint64), np.zeros(n, np.int64)
            for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
                digest = shingle_set(text.as_py() or b"", size)
                names[k], held[k] = _name(digest), digest.nbytes
                if len(digest):
                    prints[k] = _fold(digest)
                    least[k] = [(digest * f).min() for f in factors]
            flat = pa.array(least.view(np.int64).reshape(-1))
            keys = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, tables, dtype=np.int32), flat)
            yield pa.record_batch({"doc_id": batch.column(0), "th": batch.column(2), "fp": prints.view(np.int64), "id": names.view(np.int64), "keys": keys, "bytes": held})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            own = [shingle_set(x.as_py() or b"", size) for x in batch.column(0).cast(pa.large_binary())]
            names = np.fromiter((_name(x) for x in own), np.uint64, len(own))
            yield pa.record_batch({"id": names.view(np.int64), "hashes": pa.array([x.tobytes() for x in own], pa.binary())})

    return run


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut where a key (the first ``width`` columns, sorted) ends, with the starts of the keys."""
    kept: list[pa.RecordBatch] = []

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(width)], axis=1)
        return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = cut(batch)
        key = lambda x, k: [x.column(c)[k].as_py() for c in range(width)]
        goes_on = bool(kept) and key(kept[-1], kept[-1].num_rows - 1) == key(batch, 0)
        if goes_on and len(new) == 1:
            kept.append(batch)
            continue
        last = int(new[-1])  # the last key may go on in the next batch
        if kept:
            if goes_on:
                kept.append(batch.slice(0, int(new[1])))
            yield joined(), np.zeros(1, np.int64)
            if goes_on:
                batch, last, new = batch.slice(int(new[1])), last - int(new[1]), new[1:] - new[1]
        if last:
            yield batch.slice(0, last), new[:-1]
        kept = [batch.slice(last)]
    if kept:
        yield joined(), np.zeros(1, np.int64)


def _blocks(nodes: DataFrame) -> DataFrame:
    """(band, key, i, j, id, fp): the blocks of two nodes or more.

    A block of more than ``LIMIT`` nodes, or more than ``LIMIT_BYTES`` of their shingle hashes (column bytes, if there), is
    dealt into parts of half of that, and any two parts i < j meet in one bucket: every pair is compared, a bucket holds
    about the limit whatever the texts' lengths, and a node of a block of p parts is in p - 1 buckets.
    """
    held = F.col("bytes") if "bytes" in nodes.columns else F.lit(0)
    table = nodes.select("id", "fp", held.cast("long").alias("bytes"), F.posexplode("keys").alias("band", "key"))
    sizes = table.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("b")).where("m > 1")
    sized = table.join(sizes, ["band", "key"])
    zero = F.lit(0).cast("long")
    fits = (F.col("m") <= LIMIT) & (F.col("b") <= LIMIT_BYTES)
    once = sized.where(fits).select("band", "key", zero.alias("i"), zero.alias("j"), "id", "fp")
    parts = F.greatest(F.ceil(F.col("m") * 2 / LIMIT), F.ceil(F.col("b") * 2 / LIMIT_BYTES), F.lit(2).cast("long"))
    dealt = sized.where(~fits).withColumn("p", parts).withColumn("own", F.expr("pmod(xxhash64(id), p)"))
    other = dealt.withColumn("q", F.explode(F.sequence(zero, F.col("p") - 1))).where("q != own")
    return once.unionByName(other.select("band", "key", F.least("own", "q").alias("i"), F.greatest("own", "q").alias("j"), "id", "fp"))


def _candidates(radius: int, small: int = 96):
    """Groups (group, id, fp) that 'at most ``radius`` bits differ' links in a block, named by their members, so that the
    blocks which find the same group name it alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in _by_key(batches, BLOCK_KEYS):
            ids, prints = (batch.column(BLOCK_KEYS + k).to_numpy() for k in range(2))
            prints = prints.view(np.uint64)
            sizes = np.diff(np.append(cuts, len(ids)))
            root = np.full(len(ids), -1)
            few = np.flatnonzero(np.repeat(sizes <= small, sizes))
            parts = [(few, small_forests(prints[few], np.repeat(np.arange(len(cuts)), sizes)[few], radius))] if len(few) else []
            parts += [(np.arange(low, low + size), forest(prints[low : low + size], radius)) for low, size in zip(cuts[sizes > small], sizes[sizes > small], strict=True)]
            for at, (members, roots) in parts:
                root[at[members]] = at[roots]
                root[at[roots]] = at[roots]
            linked = np.flatnonzero(root >= 0)
            linked = linked[np.lexsort((ids[linked], root[linked]))]
            starts = np.flatnonzero(np.diff(root[linked], prepend=-1))
            lengths = np.diff(np.append(starts, len(linked)))
            names = [xxhash.xxh64_intdigest(ids[linked[low : low + n]].tobytes(), SEED) for low, n in zip(starts, lengths, strict=True)]
            group = np.repeat(np.array(names, np.uint64), lengths).view(np.int64)
            yield pa.record_batch({"group": group, "id": ids[linked], "fp": prints[linked].view(np.int64)})

    return run


def exact_forest(prints: np.ndarray, flat: np.ndarray, starts: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of 'Jaccard similarity at least ``similarity``' among the sets flat[starts[k] : starts[k + 1]],
    breadth first; a pair is counted where at most ``radius`` bits differ and the sizes allow it."""
    n, sizes = len(prints), np.diff(starts)
    names, flat = np.unique(flat, return_inverse=True)
    marked, free, members, roots = np.zeros(len(names), bool), np.ones(n, bool), [], []
    while free.any():
        root = int(np.argmax(free))
        free[root] = False
        queue = [root]
        while queue:
            own = queue.pop()
            fits = free & (np.bitwise_count(prints ^ prints[own]) <= radius) & (np.minimum(sizes, sizes[own]) >= similarity * np.maximum(sizes, sizes[own]) - 1e-6)
            at = np.flatnonzero(fits)
            step = max(1, (1 << 22) // int(sizes[own] / similarity + 2))
            for low in range(0, len(at), step):
                some = at[low : low + step]
                ends = np.cumsum(sizes[some])
                where = np.repeat(starts[some] - ends + sizes[some], sizes[some]) + np.arange(ends[-1])
                marked[flat[starts[own] : starts[own + 1]]] = True
                both = np.add.reduceat(marked[flat[where]], ends - sizes[some], dtype=np.int64)
                marked[flat[starts[own] : starts[own + 1]]] = False
                near = some[both / (sizes[own] + sizes[some] - both) >= similarity]
                free[near] = False
                queue += near.tolist()
                members.append(near)
                roots.append(np.full(len(near), root))
    none = np.zeros(0, int)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def _confirmed(radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in _by_key(batches, 1):
            ids, prints = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            data, offsets = bytes_of(batch.column(3))
            flat, offsets = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high in zip(cuts, np.append(cuts[1:], len(ids)), strict=True):
                a, b = exact_forest(prints[low:high], flat[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], radius, similarity)
                u.append(ids[low:high][a])
                v.append(ids[low:high][b])
            yield pa.record_batch({"u": np.concatenate(u), "v": np.concatenate(v)})

    return run


def similar_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8, tables: int = 8) -> DataFrame:
    """(doc_id, fp, component_id) of every row: components of 'the sets of ``size``-word shingles have a Jaccard similarity
    of ``similarity`` at least'.

    Texts of one shingle set are one node.  Blocks are the nodes whose smallest shingle hash agrees under one of
    ``tables`` orders, which a pair of similarity j misses with (1-j)**tables (0.8: 3 in a million).  In a block the
    bit-sliced comparison finds candidates within ``WIDE`` bits of the sets' fingerprints, and the candidates are compared
    exactly, by the shingle hashes of their texts.  Blocks of any size are compared completely (``_blocks``).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_or_empty()
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    prints = written(texts.mapInArrow(_blocked(size, tables), f"doc_id {kind}, th long, fp long, id long, keys array<long>, bytes long"), "fingerprints")
    nodes = prints.groupBy("id").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes"))
    table = _blocks(nodes)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = table.columns[:BLOCK_KEYS]
    dealt = table.repartition(parts, *names).sortWithinPartitions(*names, "id")
    groups = written(dealt.mapInArrow(_candidates(WIDE), "group long, id long, fp long").distinct(), "candidates")
    # the texts of candidates, one for each node; the join's key holds doc_id too, so copies of a text are spread
    wanted = prints.groupBy("id").agg(F.min(F.struct("th", "doc_id")).alias("x")).join(groups.select("id").distinct(), "id", "left_semi")
    wanted = wanted.select(F.col("x.th").alias("_th"), F.col("x.doc_id").alias("_id")).distinct()
    sets = texts.join(wanted, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = sets.mapInArrow(_sets(size), "id long, hashes binary").dropDuplicates(["id"])
    shown = groups.join(sets, "id").select("group", "id", "fp", "hashes")
    edges = shown.repartition(parts, "group").sortWithinPartitions("group", "id").mapInArrow(_confirmed(WIDE, similarity), "u long, v long").distinct()
    return _classes(prints.select("doc_id", "fp", "id"), edges, "id")


def drop_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near copies.

    Rows that share a doc_id can't be told apart: they stay or go together.  Rows without a doc_id stay only in groups
    that have no other.
    """
    classes = similar_classes(docs, size, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = classes.select(F.col("doc_id").alias("_id")).distinct()
    own, name = private(docs)
    return own.join(kept, F.col(name["doc_id"]).eqNullSafe(F.col("_id")), "left_semi").toDF(*docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document; 3-word shingles, radius 2."""
    found = near_classes(read_table(spark, sf_dir, "documents"), 3, RADIUS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
