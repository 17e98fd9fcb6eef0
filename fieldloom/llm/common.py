"""Helpers shared by the training-data operators: tables in the shared folder, Arrow text buffers, 64-bit hashing.

Conventions of this subpackage
------------------------------
* A null text is the empty text.  Input columns that an operator doesn't name are ignored, so extra
  columns and columns that share a name with an internal one can't clash: every operator first
  projects what it reads onto private names.
* Words are maximal runs outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as one numpy block; a longer document makes its own block.
BLOCK_BYTES = (1 << 20) - 64


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a fresh local folder only where that is unset and the session is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fieldloom/{spark.sparkContext.applicationId}"


def drop_all_written(spark: SparkSession) -> None:
    """Delete every table that :func:`written` made in this application; what was computed lazily from them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` (round tables of iterative operators)."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed by position, and the new name of each: no column of the caller's can clash with an operator's.

    The caller's names come back with ``toDF(*docs.columns)``.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), {old: new for old, new in reversed(list(zip(docs.columns, names, strict=True)))}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contiguous UTF-8 bytes of a text column, and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type).cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if n else whole[:0], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; never splits a document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = bytes_of(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one entry more than rows)."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = offsets[1:-1] - 1
    before = before[before >= 0]
    last[before] |= inside[before]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_NAME = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls for blocks of the usual size."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, np.uint64)
        step = np.uint64(base)
        with np.errstate(over="ignore"):
            while len(known) < n:
                known = np.concatenate([known, known * step])
                step = step * step
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = known
    return known[:n]


class RunningHash:
    """Hashes of any slices of a sequence of 64-bit names from one running sum (polynomial modulo 2**64, then mixed)."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(names * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def every(self, width: int) -> np.ndarray:
        """Hashes of every ``width`` consecutive names, not mixed: their leading bits are good enough to choose by."""
        raw = self.sums[width:] - self.sums[:-width]
        raw *= self.inverse[: len(raw)]
        return raw

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


LANES = 8  # words of up to this many 8-byte lanes are hashed together, longer ones by XXH64


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of words: every 8-byte lane goes through a non-linear mix with what came before, so no arrangement of
    the bytes makes two words of one name likelier than chance.  Memory follows the words, not the bytes."""
    sizes = ends - starts
    names = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    live = np.flatnonzero(sizes <= 8 * LANES)
    at, left = starts[live], sizes[live]
    while len(live):
        lane = lanes[at]
        short = left < 8
        lane = np.where(short, lane & ((np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), lane)
        names[live] = mix((names[live] ^ lane) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes > 8 * LANES):
        names[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]])
    return names


def squeezed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space behind each, and where each begins (one entry more than words); long documents go in pieces."""
    sizes = ends - starts
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    out, at = np.full(begins[-1], 0x20, np.uint8), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
        part, own = data[starts[at] : ends[to - 1]], sizes[at:to]
        before = np.cumsum(own) - own
        out[np.repeat(begins[at:to] - before, own) + np.arange(int(own.sum()))] = part[~SPACE[part]]
        at = to
    return out, begins


def checks(text: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of the bytes of words start..end of squeezed text: names only say where to look, these compare what stands there."""
    data, begins = memoryview(text[0]), text[1]
    return np.fromiter((xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(begins[start].tolist(), begins[end].tolist(), strict=True)), np.uint64, len(start))


MARK_BITS = 26


def marked(marks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which 64-bit keys a bit table marks."""
    place = (key >> np.uint64(64 - MARK_BITS)).astype(np.int64)
    return (marks[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def bit_table(keys: DataFrame, bits: int = MARK_BITS) -> np.ndarray:
    """A table of fixed size (8 MB) with the leading ``bits`` of 32-bit names (column name): at most 2**(bits-6) rows come to the driver."""
    place = F.shiftright(F.col("name").cast("long"), 32 - bits)
    rows = keys.select(place.alias("p")).selectExpr("shiftright(p, 6) AS word", "shiftleft(1L, CAST(p & 63 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(1 << bits - 6, np.uint64)
    marks[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return marks


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi-join on columns without nulls that lets AQE split a key which many rows of ``left`` share.

    An aggregated ``right`` would lend its partitioning to the join, and the join then couldn't be split; a second key,
    fixed by the first, asks both sides for exchanges of their own right below the join.
    """
    fresh = lambda x: x.withColumn("_fresh", F.xxhash64(*on))
    return fresh(left).join(fresh(right), [*on, "_fresh"]).drop("_fresh")


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values by doubling; the tail beyond the end counts as the largest."""
    out, span = values.copy(), 1
    while span < width:
        step = min(span, width - span)
        out[:-step] = np.minimum(out[:-step], out[step:])
        span += step
    return out


def bound_by_arrow(spark: SparkSession) -> int:
    """Rows in an Arrow batch; batches are cut again by bytes in :func:`blocks`."""
    return int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
