"""Substring dedup by recompression.

A text is a sequence of word names.  A round replaces every maximal run of one symbol by a symbol named by
(symbol, length), then every adjacent pair (left, right) of a two-colouring of the symbols by a symbol named by the
pair.  A name is a fixed 64-bit mix of what it stands for, so all executors give equal substrings equal symbols and
no round has to agree on a dictionary by an exchange.  Beside its name a symbol carries the stretch of words that
decided it (its context): wherever these words occur, the same symbol stands at the same place, whatever surrounds
them.  Every window of ``window`` words thus holds symbols that are its own; it picks the one of the highest level,
then the smallest name, then the leftmost, as its anchor, so equal windows pick equal anchors.

1. *Reveal.*  Consecutive windows with one anchor form a stretch; the anchor's key holds the symbol and the words that
   surround it.  Keys are counted (a 32-bit name each), and those seen twice are marked in a bit table of fixed size
   (8 MB), which is broadcast: a false mark only lets a stretch take part for nothing, a full table lets all take part.
   Stretches with marked keys are listed with their content's name and a check, XXH3 of the words' bytes, and counted by
   (key, content, check).  Those seen twice repeat as a whole.
2. *Verify.*  A stretch whose anchor repeats while its content doesn't (the ends of a repeat) is opened into its
   windows; those are counted by (key, content, check) against the windows of one stretch of every other content.
3. The spans found are joined to their documents.

Only anchors are counted (about one in nine words) and only repeating ones exchanged.  Counts are aggregated before the
exchange, and AQE can split the joins on what may be hot (a common key, a common window).  Windows are judged on
the input.

Defined results: null texts are empty; documents of under ``window`` words lose nothing; rows that repeat (doc_id and
text too) are rows of their own and thus copies of each other; null doc_ids are allowed; a document of 2**28 words or
more raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RunningHash, bit_table, blocks, bytes_of, checks, drop_written, marked, mix, private, read_table, sliding_min, spread_join, squeezed, text_or_empty, word_bounds, word_names, written

WINDOW = 35
ROUNDS = 3
FAR = 1 << 40
POSITION_BITS = 28


def recompress(sym: np.ndarray, first: np.ndarray, last: np.ndarray, cs: np.ndarray, ce: np.ndarray, level: int):
    """One round over the symbols of many documents: runs, then pairs.  cs, ce: context, first and one past the last word."""
    n = len(sym)
    same = np.zeros(n, bool)
    same[1:] = (sym[1:] == sym[:-1]) & ~first[1:]
    heads = np.flatnonzero(~same)
    tails = np.append(heads[1:], n) - 1
    length = (tails - heads + 1).astype(np.uint64)
    run = sym[heads]
    run = np.where(length > 1, mix(run * np.uint64(0x9FB21C651E98DF25) + length), run)
    cs = np.where(first[heads], -FAR, cs[np.maximum(heads - 1, 0)])
    ce = np.where(last[tails], FAR, ce[np.minimum(tails + 1, n - 1)])
    first, last, sym, n = first[heads], last[tails], run, len(heads)

    left = (mix(sym ^ np.uint64(0x632BE59BD9B4E019 * (level + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
    pair = np.zeros(n, bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~last[:-1]
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    after, before = np.append(np.arange(1, n), n - 1), np.maximum(np.arange(n) - 1, 0)
    ce = np.where(pair, ce[after], np.where(left, np.where(last, FAR, ce[after]), ce))
    cs = np.where(left, cs, np.where(first, -FAR, cs[before]))
    named = np.where(pair, mix(sym * np.uint64(0xC2B2AE3D27D4EB4F) + mix(sym[after] + np.uint64(level + 1))), sym)
    last = np.where(pair, last[after], last)
    keep = ~second
    return named[keep], first[keep], last[keep], cs[keep], ce[keep]


def anchors(names: np.ndarray, bounds: np.ndarray, window: int, rounds: int = ROUNDS):
    """Position and symbol of the anchors, and the first and last start of the windows that picked each."""
    reach = max(1, window * 16 // 35)
    n = len(names)
    if n >= 1 << POSITION_BITS:
        raise ValueError(f"a document has more than {1 << POSITION_BITS} words")
    sizes = np.diff(bounds)
    starts = np.zeros(n, bool)
    starts[bounds[:-1][sizes > 0]] = True
    ends = np.zeros(n, bool)
    ends[bounds[1:][sizes > 0] - 1] = True
    place = np.arange(n, dtype=np.int64)

    def rank(level: int, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        high = np.uint64(rounds - level) << np.uint64(62)
        return high | (mix(sym) >> np.uint64(30)) << np.uint64(POSITION_BITS) | at.astype(np.uint64)

    score = rank(0, names, place)
    state = (names, starts, ends, place, place + 1)
    for level in range(1, rounds + 1):
        state = recompress(*state, level)
        sym, _, _, cs, ce = state
        fit = ce - cs <= reach
        np.minimum.at(score, cs[fit], rank(level, sym[fit], cs[fit]))
    best = sliding_min(score, window - reach + 1)
    valid = np.ones(n, bool)
    for back in range(1, window):  # the last window-1 words of each document start no window
        at = bounds[1:] - back
        valid[at[at >= bounds[:-1]]] = False
    at = np.flatnonzero(valid)
    best = best[at]
    new = np.ones(len(at), bool)
    new[1:] = best[1:] != best[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1 if len(at) else head
    position = (best[head] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    return position, best[head] >> np.uint64(POSITION_BITS), at[head], at[tail], reach


def _anchors_of(batch: pa.RecordBatch, window: int):
    data, offsets = bytes_of(batch.column(batch.schema.get_field_index("text")))
    starts, ends, bounds = word_bounds(data, offsets)
    names = word_names(data, starts, ends)
    position, symbol, a, b, reach = anchors(names, bounds, window)
    content = RunningHash(names)
    key = mix(content.slices(position, position + reach) ^ symbol)
    return (data, starts, ends), content, bounds, key, position, a, b


def _name_keys(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            key = _anchors_of(batch, window)[3]
            names, n = np.unique((key >> np.uint64(32)).astype(np.int64), return_counts=True)
            yield pa.record_batch({"name": names, "n": np.minimum(n, 2).astype(np.int64)})

    return run


def _list_stretches(window: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in blocks(batches):
            words, content, bounds, key, position, a, b = _anchors_of(batch, window)
            own = marked(marks, key)
            key, position, a, b = (x[own] for x in (key, position, a, b))
            if not len(key):
                continue
            whole = mix(content.slices(a, b + window) + (position - a).astype(np.uint64))
            row = np.searchsorted(bounds, a, "right") - 1
            at = pa.array(row)
            yield pa.record_batch(
                {
                    "key": key.view(np.int64),
                    "content": whole.view(np.int64),
                    "check": checks(squeezed(*words), a, b + window).view(np.int64),
                    "doc": batch.column(0).take(at),
                    "th": batch.column(1).take(at),
                    "a": (a - bounds[row]).astype(np.int32),
                    "n": (b - a + window).astype(np.int32),
                }
            )

    return run


def _open_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = bytes_of(batch.column(2))
            starts, ends, bounds = word_bounds(data, offsets)
            content, text = RunningHash(word_names(data, starts, ends)), squeezed(data, starts, ends)
            spans = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            spans = spans.flatten()
            key, a, n, judged = (spans.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            count = n - window + 1
            of = np.repeat(np.arange(len(a)), count)
            within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            start = a[of] + within
            at = bounds[row[of]] + start
            doc = pa.array(row[of])
            yield pa.record_batch(
                {
                    "key": key[of],
                    "content": content.slices(at, at + window).view(np.int64),
                    "check": checks(text, at, at + window).view(np.int64),
                    "doc": batch.column(0).take(doc),
                    "th": batch.column(1).take(doc),
                    "a": start.astype(np.int32),
                    "judged": judged[of],
                }
            )

    return run


def _documents(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def _same_document(left: DataFrame, right: DataFrame):
    return (left["th"] == right["th"]) & left["doc"].eqNullSafe(right["doc"])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, th, spans): word spans (a, n) covered by a window that starts elsewhere too; th: xxhash64 of the text."""
    source = _documents(docs)
    doc_type = source.schema["doc"].dataType.simpleString()
    same = ["key", "content", "check"]
    twice = source.mapInArrow(_name_keys(window), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    marks = docs.sparkSession.sparkContext.broadcast(bit_table(twice))
    listed = written(source.mapInArrow(_list_stretches(window, marks), f"key long, content long, check long, doc {doc_type}, th long, a int, n int"), "listed")
    seen = listed.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    keys = seen.groupBy("key").agg(F.sum("copies").alias("in_key"), F.count(F.lit(1)).alias("kinds")).where("in_key > 1")
    seen = spread_join(seen, keys, ["key"]).select(*same, (F.col("copies") > 1).alias("whole"), (F.col("kinds") > 1).alias("mixed"))
    found = written(spread_join(listed, seen, same), "stretches")
    drop_written(listed)
    whole = found.where("whole").select("doc", "th", "a", "n")
    # the ends of repeats, and one stretch of each content that stands for its copies
    alone = found.where("not whole").select("doc", "th", F.struct("key", "a", "n", F.lit(True).alias("judged")).alias("span"))
    one = found.where("whole and mixed").groupBy(*same).agg(F.min(F.struct("th", "a", "n", "doc")).alias("one"))
    one = one.select("one.doc", "one.th", F.struct("key", "one.a", "one.n", F.lit(False).alias("judged")).alias("span"))
    asked = alone.unionByName(one).groupBy("doc", "th").agg(F.collect_list("span").alias("spans"))
    opened = source.join(asked, _same_document(source, asked)).select(source["doc"], source["th"], "text", "spans")
    windows = written(opened.mapInArrow(_open_windows(window), f"key long, content long, check long, doc {doc_type}, th long, a int, judged boolean"), "windows")
    again = windows.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(*same)
    ends = spread_join(windows.where("judged"), again, same).select("doc", "th", "a", F.lit(window).alias("n"))
    return whole.unionByName(ends).distinct().groupBy("doc", "th").agg(F.collect_list(F.struct("a", "n")).alias("spans"))


def covered(n: int, spans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words (or bytes) the spans cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, spans, 1)
    np.add.at(steps, spans + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def with_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs``, columns renamed by ``private``, with a column ``_spans`` of what to remove; null where nothing is."""
    spans = repeated_spans(docs, window)
    own, name = private(docs)
    keyed = own.withColumns({"_th": F.xxhash64(text_or_empty(name["text"]))})
    spans = spans.select(F.col("doc").alias("_doc"), F.col("th").alias("_th2"), F.col("spans").alias("_spans"))
    return keyed.join(spans, (F.col("_th") == F.col("_th2")) & F.col(name["doc_id"]).eqNullSafe(F.col("_doc")), "left").drop("_th", "_th2", "_doc")


def _masks(batch: pa.RecordBatch, counts: np.ndarray) -> Iterator[np.ndarray | None]:
    spans = batch.column(batch.schema.get_field_index("_spans"))
    edges, flat = spans.offsets.to_numpy(), spans.values
    a, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    for k, count in enumerate(counts):
        low, high = edges[k], edges[k + 1]
        yield covered(int(count), a[low:high], n[low:high]) if high > low else None


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every repeated passage cut out of ``text`` (what stands between kept words stays); ``n_chars`` follows where it exists."""

    own, name = private(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, name["text"]):
            at = batch.schema.get_field_index(name["text"])
            data, offsets = bytes_of(batch.column(at))
            starts, ends, bounds = word_bounds(data, offsets)
            new = batch.column(at).to_pylist()
            for k, gone in enumerate(_masks(batch, np.diff(bounds))):
                if gone is not None:
                    s, low, high = starts[bounds[k] : bounds[k + 1]], offsets[k], offsets[k + 1]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~gone, [False]])))
                    stop = np.append(s, high)
                    new[k] = bytes(b"".join(data[s[i] : stop[j]].tobytes() for i, j in zip(edges[::2], edges[1::2], strict=True))).decode().rstrip() if len(edges) else ""
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_spans"}
            columns[name["text"]] = pa.array(new, pa.string())
            if "n_chars" in name:
                columns[name["n_chars"]] = pa.array([None if x is None else len(x) for x in new], columns[name["n_chars"]].type)
            yield pa.record_batch(columns)

    return with_spans(docs, window).mapInArrow(cut, own.schema).toDF(*docs.columns)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        words = [(x or b"").split() for x in texts]
        removed, kept = [], []
        for own, gone in zip(words, _masks(batch, np.array([len(x) for x in words])), strict=True):
            removed.append(0 if gone is None else int(gone.sum()))
            kept.append(hashlib.sha256(b" ".join(own if gone is None else compress(own, ~gone))).hexdigest())
        yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array([len(x) for x in words], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document under windows of 35 words."""
    return digest(read_table(spark, sf_dir, "documents"), WINDOW)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return with_spans(docs, window).toDF("doc_id", "text", "_spans").mapInArrow(_digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


SQL = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT rid, unnest(range(1, len(words) - 33)) AS a, words FROM w WHERE len(words) >= 35),
k AS (SELECT rid, a, md5(array_to_string(words[a:a + 34], ' ')) AS h FROM g),
twice AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
s AS (SELECT rid, list(a) AS starts FROM k WHERE h IN (SELECT h FROM twice) GROUP BY rid),
c AS (SELECT DISTINCT rid, a + d AS p FROM (SELECT rid, unnest(starts) AS a FROM s), range(35) t(d)),
r AS (SELECT rid, list(p) AS gone, count(*) AS n FROM c GROUP BY rid),
q AS (SELECT w.rid, list(x.word ORDER BY x.i) AS kept FROM w, (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w) x
      WHERE x.rid = w.rid AND NOT EXISTS (SELECT 1 FROM c WHERE c.rid = x.rid AND c.p = x.i) GROUP BY w.rid)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(q.kept, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (rid) LEFT JOIN q USING (rid)
""",
}
