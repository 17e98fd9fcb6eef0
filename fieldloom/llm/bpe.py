"""BPE encoding and decoding of whole texts, with tree concatenation for long unsplit text.

A text is split by the tokenizer's own pre-tokenizer; merges never cross a split.  A split of more than ``LEAF`` bytes
is halved down to leaves, the leaves are encoded in parallel (two threads, 1.8 times as fast as one on ASCII; other leaves go
through the library, which keeps the interpreter's lock), and neighbours are joined from the bottom up: the last
tokens of the left and the first tokens of the right side are decoded and encoded again, the window doubling until its
first token is the left side's and its last token the right side's.  Then every pair of neighbours in the joined
sequence stands in a valid encoding, which makes the whole the encoding of the whole.

Ordinary texts take one call each.  Where the vocabulary's ids follow the order of its merges, texts of plain European
characters go through tiktoken, which is about five times as fast and gives the same ids; all others go through
tokenizers.

Defined results: null texts are empty (no tokens, the hash of the empty string); special-token strings in a text are
encoded as the library does; repeated rows are encoded alike.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import blocks, read_table

TOKENIZER = "byte_bpe_50k.json"
LEAF = 2048
# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The character that byte-level BPE writes for each byte: itself if printable, else the next free one from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def tree_encode(text: str, encode, sizes, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """Ids of one unsplit text.  encode(text) -> ids; sizes(id) -> the characters of text that the token covers."""
    pieces = [text]
    while max(map(len, pieces)) > leaf:
        pieces = [half for p in pieces for half in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > leaf else (p,))]
    parts = list((pool.map if pool else map)(encode, pieces))
    ends, at = [], 0
    for p in pieces:
        at += len(p)
        ends.append(at)
    starts = [0, *ends[:-1]]
    while len(parts) > 1:
        joined = []
        for k in range(0, len(parts) - 1, 2):
            joined.append((_join(text, parts[k], parts[k + 1], ends[k], encode, sizes), starts[k], ends[k + 1]))
        if len(parts) % 2:
            joined.append((parts[-1], starts[-1], ends[-1]))
        parts, starts, ends = ([x[i] for x in joined] for i in range(3))
    return parts[0]


def _join(text: str, left: list[int], right: list[int], middle: int, encode, sizes) -> list[int]:
    reach = 4
    while True:
        a, b = min(reach, len(left)), min(reach, len(right))
        window = encode(text[middle - sum(map(sizes, left[len(left) - a :])) : middle + sum(map(sizes, right[:b]))])
        if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
            return left[: len(left) - a] + window + right[b:]
        reach *= 2


class Codec:
    """Encoder and decoder of one tokenizers file, made once in a worker."""

    long_run = re.compile(rf"\S{{{LEAF}}}|\s{{{LEAF}}}")
    plain = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ſ–—‘-”…]")

    def __init__(self, path: str, leaf: int = LEAF):
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.leaf = leaf
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        of_id = {k: t for t, k in self.vocabulary.items()}
        names = set(self.special)
        self.raw = {k: t.encode() if t in names else bytes(byte_of[c] for c in t) for k, t in of_id.items()}
        self.names = [str(k) for k in range(max(of_id) + 1)]
        self.fast = self._fast(path, {v: k for k, v in self.raw.items() if of_id[k] not in names})
        self.pool = ThreadPoolExecutor(2)

    def _fast(self, path: str, ranks: dict[bytes, int]):
        """tiktoken over the same ranks, if the ids are the order of the merges."""
        import json

        import tiktoken

        with open(path) as f:
            merges = json.load(f)["model"]["merges"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        if all(self.vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)):
            return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        return None

    def _model(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def _leaf(self, piece: str) -> list[int]:
        """The same for a part of one split, in the characters that stand for its bytes (printable ASCII for itself).  tiktoken
        lets other threads run meanwhile, the library doesn't; a part of a split is of one class of characters, so tiktoken's
        own pattern leaves it whole."""
        return self.fast.encode_ordinary(piece) if self.fast is not None and piece.isascii() else self._model(piece)

    def _pieces(self, text: str) -> list[int]:
        ids: list[int] = []
        size = lambda k: len(self.raw[k])
        cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        for part in cut.split(text) if cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part) if part else ():
                ids += self._model(piece) if len(piece) <= self.leaf else tree_encode(piece, self._leaf, size, self.leaf, self.pool)
        return ids

    def encode(self, text: str) -> list[int]:
        if self.long_run.search(text):
            return self._pieces(text)
        if self.fast is not None and not self.plain.search(text):
            return self.fast.encode(text, allowed_special="all")
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[k] for k in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, out: str = "ids") -> DataFrame:
    """``docs`` with a column of ids; a column of that name is replaced."""
    docs = docs.drop(out)
    schema = StructType([*docs.schema.fields, StructField(out, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in blocks(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.record_batch([*batch.columns, pa.array([own.encode(t or "") for t in texts], pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, tokenizer: str = TOKENIZER, ids: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with its column of ids turned back into text (null ids: null)."""
    rest = [f for f in tokens.schema.fields if f.name not in (ids, out)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            lists = batch.column(len(rest)).to_pylist()
            yield pa.record_batch([*batch.columns[: len(rest)], pa.array([None if x is None else own.decode(x) for x in lists], pa.string())], names=[*(f.name for f in rest), out])

    return tokens.select(*(f.name for f in rest), ids).mapInArrow(run, schema)


def _digest(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        names = own.names
        for batch in blocks(batches):
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join([names[k] for k in ids]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())})

    return run


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_digest(tokenizer), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return round_trip(read_table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
