"""Packing along a space-filling curve.

Token ids of each document are projected by a hash to three coordinates, quantised and turned into a Hilbert key; rows
are range-partitioned and sorted by (key, doc_id), so neighbours on the curve, copies above all, stand together, and a
tie as large as a third of the rows is still cut between partitions by doc_id. Each partition cuts its run of tokens
every ``length`` tokens; only its last sequence is padded.

Partitions follow from all tokens (``TASK_TOKENS`` each), so a task stays as it is while the data grow. Null and empty
texts hold the end token alone. Repeated rows are packed each on its own; rows with a null doc_id are packed like others,
their pieces have a null doc_id. Documents of any length are encoded whole and cut where a sequence ends. An empty table
gives no pieces. Only the id and the text are read, so other columns may have any name. Encoding goes word by word through
a cache: the tokenizer drops white space and never joins across it, so this equals encoding the whole text.
"""

from __future__ import annotations

import os
from array import array
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, released, sliced, stored

LENGTH, END = 2048, 1
#: Bits of each coordinate of the curve, and how far a projection of typical size reaches towards the cube's faces.
BITS, DIMS, GAIN = 16, 3, 4.0
#: Sequences that a partition should hold at least, so that padding stays under a five-hundredth, and tokens that it holds at most, about.
SEQUENCES, TASK_TOKENS = 256, 1 << 24
#: Words whose ids a worker remembers, in each of two generations: words in use outlive those met once.
REMEMBERED = 400_000
_PUNCTUATION = b".,;:!?#$%&*-+=/\\()[]{}|<>@^_`~\""

_STATE: dict = {}


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies have for each byte: printable ones stand for themselves, others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Words' ids as bytes. A new word is taken from the older generation, put together from its parts, or encoded."""

    def __init__(self, tokenizer, unit: str):
        super().__init__()
        self.tokenizer, self.unit, self.old = tokenizer, unit, {}
        self.letters, self.model = _byte_letters(), tokenizer.model

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            core = word.rstrip(_PUNCTUATION)
            if core and len(core) < len(word) and self._ends_in_letter(core):
                ids = self[core] + self[word[len(core) :]]
            else:
                ids = array(self.unit, self._encode(word)).tobytes()
        self[word] = ids
        return ids

    @staticmethod
    def _ends_in_letter(core: bytes) -> bool:
        return core[-1:].isalnum() or core[-1] > 127 and normalize("NFC", core.decode("utf-8", "surrogatepass")).lower()[-1].isalpha()

    def _encode(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "surrogatepass")
        # a word of Latin letters is normal already and one run of letters: it goes to the merges at once
        if max(text) < "\u0250" and (low := text.lower()).isalpha():
            return [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Encoder:
    """Ids of UTF-8 texts, word by word through a cache.

    White space is dropped by the tokenizer and never joined across, and it lowers case itself, so equal words in lower
    case have equal ids. A word's closing ASCII punctuation is a token run of its own after a letter or digit, so a new
    word that ends in it is put together from its parts. Texts with the mark of a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.unit = unit_of(self.tokenizer.get_vocab_size())
        self.words = _Words(self.tokenizer, self.unit)

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        self.words.age()
        get, out = self.words.__getitem__, []
        for t in texts:
            if t and b"<|" in t:
                out.append(np.array(self.tokenizer.encode(t.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, self.unit))
            else:
                out.append(np.frombuffer(b"".join(map(get, t.lower().split())) if t else b"", self.unit))
        return out


def unit_of(size: int) -> str:
    """The type that holds ids of a vocabulary, as of array and numpy."""
    return "H" if size <= 1 << 16 else "I"


def encoder(path: str) -> Encoder:
    """The tokenizer is loaded once for each worker."""
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows, dims), after Skilling's transform: axes to transposed index, then interleaved."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _signs(ids: int) -> np.ndarray:
    """Hashed coordinates in (-1, 1) of the first ``ids`` ids."""
    i = np.arange(ids, dtype=np.uint64)[:, None] * np.uint64(DIMS) + np.arange(DIMS, dtype=np.uint64)
    return mix(i).astype(np.float64) / 2**63 - 1


def projections(ids: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """Mean hashed projection of each document's ids, as integer coordinates of the curve."""
    n = np.array([len(i) for i in ids])
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    mean = np.add.reduceat(signs[np.concatenate(ids)], start) / n[:, None]
    return np.minimum(((np.tanh(GAIN * mean) + 1) / 2 * 2**BITS).astype(np.int64), 2**BITS - 1)


def tokenized(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(doc_id, key, n, ids): ids with the end token in the vocabulary's unit, and the Hilbert key."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encode = encoder(path)
        last = np.array([end], encode.unit)
        signs = _signs(encode.tokenizer.get_vocab_size())
        for batch in sliced(batches, 512):
            if batch.num_rows:
                ids = [np.append(i, last) for i in encode(batch.column(1).cast(pa.binary()).to_pylist())]
                key = hilbert(projections(ids, signs), BITS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())], schema=schema)
        encode.words.forget()  # the worker may be kept for other tasks

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(run), "doc_id long, key long, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, id_column: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian unsigned 32-bit."""
    spark = docs.sparkSession
    # written once: the range partitioner samples its input before it shuffles it
    table = stored(tokenized(docs, path, id_column, text, end), "tokens")
    total = table.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_TOKENS), total // (length * SEQUENCES)))
    ordered = table.repartitionByRange(parts, "key", "doc_id", "n").sortWithinPartitions("key", "doc_id", "n", F.crc32("ids"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        sequence, at = TaskContext.get().partitionId() << 32, 0
        for batch in sliced(batches, 512):
            rows = []
            for doc_id, n, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                start, ids = 0, np.frombuffer(raw, unit_of(256 ** (len(raw) // n))).astype("<u4").tobytes()
                while start < n:
                    take = min(n - start, length - at)
                    rows.append((doc_id, start, take, ids[4 * start : 4 * (start + take)], n, sequence, at))
                    start, at = start + take, at + take
                    if at == length:
                        sequence, at = sequence + 1, 0
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return ordered.mapInArrow(released(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Pieces with a checksum in place of the ids."""
    return pack(docs, path).select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
