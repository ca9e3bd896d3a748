"""Helpers shared by the operators: the shared folder, word and shingle hashes, column-block payloads."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Java pattern of the characters that separate words: space, tab, line feed, vertical tab, form feed, return.
WORD_GAP = "[ \\t-\\r]+"

#: Bits, at most, of the Bloom filters that spare most rows the way through a shuffle, and the bits of a slice (as a power of two).
BLOOM_BITS, _SLICE = 1 << 28, 16

_OWN: list[tempfile.TemporaryDirectory] = []
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a temporary one in local mode (tests), else an error: executors would not share it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.TemporaryDirectory(prefix="fieldspark-", ignore_cleanup_errors=True)
        _OWN.append(own)
        atexit.register(own.cleanup)
        sc.setCheckpointDir(own.name)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fieldspark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and a lost executor loses nothing.

    Within ``scratch`` the table goes at its end, unless it is to be kept, and then with the scratch around that, if any.
    """
    path = new_path(df.sparkSession, name)
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that ``stored`` writes within go at the end: nothing that outlives it may read them."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input, for sizing exchanges only; 0 where it knows nothing useful."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def block_count(df: DataFrame, target_bytes: int = 4 << 20) -> int:
    """Column blocks for an exchange: at least the shuffle partitions, and one for each ``target_bytes`` of input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, input_bytes(df) // target_bytes))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, A-Z lower-cased: what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; with fewer words, of the whole sequence."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - width + 1
    acc = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(width):
        acc = mix(acc ^ h[i : i + n])
    return np.unique(acc)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(*columns: np.ndarray) -> bytes:
    """Equally long numpy columns as one compressed payload."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(payload: bytes, *dtypes: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = len(raw) // sum(np.dtype(t).itemsize for t in dtypes)
    out, at = [], 0
    for t in dtypes:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def repeated(key: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """The rows whose key stands more than once, sorted by key; a first sort by the key alone spares the others any more."""
    order = np.argsort(key)
    _, length = runs(key[order])
    keep = order[np.repeat(length, length) > 1]
    return [key[keep], *(c[keep] for c in columns)]


def split_blocks(block: np.ndarray, *columns: np.ndarray):
    """(block, payload) for each block that has rows."""
    if len(block) and block.max() < 1 << 16:
        block = block.astype(np.uint16)  # sorted by radix
    order = np.argsort(block, kind="stable")
    block = block[order].astype(np.int64)
    columns = [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges], [*edges, len(block)], strict=True):
        if b > a:
            yield int(block[a]), pack(*(c[a:b] for c in columns))


def chunks_of(batches, *dtypes: str, most: int = 1 << 21):
    """(block, whether it ends, columns) of an exchanged partition, which is sorted by block: at most about ``most`` rows in memory at once."""
    at, held, size = None, [], 0

    def joined():
        return [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.empty(0, t) for t in dtypes]

    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if block != at and at is not None:
                yield at, True, joined()
                held, size = [], 0
            elif size >= most:
                yield at, False, joined()
                held, size = [], 0
            at = block
            held.append(unpack(payload.as_py(), *dtypes))
            size += len(held[-1][0])
    if at is not None:
        yield at, True, joined()


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    start = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_keys)))


def exchange(df: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, payload) dealt out by block and sorted by it."""
    return df.repartition(max(1, min(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)), "block").sortWithinPartitions("block")


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def released(run):
    """``run``, a function over record batches, giving memory back when its task ends: Python workers outlive their tasks."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every libc can
                ctypes.CDLL(None).malloc_trim(0)

    return own


def sliced(batches, rows: int = 512):
    """Record batches in slices of at most ``rows`` rows, so that long texts are never many at once in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bloom_bits(keys: int) -> int:
    """Bits of a filter: sixteen for each key, as a power of two between 2**20 and ``BLOOM_BITS``, so its broadcast is bounded."""
    return min(BLOOM_BITS, max(1 << 20, 1 << (16 * keys - 1).bit_length() if keys else 0))


def _places(k: np.ndarray, bits: int):
    k = mix(k.astype(np.int64).view(np.uint64))
    for salt in (0, 21, 40):
        yield ((k >> np.uint64(salt)) ^ (k << np.uint64(64 - salt) if salt else np.uint64(0))) & np.uint64(bits - 1)


def bloom(keys: DataFrame, column: str) -> bytes:
    """A filter over a column of longs: no false negatives, and more false positives where its bound is reached.

    Each task gives the slices that it has set; slices are put together by their number, and the driver joins them.
    """
    bits = bloom_bits(keys.count())

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            k = batch.column(0).drop_null().to_numpy()
            for at in _places(k, bits):
                at = np.unique(at)
                part = (at >> np.uint64(_SLICE)).astype(np.int64)
                start, length = runs(part)
                for a, n in zip(start, length, strict=True):
                    own = held.setdefault(int(part[a]), np.zeros(1 << (_SLICE - 3), np.uint8))
                    low = at[a : a + n] & np.uint64((1 << _SLICE) - 1)
                    np.bitwise_or.at(own, (low >> np.uint64(3)).astype(np.int64), (1 << (low & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())], names=["part", "bits"])

    def merged(batches):
        at, own = None, None
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(zlib.decompress(raw), np.uint8)
                if part == at:
                    own = own | v
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "bits"])
                at, own = part, v
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "bits"])

    slices = keys.select(F.col(column).cast("long").alias("k")).mapInArrow(released(run), "part int, bits binary")
    total = np.zeros(bits >> 3, np.uint8)
    joined = slices.repartition("part").sortWithinPartitions("part").mapInArrow(merged, "part int, bits binary")
    # an iterator runs a job for each partition, also for empty ones; up to 8 MiB come at once
    for row in joined.collect() if bits <= 1 << 26 else joined.toLocalIterator():
        v = np.frombuffer(row.bits, np.uint8)
        total[row.part << (_SLICE - 3) : (row.part << (_SLICE - 3)) + len(v)] = v
    return total.tobytes()


def maybe(filled: bytes, k: np.ndarray) -> np.ndarray:
    held = np.frombuffer(filled, np.uint8)
    out = np.ones(len(k), bool)
    for at in _places(k, len(held) << 3):
        out &= (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def matched(rows: DataFrame, names: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``names`` (one row for each key, with the number of its rows in ``count``, which is dropped).

    At most a thousand keys can stand in more than a thousandth of all ``total`` rows, so these names are broadcast; the
    rows of all others meet their names in a shuffle, none of whose keys has more rows than that.
    """
    often = max(1, total // 1000)
    hot = F.broadcast(names.where(F.col(count) > often).drop(count))
    rest = names.where(F.col(count) <= often).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key, "left"), allowMissingColumns=True)
