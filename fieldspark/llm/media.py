"""Media columns: payloads stored as 8-bit grey PNG members of archives, read back by a custom Spark data source.

Writing: each task writes one archive to the shared folder (members one after another, then a directory of them) and
returns a row about it; the driver's commit file names the archives of tasks that ended well, so archives of lost or
repeated attempts are never read. Reading: the source plans byte ranges over the committed archives, each range reads
the directory, takes the members that start in it, streams them as Arrow batches and retries each member by its offset.

Null and empty texts give 64 zero bytes. Rows without an id keep a null id. Repeated rows are members of their own, with
equal values; there are no ties. Texts of any length are stored whole, one member at a time. An empty table gives no rows,
and an archive folder with an empty commit file. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path, remove, sliced, stored

UNIT, RANGE_BYTES, TRIES, BATCH_BYTES = 64, 16 << 20, 3, 4 << 20
_PNG = b"\x89PNG\r\n\x1a\n"
_ENTRY = np.dtype([("id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u4"), ("crc", "<u4")])
_FOOT = "<QQ8s"
_MAGIC = b"FSPKARC1"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with zero bytes to a positive multiple of 64, and the length before padding."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def png(payload: bytes) -> bytes:
    """A grey 8-bit image, 64 samples a row."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(media: bytes) -> bytes:
    """The samples of an image that ``png`` made; ValueError if it is damaged."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, b"", None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Sixteen levels of the histogram as hex bytes of their share, then mean and deviation in hundredths."""
    a = np.frombuffer(payload, np.uint8)
    counts = np.bincount(a, minlength=256)
    total, squares = int((counts * np.arange(256)).sum()), int((counts * np.arange(256) ** 2).sum())
    n = len(a)
    levels = counts.reshape(16, 16).sum(1) * 255 // n
    variance = (squares * n - total * total) / (n * n)
    return "".join(f"{int(x):02x}" for x in levels) + f":{total * 100 // n}:{int(variance**0.5 * 100)}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a Hadoop-style URI; a bare path is local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_archives(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> str:
    """Write every row's payload as an archive member; returns the folder, which holds a commit file."""
    spark = docs.sparkSession
    path = path or new_path(spark, "media")
    fs, own = open_fs(path)
    fs.create_dir(own, recursive=True)

    def run(batches):
        fs, own = open_fs(path)
        name = f"archive-{uuid.uuid4().hex}.bin"
        entries, at, out = [], 0, None
        for batch in sliced(batches, 256):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{own}/{name}")
                media = png(payload_of(t)[0])
                raw_length = len(t.encode("utf-8", "surrogatepass")) if t else 0
                member = struct.pack("<Q", raw_length) + media
                out.write(member)
                entries.append((i or 0, i is not None, at, len(member), zlib.crc32(member)))
                at += len(member)
        if out is not None:
            directory = np.array(entries, _ENTRY).tobytes()
            out.write(directory)
            out.write(struct.pack(_FOOT, at, len(entries), _MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "data_bytes": pa.array([at], pa.int64()), "members": pa.array([len(entries)], pa.int64())})

    # one row for each task that wrote: names of archives, never documents
    done = docs.select(F.col(f"`{id_column}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "archive string, data_bytes long, members long").collect()
    with fs.open_output_stream(f"{own}/_committed.json") as f:
        f.write(json.dumps([[r.archive, r.data_bytes, r.members] for r in done]).encode())
    return path


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    """Byte ranges over committed archives; a member belongs to the range that it starts in."""

    def __init__(self, path: str, range_bytes: int, tries: int):
        self.path, self.range_bytes, self.tries = path, range_bytes, tries

    def partitions(self):
        fs, own = open_fs(self.path)
        with fs.open_input_stream(f"{own}/_committed.json") as f:
            archives = json.loads(f.read())
        return [Range(name, a, min(a + self.range_bytes, size)) for name, size, _ in archives for a in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def _directory(self, fs, file: str) -> np.ndarray:
        with fs.open_input_file(file) as f:
            size = f.size()
            at, n, magic = struct.unpack(_FOOT, f.read_at(struct.calcsize(_FOOT), size - struct.calcsize(_FOOT)))
            if magic != _MAGIC:
                raise ValueError(f"{file}: no directory")
            return np.frombuffer(f.read_at(n * _ENTRY.itemsize, at), _ENTRY)

    def member(self, fs, file: str, offset: int, length: int, crc: int, handle: list) -> bytes:
        """One member by its offset. A failure reopens the file and tries this member again, no other."""
        for k in range(self.tries):
            try:
                if not handle:
                    handle.append(fs.open_input_file(file))
                data = handle[0].read_at(length, offset)
                if len(data) == length and zlib.crc32(data) == crc:
                    return data
                raise OSError(f"{file}: member at {offset} is damaged")
            except OSError:
                while handle:
                    handle.pop().close()
                if k == self.tries - 1:
                    raise
        raise AssertionError

    def read(self, part):
        if not part.archive:
            return
        fs, own = open_fs(self.path)
        file = f"{own}/{part.archive}"
        directory = self._directory(fs, file)
        lo, hi = np.searchsorted(directory["offset"], [part.start, part.end])
        handle: list = []
        rows, held = [], 0
        for e in directory[lo:hi]:
            member = self.member(fs, file, int(e["offset"]), int(e["length"]), int(e["crc"]), handle)
            rows.append((int(e["id"]) if e["has_id"] else None, part.archive, int(e["offset"]), struct.unpack_from("<Q", member)[0], member[8:]))
            held += len(member)
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)
        while handle:
            handle.pop().close()

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "archive", "offset", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").option("path", folder)``; options range_bytes and tries."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "doc_id long, archive string, offset long, n_bytes long, media binary"

    def reader(self, schema):
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("tries", TRIES)))


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("path", path).option("range_bytes", str(range_bytes)).load()


def media_features(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back and describe them. The archives go once the descriptions are written."""
    path = write_archives(docs, id_column, text)
    read = read_archives(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for batch in sliced(batches, 1024):
            rows = []
            for i, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = m.as_py()
                p = samples(media)
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(p)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    described = read.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    out = stored(described, "described")
    remove(docs.sparkSession, path)
    return out
