"""Fuzzy line deduplication: MinHash of character shingles, high-recall banding, exact Jaccard, union-find.

Lines are compared in lower case with white space collapsed. Equal lines are one node from the start. A node's distinct
character shingles fill one-permutation MinHash bins (empty ones borrow from the next filled bin in a fixed walk); bands
of ``ROWS`` bins give ``BANDS`` posting keys, which find a pair at the threshold with probability over 0.99. Pairs are
verified by exact Jaccard of their shingle sets and joined by union-find (``linking``). Of each component the first line
by (doc_id, line number) stays; all others go from their documents.

A line is named by 64 bits; copies are told by 64 bits more. Lines without a character other than white space are no
lines of a component and stay. Null and empty texts, and rows with a null doc_id, stay as they are. Rows that share a
doc_id count as one document, so repeated rows keep the same lines; ties go to the least (doc_id, line number). A document
all of whose lines go is left out by ``dedup_lines``, as nothing of it remains. Lines and texts of any length are hashed
whole. An empty table gives no rows. Columns of any name may stand beside the id and the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import block_count, bloom, exchange, fresh, matched, maybe, mix, released, scratch, sliced, split_blocks, stored
from .linking import MET, link, met

#: Characters in a shingle, percent of Jaccard similarity, bands and MinHash values in a band.
WIDTH, PERCENT, BANDS, ROWS = 7, 80, 10, 4
BINS = BANDS * ROWS
_A = np.uint64(0x9E3779B97F4A7C15)
_A2 = np.uint64(0x9E3779B97F4A7C15**2 % 2**64)


def normal(line: str) -> str:
    low = line.lower().strip()
    # only a space is both white space and printable, so such a line has no other
    return low if low.isprintable() and "  " not in low else " ".join(low.split())


def names_of(line: str) -> tuple[int, int]:
    """A line's name and its proof, as two signed 64-bit integers."""
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def char_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles (WIDTH wide) of all lines, one after another, and how many each line has (one at least)."""
    flat = np.frombuffer("".join(x if len(x) >= WIDTH else x.ljust(WIDTH, "\0") for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.maximum(WIDTH, np.fromiter(map(len, lines), np.int64, len(lines)))
    # a polynomial over seven characters, by doubling: two, four, six, seven
    two = flat[:-1] * _A + flat[1:]
    four = two[:-2] * _A2 + two[2:]
    acc = (four[:-3] * _A2 + two[4:-1]) * _A + flat[6:]
    # windows that begin in a line's last characters reach into the next line
    keep = np.ones(len(acc), bool)
    end = np.cumsum(length)[:-1]
    for i in range(1, WIDTH):
        keep[end - i] = False
    return mix(acc[keep]), length - WIDTH + 1


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each line."""
    if not lines:
        return []
    h, count = char_hashes(lines)
    return [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])]


def signatures(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One-permutation MinHash, (lines, BINS)."""
    m = len(count)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(m * BINS, none, np.uint64)
    slot = np.repeat(np.arange(m, dtype=np.int64) * BINS, count)
    slot += (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, slot, mix(h))
    sig = sig.reshape(m, BINS)
    # an empty bin tries others in a walk of its own, the same for all lines, until it meets a filled one
    rows = np.flatnonzero((sig == none).any(1))
    base, out = sig[rows], sig[rows].copy()
    empty = out == none
    k = 0
    while empty.any():
        k += 1
        donor = (mix(np.arange(BINS, dtype=np.uint64) * np.uint64(1000003) + np.uint64(k)) % np.uint64(BINS)).astype(np.int64) if k < 4 * BINS else (np.arange(BINS) + k) % BINS
        got = base[:, donor]
        fill = empty & (got != none)
        out = np.where(fill, got + np.uint64(k), out)
        empty &= ~fill
    sig[rows] = out
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            acc = mix(acc ^ sig[:, b * ROWS + r])
        out[:, b] = acc
    return out


def line_components(docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, line, node, proof), and (node, proof, place, n, root) of each distinct line: its first place, its rows and its component."""
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    blocks = block_count(base)

    def first(batches):
        for batch in sliced(batches, 512):
            ids, places, nodes, proofs, texts, distinct = [], [], [], [], [], {}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, raw in enumerate(t.as_py().split("\n")):
                    if line := normal(raw):
                        node, proof = names_of(line)
                        ids.append(i)
                        places.append(at)
                        nodes.append(node)
                        proofs.append(proof)
                        texts.append(None if node in distinct else line)  # once in a batch
                        distinct.setdefault(node, line)
            names = list(distinct)
            sig = [signatures(*char_hashes([distinct[k] for k in part])) for part in _parts(names, distinct)]
            keys = band_keys(np.concatenate(sig)).ravel() if sig else np.empty(0, np.uint64)
            node = np.repeat(np.array(names, np.int64), BANDS)
            chunks = list(split_blocks(((keys >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), keys, node, np.zeros(len(node), np.uint32)))
            m, k = len(ids), len(chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids + [None] * k, pa.int64()), pa.array(places + [None] * k, pa.int32()), pa.array(nodes + [None] * k, pa.int64()), pa.array(proofs + [None] * k, pa.int64()), pa.array(texts + [None] * k, pa.string()),
                    pa.array([None] * m + [b for b, _ in chunks], pa.int32()), pa.array([None] * m + [p for _, p in chunks], pa.binary()),
                ],
                names=["doc_id", "line", "node", "proof", "text", "block", "payload"],
            )

    table = stored(base.mapInArrow(released(first), "doc_id long, line int, node long, proof long, text string, block int, payload binary"), "lines")
    lines = table.where("node is not null").select("doc_id", "line", "node", "proof")
    lists = stored(exchange(table.where("block is not null").select("block", "payload"), blocks).mapInArrow(released(met), MET), "lists")
    nodes = stored(lists.select("node").unionByName(lists.select(F.col("hub").alias("node"))).distinct(), "nodes")
    bits = docs.sparkSession.sparkContext.broadcast(bloom(nodes, "node"))

    @F.pandas_udf("boolean")
    def wanted(ids):
        return pd.Series(maybe(bits.value, ids.to_numpy()))

    # of lines that share a name and are not equal, one takes part: the least by its proof
    texts = table.where("text is not null").select("node", "proof", "text").where(wanted("node"))
    chosen = texts.groupBy("node").agg(F.min(F.struct("proof", "text")).alias("x")).select("node", "x.proof", F.col("x.text").alias("payload"))
    sets = stored(chosen.join(nodes, "node", "left_semi"), "candidates")

    # distinct shingles are not counted beforehand, so sizes bound nothing here and every pair is verified
    roots = link(lists, sets.select("node", "payload"), shingle_sets, percent, way="within").join(sets.select("node", "proof"), "node")
    # (doc_id, line) as one number, as hash aggregation takes the least of a number and not of a struct
    place = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
    classes = lines.groupBy("node", "proof").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    return lines, classes.join(roots, ["node", "proof"], "left")


def _parts(names: list[int], lines: dict[int, str], most: int = 1 << 16):
    """Lines in groups of about ``most`` characters."""
    held, size = [], 0
    for k in names:
        held.append(k)
        size += len(lines[k])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def removed_lines(docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, gone): the numbers of the lines that another line stands for, of each document that has any."""
    lines, classes = line_components(docs, percent, id_column, text)
    classes = stored(classes, "classes")
    linked = classes.where("root is not null")
    first = linked.groupBy("root").agg(F.min("place").alias("first"))
    linked = linked.join(first, "root").select("node", "proof", "n", "first")
    # only lines that stand twice or have a link can lose a row
    names = stored(linked.unionByName(classes.where("root is null and n > 1").select("node", "proof", "n", F.col("place").alias("first"))), "names")
    key = F.struct("node", "proof")
    place = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
    named = matched(lines.select("doc_id", "line", key.alias("key")), names.select(key.alias("key"), "n", "first"), "key", "n", lines.count())
    return named.where(place != F.col("first")).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def marked(docs: DataFrame, percent: int, id_column: str, text: str, gone: str, out: str) -> DataFrame:
    """``docs`` with ``gone`` (null where nothing goes) and the text left in ``out``."""
    with scratch(docs.sparkSession):
        table = stored(removed_lines(docs, percent, id_column, text), "gone", keep=True)
    (key,) = fresh(docs, "__key")

    @F.pandas_udf("string")
    def without(texts, gones):
        def one(t, g):
            if g is None or not isinstance(t, str):
                return t
            drop = set(g)
            return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)

        return texts.combine(gones, one)

    own = F.col(f"`{text}`")
    # the table grows with the corpus, so it is merged at every size and never broadcast
    joined = docs.join(table.select(F.col("doc_id").alias(key), F.col("gone").alias(gone)).hint("merge"), F.col(f"`{id_column}`").cast("long") == F.col(key), "left").drop(key)
    # texts that lose nothing do not go to Python
    return joined.withColumn(out, F.when(F.col(gone).isNull(), own).otherwise(without(F.when(F.col(gone).isNotNull(), own), F.col(gone))))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines left in ``text``; documents of which no line is left go. Columns as in ``docs``."""
    gone, out = fresh(docs, "__gone", "__out")
    df = marked(docs, percent, id_column, text, gone, out).where(F.col(gone).isNull() | F.col(out).rlike(r"\S"))
    return df.select([F.col(out).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, text) of every document, texts without the lines that go."""
    base = docs.select("doc_id", "text")
    gone, left = fresh(base, "gone", "left")
    df = marked(base, PERCENT, "doc_id", "text", gone, left)
    n = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).cast("long")
    lost = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
    return df.select("doc_id", n.alias("n_lines"), (n - lost).cast("long").alias("n_kept"), F.col(left).alias("text"))
