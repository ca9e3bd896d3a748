"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence matrix.

Equal sets are one row of the matrix (a row is named by a hash of its whole set), so exact copies never multiply.

1. Which products are wanted. Rows above the threshold differ in at most k columns, by their sizes. The columns are dealt
   into more than k + 1 groups by hash, the same for all rows of like size; then at least one group that holds columns is
   the same in both rows. So each row gives the hashes of its k + 1 fullest groups (``signature``), once for the rows of
   its own class of sizes and once for those of the next, and only rows that meet in one are multiplied. This is exact,
   and a hash over several n-grams is rare however common each of them is, so the lists stay short at any size.
2. The products. Overlaps of a row with a block of others are added up over blocks of columns, and a row drops out as soon
   as what is left cannot reach the bound from the sizes; ``linking`` does so for each list's hub, contracts, and splits
   what is still apart by the rarest n-grams.

A row is named by 64 bits; copies are told by 64 bits more. Documents without words, and null texts, have an empty set and
are linked with nothing. Rows with a null doc_id keep a null component and link nothing. Repeated doc_ids and equal texts
share a component by their texts; ties go to the least doc_id. Texts of any length are taken whole; an empty table gives
no rows. Columns of any name may stand beside the id and the text.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import block_count, bloom, exchange, fresh, matched, maybe, mix, released, runs, scratch, shingles, sliced, split_blocks, stored
from .linking import MET, link, met, outline

WIDTH, PERCENT = 3, 90

_SALT = np.uint64(0xA0761D6478BD642F)


def names_of(s: np.ndarray) -> tuple[int, int]:
    """A row's name and its check: a hash of its whole set, as two signed 64-bit integers."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def node_of(s: np.ndarray) -> int:
    return names_of(s)[0]


class Sizes:
    """Classes of set sizes: a set of one class is similar to sets of the same and of the next ones above and below only."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        self.percent = percent
        # smaller sets only link with equal ones
        self.smallest = next((n for n in range(1, 101) if n * 100 >= percent * (n + 1)), largest)
        self.low, self.high = [], []
        at = self.smallest
        while at < largest:
            self.low.append(at)
            self.high.append(at * 100 // percent)
            at = self.high[-1] + 1

    def differ(self, n: int, m: int) -> int:
        """The most columns in which sets of n and m at the threshold differ."""
        return (100 - self.percent) * (n + m) // (100 + self.percent)

    def groups(self, j: int) -> int:
        """Groups of columns of the j-th class: some more than could differ, so that the emptiest need not count."""
        k = self.differ(self.high[j], self.high[j]) + 1
        return k + k // 4 + 2


def signature(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Hashes of groups of the set's columns: of two sets at the threshold some are the same.

    A group is used if it has c columns or more, with the largest c that leaves one more than may differ. Of two sets the
    one with the larger c has an untouched group among its own, which the other uses as well.
    """
    n = len(s)
    if n < sizes.smallest:
        return np.empty(0, np.uint64)
    own = bisect.bisect_right(sizes.low, n) - 1
    most = n * 100 // sizes.percent  # columns of the largest set that is similar
    h, top = mix(s ^ _SALT), s >> np.uint64(32)
    out = []
    for j in (own, own + 1):
        if most < sizes.low[j]:
            continue
        groups, wanted = sizes.groups(j), sizes.differ(n, min(most, sizes.high[j])) + 1
        group = (top * np.uint64(groups)) >> np.uint64(32)  # in order, as the set is sorted
        start, length = runs(group)
        value = np.add.reduceat(h, start)
        name = group[start]
        if len(start) < wanted:  # empty groups count as well: both sets may have them in common only
            empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), name)
            name, value = np.concatenate([name, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
        else:
            use = length >= np.partition(length, len(length) - wanted)[len(length) - wanted]
            name, value = name[use], value[use]
        out.append(mix(value ^ mix(name | np.uint64(j << 40))))
    return np.concatenate(out)


def _postings(sets: dict[int, np.ndarray], sizes: Sizes, blocks: int):
    """Chunks of postings (key, node, n) of the rows in ``sets``, dealt out by key."""
    keys = [signature(s, sizes) for s in sets.values()]
    m = [len(k) for k in keys]
    if sum(m):
        key = np.concatenate(keys)
        node = np.repeat(np.fromiter(sets, np.int64, len(sets)), m)
        n = np.repeat(np.fromiter(map(len, sets.values()), np.uint32, len(sets)), m)
        yield from split_blocks(((key >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), key, node, n)


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node, proof) for each document, node null for empty sets; and (node, proof, least, n, linked, root, root_proof) of the distinct rows of documents with an id."""
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks, sizes = block_count(base), Sizes(percent)

    def first(batches):
        for batch in sliced(batches, 1024):
            ids, nodes, proofs, counts, sets = batch.column(0).to_pylist(), [], [], [], {}
            for i, t in zip(ids, batch.column(1), strict=True):
                s = shingles(t.as_py(), width)
                node, proof = names_of(s) if len(s) else (None, None)
                nodes.append(node)
                proofs.append(proof)
                counts.append(len(s))
                if i is not None and len(s):
                    sets.setdefault(node, s)
            chunks = list(_postings(sets, sizes, blocks))
            m, k = len(ids), len(chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids + [None] * k, pa.int64()), pa.array(nodes + [None] * k, pa.int64()), pa.array(proofs + [None] * k, pa.int64()), pa.array(counts + [None] * k, pa.int64()),
                    pa.array([None] * m + [b for b, _ in chunks], pa.int32()), pa.array([None] * m + [p for _, p in chunks], pa.binary()),
                ],
                names=["doc_id", "node", "proof", "n_shingles", "block", "payload"],
            )

    table = stored(base.mapInArrow(released(first), "doc_id long, node long, proof long, n_shingles long, block int, payload binary"), "incidence")
    rows = table.where("n_shingles is not null").select("doc_id", "n_shingles", "node", "proof")
    classes = stored(rows.where("doc_id is not null and node is not null").groupBy("node", "proof").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    lists = stored(exchange(table.where("block is not null").select("block", "payload"), blocks).mapInArrow(released(met), MET), "lists")

    nodes = lists.select("node").unionByName(lists.select(F.col("hub").alias("node"))).distinct()
    # of rows that share a name and are not equal, one takes part: the least by its proof
    chosen = stored(classes.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("proof").alias("proof")), "chosen")
    left = stored(chosen.join(classes, ["node", "proof"]).select(F.col("least").alias("doc_id"), "node", "proof"), "left")
    bits = docs.sparkSession.sparkContext.broadcast(bloom(left, "doc_id"))

    @F.pandas_udf("boolean")
    def wanted(ids):
        known = ids.notna()
        return known & maybe(bits.value, ids.fillna(0).to_numpy())

    def second(batches):
        for batch in sliced(batches, 512):
            found: dict[int, np.ndarray] = {}
            for node, proof, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingles(t.as_py(), width)
                if node not in found and len(s) and names_of(s) == (node, proof):  # a repeated doc_id may bring other texts
                    found[node] = s
            payloads, outlines = [s.tobytes() for s in found.values()], [outline(s) for s in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(payloads, pa.binary()), pa.array(outlines, pa.binary())], names=["node", "payload", "outline"])

    sets = stored(base.where(wanted("doc_id")).join(left, "doc_id").select("node", "proof", "text").mapInArrow(released(second), "node long, payload binary, outline binary").dropDuplicates(["node"]), "sets")

    def members(payloads: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(p, np.uint64) for p in payloads]

    roots = link(lists, sets, members, percent).join(chosen, "node")
    own = classes.join(roots, ["node", "proof"], "left")
    # a linked row belongs to its root's name, any other to its own name and proof
    linked = F.col("root").isNotNull()
    return rows, own.select("node", "proof", "least", "n", linked.alias("linked"), F.coalesce("root", "node").alias("root"), F.when(linked, F.lit(0)).otherwise(F.col("proof")).alias("root_proof"))


def _components(docs: DataFrame, width: int, percent: int, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node, proof) and, for each (node, proof) of a row with an id, (component_id, n, linked, root, root_proof)."""
    with scratch(docs.sparkSession):
        rows, classes = join(docs, width, percent, id_column, text)
        classes = stored(classes, "named")
        least = classes.groupBy("root", "root_proof").agg(F.min("least").alias("component_id"))
        names = stored(classes.join(least, ["root", "root_proof"]).drop("least"), "names", keep=True)
        return stored(rows, "rows", keep=True), names


def components_of(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``; a component is named by its least doc_id."""
    rows, names = _components(docs, width, percent, id_column, text)
    key = F.struct("node", "proof")
    total = rows.count()
    # a row that is alone is its own component; copies share a name, which may hold a third of all rows
    names = names.where("n > 1 or linked")
    out = matched(rows.withColumn("key", F.when(F.col("node").isNotNull(), key)), names.select(key.alias("key"), "component_id", "n"), "key", "n", total)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, one with the least id; rows without an id or without words stay. Columns as in ``docs``.

    Of rows with that id the one with the least node stays, and of those the one with the least text. Repeated rows are
    copies of each other, so one stays.
    """
    rows, names = _components(docs, width, percent, id_column, text)
    gone_id, several_id, row, doc_key, node_key = fresh(docs, "__gone", "__several", "__row", "__doc", "__node")
    # a doc_id in one row is told by its id alone; the rows of the others are told by their node too
    several = stored(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    own = names.where("n > 1 or linked")  # all others are alone
    total = rows.count()
    key = F.struct("node", "proof")
    own = matched(rows.where("doc_id is not null and node is not null").select("doc_id", "node", key.alias("key")), own.select(key.alias("key"), "component_id", "root", "root_proof", "n"), "key", "n", total)
    own = stored(own.where("component_id is not null").select("doc_id", "node", "component_id", "root", "root_proof").distinct(), "own")
    alone = rows.where("doc_id is not null and node is not null").join(several, "doc_id", "left_semi").select("doc_id", "node").join(own, ["doc_id", "node"], "left_anti")
    first = own.where("doc_id = component_id").groupBy("root", "root_proof").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("first.*")
    kept = stored(several.join(first.unionByName(alone.distinct()), "doc_id"), "kept")
    gone = stored(own.where("doc_id <> component_id").select("doc_id").union(several).distinct().select(F.col("doc_id").alias(gone_id)), "gone")

    @F.pandas_udf("long")
    def node(texts):
        sets = [shingles(t if isinstance(t, str) else None, width) for t in texts]
        return pd.Series([node_of(s) if len(s) else None for s in sets], dtype="Int64")

    of = F.col(f"`{id_column}`").cast("long")
    single = docs.join(gone, of == F.col(gone_id), "left_anti")
    again = docs.join(several.select(F.col("doc_id").alias(several_id)), of == F.col(several_id), "left_semi").select(F.struct("*").alias(row), of.alias(doc_key), node(F.col(f"`{text}`")).alias(node_key))
    kept = kept.select(F.col("doc_id").alias(doc_key), F.col("node").alias(node_key))
    one = again.where(F.col(node_key).isNotNull()).join(kept, [doc_key, node_key], "left_semi").groupBy(doc_key, node_key).agg(F.min_by(row, F.col(row)[text]).alias(row))
    return single.unionByName(one.select(f"{row}.*")).unionByName(again.where(F.col(node_key).isNull()).select(f"{row}.*"))
