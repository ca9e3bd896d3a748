"""From lists of rows that meet in a column to components, by blocked products of the rows' sets.

A list (all nodes with one key) of m nodes has m * m / 2 pairs, which are never made as rows. Its hub is compared with all
others, and verified links are contracted (``components``). The hub is done then, and so is a list of two. Only lists whose
other nodes still hold several components go on, in one of two ways that the caller chooses:

- ``within``: the nodes of a list meet in one task, each with its set once, and the products between its components are
  taken there; what is found on the way joins components at once, and two nodes are multiplied in the first of the lists
  that they share. Lists of over ``LONG`` nodes get more hubs before, and go the other way if they stay long.
- ``split``: the nodes are ordered by the rarest of their members first, and nodes that could be similar share one of the
  first few (a prefix filter, exact in any order of members). The lists of these members get more hubs if they are long,
  and then give the pairs that sizes and places allow between components.

No link between nodes that share a key is lost.

A pair is verified by the product of its rows in the matrix of nodes by members: a hub's row and a block of other rows
are multiplied one block of columns after another, the overlaps add up, and a row drops out as soon as what is left of
it cannot reach the bound that follows from the two sizes.

Where sets have outlines (``outline``), these go through the shuffles first, as they hold a bit or two for each member.
They count members that two sets do not share, some of them at least, so none but pairs below the threshold drop out; whole
sets go only to the pairs that are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bloom, chunks_of, maybe, released, repeated, runs, sliced, stored
from .components import components

#: Column blocks of a product, and counters of members. Lists of over ``LONG`` nodes, or with over ``PAIRS`` pairs between components, get up to ``TURNS`` more hubs first.
COLUMN_BLOCKS, SLOTS, LONG, PAIRS, TURNS = 4, 1 << 16, 2048, 1 << 11, 3

_EDGES = (np.arange(1, COLUMN_BLOCKS, dtype=np.uint64) * np.uint64(2**64 // COLUMN_BLOCKS)).astype(np.uint64)


def needed(n, m, percent: int):
    """The least overlap of sets of n and m at the threshold: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def products(hub: np.ndarray, rows: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``rows`` are similar to ``hub`` (sorted distinct members, spread evenly over 64 bits)."""
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    need = needed(n, len(hub), percent)
    total = np.zeros(len(rows), np.int64)
    done = np.zeros(len(rows), np.int64)  # columns of each row that are behind
    live = np.flatnonzero(np.minimum(n, len(hub)) >= np.maximum(need, 1))
    cut = [0, *np.searchsorted(hub, _EDGES), len(hub)]
    for c in range(COLUMN_BLOCKS):
        if not len(live):
            break
        part = hub[cut[c] : cut[c + 1]]
        last = c == COLUMN_BLOCKS - 1
        parts = [rows[i][done[i] : None if last else done[i] + np.searchsorted(rows[i][done[i] :], _EDGES[c])] for i in live]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        done[live] += size
        if len(part) and size.any():
            flat = np.concatenate(parts)
            hit = part[np.minimum(np.searchsorted(part, flat), len(part) - 1)] == flat
            total[live] += np.bincount(np.repeat(np.arange(len(live)), size), hit, minlength=len(live)).astype(np.int64)
        live = live[total[live] + np.minimum(len(hub) - cut[c + 1], n[live] - done[live]) >= need[live]]
    out = np.zeros(len(rows), bool)
    out[live] = True
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``percent`` or more."""
    return bool(products(x, [y], percent)[0])


def outline(s: np.ndarray) -> bytes:
    """A set's size and, for one to two counters a member (a power of two, 64 at least), whether each is odd."""
    bits = max(64, 1 << (len(s) - 1).bit_length() if len(s) else 0)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.uint64(len(s)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def outlines_allow(x: bytes, y: bytes, percent: int) -> bool:
    """Whether sets with these outlines can be similar: each counter that differs has a member that only one of them has."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    n, m = int(a[0]), int(b[0])
    need = needed(n, m, percent)
    if min(n, m) < max(need, 1):
        return False
    # counters go by low bits, so those of the larger outline add up to fewer
    folded = np.bitwise_xor.reduce(b[1:].reshape(-1, len(a) - 1), axis=0)
    return int(np.bitwise_count(a[1:] ^ folded).sum()) <= n + m - 2 * need


def _known(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets`` without most of those whose node is not in ``nodes``, before any shuffle."""
    bits = sets.sparkSession.sparkContext.broadcast(bloom(nodes, "node"))

    @F.pandas_udf("boolean")
    def wanted(ids):
        return pd.Series(maybe(bits.value, ids.to_numpy()))

    return sets.where(wanted("node"))


def _allowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the outlines of their sets do not rule out."""
    held = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("outline").alias("ob")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("outline").alias("oa")), "a").select("a", "b", "oa", "ob")
    )

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([outlines_allow(i, j, percent) for i, j in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return held.mapInArrow(released(run), "a long, b long")


def reachable(percent: int, n1: Column, u1: Column, n2: Column, u2: Column) -> Column:
    """The bound: from sizes and members known not to be shared, the largest overlap and so the similarity."""
    most = F.least(n1 - u1, n2 - u2)
    return 100 * most >= percent * (n1 + n2 - most)


def met(batches):
    """(key, node, n, hub, hub's n) of all nodes but the hub of each list, from postings (key, node, n) dealt out by key.

    The hub is the node met most often, ties to the least, in the first part of a block that has the key; only hubs stay
    in memory from part to part, so a key may have any number of nodes.
    """
    known = [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
    for _, ends, (key, node, n) in chunks_of(batches, "<u8", "<i8", "<u4"):
        n = n.astype(np.int64)
        if ends and not len(known[0]):
            key, node, n = repeated(key, node, n)
        order = np.lexsort((node, key))
        key, node, n = key[order], node[order], n[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (node[1:] != node[:-1]))))
        often = np.diff(np.append(new, len(key)))
        key, node, n = key[new], node[new], n[new]
        order = np.lexsort((node, -often, key))
        key, node, n = key[order], node[order], n[order]
        start, length = runs(key)
        first = np.repeat(start, length)
        hub, hub_n = node[first], n[first]
        if len(known[0]):
            at = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
            found = known[0][at] == key
            hub, hub_n = np.where(found, known[1][at], hub), np.where(found, known[2][at], hub_n)
            start = start[~found[start]]
        if not ends:
            order = np.argsort(np.concatenate([known[0], key[start]]), kind="stable")
            known = [np.concatenate([a, b])[order] for a, b in zip(known, (key[start], node[start], n[start]), strict=True)]
        else:
            known = [a[:0] for a in known]
        keep = node != hub
        cols = [key[keep].view(np.int64), node[keep], n[keep], hub[keep], hub_n[keep]]
        for a in range(0, len(cols[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 65536]) for c in cols], names=["key", "node", "n", "hub", "hub_n"])


MET = "key long, node long, n long, hub long, hub_n long"


def verified(pairs: DataFrame, sets: DataFrame, members, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; ``sets`` has (node, payload) and may have ``outline``, ``members`` gives the sorted sets of a list of payloads."""
    if "outline" in sets.columns:
        pairs = stored(_allowed(pairs, sets, percent), "allowed")
        if not pairs.limit(1).count():
            return pairs
        sets = _known(sets, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    held = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("payload").alias("pb")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("payload").alias("pa")), "a").select("a", "b", "pa", "pb")
    )

    def run(batches):
        for batch in sliced(batches, 512):
            a, b, pb = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            order = np.argsort(a, kind="stable")
            start, length = runs(a[order])
            hubs = members([batch.column(2)[int(order[s])].as_py() for s in start])
            rows = members(pb)
            keep = np.zeros(len(a), bool)
            for hub, s, m in zip(hubs, start, length, strict=True):
                own = order[s : s + m]
                keep[own] = products(hub, [rows[i] for i in own], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return held.mapInArrow(released(run), "a long, b long")


def _named(df: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """``df`` with each column's node replaced by its root, if it has one."""
    for x in columns:
        df = df.join(roots.select(F.col("node").alias(x), F.col("root").alias("__r")), x, "left").withColumn(x, F.coalesce("__r", x)).drop("__r")
    return df


def contracted(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) once the links (a, b) count too."""
    if roots is None:
        return stored(components(links), "roots")
    moved = components(_named(links, roots, "a", "b")).select(F.col("node").alias("root"), F.col("root").alias("least"))
    moved = stored(moved, "moved")
    own = moved.join(roots, "root", "left_anti").select(F.col("root").alias("node"), F.col("least").alias("root"))
    return stored(roots.join(moved, "root", "left").select("node", F.coalesce("least", "root").alias("root")).unionByName(own), "roots")


def _rarity(own: DataFrame, members) -> np.ndarray:
    """How often members fall into each of ``SLOTS`` counters, over all sets: only an order follows from it, so two in one slot do no harm."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in sliced(batches, 512):
            sets = members(batch.column(0).to_pylist())
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    # one number for each slot, whatever the input: a fixed bound
    for row in own.select("payload").mapInArrow(released(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[row.slot] = row.n
    return out


def _prefixes(own: DataFrame, members, percent: int) -> DataFrame:
    """(key, node, root, n, place) of the members of each set, rarest first, of which similar sets share one at least."""
    rarity = own.sparkSession.sparkContext.broadcast(_rarity(own, members))

    def run(batches):
        for batch in sliced(batches, 512):
            out = []
            for node, root, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), members(batch.column(2).to_pylist()), strict=True):
                n = len(s)
                order = np.lexsort((s, rarity.value[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))[: n - (n * percent + 99) // 100 + 1]
                out.append((s[order].view(np.int64), node, root, n))
            m = [len(o[0]) for o in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([o[0] for o in out]) if out else np.empty(0, np.int64)), pa.array(np.repeat(np.array([o[1] for o in out], np.int64), m)), pa.array(np.repeat(np.array([o[2] for o in out], np.int64), m)),
                    pa.array(np.repeat(np.array([o[3] for o in out], np.int64), m)), pa.array(np.concatenate([np.arange(x) for x in m]) if out else np.empty(0, np.int64)),
                ],
                names=["key", "node", "root", "n", "place"],
            )

    return own.select("node", "root", "payload").mapInArrow(released(run), "key long, node long, root long, n long, place long")


def _apart(p: DataFrame, turn: int) -> DataFrame:
    """The postings of lists that hold several components, with the largest of these, a hub for this turn, and the number of pairs between components."""
    rank = F.xxhash64("node", F.lit(turn))
    parts = p.groupBy("key", "root").agg(F.count("*").alias("c"), F.min(F.struct(rank.alias("rank"), "node", "n", "place")).alias("h"))
    hub = F.min(F.struct("h.rank", "h.node", "h.n", "h.place", "root"))
    lists = parts.groupBy("key").agg(F.count("*").alias("k"), (F.sum("c") ** 2 - F.sum(F.col("c") * F.col("c"))).alias("pairs"), F.max(F.struct("c", "root"))["root"].alias("big"), hub.alias("h")).where("k > 1").drop("k")
    return p.join(lists.withColumn("pairs", F.col("pairs") / 2), "key")


def _between(p: DataFrame, sets: DataFrame, members, percent: int) -> DataFrame:
    """Links (a, b) between components that share lists, from postings (key, node, n, place, root)."""
    links = None
    columns = p.columns
    for turn in range(1, TURNS + 2):
        apart = stored(_apart(p, turn), "apart")
        last = turn > TURNS
        few = F.lit(True) if last else F.col("pairs") <= PAIRS
        # a pair between components has at most one end in the list's largest
        x = apart.where(few & (F.col("root") != F.col("big"))).select("key", F.col("node").alias("a"), F.col("n").alias("an"), F.col("place").alias("ap"), F.col("root").alias("ar"))
        y = apart.where(few).select("key", "big", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("place").alias("bp"), F.col("root").alias("br"))
        cross = x.join(y, "key").where("ar <> br and (br = big or a < b)").where(reachable(percent, F.col("an"), F.col("ap"), F.col("bn"), F.col("bp")))
        pairs = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if not last:
            star = apart.where(~few & (F.col("root") != F.col("h.root"))).where(reachable(percent, F.col("n"), F.col("place"), F.col("h.n"), F.col("h.place")))
            pairs = pairs.unionByName(star.select(F.col("h.node").alias("a"), F.col("node").alias("b")))
        found = stored(verified(pairs.distinct(), sets, members, percent), "found")
        links = found if links is None else links.unionByName(found)
        rest = apart.where(~few).select(columns)
        if last or not rest.limit(1).count():
            return links
        # contract what this turn has found, on the names that the postings have
        named = rest.select("node", "root").distinct()
        ends = found.join(named.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(named.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        p = stored(_named(rest, contracted(None, ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "root"), "rest")
    raise AssertionError


def _within(p: DataFrame, sets: DataFrame, members, percent: int) -> DataFrame:
    """Links (a, b) that join components within lists (key, node, root) of at most ``LONG`` nodes."""
    keys = p.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # as many as a node has keys
    own = p.select("key", "node", "root").join(keys, "node").join(sets, "node")

    def block(table: pa.Table) -> pa.Table:
        here = table.column("key")[0].as_py()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        names, part, count = np.unique(root, return_inverse=True, return_counts=True)
        order = np.argsort(count[part], kind="stable")  # the largest component comes last
        node, part = node[order], part[order]
        small = count.sum() - count.max()
        before = [[k for k in table.column("keys")[int(i)].as_py() if k < here] for i in order]
        width = [len(x) for x in before]
        flat, owner = np.array([k for x in before for k in x], np.int64), np.repeat(np.arange(len(node)), width)
        todo = []
        for i in range(int(small)):
            other = part != part[i]
            other[: i + 1] = False
            if width[i]:  # nodes that an earlier list has brought together are done
                other[owner[np.isin(flat, before[i])]] = False
            if other.any():
                todo.append((i, np.flatnonzero(other)))
        # only rows that have something left to be multiplied with get their sets
        need = np.unique(np.concatenate([np.append(at, i) for i, at in todo])) if todo else np.empty(0, np.int64)
        rows = dict(zip(need.tolist(), members(table.column("payload").take(pa.array(order[need])).to_pylist()), strict=True))
        up = np.arange(len(names))
        a, b = [], []
        for i, at in todo:
            at = at[up[part[at]] != up[part[i]]]
            if not len(at):
                continue
            for j in at[products(rows[i], [rows[k] for k in at.tolist()], percent)]:
                if up[part[j]] != up[part[i]]:
                    up[up == up[part[j]]] = up[part[i]]
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return own.groupBy("key").applyInArrow(block, "a long, b long")


def _split(p: DataFrame, sets: DataFrame, roots: DataFrame, members, percent: int) -> DataFrame:
    """Links (a, b) between components among the nodes of lists, by the rarest of their members."""
    nodes = p.select("node").distinct().withColumn("root", F.col("node"))
    nodes = stored(_named(nodes, roots, "root"), "left")
    own = stored(_known(sets, nodes).join(nodes, "node"), "own")
    return _between(stored(_prefixes(own, members, percent), "prefixes"), own, members, percent)


def link(lists: DataFrame, sets: DataFrame, members, percent: int, way: str = "split") -> DataFrame:
    """(node, root) of nodes with a link. ``lists`` is stored and as ``met`` gives it; sizes of 0 are unknown and rule nothing out."""
    pairs = lists.select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_n").alias("an"), F.col("n").alias("bn")).distinct()
    pairs = stored(pairs, "pairs")
    zero = F.lit(0)
    links = stored(verified(pairs.where(reachable(percent, F.col("an"), zero, F.col("bn"), zero)).select("a", "b"), sets, members, percent), "star")
    roots = contracted(None, links)
    # a list is apart if some node has another component than its hub
    unlinked = pairs.select("a", "b").join(links, ["a", "b"], "left_anti").withColumn("hub", F.col("a")).withColumn("node", F.col("b"))
    apart = stored(_named(unlinked, roots, "a", "b").where("a <> b").select("hub", "node"), "unlinked")
    if not apart.limit(1).count():
        return roots
    keys = lists.join(apart, ["hub", "node"], "left_semi").select("key").distinct()
    # a hub has met all of its list, so only the others are left: a list of two is done
    among = lists.join(keys, "key", "left_semi").select("key", "node").distinct()
    p = stored(_named(among.withColumn("root", F.col("node")), roots, "root"), "among")
    sized = p.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "m")
    p = stored(p.join(sized, "key"), "sized")
    if not p.limit(1).count():
        return roots
    if way == "split":
        return contracted(roots, _split(p, sets, roots, members, percent))
    roots = contracted(roots, stored(_within(p.where(F.col("m") <= LONG), sets, members, percent), "within"))
    long = p.where(F.col("m") > LONG).select("key", "node")
    return contracted(roots, _split(long, sets, roots, members, percent)) if long.limit(1).count() else roots


__all__ = ["MET", "contracted", "link", "met", "outline", "outlines_allow", "products", "similar", "verified"]
