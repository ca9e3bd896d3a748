"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

The index holds a bounded, documented sample of labelled rows (``EXAMPLES`` rows, ``EXAMPLE_BYTES`` of text) with all their
words, so it is broadcast. Document frequencies are counted over all documents. A word weighs (1 + log tf) * idf *
relevance, where relevance is 1 and grows with the word's chi-squared against the label over ``SIGNIFICANT``; vectors
have a length of 1 in the space of the examples' words. (A document's other words would scale all its similarities alike,
so they change neither neighbours nor votes.) Examples stand in blocks of like texts. A word's postings are sorted by
block and carry the largest weight of each block, so a document's blocks have upper bounds; blocks are opened by these
until none left can reach the k-th similarity. Texts meet the index in batches. Where a word's postings fill an eighth of a
block they stand as a row of all its places, so opening it for all texts that want it is one product; the postings of
thinner parts are added up before, so only full parts need bounds. The k-th similarity's candidates are summed anew from
the vectors, so results depend on no batch. The top k is exact: ties go to the least example id. Votes weigh by squared
similarity and are calibrated by leave-one-out votes of the examples themselves, fitted to be monotone (pool adjacent
violators). Scoring is a map over whole texts.

Null and empty texts, and those without any word of the examples, get the calibrated score of examples without
neighbours. Without labelled rows the score is 0 and there is no evidence. Of a repeated id's texts the least is its
example; of its labels the largest. Rows with a null id are scored and never are examples. Texts of any length are taken
whole; an empty table gives no rows. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import released, runs, sliced, stored

#: Labelled rows and bytes of their texts that the index holds at most, examples in a block, neighbours that vote.
EXAMPLES, EXAMPLE_BYTES, BLOCK, K = 4096, 64 << 20, 64, 15
#: Bytes of full parts of the lists, numbers in the tables of a batch of texts, words in it, and list places added up at once: memory only, results are the same.
FULL_BYTES, BATCH, WORDS_AT_ONCE, THIN_AT_ONCE = 64 << 20, 1 << 20, 1 << 18, 1 << 15
#: Sums that were added in another order are equal down to this share; a similarity above 0 is above the other.
CLOSE, TINY = 1 - 1e-9, 1e-300
#: Chi-squared above which a word says more of the label than chance does.
SIGNIFICANT = 15.0

_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", bytes(range(97, 123)) + b" " * 37)


def terms_of(text: str | None) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all ranges, one after another."""
    ends = np.cumsum(length, dtype=np.int32)
    out = np.repeat(start - (ends - length), length)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Vocabulary(dict):
    """Words with their numbers in order of first sight. It travels as one string, as tables of many small objects take memory and time."""

    def __reduce__(self):
        return _vocabulary, (b" ".join(self),)

    def learn(self, words: list[bytes]) -> None:
        for w in words:
            self.setdefault(w, len(self))

    def numbers(self, texts: list) -> np.ndarray:
        """Numbers of all words of the texts, one text after another; -1 for unknown ones."""
        return np.fromiter(map(self.get, chain.from_iterable(texts), repeat(-1)), np.int64, sum(map(len, texts)))

    def counted(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' known words: number of the text, number of the word, sorted by both, and how often it stands there."""
        key = self.numbers(texts)
        known = key >= 0
        key += np.repeat(np.arange(len(texts)) * len(self), [len(t) for t in texts])
        key = np.sort(key[known])
        start, count = runs(key)
        return *np.divmod(key[start], max(1, len(self))), count


def _vocabulary(joined: bytes) -> Vocabulary:
    return Vocabulary((w, i) for i, w in enumerate(joined.split(b" ") if joined else []))


class Index:
    """Inverted lists of the examples with the largest weight in each block, and the calibration.

    ``frequency`` gives, for each word of the vocabulary in order, the number of all ``documents`` that have it; by default
    the examples are all. ``texts`` may be an iterator of word lists. It travels as the examples' vectors and is laid out
    again on arrival.
    """

    def __init__(self, texts, labels: list[int], frequency=None, documents: int = 0, block: int = BLOCK, k: int = K):
        self.vocabulary = Vocabulary()
        counts = []
        for t in texts:
            self.vocabulary.learn(t)
            counts.append([x.astype(np.int32) for x in self.vocabulary.counted([t])[1:]])
        self.k, self.block, self.n = k, block, len(counts)
        y = np.array(labels, np.float64)
        size = len(self.vocabulary)
        n1, n0 = y.sum(), self.n - y.sum()
        with_0, with_1 = np.zeros(size), np.zeros(size)
        for (own, _), label in zip(counts, labels, strict=True):
            (with_1 if label else with_0)[own] += 1
        if frequency is None:
            df, documents = with_0 + with_1, self.n
        else:
            df, documents = frequency(self.vocabulary) if callable(frequency) else (np.asarray(frequency, np.float64), documents)
        down = (with_0 + with_1) * (self.n - with_0 - with_1) * n0 * n1
        chi2 = self.n * (with_0 * (n1 - with_1) - with_1 * (n0 - with_0)) ** 2 / np.where(down == 0, np.inf, down)
        self.weight = (np.log((1 + documents) / (1 + df)) + 1) * (1 + np.maximum(0.0, chi2 - SIGNIFICANT))
        self.labels = y
        self.prior = float(y.mean()) if self.n else 0.0
        vectors = [(own, self._weighed(np.zeros(len(own), np.int64), own, n)) for own, n in counts]
        del counts
        # like texts share a block: those whose commonest words, by df, are the same
        common = np.argsort(-df, kind="stable")[:64]
        rank = np.full(size, 64)
        rank[common] = np.arange(len(common))
        looks = [tuple(np.argsort(-np.bincount(rank[own], v, 65)[:64], kind="stable")[:3].tolist()) if len(own) else () for own, v in vectors]
        self.order = np.array(sorted(range(self.n), key=lambda j: (looks[j], j)), np.int64)  # example at each place
        self.own_start = np.cumsum([0, *(len(vectors[j][0]) for j in self.order)]).astype(np.int32)
        self.own_term = np.concatenate([vectors[j][0] for j in self.order]).astype(np.int32) if vectors else np.empty(0, np.int32)
        self.own_value = np.concatenate([vectors[j][1] for j in self.order]) if vectors else np.empty(0)
        del vectors
        self._fill()
        self._calibrate()

    def _weighed(self, row: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.weight[ids]
        return v / np.sqrt(np.bincount(row, v * v))[row] if len(v) else v

    def _fill(self) -> None:
        """The lists. A word's part in a block is full if it has an eighth of the block's places; then it stands as one row of them."""
        self.blocks = -(-self.n // self.block)
        place = np.repeat(np.arange(self.n), np.diff(self.own_start))
        order = np.argsort(self.own_term, kind="stable")
        term, place, value = self.own_term[order].astype(np.int64), place[order], self.own_value[order]
        start, length = runs(term * max(1, self.blocks) + place // self.block)
        part_term, part_block = term[start], place[start] // self.block
        full = np.flatnonzero(8 * length >= self.block)
        full = full[np.argsort(-length[full], kind="stable")[: FULL_BYTES // (8 * self.block)]]
        full = full[np.lexsort((part_term[full], part_block[full]))]
        words, column = np.unique(part_term[full], return_inverse=True)
        self.column = np.full(len(self.vocabulary), -1, np.int32)
        self.column[words] = np.arange(len(words))
        self.full_column, self.full_start = column, np.searchsorted(part_block[full], np.arange(self.blocks + 1))
        self.top = np.zeros((len(words), self.blocks))
        if len(full):
            self.top[column, part_block[full]] = np.maximum.reduceat(value, start)[full]
        part = np.full(len(start), -1)
        part[full] = np.arange(len(full))
        part = np.repeat(part, length)
        self.full = np.zeros((len(full), self.block))
        is_full = part >= 0
        self.full[part[is_full], place[is_full] % self.block] = value[is_full]
        self.place, self.value = place[~is_full], value[~is_full]
        self.term_start = np.searchsorted(term[~is_full], np.arange(len(self.vocabulary) + 1)).astype(np.int32)
        self.place_of = np.empty(self.n, np.int64)
        self.place_of[self.order] = np.arange(self.n)
        # texts at once: what they take in memory is bounded
        self.batch = max(8, min(512, BATCH // max(1, len(words) + self.blocks * self.block)))

    def __getstate__(self):
        laid = ("blocks", "column", "full_column", "full_start", "top", "full", "place", "value", "term_start", "place_of", "batch")
        return {k: v for k, v in self.__dict__.items() if k not in laid}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fill()

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        row, ids, counts = self.vocabulary.counted([words])
        return ids, self._weighed(row, ids, counts)

    def nearest(self, ids: np.ndarray, v: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and similarities of the exact top k with a similarity above 0, nearest first, ties to the least example; ``skip`` is left out."""
        return self.nearest_of(np.array([0, len(ids)]), ids, v, None if skip < 0 else np.array([skip]))[0]

    def nearest_of(self, start: np.ndarray, ids: np.ndarray, v: np.ndarray, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several texts, whose words lie from ``start`` to the next; ``skip`` has an example for each."""
        n = len(start) - 1
        if not self.n or not n:
            return [(np.empty(0, np.int64), np.empty(0))] * n
        row = np.repeat(np.arange(n), np.diff(start))
        s = self._thin(start, row, ids, v)
        flat = s.reshape(n, -1)
        column = self.column[ids]
        has = column >= 0
        q = np.zeros((len(self.top), n))
        q[column[has], row[has]] = v[has]
        rows = np.arange(n)
        if skip is not None:
            skip = self.place_of[skip]
            flat[rows, skip] = 0
        bound = q.T @ self.top + s.max(2)
        first = np.argsort(-bound, axis=1, kind="stable")[:, :3]
        chosen = np.zeros(bound.shape, bool)
        chosen[rows[:, None], first] = True
        self._opened(s, q, chosen)
        if skip is not None:
            flat[rows, skip] = 0
        seen = s[rows[:, None], first].reshape(n, -1)
        least = np.partition(seen, -self.k, axis=1)[:, -self.k] if seen.shape[1] >= self.k else np.zeros(n)
        least = np.maximum(least * CLOSE, TINY)  # a hair below the k-th: sums may round apart, and ties may have a lesser id
        self._opened(s, q, ~chosen & (bound >= least[:, None]))
        if skip is not None:
            flat[rows, skip] = 0
        out, held = [], np.zeros(len(self.vocabulary))
        for i in range(n):
            at = np.flatnonzero(flat[i] >= least[i])
            if len(at) > self.k:
                own = flat[i, at]
                at = at[own >= np.partition(own, -self.k)[-self.k] * CLOSE]
            if not len(at):
                out.append((at, np.empty(0)))
                continue
            # anew from the vectors: the same sum for equal ones, whatever place and batch they stand in
            mine = slice(start[i], start[i + 1])
            held[ids[mine]] = v[mine]
            length = self.own_start[at + 1] - self.own_start[at]
            parts = [slice(a, a + n) for a, n in zip(self.own_start[at], length, strict=True)]
            shares = held[np.concatenate([self.own_term[x] for x in parts])] * np.concatenate([self.own_value[x] for x in parts])
            sums = np.add.reduceat(shares, np.cumsum(length) - length)
            held[ids[mine]] = 0
            j = self.order[at]
            best = np.lexsort((j, -sums))[: self.k]
            out.append((j[best], sums[best]))
        return out

    def _thin(self, start: np.ndarray, row: np.ndarray, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        """What words add outside their full parts: by text, block and place in it."""
        n, size = len(start) - 1, self.blocks * self.block
        out = np.empty((n, size))
        first = self.term_start[ids]
        length = self.term_start[ids + 1] - first
        done = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))[start]
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(done, done[a] + THIN_AT_ONCE, "right")) - 1)
            mine = slice(start[a], start[b])
            at = _spread(first[mine], length[mine])
            share = np.repeat(v[mine], length[mine])
            share *= self.value[at]
            to = np.repeat((row[mine] - a) * size, length[mine])
            to += self.place[at]
            out[a:b] = np.bincount(to, share, minlength=(b - a) * size).reshape(b - a, size)
            a = b
        return out.reshape(n, self.blocks, self.block)

    def _opened(self, s: np.ndarray, q: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the full parts of the chosen blocks, which makes their similarities whole."""
        for b in np.flatnonzero(chosen.any(0)):
            a, e = self.full_start[b], self.full_start[b + 1]
            if a < e:
                rows = np.flatnonzero(chosen[:, b])
                s[rows, b] += q[self.full_column[a:e]][:, rows].T @ self.full[a:e]

    def vote(self, j: np.ndarray, s: np.ndarray) -> float:
        w = s**2
        return float((w * self.labels[j]).sum() / w.sum())

    def _calibrate(self) -> None:
        votes, none = [], []
        for a in range(0, self.n, self.batch):
            own = self.order[a : a + self.batch]
            start = self.own_start[a : a + self.batch + 1]
            mine = slice(start[0], start[-1])
            for i, (j, s) in zip(own, self.nearest_of(start - start[0], self.own_term[mine], self.own_value[mine], own), strict=True):
                if len(j):
                    votes.append((self.vote(j, s), self.labels[i]))
                else:
                    none.append(self.labels[i])
        self.alone = (sum(none) + self.prior) / (len(none) + 1) if self.n else 0.0
        pools: list[list[float]] = []  # weight, sum of votes, sum of labels
        for x, label in sorted(votes):
            pools.append([1, x, label])
            while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
        self.cal_x = np.array([p[1] / p[0] for p in pools] or [0.0])
        # one example's weight of the prior keeps scores off 0 and 1, and apart where votes differ
        self.cal_y = np.array([(p[2] + self.prior) / (p[0] + 1) for p in pools] or [self.prior])

    def score(self, words: list[bytes]) -> tuple[float, np.ndarray, np.ndarray]:
        """The calibrated score, and the examples that voted with their similarities, nearest first."""
        return next(self.scores([words]))

    def scores(self, texts):
        """``score`` of each word list of an iterator, in batches."""
        held, n = [], 0
        for words in texts:
            if held and (len(held) == self.batch or n + len(words) > WORDS_AT_ONCE):
                yield from self._scored(held)
                held, n = [], 0
            held.append(words)
            n += len(words)
        if held:
            yield from self._scored(held)

    def _scored(self, texts: list[list[bytes]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        row, ids, counts = self.vocabulary.counted(texts)
        start = np.searchsorted(row, np.arange(len(texts) + 1))
        out = []
        for j, s in self.nearest_of(start, ids, self._weighed(row, ids, counts)):
            p = float(np.interp(self.vote(j, s), self.cal_x, self.cal_y)) if len(j) else self.alone
            out.append((min(1.0, max(0.0, p)), j, s))
        return out


def frequencies(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each word of ``vocabulary`` stands, and how many documents there are. One number a word comes to the driver."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        at = held.value
        counts, rows = np.zeros(len(at), np.int64), 0
        for batch in sliced(batches, 512):
            for t in batch.column(0).to_pylist():
                seen = at.numbers([set(terms_of(t))])
                counts[seen[seen >= 0]] += 1
            rows += batch.num_rows
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1).astype(np.int32)), pa.array(np.append(counts[k], rows))], names=["k", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(released(run), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    held.unpersist()
    k, n = rows.column("k").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(len(vocabulary) + 1)
    out[k] = n  # the last is the number of documents
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "label", examples: int = EXAMPLES, example_bytes: int = EXAMPLE_BYTES) -> tuple[Index, list]:
    """An index over the first labelled rows in hash order, within both bounds, and their ids. Rows without label or text count for nothing."""
    chosen = (
        labelled.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
        .groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(examples)
    )
    # at most ``examples`` rows, so the broadcast has a fixed bound
    texts = docs.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text}`").alias("__t")).where("__t <> ''").join(F.broadcast(chosen), "__id")
    texts = stored(texts.groupBy("__id").agg(F.min("__t").alias("__t"), F.max("__y").alias("__y")), "examples")
    sizes = texts.select("__id", F.octet_length("__t").alias("n")).orderBy(F.xxhash64("__id"), "__id").collect()
    within = np.cumsum([r.n for r in sizes]) <= example_bytes
    own = {r["__id"] for r, w in zip(sizes, within, strict=True) if w}
    rows = texts.toArrow().sort_by("__id") if len(own) == len(sizes) else texts.where(F.col("__id").isin(list(own))).toArrow().sort_by("__id")
    if not own:
        return Index([], []), []
    words = (terms_of(t.as_py()) for t in rows.column("__t"))
    return Index(words, rows.column("__y").to_pylist(), lambda vocabulary: frequencies(docs, vocabulary, text)), rows.column("__id").to_pylist()


def score(docs: DataFrame, index: Index, example_ids: list, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, evidence): evidence lists the examples that voted, nearest first, with similarity and label."""
    held = docs.sparkSession.sparkContext.broadcast((index, example_ids))
    one = pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])

    def run(batches):
        own, ids = held.value
        ids = np.array(ids, np.int64)
        for batch in sliced(batches, 512):
            texts = batch.column(1).to_pylist()
            alike = dict.fromkeys(texts)  # copies in a batch are scored once
            found = dict(zip(alike, own.scores(map(terms_of, alike)), strict=True))
            out = [found[t] for t in texts]
            offsets = np.cumsum([0, *(len(j) for _, j, _ in out)])
            j = np.concatenate([j for _, j, _ in out]) if out else np.empty(0, np.int64)
            s = np.concatenate([s for _, _, s in out]) if out else np.empty(0)
            flat = pa.StructArray.from_arrays([pa.array(ids[j] if len(j) else np.empty(0, np.int64)), pa.array(s), pa.array(own.labels[j].astype(np.int32) if len(j) else np.empty(0, np.int32))], fields=list(one))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _, _ in out], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["doc_id", "score", "evidence"])

    ddl = "doc_id long, score double, evidence array<struct<example:long,similarity:double,label:int>>"
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(released(run), ddl)
