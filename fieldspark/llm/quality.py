"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a Column over a row's text, words and lines, with all counts that it takes, so its cost is its own. Cost and
selectivity come from a sample spread over all partitions (``SAMPLE_ROWS`` rows, written once): the time that a rule
takes there and the share that it rejects. Rules run by rejection per cost: ``keep_good`` filters by one after another,
so a count of n-grams is made only for rows that cheaper rules leave; ``judge`` reports all counts of every row, and its
verdict stops at the first rule that rejects. The order never changes a verdict, which is the conjunction of all rules;
which of several failing rules ``failed_rule`` names does depend on the order, and so on the times measured.

All is within a row: no shuffle, no join, so hot sources, copies and repeated rows cost nothing extra and there are no
ties. Null and empty texts have no words and fail. Texts of any length are taken whole. An empty table gives no rows.
Columns of the input keep their names and values, but for one named like ``out``, which is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_GAP, fresh, scratch, stored

#: Rows on which cost and selectivity are estimated, and how often each is run there. Verdicts do not depend on it.
SAMPLE_ROWS, REPEATS = 256, 4
#: Fixed values of the base verdict.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Fixed values of the further rules.
MAX_SYMBOLS_PER_WORD, MAX_UPPER_SHARE, MAX_DUP_LINE_SHARE, MEAN_WORD = 0.15, 0.3, 0.5, (2.0, 14.0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words covered by three-word windows that stand twice or more in the text.

    Windows are hashed; only where some hash repeats are they sorted with their places, and a sweep over the places of
    repeated ones counts the words that they cover.
    """

    def covered(z: Column) -> Column:
        again = F.filter(z, lambda x, i: F.coalesce(F.get(z, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(z, i + 1)["h"] == x["h"], F.lit(False)))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(F.sort_array(F.transform(again, lambda x: x["i"])), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(windows, counted)


#: Each count over a row's parts: the text ``t``, its words ``w``, and its lines with a word ``ln``.
COUNTS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda p: F.size(p["w"]).cast("long"),
    "word_chars": lambda p: F.length(F.translate(p["t"], " \t\n\x0b\x0c\r", "")).cast("long"),
    "n_symbols": lambda p: (F.length(p["t"]) - F.length(F.translate(p["t"], "#*$%&|<>", ""))).cast("long"),
    "n_lines": lambda p: F.size(p["ln"]).cast("long"),
    "n_dup_lines": lambda p: (F.size(p["ln"]) - F.size(F.array_distinct(p["ln"]))).cast("long"),
    "n_repeat_words": lambda p: _repeated(p["w"]),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean Column over the row's parts and a function that gives a count by name."""

    name: str
    rejects: Callable[[Column, Callable[[str], Column]], Column]


def _share(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _letters(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


BASE = (
    Rule("few_words", lambda p, n: n("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda p, n: 100 * n("n_repeat_words") > MAX_REPEAT_PERCENT * n("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda p, n: _share(n("n_symbols"), n("n_words")) > MAX_SYMBOLS_PER_WORD),
    Rule("word_length", lambda p, n: ~_share(n("word_chars"), n("n_words")).between(*MEAN_WORD)),
    Rule("upper_case", lambda p, n: _share(_letters(p["t"], r"[^\p{Lu}]+"), _letters(p["t"], r"[^\p{L}]+")) > MAX_UPPER_SHARE),
    Rule("dup_lines", lambda p, n: _share(n("n_dup_lines"), n("n_lines")) > MAX_DUP_LINE_SHARE),
)


def with_parts(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the struct ``out`` of the text (null as empty), its words and its lines with a word."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    parts = F.struct(t.alias("t"), F.array_remove(F.split(t, WORD_GAP), "").alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("ln"))
    # exploding an array of one is a barrier: what stands above is computed from the parts, and no filter takes their
    # expressions with it below
    return docs.withColumn(out, F.explode(F.array(parts)))


def _own(parts: Column) -> Callable[[str], Column]:
    return lambda name: COUNTS[name](parts)


def sampled(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About ``rows`` texts from all partitions (all, if there are no more), written once."""
    total = docs.count()
    own = docs.select(F.col(f"`{text}`").alias("text"))
    return stored(own if total <= rows else own.sample(min(1.0, rows / total), seed=7), "sample")


def cascade_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on the sample, by rejection per cost, best first; ties by name."""
    (p,) = fresh(docs, "__parts")
    with scratch(docs.sparkSession):
        sample = sampled(docs, text, rows).withColumn("again", F.explode(F.array_repeat(F.lit(1), REPEATS)))
        parts = with_parts(sample, "text", p)

        def timed(rejects: Column) -> tuple[float, float]:
            best, share = float("inf"), 0.0
            for _ in range(2):
                began = time.perf_counter()
                share = parts.agg(F.avg(rejects.cast("double"))).first()[0] or 0.0
                best = min(best, time.perf_counter() - began)
            return best, share

        floor, _ = timed(F.size(F.col(p)["w"]) < 0)
        found = []
        for rule in rules:
            took, share = timed(rule.rejects(F.col(p), _own(F.col(p))))
            found.append((rule, max(took - floor, 1e-4), share))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def judge(docs: DataFrame, text: str = "text", out: str = "quality", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the struct ``out``: all counts, base_failed, failed_rule (the first that rejected) and kept."""
    p, c = fresh(docs, "__parts", "__counts")
    order = [x[0] for x in cascade_order(docs, text, rules, rows)]
    df = with_parts(docs, text, p).withColumn(c, F.explode(F.array(F.struct(*[f(F.col(p)).alias(n) for n, f in COUNTS.items()]))))
    counts = F.col(c)
    first = F.when(F.lit(False), F.lit(""))
    for rule in order:  # CASE WHEN evaluates each branch only where no branch before it held
        first = first.when(rule.rejects(F.col(p), lambda n: counts[n]), F.lit(rule.name))
    base = BASE[0].rejects(F.col(p), lambda n: counts[n]) | BASE[1].rejects(F.col(p), lambda n: counts[n])
    verdict = F.struct(*[counts[n].alias(n) for n in COUNTS], base.alias("base_failed"), first.alias("failed_rule"), first.isNull().alias("kept"))
    return df.withColumn(out, verdict).drop(p, c)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that every rule keeps, with the columns of ``docs``: each rule filters what those before it left."""
    (p,) = fresh(docs, "__parts")
    order = [x[0] for x in cascade_order(docs, text, rules, rows)]
    df = with_parts(docs, text, p)
    for rule in order:
        df = df.where(~rule.rejects(F.col(p), _own(F.col(p))))
    return df.drop(p)
