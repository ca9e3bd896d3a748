"""Mixing to target weights by soft membership, in DataFrame functions only.

1. A multinomial naive Bayes over hashed words (``BUCKETS``) is counted on a bounded, documented sample of labelled
   rows (``TRAIN_ROWS`` in hash order). Its table has domains x buckets numbers, a fixed size, and goes into the plan as
   a literal; posteriors are a column expression over each row's whole text, so there is no join and no shuffle.
2. Rates r >= floor solve: minimise sum over domains of (sum of r n p - target)^2 / (S s) + MU * sum of n (r - 1)^2 / S,
   for token counts n, posteriors p, S all tokens and s the domain's share. Projected gradient with unit steps: under
   these weights the Hessian's norm is at most 1 + MU. An iteration aggregates one number for each domain; a row's
   rate replays the residuals so far, so no state is kept and a lost executor costs a recomputation only.

The iteration ends when all targets are met to ``TOLERANCE``, or when a step changes no residual by more than that (some
targets are then out of reach at the floor), or after ``ITERATIONS`` steps. The report says whether all targets are met and
whether the iteration came to rest; where not, a warning gives the report.

Null and empty texts have no tokens and the prior as posterior. Rows without a domain label count for nothing in the
fit, and are scored like all others; of an id's labels the least by name counts. Without any label there is one domain
and every rate is 1. Repeated rows have equal rates; ties of posteriors go to the first domain by name. Domains without
tokens get no target. Texts of any length count whole; an empty table gives no rows. Columns of any name may stand beside
the id and the text.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_GAP, fresh, stored

#: Labelled rows that the classifier is fitted on at most; hash buckets; words after which evidence counts no further.
TRAIN_ROWS, BUCKETS, EVIDENCE = 4096, 4096, 32
#: Pull of the rates towards 1; relative residual, or change of it, that ends the iteration; iterations at most.
MU, TOLERANCE, ITERATIONS = 1e-5, 1e-4, 64
#: Default targets are shares to this power: below 1 it lifts rare domains.
FLATTEN = 0.7

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    prior: list[float]
    word: list[list[float]]  # log probability by domain and bucket


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def train(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text: str = "text", domain: str = "domain", rows: int = TRAIN_ROWS) -> Classifier:
    chosen = (
        labelled.select(F.col(id_column).alias("__id"), F.col(domain).cast("string").alias("__domain")).where("__id is not null and __domain is not null")
        .groupBy("__id").agg(F.min("__domain").alias("__domain")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    )
    # at most ``rows`` rows, so the broadcast has a fixed bound
    own = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    counts = own.select("__domain", F.explode(_words(F.col("__text"))).alias("w")).groupBy("__domain", _bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")).collect()
    domains = sorted({r["__domain"] for r in counts})
    if not domains:
        return Classifier([""], [1.0], [[0.0] * BUCKETS])
    at = {d: i for i, d in enumerate(domains)}
    n = [[0] * BUCKETS for _ in domains]
    for r in counts:
        n[at[r["__domain"]]][r["b"]] = r["n"]
    total = [sum(x) for x in n]
    prior = [t / sum(total) for t in total]
    return Classifier(domains, prior, [[round(math.log((c + 0.5) / (t + 0.5 * BUCKETS)), 3) for c in row] for row, t in zip(n, total, strict=True)])


def with_posteriors(docs: DataFrame, model: Classifier, text: str, n: str, p: str) -> DataFrame:
    """``docs`` with its token counts in ``n`` and posteriors in ``p`` (array, in the order of the model's domains)."""
    k = len(model.domains)
    (b,) = fresh(docs, "__b")
    df = docs.withColumn(b, F.transform(_words(F.col(text)), _bucket))
    df = df.withColumn(n, F.size(b).cast("long"))
    if k == 1:
        return df.withColumn(p, F.array(F.lit(1.0))).drop(b)
    logs = [F.from_json(F.lit(json.dumps(row)), "array<double>") for row in model.word]
    (s,) = fresh(df, "__s")

    def evidence(row: Column) -> Column:
        return F.aggregate(F.col(b), F.lit(0.0), lambda a, x: a + F.get(row, x))

    sums = [evidence(row) for row in logs]
    # the mean evidence of a word, counted EVIDENCE times at most, so that long texts stay soft
    weight = F.least(F.col(n), F.lit(EVIDENCE)) / F.greatest(F.col(n), F.lit(1))
    df = df.withColumn(s, F.array(*[x * weight + math.log(q) for x, q in zip(sums, model.prior, strict=True)]))
    df = df.withColumn(s, F.transform(F.col(s), lambda x: F.exp(x - F.array_max(F.col(s)))))
    df = df.withColumn(p, F.transform(F.col(s), lambda x: F.round(x / F.aggregate(F.col(s), F.lit(0.0), lambda a, y: a + y), 6)))
    return df.drop(b, s)


def _rate(p: Column, history: list[list[float]], floor: float) -> Column:
    r = F.lit(1.0)
    for c in history:
        dot = sum((p[i] * F.lit(x) for i, x in enumerate(c)), F.lit(0.0))
        r = F.greatest(F.lit(float(floor)), r * F.lit(1 - MU) - dot + F.lit(MU))
    return F.round(r, 9)


def fit_rates(scored: DataFrame, domains: list[str], n: str, p: str, weights: dict[str, float] | None = None, floor: float = 0.0, flatten: float = FLATTEN) -> tuple[Column, dict]:
    """The rate as a Column over ``p``, and a report: tokens, targets and fitted totals by domain, iterations, whether all targets are met, and whether it came to rest.

    ``weights`` are relative target totals; by default the shares to the power ``flatten``. With a floor of 0 the
    targets add up to all tokens; with a floor, to the least total that needs no rate below it.
    """
    k = len(domains)

    def totals(rate: Column) -> list[float]:
        row = scored.agg(*[F.sum((rate * F.col(n) * F.col(p)[i]).cast("decimal(30,6)")).alias(f"t{i}") for i in range(k)]).first()
        return [float(x or 0) for x in row]

    now = totals(F.lit(1.0))
    whole = sum(now)
    if not whole:
        return F.lit(1.0), {"domains": domains, "tokens": now, "targets": now, "fitted": now, "iterations": 0, "met": True, "at_rest": True}
    share = [t / whole for t in now]
    want = [(weights.get(d, 0.0) if weights else s**flatten) * (s > 0) for d, s in zip(domains, share, strict=True)]
    want = [w / sum(want) for w in want] if sum(want) else share
    total = whole if not floor else whole * max(floor * s / w for s, w in zip(share, want, strict=True) if w)
    targets = [w * total for w in want]
    history: list[list[float]] = []
    fitted, last, met, rest = now, [math.inf] * k, False, False
    while True:
        residual = [(f - t) / (whole * s) if s else 0.0 for f, t, s in zip(fitted, targets, share, strict=True)]
        met = max(map(abs, residual)) < TOLERANCE
        # at the floor some targets may be out of reach: then the residual stays, and a step changes it no more
        rest = met or max(abs(r - q) for r, q in zip(residual, last, strict=True)) < TOLERANCE
        if rest or len(history) == ITERATIONS:
            break
        last = residual
        history.append(residual)
        fitted = totals(_rate(F.col(p), history, floor))
    return _rate(F.col(p), history, floor), {"domains": domains, "tokens": now, "targets": targets, "fitted": fitted, "iterations": len(history), "met": met, "at_rest": rest}


def _copies(rate: Column, key: list[Column]) -> Column:
    """The rate's whole part, and one more with its fraction as probability, by a hash of the row's key."""
    u = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def rates(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text: str = "text", domain: str = "domain", weights: dict[str, float] | None = None, floor: float = 0.0) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies) of each row; domain is the likeliest, ties to the first by name."""
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    model = train(docs, labelled, id_column, text, domain)
    scored = stored(with_posteriors(base, model, "text", "n_tokens", "posterior").drop("text"), "posteriors")
    rate, report = fit_rates(scored, model.domains, "n_tokens", "posterior", weights, floor)
    if not report["met"]:
        log.warning("targets not met at floor %s: %s", floor, report)
    best = F.element_at(F.array(*map(F.lit, model.domains)), F.array_position(F.col("posterior"), F.array_max("posterior")).cast("int"))
    out = scored.withColumn("rate", rate)
    return out.select("doc_id", "n_tokens", best.alias("domain"), "posterior", "rate", _copies(F.col("rate"), [F.col("doc_id")]).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text: str = "text", domain: str = "domain", weights: dict[str, float] | None = None, floor: float = 0.0) -> DataFrame:
    """``docs`` with each row as often as its rate says. Columns as in ``docs``."""
    n, p, c = fresh(docs, "__n", "__p", "__c")
    model = train(docs, labelled, id_column, text, domain)
    scored = stored(with_posteriors(docs, model, text, n, p), "scored")
    rate, report = fit_rates(scored, model.domains, n, p, weights, floor)
    if not report["met"]:
        log.warning("targets not met at floor %s: %s", floor, report)
    out = scored.withColumn(c, _copies(rate, [F.col(f"`{id_column}`")])).where(F.col(c) > 0)
    return out.withColumn(c, F.explode(F.array_repeat(F.lit(1), F.col(c).cast("int")))).select([F.col(f"`{x}`") for x in docs.columns])
