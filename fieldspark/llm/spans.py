"""Span lists of the pattern operators: ordering, digests and the Arrow loop."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, sliced

Span = tuple[str, int, int]


def listed(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` joined by commas, by start, then by kind as listed, then by end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


SPAN = "array<struct<kind:string,start:int,end:int,score:double,base:boolean,detail:string>>"


def find(docs: DataFrame, finder, text: str, out: str) -> DataFrame:
    """``docs`` with column ``out``: the finder's spans of the text column (null as empty), found over Arrow batches."""

    @F.pandas_udf(SPAN)
    def spans(texts):
        return texts.map(lambda t: finder(t if isinstance(t, str) else ""))

    return docs.withColumn(out, spans(F.col(text)))


def digests(docs: DataFrame, finder, kinds: tuple[str, ...], base: tuple[str, ...], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans and the list of all spans."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in base), ("base_sha256", pa.string()), ("spans", pa.string())])
    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string"

    def run(batches):
        for batch in sliced(batches, 2048):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = finder(t or "")
                own = [(s["kind"], s["start"], s["end"]) for s in found if s["base"]]
                rows.append((i, *(sum(s[0] == k for s in own) for k in base), digest(listed(own, kinds)), listed([(s["kind"], s["start"], s["end"]) for s in found], kinds)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl)


__all__ = ["SPAN", "digest", "digests", "find", "fresh", "listed"]
