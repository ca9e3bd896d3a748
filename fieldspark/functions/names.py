"""Names of results, state lists and label ranges, as users write them."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A name, class, label, state, material or subscript that the data does not have."""


@dataclass(frozen=True)
class Name:
    """``x``, ``x[3]``, ``x[1,2]`` (subscripts from 1) or ``vec[comp]``."""

    base: str
    subscript: tuple[int, ...] = ()
    component: str | None = None


def parse_name(text: str) -> Name:
    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(?:\[([^\]]*)\])?\s*", text)
    if not m:
        raise QueryError(f"not a result name: {text!r}")
    if m[2] is None:
        return Name(m[1])
    parts = [p.strip() for p in m[2].split(",")]
    if all(re.fullmatch(r"\d+", p) for p in parts):
        return Name(m[1], tuple(map(int, parts)))
    if len(parts) == 1 and parts[0]:
        return Name(m[1], component=parts[0])
    raise QueryError(f"mixed subscript: {text!r}")


def ravel(subscript: tuple[int, ...], dims: tuple[int, ...]) -> int:
    """Row-major place, from 0, of a full subscript from 1."""
    if len(subscript) != len(dims):
        raise QueryError(f"{len(subscript)} subscripts for {len(dims)} dimensions")
    place = 0
    for i, d in zip(subscript, dims, strict=True):
        if not 1 <= i <= d:
            raise QueryError(f"subscript {i} is not in 1..{d}")
        place = place * d + i - 1
    return place


def states(wanted: list[int] | int | None, count: int) -> list[int]:
    """Sorted distinct states from 1; negative ones count from the end; None is all."""
    if wanted is None:
        return list(range(1, count + 1))
    out = {s + count + 1 if s < 0 else s for s in ([wanted] if isinstance(wanted, int) else wanted)}
    if bad := [s for s in out if not 1 <= s <= count]:
        raise QueryError(f"states out of 1..{count}: {sorted(bad)}")
    return sorted(out)


def ranges(text: str) -> list[tuple[int, int]]:
    """``"1-10,15"`` as inclusive pairs."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise QueryError(f"not a range: {part!r}")
        out.append((int(m[1]), int(m[2] or m[1])))
    return out
