"""Overlap resolution inside one document's span array.

Greedy by (confidence desc, length desc, production order).  Spans are first
cut into islands of transitively overlapping neighbours, so the pairwise test
runs inside an island and stays near-linear for a whole document.
"""

from __future__ import annotations

from maskwright.functions import fixed
from maskwright.functions.spans import SPANS, cut, empty, let, lit, overlap, walk


def _islands(spans: str) -> str:
    ordered = f"array_sort(transform({spans}, (s, i) -> struct(s.start as start, s.end as end, i as i, s as s)))"
    heads = walk("ordered", "-1", "greatest(acc.a, r.end)", "case when r.start >= acc.a then acc.n end", "int")
    return let("ordered", ordered, cut("ordered", f"filter({heads}, h -> h is not null)"))


def _greedy(island: str) -> str:
    ranked = (
        f"array_sort(transform({island}, x -> struct(-x.s.confidence as c, x.start - x.end as l, x.i as i, x.s as s)))"
    )
    return (
        f"array_sort(aggregate({ranked}, {empty(SPANS)}, (acc, x) -> case when "
        f"exists(acc, k -> {overlap('k', 'x.s')}) then acc else concat(acc, array(x.s)) end))"
    )


def resolve(spans: str) -> str:
    """Disjoint spans sorted by start; ``spans`` is in production order."""
    picked = f"case when size(isl) = 1 then transform(isl, x -> x.s) else {_greedy('isl')} end"
    return let(
        "spans", spans,
        f"case when size(spans) = 0 then {empty(SPANS)} "
        f"else flatten(transform({_islands('spans')}, isl -> {picked})) end",
    )


def is_masked(value: str) -> str:
    """The value already carries masking characters."""
    return "(" + " or ".join(f"contains({value}, {lit(mark)})" for mark in fixed.MASK_MARKS) + ")"


def drop_masked(spans: str) -> str:
    """Applied after resolution: a masked winner still hides what it beat."""
    return f"filter({spans}, s -> not {is_masked('s.text')})"
