"""Scalar text functions as SQL fragments: clean-up, normal forms, comparison."""

from __future__ import annotations

from maskwright.functions import fixed
from maskwright.functions.spans import let, lit, lits, matches, strip, u


def join_broken_names(text: str) -> str:
    """Put a name particle and the capitalised word on the next line together.

    The length does not change.  Particles are handled one after the other
    because joining one can expose the next.
    """
    joined = text
    for particle in fixed.LINE_BREAK_PARTICLES:
        joined = f"regexp_replace({joined}, {lit(u(rf'\b({particle})\n([A-Z][A-Za-z]+)'))}, '$1 $2')"
    gate = u(rf"\b(?:{'|'.join(fixed.LINE_BREAK_PARTICLES)})\n[A-Z][A-Za-z]")
    return f"case when {matches(text, gate)} then {joined} else {text} end"


def words(text: str) -> str:
    return f"filter(split({text}, {lit(u(r'\s+'))}), w -> w != '')"


def normalise_person(value: str) -> str:
    """Upper-case words without particles, in sorted order."""
    core = f"filter({words(f'upper({value})')}, w -> w not in ({lits(fixed.NAME_PARTICLES)}))"
    return f"array_join(array_sort({core}), '|')"


def normalise_phone(value: str) -> str:
    """Digits and plus signs, with 00 and ten-digit local numbers made international."""
    return let(
        "d", f"regexp_replace({value}, {lit(u('[^\\d+]'))}, '')",
        "case when startswith(d, '00') then concat('+', substring(d, 3)) "
        "when startswith(d, '0') and length(d) = 10 then concat('+32', substring(d, 2)) else d end",
    )


def normalise_iban(value: str) -> str:
    return f"regexp_replace(upper({value}), {lit(u(r'\s'))}, '')"


def normalise_other(value: str) -> str:
    return strip(f"upper({value})")


def normalise(value: str, category: str) -> str:
    """The key under which differently written forms count as one value."""
    return (
        f"case {category} when 'PERSON' then {normalise_person(value)} "
        f"when 'PHONE' then {normalise_phone(value)} when 'IBAN' then {normalise_iban(value)} "
        f"else {normalise_other(value)} end"
    )


def placeholder(category: str, num: str) -> str:
    """CATEGORY_NNN, padded to three digits and growing beyond them."""
    return f"format_string('%s_%03d', {category}, {num})"


def category_of(token: str) -> str:
    return f"regexp_extract({token}, {lit(r'(?s)^(.*)_[^_]*$')}, 1)"


def first_difference(left: str, right: str) -> str:
    """0-based position of the first differing character, null if one text is a
    prefix of the other.  Binary search on prefixes: about log2(n) comparisons."""
    mid = "(acc.lo + acc.hi + 1) div 2"
    halved = let(
        "mid", f"cast({mid} as int)",
        f"case when substring({left}, 1, mid) = substring({right}, 1, mid) "
        "then struct(mid as lo, acc.hi as hi) else struct(acc.lo as lo, mid - 1 as hi) end",
    )
    same = (
        f"aggregate(sequence(1, 32), struct(0 as lo, shared as hi), "
        f"(acc, i) -> case when acc.lo < acc.hi then {halved} else acc end, acc -> acc.lo)"
    )
    return let("shared", f"least(length({left}), length({right}))",
               let("same", same, "case when same < shared then same end"))
