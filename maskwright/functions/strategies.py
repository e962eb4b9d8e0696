"""Anonymisation strategies: (value, category) -> replacement.

Built-in strategies are SQL fragments, so they run inside the span array of a
document without a shuffle.  Own strategies may instead be column functions
(a pandas UDF included); those run on the exploded spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from maskwright.functions.spans import let, lit, u
from maskwright.functions.text import words

Fragment = Callable[[str, str], str]


@dataclass(frozen=True)
class Strategy:
    name: str
    sql: Fragment | None = None
    column: Callable[[Column, Column], Column] | None = None
    reversible: bool = False


def redact(marker: str = "[REDACTED]", include_category: bool = True) -> Strategy:
    """``[CATEGORY]``, or the same marker for everything."""
    return Strategy(
        "redact",
        (lambda v, c: f"concat('[', {c}, ']')") if include_category else (lambda v, c: lit(marker)),
    )


def _stars(char: str, count: str) -> str:
    return f"repeat({lit(char)}, {count})"


def mask_words(value: str, char: str = "*", keep_start: int = 1, keep_end: int = 2) -> str:
    """Each word keeps its ends, short words keep nothing; one space between."""
    kept = keep_start + keep_end
    tail = f"right(w, {keep_end})" if keep_end > 0 else "''"
    word = (
        f"case when length(w) <= {kept} then {_stars(char, 'length(w)')} else "
        f"concat(substring(w, 1, {keep_start}), {_stars(char, f'length(w) - {kept}')}, {tail}) end"
    )
    return f"array_join(transform({words(value)}, w -> {word}), ' ')"


def _first_then_stars(part: str, char: str) -> str:
    return f"case when {part} = '' then '' else concat(substring({part}, 1, 1), {_stars(char, f'length({part}) - 1')}) end"


def mask_email(value: str, char: str = "*", keep_start: int = 1, keep_end: int = 2) -> str:
    """First characters of the local part and the domain, and the last label."""
    at, dot = lit(r"(?s)^(.*)@([^@]*)$"), lit(r"(?s)^(.*)\.([^.]*)$")
    host = let(
        "name", f"regexp_extract(host, {dot}, 1)",
        f"concat({_first_then_stars('name', char)}, '.', regexp_extract(host, {dot}, 2))",
    )
    masked = let("loc", f"regexp_extract({value}, {at}, 1)", let(
        "host", f"regexp_extract({value}, {at}, 2)",
        f"concat({_first_then_stars('loc', char)}, '@', "
        f"case when contains(host, '.') then {host} else {_stars(char, 'length(host)')} end)"))
    return f"case when contains({value}, '@') then {masked} else {mask_words(value, char, keep_start, keep_end)} end"


def mask_phone(value: str, char: str = "*") -> str:
    """The first and last two digits survive, separators stay where they are."""
    no_digit = lit(u(r"\D"))
    masked = (
        f"array_join(transform(sequence(1, length({value})), i -> case "
        f"when not regexp_like(substring({value}, i, 1), {lit(u(r'\d'))}) then substring({value}, i, 1) "
        f"when length(regexp_replace(substring({value}, 1, i), {no_digit}, '')) <= 2 then substring({value}, i, 1) "
        f"when length(regexp_replace(substring({value}, i), {no_digit}, '')) <= 2 then substring({value}, i, 1) "
        f"else {lit(char)} end), '')"
    )
    digits = f"length(regexp_replace({value}, {no_digit}, ''))"
    return f"case when {digits} <= 4 then {_stars(char, f'length({value})')} else {masked} end"


def mask_iban(value: str, char: str = "*") -> str:
    """The first and last four characters survive; groups of four if it had spaces."""
    clean = f"replace({value}, ' ', '')"
    masked = f"concat(substring(iban, 1, 4), {_stars(char, 'length(iban) - 8')}, right(iban, 4))"
    grouped = f"regexp_replace({masked}, {lit('(.{4})(?=.)')}, '$1 ')"
    return let(
        "iban", clean,
        f"case when length(iban) < 8 then {_stars(char, f'length({value})')} "
        f"when contains({value}, ' ') then {grouped} else {masked} end",
    )


def mask(mask_char: str = "*", keep_start: int = 1, keep_end: int = 2) -> Strategy:
    return Strategy("mask", lambda v, c: (
        f"case {c} when 'EMAIL' then {mask_email(v, mask_char, keep_start, keep_end)} "
        f"when 'PHONE' then {mask_phone(v, mask_char)} when 'IBAN' then {mask_iban(v, mask_char)} "
        f"else {mask_words(v, mask_char, keep_start, keep_end)} end"))


def hash_values(algorithm: str = "sha256", truncate: int | None = 16, salt: str | None = None) -> Strategy:
    """Hex digest of salt, value and category; unknown algorithms mean SHA-256."""

    def digest(v: str, c: str) -> str:
        salted = f"concat({lit(salt or '')}, {v}, {c})"
        whole = {"md5": f"md5({salted})", "sha512": f"sha2({salted}, 512)"}.get(algorithm, f"sha2({salted}, 256)")
        return f"substring({whole}, 1, {truncate})" if truncate else whole

    return Strategy("hash", digest)


def encrypt(key: str) -> Strategy:
    """AES-GCM, base64; the key (16, 24 or 32 characters) is the caller's."""
    if len(key.encode()) not in (16, 24, 32):
        raise ValueError("the key must have 16, 24 or 32 bytes")
    return Strategy("encrypt", lambda v, c: f"base64(aes_encrypt({v}, {lit(key)}, 'GCM'))", reversible=True)


def decrypt(value: str, key: str) -> str:
    """Inverse of ``encrypt`` as a SQL fragment."""
    return f"cast(aes_decrypt(unbase64({value}), {lit(key)}, 'GCM') as string)"


def replace() -> Strategy:
    """Placeholders from the mapping; the rewrite looks them up."""
    return Strategy("replace", reversible=True)


STRATEGIES: dict[str, Callable[..., Strategy]] = {
    "replace": replace,
    "redact": redact,
    "mask": mask,
    "hash": hash_values,
    "encrypt": encrypt,
}


def get_strategy(strategy: str | Strategy, **options) -> Strategy:
    """A strategy by name with its options, or an own ``Strategy`` as it is."""
    if isinstance(strategy, Strategy):
        return strategy
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](**options)
