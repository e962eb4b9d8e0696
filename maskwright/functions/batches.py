"""The detectors over many ASCII texts at once, in Python: the same spans as the SQL fragments of ``detectors``.

Inside lambdas Spark interprets SQL fragments, which costs more than the regexes themselves. Here the texts of a batch stand
in one string, a separator between them that no pattern matches and that is no part of a word; each pattern scans
that string once, and offsets, filters and overlap resolution are worked on for the whole batch. Patterns and word lists
are those of ``fixed`` and ``detectors``.

ASCII texts alone come here: there Java's and Python's classes, word edges and cases are the same. What a gate of ``detectors`` asks
of a text is a necessary condition of its patterns, so nothing is asked here.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from maskwright.functions import detectors as sql
from maskwright.functions import fixed

SEPARATOR = "\0"
# Texts of so many characters are searched together.
CHARS = 1 << 20
SPACES = " \t\n\x0b\f\r"


def _compile(pattern: str) -> re.Pattern:
    return re.compile(pattern.removeprefix("(?U)"), re.ASCII)


def _compiled(patterns: Iterable[str]) -> list[re.Pattern]:
    return [_compile(p) for p in patterns]


def _class(characters: str) -> np.ndarray:
    """Whether a character is of a regex class."""
    return np.array([re.match(f"[{characters}]", chr(c), re.ASCII) is not None for c in range(128)] + [False] * 128)


DIGIT, UPPER, LOWER, WORD, SPACE = map(_class, (r"\d", "A-Z", "a-z", r"\w", r"\s"))


def _keys(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 14) | (second.astype(np.int64) << 7) | third


def _key_table(words: Iterable[str]) -> np.ndarray:
    """Which keys words of two or more characters begin with."""
    table = np.zeros(1 << 21, bool)
    for word in words:
        a, b, *rest = word.encode("ascii")[:3]
        table[(a << 14) | (b << 7) | (rest[0] if rest else np.arange(128))] = True
    return table


def _cues(words: Iterable[str]) -> Callable[[str], bool]:
    """Whether one of the words is in a text."""
    words = [w for w in set(words) if w.isascii()]
    least = [w for w in words if not any(o != w and o in w for o in words)]
    return lambda text: any(w in text for w in least)


# --- a batch -----------------------------------------------------------------

@dataclass(frozen=True)
class Found:
    """Spans of one detector as offsets in the whole string; those of one text in the order in which it made them."""

    start: np.ndarray
    end: np.ndarray
    confidence: float | np.ndarray
    ctx_start: np.ndarray
    ctx_end: np.ndarray


def _pairs(rows: list[tuple[int, int]]) -> np.ndarray:
    return np.array(rows, np.int64).reshape(-1, 2)


def _around(rows: list[tuple[int, int]] | np.ndarray, confidence, before: int, after: int) -> Found:
    at = rows if isinstance(rows, np.ndarray) else _pairs(rows)
    return Found(at[:, 0], at[:, 1], confidence, at[:, 0] - before, at[:, 1] + after)


class Cut:
    """Stretches of a string, each with the characters next to it; searched as one string, answered by places in the whole."""

    def __init__(self, text: str, stretches: np.ndarray):
        self.text = SEPARATOR.join([text[s - 1:e + 1] for s, e in stretches.tolist()])
        self.first = np.concatenate([[0], np.cumsum(stretches[:, 1] - stretches[:, 0] + 3)])[:-1]
        self.shift = stretches[:, 0] - 1 - self.first

    def find(self, pattern: re.Pattern) -> np.ndarray:
        at = _pairs([m.span() for m in pattern.finditer(self.text)])
        if not len(at):
            return at
        return at + self.shift[np.searchsorted(self.first, at[:, 0], "right") - 1][:, None]


@dataclass(frozen=True)
class Starts:
    """Words that begin with a run of one class: where, how long the run is, and the two characters after it."""

    at: np.ndarray
    n: np.ndarray
    after: np.ndarray
    then: np.ndarray


class Batch:
    def __init__(self, texts: list[str]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text = SEPARATOR + SEPARATOR.join(texts) + SEPARATOR
        self.lowered = self.text.lower()
        self.first = 1 + np.concatenate([[0], np.cumsum(lengths + 1)])[:-1].astype(np.int64)
        # separators after the end, so that there are characters after every place
        self.codes = np.frombuffer((self.text + 3 * SEPARATOR).encode("ascii"), np.uint8)
        self.low_codes = np.frombuffer((self.lowered + 3 * SEPARATOR).encode("ascii"), np.uint8)
        word = WORD[self.codes]
        self.edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        begins = word[self.edges]
        self.begins, self.ends = self.edges[begins], self.edges[~begins]
        self._outside: dict[bytes, np.ndarray] = {}

    @cached_property
    def firsts(self) -> list[int]:
        return self.first.tolist()

    def outside(self, kind: np.ndarray) -> np.ndarray:
        """Places of the characters that are not of a class."""
        key = kind.tobytes()
        if key not in self._outside:
            self._outside[key] = np.flatnonzero(~kind[self.codes])
        return self._outside[key]

    def run(self, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of a class begin and end that hold what stands before the places."""
        outside = self.outside(kind)
        i = np.searchsorted(outside, at, "left")
        return outside[i - 1] + 1, outside[i]

    def _starts(self, kind: np.ndarray) -> Starts:
        at = self.begins[kind[self.codes[self.begins]]]
        end = self.run(kind, at + 1)[1]
        return Starts(at, end - at, self.codes[end], self.codes[end + 1])

    @cached_property
    def digits(self) -> Starts:
        return self._starts(DIGIT)

    @cached_property
    def capitals(self) -> Starts:
        return self._starts(UPPER)

    @cached_property
    def keys(self) -> np.ndarray:
        """The first three characters of words, and of what begins at the end of one."""
        e = self.edges
        return _keys(self.codes[e], self.codes[e + 1], self.codes[e + 2])

    @cached_property
    def low_keys(self) -> np.ndarray:
        e = self.edges
        return _keys(self.low_codes[e], self.low_codes[e + 1], self.low_codes[e + 2])

    @cached_property
    def numbers(self) -> Cut:
        """What has eight digits or more with nothing but separators of phone numbers between them."""
        return Cut(self.text, _pairs([m.span() for m in _EIGHT_DIGITS.finditer(self.text)]))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The texts' indexes for places in the string."""
        return np.searchsorted(self.first, at, "right") - 1

    def before(self, start: int, width: int) -> str:
        """Up to so many lower-case characters of the same text before a place."""
        low = start - width
        stretch = self.lowered[max(low, 0):start]
        if SEPARATOR in stretch:  # or a character of the text that looks like one
            low = max(low, self.firsts[bisect_left(self.firsts, start + 1) - 1])
            stretch = self.lowered[max(low, 0):start]
        return stretch

    def matches(self, pattern: re.Pattern, at: np.ndarray) -> Iterator[re.Match]:
        """What ``finditer`` finds of a pattern that can only begin at the places."""
        done, match = 0, pattern.match
        for place in at.tolist():
            if place >= done and (m := match(self.text, place)):
                done = m.end()
                yield m

    def spans(self, pattern: re.Pattern, at: np.ndarray) -> list[tuple[int, int]]:
        return [m.span() for m in self.matches(pattern, at)]


_EIGHT_DIGITS = re.compile(r"\d(?:[-+/.()\s]*+\d){7,}+", re.ASCII)

Finder = Callable[[Batch], Found]
# Where in a batch a pattern can begin, as it begins with a word edge and what is asked here.
Where = Callable[[Batch], np.ndarray]


def _digits(test: Callable[[Starts], np.ndarray]) -> Where:
    return lambda b: b.digits.at[test(b.digits)]


def _capitals(test: Callable[[Starts], np.ndarray]) -> Where:
    return lambda b: b.capitals.at[test(b.capitals)]


def _words(*words: str) -> Where:
    table = _key_table(words)
    return lambda b: b.edges[table[b.keys]]


# --- structured data ---------------------------------------------------------

# A sign that may come before a number is added to what is found without it.
_SIGN = r"\+?"
_PHONES = [(p.startswith(_SIGN), _compile(re.sub(r"^\\b0", r"0(?<!\\w0)", p.removeprefix(_SIGN)))) for p in fixed.PHONES]


def phones(b: Batch) -> Found:
    # all their characters are digits and separators, eight digits at least
    found = []
    for signed, pattern in _PHONES:
        at = b.numbers.find(pattern)
        if signed:
            at[:, 0] -= b.codes[at[:, 0] - 1] == ord("+")
        found.append(at)
    return _around(np.concatenate(found), 0.95, 20, 20)


_LOCAL = _class(fixed.EMAIL_LOCAL[1:-1])
_DOMAIN = re.compile(fixed.EMAIL.removeprefix(fixed.EMAIL_LOCAL + "+"), re.ASCII)


def emails(b: Batch) -> Found:
    # a run of local characters, or what is left of it after another address
    at = np.flatnonzero(b.codes == ord("@"))
    found, done = [], 0
    for start, place in zip(b.run(_LOCAL, at)[0].tolist(), at.tolist(), strict=True):
        start = max(start, done)
        if start < place and (m := _DOMAIN.match(b.text, place)):
            done = m.end()
            found.append((start, done))
    return _around(found, 0.99, 20, 20)


_IBANS = _compiled(fixed.IBANS)


def ibans(b: Batch) -> Found:
    # two capitals, then a digit
    at = b.capitals.at[(b.capitals.n == 2) & DIGIT[b.capitals.after]]
    found = [span for pattern in _IBANS for span in b.spans(pattern, at)]
    return _around([(s, e) for s, e in found if "XX" not in (value := b.text[s:e]) and "xx" not in value], 0.95, 20, 20)


_ROAD, _ROAD_HEAD = _compile(fixed.ROAD), _class("NAERnaer")


def roads(b: Batch) -> Found:
    at = b.begins[_ROAD_HEAD[b.codes[b.begins]] & DIGIT[b.codes[b.begins + 1]]]
    return _around(b.spans(_ROAD, at), 0.95, 20, 20)


def _capital_before_number(b: Batch) -> np.ndarray:
    """Capitals that only small letters, then white space and a number follow."""
    ends = b.run(SPACE, b.digits.at)[0]
    ends = ends[ends < b.digits.at]
    at = b.run(LOWER, ends)[0]
    return (at - 1)[(at < ends) & UPPER[b.codes[at - 1]]]


_STREET_AND_NUMBER = _capital_before_number
_NUMBER_AND_NAME = _digits(lambda s: SPACE[s.after] & (SPACE[s.then] | UPPER[s.then]))
_ADDRESS_STARTS: list[Where] = [
    _STREET_AND_NUMBER,
    _digits(lambda s: (s.n == 4) & (s.after == ord(" ")) & UPPER[s.then]),
    _digits(lambda s: (s.n == 4) & (SPACE[s.after] | UPPER[s.after])),
    _NUMBER_AND_NAME,
    _digits(lambda s: s.n == 5),
    _capitals(lambda s: (s.n == 1) & LOWER[s.after]),
    _capitals(lambda s: (s.n <= 2) & DIGIT[s.after]),
    _NUMBER_AND_NAME,
    _digits(lambda s: SPACE[s.after] & (SPACE[s.then] | LOWER[s.then])),
    _digits(lambda s: (s.n == 5) & SPACE[s.after]),
    _STREET_AND_NUMBER,
    _digits(lambda s: (s.n == 5) & SPACE[s.after]),
]
_ADDRESSES = list(zip(_compiled(sql.address_patterns()), _ADDRESS_STARTS, strict=True))
_STATE = re.compile(r",\s*[A-Z]{2}\s+\d{5}", re.ASCII)


def addresses(b: Batch) -> Found:
    found = []
    for i, (pattern, where) in enumerate(_ADDRESSES):
        if i != 5 or _STATE.search(b.text):
            found += b.spans(pattern, where(b))
    return _around([(s, e) for s, e in found if "\n" not in b.text[s:e]], 0.85, 30, 20)


_DATE, _DATE_MARK = _compile(fixed.DATE), _class(r"\-/.")
_DATE_START = _digits(lambda s: (s.n <= 2) & _DATE_MARK[s.after] & DIGIT[s.then])
_DOB_CUE = _cues(fixed.DOB_CUES)


def dates_of_birth(b: Batch) -> Found:
    return _around([(s, e) for s, e in b.spans(_DATE, _DATE_START(b)) if _DOB_CUE(b.before(s, 30))], 0.90, 30, 20)


# Of digits and separators alone, nine digits or more: searched in ``numbers``. Others by where they begin.
_ID_STARTS: dict[str, Where] = {
    "UK_NI": _capitals(lambda s: (s.n == 2) & (DIGIT[s.after] | SPACE[s.after])),
    "DE_SOZVERS": _digits(lambda s: (s.n == 8) | (s.n == 2) & SPACE[s.after]),
    "DE_PERSO": _capitals(lambda s: (s.n == 1) & DIGIT[s.after]),
    "ES_DNI": _digits(lambda s: s.n == 8),
    "ES_NIE": lambda b: b.capitals.at[(b.capitals.n == 1) & _NIE_HEAD[b.codes[b.capitals.at]]],
    "IT_CF": _capitals(lambda s: (s.n == 6) & DIGIT[s.after]),
    "PASSPORT": _capitals(lambda s: (s.n <= 2) & DIGIT[s.after]),
}
_NIE_HEAD = _class("XYZ")
_NATIONAL_IDS = [(_compile(p), kind, _ID_STARTS.get(kind)) for p, kind in fixed.NATIONAL_IDS]
_ID_CUE, _SSN_CUE = _cues(fixed.ID_CUES), _cues(fixed.SSN_CUES)
_UNDOTTED = str.maketrans("", "", ".- ")


def bsn_valid(value: str) -> bool:
    digits = [int(c) for c in value if c in "0123456789"]
    return len(digits) == 9 and sum(w * d for w, d in zip(fixed.BSN_WEIGHTS, digits, strict=True)) % 11 == 0


def national_ids(b: Batch) -> Found:
    found, cued = [], []
    for pattern, kind, where in _NATIONAL_IDS:
        hits = b.numbers.find(pattern).tolist() if where is None else b.spans(pattern, where(b))
        for s, e in hits:
            before = b.before(s, 50)
            cue = _ID_CUE(before)
            if kind == "NL_BSN":
                kept = cue or bsn_valid(b.text[s:e])
            elif kind == "US_SSN":
                kept = _SSN_CUE(before)
            elif kind == "BE_NATIONAL":
                kept = cue or len(b.text[s:e].translate(_UNDOTTED)) != 11
            elif kind == "PASSPORT":
                kept = cue
            else:
                kept = True
            if kept:
                found.append((s, e))
                cued.append(cue)
    return _around(found, np.where(np.array(cued, bool), 0.85, 0.70), 30, 20)


# --- terms -------------------------------------------------------------------

class Terms:
    """Whole words of a list in any case, the longest at each place; they may overlap."""

    def __init__(self, terms: Iterable[str]):
        words = sorted({t.lower() for t in terms if t.isascii()}, key=lambda t: (-len(t), t))
        by_head: dict[str, list[str]] = {}
        for word in words:
            by_head.setdefault(word[0], []).append(re.escape(word[1:]))
        heads = "|".join(f"{re.escape(head)}(?:{'|'.join(tails)})" for head, tails in by_head.items())
        self.pattern = re.compile(rf"\b(?:{heads})\b", re.ASCII)
        self.table = _key_table(words)

    def find(self, b: Batch) -> list[tuple[int, int]]:
        at, match = b.edges[self.table[b.low_keys]], self.pattern.match
        return [m.span() for p in at.tolist() if (m := match(b.lowered, p))]


# --- places and streets ------------------------------------------------------

_PLACES = Terms(fixed.PLACES)
_PREPOSITION = _compile(fixed.PREPOSITION_PLACE)
_NOT_AFTER_PREPOSITION, _LISTED = set(fixed.NOT_A_PLACE_AFTER_PREPOSITION), set(fixed.PLACES)


def places(b: Batch) -> Found:
    known = _PLACES.find(b)
    taken = set(known)
    hits = []
    for m in _PREPOSITION.finditer(b.text):
        name, at = m[1], m.span(1)
        if len(name) >= 3 and name not in _LISTED and name.lower() not in _NOT_AFTER_PREPOSITION and at not in taken:
            hits.append((*at, *m.span()))
    after = np.array(hits, np.int64).reshape(-1, 4)
    at, around = (np.concatenate([_pairs(known), part]) for part in (after[:, :2], after[:, 2:]))
    confidence = np.repeat([0.95, 0.75], [len(known), len(hits)])
    return Found(at[:, 0], at[:, 1], confidence, around[:, 0] - 20, around[:, 1] + 20)


_TOWARDS, _CODE = _words("richting"), _digits(lambda s: (s.n == 4) & ((s.after == ord(" ")) | UPPER[s.after]))
_MARKER_STARTS: list[Where] = [
    _words(*(f"te{c}" for c in SPACES)), _TOWARDS, _words("naar"), _words("vanuit"), _words("via"), _words("th", "t."), _words("ter hoogte"),
    _CODE, _CODE, _capitals(lambda s: (s.n >= 3) & SPACE[s.after]), _TOWARDS,
]
_MARKERS = list(zip(_compiled(fixed.LOCATION_MARKERS), _MARKER_STARTS, strict=True))
_NOT_AFTER_MARKER = set(fixed.NOT_A_PLACE_AFTER_MARKER)


def context_places(b: Batch) -> Found:
    rows = []
    for pattern, where in _MARKERS:
        for m in b.matches(pattern, where(b)):
            name = m[1]
            if len(name) >= 3 and name not in _NOT_AFTER_MARKER:
                start = m.start() + m[0].find(name)
                rows.append((start, start + len(name), *m.span()))
    at = np.array(rows, np.int64).reshape(-1, 4)
    return Found(at[:, 0], at[:, 1], 0.90, at[:, 2] - 10, at[:, 3] + 10)


_STREET_TABLE, _STREET_CHARS = _key_table(s[-3:] for s in fixed.STREET_SUFFIXES), _class(r"A-Za-z\-")
_STREET = re.compile(sql._any_street(), re.ASCII)
_NOT_STREETS = {*fixed.STREET_SUFFIXES, *fixed.NOT_STREETS}


def any_street(b: Batch) -> Found:
    # a street lies in a run of letters and hyphens where a word has one of the endings
    low, e = b.low_codes, b.ends[b.ends >= 3]
    e = e[_STREET_TABLE[_keys(low[e - 3], low[e - 2], low[e - 1])]]
    found = []
    if len(e):
        stretches = np.stack(b.run(_STREET_CHARS, e), 1)
        stretches = stretches[np.append(True, stretches[1:, 0] != stretches[:-1, 0])]
        for s, e in Cut(b.lowered, stretches).find(_STREET).tolist():
            value = b.lowered[s:e]
            if e - s >= 6 and value not in _NOT_STREETS and not value.endswith("ering"):
                found.append((s, e))
    return _around(found, 0.88, 20, 20)


# --- persons -----------------------------------------------------------------

_CAPITALS = _capitals(lambda s: (s.n >= 2) & SPACE[s.after])
_NAME_STARTS: list[Where] = [
    _CAPITALS,
    _words("El", "Van", "De", "Der", "Den", "Ten", "Ter", "La", "Le"),
    _words("Jean", "Marie", "Pierre", "Jacques", "Philippe", "Fran", "Michel", "Andr", "Louis", "Charles"),
    _words("de", "du"),
    _words("von", "zu", "vom"),
    _words("O'"),
    _words("Mc", "Mac"),
    _CAPITALS,
    _capitals(lambda s: (s.n == 1) & LOWER[s.after]),
    _CAPITALS,
    _words("Mr", "Ms", "Miss", "Dr", "Prof"),
]
_NAMES = list(zip(_compiled(fixed.NAMES), _NAME_STARTS, strict=True))
_NOT_NAMES, _NOT_LAST = set(fixed.NOT_NAMES), set(fixed.NOT_LAST_IN_NAMES)
_NOT_IN_NAME = _cues(fixed.NOT_IN_NAMES)
_SPACE = re.compile(r"\s+", re.ASCII)


def names(b: Batch) -> Found:
    found = []
    for pattern, where in _NAMES:
        for m in b.matches(pattern, where(b)):
            value = m[0]
            upper = value.upper()
            if (len(value) >= 5 and "\n" not in value and upper not in _NOT_NAMES and not _NOT_IN_NAME(upper)
                    and _SPACE.split(value)[-1].lower() not in _NOT_LAST):
                found.append(m.span())
    return _around(found, 0.80, 30, 20)


_RUN_CHARS, _RUN = _class(r"A-Za-z'\-\s"), _compile(sql._RUN)
_DATE_TAIL = _compile(sql._DATE_TAIL)
_LOWER_WORD, _UPPER_WORD, _NAME_START = _compile(sql._LOWER_WORD), _compile(sql._UPPER_WORD), _compile(sql._NAME_START)
_NOT_BEFORE_DATE = set(fixed.NOT_NAMES_BEFORE_DATE)


def _name_start(run: str) -> int | None:
    """See ``detectors._name_start``."""
    words, gaps = _SPACE.split(run), _SPACE.findall(run)
    phase = tail = 0
    for word in reversed(words):
        if phase == 0 and _UPPER_WORD.match(word):
            pass
        elif _LOWER_WORD.match(word):
            phase = 1
        else:
            break
        tail += 1
    for i in range(max(len(words) - tail - 1, 0), len(words)):
        if m := _NAME_START.search(words[i]):
            return sum(map(len, words[:i])) + sum(map(len, gaps[:i])) + m.start()
    return None


def _names_before_dates(b: Batch) -> list[tuple[int, int]]:
    # dates after a hyphen; what else ends in a date has no name
    at = b.digits.at[(b.digits.n <= 2) & _DATE_MARK[b.digits.after]]
    at = at[b.codes[b.run(SPACE, at)[0] - 1] == ord("-")]
    found, done = [], 0
    for start, place in zip(b.run(_RUN_CHARS, at)[0].tolist(), at.tolist(), strict=True):
        if start < done or not (m := _DATE_TAIL.match(b.text, place)):
            continue
        done = m.end()
        run = r[1] if (r := _RUN.match(b.text[start:done])) else ""
        skip = _name_start(run)
        if skip is not None and len(run) - skip >= 3 and run[skip:].lower() not in _NOT_BEFORE_DATE:
            found.append((start + skip, start + len(run)))
    return found


_CAPS_NAME, _NOT_CAPS = _compile(sql._CAPS_NAME), set(fixed.NOT_CAPS_NAMES)
_CAPS_START = _capitals(lambda s: s.n >= 3)
_TOKEN, _TOKEN_CHARS = re.compile(r"(?<=\s)PERSON_\d{3,4}", re.ASCII), _class(r"A-Za-z\s")
_BEFORE_TOKEN = _compile(fixed.NAME_BEFORE_TOKEN.replace(")+)", ")++)"))


def _caps_names(b: Batch) -> list[tuple[int, int]]:
    found = []
    for m in b.matches(_CAPS_NAME, _CAPS_START(b)):
        name = m[1].strip(SPACES)
        if name not in _NOT_CAPS:
            found.append((m.start(), m.start() + len(name)))
    return found


def _names_before_tokens(b: Batch) -> list[tuple[int, int]]:
    # in the run of letters and white space before a token
    tokens = _pairs([m.span() for m in _TOKEN.finditer(b.text)])
    if not len(tokens):
        return []
    tokens[:, 0] = b.run(_TOKEN_CHARS, tokens[:, 0])[0]
    stretches = Cut(b.text, tokens)
    places = stretches.find(_BEFORE_TOKEN).tolist()
    return [(s, s + n) for s, e in places if (n := len(_BEFORE_TOKEN.match(b.text, s)[1])) >= 4]


def without_overlaps(spans: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The spans that overlap none of the others."""
    if not len(spans) or not len(others):
        return spans
    others = others[np.argsort(others[:, 0], kind="stable")]
    reach = np.concatenate([[-1], np.maximum.accumulate(others[:, 1])])
    return spans[reach[np.searchsorted(others[:, 0], spans[:, 1], "left")] <= spans[:, 0]]


def context_names(b: Batch) -> Found:
    dated = _names_before_dates(b)
    caps = [tuple(r) for r in without_overlaps(_pairs(_caps_names(b)), _pairs(dated)).tolist()]
    seen = {*dated, *caps}
    tokens = [at for at in _names_before_tokens(b) if at not in seen]
    confidence = np.repeat([0.88, 0.85, 0.82], [len(dated), len(caps), len(tokens)])
    return _around([*dated, *caps, *tokens], confidence, 10, 30)


# --- vehicles ----------------------------------------------------------------

_BRANDS, _MODELS = Terms(fixed.BRANDS), Terms(fixed.MODELS)
# a longer brand hides the shorter one it starts with
_WITHIN = {b: [s for s in fixed.BRANDS if s.isascii() and b.startswith(s)] for b in fixed.BRANDS if b.isascii()}
_TAILS = {b: re.compile(re.escape(b) + fixed.BRAND_TAIL + r"\b", re.ASCII) for b in _WITHIN}


def vehicles(b: Batch) -> Found:
    brands, done = [], dict.fromkeys(_TAILS, 0)
    for s, e in _BRANDS.find(b):
        for brand in _WITHIN[b.lowered[s:e]]:
            # matches of one brand do not overlap; those of different brands may
            if s >= done[brand] and (m := _TAILS[brand].match(b.lowered, s)):
                done[brand] = m.end()
                if m.end() - s >= 3:
                    brands.append((s, m.end()))
    models = without_overlaps(_pairs(_MODELS.find(b)), _pairs(brands))
    at = np.concatenate([_pairs(sorted(brands)), models])
    return _around(at, np.repeat([0.92, 0.88], [len(brands), len(models)]), 20, 20)


FINDERS: dict[str, Finder] = {
    "email": emails,
    "iban": ibans,
    "phone": phones,
    "vehicle": vehicles,
    "road": roads,
    "dob": dates_of_birth,
    "address": addresses,
    "any_street": any_street,
    "context_place": context_places,
    "place": places,
    "national_id": national_ids,
    "context_name": context_names,
    "name": names,
}


# --- all detectors of a batch ------------------------------------------------

def _greedy(island: list[int], start: list[int], end: list[int], confidence: list[float]) -> list[int]:
    """The indexes kept of those of one island: by confidence, then length, then production order, which is the indexes'."""
    taken: list[tuple[int, int, int]] = []  # disjoint, by start
    for _, _, i in sorted([(-confidence[i], start[i] - end[i], i) for i in island]):
        at = bisect_left(taken, (end[i],))
        if at == 0 or taken[at - 1][1] <= start[i]:
            taken.insert(at, (start[i], end[i], i))
    return [i for _, _, i in taken]


def resolve(start: np.ndarray, end: np.ndarray, confidence: np.ndarray) -> np.ndarray:
    """Indexes of disjoint spans, by start; the spans of a text are in production order. See ``functions.resolve``."""
    if not len(start):
        return np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    s, e = start[order], end[order]
    reach = np.maximum.accumulate(e)
    heads = np.flatnonzero(np.concatenate([[True], s[1:] >= reach[:-1]]))
    sizes = np.diff(np.append(heads, len(s)))
    kept = np.zeros(len(s), bool)
    kept[order[heads[sizes == 1]]] = True
    many = sizes > 1
    rows, starts, ends, confidences = order.tolist(), start.tolist(), end.tolist(), confidence.tolist()
    picked: list[int] = []
    for h, n in zip(heads[many].tolist(), sizes[many].tolist(), strict=True):
        picked += _greedy(rows[h:h + n], starts, ends, confidences)
    kept[picked] = True
    return order[kept[order]]


def _spans(texts: list[str], names: tuple[str, ...], resolved: bool) -> tuple[np.ndarray, pa.StructArray]:
    """How many spans each text has, and the spans."""
    batch = Batch(texts)
    parts = []
    for nr, name in enumerate(names):
        found = FINDERS[name](batch)
        owner = batch.owner(found.start)
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        confidence = np.broadcast_to(np.asarray(found.confidence, float), found.start.shape)[order]
        parts.append((owner, found.start[order], found.end[order], confidence, found.ctx_start[order], found.ctx_end[order],
                      np.full(len(owner), nr), np.arange(len(owner)) - np.searchsorted(owner, owner, "left")))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    # of all detectors the spans of a text lie together, in production order
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    if resolved:
        kept = resolve(*columns[1:4])
        columns = [c[kept] for c in columns]
    owner, start, end, confidence, ctx_start, ctx_end, nr, number = columns
    text = batch.text
    values = pa.array([text[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.string())
    shift = batch.first[owner]
    whole = lambda a: pa.array(a.astype(np.int32))
    nr = pa.array(nr)
    spans = pa.StructArray.from_arrays(
        [whole(start - shift), whole(end - shift), values, pa.array([sql.CATEGORIES[n] for n in names]).take(nr),
         pa.array(confidence), pa.array(list(names)).take(nr), whole(np.maximum(ctx_start - shift, 0)), whole(ctx_end - shift), whole(number)],
        ["start", "end", "text", "category", "confidence", "detector", "ctx_start", "ctx_end", "ord"])
    return np.bincount(owner, minlength=len(texts)), spans


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts to be searched together; one that holds the separator is on its own."""
    group, chars = [], 0
    for text in texts:
        alone = SEPARATOR in text
        if group and (alone or chars + len(text) > CHARS):
            yield group
            group, chars = [], 0
        group.append(text)
        chars += len(text)
        if alone:
            yield group
            group, chars = [], 0
    if group:
        yield group


def spans_of(texts: pa.Array, names: tuple[str, ...], resolved: bool = False) -> pa.ListArray:
    """Spans of the named detectors, in production order or disjoint by start; none for null texts."""
    made = [_spans(group, names, resolved) for group in _groups(["" if t is None else t for t in texts.to_pylist()])]
    if not made:
        made = [_spans([], names, resolved)]
    counts = np.concatenate([n for n, _ in made])
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.concat_arrays([s for _, s in made]))
