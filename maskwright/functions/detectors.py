"""The detectors: a text expression in, an array of spans out, no shuffle.

Each detector is gated by a cheap necessary condition so that rows without a
candidate pay one short scan instead of one scan per pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from maskwright.functions import fixed
from maskwright.functions.spans import (
    SPANS, alternation, any_of, empty, find, find_each, find_terms, has, let, lit, lits,
    matches, number, span, strip, u, window, without_overlaps, without_places,
)

# Necessary conditions, all linear in the text (possessive quantifiers).
EIGHT_DIGITS = u(r"\d(?:[-/.()\s]*+\d){7}")
IBAN_HEAD = u(r"[A-Z]{2}\d{2}")
DATE_HEAD = u(r"\d[-/.]\d{1,2}[-/.]\d{2}")
DASHED_DATE = u(r"[-–]\s*+\d{1,2}[-/.]\d{1,2}[-/.]\d{2}")
DIGIT = u(r"\d")
FOUR_DIGITS = u(r"\d{4}")
TWO_CAPITALS = "[A-Z]{2}"


def _gate(test: str, spans: str) -> str:
    return f"case when {test} then {spans} else {empty(SPANS)} end"


def _all(text, patterns, category, confidence, detector, before, after, keep="true", needs=None):
    """Spans of several patterns, in pattern order, filtered by ``keep`` on x."""
    made = span("x.start", "x.end", "x.text", category, confidence, detector,
                f"x.start - {before}", f"x.end + {after}", "i")
    found = find(text, *[u(p) for p in patterns], needs=needs)
    if keep != "true":
        found = f"filter({found}, x -> {keep})"
    return f"transform({found}, (x, i) -> {made})"


# --- structured data ---------------------------------------------------------

def phones(text: str) -> str:
    # what each pattern has in plain letters
    holds = {0: "0", 1: "+32", 2: "32", 3: "32", 4: "0", 5: "31", 6: "31", 7: "(", 9: "1", 10: "44", 11: "0", 12: "33", 13: "33",
             14: "0", 15: "49", 16: "0", 17: "212", 18: "79", 19: "+"}
    needs = {i: has(text, part) for i, part in holds.items()}
    return _gate(matches(text, EIGHT_DIGITS), _all(text, fixed.PHONES, "PHONE", 0.95, "phone", 20, 20, needs=needs))


def emails(text: str) -> str:
    # A run of local-part characters not followed by "@" fails from each of its
    # positions, so only its first one (or the end of the last match) is tried.
    local = fixed.EMAIL_LOCAL
    pattern = rf"(?:\G|(?<!{local}))" + fixed.EMAIL.replace(local + "+@", local + "++@")
    return _gate(f"contains({text}, '@')", _all(text, [pattern], "EMAIL", 0.99, "email", 20, 20))


def ibans(text: str) -> str:
    keep = "not contains(x.text, 'XX') and not contains(x.text, 'xx')"
    needs = {i: has(text, country) for i, country in enumerate(["BE", "NL", "DE", "FR", "GB", "ES", "IT"])}
    return _gate(matches(text, IBAN_HEAD), _all(text, fixed.IBANS, "IBAN", 0.95, "iban", 20, 20, keep, needs))


def roads(text: str) -> str:
    return _all(text, [fixed.ROAD], "ROAD", 0.95, "road", 20, 20)


# ``[A-Z][a-zé-]+(?:\s+[A-Z][a-zé-]+)*\b`` recurses once per word in Java.  The
# same match without recursion: words that are followed by white space end at
# a word edge if they have a letter after the capital, so each of them is
# committed as long as another word that can end the match comes after it.
_HEAD, _ENDING = r"[A-Z][a-zé-]+", r"\s+[A-Z][a-zé-]+\b"
_ENDLESS = r"(?:\s+[A-Z]-++(?=\s))*+"
_COMMITTED = rf"(?:{_ENDLESS}\s+[A-Z]-*+[a-zé][a-zé-]*+(?=\s)(?={_ENDLESS}{_ENDING}))*+"
_WORDS = rf"(?:{_HEAD}+{_COMMITTED}{_ENDLESS}{_ENDING}|{_HEAD}\b)"


def address_patterns() -> list[str]:
    # After ``[a-zé-]+`` a hyphen and capital can only follow where the match
    # has ended at a word edge before, so hyphenated parts add nothing.
    hyphened = r"(?:-[A-Z][a-zé-]+)*"
    return [p.replace(_HEAD + r"(?:\s+[A-Z][a-zé-]+)*\b", _WORDS).replace(hyphened, "") for p in fixed.ADDRESSES]


def addresses(text: str) -> str:
    keep = r"not contains(x.text, '\n')"
    needs = {
        0: has(text, "straat", "laan", "weg", "plein", "singel", "dreef", "lei", "kaai"),
        3: has(text, "St", "Ave", "Road", "Rd", "Dr", "Lane", "Ln", "Boulevard", "Blvd", "Way", "Court", "Ct", "Pl"),
        5: has(text, ","),
        7: has(text, "Street", "Road", "Lane", "Avenue", "Gardens", "Square", "Terrace", "Close", "Crescent"),
        8: has(text, "rue", "avenue", "boulevard", "place", "allée", "chemin", "impasse"),
        10: has(text, "straße", "strasse", "weg", "platz", "allee", "gasse"),
    }
    return _gate(matches(text, DIGIT), _all(text, address_patterns(), "ADDRESS", 0.85, "address", 30, 20, keep, needs))


def dates_of_birth(text: str) -> str:
    before = window("lowered", "x.start - 30", "x.start")
    cued = f"filter({find(text, u(fixed.DATE))}, x -> regexp_like({before}, {any_of(fixed.DOB_CUES)}))"
    made = span("x.start", "x.end", "x.text", "DOB", 0.90, "dob", "x.start - 30", "x.end + 20")
    spans = number(f"transform({let('lowered', f'lower({text})', cued)}, x -> {made})")
    return _gate(matches(text, DATE_HEAD), spans)


def bsn_valid(value: str) -> str:
    """Eleven-proof of a nine-digit number: weighted digit sum divisible by 11."""
    weights = ", ".join(str(w) for w in fixed.BSN_WEIGHTS)
    total = (
        "aggregate(zip_with(sequence(1, 9), array({w}), (i, w) -> cast(substring(digits, i, 1) as int) * w), "
        "0, (a, x) -> a + x)"
    ).format(w=weights)
    test = f"coalesce(case when length(digits) = 9 then {total} % 11 = 0 else false end, false)"
    digits = f"regexp_replace({value}, {lit(u('[^0-9]'))}, '')"
    return let("digits", digits, test)


def national_ids(text: str) -> str:
    kinds = f"get(array({lits(kind for _, kind in fixed.NATIONAL_IDS)}), x.nr)"
    accepted = (
        f"case {kinds} when 'NL_BSN' then cue or {bsn_valid('x.text')} "
        f"when 'US_SSN' then regexp_like(before, {any_of(fixed.SSN_CUES)}) "
        "when 'BE_NATIONAL' then cue or length(translate(x.text, '.- ', '')) != 11 "
        "when 'PASSPORT' then cue else true end"
    )
    made = span("x.start", "x.end", "x.text", "ID", "case when cue then 0.85 else 0.70 end",
                "national_id", "x.start - 30", "x.end + 20")
    judged = let(
        "before", window("lowered", "x.start - 50", "x.start"),
        let("cue", f"regexp_like(before, {any_of(fixed.ID_CUES)})", f"case when {accepted} then {made} end"),
    )
    found = find(text, *[u(p) for p, _ in fixed.NATIONAL_IDS])
    spans = let("lowered", f"lower({text})", f"filter(transform({found}, x -> {judged}), s -> s is not null)")
    return _gate(matches(text, DIGIT), number(spans))


# --- places and streets ------------------------------------------------------

def known_places(text: str) -> str:
    made = span("x.start", "x.end", "x.text", "PLACE", 0.95, "place", "x.start - 20", "x.end + 20")
    return number(f"transform({find_terms(text, fixed.PLACES)}, x -> {made})")


def places(text: str) -> str:
    """Listed places, then capitalised words after a preposition."""
    made = span("x.end - length(x.grp)", "x.end", "x.grp", "PLACE", 0.75, "place", "x.start - 20", "x.end + 20")
    hits = f"transform({find(text, u(fixed.PREPOSITION_PLACE), group=1)}, x -> {made})"
    keep = (
        f"lower(p.text) not in ({lits(fixed.NOT_A_PLACE_AFTER_PREPOSITION)}) "
        f"and p.text not in ({lits(fixed.PLACES)}) and length(p.text) >= 3"
    )
    both = f"struct({known_places(text)} as known, filter({hits}, p -> {keep}) as hits)"
    return let("at", both, number(f"concat(at.known, {without_places('at.hits', 'at.known')})"))


def context_places(text: str) -> str:
    start = "x.start + instr(x.text, x.grp) - 1"
    made = span(start, f"{start} + length(x.grp)", "x.grp", "PLACE", 0.90, "context_place",
                "x.start - 10", "x.end + 10")
    needs = {
        0: has(text, "te"), 1: has(text, "richting"), 2: has(text, "naar"), 3: has(text, "vanuit"),
        4: has(text, "via"), 5: has(text, "thv", "t.h", "th."), 6: has(text, "ter hoogte van"),
        7: "four_digits", 8: "four_digits", 9: "four_digits", 10: has(text, "richting"),
    }
    found = find(text, *[u(p) for p in fixed.LOCATION_MARKERS], group=1, needs=needs)
    keep = f"x.grp not in ({lits(fixed.NOT_A_PLACE_AFTER_MARKER)}) and length(x.grp) >= 3"
    return number(let("four_digits", matches(text, FOUR_DIGITS), f"transform(filter({found}, x -> {keep}), x -> {made})"))


def _any_street() -> str:
    """The street-suffix pattern with the backtracking taken out for words
    without a hyphen: there only the end of the word can end the match."""
    by_length: dict[int, list[str]] = {}
    for suffix in fixed.STREET_SUFFIXES:
        by_length.setdefault(len(suffix), []).append(suffix)
    behind = "|".join(rf"(?<=[A-Za-zé](?:{'|'.join(words)}))" for words in by_length.values())
    hyphened = fixed.ANY_STREET.removeprefix(r"\b")
    return rf"\b(?:[A-Za-zé]++(?!-)(?:{behind})\b|(?=[A-Za-zé]*+-){hyphened})"


def any_street(text: str) -> str:
    made = span("x.start", "x.end", "x.text", "STREET", 0.88, "any_street", "x.start - 20", "x.end + 20")
    keep = (
        f"length(x.text) >= 6 and lower(x.text) not in ({lits(fixed.STREET_SUFFIXES)}) "
        f"and lower(x.text) not in ({lits(fixed.NOT_STREETS)}) and not endswith(lower(x.text), 'ering')"
    )
    found = find(text, u(_any_street(), ignore_case=True))
    return number(f"transform(filter({found}, x -> {keep}), x -> {made})")


def precise_streets(text: str) -> str:
    """Street names that carry no house number; used on its own only."""
    made = span("x.start", "x.end", "x.text", "STREET", 0.85, "street", "x.start - 20", "x.end + 20")
    keep = (
        f"not regexp_like({window(text, 'x.end', 'x.end + 10')}, {lit(u(r'^\s*\d'))}) "
        r"and not contains(x.text, '\n') and length(x.text) >= 5"
    )
    found = find(text, *[u(p) for p in fixed.PRECISE_STREETS])
    return number(f"transform(filter({found}, x -> {keep}), x -> {made})")


# --- persons -----------------------------------------------------------------

def names(text: str) -> str:
    last = rf"element_at(split(lower(x.text), {lit(u(r'\s+'))}), -1)"
    keep = (
        f"upper(x.text) not in ({lits(fixed.NOT_NAMES)}) "
        f"and not regexp_like(upper(x.text), {any_of(fixed.NOT_IN_NAMES)}) "
        f"and {last} not in ({lits(fixed.NOT_LAST_IN_NAMES)}) "
        r"and not contains(x.text, '\n') and length(x.text) >= 5"
    )
    needs = {
        0: "capitals and " + has(text, "EL", "VAN", "DE", "TE"),
        1: has(text, "El", "Van", "De", "Ten", "Ter", "La", "Le"),
        2: has(text, "Jean", "Marie", "Pierre", "Jacques", "Philippe", "François", "Michel", "André", "Louis", "Charles"),
        3: has(text, "de", "du"),
        4: has(text, "von", "zu", "vom"),
        5: has(text, "O'"),
        6: has(text, "Mc", "Mac"),
        7: "capitals",
        8: "capitals",
        9: "capitals and " + has(text, "EL", "VAN", "DE"),
        10: has(text, "Mr", "Ms", "Miss", "Dr", "Prof"),
    }
    return let("capitals", matches(text, TWO_CAPITALS),
               _all(text, fixed.NAMES, "PERSON", 0.80, "name", 30, 20, keep, needs))


# A name that ends right before a dashed date.  Names are runs of words, and a
# pattern over runs of words recurses (and backtracks) once per word in Java.
# The same result comes from the run itself: cut out the whole run of name
# characters in front of each date, then walk its words from the right.
_NAME_CHARS = r"A-Za-zé'\-\s"
_DATE_TAIL = r"\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}"
_RUN_AND_DATE = u(rf"(?<![{_NAME_CHARS}])[{_NAME_CHARS}]++(?:–\s*+)?{_DATE_TAIL}")
_RUN = u(rf"^([{_NAME_CHARS}–]*?)\s*[-–]\s*{_DATE_TAIL}$")
_LOWER_WORD = u(r"^[A-Z]?[a-zé'\-]+$")
_UPPER_WORD = u(r"^[A-Z][A-Za-zé'\-]+$")
_NAME_START = u(r"[A-Z][A-Za-zé'\-]")


def _name_start(run: str) -> str:
    """Offset in ``run`` where the leftmost admissible name begins, or null.

    Words read: a first word with a capital, then lower-case-style words, then
    upper-case-style words.  From the right: upper-style words, then
    lower-style words; the name may start one word further left.
    """
    flags = (
        f"transform(reverse(ws), w -> struct(regexp_like(w, {lit(_LOWER_WORD)}) as low, "
        f"regexp_like(w, {lit(_UPPER_WORD)}) as up))"
    )
    # phase 0: only upper-style so far; 1: lower-style reached; 2: closed
    phase = "case when acc.phase = 0 and f.up then 0 when acc.phase < 2 and f.low then 1 else 2 end"
    tail = (
        f"aggregate({flags}, struct(0 as phase, 0 as n), (acc, f) -> struct({phase} as phase, "
        f"acc.n + case when {phase} < 2 then 1 else 0 end as n), acc -> acc.n)"
    )
    skip = f"length(regexp_extract(w, {lit(u(r'^(.*?)[A-Z][A-Za-z\u00e9' + chr(39) + r'\-]'))}, 1))"
    candidates = (
        f"filter(transform(ws, (w, i) -> case when i >= size(ws) - least(tail + 1, size(ws)) "
        f"and regexp_like(w, {lit(_NAME_START)}) then struct(i as i, {skip} as skip) end), c -> c is not null)"
    )
    offset = (
        "aggregate(zip_with(slice(ws, 1, c.i), slice(gaps, 1, c.i), (w, g) -> length(w) + length(g)), "
        "0, (a, x) -> a + x) + c.skip"
    )
    spaces = lit(u(r"\s+"))
    return let("ws", f"split({run}, {spaces}, -1)", let(
        "gaps", f"regexp_extract_all({run}, {spaces}, 0)", let(
            "tail", tail, let("c", f"get({candidates}, 0)", f"case when c is not null then {offset} end"))))


def names_before_dates(text: str) -> str:
    made = span("x.start + off", "x.start + off + length(name)", "name", "PERSON", 0.88, "context_name",
                "x.start + off - 10", "x.start + off + length(name) + 30")
    named = let("run", f"regexp_extract(x.text, {lit(_RUN)}, 1)", let(
        "off", _name_start("run"),
        f"case when off is not null then {let('name', 'substring(run, off + 1)', made)} end"))
    keep = (
        "s is not null and length(s.text) >= 3 "
        f"and lower(s.text) not in ({lits(fixed.NOT_NAMES_BEFORE_DATE)})"
    )
    spans = f"filter(transform({find(text, _RUN_AND_DATE)}, x -> {named}), s -> {keep})"
    return _gate(matches(text, DASHED_DATE), spans)


# Words of a capitals name are taken as one block when the cue follows the last
# of them; otherwise the cue sits inside the run, at a word that contains it.
_CAPS_CUE = r"(?:[-–]\s*\d{1,2}[-/\.]|Nationaliteit|PERSON_|geboren)"
_WORD = r"[A-Z][a-z]+"
_CUE_WORD = rf"(?:Nationaliteit|{_WORD}geboren)"
_PLAIN = rf"(?:\s+(?!{_CUE_WORD}){_WORD})*+"
# Words with a cue are committed while another one follows in the run.
_CAPS_NAME = u(
    rf"\b([A-Z]{{3,}}(?:(?:\s+{_WORD})*+(?=\s*{_CAPS_CUE})"
    rf"|{_PLAIN}(?:\s+{_WORD}+{_PLAIN}(?=\s+{_CUE_WORD}))*+(?:\s+{_WORD}(?=geboren))?))\s*{_CAPS_CUE}"
)
_CAPS_GATE = r"[-–]\s*+\d|Nationaliteit|PERSON_|geboren"


def caps_names(text: str) -> str:
    made = let("name", strip("x.grp"), span(
        "x.start", "x.start + length(name)", "name", "PERSON", 0.85, "context_name",
        "x.start - 10", "x.start + length(name) + 30"))
    spans = (
        f"filter(transform({find(text, _CAPS_NAME, group=1)}, x -> {made}), "
        f"s -> s.text not in ({lits(fixed.NOT_CAPS_NAMES)}))"
    )
    return _gate(matches(text, u(_CAPS_GATE)), spans)


def names_before_tokens(text: str) -> str:
    pattern = fixed.NAME_BEFORE_TOKEN.replace(")+)", ")++)")
    made = span("x.start", "x.start + length(x.grp)", "x.grp", "PERSON", 0.82, "context_name",
                "x.start - 10", "x.start + length(x.grp) + 30")
    spans = f"filter(transform({find(text, u(pattern), group=1)}, x -> {made}), s -> length(s.text) >= 4)"
    return _gate(f"contains({text}, 'PERSON_')", spans)


def context_names(text: str) -> str:
    """Names known from what follows them; earlier rules win over later ones."""
    each = f"struct({names_before_dates(text)} as dated, {caps_names(text)} as caps, {names_before_tokens(text)} as tokens)"
    return let("at", each, let(
        "seen", f"concat(at.dated, {without_overlaps('at.caps', 'at.dated')})",
        number(f"concat(seen, {without_places('at.tokens', 'seen')})")))


# --- vehicles and roads ------------------------------------------------------

def vehicles(text: str) -> str:
    """Brands with the word after them, then model names outside those spans.

    Brand matches of different brands may overlap, so one alternation is not
    enough: it only tells which brands occur, and each of those is then matched
    on its own.
    """
    heads = "".join(sorted({b[0] for b in fixed.BRANDS}))
    word_start = u(rf"\b(?=[{heads}])(?=({alternation(fixed.BRANDS)})\b)", ignore_case=True)
    # case variants that Unicode matching treats as the plain letter
    plain = "translate(lower(w), '\u017f\u0131\u0307', 'si')"
    present = f"array_distinct(transform(regexp_extract_all({text}, {lit(word_start)}, 1), w -> {plain}))"
    # a longer brand hides the shorter one it starts with
    hidden = {t: [s for s in fixed.BRANDS if t.startswith(s)] for t in fixed.BRANDS}
    whens = " ".join(f"when {lit(t)} then array({lits(ss)})" for t, ss in hidden.items() if len(ss) > 1)
    terms = f"array_distinct(flatten(transform(present, b -> case b {whens} else array(b) end)))"
    regexes = (
        rf"transform({terms}, b -> concat({lit(r'(?iU)\b(?:\Q')}, b, {lit(r'\E' + fixed.BRAND_TAIL + r')\b')}))"
    )
    made = span("x.start", "x.end", "x.text", "VEHICLE", 0.92, "vehicle", "x.start - 20", "x.end + 20")
    brands = (
        f"case when size(present) = 0 then {empty(SPANS)} else "
        f"transform(array_sort(filter({find_each(text, regexes)}, x -> length(x.text) >= 3)), x -> {made}) end"
    )
    made = span("x.start", "x.end", "x.text", "VEHICLE", 0.88, "vehicle", "x.start - 20", "x.end + 20")
    models = f"transform({find_terms(text, fixed.MODELS)}, x -> {made})"
    both = f"struct({let('present', present, brands)} as brands, {models} as models)"
    return let("at", both, number(f"concat(at.brands, {without_overlaps('at.models', 'at.brands')})"))


Detector = Callable[[str], str]

DETECTORS: dict[str, Detector] = {
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
    "street": precise_streets,
}

# The one category of each detector's spans; a caller's own detectors may make any.
CATEGORIES = {
    "email": "EMAIL", "iban": "IBAN", "phone": "PHONE", "vehicle": "VEHICLE", "road": "ROAD", "dob": "DOB", "address": "ADDRESS",
    "any_street": "STREET", "context_place": "PLACE", "place": "PLACE", "national_id": "ID", "context_name": "PERSON",
    "name": "PERSON", "street": "STREET",
}


def custom(name: str, category: str, pattern: str, confidence: float, before: int = 20, after: int = 20,
           cues: list[str] | None = None, cue_window: int = 30) -> Detector:
    """A detector for a caller's own entity label: a pattern and, optionally,
    words of which one must occur (lower-cased) shortly before the match."""

    def detector(text: str) -> str:
        found = find(text, u(pattern))
        if cues:
            near = window("lowered", f"x.start - {cue_window}", "x.start")
            found = let("lowered", f"lower({text})",
                        f"filter({found}, x -> regexp_like({near}, {any_of(cues)}))")
        made = span("x.start", "x.end", "x.text", category, confidence, name,
                    f"x.start - {before}", f"x.end + {after}")
        return number(f"transform({found}, x -> {made})")

    return detector
