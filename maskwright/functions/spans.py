"""Regex matches with offsets, as Spark SQL expressions.

The functions here take and return SQL fragments (strings) that end up in one
``F.expr``: an expression over a hundred patterns parses in milliseconds, while
assembling it call by call would take longer than many queries.

Spark's ``regexp_extract_all`` returns texts without positions.  So the matches
are marked in the text by one ``regexp_replace``, whose literal pattern is
compiled once; cut at the marks, the text is pieces and matches in turn, and a
running sum of their lengths yields exact code point offsets.  Texts that hold
the mark themselves are cut by ``split`` with the pattern instead.

A span is ``struct<start,end,text,category,confidence,detector,ctx_start,
ctx_end,ord>``; offsets are 0-based code points and ``end`` is exclusive.
"""

from __future__ import annotations

from collections.abc import Iterable

FOUND = "array<struct<start:int,end:int,text:string,grp:string,nr:int>>"
SPAN = (
    "struct<start:int,end:int,text:string,category:string,confidence:double,"
    "detector:string,ctx_start:int,ctx_end:int,ord:int>"
)
SPANS = f"array<{SPAN}>"


def lit(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def lits(values: Iterable[str]) -> str:
    return ", ".join(lit(v) for v in values)


def u(pattern: str, ignore_case: bool = False) -> str:
    """Compile flags that make Java classes and word edges Unicode-aware."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def quote(term: str) -> str:
    """``term`` as a literal inside a Java regex."""
    return r"\Q" + term + r"\E"


def alternation(terms: Iterable[str]) -> str:
    """Longest-first alternation of literals, factored by first character so
    that a position is rejected after one character instead of one per term."""
    by_head: dict[str, list[str]] = {}
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        by_head.setdefault(term[0], []).append(term[1:])
    return "|".join(
        quote(head) + "(?:" + "|".join(quote(t) if t else "" for t in tails) + ")"
        for head, tails in sorted(by_head.items())
    )


def any_of(words: Iterable[str]) -> str:
    """Pattern literal: the text contains one of the words."""
    return lit("|".join(quote(w) for w in words))


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def empty(ddl: str) -> str:
    return f"cast(array() as {ddl})"


def strip(text: str) -> str:
    """Remove whitespace at both ends, Unicode-aware (``trim`` strips spaces)."""
    return rf"regexp_replace({text}, {lit(u(r'^\s+|\s+$'))}, '')"


def window(text: str, start: str, end: str) -> str:
    """``text[start:end]`` with the start clamped at 0."""
    low = f"greatest({start}, 0)"
    return f"substring({text}, {low} + 1, greatest({end} - {low}, 0))"


# Arrays longer than this are worked on in blocks of so many elements, so that time grows with their length.
BLOCK = 64


def blocks(rows: str) -> str:
    """A filled array cut into arrays of BLOCK elements."""
    return f"transform(sequence(0, (size({rows}) - 1) div {BLOCK}), b -> slice({rows}, b * {BLOCK} + 1, {BLOCK}))"


def walk(rows: str, first: str, step: str, item: str, kind: str) -> str:
    """``item`` of each row ``r`` of a variable, in order, with ``acc.a`` (an int) and ``acc.n`` (the row's index) before it.

    ``first`` is what acc.a starts with, ``step`` what it becomes after r. Appending to an array copies it, so the items of
    a block are gathered on their own, and time grows with the rows.
    """
    part = (
        f"aggregate(part, struct(done.a as a, done.n as n, {empty(f'array<{kind}>')} as out), "
        f"(acc, r) -> struct({step} as a, acc.n + 1 as n, concat(acc.out, array({item})) as out))"
    )
    first = f"struct({first} as a, 0 as n, {empty(f'array<array<{kind}>>')} as outs)"
    return (
        f"case when size({rows}) = 0 then {empty(f'array<{kind}>')} else aggregate({blocks(rows)}, {first}, (done, part) -> "
        f"element_at(transform(array({part}), w -> struct(w.a as a, w.n as n, concat(done.outs, array(w.out)) as outs)), 1), "
        "done -> flatten(done.outs)) end"
    )


def cut(rows: str, heads: str) -> str:
    """An array variable cut before the elements with the indexes ``heads`` (the first of them 0)."""
    return let("heads", heads, (
        f"transform(heads, (h, j) -> slice({rows}, h + 1, coalesce(get(heads, j + 1), size({rows})) - h))"))


def runs(rows: str, begins: str) -> str:
    """An array variable cut where ``begins`` (of x and i) holds, and at its first element."""
    return cut(rows, f"filter(transform({rows}, (x, i) -> case when i = 0 or {begins} then i end), h -> h is not null)")


# What matches are marked with.
MARK = "\x01"


def is_ascii(text: str) -> str:
    return f"octet_length({text}) = length({text})"


def _plain(pattern: str) -> str:
    """A pattern of ``u`` without the Unicode flag: in ASCII text it finds the same and takes a fraction of the time.

    Only the POSIX classes mean other ASCII characters with the flag.
    """
    if r"\p" in pattern or r"\P" in pattern:
        return pattern
    return pattern.removeprefix("(?U)") if pattern.startswith("(?U)") else pattern.replace("(?iU)", "(?i)", 1)


def by_script(text: str, pattern: str, use) -> str:
    """``use`` of the pattern's literal, the one without the Unicode flag for ASCII texts."""
    plain = _plain(pattern)
    if plain == pattern:
        return use(lit(pattern))
    return f"case when {is_ascii(text)} then {use(lit(plain))} else {use(lit(pattern))} end"


def matches(text: str, pattern: str) -> str:
    return by_script(text, pattern, lambda regex: f"regexp_like({text}, {regex})")


def _marked(text: str, regex: str, group: int | None = None) -> str:
    """The text cut into pieces and matches in turn, each match followed by its group if there is one."""
    parts = ["", "$0", ""] if group is None else ["", "$0", f"${group}", ""]
    return f"split(regexp_replace({text}, {regex}, {lit(MARK.join(parts))}), {lit(MARK)}, -1)"


def _struct_of_hit(start: str, text: str, grp: str, nr: str) -> str:
    return f"struct({start} as start, {start} + length({text}) as end, {text} as text, {grp} as grp, {nr} as nr)"


def _walk_hits(rows: str, nr: str) -> str:
    item = FOUND.removeprefix("array<").removesuffix(">")
    return let("rows", rows, walk("rows", "0", "acc.a + r.g + length(r.m)", _struct_of_hit("acc.a + r.g", "r.m", "r.grp", nr), item))


def _place(pieces: str, group: int | None, nr: str) -> str:
    """Offsets of the matches in ``pieces``, a variable with what ``_marked`` returns."""
    step = 2 if group is None else 3
    grp = "cast(null as string)" if group is None else f"get({pieces}, k + 2)"
    rows = (
        f"transform(sequence(0, size({pieces}) - {step + 1}, {step}), "
        f"k -> struct(get({pieces}, k + 1) as m, length(get({pieces}, k)) as g, {grp} as grp))"
    )
    only = _struct_of_hit(f"length(get({pieces}, 0))", f"get({pieces}, 1)", grp.replace("k +", "0 +"), nr)
    return (
        f"case size({pieces}) when 1 then {empty(FOUND)} when {step + 1} then array({only}) "
        f"else {_walk_hits(rows, nr)} end"
    )


def _locate(text: str, found: str, regex: str, group: int | None, nr: str) -> str:
    """Offsets of the matches ``found`` of ``regex`` in a text that may hold any character."""
    gaps = f"transform(slice(split({text}, {regex}, -1), 1, size({found})), gap -> length(gap))"
    if group is None:
        rows = f"zip_with({found}, {gaps}, (m, g) -> struct(m, g, cast(null as string) as grp))"
    else:
        rows = (
            f"zip_with(zip_with({found}, {gaps}, (m, g) -> struct(m, g)), "
            f"regexp_extract_all({text}, {regex}, {group}), (mg, grp) -> struct(mg.m as m, mg.g as g, grp as grp))"
        )
    return f"case when size({found}) = 0 then {empty(FOUND)} else {_walk_hits(rows, nr)} end"


def _unless_marked(text: str, marked: str, regexes: str, group: int | None = None) -> str:
    """``marked``, or for texts that hold the mark the same by ``_locate``."""
    located = let("found", f"regexp_extract_all({text}, regex, 0)", _locate(text, "found", "regex", group, "nr"))
    return (
        f"case when contains({text}, {lit(MARK)}) then flatten(transform({regexes}, (regex, nr) -> {located})) "
        f"else {marked} end"
    )


def has(text: str, *words: str) -> str:
    """The text contains one of the words: a byte search, far below a regex scan."""
    return "(" + " or ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def find(text: str, *patterns: str, group: int | None = None, needs: dict[int, str] | None = None) -> str:
    """All matches of each pattern, pattern by pattern; none may match ''.

    ``needs`` gives necessary conditions (SQL) by pattern index; a pattern whose
    condition fails for a row is not scanned there.

    The scans use literal patterns (compiled once); the offsets are worked out
    by one shared lambda, and only for patterns that matched.  ``nr`` is the
    index of the pattern; with ``group`` that capture group comes as ``grp``.
    """
    needs = needs or {}

    def scan(i: int, pattern: str) -> str:
        pieces = by_script(text, pattern, lambda regex: _marked(text, regex, group))
        return f"case when {needs[i]} then {pieces} else array('') end" if i in needs else pieces

    scans = ", ".join(scan(i, p) for i, p in enumerate(patterns))
    marked = f"flatten(transform(array({scans}), (pieces, nr) -> {_place('pieces', group, 'nr')}))"
    return _unless_marked(text, marked, f"array({lits(patterns)})", group)


def find_each(text: str, regexes: str) -> str:
    """Like ``find`` for an array of patterns that is only known per row."""
    located = let("pieces", _marked(text, "regex"), _place("pieces", None, "nr"))
    return _unless_marked(text, f"flatten(transform({regexes}, (regex, nr) -> {located}))", regexes)


def find_terms(text: str, terms: Iterable[str]) -> str:
    """Every whole-word, case-insensitive occurrence of the terms, including
    ones that overlap: a zero-width look-ahead is matched at each word start."""
    terms = list(terms)
    words = alternation(terms)
    heads = "".join(sorted({t[0] for t in terms}))
    # the class of first characters rejects most word edges at once
    word = u(rf"\b(?=[{heads}])(?=({words})\b)", ignore_case=True)
    hit = (
        "struct({start} as start, {start} + length({w}) as end, {w} as text, "
        "cast(null as string) as grp, 0 as nr)"
    )
    # The words stand marked in front of themselves.
    pieces = by_script(text, word, lambda regex: f"split(regexp_replace({text}, {regex}, {lit(f'{MARK}$1{MARK}')}), {lit(MARK)}, -1)")
    item = FOUND.removeprefix("array<").removesuffix(">")
    pairs = "transform(sequence(0, size(pieces) - 3, 2), k -> struct(length(get(pieces, k)) as g, get(pieces, k + 1) as w))"
    marked = let("pieces", pieces, (
        f"case when size(pieces) = 1 then {empty(FOUND)} else "
        + let("pairs", pairs, walk("pairs", "0", "acc.a + r.g", hit.format(start="acc.a + r.g", w="r.w"), item)) + " end"))
    # A match at position 0 leaves no piece in front of it.
    skipped = "if(size(pieces) = size(found), 0, 1)"
    ends = walk("pieces", "0", "acc.a + length(r)", "acc.a", "int")
    starts = f"slice({ends}, 1 + {skipped}, size(pieces) - {skipped})"
    hits = f"zip_with({starts}, found, (s, w) -> {hit.format(start='s', w='w')})"
    cut_up = let("found", f"regexp_extract_all({text}, {lit(word)}, 1)", (
        f"case when size(found) = 0 then {empty(FOUND)} else {let('pieces', f'split({text}, {lit(word)}, -1)', hits)} end"))
    return f"case when contains({text}, {lit(MARK)}) then {cut_up} else {marked} end"


def span(start: str, end: str, text: str, category: str, confidence: float | str, detector: str,
         ctx_start: str, ctx_end: str, ord: str = "0") -> str:
    return (
        f"struct({start} as start, {end} as end, {text} as text, {lit(category)} as category, "
        f"cast({confidence} as double) as confidence, {lit(detector)} as detector, "
        f"greatest({ctx_start}, 0) as ctx_start, {ctx_end} as ctx_end, {ord} as ord)"
    )


def number(spans: str) -> str:
    """Record the order in which a detector produced its spans."""
    kept = ", ".join(f"s.{f} as {f}" for f in
                     ("start", "end", "text", "category", "confidence", "detector", "ctx_start", "ctx_end"))
    return f"transform({spans}, (s, i) -> struct({kept}, i as ord))"


def overlap(a: str, b: str) -> str:
    return f"({a}.start < {b}.end and {a}.end > {b}.start)"


def same_place(a: str, b: str) -> str:
    return f"({a}.start = {b}.start and {a}.end = {b}.end)"


def without_overlaps(spans: str, others: str) -> str:
    """The spans that overlap none of the others, in their order.

    In order of the others' starts and the spans' ends, the largest end of the others so far tells.
    """
    marks = (
        f"array_sort(concat(transform({spans}, (s, i) -> struct(s.end as at, 0 as other, i as i, s.start as start, -1 as reach, s as s)), "
        f"transform({others}, (o, i) -> struct(o.start as at, 1 as other, i as i, o.start as start, o.end as reach, o as s))))"
    )
    free = "case when r.other = 0 and acc.a <= r.start then struct(r.i as i, r.s as s) end"
    found = walk("marks", "-1", "greatest(acc.a, r.reach)", free, f"struct<i:int,s:{SPAN}>")
    ordered = f"transform(array_sort(filter({let('marks', marks, found)}, f -> f is not null)), f -> f.s)"
    return f"case when size({others}) = 0 or size({spans}) = 0 then {spans} else {ordered} end"


def without_places(spans: str, others: str) -> str:
    """The spans, of distinct places, that have the place of none of the others; sorted by place."""
    marks = (
        f"array_sort(concat(transform({spans}, s -> struct(s.start as start, s.end as end, 1 as own, s as s)), "
        f"transform({others}, o -> struct(o.start as start, o.end as end, 0 as own, o as s))))"
    )
    own = "filter(marks, (x, i) -> x.own = 1 and not (i > 0 and get(marks, i - 1).own = 0 " \
          "and get(marks, i - 1).start = x.start and get(marks, i - 1).end = x.end))"
    return (
        f"case when size({spans}) = 0 or size({others}) = 0 then {spans} "
        f"else {let('marks', marks, f'transform({own}, m -> m.s)')} end"
    )


def one_per_position(spans: str) -> str:
    """Keep the first produced span of every (start, end); sorted by position."""
    keyed = f"array_sort(transform({spans}, s -> struct(s.start as start, s.end as end, s.ord as ord, s as s)))"
    return let(
        "rows", keyed,
        "transform(filter(rows, (r, i) -> i = 0 or not "
        "(r.start = get(rows, i - 1).start and r.end = get(rows, i - 1).end)), r -> r.s)",
    )
