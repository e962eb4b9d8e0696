"""Expected results as standalone SQL, written from the definitions.

The statements run on another engine over the same tables.  Its regular
expressions know ASCII word edges only and no look-around, so they are used on
ASCII texts and with the one look-ahead turned into a condition.
"""

from __future__ import annotations

from maskwright.functions import fixed
from maskwright.plans.corpora import NOTES_SQL, PAGES_SQL, entities_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qs(values) -> str:
    return ", ".join(q(v) for v in values)


NOTES = f"notes as materialized ({NOTES_SQL})"


def prepared(name: str = "prepared", source: str = "notes") -> str:
    text = "text"
    for p in fixed.LINE_BREAK_PARTICLES:
        text = rf"regexp_replace({text}, '\b({p})\n([A-Z][A-Za-z]+)', '\1 \2', 'g')"
    return f"{name} as materialized (select doc_id, {text} as text from {source})"


def find(source: str, pattern: str, nr: int = 0, group: int | None = None, terms: list[str] | None = None,
         around: tuple[str, str] | None = None) -> str:
    """doc_id, text, nr, i, s, e, v, g of all matches.  With ``terms`` one
    pattern per term: around[0] || term || around[1]."""
    base = source
    expr = q(pattern)
    if terms is not None:
        values = ", ".join(f"({q(t)})" for t in terms)
        base = f"(select * from {source}, (values {values}) t(term) where contains(lower(text), lower(term)))"
        expr = f"{q(around[0])} || regexp_escape(term) || {q(around[1])}"
    grp = "null" if group is None else f"regexp_extract_all(text, {expr}, {group})[i]"
    return (
        f"select doc_id, text, {nr} as nr, i, s, s + length(m[i]) as e, m[i] as v, {grp} as g from ("
        "select *, cast(list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) as int) as s from ("
        f"select *, unnest(range(1, len(m) + 1)) as i from (select *, regexp_extract_all(text, {expr}) as m, "
        f"regexp_split_to_array(text, {expr}) as p from {base}) where len(m) > 0))"
    )


def _ctx(a: str, b: str) -> str:
    return f"cast(greatest({a}, 0) as int) as cs, cast({b} as int) as ce"


def _spans(source: str, cat: str, conf, det: str, before: int, after: int, where: str = "true") -> str:
    return (
        f"select doc_id, text as doc, nr, i, s, e, v, {q(cat)} as category, cast({conf} as double) as confidence, "
        f"{q(det)} as detector, {_ctx(f's - {before}', f'e + {after}')} from ({source}) where {where}"
    )


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


def _cued(before: str, cues) -> str:
    return f"len(list_filter([{qs(cues)}], lambda cue_word: contains({before}, cue_word))) > 0"


def bsn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    terms = " + ".join(f"{w} * coalesce(try_cast(substr({d}, {i + 1}, 1) as int), 0)" for i, w in enumerate([9, 8, 7, 6, 5, 4, 3, 2, -1]))
    return f"(length({d}) = 9 and ({terms}) % 11 = 0)"


def _many(source: str, patterns, **kw) -> str:
    return _union([find(source, p, nr, **kw) for nr, p in enumerate(patterns)])


def _name_patterns(source: str) -> str:
    """The one pattern with a look-ahead, as a match and a condition."""
    parts = []
    for nr, p in enumerate(fixed.NAMES):
        if "(?!" in p:
            barred = p[p.index("(?!") + 3:p.index(")[A-Z]")]
            plain = p.replace(f"(?!{barred})", "")
            parts.append(f"select * from ({find(source, plain, nr)}) where not regexp_matches(v, {q('^[A-Z]+' + chr(92) + 's+(?:' + barred + ')')})")
        else:
            parts.append(find(source, p, nr))
    return _union(parts)


def detector(name: str, src: str) -> str:
    """doc_id, doc, nr, i, s, e, v, category, confidence, detector, cs, ce."""
    window = lambda n: f"substr(lower(text), greatest(s - {n}, 0) + 1, s - greatest(s - {n}, 0))"
    if name == "email":
        return _spans(find(src, fixed.EMAIL), "EMAIL", 0.99, name, 20, 20)
    if name == "iban":
        return _spans(_many(src, fixed.IBANS), "IBAN", 0.95, name, 20, 20, "not contains(v, 'XX') and not contains(v, 'xx')")
    if name == "phone":
        return _spans(_many(src, fixed.PHONES), "PHONE", 0.95, name, 20, 20)
    if name == "road":
        return _spans(find(src, fixed.ROAD), "ROAD", 0.95, name, 20, 20)
    if name == "dob":
        return _spans(find(src, fixed.DATE), "DOB", 0.90, name, 30, 20, _cued(window(30), fixed.DOB_CUES))
    if name == "address":
        return _spans(_many(src, fixed.ADDRESSES), "ADDRESS", 0.85, name, 30, 20, "not contains(v, chr(10))")
    if name == "any_street":
        return _spans(find(src, "(?i)" + fixed.ANY_STREET), "STREET", 0.88, name, 20, 20, (
            f"length(v) >= 6 and lower(v) not in ({qs(fixed.STREET_SUFFIXES)}) and lower(v) not in ({qs(fixed.NOT_STREETS)}) "
            "and not ends_with(lower(v), 'ering')"))
    if name == "street":
        return _spans(_many(src, fixed.PRECISE_STREETS), "STREET", 0.85, name, 20, 20, (
            r"not regexp_matches(substr(text, e + 1, 10), '^\s*\d') and not contains(v, chr(10)) and length(v) >= 5"))
    if name == "name":
        barred = " or ".join(f"contains(upper(v), {q(w)})" for w in fixed.NOT_IN_NAMES)
        return _spans(_name_patterns(src), "PERSON", 0.80, name, 30, 20, (
            f"upper(v) not in ({qs(fixed.NOT_NAMES)}) and not ({barred}) "
            rf"and regexp_extract(lower(v), '(\S+)$', 1) not in ({qs(fixed.NOT_LAST_IN_NAMES)}) "
            "and not contains(v, chr(10)) and length(v) >= 5"))
    if name == "national_id":
        kinds = "[" + qs(k for _, k in fixed.NATIONAL_IDS) + "]"
        judged = (
            f"select *, {kinds}[nr + 1] as kind, {window(50)} as w, {_cued(window(50), fixed.ID_CUES)} as cue "
            f"from ({_many(src, [p for p, _ in fixed.NATIONAL_IDS])})"
        )
        return _spans(judged, "ID", "case when cue then 0.85 else 0.70 end", name, 30, 20, (
            f"case kind when 'NL_BSN' then cue or {bsn('v')} when 'US_SSN' then {_cued('w', fixed.SSN_CUES)} "
            "when 'BE_NATIONAL' then cue or length(replace(replace(replace(v, '.', ''), '-', ''), ' ', '')) <> 11 "
            "when 'PASSPORT' then cue else true end"))
    if name == "place":
        listed = find(src, "", 0, terms=fixed.PLACES, around=(r"(?i)\b", r"\b"))
        known = f"select doc_id, text, 0 as nr, row_number() over (partition by doc_id order by s, e) as i, s, e, v, g from ({listed})"
        after = (
            f"select f.doc_id, f.doc, 1 as nr, f.i, f.s, f.e, f.v, 'PLACE' as category, cast(0.75 as double) as confidence, "
            f"'place' as detector, f.cs, f.ce from (select doc_id, text as doc, i, e - length(g) as s, e, g as v, {_ctx('s - 20', 'e + 20')} "
            f"from ({find(src, fixed.PREPOSITION_PLACE, 1, group=1)})) f anti join ({listed}) k on f.doc_id = k.doc_id and f.s = k.s and f.e = k.e "
            f"where lower(f.v) not in ({qs(fixed.NOT_A_PLACE_AFTER_PREPOSITION)}) and f.v not in ({qs(fixed.PLACES)}) and length(f.v) >= 3"
        )
        return _union([_spans(known, "PLACE", 0.95, name, 20, 20), after])
    if name == "context_place":
        return (
            f"select doc_id, text as doc, nr, i, cast(s + strpos(v, g) - 1 as int) as s, cast(s + strpos(v, g) - 1 + length(g) as int) as e, g as v, "
            f"'PLACE' as category, cast(0.90 as double) as confidence, 'context_place' as detector, {_ctx('s - 10', 'e + 10')} "
            f"from ({_many(src, fixed.LOCATION_MARKERS, group=1)}) where g not in ({qs(fixed.NOT_A_PLACE_AFTER_MARKER)}) and length(g) >= 3"
        )
    if name == "context_name":
        def named(pattern, nr, conf, where):
            return (
                f"select doc_id, text as doc, {nr} as nr, i, s, s + length(g) as e, g as v, 'PERSON' as category, "
                f"cast({conf} as double) as confidence, 'context_name' as detector, {_ctx('s - 10', 's + length(g) + 30')} "
                rf"from (select doc_id, text, i, s, regexp_replace(g, '\s+$', '') as g from ({find(src, pattern, nr, group=1)})) where {where}"
            )
        dated = named(fixed.NAME_BEFORE_DATE, 0, 0.88, f"length(g) >= 3 and lower(g) not in ({qs(fixed.NOT_NAMES_BEFORE_DATE)})")
        caps = named(fixed.CAPS_NAME, 1, 0.85, f"g not in ({qs(fixed.NOT_CAPS_NAMES)})")
        tokens = named(fixed.NAME_BEFORE_TOKEN, 2, 0.82, "length(g) >= 4")
        free = f"select c.* from ({caps}) c anti join ({dated}) d on c.doc_id = d.doc_id and c.s < d.e and c.e > d.s"
        seen = f"({dated} union all {free})"
        return f"{dated} union all {free} union all select t.* from ({tokens}) t anti join {seen} z on t.doc_id = z.doc_id and t.s = z.s and t.e = z.e"
    if name == "vehicle":
        brands = _spans(
            find(src, "", 0, terms=fixed.BRANDS, around=(r"(?i)\b(?:", fixed.BRAND_TAIL + r")\b")),
            "VEHICLE", 0.92, name, 20, 20, "length(v) >= 3").replace(
                "nr, i, s,", "0 as nr, row_number() over (partition by doc_id order by s, e) as i, s,", 1)
        models = _spans(
            find(src, "", 1, terms=fixed.MODELS, around=(r"(?i)\b", r"\b")), "VEHICLE", 0.88, name, 20, 20).replace(
                "nr, i, s,", "1 as nr, row_number() over (partition by doc_id order by s, e) as i, s,", 1)
        return f"{brands} union all select m.* from ({models}) m anti join ({brands}) b on m.doc_id = b.doc_id and m.s < b.e and m.e > b.s"
    raise KeyError(name)


COLUMNS = 'doc_id, s as start, e as "end", v as text, category, confidence, detector'
CONTEXT = "substr(doc, cs + 1, ce - cs) as context"


def detect(name: str, source: str = NOTES, table: str = "notes") -> str:
    return (
        f"with {source}, d as ({detector(name, table)}) select {COLUMNS}, {CONTEXT} from ("
        "select *, row_number() over (partition by doc_id, s, e order by nr, i) as pick from d) where pick = 1"
    )


def raw(table: str = "notes", profile=None, name: str = "raw") -> str:
    """CTE of all spans of a profile in production order."""
    dets = profile or fixed.PATTERN_PROFILE
    parts = [f"select {rank} as rank, * from ({detector(d, table)})" for rank, d in enumerate(dets)]
    return f"{name} as materialized ({_union(parts)})"


def resolved(source: str = "raw", name: str = "resolved", order: str = "-confidence, s - e, rank, nr, i") -> str:
    """CTE of the greedy choice of disjoint spans per document."""
    ranked = f"select *, row_number() over (partition by doc_id order by {order}) as o from {source}"
    item = "{'s': s, 'e': e, 'v': v, 'category': category, 'confidence': confidence}"
    lists = f"select doc_id, list({item} order by o) as l from ({ranked}) group by doc_id"
    greedy = (
        "list_reduce(l[2:], lambda acc, x: case when len(list_filter(acc, lambda k: k.s < x.e and k.e > x.s)) > 0 "
        "then acc else list_append(acc, x) end, l[1:1])"
    )
    return (
        f"{name} as materialized (select doc_id, x.s as s, x.e as e, x.v as v, x.category as category, x.confidence as confidence "
        f"from (select doc_id, unnest({greedy}) as x from ({lists})))"
    )


UNMASKED = "not (contains(v, 'XX') or contains(v, 'xx') or contains(v, '***'))"


def norm(v: str = "v", c: str = "category") -> str:
    words = rf"list_filter(regexp_split_to_array(upper({v}), '\s+'), lambda w: w <> '' and w not in ({qs(fixed.NAME_PARTICLES)}))"
    d = f"regexp_replace({v}, '[^0-9+]', '', 'g')"
    return (
        f"case {c} when 'PERSON' then coalesce(array_to_string(list_sort({words}), '|'), '') "
        f"when 'PHONE' then case when starts_with({d}, '00') then '+' || substr({d}, 3) "
        f"when starts_with({d}, '0') and length({d}) = 10 then '+32' || substr({d}, 2) else {d} end "
        rf"when 'IBAN' then regexp_replace(upper({v}), '\s', '', 'g') "
        rf"else regexp_replace(upper({v}), '^\s+|\s+$', '', 'g') end"
    )


def kept(source: str = "resolved", name: str = "kept", where: str = UNMASKED) -> str:
    return f"{name} as materialized (select *, {norm()} as norm from {source} where {where})"


def mapping(source: str = "kept", scope: str = "0", name: str = "mapping") -> str:
    """CTE of the mapping; ``scope`` is a SQL expression (constant or doc_id)."""
    return f"""{name} as materialized (
      with firsts as (select * from (select {scope} as scope, *, row_number() over (partition by {scope}, norm order by doc_id, s desc) as pick
        from {source}) where pick = 1),
      numbered as (select *, row_number() over (partition by scope, category order by doc_id, s desc) as num from firsts),
      forms as (select {scope} as scope, norm, count(*) as occurrences, array_to_string(list_sort(list_distinct(list(v))), '|') as variations
        from {source} group by 1, 2)
      select cast(n.scope as bigint) as scope, n.category || '_' || format('{{:03d}}', n.num) as placeholder, n.category, cast(n.num as int) as num,
        n.norm, n.v as canonical, f.variations, f.occurrences
      from numbered n join forms f on n.scope = f.scope and n.norm = f.norm)"""


def rewritten(valued: str, texts: str, name: str = "rewritten") -> str:
    """CTE: texts with the spans (doc_id, s, e, value) replaced."""
    return f"""{name} as materialized (
      with cut as (select doc_id, s, e, value, coalesce(lag(e) over (partition by doc_id order by s), 0) as prev from ({valued})),
      glued as (select c.doc_id, string_agg(substr(t.text, prev + 1, s - prev) || value, '' order by s) as head, max(e) as last
        from cut c join {texts} t on c.doc_id = t.doc_id group by c.doc_id)
      select t.doc_id, case when g.doc_id is null then t.text else g.head || substr(t.text, g.last + 1) end as text
      from {texts} t left join glued g on t.doc_id = g.doc_id)"""


def encoding(profile=None) -> list[str]:
    """CTEs up to ``kept`` for the encoding of the notes."""
    return [NOTES, prepared(), raw("prepared", profile), resolved(), kept()]


def valued(scope: str = "0") -> str:
    return f"select k.doc_id, k.s, k.e, m.placeholder as value from kept k join mapping m on m.norm = k.norm and m.scope = {scope}"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def mask_words(v: str) -> str:
    w = "case when length(w) <= 3 then repeat('*', length(w)) else substr(w, 1, 1) || repeat('*', length(w) - 3) || right(w, 2) end"
    return rf"array_to_string([{w} for w in regexp_split_to_array({v}, '\s+') if w <> ''], ' ')"


def mask_email(v: str) -> str:
    loc, dom, tld = [rf"regexp_extract({v}, '^(.*)@(.*)\.([^.]*)$', {i})" for i in (1, 2, 3)]
    head = lambda x: f"substr({x}, 1, 1) || repeat('*', length({x}) - 1)"
    return f"{head(loc)} || '@' || {head(dom)} || '.' || {tld}"


def mask_phone(v: str) -> str:
    n = f"length(regexp_replace({v}, '[^0-9]', '', 'g'))"
    rank = f"length(regexp_replace(substr({v}, 1, j), '[^0-9]', '', 'g'))"
    c = f"substr({v}, j, 1)"
    out = f"case when {c} not between '0' and '9' then {c} when {rank} <= 2 or {rank} > {n} - 2 then {c} else '*' end"
    return f"case when {n} <= 4 then repeat('*', length({v})) else array_to_string([{out} for j in range(1, length({v}) + 1)], '') end"


def mask_iban(v: str) -> str:
    clean = f"replace({v}, ' ', '')"
    flat = f"left({clean}, 4) || repeat('*', length({clean}) - 8) || right({clean}, 4)"
    groups = f"array_to_string([substr({flat}, j, 4) for j in range(1, length({clean}) + 1, 4)], ' ')"
    return f"case when length({clean}) < 8 then repeat('*', length({v})) when contains({v}, ' ') then {groups} else {flat} end"


def mask(v: str = "v", c: str = "category") -> str:
    return f"case {c} when 'EMAIL' then {mask_email(v)} when 'PHONE' then {mask_phone(v)} when 'IBAN' then {mask_iban(v)} else {mask_words(v)} end"


LEGEND = q("\n".join(fixed.LEGEND_HEAD) + "\n")
LEGEND_END = q("\n" + "\n".join(fixed.LEGEND_FOOT))


def legend(scope_filter: str = "true") -> str:
    """Legend text from the CTE ``mapping``, one row per scope."""
    desc = " ".join(f"when {q(c)} then {q(d)}" for c, d in fixed.CATEGORY_TEXT.items())
    return (
        f"select scope, {LEGEND} || string_agg('  ' || category || '_NNN : ' || case category {desc} else 'Other' end || ' (' || n || ' unique)', "
        f"chr(10) order by category) || {LEGEND_END} as legend from (select scope, category, count(*) as n from mapping group by 1, 2) group by scope"
    )


ENTITIES = f"entities as materialized ({entities_sql()})"
PAGES = f"page_text as materialized ({PAGES_SQL})"


def label_case(column: str, table: dict[str, str], other: str = "null") -> str:
    return f"case {column} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items()) + f" else {other} end"
