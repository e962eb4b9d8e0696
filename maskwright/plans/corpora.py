"""Document tables derived from the relational and text tables.

``notes`` writes one short report per order about its customer; it grows with
the tables, repeats customers over orders and varies the spelling per order.
The expressions use only functions that Spark SQL and other SQL engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import deal, spread

K, V = "c_custkey", "(o_orderkey % 3)"


def _part(by: int, mod: int) -> str:
    return f"(cast(floor({K} / {by}) as int) % {mod})"


def _two(n: str) -> str:
    return f"lpad(cast({n} as string), 2, '0')"


def _case(n: str, *values: str) -> str:
    return f"case {n} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _words(n: str, *words: str) -> str:
    return _case(n, *[f"'{w}'" for w in words])


_UPPER = _words(f"({K} % 8)", "LOOVEREN", "JANSSENS", "PEETERS", "MERTENS", "CLAES", "GOOSSENS", "WOUTERS", "MAES")
_MIXED = _words(f"({K} % 8)", "Looveren", "Janssens", "Peeters", "Mertens", "Claes", "Goossens", "Wouters", "Maes")
_GIVEN = f"concat(chr(cast(65 + {K} % 26 as int)), chr(cast(97 + {_part(26, 26)} as int)), 'rin')"
_PERSON = _case(V, f"concat('VAN ', {_UPPER}, ' ', {_GIVEN})", f"concat('Van ', {_MIXED}, ' ', {_GIVEN})",
                f"concat({_UPPER}, ' ', {_GIVEN})")
_G1, _G2, _G3 = _two(f"({K} % 100)"), _two(_part(100, 100)), _two(_part(10000, 100))
_PHONE = _case(V, f"concat('0489/', {_G3}, '.', {_G2}, '.', {_G1})", f"concat('0489 ', {_G3}, ' ', {_G2}, ' ', {_G1})",
               f"concat('+32 489', {_G3}, {_G2}, {_G1})")
_IBAN = _case(V, f"concat('BE', {_two(f'({K} % 97)')}, ' 3770 ', {_G3}, {_G2}, ' ', {_G1}, '45')",
              f"concat('BE', {_two(f'({K} % 97)')}, '3770', {_G3}, {_G2}, {_G1}, '45')",
              "'BE44 XXXX 8065 6345'")
_DAY, _MONTH, _YEAR = _two(f"(1 + {K} % 28)"), _two(f"(1 + {K} % 12)"), f"cast(1950 + {K} % 50 as string)"
_EVENT = ("concat(cast(day(o_orderdate) as string), '/', cast(month(o_orderdate) as string), '/', "
          "cast(year(o_orderdate) as string))")
_NUMBER = f"cast(({K} * 7919) % 800000000 + 100000000 as string)"
_ID = _case(V, f"concat('bsn ', {_NUMBER})", f"concat('nummer ', {_NUMBER})",
            f"concat('ssn 5', {_G1}, '-', {_G2}, '-1', {_G1}, '7 of paspoort, passport AB', {_G1}, {_G2}, {_G3})")
_PLACE = _words(f"({K} % 6)", "Gent", "Aalst", "Sint-Niklaas", "Leuven", "Wuustwezel", "Den Haag")
_ADDRESS = _case(V, f"concat('Hoofdstraat ', cast(1 + {K} % 200 as string), ', ', cast(1000 + {K} % 8999 as string), ' ', {_PLACE})",
                 f"concat('Kampweg te ', {_PLACE}, ', voorheen ', cast(1 + {K} % 300 as string), ' Oak Hill Avenue')",
                 f"concat(cast(10000 + {K} % 89999 as string), ' Lyon, postbus SW1A 1AA, in Vlierzele')")
_VEHICLE = _words(f"({K} % 5)", "een fiat seat ibiza", "BMW X5", "Mercedes-Benz Sprinter", "de ducato", "renault trucks T430")
_ROAD = f"concat({_words(V, 'N', 'E', 'a')}, cast(1 + {K} % 999 as string))"
_EXTRA = _case("(o_orderkey % 7)", "'zie PERSON_001 en Salu Kia Zola PERSON_1062'", "'RECHTBANK VAN EERSTE AANLEG'",
               "concat('vader van DE', chr(10), 'GROOT Willem en Karel')", "'telefoon +32 3 217 84 30'",
               "'volgens von Braun, Mr. John Smith en Jean-Pierre Dupont'", "'de vergadering over de woonplaats van De Grote Markt'",
               "'THOMPSON Jan geboren'")

NOTE = (
    "case when o_orderkey % 10 = 9 then 'Geen bijzonderheden, het dossier wordt gesloten.' else concat("
    f"'Dossier ', o_orderstatus, ': ', {_PERSON}, ', geboren op ', {_DAY}, '/', {_MONTH}, '/', {_YEAR}, ' te ', {_PLACE}, "
    f"', aangetroffen op ', {_EVENT}, '.', chr(10), "
    f"'Tel ', {_PHONE}, ' mail c', cast({K} as string), '@example.com rekening ', {_IBAN}, '; ', {_ID}, '.', chr(10), "
    f"'Adres: ', {_ADDRESS}, '. Rijdt met ', {_VEHICLE}, ' op ', {_ROAD}, ' richting antwerpen.', chr(10), "
    f"{_GIVEN}, ' ', {_UPPER}, ' - ', {_DAY}, '-', {_MONTH}, '-', {_YEAR}, ' - Nationaliteit: Belgisch; ', {_EXTRA}, '.', "
    "repeat(' Verder geen nieuws.', cast(o_orderkey % 4 as int))) end"
)
NOTES_SQL = f"select o_orderkey as doc_id, {NOTE} as text from orders join customer on o_custkey = c_custkey"

# Pages of a scan: some with hardly any native text where the OCR text is whole.
PAGES_SQL = (
    "select conv_id as doc_id, cast(turn + 1 as int) as page_no, "
    "case when turn % 4 = 3 then text when turn % 3 = 0 then substr(text, 1, 30) when turn % 3 = 1 then text else concat(chr(10), substr(text, 1, 5), '  ') end as native_text, "
    "case when turn % 4 = 3 then '' else concat(' ', text) end as ocr_text from conversations"
)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    # dealt after the join, whose partitions are sized by bytes
    return deal(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), orders.count(), "o_orderkey", "o_custkey")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_with_customers(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.expr(NOTE).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with every non-ASCII character replaced by ``_``; engines
    whose word edges are ASCII-only agree with Unicode ones on such text."""
    return documents(spark, sf_dir).select("doc_id", F.expr("regexp_replace(text, '[^\\\\x00-\\\\x7F]', '_')").alias("text"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        F.expr("case when turn % 4 = 3 then text when turn % 3 = 0 then substr(text, 1, 30) when turn % 3 = 1 then text "
               "else concat(chr(10), substr(text, 1, 5), '  ') end").alias("native_text"),
        F.expr("case when turn % 4 = 3 then '' else concat(' ', text) end").alias("ocr_text"),
    )


# What entity models might have returned for a note: text, label, score, language.
_PERSON_FORM = f"concat({_GIVEN}, ' ', {_UPPER})"
ENTITY_ROWS = [
    (_PERSON_FORM, "'PER'", f"cast(50 + {K} % 50 as double) / cast(100 as double)", "'nl'"),
    (_PERSON_FORM, "'PERSON'", f"cast(40 + {K} % 50 as double) / cast(100 as double)", "'en'"),
    ("'Dossier'", _words(V, "ORG", "LOC", "Misc_Thing"), f"cast(30 + {K} % 60 as double) / cast(100 as double)", "'nl'"),
    ("'Adres'", _words(V, "GPE", "ORG", "DATE"), "0.75", "'en'"),
    ("'Verder geen'", _words(V, "LOC", "PER", "EVENT"), f"cast(35 + {K} % 40 as double) / cast(100 as double)", "'de'"),
    ("'geen nieuws'", _words(V, "PER", "FAC", "LOC"), "0.6", "'nl'"),
    (f"concat('c', cast({K} as string), '@example.com')", "'PER'", "0.8", "'fr'"),
    (f"concat('richting antwerpen.', chr(10), {_GIVEN})", "'LOC'", "0.65", "'nl'"),
]
# Labels of the other two kinds of models, by row.
ZERO_SHOT_ROWS = ["Person", "name", "organization", "address", "API key", "shoe size", "email", "city"]
RULE_ENGINE_ROWS = ["PERSON", "NRP", "ORGANIZATION", "LOCATION", "UK_NHS", "SHOE_SIZE", "EMAIL_ADDRESS", "GPE"]


def _entity(i: int, row: tuple[str, str, str, str]) -> str:
    text, label, score, lang = row
    return (
        f"{text} as e_text, {label} as label, cast({score} as double) as score, {lang} as lang, {i} as ord, "
        f"'{ZERO_SHOT_ROWS[i]}' as zero_shot, '{RULE_ENGINE_ROWS[i]}' as rule_engine"
    )


def entities_sql() -> str:
    """Model output for all notes: the first place where the text occurs."""
    base = f"select o_orderkey, c_custkey, {NOTE} as note from orders join customer on o_custkey = c_custkey"
    rows = " union all ".join(
        f"select o_orderkey as doc_id, note, {_entity(i, r)} from base" for i, r in enumerate(ENTITY_ROWS))
    return (
        f"with base as ({base}), found as ({rows}) "
        "select doc_id, cast(instr(note, e_text) - 1 as int) as start, "
        'cast(instr(note, e_text) - 1 + length(e_text) as int) as "end", e_text as text, label, score, lang, ord, '
        "zero_shot, rule_engine from found where instr(note, e_text) > 0"
    )


def entities(spark: SparkSession, sf_dir: str, labels: str = "label") -> DataFrame:
    """The same rows in Spark: one pass over the notes, exploded.  ``labels``
    selects whose labels are used: label, zero_shot or rule_engine.

    An outer explode and a test that holds for nulls too: what an inner explode or a plain comparison rules out, the
    optimizer tests below the dealing already, and so makes the notes once more there, in tasks sized by bytes.
    """
    rows = ", ".join(
        f"struct(instr(note, {r[0]}) - 1 as start, {_entity(i, r)})".replace(" as e_text", " as text")
        for i, r in enumerate(ENTITY_ROWS))
    found = (
        orders_with_customers(spark, sf_dir)
        .select("o_orderkey", "c_custkey", F.expr(NOTE).alias("note"))
        .select(F.col("o_orderkey").alias("doc_id"), F.expr(f"array({rows})").alias("rows"))
        .select("doc_id", F.explode_outer("rows").alias("e"))
        .select("doc_id", "e.*")
        .where("coalesce(start, -1) >= 0")
    )
    return found.select(
        "doc_id", "start", (F.col("start") + F.length("text")).alias("end"), "text",
        F.col(labels).alias("label"), "score", "lang", "ord")
