"""Detection as a table operator: documents in, spans out."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import batches, fixed
from maskwright.functions.detectors import CATEGORIES, DETECTORS, Detector
from maskwright.functions.resolve import drop_masked, resolve
from maskwright.functions.spans import SPANS, empty, is_ascii, lits, one_per_position, window
from maskwright.session import ship

PROFILES: dict[str, list[str]] = {
    "patterns": fixed.PATTERN_PROFILE,
    "hybrid": fixed.HYBRID_PROFILE,
}
Profile = str | Iterable[str | Detector]


def detectors_of(profile: Profile, categories: Iterable[str] | None = None) -> list[Detector]:
    """A profile name, or an own list of detector names and functions; of named ones only those that make the categories."""
    if isinstance(profile, str):
        if profile not in PROFILES:
            raise ValueError(f"unknown profile {profile!r}; known: {', '.join(PROFILES)}")
        profile = PROFILES[profile]
    if categories is not None:
        wanted = set(categories)
        profile = [d for d in profile if not isinstance(d, str) or CATEGORIES[d] in wanted]
    return [DETECTORS[d] if isinstance(d, str) else d for d in profile]


def raw_spans(text: str, profile: Profile = "patterns") -> str:
    """All detectors' spans of a text, in production order, possibly overlapping."""
    return "concat(" + ", ".join(d(text) for d in detectors_of(profile)) + ")"


def resolved_spans(text: str, profile: Profile = "patterns", skip_masked: bool = False,
                   categories: Iterable[str] | None = None) -> str:
    """Disjoint spans of a text, sorted by start."""
    spans = resolve(raw_spans(text, profile))
    if categories is not None:
        spans = f"filter({spans}, s -> s.category in ({lits(categories)}))"
    return drop_masked(spans) if skip_masked else spans


def searched(spark: SparkSession, text: str, names: Iterable[str], resolved: bool, otherwise: str) -> Column:
    """The spans of named detectors: of ASCII texts found by the batch, ``otherwise`` of others by the SQL fragment."""
    wanted = tuple(names)

    def search(texts: pa.Array) -> pa.Array:
        return batches.spans_of(texts, wanted, resolved)

    ship(spark)
    ascii_text = F.expr(is_ascii(text))
    found = F.arrow_udf(search, SPANS)(F.when(ascii_text, F.col(text)))
    return F.when(ascii_text, found).otherwise(F.expr(otherwise))


def _named(profile: Profile, categories: Iterable[str] | None = None) -> list[str] | None:
    """The names of a profile's detectors, of those that make the categories; None if it has a caller's own."""
    known = {id(DETECTORS[n]): n for n in batches.FINDERS}
    names = [known.get(id(d)) for d in detectors_of(profile, categories)]
    return None if not names or None in names else names


def with_raw(docs: DataFrame, profile: Profile, categories: Iterable[str] | None = None) -> DataFrame:
    """The documents' ``spans``: all of the profile, or those of some categories alone."""
    if categories is None:
        spans = raw_spans("text", profile)
    else:
        wanted = list(categories)
        chosen = detectors_of(profile, wanted)
        spans = f"filter(concat({', '.join(d('text') for d in chosen)}), s -> s.category in ({lits(wanted)}))" if chosen else empty(SPANS)
    names = _named(profile, categories)
    # a named detector makes spans of its one category
    found = F.expr(spans) if names is None else searched(docs.sparkSession, "text", names, False, spans)
    return docs.withColumn("spans", found)


def with_resolved(docs: DataFrame, profile: Profile = "patterns", skip_masked: bool = False,
                  categories: Iterable[str] | None = None) -> DataFrame:
    """The documents' disjoint ``spans``, sorted by start."""
    names = _named(profile)
    if names is None:
        return docs.withColumn("spans", F.expr(resolved_spans("text", profile, skip_masked, categories)))
    done = docs.withColumn("spans", searched(docs.sparkSession, "text", names, True, resolved_spans("text", profile)))
    if categories is not None:
        done = done.withColumn("spans", F.expr(f"filter(spans, s -> s.category in ({lits(categories)}))"))
    return done.withColumn("spans", F.expr(drop_masked("spans"))) if skip_masked else done


def explode_spans(docs: DataFrame, key: str = "doc_id", context: bool = True) -> DataFrame:
    """One row per span of the column ``spans``.  The array is computed once, below the generator; the
    null test stays above it so it cannot be pushed into the search."""
    rows = (
        docs.select(key, "text", F.posexplode_outer("spans").alias("pos", "s"))
        .where(F.col("s").isNotNull())
    )
    columns = [
        F.col(key),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        F.col("s.text").alias("text"),
        F.col("s.category").alias("category"),
        F.col("s.confidence").alias("confidence"),
        F.col("s.detector").alias("detector"),
        F.col("pos").alias("ord"),
    ]
    if context:
        columns.append(F.expr(window("text", "s.ctx_start", "s.ctx_end")).alias("context"))
    return rows.select(*columns)


def detect(docs: DataFrame, detector: str | Detector, key: str = "doc_id") -> DataFrame:
    """Spans of one detector, one row per distinct position."""
    fn = DETECTORS[detector] if isinstance(detector, str) else detector
    return explode_spans(docs.select(key, "text", F.expr(one_per_position(fn("text"))).alias("spans")), key)


def detect_raw(docs: DataFrame, profile: Profile = "patterns", key: str = "doc_id", context: bool = False,
               categories: Iterable[str] | None = None) -> DataFrame:
    """Spans of all detectors of a profile; ``ord`` is the production order.

    With ``categories`` only their spans come, numbered among themselves, and the other detectors do not search. Raw spans
    do not depend on those of other detectors; resolved ones do.
    """
    return explode_spans(with_raw(docs.select(key, "text"), profile, categories), key, context)


def detect_all(docs: DataFrame, profile: Profile = "patterns", skip_masked: bool = False,
               categories: Iterable[str] | None = None, key: str = "doc_id", context: bool = False) -> DataFrame:
    """Disjoint spans of all detectors of a profile."""
    return explode_spans(with_resolved(docs.select(key, "text"), profile, skip_masked, categories), key, context)
