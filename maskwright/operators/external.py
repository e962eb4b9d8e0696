"""Entities found by models elsewhere, as tables.

Input: ``doc_id, start, end, text, label, score, lang, source`` and, where the
model's own order matters, ``ord``.  Offsets refer to the document.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.spans import lits, strip, lit
from maskwright.operators.joins import without_overlaps
from maskwright.operators.resolve import resolve_spans

# source -> (label map, category of unknown labels or None to drop, lower-case labels)
LABEL_MAPS: dict[str, tuple[dict[str, str], str | None, bool]] = {
    "ner": (fixed.NER_LABELS, "MISC", False),
    "hybrid": (fixed.HYBRID_LABELS, None, False),
    "zero_shot": (fixed.ZERO_SHOT_LABELS, "MISC", True),
    "rule_engine": (fixed.RULE_ENGINE_LABELS, "MISC", False),
}


def _lookup(column: str, table: dict[str, str]) -> str:
    whens = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items())
    return f"case {column} {whens} end"


def map_labels(entities: DataFrame, source: str) -> DataFrame:
    """Add ``category``; unknown labels become MISC or, for hybrid, drop out."""
    table, other, lowered = LABEL_MAPS[source]
    category = F.expr(_lookup("lower(label)" if lowered else "label", table))
    out = entities.withColumn("category", category if other is None else F.coalesce(category, F.lit(other)))
    return out.where(F.col("category").isNotNull()) if other is None else out


def one_per_position(entities: DataFrame, *order: Column, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """First entity of every position.  A reduction, not a window: copies of a
    position are merged before they are shuffled."""
    keys = [*by, "start", "end"]
    rest = [c for c in entities.columns if c not in keys]
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_r")
    return entities.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}") for c in rest]).select(*entities.columns)


def ner_spans(entities: DataFrame, categories: Iterable[str] | None = None, include_dates: bool = False,
              by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Named entities worth replacing: wanted categories, on one line, two
    characters or more, one per position; confidence 0.90."""
    wanted = list(categories) if categories is not None else (
        fixed.NER_DEFAULT_CATEGORIES + (["DATE"] if include_dates else []))
    kept = map_labels(entities, "ner").where(
        F.col("category").isin(wanted)
        & (F.length(F.expr(strip("text"))) >= 2)
        & ~F.col("text").contains("\n")
    ).withColumn("confidence", F.lit(0.90))
    return one_per_position(kept, F.col("ord"), by=by)


def merge_languages(entities: DataFrame, languages: list[str], categories: Iterable[str] | None = None) -> DataFrame:
    """Results of several languages' models: the first language in the list
    wins a position; languages not listed are left out."""
    spoken = entities.where(F.col("lang").isin(languages))
    found = ner_spans(spoken, categories, by=("doc_id", "lang"))
    rank = F.expr(f"array_position(array({lits(languages)}), lang)")
    return one_per_position(found, rank, F.col("ord"))


def hybrid_entities(patterns: DataFrame, entities: DataFrame, include_org: bool = False) -> DataFrame:
    """Model entities that fit in beside the pattern spans."""
    wanted = ["PERSON", "PLACE"] + (["ORG"] if include_org else [])
    candidates = map_labels(entities, "hybrid").where(
        F.col("category").isin(wanted)
        & (F.length(F.expr(strip("text"))) >= 2)
        & ~F.col("text").contains("@")
        & (F.lower("text") != "email")
    )
    free = without_overlaps(candidates, patterns)
    earlier_first = resolve_spans(free, [F.col("ord")])
    return earlier_first.withColumn("confidence", F.lit(0.90))


def hybrid_spans(patterns: DataFrame, entities: DataFrame, include_org: bool = False) -> DataFrame:
    """Pattern spans and fitting model entities, overlaps resolved."""
    columns = ["doc_id", "start", "end", "text", "category", "confidence", "ord"]
    added = hybrid_entities(patterns, entities, include_org)
    both = patterns.select(*columns[:-1], F.lit(0).alias("_src"), "ord").unionByName(
        added.select(*columns[:-1], F.lit(1).alias("_src"), "ord"))
    order = [-F.col("confidence"), F.col("start") - F.col("end"), F.col("_src"), F.col("ord")]
    return resolve_spans(both, order).select(*columns)


def scored_spans(entities: DataFrame, source: str, threshold: float = 0.5, labels: Iterable[str] | None = None,
                 flat: bool = False) -> DataFrame:
    """Entities above a score with requested labels; the score is the confidence."""
    kept = entities.where(F.col("score") >= threshold)
    if labels is not None:
        kept = kept.where(F.col("label").isin(list(labels)))
    mapped = map_labels(kept, source).withColumn("confidence", F.col("score"))
    return resolve_spans(mapped) if flat else mapped


# Profiles whose spans come from a model alone: named entities, zero-shot entities with scores, a rule engine's.
MODEL_PROFILES = ("ner", "zero_shot", "rule_engine")


def model_spans(entities: DataFrame, profile: str, threshold: float = 0.5, labels: Iterable[str] | None = None,
                categories: Iterable[str] | None = None) -> DataFrame:
    """Disjoint spans of one kind of model: by score, then length, then the model's order.

    ``threshold`` and ``labels`` select scored entities, ``categories`` named ones.
    """
    if profile == "ner":
        found = ner_spans(entities, categories)
    elif profile in MODEL_PROFILES:
        found = scored_spans(entities, profile, threshold, labels)
    else:
        raise ValueError(f"unknown model profile {profile!r}; known: {', '.join(MODEL_PROFILES)}")
    return resolve_spans(found.select("doc_id", "start", "end", "text", "category", "confidence", "ord"))


def personal_data_spans(entities: DataFrame, extended: bool = False, threshold: float = 0.5) -> DataFrame:
    """Entities with the predefined labels for personal data."""
    labels = fixed.ZERO_SHOT_DEFAULT + (fixed.ZERO_SHOT_EXTRA if extended else [])
    return scored_spans(entities, "zero_shot", threshold, labels)


def language_code(language: str) -> str:
    """ISO code of a language code or name (SQL fragment); fails on others."""
    names = _lookup("lower(trim(l))", {**fixed.LANGUAGE_NAMES, **{c: c for c in fixed.LANGUAGES}})
    error = f"raise_error(concat('unknown language: ', l))"
    return f"element_at(transform(array({language}), l -> coalesce({names}, {error})), 1)"


def to_document_offsets(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Shift entities found in chunks (doc_id, chunk) to document positions."""
    starts = chunks.select("doc_id", "chunk", F.col("start").alias("_at"))
    return (
        entities.join(starts, ["doc_id", "chunk"])
        .withColumn("start", F.col("start") + F.col("_at"))
        .withColumn("end", F.col("end") + F.col("_at"))
        .drop("_at")
    )
