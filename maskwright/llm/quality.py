"""Quality rules by compression bands.

Zstandard ratios (bytes / compressed bytes) of the whole text and of fixed chunks reject repetitive text (ratio above
the band) and incompressible text (below it); the band depends on the text's length. One narrow pass, no shuffle.

Defined cases: null text is empty (no words, so it fails the base rules); equal rows give equal results; an empty table
gives an empty result; columns other than id and text are neither read nor returned by `quality`, and all of them are
returned untouched by `keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ship
from .texts import BASE, Words, mix, slices, sums

#: (bytes of text up to, lowest ratio, highest ratio) of whole texts; short texts carry more of the frame's overhead.
WHOLE_BANDS = ((512, 1.15, 3.0), (2048, 1.3, 3.5), (8192, 1.45, 4.0), (65536, 1.5, 4.5), (1 << 62, 1.5, 5.5))
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Limits. A text is rejected by its chunks if over `bad_chunk_share` of them lie outside `chunk_band`;
    a last chunk under half the size counts with no other, so it is left to the whole-text band."""

    whole_bands: tuple = WHOLE_BANDS
    chunk_bytes: int = 2048
    chunk_band: tuple[float, float] = (1.3, 3.5)
    bad_chunk_share: float = 1 / 3
    min_words: int = 50
    max_repeat_share: float = 0.5
    level: int = 3


def _repeated_words(words: Words) -> np.ndarray:
    """Per text: words in a three-word window that is found twice or more in the text."""
    marks = np.zeros(len(words.start), bool)
    shingle, at = words.shingles(3)
    key = mix(shingle + words.text_of[at].astype(np.uint64) * np.uint64(BASE))
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        hit = at[np.isin(key, again)]
        for i in range(3):
            marks[hit + i] = True
    return sums(marks, words.first)


def _measure(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    words = Words(texts, lower=False)
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(SYMBOLS[1:-1].encode(), np.uint8)] = True
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": sums(words.inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": sums(symbol[data], offsets),
        "n_repeat_words": _repeated_words(words),
    }
    whole = data.tobytes()
    zip_ = zstandard.ZstdCompressor(level=rules.level).compress
    duplicates, ratio, chunks, bad = np.zeros(n, np.int64), np.ones(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    low, high = rules.chunk_band
    for i in range(n):
        text = whole[offsets[i]:offsets[i + 1]]
        lines = [line for line in text.split(b"\n") if line.strip()]
        duplicates[i] = len(lines) - len(set(lines))
        if not text:
            continue
        ratio[i] = len(text) / len(zip_(text))
        for k in range(0, len(text), rules.chunk_bytes):
            chunk = text[k:k + rules.chunk_bytes]
            if 2 * len(chunk) < rules.chunk_bytes:
                break
            chunks[i] += 1
            bad[i] += not low <= len(chunk) / len(zip_(chunk)) <= high
    bands = np.searchsorted([b[0] for b in rules.whole_bands], np.diff(offsets), "left")
    lowest, highest = (np.array([b[k] for b in rules.whole_bands])[bands] for k in (1, 2))
    out |= {"n_dup_lines": duplicates, "zstd_ratio": ratio, "n_chunks": chunks, "n_bad_chunks": bad}
    out["base_failed"] = (out["n_words"] < rules.min_words) | (
        100 * out["n_repeat_words"] > 100 * rules.max_repeat_share * out["n_words"])
    out["kept"] = ~out["base_failed"] & (ratio >= lowest) & (ratio <= highest) & (bad <= rules.bad_chunk_share * chunks)
    return out


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "zstd_ratio double, n_chunks long, n_bad_chunks long, kept boolean"
)


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts, ratios, base_failed and kept."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = _measure(part.column("text"), rules)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(found[c]) for c in names)], names=["doc_id", *names])

    ship(docs.sparkSession)
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part in slices(batch, str(where)):
                part = part.filter(pa.array(_measure(part.column(where), rules)["kept"]))
                yield part.rename_columns(names)

    names = docs.columns
    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


__all__ = ["Rules", "keep_good", "quality"]
