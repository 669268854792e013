"""Similarities of names and hashes, and the rule that fuses them into scores."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X

# Thresholds and weights of the comparison.
GATE, PIXEL_LOW, LOGO_HIGH, LOGO_FACTOR, SNAP = 0.3, 0.25, 0.70, 0.4, 0.92
TEXT_FACTOR, FUZZY_FACTOR, CONTAINED = 0.9, 0.95, 0.85
NAMED_THRESHOLD, NAMELESS_THRESHOLD = 0.35, 0.45
HIGH_TIER, BADGE = 70.0, 80.0
HASH_BITS = 64


def literal(a: Column, b: Column) -> Column:
    """1 for equal names, less where one holds the other, 0 otherwise and for empty ones; of normalised names."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(X.contains_either(a, b), CONTAINED).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 if there are none."""
    x, y = X.tokens(a), X.tokens(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def hash_similarity(a: Column, b: Column) -> Column:
    """1 minus the share of differing bits of two 64-bit hashes; 0 where one is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(HASH_BITS))), F.lit(0.0))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matcher prepares its second text, so equal second texts of a batch are prepared once."""
    out = [0.0] * len(a)
    rows: dict[str, list[int]] = {}
    first = [(x or "").lower() for x in a]
    for i, y in enumerate(b):
        rows.setdefault((y or "").lower(), []).append(i)
    for y, at in rows.items():
        matcher = SequenceMatcher(None, "", y)
        done: dict[str, float] = {}
        for i in at:
            if first[i] not in done:
                matcher.set_seq1(first[i])
                done[first[i]] = matcher.ratio()
            out[i] = done[first[i]]
    return pd.Series(out, dtype="float64")


def sequence_ratio(query: Column, other: Column) -> Column:
    """Ratcliff-Obershelp ratio of lower-cased texts; not symmetric, so the query comes first."""
    return F.pandas_udf(_ratios, "double")(query, other)


def python_percent(x: Column) -> Column:
    """round(100 * x, 2) as Python rounds, which no built-in does."""
    return F.pandas_udf(lambda v: pd.Series([None if e is None or e != e else round(e * 100, 2) for e in v], dtype="float64"), "double")(x)


def percent(x: Column) -> Column:
    return F.round(x * 100, 2)


def passes_gate(has_image: Column, text: Column, logo: Column) -> Column:
    """Whether a candidate is scored: text alone must be near enough, or with a picture either."""
    return (text >= GATE) | (has_image & (logo >= GATE))


def text_score(literal_: Column, text: Column, fuzzy: Column) -> Column:
    return F.greatest(literal_, TEXT_FACTOR * text, FUZZY_FACTOR * fuzzy)


def image_score(pixel: Column, logo: Column) -> Column:
    """The better of both signals; a near logo that the pixels contradict counts less; near 1 snaps to 1."""
    raw = F.when((pixel < PIXEL_LOW) & (logo > LOGO_HIGH), LOGO_FACTOR * logo).otherwise(F.greatest(logo, pixel))
    return F.when(raw > SNAP, 1.0).otherwise(raw)


def threshold(query_name: Column) -> Column:
    return F.when(query_name != "", NAMED_THRESHOLD).otherwise(NAMELESS_THRESHOLD)


def tier(image_percent: Column, text_percent: Column) -> Column:
    return F.when((image_percent >= HIGH_TIER) | (text_percent >= HIGH_TIER), "high").otherwise("low")


def has_badge(image_percent: Column, text_percent: Column) -> Column:
    return F.greatest(image_percent, text_percent) >= BADGE
