"""Running values over sequences of any length: a pass within parts of a sequence, and what each part carries to the next.

A window over a key is one task's work, however many rows the key has, and all rows are one task's
if there is no key. So a long sequence is cut into parts by its order: places of about equal rows
between them are estimated once, and every row's part follows from its own place alone, so a lost
task gives the same parts again. Windows then run within (key, part). A part carries one small row
to the parts behind it, at most as many for a key as there are parts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a part, about; parts at most.
PART_ROWS, MOST_PARTS = 1_000_000, 4096
PART = "_part"

_PLACES = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)


def place(df: DataFrame, at: str) -> Column:
    """A number that grows with the order, for cutting; equal for equal rows."""
    kind = df.schema[at].dataType
    day = isinstance(kind, T.DateType)
    return (F.unix_date(at) if day else F.col(at).cast("timestamp") if isinstance(kind, T.TimestampNTZType) else F.col(at)).cast("double")


def in_parts(df: DataFrame, at: str, part_rows: int | None = PART_ROWS) -> tuple[DataFrame, bool]:
    """The frame with the part of each row, and whether there is more than one.

    All rows are in one part where they are few, where no size of parts is given, and where the
    order isn't a number or a time.
    """
    cut = part_rows is not None and isinstance(df.schema[at].dataType, _PLACES)
    parts = min(MOST_PARTS, -(-df.count() // part_rows)) if cut else 1
    if parts < 2:
        return df.withColumn(PART, F.lit(0)), False
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(place(df, at), shares, F.lit(max(10_000, 4 * parts))).alias("x")).first()["x"]  # a number for each part
    return df.withColumn(PART, _above(place(df, at), sorted({x for x in found or [] if not math.isnan(x)}))), True


def _above(x: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are below x; a null is below all. Looked up in two steps, so few are compared."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    every, coarse = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    whole = F.size(F.filter(coarse, lambda b: b < x)) * step
    return F.coalesce(whole + F.size(F.filter(F.slice(every, whole + 1, step), lambda b: b < x)), F.lit(0))


def with_carry(local: DataFrame, carries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What carries say of each row's key and part, null keys included; frequent keys can be split, as both sides are shuffled for the join."""
    on = [*keys, PART]
    renamed = carries.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return local.join(renamed, same, "left").drop(*[f"_of_{c}" for c in on])
