"""Entries from a stream of lines: a running count of start markers numbers them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.records import START_MARKERS
from lodestone.operators import scan as P


def starts(line: Column) -> Column:
    """Whether a trimmed line starts an entry."""
    return reduce(lambda a, b: a | b, [line.rlike(p) for p in START_MARKERS])


def segmented(rows: DataFrame, keys: Sequence[str], order: str, is_start: Column, dropped: Column | None = None, part_rows: int | None = P.PART_ROWS) -> DataFrame:
    """Rows with entry, the number of the entry they are in; those before the first start, and dropped ones, are left out.

    Starts are counted within parts of a long sequence, to which those of the parts before are added.
    """
    out, several = P.in_parts(rows.withColumn("_start", F.coalesce(is_start, F.lit(False))), order, part_rows)
    if dropped is not None:
        out = out.withColumn("_drop", F.coalesce(dropped, F.lit(False)))
    seq = W.partitionBy(*keys, P.PART).orderBy(order)
    local = out.withColumn("entry", F.sum(F.col("_start").cast("long")).over(seq))
    if several:
        counted = out.groupBy(*keys, P.PART).agg(F.count_if("_start").alias("_starts"))
        earlier = F.sum("_starts").over(W.partitionBy(*keys).orderBy(P.PART).rowsBetween(W.unboundedPreceding, -1))
        carried = P.with_carry(local, counted.select(*keys, P.PART, earlier.alias("_earlier")), keys)
        local = carried.withColumn("entry", F.col("entry") + F.coalesce("_earlier", F.lit(0))).drop("_earlier")
    found = local.where("entry > 0").drop(P.PART)
    return found.drop("_start") if dropped is None else found.where(F.col("_start") | ~F.col("_drop")).drop("_start", "_drop")


def entries(pages: DataFrame, keys: Sequence[str] = ("doc_id", "page"), text: str = "text", compat: bool = False) -> DataFrame:
    """(…, entry, lines) of each page's text. Entries don't span pages.

    With compat the line right before a start is lost, as in the format's first reader.
    """
    lines = pages.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("at", "raw")).withColumn("line", X.stripped(F.col("raw")))
    following = F.lead(X.stripped(F.col("raw"))).over(W.partitionBy(*keys).orderBy("at"))
    lines = lines.withColumn("_next", starts(following)) if compat else lines
    found = segmented(lines.where(F.col("line") != ""), keys, "at", starts(F.col("line")), F.col("_next") if compat else None, part_rows=None)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return found.groupBy(*keys, "entry").agg(ordered.alias("lines"))
