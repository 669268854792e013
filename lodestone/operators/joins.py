"""Joins that aren't plain equi-joins: nearest before and after, containment, lookups with a fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import scan as S


def previous_and_next(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, value: str, part_rows: int | None = S.PART_ROWS) -> DataFrame:
    """The rows of left with previous and next: value of the nearest row of right strictly before and after.

    Both sides are laid in one sequence for each key, once forwards and once backwards, so nothing
    is joined. Long sequences are cut into parts, each of which carries its last and first value to
    the others, so that a key with very many rows, or none at all, is many tasks' work. Where rows of
    right are tied, the largest value counts; null values count as no rows.
    """
    columns = [c for c in left.columns if c not in (*on, at)]
    rows = left.select(*on, at, F.struct(*columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    marks = right.select(*on, at, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    # Of equal places the rows of left come first either way, so what precedes them is strictly before or after.
    both, several = S.in_parts(rows.withColumn("_mark", F.lit(0)).unionByName(marks.withColumn("_mark", F.lit(1))), at, part_rows)
    seq = W.partitionBy(*on, S.PART)
    so_far = (W.unboundedPreceding, W.currentRow)
    placed = both.withColumn("previous", F.last("_v", ignorenulls=True).over(seq.orderBy(F.asc(at), "_mark", "_v").rowsBetween(*so_far)))
    placed = placed.withColumn("next", F.last("_v", ignorenulls=True).over(seq.orderBy(F.desc(at), "_mark", "_v").rowsBetween(*so_far)))
    own = [*on, at, *[F.col("_row")[c].alias(c) for c in columns]]
    if not several:
        return placed.where("_mark = 0").select(*own, "previous", "next")
    # Of each part the nearest values to either border, and of these what the parts before and behind a part have.
    per_place = both.groupBy(*on, S.PART, at).agg(F.max("_v").alias("_v"))
    there = F.when(F.col("_v").isNotNull(), F.col(at))
    per_part = per_place.groupBy(*on, S.PART).agg(F.max_by("_v", there).alias("_last"), F.min_by("_v", there).alias("_first"))
    parts = W.partitionBy(*on).orderBy(S.PART)
    before = F.last("_last", ignorenulls=True).over(parts.rowsBetween(W.unboundedPreceding, -1)).alias("_before")
    behind = F.first("_first", ignorenulls=True).over(parts.rowsBetween(1, W.unboundedFollowing)).alias("_behind")
    done = S.with_carry(placed.where("_mark = 0"), per_part.select(*on, S.PART, before, behind), on)
    return done.select(*own, F.coalesce("previous", "_before").alias("previous"), F.coalesce("next", "_behind").alias("next"))


#: The sides of an item and of a box along each axis.
_AXES = {"x": ("x0", "x1", "bx0", "bx1"), "y": ("top", "bottom", "by0", "by1")}
#: Sizes are powers of two from the least to the largest, by their exponent; marks of boxes that no bin holds, and of items that no bin does.
_LEAST, _LARGEST, _ANY_BOX, _ANY_ITEM = -20, 50, 1000, 1001
#: Boxes, at most, that are sent to where the items lie.
FEW_BOXES = 100_000
#: Where both sides are shuffled: sizes that share their bins, and by how much the largest of these may exceed the bins.
_SHARED, _ABOVE = 6, 3


def _shared_bins(sizes: Sequence[int]) -> dict[int, int]:
    """The size of the bins of each size: sizes near each other share theirs, so that an item lies in few.

    A box covers at most 2**_ABOVE bins and one or two more, and a bin is less than 2**(_SHARED - _ABOVE) times as wide as its boxes.
    """
    shared: dict[int, int] = {}
    for top in sorted(sizes, reverse=True):
        if top not in shared:
            near = [s for s in sizes if top - _SHARED < s <= top]
            shared |= dict.fromkeys(near, max(min(near), top - _ABOVE))
    return shared


def inside(items: DataFrame, boxes: DataFrame, on: Sequence[str], axis: str = "y", sizes: Sequence[int] | None = None, few: int = FEW_BOXES) -> DataFrame:
    """Items (x0, x1, top, bottom) that lie wholly in a box (bx0, by0, bx1, by1) of the same page.

    Along the axis, a box covers at most two or three bins of the smallest size that is no smaller
    than itself; an item lies in one bin of each size that boxes have. Both are joined by bin, so an
    item meets boxes near it only, and a page with very many of both is many tasks' work; the edges
    are compared after that. Sizes are found by one pass over the boxes if they aren't given; if that
    finds few boxes, they are sent to where the items lie, which then aren't shuffled. Else both sides
    are: by what Spark estimates, words made from a small table would be sent through the driver. An
    item would then be shuffled for each size; sizes that were found share bins, of which boxes cover more.
    Unbounded boxes, and what has no place (null, not a number, or ends before it begins), meet all.
    """
    begin, end, low, high = map(F.col, _AXES[axis])
    wide = high - low
    placeless = lambda a, b: F.coalesce(F.isnan(a.cast("double")) | F.isnan(b.cast("double")) | (a > b), F.lit(True))
    exponent = F.greatest(F.ceil(F.log2(F.when(wide > 0, wide.cast("double")).otherwise(1e-9))), F.lit(_LEAST)).cast("int")
    if sizes is not None:
        fitting = F.array_min(F.filter(F.array(*[F.lit(s) for s in sorted(sizes)]), lambda s: s >= exponent))
        exponent = F.coalesce(fitting, F.lit(_LARGEST + 1))
    bin_of = lambda x, size: F.floor(x.cast("double") / F.pow(F.lit(2.0), size)).cast("long")
    level = F.when(placeless(low, high) | (exponent > _LARGEST), _ANY_BOX).otherwise(exponent)
    sized = boxes.withColumn("_size", level)
    seen = {r[0]: r[1] for r in sized.groupBy("_size").count().collect()} if sizes is None else None  # at most one row for each size
    present, sent = sorted(seen) if sizes is None else [*sorted(sizes), _ANY_BOX], seen is not None and sum(seen.values()) <= few
    if seen is not None and not sent:
        shared = _shared_bins([s for s in present if s != _ANY_BOX]) | {_ANY_BOX: _ANY_BOX}
        sized = sized.withColumn("_size", F.create_map(*[F.lit(x) for pair in shared.items() for x in pair])[F.col("_size")])
        present = sorted({shared[s] for s in present})
    own = F.when(F.col("_size") == _ANY_BOX, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(bin_of(low, F.col("_size")), bin_of(high, F.col("_size"))))
    placed = F.transform(own, lambda b: F.struct(F.col("_size").alias("size"), b.alias("bin")))
    filed = sized.withColumn("_bin", F.explode(F.concat(placed, F.array(F.struct(F.lit(_ANY_ITEM).alias("size"), F.lit(0).cast("long").alias("bin")))))).drop("_size")
    filed = filed.hint("broadcast" if sent else "merge")
    bins = [F.struct(F.lit(s).alias("size"), (F.lit(0).cast("long") if s == _ANY_BOX else bin_of(begin, F.lit(float(s)))).alias("bin")) for s in present]
    alone = F.struct(F.lit(_ANY_ITEM).alias("size"), F.lit(0).cast("long").alias("bin"))
    asked = items.withColumn("_bin", F.explode(F.when(placeless(begin, end), F.array(alone)).otherwise(F.array(*bins) if bins else F.array(alone))))
    within = (F.col("x0") >= F.col("bx0")) & (F.col("x1") <= F.col("bx1")) & (F.col("top") >= F.col("by0")) & (F.col("bottom") <= F.col("by1"))
    return asked.join(filed, [*on, "_bin"]).where(within).drop("_bin")


def reordered(rows: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Rows that were found, in the order of their rank."""
    return rows.join(found.select(key, "rank"), key).orderBy("rank")


def with_blob(matches: DataFrame, marks: DataFrame, clients: DataFrame, column: str = "logo_data") -> DataFrame:
    """Matches (source, id) with the blob of their own table; ids of both tables overlap, so the source decides."""
    own = marks.select(F.lit("mark").alias("source"), "id", F.col(column)).unionByName(clients.select(F.lit("client").alias("source"), "id", F.col(column)))
    return matches.join(own, ["source", "id"], "left")


def first_blob(keys: DataFrame, marks: DataFrame, clients: DataFrame, column: str = "logo_data") -> DataFrame:
    """For each id the blob among the marks, else that among the clients."""
    a = marks.select("id", F.col(column).alias("_a"))
    b = clients.select("id", F.col(column).alias("_b"))
    return keys.join(a, "id", "left").join(b, "id", "left").withColumn(column, F.coalesce("_a", "_b")).drop("_a", "_b")


def merged_scores(text: DataFrame, logo: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates of either list with both scores, 0 where a list lacks one."""
    t = text.select(*keys, F.col("sim").alias("t"))
    return t.join(logo.select(*keys, F.col("sim").alias("l")), list(keys), "full").select(*keys, F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("l", F.lit(0.0)).alias("l"))
