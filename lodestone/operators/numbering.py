"""Dense numbers in an order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART, _AT = "_number_part", "_number_at"


def numbered(df: DataFrame, order: Sequence[str], folder: str, to: str = "seq", first: int = 0) -> DataFrame:
    """The frame with the place of each row in an order, from first on without gaps; ties in any order.

    Rows are dealt out by ranges of the order and written with their place in the range to a new
    folder, so that ranges are what they are from then on; the numbers of rows in the ranges before,
    one small row for each range, are added when that is read.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low = (1 << 33) - 1  # the lower bits of an increasing id count the rows of a partition
    ranged.withColumn(_PART, F.spark_partition_id()).withColumn(_AT, F.monotonically_increasing_id().bitwiseAND(low)).write.parquet(folder)
    kept = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, {_PART} int, {_AT} long").parquet(folder)
    sizes = sorted((r[_PART], r["n"]) for r in kept.groupBy(_PART).agg(F.count("*").alias("n")).collect())  # a row for each range
    before, at = [], first
    for part, n in sizes:
        before.append((part, at))
        at += n
    offsets = spark.createDataFrame(before, f"{_PART} int, _before long")
    return kept.join(F.broadcast(offsets), _PART).withColumn(to, F.col("_before") + F.col(_AT)).select(*df.columns, to)
