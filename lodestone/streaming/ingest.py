"""Records as they arrive: every micro-batch is upserted into a table of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone.operators.dml import Catalog


def upsert_stream(spark: SparkSession, source: str, schema: StructType, catalog: Catalog, table: str, checkpoint: str, available_now: bool = True, **how) -> StreamingQuery:
    """Upsert the Parquet files that arrive in a folder; the rows of a batch are applied in the order of seq.

    What each micro-batch holds is observed under the table's name, for a listener (see progress).
    An upsert of the same rows twice leaves the same table, so a batch replayed after a failure does no harm.
    """

    def apply(batch: DataFrame, _: int) -> None:
        batch.persist()  # read more than once, but observed once
        try:
            if not batch.isEmpty():
                catalog.upsert(table, batch, **how)
        finally:
            batch.unpersist()

    rows = spark.readStream.schema(schema).parquet(source).observe(table, F.count(F.lit(1)).alias("current"))
    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
