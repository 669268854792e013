"""Keyed tables as snapshots: create, insert, upsert, update and delete by writing a new version.

A table is a folder of snapshots and a list of versions, one small file for each, that names the
snapshot. A change writes a snapshot under a name of its own and then adds the next version to the
list by a rename that never replaces a file. So readers see the old version or the new one, a failed
write leaves the old, nothing is ever overwritten, and of two writers that began at the same version
the second one fails. Paths go through Hadoop's file system, so any store that Spark reads will do;
the store's rename has to be atomic.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import FIRST_STORED, OVERWRITTEN


def upserted(current: DataFrame, batch: DataFrame, key: str = "serial_number", seq: str = "seq", overwrite: Sequence[str] = OVERWRITTEN, keep: Sequence[str] = FIRST_STORED, id_column: str | None = "id", top: DataFrame | None = None) -> DataFrame:
    """The table after the rows of a batch, in the order of seq, were each inserted or updated.

    New ids follow the largest in the table, or that in top, where current is only a part of it.

    Repeated keys of a batch act one after the other: what an upsert overwrites comes from the last,
    what it keeps from the first, or from the row already stored. Both come out of one aggregate
    that is reduced before the shuffle. A null key can't be stored and is left out; see rejected().
    """
    batch = batch.where(F.col(key).isNotNull())
    new = batch.groupBy(key).agg(F.max_by(F.struct(*overwrite), seq).alias("_new"), F.min_by(F.struct(*keep), seq).alias("_first"), F.min(seq).alias("_seq"))
    old = current.withColumn("_old", F.lit(True))
    both = old.join(new, key, "full")
    stored, sent = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c == id_column:
            return F.when(stored, F.col(c)).otherwise(F.col("_top") + 1 + F.col("_seq") - F.col("_low"))
        if c in overwrite:
            return F.when(sent, F.col("_new")[c]).otherwise(F.col(c))
        return F.when(stored, F.col(c)).otherwise(F.col("_first")[c]) if c in keep else F.col(c)

    if id_column is None:
        return both.select(*[value(c).alias(c) for c in current.columns])
    top = current.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top")) if top is None else top
    low = batch.agg(F.coalesce(F.min(seq), F.lit(0)).alias("_low"))
    one_row = top.join(low)  # one row each
    return both.join(F.broadcast(one_row)).select(*[value(c).cast(current.schema[c].dataType).alias(c) for c in current.columns])


def rejected(batch: DataFrame, key: str = "serial_number") -> DataFrame:
    """Rows of a batch that can't be stored, with the reason."""
    return batch.where(F.col(key).isNull()).withColumn("reason", F.lit(f"{key} is null"))


def inserted(current: DataFrame, rows: DataFrame, unique: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table with the rows whose unique columns are new, and the rows that clash with it or one another."""
    numbered = rows.withColumn("_n", F.monotonically_increasing_id())
    clash = F.lit(False)
    for i, c in enumerate(unique):
        taken = current.select(F.col(c).alias(f"_t{i}")).where(F.col(c).isNotNull()).distinct()
        firsts = numbered.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_u{i}")).agg(F.min("_n").alias(f"_m{i}"))
        numbered = numbered.join(taken, F.col(c) == F.col(f"_t{i}"), "left").join(firsts, F.col(c) == F.col(f"_u{i}"), "left")
        clash = clash | F.col(f"_t{i}").isNotNull() | (F.col("_n") > F.coalesce(F.col(f"_m{i}"), F.col("_n")))
    good = numbered.where(~clash).select(*rows.columns)
    return current.unionByName(good), numbered.where(clash).select(*rows.columns)


def updated(current: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return current.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(current.schema[c].dataType).alias(c) if c in values else F.col(c) for c in current.columns])


def deleted(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The table without the rows whose key is listed."""
    return current.join(ids.select(key).distinct(), key, "left_anti").select(*current.columns)


def hits(current: DataFrame, ids: DataFrame, key: str = "id") -> int:
    """How many rows a delete removes; ids that aren't stored don't count."""
    return current.join(ids.select(key).distinct(), key, "left_semi").count()


class Catalog:
    """Tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _listed(self, name: str) -> str:
        return f"{self.root}/{name}/_versions"

    def version(self, name: str) -> int:
        """The current version of a table; 0 before it is created."""
        fs, path = self._fs(self._listed(name))
        if not fs.exists(path):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def snapshot(self, name: str, version: int) -> str:
        """The folder of a version's rows."""
        fs, path = self._fs(f"{self._listed(name)}/{version}")
        stream = fs.open(path)
        try:
            return f"{self.root}/{name}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.snapshot(name, self.version(name)))

    def commit(self, name: str, df: DataFrame, partition_by: Sequence[str] = (), base: int | None = None) -> int:
        """Write a snapshot and list it as the version after base, the current one if base isn't given.

        OSError, and no change, if there is a version after base already.
        """
        base = self.version(name) if base is None else base
        folder = f"v={base + 1}-{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{self.root}/{name}/{folder}")
        self._list(name, base + 1, folder)
        return base + 1

    def _list(self, name: str, version: int, folder: str) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, fresh = self._fs(f"{self._listed(name)}/_new-{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(folder.encode()))
        out.close()
        _, path = self._fs(f"{self._listed(name)}/{version}")
        hadoop = jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(fs.makeQualified(path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(fresh), fs.makeQualified(path), gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as e:
            fs.delete(fresh, False)
            raise OSError(f"{name}: version {version} is already there; read again and repeat the change") from e

    def create(self, name: str, schema: T.StructType) -> None:
        """An empty table, unless it exists."""
        if self.version(name) == 0:
            self.commit(name, self.spark.createDataFrame([], schema))

    def _current(self, name: str) -> tuple[int, DataFrame]:
        at = self.version(name)
        return at, self.spark.read.parquet(self.snapshot(name, at))

    def upsert(self, name: str, batch: DataFrame, **how) -> int:
        at, current = self._current(name)
        return self.commit(name, upserted(current, batch, **how), base=at)

    def insert(self, name: str, rows: DataFrame, unique: Sequence[str] = ()) -> int:
        """Append rows; ValueError, and no change, if one of them clashes in a unique column."""
        at, current = self._current(name)
        new, clashing = inserted(current, rows, unique)
        if unique and not clashing.isEmpty():
            raise ValueError(f"{name}: already there: {', '.join(unique)}")
        return self.commit(name, new, base=at)

    def update(self, name: str, where: Column, **values: Column) -> int:
        at, current = self._current(name)
        return self.commit(name, updated(current, where, **values), base=at)

    def delete(self, name: str, ids: DataFrame, key: str = "id") -> int:
        """Remove rows and say how many there were."""
        at, current = self._current(name)
        n = hits(current, ids, key)
        self.commit(name, deleted(current, ids, key), base=at)
        return n
