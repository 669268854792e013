"""Keyed tables in buckets: a change writes the buckets that it touches and refers to all others again.

A version of such a table is a list: for each bucket of the key's hash, the folders that hold its
rows. An upsert, update or delete reads and rewrites the buckets of the rows it changes; an insert
adds a folder to those it reaches. Versions are added as for any table of a catalog, so a reader sees
the old one or the new one, a failed write leaves the old, and of two writers one fails.

Rows without a key are one bucket with those whose hash falls there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import dml

BUCKETS = 256
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Listing:
    """A version: the schema, the key, how many buckets, and the folders of each that has rows."""

    schema: T.StructType
    key: str
    buckets: int
    folders: dict[int, tuple[str, ...]]

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "key": self.key, "buckets": self.buckets, "folders": {str(b): list(f) for b, f in sorted(self.folders.items())}})

    @classmethod
    def of(cls, text: str) -> Listing:
        got = json.loads(text)
        return cls(T.StructType.fromJson(got["schema"]), got["key"], got["buckets"], {int(b): tuple(f) for b, f in got["folders"].items()})

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")


class Table:
    """A table in buckets under a catalog's folder."""

    def __init__(self, catalog: dml.Catalog, name: str):
        self.catalog, self.name, self.spark = catalog, name, catalog.spark

    def create(self, schema: T.StructType, key: str, buckets: int = BUCKETS) -> None:
        """An empty table, unless it exists."""
        if self.catalog.version(self.name) == 0:
            self.catalog._list(self.name, 1, Listing(schema, key, buckets, {}).text())

    def current(self) -> tuple[int, Listing]:
        at = self.catalog.version(self.name)
        if at == 0:
            raise ValueError(f"{self.name}: no such table")
        return at, Listing.of(self.catalog.snapshot(self.name, at).removeprefix(f"{self.catalog.root}/{self.name}/"))

    def read(self) -> DataFrame:
        return self._rows(self.current()[1])

    def _rows(self, listing: Listing, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of some buckets, or all."""
        wanted = listing.folders if buckets is None else set(buckets) & set(listing.folders)
        paths = [f"{self.catalog.root}/{self.name}/{f}" for b in sorted(wanted) for f in listing.folders[b]]
        return self.spark.read.schema(listing.schema).parquet(*paths) if paths else self.spark.createDataFrame([], listing.schema)

    def _touched(self, rows: DataFrame, listing: Listing) -> list[int]:
        return sorted(r[0] for r in rows.select(listing.bucket().alias("b")).distinct().collect())  # at most as many as buckets

    def _write(self, at: int, listing: Listing, rows: DataFrame, touched: Sequence[int], add: bool = False) -> int:
        """A version whose touched buckets hold the rows, after those that they hold already if they are added."""
        folder = f"v={at + 1}-{uuid.uuid4().hex}"
        rows.select(*listing.schema.names).withColumn(_BUCKET, listing.bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.catalog.root}/{self.name}/{folder}")
        folders = dict(listing.folders)
        for b in touched:
            own = f"{folder}/{_BUCKET}={b}"
            fs, path = self.catalog._fs(f"{self.catalog.root}/{self.name}/{own}")
            new = (*(folders.pop(b, ()) if add else ()), *([own] if fs.exists(path) else ()))
            folders = {**{k: v for k, v in folders.items() if k != b}, **({b: new} if new else {})}
        self.catalog._list(self.name, at + 1, replace(listing, folders=folders).text())
        return at + 1

    def upsert(self, batch: DataFrame, id_column: str | None = "id", **how) -> int:
        """Insert or update each row of a batch, in the order of seq; see dml.upserted."""
        at, listing = self.current()
        sent = batch.where(F.col(listing.key).isNotNull())
        touched = self._touched(sent, listing)
        top = None if id_column is None else self._rows(listing).agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
        rows = dml.upserted(self._rows(listing, touched), sent, key=listing.key, id_column=id_column, top=top, **how)
        return self._write(at, listing, rows, touched)

    def insert(self, rows: DataFrame) -> int:
        """Append rows."""
        at, listing = self.current()
        return self._write(at, listing, rows, self._touched(rows, listing), add=True)

    def update(self, where: Column, **values: Column) -> int:
        """Set columns of the rows that fulfil a condition; the key stays."""
        at, listing = self.current()
        if listing.key in values:
            raise ValueError(f"{self.name}: {listing.key} is the key")
        touched = self._touched(self._rows(listing).where(where), listing)
        return self._write(at, listing, dml.updated(self._rows(listing, touched), where, **values), touched)

    def delete(self, ids: DataFrame, key: str = "id") -> int:
        """Remove rows by any column and say how many there were."""
        at, listing = self.current()
        gone = self._rows(listing).join(ids.select(key).distinct(), key, "left_semi")
        found = {r["b"]: r["n"] for r in gone.groupBy(listing.bucket().alias("b")).agg(F.count("*").alias("n")).collect()}  # at most as many as buckets
        self._write(at, listing, dml.deleted(self._rows(listing, found), ids, key), sorted(found))
        return sum(found.values())
