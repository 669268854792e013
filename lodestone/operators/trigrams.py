"""A trigram index for substring search: posting lists narrow a search to a few parts of the rows.

Rows are written in parts by a hash of what they hold. For each three letters in a row that stand
side by side in one of its searched columns, lower-cased, the row is posted. A task posts some
thousands of rows together: one posting (gram, field, rows) lists all of them that have the gram, so
that what is shuffled and sorted are far fewer postings than rows have grams. Grams are numbers, three
code points of 21 bits. Postings lie with those of their bucket, sorted by gram; those of a frequent
gram are dealt out over several files. A search looks up how frequent the grams of its words are,
reads the postings of the rarest ones, keeps the rows that have all of them in one field, and reads
only the parts that hold such rows. There the search's own condition decides, so an index never changes a result; a hash that two
rows share adds a candidate and loses none.

Words without three letters in a row, wildcards aside, can't be narrowed: they read every part, as
without an index. Words with a gram that no row has read none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.functions import text as X
from lodestone.operators import search as S
from lodestone.sources import readers

#: Letters of a gram, grams of a search that are looked up, tasks that share a bucket, and grams of rows that are posted together.
GRAM, RAREST, SALTS, TOGETHER = 3, 4, 8, 1 << 21
#: Bits of a code point, and how many numbers there are for rows.
POINT, ROWS = 21, 1 << 31
_POSTED, _FREQUENCY = "field int, gram long, n int, rows array<int>", "gram long, n long, bucket int"
_POSTINGS = f"{_POSTED}, bucket int"


def grams(text: str) -> np.ndarray:
    """The distinct grams of a lower-cased text, sorted."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    n = max(0, len(points) - GRAM + 1)
    return np.unique(sum((points[i : i + n] << (POINT * i) for i in range(GRAM)), np.zeros(n, np.int64)))


def _together(field: int, rows: list[int], own: list[np.ndarray]) -> pa.RecordBatch:
    """A posting for each gram of some rows, sorted by gram."""
    every = np.concatenate(own)
    order = np.argsort(every, kind="stable")
    found, starts = np.unique(every[order], return_index=True)
    listed = np.repeat(np.array(rows, np.int32), [len(x) for x in own])[order]
    ends = np.append(starts[1:], len(every))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(every)).astype(np.int32)), pa.array(listed))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), field, np.int32)), pa.array(found), pa.array((ends - starts).astype(np.int32)), lists], names=["field", "gram", "n", "rows"])


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of (row, lower-cased text of each field)."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    sizes: dict[int, int] = {}
    for batch in batches:
        numbers = batch.column(0).to_pylist()
        for field in range(batch.num_columns - 1):
            rows, own = held.setdefault(field, ([], []))
            for row, text in zip(numbers, batch.column(field + 1).to_pylist(), strict=True):
                if text is not None and len(text) >= GRAM:
                    rows.append(row)
                    own.append(grams(text))
                    sizes[field] = sizes.get(field, 0) + len(own[-1])
                    if sizes[field] >= TOGETHER:
                        yield _together(field, rows, own)
                        rows, own = held[field] = [], []
                        sizes[field] = 0
    for field, (rows, own) in held.items():
        if rows:
            yield _together(field, rows, own)


def literal_runs(pattern: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards; a backslash makes the next character an ordinary one."""
    runs, own, escaped = [], "", False
    for c in pattern:
        if escaped or c not in "%_\\":
            own, escaped = own + c, False
        elif c == "\\":
            escaped = True
        else:
            runs, own = [*runs, own], ""
    return [r for r in [*runs, own] if r]


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """An index in a folder, over named columns and a serial number whose white space doesn't count."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    serial: str | None
    parts: int
    buckets: int
    schema: StructType

    @classmethod
    def build(cls, rows: DataFrame, path: str, columns: Sequence[str] = S.NAMED, serial: str | None = "serial_number", parts: int = 256, buckets: int = 64) -> Index:
        """Write an index of the rows to a new folder: rows in parts, postings in buckets. The columns part and row may not be among theirs."""
        readers.small_batches(rows.sparkSession)
        fields = [F.col(c) for c in columns] + ([X.without_spaces(F.col(serial))] if serial else [])
        own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t]), F.lit(ROWS)).cast("int")
        rows.withColumn("part", F.pmod(own, F.lit(parts)).cast("int")).repartition("part").write.partitionBy("part").parquet(f"{path}/rows")
        found = rows.select(own.alias("row"), *[F.lower(c.cast("string")).alias(f"field{i}") for i, c in enumerate(fields)]).mapInArrow(posted, _POSTED)
        dealt = found.withColumn("bucket", bucket(F.col("gram"), buckets)).repartition("bucket", F.pmod(F.element_at("rows", 1), F.lit(SALTS)))
        dealt.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
        spark = rows.sparkSession
        counted = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
        counted.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/frequency")
        return cls(spark, path, tuple(columns), serial, parts, buckets, StructType([*rows.schema, StructField("part", IntegerType())]))

    def rows(self) -> DataFrame:
        """All rows, with the part that each is in."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _runs(self, words: str) -> list[str]:
        """What stands between the wildcards of the words, lower-cased as a search does."""
        one = self.spark.sql("SELECT 1 AS one")  # constants over it are folded, so no job runs
        return literal_runs(one.select(F.lower(F.lit("".join(words.split())))).first()[0])

    def wanted(self, words: str) -> list[int] | None:
        """The rarest grams that a row with the words has; None if they have none, an empty list if no row has them all."""
        asked = {int(g) for r in self._runs(words) for g in grams(r)}  # a few for each word
        if not asked:
            return None
        there = self._of(self.spark.read.schema(_FREQUENCY).parquet(f"{self.path}/frequency"), asked)
        found = sorted((r["n"], r["gram"]) for r in there.collect())
        return [g for _, g in found[:RAREST]] if len(found) == len(asked) else []

    def _of(self, table: DataFrame, wanted: Iterable[int]) -> DataFrame:
        """The rows of some grams, from the files of their buckets."""
        return table.where(F.col("bucket").isin([bucket(F.lit(g).cast("long"), self.buckets) for g in wanted]) & F.col("gram").isin(sorted(wanted)))

    def candidates(self, wanted: Sequence[int]) -> DataFrame:
        """(row): hashes of rows that have all of the grams in one field."""
        postings = self._of(self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings"), wanted).select("field", "gram", F.explode("rows").alias("row"))
        at = F.array_position(F.array(*[F.lit(g).cast("long") for g in wanted]), F.col("gram")).cast("int") - 1
        met = postings.groupBy("field", "row").agg(F.bit_or(F.pow(F.lit(2), at).cast("long")).alias("has"))
        return met.where(F.col("has") == 2 ** len(wanted) - 1).select("row").distinct()

    def parts_with(self, words: str | None) -> list[int]:
        """The parts that a search for the words has to read."""
        if not words or not words.strip() or (wanted := self.wanted(words)) is None:
            return list(range(self.parts))
        if not wanted:
            return []
        found = self.candidates(wanted).select(F.pmod("row", F.lit(self.parts)).cast("int").alias("part")).distinct()
        return sorted(r["part"] for r in found.collect())  # at most one row for each part

    def narrowed(self, words: str | None) -> DataFrame:
        """The rows of those parts, a few of which the words are in."""
        return self.rows().where(F.col("part").isin(self.parts_with(words))).drop("part")

    def promising(self, words: str | None) -> DataFrame:
        """Those of the narrowed rows that hold all that stands between wildcards, in any order: a pattern of several
        runs is tried at each place of the first one in a text, which takes the square of its length where the rest isn't there."""
        rows, runs = self.narrowed(words), self._runs(words or "")
        if len(runs) < 2:
            return rows
        own = [F.col(c) for c in self.columns] + ([X.without_spaces(F.col(self.serial))] if self.serial else [])
        return rows.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(F.lower(c.cast("string")), F.lit(r)) for r in runs]) for c in own]))

    def matches(self, words: str) -> DataFrame:
        """The rows that hold the words in one of the indexed columns."""
        return self.promising(words).where(S.words_match(words, self.columns, self.serial))


def search(index: Index, words: str | None = None, class_filter: str | None = None, **how) -> DataFrame:
    """As the search without an index, over its rows."""
    rows = index.narrowed(words) if how.get("normalize_columns") else index.promising(words)
    return S.search(rows, words, class_filter, **how)
