"""Filters and listings over the catalog: optional predicates folded into one condition."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

NAMED = ("trademark_name", "applicant_name", "description")


def words_match(words: str, columns: Iterable[str] = NAMED, serial: str | None = "serial_number", normalize_columns: bool = False) -> Column:
    """Whether any column holds the words, case aside; LIKE wildcards in the words stay wildcards.

    White space is dropped from the words and from the serial, and from the other columns only if
    asked for; so words with a space in them can miss a column that has one.
    """
    pattern = f"%{''.join(words.split())}%"
    own = [X.without_spaces(F.col(c)) if normalize_columns else F.col(c) for c in columns]
    if serial:
        own.append(X.without_spaces(F.col(serial)))
    return reduce(lambda a, b: a | b, [c.ilike(pattern) for c in own])


def class_matches(wanted: str, column: str = "class_indices", exact: bool = False) -> Column:
    """Whether the class list holds the wanted class, as a substring or exactly."""
    if exact:
        return F.array_contains(X.class_numbers(F.col(column)), int(wanted))
    return F.col(column).ilike(f"%{wanted}%")


def folded(*conditions: Column | None) -> Column:
    """All of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def with_ids(df: DataFrame, ids: Iterable | DataFrame | None, key: str = "id", most: int = 1000) -> DataFrame:
    """Rows whose key is listed: None is no filter, an empty list no rows; long lists and frames join."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    ids = list(ids)
    if len(ids) <= most:
        return df.where(F.col(key).isin(ids)) if ids else df.where(F.lit(False))
    return df.join(df.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` {df.schema[key].dataType.simpleString()}"), key, "left_semi")


def search(marks: DataFrame, words: str | None = None, class_filter: str | None = None, ids=None, batch: str | None = None, year: str | None = None, exact_class: bool = False, normalize_columns: bool = False) -> DataFrame:
    """Marks that fulfil all given conditions, newest first. Batch and year are filtered before anything is projected away."""
    condition = folded(
        words_match(words, normalize_columns=normalize_columns) if words and words.strip() else None,
        class_matches(class_filter, exact=exact_class) if class_filter else None,
        F.col("batch_number") == batch if batch else None,
        F.col("batch_year") == year if year else None,
    )
    return with_ids(marks.where(condition), ids).orderBy(F.desc("id"))


def search_clients(clients: DataFrame, words: str | None = None) -> DataFrame:
    """Client records whose applicant or description holds the words, latest upload first, undated ones before all."""
    found = clients if not words else clients.where(F.col("applicant_name").ilike(f"%{words}%") | F.col("description").ilike(f"%{words}%"))
    return found.orderBy(F.desc_nulls_first("upload_date"), F.desc("id"))


def listed(marks: DataFrame, *columns: str) -> DataFrame:
    """A narrow newest-first listing with a flag for a stored logo instead of the logo."""
    flag = F.col("has_logo") if "has_logo" in marks.columns else F.col("logo_data").isNotNull()
    return marks.select("id", *columns, flag.alias("has_logo")).orderBy(F.desc("id"))


def blob(df: DataFrame, key, column: str, id_column: str = "id") -> DataFrame:
    """One stored blob by id."""
    return df.where(F.col(id_column) == key).select(column)
