"""What answers have in common: filters by predicate, names, texts, the single element."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F


def filter_rows(df: DataFrame, predicate: Column | Callable[[Row], bool]) -> DataFrame:
    """Rows that satisfy a Column, or a function of a Row; a Column stays within Catalyst and is pushed down."""
    if isinstance(predicate, Column):
        return df.where(predicate)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = Row(*names)
            keep = [bool(predicate(row(*(r[n] for n in names)))) for r in b.to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def names(df: DataFrame, column: str = "class_name") -> DataFrame:
    """Distinct names in order."""
    return df.select(column).distinct().orderBy(column)


def as_strings(df: DataFrame, *columns: str) -> DataFrame:
    """(text) the columns of each row joined by blanks; nulls are left out."""
    return df.select(F.concat_ws(" ", *columns).alias("text"))


def only(df: DataFrame) -> Row | None:
    """The one row of an answer, None of an empty one; more than one is an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0] if rows else None
