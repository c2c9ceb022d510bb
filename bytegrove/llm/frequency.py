"""Frequency of every distinct term: occurrences, distinct records, and marks for too rare and too common ones.

Terms and record identifiers are range-partitioned and sorted as pairs, then each partition is scanned in run lengths.
Ranges are over the whole (term, record, row) triple, so a term that holds a third of all rows spans many partitions and
equal triples still meet in one; the runs at partition borders are added up afterwards. A border may also fall inside one
(term, record), so the records at the ends of a partition are put out by name and counted as distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from bytegrove.scratch import Scratch

_RUNS = "kind string, term string, n bigint, n_records bigint"
_FIELDS = [("kind", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_records", pa.int64())]


def _changed(column: pa.Array, before) -> np.ndarray:
    """For each value whether it differs from the one before it; ``before`` is what came before the first."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        ne = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] = pc.or_(ne, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    out[0] = before is _START or column[0].as_py() != before
    return out


_START = object()


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted (kind, term, record, row): (kind, term, occurrences, records, edge) of the runs of a term.

    Rows equal in all four count once; a run is carried over from batch to batch. Null records count as no record. The
    first and the last record of all rows may go on in other partitions: they are left out of ``records`` and given as
    ``edge``, which is null elsewhere. The first one has a row of its own, with nothing else counted.
    """
    last = (_START,) * 4
    open_run: list | None = None
    inside = False  # whether the last (kind, term, record) is another than the first
    schema: pa.Schema | None = None

    def batch_of(runs: list, edge=None) -> pa.RecordBatch:
        columns = [*zip(*runs), (edge,) * len(runs)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        if not len(batch):
            continue
        kind, term, record, row = (batch.column(i) for i in range(4))
        new_term = _changed(kind, last[0]) | _changed(term, last[1])
        new_record = new_term | _changed(record, last[2])
        new_row = new_record | _changed(row, last[3])
        counted = new_record & pc.is_valid(record).to_numpy(zero_copy_only=False)
        if schema is None:
            schema = pa.schema([*_FIELDS, ("edge", record.type)])
            yield batch_of([(kind[0].as_py(), term[0].as_py(), 0, 0)], record[0].as_py())
            counted[0] = False
            inside = bool(new_record[1:].any())
        else:
            inside = inside or bool(new_record.any())
        starts = np.flatnonzero(new_term)
        edges = np.concatenate(([0], starts[starts > 0]))
        rows, records = np.add.reduceat(new_row.astype(np.int64), edges), np.add.reduceat(counted.astype(np.int64), edges)
        runs = [list(x) for x in zip(kind.take(pa.array(edges)).to_pylist(), term.take(pa.array(edges)).to_pylist(), rows.tolist(), records.tolist())]
        if open_run is not None:
            if new_term[0]:
                runs.insert(0, open_run)
            else:
                runs[0][2] += open_run[2]
                runs[0][3] += open_run[3]
        open_run = runs.pop()
        last = tuple(c[len(batch) - 1].as_py() for c in (kind, term, record, row))
        if runs:
            yield batch_of(runs)
    if open_run is not None:
        edge = last[2] if inside else None
        open_run[3] -= edge is not None
        yield batch_of([open_run], edge)


def term_frequencies(
    rows: DataFrame, kind: Column, term: Column, record: Column, row_key: Column, *, rare_below: int = 3, common_share: tuple[int, int] = (1, 10)
) -> DataFrame:
    """(kind, term, n, n_records, total_records, mark) for every distinct non-null term of each kind.

    ``row_key`` (a string) names a row within its record: rows equal in term, record and key count once. ``n_records`` is
    the number of distinct non-null records with the term, ``total_records`` that of the kind, rows without a term
    included. mark is ``rare`` below ``rare_below`` records, else ``common`` from ``common_share`` of the total on, else
    null. An empty table gives no rows; other columns are ignored.
    """
    # Sampling the ranges, sorting, and the totals each read the rows, so what the expressions make of them is written once.
    sc = Scratch(rows.sparkSession, "terms")
    given = rows.select(kind.alias("kind"), term.alias("term"), record.alias("record"), row_key.cast("string").alias("row_key"))
    given = sc.save(given, "given")
    totals = given.where("record is not null").select("kind", "record").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("total_records"))
    order = ["kind", "term", "record", "row_key"]
    schema = T.StructType.fromDDL(_RUNS).add("edge", given.schema["record"].dataType)
    runs = given.where("term is not null").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan_runs, schema)
    terms = runs.groupBy("kind", "term").agg(F.sum("n").alias("n"), (F.sum("n_records") + F.count_distinct("edge")).alias("n_records"))
    top, bottom = common_share
    mark = F.when(F.col("n_records") < rare_below, F.lit("rare")).when(F.col("n_records") * bottom >= F.col("total_records") * top, F.lit("common"))
    # One row per kind, and the kinds are named by the caller's expression.
    return terms.join(F.broadcast(totals), "kind", "left").withColumn("total_records", F.coalesce("total_records", F.lit(0))).withColumn("mark", mark)
