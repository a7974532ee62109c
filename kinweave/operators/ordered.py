"""Row numbers and running sums within keys, of which any may hold most of the rows.

A window by key would sort a hot key in one task. Here rows are sorted in ranges of (key, order), so that
a hot key takes as many tasks as its rows need. Each task runs through its range once, counts within the
keys' runs, and the range is written. Only a range's first run can have begun in earlier ranges, so one row
per range, its first and last run, gives every range its start: rows are shuffled once, by the sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, MapType, StructType

from kinweave.sources.scratch import saved


def _changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """True where a value differs from the row before; nulls equal each other."""
    shifted = pa.concat_arrays([pa.array([before.as_py() if before is not None else None], column.type), column.slice(0, len(column) - 1)])
    differ = pc.fill_null(pc.not_equal(column, shifted), True)
    out = pc.and_not(differ, pc.and_(pc.is_null(column), pc.is_null(shifted))).to_numpy(zero_copy_only=False).copy()
    if before is None:
        out[0] = True
    return out


def _running(keys: list[str], values: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the sums of each value over their run's rows before and up to them, their range, their
        place in it, and whether they belong to its first run."""
        p, place, last, first = TaskContext.get().partitionId(), 0, None, True
        carried = {v: 0 for v in values}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            for i, k in enumerate(keys):
                begins |= _changes(batch.column(k), last[i] if last else None)
            begins[0] |= last is None
            in_first = np.cumsum(begins) - (last is None) == 0 if first else np.zeros(n, bool)
            starts = np.flatnonzero(begins)
            run_of = np.cumsum(begins) - 1  # -1: the run that the batch before left open
            sums = []
            for v in values:
                x = pc.fill_null(batch.column(v), 0).to_numpy(zero_copy_only=False)
                upto = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
                base = np.append(upto[starts], -carried[v])  # the last one serves index -1
                before = upto[:n] - base[run_of]
                sums.append(pa.array(before))
                carried[v] = before[-1] + x[-1]
            first, last = bool(in_first[-1]), [batch.column(k)[n - 1] for k in keys]
            own = [pa.array(np.full(n, p, np.int32)), pa.array(np.arange(place, place + n)), pa.array(in_first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums, *own], names=[*batch.schema.names, *[f"_b{v}" for v in values], "_p", "_at", "_first"])
            place += n

    return run


def _starts(ranged: DataFrame, keys: list[str], values: list[str]) -> list[tuple]:
    """(range, the sums of its first run in earlier ranges), where there are any. One row per range reaches the
    driver."""
    row = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[(F.col(f"_b{v}") + F.coalesce(v, F.lit(0))).alias(f"s{i}") for i, v in enumerate(values)], "_first")
    ends = ranged.groupBy("_p").agg(F.min_by(row, "_at").alias("head"), F.max_by(row, "_at").alias("tail")).orderBy("_p")
    out, key, carried = [], None, []
    for r in ends.toLocalIterator():
        head, tail = ([x[f"k{i}"] for i in range(len(keys))] for x in (r.head, r.tail))
        sums = [r.tail[f"s{i}"] for i in range(len(values))]
        goes_on = key is not None and head == key
        if goes_on:
            out.append((r._p, *carried))
        carried = [a + b for a, b in zip(carried, sums, strict=True)] if goes_on and r.tail._first else sums
        key = tail
    return out


def sums_before(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with a column for each of `values`: its sum over the key's rows before this one, 0 for the first
    (long for whole numbers, else double; null counts as 0). With an empty `by`, over the whole table. Null
    keys are keys of their own. Rows that tie in `order` take their places in any order."""
    nested = any(isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) for c in by)
    keys = ["_key"] if nested else list(by)
    rows = df.withColumn("_key", F.to_json(F.struct(*by))) if nested else df
    kinds = {k: "long" if isinstance(rows.select(v).schema[0].dataType, IntegralType) else "double" for k, v in values.items()}
    rows = rows.withColumns({f"_v_{k}": v.cast(kinds[k]) for k, v in values.items()})
    names, sort = [f"_v_{k}" for k in values], [*map(F.col, by), *order]
    schema = StructType(list(rows.schema.fields))
    for k in values:
        schema = schema.add(f"_b_v_{k}", kinds[k])
    schema = schema.add("_p", "integer").add("_at", "long").add("_first", "boolean")
    ranged = saved(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_running(keys, names), schema))
    starts = df.sparkSession.createDataFrame(_starts(ranged, keys, names), ", ".join(["_p int", *[f"`_s_{k}` {kinds[k]}" for k in values]]))
    found = ranged.join(F.broadcast(starts), "_p", "left")  # a row per range at most
    found = found.withColumns({k: F.col(f"_b_v_{k}") + F.when(F.col("_first"), F.coalesce(f"_s_{k}", F.lit(0))).otherwise(0) for k in values})
    return found.select(*[c for c in df.columns if c not in values], *values)


def number_within(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's number from 0 within its key, in the given order; cases as in `sums_before`."""
    return sums_before(df, by, order, {name: F.lit(1).cast("long")})
