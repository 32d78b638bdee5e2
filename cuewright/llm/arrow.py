"""Column-wise Python kernels over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_column(df: DataFrame, column: str, fields: list[T.StructField], fn: Callable[[list], list[list]], keep: list[str] | None = None, prepare: Callable | None = None) -> DataFrame:
    """Appends columns that fn makes of the values of one column, a batch at a time; other columns pass as they are.

    fn gets the list of values (and what prepare() made once per task, if given) and returns one list per new field.
    """
    keep = [c for c in df.columns if c != column] if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(T.StructType(fields))]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = prepare() if prepare else None
        for b in batches:
            values = b.column(column).to_pylist()
            made = fn(values, state) if prepare else fn(values)
            arrays = [b.column(c) for c in keep] + [pa.array(x, t) for x, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.select(*keep, *([column] if column not in keep else [])).mapInArrow(run, schema)
