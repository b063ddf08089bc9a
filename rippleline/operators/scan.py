"""Table functions in Python: rows that a function makes of each row, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_ROWS = 10_000


def table_function(rows: DataFrame, columns: Sequence[str], f: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """f(values of some columns) gives the rows that stand for one row. A batch out holds what many rows in have given, as most give few."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for some in batches:
            for values in zip(*[c.to_pylist() for c in some.columns]):
                made += f(*values)
                if len(made) >= _ROWS:
                    yield batch(made)
                    made = []
        if made:
            yield batch(made)

    return rows.select(*columns).mapInArrow(run, schema)
