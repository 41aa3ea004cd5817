"""Plain Python functions over the rows of a DataFrame, in Arrow batches.

A row that a function cannot handle has its error in a column of its own, and stops no other row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are handled together, which bounds what a batch of results holds.
ROWS = 256


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            yield batch.slice(begin, ROWS)


def _ready(docs: DataFrame, key: str, inputs: dict[str, str | Column]) -> DataFrame:
    return docs.select(docs[key].alias("key"), *[(docs[c] if isinstance(c, str) else c).alias(f"in{i}") for i, c in enumerate(inputs.values())])


def each(docs: DataFrame, key: str, inputs: dict[str, str | Column], outputs: str, f: Callable[..., tuple]) -> DataFrame:
    """(key, *outputs, error) for every row: ``f`` takes the inputs by name and returns the outputs (a DDL string names them).

    A null key stays null; whether a null input is an error is for ``f`` to say. Repeated rows stay repeated, other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    arrow = to_arrow_schema(StructType.fromDDL(outputs))
    names, blank = list(inputs), (None,) * len(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows, errors = [], []
            for values in zip(*(part.column(i + 1).to_pylist() for i in range(len(names))), strict=True):
                try:
                    rows.append(f(**dict(zip(names, values, strict=True))))
                    errors.append(None)
                except Exception as e:  # a row never fails its task
                    rows.append(blank)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], field.type) for i, field in enumerate(arrow)), pa.array(errors, pa.string())], [key, *arrow.names, "error"])

    return _ready(docs, key, inputs).mapInArrow(run, f"`{key}` {kind}, {outputs}, error string")


def many(docs: DataFrame, key: str, inputs: dict[str, str | Column], outputs: str, f: Callable[..., Iterable[tuple]]) -> DataFrame:
    """(key, ord, *outputs): a child table. ``f`` returns the outputs of each child in order, none for a row without children."""
    kind = docs.schema[key].dataType.simpleString()
    arrow = to_arrow_schema(StructType.fromDDL(outputs))
    names = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            at, ords, rows = [], [], []
            for k, values in enumerate(zip(*(part.column(i + 1).to_pylist() for i in range(len(names))), strict=True)):
                for n, row in enumerate(f(**dict(zip(names, values, strict=True)))):
                    at.append(k)
                    ords.append(n)
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(ords, pa.int64()), *(pa.array([r[i] for r in rows], field.type) for i, field in enumerate(arrow))], [key, "ord", *arrow.names])

    return _ready(docs, key, inputs).mapInArrow(run, f"`{key}` {kind}, ord long, {outputs}")
