"""Running byte analysers over binary columns, and what all of them share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

_KINDS = {"str": T.StringType(), "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType()}


def struct_of(cls: type) -> T.StructType:
    """A dataclass of plain fields as a Spark struct."""
    return T.StructType([T.StructField(f.name, _KINDS[f.type]) for f in fields(cls)])


def analyze_binary(items: DataFrame, content: str, name: str, analyse: Callable[[bytes], dict], result: T.StructType) -> DataFrame:
    """items with one more column: analyse(content) as a struct. It has a field error; bytes that can't be read never fail the job.

    A map over Arrow batches: nothing is shuffled, and other columns pass through untouched; a column of that name is replaced.
    """
    base = items.drop(name)
    schema = T.StructType([*base.schema.fields, T.StructField(name, result)])
    kind = to_arrow_type(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(content):
                data = value.as_py()
                try:
                    rows.append(None if data is None else {**analyse(bytes(data)), "error": None})
                except Exception as problem:  # one damaged file must not stop the others
                    rows.append({"error": f"{type(problem).__name__}: {problem}"})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=schema.names)

    return base.mapInArrow(run, schema)


def explode_binary(items: DataFrame, content: str, parse: Callable[[bytes], list[dict]], element: T.StructType, keep: list[str]) -> DataFrame:
    """One row per element that parse(content) finds, with the columns to keep. Damaged bytes give no rows."""
    schema = T.StructType([*[items.schema[c] for c in keep], *element.fields])
    kind = to_arrow_type(element)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners = [], []
            for i, value in enumerate(batch.column(content)):
                data = value.as_py()
                try:
                    found = parse(bytes(data)) if data is not None else []
                except Exception:  # one damaged file must not stop the others
                    found = []
                rows += found
                owners += [i] * len(found)
            parts = pa.array(rows, kind)
            taken = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keep), *(parts.field(i) for i in range(len(element)))], names=schema.names)

    return items.select(*[F.col(c) for c in dict.fromkeys([*keep, content])]).mapInArrow(run, schema)
