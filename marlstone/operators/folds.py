"""Folds over a key's rows in order, where each step hangs on the one before: rows stream through a task, and only one state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse


def fold(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], begin: Callable[[], object], step: Callable[..., tuple[object, tuple]], added: str) -> DataFrame:
    """rows with the columns `added` (a schema in SQL): what step(state, *inputs) -> (state, values) gives for each row in the order of its key.

    One shuffle by key and a sort; a key's history is never in memory. A key is one task's, as each of its steps needs the last.
    """
    more = parse(added)
    kind = StructType([*rows.schema.fields, *(StructField(f.name, f.dataType) for f in more.fields)])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out: list[tuple] = []
            held = zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in inputs), strict=True), strict=True)
            for key, own in groupby(held, key=lambda r: r[0]):
                if last is None or key != last:
                    last, state = key, begin()
                for _, values in own:
                    state, made = step(state, *values)
                    out.append(made)
            columns = zip(*out, strict=True) if out else ([] for _ in more.fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [*batch.schema.names, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    types, names = [to_arrow_type(f.dataType) for f in more.fields], more.fieldNames()
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(over, kind)
