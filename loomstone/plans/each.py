"""A plain function over rows, in the tasks: how queries reach rules that are Python."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def each(df: DataFrame, rule: Callable[[dict], dict], schema: str) -> DataFrame:
    """rule (row as a dict -> row as a dict) of each row, batch by batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([rule(r) for r in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(run, fields)
