"""Helpers for Arrow-batched passes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def batches(rows: list[tuple], schema: StructType, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """``rows`` as record batches of ``schema``."""
    fields = to_arrow_schema(schema)
    for at in range(0, len(rows), most):
        columns = zip(*rows[at : at + most], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
