"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from pyspark.sql.types import StructType


def with_fields(schema: StructType, ddl: str) -> StructType:
    """``schema`` with more fields after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
