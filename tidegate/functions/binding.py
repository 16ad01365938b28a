"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with the columns added or replaced, as outputs of a one-row generator.

    A projection's columns are copied into every filter and projection above them, so that
    rules over rules grow without end. What a generator puts out is a value: plans stay as
    long as they are written, and each value is computed once for a row.
    """
    kept = [df[c] for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
