"""Joins of a large table to a table that is unique on the join key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join facts to a lookup that has at most one row per key.

    A plain join: adaptive execution broadcasts a lookup that turns out small in bytes, and splits the partition of a
    key that holds many facts by rows, equal ones too. No job runs while the plan is built.
    """
    return facts.join(lookup, list(on), how)
