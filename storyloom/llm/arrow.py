"""Helpers for Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from storyloom.functions.batches import whole_groups

__all__ = ["rows_of", "whole_groups"]


def rows_of(column: pa.Array, size: int = 256) -> Iterator:
    """The values of a column as Python objects, a few at a time, so that long texts are not all held twice."""
    for i in range(0, len(column), size):
        yield from column.slice(i, size).to_pylist()
