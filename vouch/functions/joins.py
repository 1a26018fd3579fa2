"""Sides of joins that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def large(side: DataFrame) -> DataFrame:
    """A side that a join must not broadcast.

    Spark guesses a side's size from the compressed files under it, which lines and documents outgrow by far, and a
    broadcast passes through the driver. Both sides are sorted and merged.
    """
    return side.hint("merge")
