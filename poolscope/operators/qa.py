"""Deterministic gates: a table of what must hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gates(checks: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """gate, passed, offending: each gate is a condition for the rows of a table that offend; it passes if none does. All gates of a table take one
    aggregation, and a condition that is null does not offend."""
    parts = []
    for df, own in checks:
        one = df.agg(*(F.count_if(c).alias(f"g{k}") for k, c in enumerate(own.values())))
        rows = [F.struct(F.lit(name).alias("gate"), (F.col(f"g{k}") == 0).alias("passed"), F.col(f"g{k}").alias("offending")) for k, name in enumerate(own)]
        parts.append(one.select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)
