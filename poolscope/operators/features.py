"""Standardised features, their interactions, quantiles of the training rows, and support around scenario endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.operators.quantiles import quantiles
from poolscope.plans.spec import SPEC, Spec


def standardised(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """df with z_<column>, by mean and sample deviation of the training rows. A constant column has z null.

    The parameters are computed once, here: sums of doubles depend on the order in which tasks end, so that every pass over a lazy plan would have z-scores
    that differ in their last bits, and exact quantiles, which take several passes, would not find their values again.
    """
    own = df.filter(train).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns)).first()
    known = lambda x: F.lit(x).cast("double")
    z = [((F.col(f"`{c}`") - known(own[f"m_{c}"])) / F.nullif(known(own[f"s_{c}"]), F.lit(0.0))).alias(f"z_{c}") for c in columns]
    return df.select("*", *z)


def interaction(a: str, b: str) -> Column:
    return F.col(a) * F.col(b)


def scenario_quantiles(df: DataFrame, columns: list[str], train: Column, spec: Spec = SPEC) -> DataFrame:
    """dimension, low, high: quartiles of the training rows, exact."""
    found = quantiles(df.filter(train), {c: [spec.low, spec.high] for c in columns})
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in columns], "dimension string, low double, high double")


def support(df: DataFrame, pairs: dict[str, tuple[str, str]], train: Column, spec: Spec = SPEC) -> DataFrame:
    """channel, endpoint, n: training rows within spec.support interquartile ranges of the low and of the high point, on both dimensions of each channel."""
    rows = df.filter(train)
    q = quantiles(rows, {c: [spec.low, spec.high] for pair in pairs.values() for c in pair})
    near = lambda c, k: F.abs(F.col(c) - F.lit(q[c][k])) <= spec.support * (F.lit(q[c][1]) - F.lit(q[c][0]))
    cells = {(channel, name): F.count_if(near(x, k) & near(y, k)) for channel, (x, y) in pairs.items() for k, name in enumerate(("low", "high"))}
    one = rows.agg(*(n.alias(f"n{i}") for i, n in enumerate(cells.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(channel).alias("channel"), F.lit(name).alias("endpoint"), F.col(f"n{i}").alias("n")) for i, (channel, name) in enumerate(cells)))).alias("x")).select("x.*")
