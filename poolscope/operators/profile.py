"""Profiling, filters, outcomes, splits and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.operators.quantiles import quantiles as selected
from poolscope.plans.spec import DAY, SPEC, Spec
from poolscope.sources.tables import is_train


def null_profile(df: DataFrame) -> DataFrame:
    """column, null_rate: one pass, then one row per column."""
    rates = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns))
    return rates.unpivot([], df.columns, "column", "null_rate")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


def quantiles(df: DataFrame, column: str, at: list[float], names: list[str]) -> DataFrame:
    """Exact interpolated quantiles as one row."""
    return df.sparkSession.createDataFrame([tuple(selected(df, {column: at})[column])], ", ".join(f"{n} double" for n in names))


def lag_gap(loans: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """Days after which nearly all training listings are complete: the 95th percentile of their duration, rounded up."""
    p95 = quantiles(loans.filter(is_train(spec)), "hours", [0.95], ["p95"])
    return p95.select(F.round("p95", 6).alias("p95_hours"), F.ceil(F.col("p95") / 24).cast("long").alias("gap_days"))


def non_negative(begin: str, end: str) -> Column:
    return F.col(end) >= F.col(begin)


def crosstab(df: DataFrame, row: str, flag: Column, yes: str, no: str) -> DataFrame:
    return df.groupBy(row).agg(F.count_if(flag).alias(yes), F.count_if(~flag).alias(no))


def log_hours(c: str = "hours") -> Column:
    return F.log1p(F.col(c).cast("double"))


def fast(spec: Spec = SPEC, c: str = "hours") -> Column:
    return (F.col(c) <= spec.fast_hours).cast("int")


def followed(hours: float, last: str = "last") -> Column:
    """Whether a row was listed at least so many hours before the last listing, whose time is in column `last`."""
    return F.col("u0") <= F.col(last) - F.lit(int(hours * 3_600_000_000))


def with_last(df: DataFrame, **only: Column) -> DataFrame:
    """df with the time of its last listing, and by name of the last one that a condition holds for: one row of them, joined to all."""
    one = df.agg(F.max("u0").alias("last"), *(F.max(F.when(c, F.col("u0"))).alias(name) for name, c in only.items()))
    return df.crossJoin(F.broadcast(one))


def sample_flow(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """step, stage, n: how many rows each condition leaves, from one aggregation."""
    one = df.agg(*(F.count_if(c).alias(f"s{k}") for k, (_, c) in enumerate(stages)))
    rows = [F.struct(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.col(f"s{k}").alias("n")) for k, (name, _) in enumerate(stages)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, sd, min, max of numeric columns."""
    one = df.agg(*(f(F.col(c)).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), *(F.col(f"{k}_{c}").cast("double").alias(k) for k in ("mean", "sd", "min", "max"))) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def calendar(ts: Column) -> list[Column]:
    """Weekday (Monday 0), hour, Monday of the week, and year, in the session's time zone."""
    return [F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour"), F.to_date(F.date_trunc("week", ts)).alias("week"), F.year(ts).alias("year")]


def by_year(loans: DataFrame) -> DataFrame:
    return loans.groupBy("year").agg(F.count("*").alias("n"), F.round(F.percentile("hours", F.lit(0.5)), 6).alias("median_hours"))


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k largest groups; ties by name. Planned as a bounded top-k, not a sort of all groups."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def large_groups(df: DataFrame, key: str, least: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def week_of(c: str = "u0") -> Column:
    """Number of the week of a time in microseconds; weeks begin on Thursday, as 1970 did."""
    return F.floor(F.col(c) / (7 * DAY)).cast("long")
