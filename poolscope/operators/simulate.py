"""Synthetic listings with planted effects, to see what an estimator recovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.plans.spec import DAY

#: Planted effects on log hours of saturation, similarity, their product, lagged volume, lagged similarity and theirs.
TRUTH = {"z_c": 0.138, "z_h": 0.170, "z_ch": 0.10, "z_v": 0.02, "z_g": 0.03, "z_vg": 0.04}
PARTNERS, SECTORS, UNFUNDED = 72, 6, 0.089


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRUTH.items()), "term string, truth double")


def draw(seed: int, k: int, *columns: str) -> Column:
    """A number from 0 to 1 by the MD5 of seed, k and columns: the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), *(F.col(c).cast("string") for c in columns))), 1, 13), 16, 10).cast("double") / 2.0**52


def listings(spark: SparkSession, n: int = 20_000, days: int = 730, seed: int = 1) -> DataFrame:
    """id, u0, sector, country, activity, partner, template, shock, use, speed, unfunded_draw: listings before their outcome.

    A partner's template share and its speed are linked; the share of templates rises over the years; a shock of sector and week drives both how many
    listings a cell has and how long they take. All draws are hashes of ids and the seed, so any partitioning gives the same rows.
    """
    u = lambda k, *c: draw(seed, k, *(c or ("id",)))
    rows = spark.range(n).select("id")
    rows = rows.select("id", F.floor(u(1) * PARTNERS).cast("int").alias("partner"), F.floor(u(2) * SECTORS).cast("int").alias("s"), u(3).alias("when"))
    rows = rows.withColumn("u0", F.floor(F.col("when") * days * DAY).cast("long")).withColumn("week", F.floor(F.col("u0") / (7 * DAY)).cast("int"))
    shock = F.sqrt(-2 * F.log(u(4, "s", "week") + 1e-12)) * F.cos(2 * 3.141592653589793 * u(5, "s", "week"))
    # busy cells draw listings from the calm weeks around them
    rows = rows.withColumn("shock", shock)
    moved = F.when((F.col("shock") < 0) & (u(6) < 0.5), F.col("u0") + 7 * DAY).otherwise(F.col("u0"))
    rows = rows.withColumn("u0", moved).withColumn("week", F.floor(F.col("u0") / (7 * DAY)).cast("int")).withColumn("shock", shock)
    share = u(7, "partner") * (0.4 + 0.6 * F.col("when"))
    rows = rows.withColumn("template", (u(8) < share).cast("int")).withColumn("speed", u(7, "partner") - 0.5)
    word = lambda k, size, *c: F.concat(F.lit(f"w{k}x"), F.floor(u(k, *(c or ("id",))) * size).cast("int").cast("string"))
    free = [word(10 + i, 40) for i in range(8)]
    fixed = [word(20 + i, 3, "partner") for i in range(8)]
    rows = rows.withColumn("tokens", F.when(F.col("template") == 1, F.array(*fixed)).otherwise(F.array(*free)))
    return rows.select("id", "u0", "week", F.concat(F.lit("sector"), F.col("s").cast("string")).alias("sector"), F.concat(F.lit("c"), F.floor(u(30) * 20).cast("string")).alias("country"), F.concat(F.lit("a"), F.floor(u(31) * 10).cast("string")).alias("activity"), "partner", "template", "shock", "tokens", "speed", (u(32) < UNFUNDED).alias("unfunded"), (F.sqrt(-2 * F.log(u(33) + 1e-12)) * F.cos(2 * 3.141592653589793 * u(34))).alias("noise"))


def outcomes(rows: DataFrame, features: list[str], loading: float = 0.6) -> DataFrame:
    """log_hours from the planted effects of standardised features, the cell's shock, the partner's speed and noise."""
    planted = sum((F.lit(TRUTH[c]) * F.coalesce(F.col(c), F.lit(0.0)) for c in features), F.lit(0.0))
    return rows.withColumn("log_hours", 4.5 + planted + loading * F.col("shock") - 0.3 * F.col("speed") + 0.5 * F.col("noise"))


def template_share(rows: DataFrame, period_days: int = 365) -> DataFrame:
    """period, templates, unfunded: shares by period."""
    return rows.groupBy(F.floor(F.col("u0") / (period_days * DAY)).cast("long").alias("period")).agg(F.avg("template").alias("templates"), F.avg(F.col("unfunded").cast("double")).alias("unfunded"))
