"""Inputs: tables by name, and the stand-in for timed, texted listings that the fixtures allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.operators.text import dictionary_masked, masked, tokens
from poolscope.plans.spec import SPEC, Spec


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 in UTC; exact for window arithmetic. A time without a zone is a time in UTC, whatever the session's zone."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        c = F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    return F.unix_micros(c.cast("timestamp"))


def loans(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: id, u0 (listed), u1 (funded), hours, sector, country, activity, amount, status, year, weekday, hour, and gender, interval, borrowers and
    term, which the fixtures lack and arithmetic on the key makes up.

    customer and nation are joined on their keys; the planner broadcasts them where their size allows.
    """
    orders, customer, nation = (table(spark, folder, x) for x in ("orders", "customer", "nation"))
    hours = F.lit(24) + F.floor("o_totalprice") % 800
    rows = orders.join(customer.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    part = lambda by, of: F.floor(F.col("o_orderkey") / by) % of
    rows = rows.select(
        F.col("o_orderkey").alias("id"),
        micros(orders, "o_orderdate").alias("u0"),
        hours.cast("long").alias("hours"),
        F.col("c_mktsegment").alias("sector"),
        F.col("n_name").alias("country"),
        F.col("o_orderpriority").alias("activity"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").alias("year"),
        F.weekday("o_orderdate").alias("weekday"),
        F.hour("o_orderdate").alias("hour"),
        F.when(part(7, 3) < 2, "female").otherwise("male").alias("gender"),
        F.element_at(F.array(*map(F.lit, ("monthly", "bullet", "irregular"))), (part(11, 3) + 1).cast("int")).alias("interval"),
        (part(3, 4) + 1).cast("long").alias("borrowers"),
        (part(1, 19) + 6).cast("long").alias("term"),
    )
    return rows.withColumn("u1", F.col("u0") + F.col("hours") * F.lit(3_600_000_000))


def names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of customers, nations and regions."""
    parts = [table(spark, folder, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("nation", "n_name"), ("region", "r_name"))]
    return parts[0].union(parts[1]).union(parts[2])


def with_texts(spark: SparkSession, folder: str, field: str = "use", mask: bool = False) -> tuple[DataFrame, DataFrame]:
    """loans() with text_id, and (text_id, tokens) of whole texts, which several listings may share: as the short `use`, the opening message of the
    conversation at id modulo their number, as the long `description` the document at id modulo theirs. mask: without names and places, dates, amounts
    and numbers before it is split. A listing whose text is not there is an error."""
    if field == "use":
        texts = table(spark, folder, "conversations").filter("turn = 0").select(F.col("conv_id").alias("text_id"), "text")
    elif field == "description":
        texts = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text")
    else:
        raise ValueError(field)
    many = texts.count()
    if mask:
        texts = dictionary_masked(texts, names(spark, folder), "text_id").withColumn("text", masked(F.col("text")))
    rows = loans(spark, folder).withColumn("_at", F.pmod("id", F.lit(many)))
    rows = rows.join(texts.select("text_id"), F.col("_at") == F.col("text_id"), "left")
    known = F.when(F.col("text_id").isNull(), F.raise_error(F.concat(F.lit(f"no {field} at "), F.col("_at").cast("string"))).cast("long")).otherwise(F.col("text_id"))
    return rows.withColumn("text_id", known).drop("_at"), texts.select("text_id", tokens(F.col("text")).alias("tokens"))


def texted(spark: SparkSession, folder: str, field: str = "use", mask: bool = False) -> DataFrame:
    """with_texts() in one table, each listing with its tokens."""
    rows, texts = with_texts(spark, folder, field, mask)
    return rows.join(texts, "text_id")


def is_train(spec: Spec = SPEC) -> Column:
    return F.col("year") <= spec.last_train_year
