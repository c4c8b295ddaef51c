"""Definitions that are fixed before any result is computed."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

DAY = 86_400_000_000  # microseconds


@dataclass(frozen=True)
class Spec:
    """Open choices have the defaults named here; every operator takes a Spec."""

    last_train_year: int = 2000
    fast_hours: int = 72
    lag_from_days: int = 35
    lag_to_days: int = 65
    half_life_days: float = 7.0
    mirror_days: tuple = (14, 16)
    least_pool: tuple = (5, 20)
    phrase_words: int = 5
    phrase_share: float = 0.00053
    least_phrase: int = 4
    phrase_countries: int = 3
    hash_buckets: int = 1 << 17
    char_gram: int = 3
    low: float = 0.25
    high: float = 0.75
    support: float = 0.10
    top_countries: int = 15
    least_sector: int = 2000
    exclude_self: bool = True
    log_volume: bool = False

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in asdict(self).items()], "name string, value string")


SPEC = Spec()
