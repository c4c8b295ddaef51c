"""A training corpus from `documents`: language, lines, near duplicates, benchmark passages, mix.

Every stage takes any table with doc_id, text, lang, source and n_chars. Null and empty texts go with the first stage, since no language can be told.
doc_id null: such rows stay, as documents that nothing can be compared with. Rows that repeat a doc_id are one document's: they stay or go together as near
duplicates, and are mixed as one. Other columns pass through, whatever their names, but for copy, shard and position, which the last stage sets.
An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.llm.decontam import decontaminate
from poolscope.llm.langid import identify, learnable, train
from poolscope.llm.linededup import dedup_lines
from poolscope.llm.mixing import mix, mixed_rows
from poolscope.llm.neardup import near_duplicates
from poolscope.llm.scratch import Scratch, collect


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with columns of these names, which an operator adds, under others."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in names if c in docs.columns})


def _back(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(f"_own_{c}").alias(c) if f"_own_{c}" in docs.columns else F.col(c) for c in columns))


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of which a language can be told; null texts and those without a letter go. lang keeps what it says, and where it is null is what was predicted.

    Where no language could be learned, since no row that may be learned from has one, every text with a letter stays, and lang as it is.
    """
    model = train(learnable(docs))
    if not model["langs"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = identify(_aside(docs, "lang_pred", "score"), model).filter(F.col("lang_pred") != "und")
    return _back(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many documents share; n_chars is that of the new text."""
    kept = dedup_lines(_aside(docs, "n_lines", "n_dropped")).withColumn("n_chars", F.char_length("text").cast("long"))
    return _back(kept, docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix draws them, with copy, shard and position in the shard."""
    own = mix(docs)
    return mixed_rows(docs, own.draws, own.shards)


STAGES = [
    ("language_id", with_language),
    ("line_dedup", without_shared_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Language models and random draws are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's output is written before the next begins; then what its operators left and its input's copy are deleted."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with collect():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
