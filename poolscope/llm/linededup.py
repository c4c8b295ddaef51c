"""Boilerplate lines: those that many documents share stay in one document only. Spark expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"


def _lowered(c: Column) -> Column:
    """A-Z as a-z and nothing else; lower() does just that where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of docs, all columns, with the lines dropped from the text, and n_lines (before) and n_dropped.

    A line's key is the line without white space at both ends and with A-Z in lower case. Keys of at least min_chars code points in at least min_docs
    documents lose all their lines except those of the largest doc_id that holds the key; other lines stay, joined by \\n.

    Lines are exploded and hashed (128 bits); documents are counted per hash after a partial aggregation, so a line of very many documents is spread.
    Only hashes over the threshold are written; what they drop is gathered by document as positions, and no line's text is shuffled but with its document.

    Text null or empty: one empty line. doc_id null: counts as no document, nothing is dropped from it. Rows that repeat a doc_id count as one document;
    each is returned with its own lines. An empty table gives no rows. Other columns pass through, but for ones named n_lines or n_dropped, which are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rest = F.struct(F.lit(0).alias("_"), *(docs[c] for c in columns if c != text_col)).alias("rest")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), rest)
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), F.split("text", "\n").alias("lines"), "rest")
    rows = docs.select("doc_id", "t", F.posexplode("lines").alias("position", "line"))
    rows = rows.filter(F.char_length("line") >= min_chars).select("doc_id", "t", "position", F.btrim("line", F.lit(SPACE)).alias("line"))
    rows = rows.filter(F.char_length("line") >= min_chars).select("doc_id", "t", "position", _lowered(F.col("line")).alias("key"))
    rows = rows.select("doc_id", "t", "position", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))
    common = rows.groupBy("h", "g").agg(F.count_distinct("doc_id").alias("many"), F.max("doc_id").alias("holder")).filter(F.col("many") >= min_docs)
    common = scratch.keep(common.select("h", "g", "holder"), "common")
    gone = rows.join(common, ["h", "g"]).filter("doc_id <> holder").groupBy("doc_id", "t").agg(F.collect_set("position").alias("gone"))
    out = docs.join(gone, ["doc_id", "t"], "left")
    n = F.size("lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda i: F.get("lines", i))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n")
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    own = [text.alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in columns]
    return out.select(*own, n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
