"""Spelling variants: words at one edit from each other, found by the halves of words, and what each word is a variant of."""

from __future__ import annotations

from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linededup import _lowered
from .scratch import Scratch

RUN = r"[a-zÀ-ÿ]+"
#: Segments that an automaton holds on average, code points of a segment that it holds, and words of one segment that a shard takes.
SHARD, SEGMENT, POSTINGS = 50_000, 64, 20_000
#: Partial results that a task gathers before it gives them on.
GATHERED = 100_000
PARTIAL = "word string, n_near long, less_n long, best string"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 0) -> DataFrame:
    """word: one row per run of letters of every whole text, A-Z lower-cased.

    spoil: where it divides the CRC-32 of `<id>:<run>`, the run loses the code point at that number modulo its length; 0 for never. An id null counts as
    an empty one.
    """
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(_lowered(docs[text_col]), F.lit(RUN), F.lit(0))).alias("run"))
    if not spoil:
        return runs.select(F.col("run").alias("word"))
    h, run = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.col("run")
    at = (h % F.char_length(run)).cast("int")
    return runs.select(F.when(h % spoil == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))).otherwise(run).alias("word"))


def _head(word: Column, length: Column) -> Column:
    """The first half of a word of that length, as far as an automaton holds it."""
    return word.substr(F.lit(1), F.least(F.floor(length / 2).cast("int"), F.lit(SEGMENT)))


def _tail(word: Column, length: Column) -> Column:
    """The second half, from its end."""
    return F.right(word, F.least((length - F.floor(length / 2)).cast("int"), F.lit(SEGMENT)))


def _key(kind: int, length: Column, segment: Column) -> Column:
    return F.xxhash64(F.lit(kind), length, segment)


class Halves:
    """An automaton over both segments of a shard's words.

    Words of a segment are filed by length, and there by both halves of what the segment leaves of them, since an edit spares one of these as well.
    """

    def __init__(self):
        self.files: dict[str, tuple[dict, dict]] = {}
        self.automaton = None

    def add(self, kind: int, word: str, n: int) -> None:
        half = len(word) // 2
        segment = word[: min(half, SEGMENT)] if kind == 0 else word[-min(len(word) - half, SEGMENT) :]
        own = self.files.setdefault(segment, ({}, {}))[kind].setdefault(len(word), {})
        rest = word[len(segment) :] if kind == 0 else word[: -len(segment)]
        cut = len(rest) // 2
        own.setdefault((0, rest[:cut]), []).append((word, n))
        own.setdefault((1, rest[cut:]), []).append((word, n))

    def near(self, word: str):
        """(other, n) for each word of the shard that is at one edit from this one, longer by one or of its length and behind it in order."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for segment, files in self.files.items():
                self.automaton.add_word(segment, (len(segment), files))
            self.automaton.make_automaton()
        size, found = len(word), []
        # of a very long word only the ends can hold a segment where one belongs
        ends = [(0, word)] if size <= 2 * SEGMENT else [(0, word[:SEGMENT]), (size - SEGMENT, word[-SEGMENT:])]
        for offset, part in ends:
            for last, (n, files) in self.automaton.iter(part):
                stop = offset + last + 1
                if stop == n:
                    found += self._fitting(word, files[0], 0, word[n:])
                if stop == size:
                    found += self._fitting(word, files[1], 1, word[: size - n])
        return found

    def _fitting(self, word: str, file: dict, kind: int, rest: str):
        begin = 0 if kind else len(word) - len(rest)
        for length in (len(word), len(word) + 1):
            own = file.get(length)
            if own is None:
                continue
            left = len(rest) + length - len(word)
            cut = left // 2
            first, second = own.get((0, rest[:cut]), ()), own.get((1, rest[len(rest) - (left - cut) :]), ())
            for k, those in enumerate((first, second)):
                for other, n in those:
                    if length == len(word) and other <= word or not one_edit(word, other):
                        continue
                    if k and other[begin : begin + cut] == rest[:cut]:  # the first half led to it
                        continue
                    # whatever both segments lead to is the first one's
                    if kind and word.startswith(other[: min(length // 2, SEGMENT)]):
                        continue
                    yield other, n


def one_edit(a: str, b: str) -> bool:
    """Whether b, which is not a, is a with one code point replaced or, where it is longer by one, inserted."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return b[i + 1 :] == a[i + (len(a) == len(b)) :]


def _scanned(batches, names: list[str]):
    """Partial results of sorted rows (shard, role, word, n): segments first, roles 0 and 1, then the words to scan, role 2."""
    shard, index, last, found = None, Halves(), None, {}

    def put(word, other, n):
        have = found.get(word)
        if have is None:
            found[word] = [1, -n, other]
        else:
            have[0] += 1
            if (-n, other) < (have[1], have[2]):
                have[1], have[2] = -n, other

    def out():
        words = list(found)
        columns = [words, *([found[w][k] for w in words] for k in range(3))]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    for batch in batches:
        for at, role, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != shard:
                shard, index, last = at, Halves(), None
            if role < 2:
                index.add(role, word, n)
            elif word != last:  # a word may come to a shard for several segments, and meets all of it once
                last = word
                for other, m in index.near(word):
                    put(word, other, m)
                    put(other, word, n)
                if len(found) >= GATHERED:
                    yield out()
    if found:
        yield out()


def near_words(words: DataFrame, scratch: Scratch, total: int) -> DataFrame:
    """(word, n_near, less_n, best): how many of the words (word, n) are at one edit from each, and the one of largest n, as -n and word, ties by code points.

    One edit spares a half of a word: what begins with the first or ends with the second of a word of its own or of the next length, with all else but one
    code point alike, is near it. Automata in shards hold both segments of all words. Every word is scanned in the shards that its own ends lead to for both
    lengths, four at most, and there meets all segments: offset and length must fit, then the rest is compared. So each pair is found in one place only,
    and the number of shards does not multiply the scans. A segment of more than POSTINGS words is dealt to several shards, each of which scans.
    """
    word, length = F.col("word"), F.char_length("word")
    own = F.array(*(F.struct(F.lit(k).alias("role"), _key(k, length, s).alias("key")) for k, s in enumerate((_head(word, length), _tail(word, length)))))
    ask = F.array(*(F.struct(F.lit(2).alias("role"), _key(k, n, s(word, n)).alias("key")) for n in (length, length + 1) for k, s in enumerate((_head, _tail))))
    segments = words.select("word", "n", F.explode(own).alias("s")).select("word", "n", "s.*")
    scans = words.select("word", "n", F.explode(ask).alias("s")).select("word", "n", "s.*")
    large = segments.groupBy("key").agg(F.ceil(F.count("*") / POSTINGS).cast("long").alias("pieces")).filter("pieces > 1")
    large = scratch.keep(large, "large")
    if large.isEmpty():
        segments, scans = (df.withColumn("piece", F.lit(0).cast("long")) for df in (segments, scans))
    else:
        pieces = F.coalesce("pieces", F.lit(1).cast("long"))
        segments = segments.join(large, "key", "left").withColumn("piece", F.pmod(F.xxhash64("word"), pieces))
        scans = scans.join(large, "key", "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    shards = max(words.sparkSession.sparkContext.defaultParallelism, -(-2 * total // SHARD))
    columns = [F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).alias("shard"), "role", "word", "n"]
    rows = segments.select(*columns).unionByName(scans.select(*columns)).repartition(shards, "shard").sortWithinPartitions("shard", "role", "word")
    found = rows.mapInArrow(partial(_scanned, names=["word", "n_near", "less_n", "best"]), PARTIAL)
    best = F.min(F.struct("less_n", "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.*")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the last that forms (word, root) lead to. Each round doubles the steps, and forms grow by a factor, so rounds are few."""
    links, k = scratch.keep(links, "links-0"), 0
    while True:
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        both = links.join(ahead, links["root"] == ahead["at"], "left")
        moved = scratch.keep(both.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"links-{k + 1}")
        links, k = moved.select("word", "root"), k + 1
        if moved.filter("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 0, least_chars: int = 7, least_n: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of least_chars code points and least_n occurrences.

    Words are near at one inserted, deleted or replaced code point. A word's form is its near word of largest n (ties: smallest by code points) if that is at
    least `times` its own n, else null; its root is where forms lead. n_near is 0 and form_n null where there is none.

    Words are counted by partial aggregates. spoil: see occurrences(). Text null, or without a run of letters: no words. id null: as empty, rows that repeat
    an id count each. A run of any length is a word. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    words = occurrences(docs, id_col, text_col, spoil).filter(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)
    words = scratch.keep(words, "words")
    near = near_words(words, scratch, words.count())
    form_n = -F.col("less_n")
    is_form = form_n >= F.col("n") * times
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, form_n).alias("form_n"))
    rows = scratch.keep(rows, "rows")
    last = roots(rows.filter("form is not null").select("word", F.col("form").alias("root")), scratch)
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
