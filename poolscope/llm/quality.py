"""Quality rules: a table of thresholds over ratios of a text, compiled into one projection. Spark expressions alone."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, as a class of characters: what is between words.
SPACE = r"\x20\x09-\x0D"
#: Frequent function words of English, French, German and Spanish: fixed values.
STOP_WORDS = """
the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you
le la les de des du et un une est que qui dans pour pas sur au en il elle ce ne
der die das und ist von den mit zu dem des ein eine nicht auch auf für im sich es
el los las una y por con no su para como más pero al lo se del
""".split()
WINDOW = 5


class Rule(NamedTuple):
    """A text fails where the feature is below `least` or above `most`; None for no limit."""

    name: str
    feature: str
    least: float | None
    most: float | None


#: After published filters for web text: lengths of texts and words, symbols, stop words, and lines. A text under `base` fails whatever the others say.
BASE = [Rule("few words", "n_words", 10, None), Rule("repeated words", "repeat_percent", None, 20)]
RULES = [
    *BASE,
    Rule("mean word length", "mean_word_chars", 2, 12),
    Rule("symbols to words", "symbol_ratio", None, 0.1),
    Rule("words with a letter", "alpha_ratio", 0.7, None),
    Rule("stop words", "stop_ratio", 0.05, None),
    Rule("capitals", "capital_ratio", None, 0.5),
    Rule("repeated lines", "dup_line_ratio", None, 0.3),
    Rule("bullet lines", "bullet_ratio", None, 0.9),
    Rule("cut lines", "ellipsis_ratio", None, 0.3),
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _long(c: Column) -> Column:
    return c.cast("long")


def _repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the text has more than once.

    Windows are hashed first: where no two hashes agree, which is the rule, no two windows do. Else windows are compared as they are, in order: one that
    equals its neighbour counts, and the words of such windows, which are in order of place, are counted once each.
    """
    places = lambda w: F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = lambda w: F.transform(places(w), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    sorted_ = lambda w: F.sort_array(F.transform(places(w), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("text"), i.alias("at"))))
    same = lambda x, i, other: F.get(x, i + other)["text"] == F.get(x, i)["text"]
    twice = lambda x: F.filter(x, lambda _, i: F.coalesce(same(x, i, -1), F.lit(False)) | F.coalesce(same(x, i, 1), F.lit(False)))
    covered = lambda at: F.aggregate(
        at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"]
    )
    exact = lambda w: _let(sorted_(w), lambda x: _let(F.sort_array(F.transform(twice(x), lambda e: e["at"])), covered))
    agree = lambda w: _let(hashes(w), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(F.when(agree(words), exact(words)).otherwise(F.lit(0)))


#: What measured() gives.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_alpha", "n_stop", "n_letters", "n_capitals", "n_lines", "n_bullets", "n_ellipses"]


def _counts(text: Column, words: Column, lines: Column) -> list[Column]:
    matching = lambda values, pattern: F.size(F.filter(values, lambda x: x.rlike(pattern)))
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    runs = F.split(F.lower(text), r"[^\p{L}\p{M}]+")
    return [
        F.size(words), left(f"[{SPACE}]+"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.size(lines) - F.size(F.array_distinct(lines)), _repeated_words(words),
        matching(words, r"\p{L}"), F.size(F.filter(runs, lambda x: x.isin(STOP_WORDS))), left(r"[^\p{L}]+"), left(r"[^\p{Lu}]+"),
        F.size(lines), matching(lines, f"^[{SPACE}]*[\u2022\u2023*\u00b7-]"), matching(lines, f"(\\.\\.\\.|\u2026)[{SPACE}]*$"),
    ]


def features() -> dict[str, Column]:
    """What rules may name: the counts, and ratios of them, null where there is nothing to divide by."""
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return {c: F.col(c) for c in COUNTS} | {
        "mean_word_chars": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "n_words"), "repeat_percent": 100 * F.col("n_repeat_words") / F.nullif(F.col("n_words"), F.lit(0)),
        "alpha_ratio": share("n_alpha", "n_words"), "stop_ratio": share("n_stop", "n_words"), "capital_ratio": share("n_capitals", "n_letters"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"), "bullet_ratio": share("n_bullets", "n_lines"), "ellipsis_ratio": share("n_ellipses", "n_lines"),
    }


def failing(rules: list[Rule]) -> Column:
    """The names of the rules that a row with the counts fails, from one expression."""
    own = features()
    for r in rules:
        if r.feature not in own:
            raise ValueError(f"rule {r.name!r}: no feature {r.feature!r}")
    beyond = lambda r: (F.lit(False) if r.least is None else own[r.feature] < r.least) | (F.lit(False) if r.most is None else own[r.feature] > r.most)
    return F.array_compact(F.array(*(F.when(beyond(r), F.lit(r.name)) for r in rules), F.lit(None).cast("string")))


def quality(docs: DataFrame, rules: list[Rule] = RULES, base: list[Rule] = BASE, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with COUNTS, and failed (names of rules), base_failed and kept.

    Words are runs without white space, lines are what \\n splits. n_symbols: #*$%&|<>. n_dup_lines: lines with a word that equal an earlier one.
    n_repeat_words: words in windows of 5 that the text has twice or more. n_alpha: words with a letter. n_stop: runs of letters that are STOP_WORDS.
    A row is read, measured and judged where it lies: no shuffle, whatever the skew, and some 20 times a text's size of memory where its windows repeat.

    Text null or empty: no words, all counts 0. A feature without a value, such as a ratio to no lines, fails no rule. Repeated rows are judged alike. An empty
    table gives no rows. Other columns pass through, but for ones of the names above, which are replaced.
    """
    columns = [c for c in docs.columns if c not in (*COUNTS, "failed", "base_failed", "kept")]
    text = F.coalesce(docs[text_col], F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(docs[c] for c in columns)).alias("row"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    counts = _counts(F.col("text"), F.col("words"), F.col("lines"))
    rows = rows.select("row", *(c.cast("long").alias(name) for name, c in zip(COUNTS, counts, strict=True)))
    rows = rows.select("row", *COUNTS, failing(rules).alias("failed"), (F.size(failing(base)) > 0).alias("base_failed"))
    return rows.select(*(F.col("row")[c].alias(c) for c in columns), *COUNTS, "failed", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
