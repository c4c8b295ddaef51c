"""Language of a text: unigram models over a fixed public vocabulary of pieces, summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from . import words as W

U = np.uint64
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Training documents of a language (about; chosen by a hash of the id), rounds of expectation-maximisation, counts added to every piece.
SAMPLE, ROUNDS, ADDED = 500, 4, 0.05
#: Characters of a stretch of a word to learn from, and distinct stretches of a language at most, chosen by a hash.
STRETCH, STRETCHES = 32, 300_000
#: Characters from which a word is scored by _long(), and those that it takes at a time.
LONG, CHUNK = 512, 1 << 15
#: Words whose likelihoods one task remembers.
REMEMBERED = 200_000
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
Q = int(W.odd(1, 51)[0])
Q_BACK = pow(Q, -1, 1 << 64)
SLOTS = 20


def _powers(q: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, q, U)]), dtype=U)


class Pieces:
    """The vocabulary's pieces of letters, at the beginning of a word or inside it, found by hash for all substrings of many words at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        self.count = len(pieces)
        order = W.mix(np.arange(0x110000, dtype=U))
        h = np.array([np.sum(order[[ord(c) for c in p]] * _powers(Q, len(p))[: len(p)], dtype=U) for p in pieces])
        self.ids = np.full(1 << SLOTS, -1, np.int32)
        self.keys = np.zeros(1 << SLOTS, U)
        for i, x in enumerate(h.tolist()):
            at = x >> (64 - SLOTS)
            while self.ids[at] >= 0:
                at = (at + 1) % (1 << SLOTS)
            self.ids[at], self.keys[at] = i, x

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; self.count where there is none."""
        at = (h >> U(64 - SLOTS)).astype(np.int64)
        out = np.full(h.shape, self.count, np.int32)
        ids = self.ids[at]
        open_ = np.flatnonzero(ids.ravel() >= 0)
        at, flat, to = at.ravel()[open_], h.ravel()[open_], out.ravel()
        while len(open_):
            ids, hit = self.ids[at], self.keys[at] == flat
            to[open_[hit]] = ids[hit]
            go = ~hit & (ids >= 0)
            open_, at, flat = open_[go], (at[go] + 1) & ((1 << SLOTS) - 1), flat[go]
        return to.reshape(h.shape)

    def lattice(self, words: list[str]) -> np.ndarray:
        """[word, end, length]: the piece that ends there with so many characters. A single character without a piece is the unknown one (count + 1)."""
        n, wide = len(words), max(map(len, words))
        text = np.zeros((n, wide), np.int64)
        for i, w in enumerate(words):
            text[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        sums = np.zeros((n, wide + 1), U)
        np.cumsum(W.mix(text.astype(U)) * _powers(Q, wide)[:wide], axis=1, dtype=U, out=sums[:, 1:])
        back = _powers(Q_BACK, wide)
        out = np.full((n, wide + 1, self.longest), self.count, np.int32)
        for k in range(1, min(self.longest, wide) + 1):
            out[:, k:, k - 1] = self.find((sums[:, k:] - sums[:, :-k]) * back[: wide + 1 - k])
        single = out[:, :, 0]
        single[single == self.count] = self.count + 1
        return out


def _groups(words: list[str], most: int = 4096):
    """Numbers of words of about equal length."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    a = 0
    while a < len(order):
        b, n = a, len(words[order[a]])
        while b < len(order) and len(words[order[b]]) <= max(8, 1.5 * n) and (b - a) * max(8, n) < 8 * most:
            b += 1
        yield order[a:b]
        a = b


def _long(pieces: Pieces, p: np.ndarray, word: str) -> np.ndarray:
    """forward() of one word of any length, in time and memory that are small for each of its characters.

    A step needs the sums at the last `longest` places only and is linear in them, so a run of steps is a matrix. A chunk is cut into about as many segments
    as a segment has characters; all segments' matrices are built side by side, and then applied to the sums one after another.
    """
    wide, langs = pieces.longest, p.shape[1]
    v, logs, lags = np.zeros((wide, langs)), np.zeros(langs), np.arange(wide)
    v[0] = 1  # v[m]: the sum m places back
    for begin in range(0, len(word), CHUNK):
        n, before = min(CHUNK, len(word) - begin), min(begin, wide)
        at = pieces.lattice([word[begin - before : begin + n]])[0][before:]
        many = isqrt(n)
        step = n // many
        m, scale = np.zeros((many, wide, wide, langs)), np.zeros((many, langs))
        m[:, lags, (-lags) % wide] = 1  # [segment, place back that began with 1, place modulo wide]
        ends = np.arange(many) * step
        for j in range(1, step + 1):
            own = p[at[ends + j]][:, (j - 1 - lags) % wide]  # by place modulo wide
            m[:, :, j % wide] = np.einsum("smkl,skl->sml", m, own)
            if j % 16 == 0 or j == step:
                top = np.maximum(m.max((1, 2)), 1e-300)
                m /= top[:, None, None]
                scale += np.log(top)
        m = m[:, :, (step - lags) % wide]
        for s in range(many):
            v = np.einsum("ml,mkl->kl", v, m[s])
            top = np.maximum(v.max(0), 1e-300)
            v, logs = v / top, logs + scale[s] + np.log(top)
        for j in range(many * step + 1, n + 1):
            new = (v * p[at[j]]).sum(0)
            v = np.concatenate([new[None], v[:-1]])
            if j % 16 == 0 or j == n:
                top = np.maximum(v.max(0), 1e-300)
                v, logs = v / top, logs + np.log(top)
    return np.log(np.maximum(v[0], 1e-300)) + logs


def forward(pieces: Pieces, p: np.ndarray, words: list[str], expected: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """[word, language]: log-probability of each word, with its mark where it has one, summed over all its segmentations. p: [piece, language], with zeros
    at pieces.count and the unknown character's after it. With expected, weight[word, language] times each piece's posterior count is added to it; words
    have STRETCH characters at most then."""
    out = np.empty((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) < LONG]
    for i in set(range(len(words))) - set(short):
        out[i] = _long(pieces, p, words[i])
    for group in _groups([words[i] for i in short]):
        group = [short[i] for i in group]
        own = [words[i] for i in group]
        at = pieces.lattice(own)
        n, wide, longest = at.shape
        lens = np.array([len(w) for w in own])
        a, scale = np.zeros((n, wide, p.shape[1])), np.zeros((n, wide, p.shape[1]))
        a[:, 0] = 1
        found = np.ascontiguousarray((at != pieces.count).transpose(1, 2, 0))
        for j in range(1, wide):
            s = np.zeros((n, p.shape[1]))
            for k in range(1, min(longest, j) + 1):
                has = np.flatnonzero(found[j, k - 1])
                if len(has):
                    x = a[has, j - k] * p[at[has, j, k - 1]]
                    s[has] += x * np.exp(scale[has, j - k] - scale[has, j - 1]) if j > STRETCH else x
            if j > STRETCH:  # long words: each position has a scale of its own
                top = np.maximum(s, 1e-300)
                a[:, j], scale[:, j] = s / top, scale[:, j - 1] + np.log(top)
            else:
                a[:, j] = s
        rows = np.arange(n)
        end = a[rows, lens]
        out[group] = np.log(np.maximum(end, 1e-300)) + scale[rows, lens]
        if expected is not None:
            b = np.zeros_like(a)
            b[rows, lens] = weight[group] / np.maximum(end, 1e-300)
            for j in range(wide - 1, 0, -1):
                for k in range(1, min(longest, j) + 1):
                    ids = at[:, j, k - 1]
                    has = ids != pieces.count
                    if has.any():
                        x = p[ids[has]] * b[has, j]
                        b[has, j - k] += x
                        np.add.at(expected, ids[has], a[has, j - k] * x)
    return out


def letters_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _alphabetic(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def stretches(word: str) -> list[str]:
    """A word with its mark, in parts of at most STRETCH characters."""
    word = MARK + word
    return [word[i : i + STRETCH] for i in range(0, len(word), STRETCH)]


def _counted(batches):
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, c = Counter(w for x in letters_of(text or "") if (w := _alphabetic(x))), Counter()
            for w, n in words.items():
                for x in stretches(w):
                    c[x] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's lower-case pieces that are letters, with the mark of a word's beginning or without."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in found if (rest := p.removeprefix(MARK)).isalpha() and rest == rest.lower() or p == MARK)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS, most: int = STRETCHES) -> dict:
    """Piece probabilities of each language, from about `sample` of its documents, chosen by a hash of the id.

    All letters of those documents count. A word longer than STRETCH is learned from in stretches, so that only pieces across their ends are not seen;
    scoring knows no stretches. The counts of at most `most` distinct stretches of a language, chosen by a hash, reach the driver. Documents without a
    language don't count; without any, the model has no language.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    many = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(many)
    pieces = vocabulary(path)
    model = {"langs": langs, "pieces": pieces, "p": np.zeros((len(pieces) + 2, len(langs)))}
    if not langs:
        return model
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / many[lang]))])
    chosen = docs.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    rows = chosen.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("k", F.row_number().over(Wd.partitionBy("lang").orderBy(F.xxhash64("word"), "word"))).filter(F.col("k") <= most).toPandas()
    rows = rows.sort_values(["word", "lang"])
    words = sorted(set(rows["word"]))
    place = {w: i for i, w in enumerate(words)}
    weight = np.zeros((len(words), len(langs)))
    weight[rows["word"].map(place).to_numpy(int), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = rows["n"]
    index = Pieces(pieces)
    p = np.full((len(pieces) + 2, len(langs)), 1.0 / (len(pieces) + 1))
    p[-2] = 0
    for _ in range(rounds if words else 0):
        expected = np.full_like(p, ADDED)
        expected[-2] = 0
        forward(index, p, words, expected, weight)
        p = expected / expected.sum(0)
    return model | {"p": p}


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.p, self.pieces = model["langs"], model["p"], Pieces(model["pieces"])
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)))

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        words = sorted(words)
        bare = [_alphabetic(w) for w in words]
        some = [i for i, w in enumerate(bare) if w]
        value = np.full((len(words), len(self.langs)), np.nan)
        if some:
            value[some] = forward(self.pieces, self.p, [MARK + bare[i] for i in some])
        self.known.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.table = np.concatenate([self.table, value])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the total likelihood."""
        counts = [Counter(letters_of(t or "")) for t in texts]
        new = {w for c in counts for w in c if w not in self.known}
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                new = {w for c in counts for w in c}
            self._learn(new)
        pred, score = [], []
        for c in counts:
            x = self.table[[self.known[w] for w in c]] if c else self.table[:0]
            ok = ~np.isnan(x[:, 0]) if len(self.langs) and len(x) else np.zeros(len(x), bool)
            if not ok.any():
                pred.append("und")
                score.append(0.0)
                continue
            total = (x[ok] * np.fromiter(c.values(), float, len(c))[ok, None]).sum(0)
            best = int(total.argmax())
            pred.append(self.langs[best])
            score.append(float(1 / np.exp(total - total[best]).sum()))
        return pred, score


def _predicted(batches, model):
    scorer = Scorer(model.value)
    for batch in batches:
        texts = batch.column(0)
        for a in range(0, len(texts), 200):
            b = min(len(texts), a + 200)
            pred, score = scorer(texts.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(1, batch.num_columns)), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])


def identify(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (all, if None) with lang_pred and score.

    A text's words are its runs of letters, in lower case. Each is scored under each language's piece probabilities by the forward algorithm, which sums
    over all segmentations into pieces, of a word of any length; a text's likelihood is the product over its words, and score the share of the best language in the sum over
    languages. Text null or without a letter, or a model without languages: und, 0.0. Equal likelihoods: the first by code point.
    An empty table gives no rows. Columns named lang_pred or score are replaced.
    """
    spark: SparkSession = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    own = [docs[c].alias(f"c{i}") for i, c in enumerate(keep)]  # whatever names they have, they are told apart
    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double")
    # The model has a fixed size: the vocabulary's pieces times the languages.
    found = docs.select(docs[text_col].alias("text"), *own).mapInArrow(partial(_predicted, model=spark.sparkContext.broadcast(model)), schema)
    return found.toDF(*keep, "lang_pred", "score")


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents to learn from: crc32 of the id as text, modulo 5, is not 0."""
    return docs.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
