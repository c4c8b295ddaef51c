"""Secrets in texts: fixed patterns, and formats learned as probabilistic automata from what the patterns label."""

from __future__ import annotations

import re
from collections import Counter
from functools import partial
from math import inf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from . import words as W

#: Base patterns, in this order; assign needs a value of 6 characters.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("pass", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "grammar")
#: Credentials of a kind, confidence of the merging test, observations that a state adds and those of a class it has not seen, share of labelled ones that
#: may score below the threshold.
CREDENTIALS, ALPHA, PRIOR, ADDED, BELOW = 800, 0.05, 10.0, 0.1, 0.05
#: Characters of a credential beyond which none is learned from: states grow with the length, and comparisons with its square.
LONGEST = 128
#: Observations of a state below which the test says little, and the overlap of lengths still to come that two such states must have.
EVIDENCE, OVERLAP = 200, 0.5
#: Nats a character by which a format must beat ordinary text.
MARGIN = 0.5


def symbol(c: str) -> str:
    """The class of a character: upper case, letters that are hexadecimal digits, other lower case, digits; others stand for themselves."""
    return "U" if "A" <= c <= "Z" else "X" if "a" <= c <= "f" else "L" if "a" <= c <= "z" else "D" if "0" <= c <= "9" else c


CLASSES = {"U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X": "abcdef", "L": "ghijklmnopqrstuvwxyz", "D": "0123456789"}


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base patterns' matches."""
    out = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return out


class Automaton:
    """A probabilistic automaton over character classes, inferred by merging the states of a prefix tree.

    Every state counts its characters, its endings, and how many characters its words still have to come. States are taken by depth, the most frequent
    first; each is merged into a state kept so far if the two are compatible, one of the same depth first, else it is kept. A merge folds the subtree.

    Compatible are states whose endings, characters and lengths to come differ by no more than Hoeffding's bound, as must those of what follows. The bound
    says nothing of a few observations, and a tree over random characters has few at each of its states: so states of unlike depth, one of them with fewer
    than EVIDENCE observations, must also share more than OVERLAP of their lengths to come. Words of one length thus keep a state for each place, and
    words of many lengths get loops.
    """

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.bound, self.shortest = sqrt(0.5 * log(2 / alpha)), min(map(len, words))
        self.next: list[dict[str, int]] = []
        self.chars: list[Counter] = []
        self.ends: list[int] = []
        self.left: list[Counter] = []
        self.depth: list[int] = []
        self._state(0)
        for w in words:
            q = 0
            self.left[q][len(w)] += 1
            for i, c in enumerate(w, 1):
                self.chars[q][c] += 1
                x = symbol(c)
                if x not in self.next[q]:
                    self.next[q][x] = self._state(i)
                q = self.next[q][x]
                self.left[q][len(w) - i] += 1
            self.ends[q] += 1
        kept, is_kept = [0], {0}
        while True:
            blue = {to for q in kept for to in self.next[q].values() if to not in is_kept}
            if not blue:
                break
            q = min(blue, key=lambda q: (self.depth[q], -self._total(q), q))
            to = next((r for r in sorted(kept, key=lambda r: (self.depth[r] != self.depth[q], r)) if self._alike(r, q)), None)
            if to is None:
                kept.append(q)
                is_kept.add(q)
                continue
            for r in kept:
                for x, old in self.next[r].items():
                    if old == q:
                        self.next[r][x] = to
            self._fold(to, q)
        self.states = kept

    def _state(self, depth: int) -> int:
        self.next.append({})
        self.chars.append(Counter())
        self.ends.append(0)
        self.left.append(Counter())
        self.depth.append(depth)
        return len(self.next) - 1

    def _total(self, q: int) -> int:
        return self.left[q].total()

    def _shared(self, a: int, b: int) -> float:
        """The share of lengths to come that two states have in common: of the lengths themselves where they repeat, else of their ranges."""
        la, lb = self.left[a], self.left[b]
        if 2 * len(la) <= la.total() and 2 * len(lb) <= lb.total():
            return len(la.keys() & lb.keys()) / len(la.keys() | lb.keys())
        low, high = (min(la), max(la)), (min(lb), max(lb))
        return max(0, min(low[1], high[1]) - max(low[0], high[0]) + 1) / (max(low[1], high[1]) - min(low[0], high[0]) + 1)

    def _close(self, a: int, b: int) -> bool:
        """Whether two states differ by no more than the bound, by themselves."""
        na, nb = self._total(a), self._total(b)
        far = self.bound * (1 / sqrt(na) + 1 / sqrt(nb))
        if abs(self.ends[a] / na - self.ends[b] / nb) > far:
            return False
        if any(abs(self.chars[a][c] / na - self.chars[b][c] / nb) > far for c in self.chars[a].keys() | self.chars[b].keys()):
            return False
        la, lb, apart = self.left[a], self.left[b], 0.0
        for n in sorted(la.keys() | lb.keys()):
            apart += la[n] / na - lb[n] / nb
            if abs(apart) > far:
                return False
        return True

    def _alike(self, a: int, b: int) -> bool:
        if self.depth[a] != self.depth[b] and min(self._total(a), self._total(b)) < EVIDENCE and self._shared(a, b) <= OVERLAP:
            return False
        stack, seen = [(a, b)], set()
        while stack:
            a, b = stack.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if not self._close(a, b):
                return False
            stack += [(self.next[a][x], self.next[b][x]) for x in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if a == b:
                continue
            self.ends[a] += self.ends[b]
            self.chars[a].update(self.chars[b])
            self.left[a].update(self.left[b])
            for x, q in sorted(self.next[b].items()):
                if x in self.next[a]:
                    stack.append((self.next[a][x], q))
                else:
                    self.next[a][x] = q

    def table(self) -> dict:
        """What scoring needs: alphabet, lengths, and of each state the log-probabilities of its end and of each character, with the state that follows.

        A state's characters are counted on top of PRIOR observations, which have its classes in their shares and all characters of a class alike. A class
        that it has not seen has ADDED observations and leads where most of its characters lead. A word that stops at a state without endings, or goes on
        where nothing follows, has probability 0. lengths: least and most characters of a word whose probability is not 0, None for no most; none is shorter
        than the shortest credential.
        """
        classes = {x: CLASSES.get(x, x) for x in sorted({symbol(c) for q in self.states for c in self.chars[q]})}
        place = {q: i for i, q in enumerate(self.states)}
        rows, follow = [], []
        for q in self.states:
            going = sum(self.chars[q].values())
            n = self.ends[q] + going
            end, steps = log(self.ends[q] / n) if self.ends[q] else None, {}
            if going:
                per = Counter()
                for c, k in self.chars[q].items():
                    per[symbol(c)] += k
                usual = self.next[q][max(sorted(per), key=per.__getitem__)]
                for x, own in classes.items():
                    share = (per[x] or ADDED) / (going + ADDED * (len(classes) - len(per))) / len(own)
                    for c in own:
                        steps[c] = log(going / n * (self.chars[q][c] + PRIOR * share) / (going + PRIOR)), place[self.next[q].get(x, usual)]
            rows.append((end, steps))
            follow.append({to for _, to in steps.values()})
        here, least, most = {0}, None, 0
        for n in range(len(rows) * 2 + 1):
            if any(rows[q][0] is not None for q in here):
                least, most = n if least is None else least, n
            here = set().union(*(follow[q] for q in here)) if here else here
            if not here:
                break
        return {"alphabet": "".join(classes.values()), "lengths": (max(least, self.shortest), None if here else most), "states": rows}


def score(table: dict, usual: dict[str, float], word: str) -> float:
    """Log-likelihood of a word's format over that of ordinary text, per character; -inf for a word that the automaton does not make."""
    states, q, total, least = table["states"], 0, 0.0, min(usual.values())
    for c in word:
        step = states[q][1].get(c)
        if step is None:
            return -inf
        total += step[0] - usual.get(c, least)
        q = step[1]
    return -inf if states[q][0] is None else (total + states[q][0]) / (len(word) + 1)


def least_score(words: list[str], table: dict, usual: dict[str, float]) -> float:
    """The score that all but BELOW of the words reach, the lower one of two ways: under their automaton, and each half under the other half's."""
    def below(scores):
        own = sorted(x for x in scores if x > -inf)
        return own[int(len(own) * BELOW)] if own else inf

    halves = [Automaton(words[k::2]).table() for k in (0, 1)] if len(words) > 1 else []
    return max(MARGIN, min(below(score(table, usual, w) for w in words), below(score(t, usual, w) for k, t in enumerate(halves) for w in words[1 - k :: 2])))


def candidates(table: dict, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end byte of the whole runs of a format's alphabet whose length its automaton can make; longer and shorter ones have probability 0."""
    inside = np.zeros(256, bool)
    inside[np.frombuffer(table["alphabet"].encode(), np.uint8)] = True
    starts, ends, _ = W.bounds(data, at, inside)
    least, most = table["lengths"]
    fits = (ends - starts >= least) & (ends - starts <= (len(data) if most is None else most))
    return np.searchsorted(at, starts[fits], "right") - 1, starts[fits], ends[fits]


def _labelled(batches, longest):
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            rows += {(kind, value) for kind, _, _, value in base_spans(text or "") if len(value) <= longest}
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"])


def _characters(batches):
    total = np.zeros(256, np.int64)
    for batch in batches:
        for text in batch.column(0):
            # In UTF-8, bytes below 128 are ASCII characters and nothing else.
            total += np.bincount(np.frombuffer(text.as_buffer() or b"", np.uint8), minlength=256)
    rows = [(chr(c), int(n)) for c, n in enumerate(total[:128]) if n and (chr(c).isalnum() or chr(c) in "+/_=-.")]
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["c", "n"])


def train(docs: DataFrame, text_col: str = "text", most: int = CREDENTIALS, longest: int = LONGEST) -> dict:
    """Automata and thresholds by kind, from at most `most` distinct credentials of a kind, chosen by a hash from those of all documents.

    Credentials of more than `longest` characters, such as certificates, are not learned from, so what is learned is bounded in number and in length; where
    they are labelled, base patterns find them whole.

    Characters are counted in all documents. Only those credentials and the counts of characters reach the driver. A kind's threshold is the score that
    all but BELOW of its own credentials reach (least_score), and at least MARGIN.
    """
    docs = docs.select(F.col(text_col).alias("text"))
    first = Wd.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    found = docs.mapInArrow(partial(_labelled, longest=longest), "kind string, value string").distinct().withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most).select("kind", "value").collect()
    counts = {r[0]: r[1] for r in docs.mapInArrow(_characters, "c string, n long").groupBy("c").agg(F.sum("n")).collect()}
    total = sum(counts.values()) + 64
    usual = {c: log((counts.get(c, 0) + 1) / total) for c in {*counts, *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."}}
    out = {"usual": usual, "kinds": []}
    for kind in KINDS[:3]:
        words = sorted(r["value"] for r in found if r["kind"] == kind)
        if words:
            table = Automaton(words).table()
            out["kinds"].append((table, least_score(words, table, usual)))
    return out


def grammar_runs(model: dict, data: np.ndarray, at: np.ndarray) -> dict[int, set[tuple[int, int]]]:
    """By text, the start and end bytes of the candidates that score over the threshold of some kind's automaton."""
    out: dict[int, set[tuple[int, int]]] = {}
    for table, least in model["kinds"]:
        for x, a, b in zip(*(c.tolist() for c in candidates(table, data, at)), strict=True):
            if score(table, model["usual"], data[a:b].tobytes().decode()) >= least:
                out.setdefault(x, set()).add((a, b))
    return out


def grammar_spans(found: set[tuple[int, int]], raw: bytes, base: list) -> list[tuple[str, int, int]]:
    """Runs of one text, in characters, that touch no base span; of runs that overlap, the first and longest."""
    out, last = [], 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        begin = len(raw[:a].decode())
        end = begin + b - a
        if begin >= last and not any(begin < y and x < end for _, x, y, _ in base):
            out.append(("grammar", begin, end))
            last = end
    return out


ROWS = "doc_id long, kinds array<string>, starts array<long>, ends array<long>"


def _scan(batches, model):
    model = model.value
    for batch in batches:
        data, at = W.utf8(batch.column(1))
        for a, b in W.blocks(data, at):
            part, where = data[at[a] : at[b]], at[a : b + 1] - at[a]
            runs, found = grammar_runs(model, part, where), []
            for i in range(b - a):
                raw = part[where[i] : where[i + 1]].tobytes()
                base = base_spans(raw.decode())
                spans = [x[:3] for x in base] + grammar_spans({(p - int(where[i]), q - int(where[i])) for p, q in runs.get(i, ())}, raw, base)
                found.append(sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))
            columns = [pa.array([[x[i] for x in s] for s in found], pa.list_(pa.string() if not i else pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "kinds", "starts", "ends"])


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kinds, starts, ends of each document's spans, by start and then kind: assign, access, hex, grammar. Offsets are code points, ends exclusive.

    Grammar spans are whole runs of a format's alphabet that its automaton makes, at a likelihood over the threshold; the alphabet and the lengths come from
    the labelled credentials, so any length that was labelled is scored.
    Text null or empty: no spans. doc_id may be null or repeat. A model without credentials adds no spans. Each row stands alone: nothing is shuffled.
    An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The model's size is bounded by the credentials that it is trained on.
    return rows.mapInArrow(partial(_scan, model=docs.sparkSession.sparkContext.broadcast(model)), ROWS)
