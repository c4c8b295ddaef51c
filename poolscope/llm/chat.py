"""Chat records of any known layout to canonical turns, and turns to training text with a loss mask."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layouts: where the turns are and how a turn's fields are named, or which field is which role's text. Fields in `optional` may be absent.
LAYOUTS = [
    {"name": "messages", "list": "messages", "role": "role", "text": "content"},
    {"name": "conversations", "list": "conversations", "role": "from", "text": "value"},
    {"name": "dialog", "list": "dialog.turns", "role": "speaker", "text": "text"},
    {"name": "instruction", "fields": [("system", "system"), ("user", "instruction"), ("assistant", "output")], "optional": ["system"]},
    {"name": "prompt", "fields": [("user", "prompt"), ("assistant", "completion")], "optional": []},
]
#: Turns and characters of a part of a conversation.
PART_TURNS, PART_CHARS = 64, 1 << 20


def paths(value, at: str = "") -> set[str]:
    """The paths of all fields of a record, nested ones and those that hold them; [] stands for any element of a list."""
    own = {at} if at else set()
    if isinstance(value, dict):
        return own.union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return own.union({f"{at}[]"}, *(paths(v, f"{at}[]") for v in value))
    return own


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


class Registry:
    """Layouts by the fingerprints of the field paths that they read.

    A record's paths are reduced to those that some layout reads, so that ids and other fields beside the turns don't matter, and the hash of what is left
    selects the layout. A record that has the paths of several layouts is of the first that it has all of.
    """

    def __init__(self, layouts: list[dict] = LAYOUTS):
        self.known: dict[str, dict] = {}
        self.own: list[tuple[set[str], list[set[str]], dict]] = []
        for x in layouts:
            if "list" in x:
                top = f"{x['list']}[]"
                sets = [{top, f"{top}.{x['role']}", f"{top}.{x['text']}"}, {top}]
            else:
                names = {name for _, name in x["fields"]}
                sets = [names - set(absent) for n in range(len(x["optional"]) + 1) for absent in combinations(x["optional"], n)]
            self.own.append((set().union(*sets), sets, x))
            for own in sets:
                self.known.setdefault(fingerprint(own), x)
        self.used = set().union(*(own for own, _, _ in self.own))

    def layout(self, record: dict) -> dict | None:
        found = paths(record) & self.used
        exact = self.known.get(fingerprint(found))
        if exact is not None:
            return exact
        for own, _, x in self.own:
            if fingerprint(found & own) in self.known and self.known[fingerprint(found & own)] is x:
                return x
        return None


def _text(value) -> str:
    """A role or text as a string; null counts as empty, and what is no string stands as JSON."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns(record: dict, layout: dict) -> list[tuple[str, str]]:
    """(role, text) of each turn; a turn without a role or text has an empty one."""
    if "list" in layout:
        value = record
        for k in layout["list"].split("."):
            value = value[k]
        return [(_text(x.get(layout["role"])), _text(x.get(layout["text"]))) for x in value]
    return [(role, _text(record[name])) for role, name in layout["fields"] if name in record]


#: What marks a turn. None of these can stand in an escaped text, which holds no <, >, [ or ].
ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "[": "\\b", "]": "\\e"}
BACK = {v: k for k, v in ESCAPES.items()}
TURN = re.compile(r"<s>\[INST\] ([^<\[]*) \[/INST\]| ([^<\[]*) </s>|<<([^<>]*)>> ([^<\[]*) <</>>")


def escape(text: str) -> str:
    return re.sub(r"[\\<>\[\]]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: BACK[m[0]], text)


def render(own: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns, and the span of each assistant's escaped text in it: the loss mask."""
    out, at, spans = [], 0, []
    for role, text in own:
        text = escape(text)
        if role == "user":
            piece = f"<s>[INST] {text} [/INST]"
        elif role == "assistant":
            piece = f" {text} </s>"
            spans.append((at + 1, at + 1 + len(text)))
        else:
            piece = f"<<{escape(role)}>> {text} <</>>"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        if m[1] is not None:
            out.append(("user", unescape(m[1])))
        elif m[2] is not None:
            out.append(("assistant", unescape(m[2])))
        else:
            out.append((unescape(m[3]), unescape(m[4])))
        at = m.end()
    return out


FORMATTED = "conversation_id long, part long, layout string, n_turns long, formatted string, problem string, loss array<struct<a:long,b:long>>"


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def formatted(text: str | None, known: Registry) -> tuple:
    """A row of FORMATTED."""
    if not text:
        return (None,) * 5 + ("no record", None)
    try:
        record = json.loads(text)
    except (ValueError, RecursionError):
        return (None,) * 5 + ("not JSON", None)
    if not isinstance(record, dict):
        return (None,) * 5 + ("not an object", None)
    own_id = _whole(record.get("conversation_id")), _whole(record.get("part"))
    try:
        layout = known.layout(record)
        own = turns(record, layout) if layout else None
    except (TypeError, AttributeError, KeyError, RecursionError):
        return (*own_id, None, None, None, "turns of mixed kinds", None)
    if layout is None:
        return (*own_id, None, None, None, "unknown layout", None)
    out, spans = render([(role.encode("utf-8", "replace").decode(), said.encode("utf-8", "replace").decode()) for role, said in own])
    return (*own_id, layout["name"], len(own), out, None, [{"a": a, "b": b} for a, b in spans])


def _format(batches, layouts):
    known = Registry(layouts)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
    for batch in batches:
        rows = [formatted(text, known) for text in batch.column(0).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FORMATTED.split(", ", 6)])


def format_records(records: DataFrame, column: str = "record", layouts: list[dict] = LAYOUTS) -> DataFrame:
    """conversation_id, part, layout, n_turns, formatted, problem, loss of each JSON record.

    The paths of a record's nested fields are hashed, and the hash selects the layout that maps it to turns (Registry); fields that no layout reads don't
    matter. Null or absent roles and texts count as empty; what is no string stands as JSON, half a surrogate pair as ?. Ids that are no integers of 64 bits
    are null. A record that is null, empty, not JSON, no object, of an unknown layout, or whose turns are of mixed kinds has its ids, if any, and a problem,
    else null. Rows keep their order; no row depends on another. Other columns are not read.
    """
    from functools import partial

    return records.select(column).mapInArrow(partial(_format, layouts=layouts), FORMATTED)


def _layout_of(conv: int | None, own: list[tuple]) -> dict:
    """A record of some layout that can hold these turns."""
    roles = [r for r, _ in own]
    kind = (conv or 0) % 5
    if kind == 4 and roles == ["user", "assistant"]:
        return {"prompt": own[0][1], "completion": own[1][1]}
    if kind == 3 and roles[-2:] == ["user", "assistant"] and roles[:-2] in ([], ["system"]):
        return dict([("system", own[0][1])] * (len(own) - 2) + [("instruction", own[-2][1]), ("output", own[-1][1])])
    if kind in (1, 3):
        return {"conversations": [{"from": r, "value": t} for r, t in own]}
    if kind == 2:
        return {"dialog": {"turns": [{"speaker": r, "text": t} for r, t in own]}}
    return {"messages": [{"role": r, "content": t} for r, t in own]}


def _records(batches):
    """Rows in order of conversation and turn to JSON records of at most PART_TURNS turns; no conversation is held whole."""
    conv, part, own, size, begun = None, 0, [], 0, False

    def record():
        return json.dumps({"conversation_id": conv, "part": part} | _layout_of(conv, own), ensure_ascii=False)

    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if own and (c != conv or len(own) >= PART_TURNS or size >= PART_CHARS):
                out.append(record())
                part, own, size = part + 1 if c == conv else 0, [], 0
            elif begun and c != conv:
                part = 0
            conv, begun = c, True
            own.append((role, text))
            size += len(text or "")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([record()], pa.string())], ["record"])


def as_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """JSON records of rows that hold one turn each, in several layouts; a conversation's records follow one another in one partition.

    Turns are ordered by number, then role and text. A long conversation has several records, in parts of bounded size.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("n"), F.col(role_col).alias("r"), F.col(text_col).alias("t"))
    rows = rows.repartition(F.col("c")).sortWithinPartitions("c", "n", "r", "t")
    return rows.select("c", "r", "t").mapInArrow(_records, "record string")


BACKREAD = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self, conv):
        self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str | None, spans: list[dict] | None) -> None:
        if formatted is None or self.n is None:
            self.n = None
            return
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for x in spans:
            text = unescape(formatted[x["a"] : x["b"]])
            self.loss += len(text)
            self.masked.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        if self.n is None:
            return (self.conv, *[None] * 5)
        return self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def _digests(batches):
    now, kinds = None, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], [x.split()[0] for x in BACKREAD.split(", ")])

    for batch in batches:
        out = []
        for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Digest(conv)
            now.add(formatted, spans)
        yield batch_of(out)
    if now is not None:
        yield batch_of([now.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """What format_records() made of each conversation, read from its output: turns, their digest, the text under the loss mask and its digest.

    A conversation with a part that has no format is null but for its id.
    formatted must hold a conversation's parts in order, in one partition, as as_records() leaves them; a conversation of any length is read as a stream.
    """
    return formatted.select("conversation_id", "formatted", "loss").mapInArrow(_digests, BACKREAD)
