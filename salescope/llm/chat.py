"""Chat formatting: records of different layouts become canonical turns, turns become marked text.

``canonical`` reads JSON records. The set of nested field paths of a record (list places written
``[]``), kept to the paths any layout names, is hashed; the hash selects a declarative layout, which
says where turns, roles and texts lie. A layout with optional fields is listed under the hash of
every combination of them. A record with paths of several layouts, whose hash is unknown, has the most
specific layout whose required paths are all there: the one with most of its paths there, then one
that requires some, then the first; further paths are ignored, but a top-level ``system`` text stays the first turn.

``format_turns`` writes one segment for each turn: a start mark with the role, the text, an end mark.
Control strings of this and other templates inside roles and texts are broken up by an escape
character after their first sign, and the escape character itself is doubled, so the segments of a
conversation in order form a text in which marks are only marks, and ``parse`` gives back every turn
exactly. The loss mask is the span of an assistant's text.

Defined results: a null or missing text is empty, a null role is empty; records without a known
layout, records that are no JSON objects and records nested too deeply for the parser have no turns and are given by
``unmatched``; a dot or bracket inside a key is part of that key, never a step of a path; a text
that is no string is written as JSON; half a surrogate pair in a
role or text is U+FFFD; turns keep the order of
their ``turn`` column (nulls first), then of their place in the record, then of role and text;
repeated rows are repeated turns. Extra columns are dropped by ``canonical``, which names its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import with_columns

ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``turns``: path of a list whose elements hold ``role`` and ``text``; or, without it, ``parts``: for each turn the
    role and the paths whose texts, joined by an empty line, form it. ``optional`` paths may be missing."""

    name: str
    turns: str | None = None
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.turns == "":
            return [self.role, self.text]
        if self.turns:
            return [f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        return [p for _, ps in self.parts for p in ps]


LAYOUTS = (
    Layout("turn row", turns="", role="role", text="text", optional=("role", "text")),
    Layout("messages", turns="messages", role="role", text="content", optional=("messages[].content",)),
    Layout("shared conversations", turns="conversations", role="from", text="value", optional=("conversations[].value",), roles=ROLES),
    Layout("nested chat", turns="chat.turns", role="speaker", text="utterance", optional=("chat.turns[].utterance",), roles=ROLES),
    Layout("prompt", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system", "completion")),
    Layout("prompt and response", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input", "output")),
    Layout("question", parts=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context", "answer")),
)


def _step(key: str) -> str:
    """A key as one step of a path: its own dots, brackets and backslashes are marked."""
    return re.sub(r"([\\.\[\]])", r"\\\1", key)


def field_paths(record: dict) -> set[str]:
    """Paths to the leaves and empty containers of a record."""
    found, open_ = set(), [(_step(k), v) for k, v in record.items()]
    while open_:
        at, value = open_.pop()
        if isinstance(value, dict) and value:
            open_ += [(f"{at}.{_step(k)}", v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            open_ += [(f"{at}[]", v) for v in value]
        else:
            found.add(at)
    return found


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "replace"), digest_size=8).hexdigest()


class Registry:
    def __init__(self, layouts=LAYOUTS):
        self.known = {p for layout in layouts for p in layout.paths()}
        self.layouts = tuple(layouts)
        self.by_print: dict[str, Layout] = {}
        for layout in layouts:
            fixed = [p for p in layout.paths() if p not in layout.optional]
            for n in range(len(layout.optional), -1, -1):
                for some in combinations(layout.optional, n):
                    if fixed or some:
                        self.by_print.setdefault(fingerprint([*fixed, *some]), layout)

    def turns(self, source: bytes) -> tuple[str | None, str | None, list[tuple[str, str]]]:
        """Fingerprint, layout and (role, text) of each turn."""
        try:
            record = json.loads(source)
            return self._turns(record) if isinstance(record, dict) else (None, None, [])
        except (ValueError, RecursionError):  # no JSON, or nested too deeply to be read
            return None, None, []

    def _turns(self, record: dict) -> tuple[str | None, str | None, list[tuple[str, str]]]:
        paths = field_paths(record) & self.known
        key = fingerprint(paths)
        layout = self.by_print.get(key) or self._nearest(paths)
        if layout is None:
            return key, None, []
        if layout.turns is None:
            out = []
            for role, paths in layout.parts:
                texts = [_text(record[p]) for p in paths if record.get(p) is not None]
                if texts:
                    out.append((role, "\n\n".join(texts)))
            return key, layout.name, out
        items = [record]
        if layout.turns:
            items = record
            for step in layout.turns.split("."):
                items = items[step]
        head = [("system", _text(record["system"]))] if layout.turns and "system" in paths and record["system"] is not None else []
        return key, layout.name, head + [(layout.roles.get(r := _text(i.get(layout.role)), r), _text(i.get(layout.text))) for i in items if isinstance(i, dict)]

    def _nearest(self, paths: set[str]) -> Layout | None:
        def rank(layout: Layout) -> tuple[int, bool]:
            fixed = set(layout.paths()) - set(layout.optional)
            return (len(paths.intersection(layout.paths())), bool(fixed)) if fixed <= paths else (0, False)

        best = max(self.layouts, key=rank, default=None)
        return best if best and rank(best)[0] else None


_HALF = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    """A value as text; half a surrogate pair, which JSON can write but no UTF-8 text can hold, is U+FFFD."""
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return _HALF.sub("\ufffd", text)


def _read(records: DataFrame, record: str, conv_id: str, turn: str, layouts) -> DataFrame:
    """(conv_id, turn, record, schema_print, layout, turns) of each JSON record."""

    def start():
        registry = Registry(layouts)

        def rows(batch):
            got = [registry.turns(t) for t in batch]
            return [g[0] for g in got], [g[1] for g in got], [[{"role": r, "text": t} for r, t in g[2]] for g in got]

        return rows

    own = records.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(record).alias("record"))
    return with_columns(own, "record", [("schema_print", "string"), ("layout", "string"), ("turns", "array<struct<role:string,text:string>>")], start)


def canonical(records: DataFrame, *, record: str = "record", conv_id: str = "conv_id", turn: str = "turn", layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, place, layout, role, text): one row for each turn of each JSON record."""
    read = _read(records, record, conv_id, turn, layouts)
    return read.select("conv_id", "turn", "layout", F.posexplode("turns").alias("place", "t")).select("conv_id", "turn", "place", "layout", "t.role", "t.text")


def unmatched(records: DataFrame, *, record: str = "record", conv_id: str = "conv_id", turn: str = "turn", layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, record, schema_print): the records that no layout reads, of which ``canonical`` has no turns."""
    return _read(records, record, conv_id, turn, layouts).where(F.col("layout").isNull()).select("conv_id", "turn", "record", "schema_print")


TURN, STOP = "<|turn|>", "<|stop|>"
ESCAPE = "␛"
#: Marks of this template and of others: none may stand unbroken in a role or text.
CONTROLS = (TURN, STOP, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>",
            "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<start_of_turn>", "<end_of_turn>")
_CONTROL = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)


def escaped(text: Column) -> Column:
    """Doubles the escape character and puts one behind the first sign of each control string."""
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), f"({_CONTROL})", "$1" + ESCAPE)


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}(.?)", lambda m: ESCAPE if m[1] == ESCAPE else m[1], text, flags=re.DOTALL) if ESCAPE in text else text


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (role, text and others) with ``segment`` and, for an assistant's turn, the span ``loss_start``,
    ``loss_end`` of its text in the segment. Role and text no longer stand beside it."""
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(ESCAPE + "\n"))
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    text = escaped(F.coalesce("text", F.lit("")))
    end = F.when(F.col("role") == "assistant", F.char_length("__head") + F.char_length("__text"))
    return (turns.withColumns({"__head": head, "__text": text})
            .withColumns({"segment": F.concat("__head", "__text", F.lit(STOP + "\n")), "loss_start": F.when(end.isNotNull(), F.char_length("__head")), "loss_end": end})
            .drop("__head", "__text", "role", "text"))


_SEGMENT = re.compile(f"{re.escape(TURN)}((?:[^\n{ESCAPE}]|{ESCAPE}.)*)\n(.*?){re.escape(STOP)}\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn starts at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out
