r"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

Each turn becomes ``### Role: text </turn>`` and a line break. In texts,
``\`` is written ``\\``, ``###`` is written ``\h`` and ``</turn>`` is written
``\e``, so no text can pass for a control string and every text comes back.

Turns are taken in order. Prefix sums of their token counts choose the longest
span of new turns that fits the budget beside the retained system turn and a
repeated history of the last turns of at most ``history`` tokens. A turn is
never cut: one that is over the budget gets a window of its own. The loss mask
covers the texts of new assistant turns only, so each target counts once.

A conversation's rows meet in one task, as order and digests demand, but are
streamed: a task holds the system turn, one window and one history, never a
whole conversation.

Rows: ordered by turn; ties by role, then text. Null roles and texts count as
empty; a null conversation id is a conversation of its own; repeated rows are
repeated turns. An empty table gives no windows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMES = {v: k for k, v in ROLES.items()}
CODES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", ":": "\\c", "\n": "\\n"}
BACK = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":", "n": "\n"}
TURN = re.compile(r"### ((?:[^:\\\n]|\\.)*): (.*?) </turn>\n", re.S)
TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return re.sub(r"\\|###|</turn>", lambda m: CODES[m[0]], text)


def escape_role(role: str) -> str:
    """Known roles get their display name; any other is written after \\x, with : and line breaks escaped too."""
    return ROLES.get(role) or "\\x" + re.sub(r"\\|###|</turn>|:|\n", lambda m: CODES[m[0]], role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text)


def unescape_role(name: str) -> str:
    return unescape(name[2:]) if name.startswith("\\x") else NAMES[name]


def piece(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    head, body = f"### {escape_role(role)}: ", escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def tokens(formatted: str) -> int:
    return sum(1 for _ in TOKEN.finditer(formatted))


class Windows:
    """Windows of one conversation, whose turns come one by one."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.opening, self.past, self.new, self.used, self.seen, self.made = None, None, [], [], 0, 0, 0

    def fixed(self) -> list[tuple]:
        return ([self.system] if self.system else []) + self.past

    def add(self, role: str, text: str) -> Iterator[dict]:
        formatted, start, end = piece(role, text)
        turn = (formatted, start, end, role == "assistant", tokens(formatted))
        if self.new and self.used + turn[4] > self.budget:
            yield self.window()
        if not self.new:
            self.used = sum(x[4] for x in self.fixed())
            while self.past and self.used + turn[4] > self.budget:
                self.used -= self.past.pop(0)[4]
        self.new.append(turn)
        self.used += turn[4]
        if self.seen == 0 and role == "system":
            self.opening = turn
        self.seen += 1

    def window(self) -> dict:
        repeated, at, loss, text = self.fixed(), 0, [], []
        for k, (formatted, start, end, target, _) in enumerate(repeated + self.new):
            if target and k >= len(repeated):
                loss.append({"start": at + start, "end": at + end})
            text.append(formatted)
            at += len(formatted)
        row = {"window": self.made, "first_turn": self.seen - len(self.new), "n_new": len(self.new), "n_repeated": len(repeated), "tokens": self.used, "text": "".join(text), "loss": loss}
        self.made += 1
        self.system = self.opening
        later = [t for t in self.past + self.new if t is not self.system]
        sums = list(accumulate(t[4] for t in reversed(later)))
        fit = sum(s <= self.history for s in sums)
        self.past = later[len(later) - fit :]
        self.new, self.used = [], 0
        return row


WINDOW = "window int, first_turn long, n_new int, n_repeated int, tokens long, text string, loss array<struct<start: long, end: long>>"


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def together(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A conversation's rows in one task, in order; the sort spills, so no group is ever held."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, *order)


def format_chats(turns: DataFrame, budget: int = 512, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv, window, first_turn, n_new, n_repeated (leading turns that were there before), tokens, text, loss (code point spans)."""
    if budget < 1 or history < 0:
        raise ValueError("budget must be positive and history not negative")
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([T.StructField("conv", turns.schema[conv_col].dataType)] + T._parse_datatype_string(WINDOW).fields)
    schema = to_arrow_schema(kind)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, out, held = None, None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if windows is None or conv != now:
                    if windows is not None and windows.new:
                        out.append({"conv": now} | windows.window())
                    now, windows = conv, Windows(budget, history)
                for row in windows.add(role, text):
                    out.append({"conv": now} | row)
                    held += len(row["text"])
                if len(out) >= 2000 or held > 1 << 22:
                    yield as_batch(out, schema)
                    out, held = [], 0
        if windows is not None and windows.new:
            out.append({"conv": now} | windows.window())
        if out:
            yield as_batch(out, schema)

    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return together(rows, "conv", ["turn", "role", "text"]).mapInArrow(of, kind)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    at = 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        yield unescape_role(m[1]), unescape(m[2])
    if at != len(text):
        raise ValueError("text after the last turn")


class Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, repeated: int, text: str, loss: list[dict]) -> None:
        for k, (role, said) in enumerate(parse(text)):
            if k >= repeated:
                self.turns.update(f"{role}\n{said}\n".encode())
                self.n_turns += 1
        for span in loss:
            said = unescape(text[span["start"] : span["end"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.formatted_chars += len(text)

    def row(self) -> dict:
        return {"n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars}


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from windows: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([T.StructField("conv", windows.schema["conv"].dataType)] + T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields)
    schema = to_arrow_schema(kind)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for conv, repeated, text, loss in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        out.append({"conv": now} | digest.row())
                    now, digest = conv, Digest()
                digest.add(repeated, text, loss)
            if len(out) >= 2000:
                yield as_batch(out, schema)
                out = []
        if digest is not None:
            out.append({"conv": now} | digest.row())
        if out:
            yield as_batch(out, schema)

    return together(windows.select("conv", "window", "n_repeated", "text", "loss"), "conv", ["window"]).mapInArrow(of, kind)
