"""Chat formatting from a declarative template, with loss flags and a finite-state check of turn order.

``format_turns`` turns each row into its formatted text and the span of it that carries loss; control strings inside a
text are escaped with a backslash. ``streams`` strings the turns of a conversation together and emits the stream as
segments with a loss flag each: an assistant's text is a segment by itself, and what stands between two such texts is one
segment, over the borders of turns. ``read_back`` gets nothing but segments. It finds the turns again at the marks that are
not escaped, runs the role automaton and sums each conversation up.

Both stream over sorted partitions and hold a turn or a segment and hash states, never a whole conversation, so a
conversation of any length fits. A digest of a text is sequential by nature, so a conversation is one task's; all
formatting runs before the shuffle, in parallel.

Defined results: null text or role count as empty; rows go by turn (null first), then by formatted text;
repeated rows stay; an unknown role is kept, formatted in brackets and fails validation; all rows of a null conv_id are
one conversation (and one task's); a stream that doesn't end with a whole turn is not valid, and the rest isn't counted
as a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, table

TEMPLATE = {
    "roles": {
        "system": {"header": "### System:\n", "loss": False},
        "user": {"header": "### User:\n", "loss": False},
        "assistant": {"header": "### Assistant:\n", "loss": True},
    },
    "other": {"open": "### [", "close": "]:\n", "loss": False},
    "footer": "</turn>\n",
    "control": ["###", "</turn>"],
    "states": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "final": ["user", "assistant"],
}
SEGMENT_TURNS = 1000  # turns without loss that make one segment at most


class Formatter:
    """Compiled template."""

    def __init__(self, template: dict):
        self.t = template
        marks = "|".join(map(re.escape, ["\\", *template["control"]]))
        self.mark, self.unmark = re.compile(marks), re.compile(rf"\\({marks})")
        self.any = tuple(["\\", *template["control"]])
        self.headers = [(spec["header"], role, spec["loss"]) for role, spec in template["roles"].items()]
        self.role_of = {head: role for head, role, _ in self.headers}
        known, o = "|".join(re.escape(h) for h in self.role_of), template["other"]
        self.head = re.compile(rf"({known})|{re.escape(o['open'])}((?:[^\]\\]|\\.)*){re.escape(o['close'])}", re.S)
        self.end = re.compile(rf"\\(?:{marks})|({re.escape(template['footer'])})")

    def escape(self, text: str) -> str:
        return self.mark.sub(lambda m: "\\" + m[0], text) if any(a in text for a in self.any) else text

    def unescape(self, text: str) -> str:
        return self.unmark.sub(r"\1", text) if "\\" in text else text

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """Formatted turn, and the span of it under the loss mask (empty where there is none)."""
        spec = self.t["roles"].get(role)
        if spec:
            head, loss = spec["header"], spec["loss"]
        else:
            o = self.t["other"]
            head, loss = f"{o['open']}{self.escape(role).replace(']', '\\]')}{o['close']}", o["loss"]
        body = self.escape(text)
        return head + body + self.t["footer"], len(head), len(head) + len(body) * loss

    def parse(self, formatted: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        body = formatted[: len(formatted) - len(self.t["footer"])]
        for head, role, _ in self.headers:
            if body.startswith(head):
                return role, self.unescape(body[len(head) :])
        o = self.t["other"]
        rest = body[len(o["open"]) :]
        end = re.match(r"(?:[^\]\\]|\\.)*", rest, re.S).end()
        return self.unescape(rest[:end].replace("\\]", "]")), self.unescape(rest[end + len(o["close"]) :])


    def turns(self, text: str) -> tuple[list[tuple[str, str]], str]:
        """(role, text) of the whole turns that a stream starts with, and the rest of it."""
        out, at = [], 0
        while head := self.head.match(text, at):
            stop = next((m for m in self.end.finditer(text, head.end()) if m[1]), None)
            if stop is None:
                break
            role = self.role_of[head[1]] if head[1] else self.unescape(head[2].replace("\\]", "]"))
            out.append((role, self.unescape(text[head.end() : stop.start()])))
            at = stop.end()
        return out, text[at:]


def format_turns(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end (code points) of every row."""
    f = Formatter(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [f.turn(r or "", t or "") for r, t in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True)]
            a, s, e = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["conv_id"].cast(pa.int64()), b["turn"].cast(pa.int64()), pa.array(a, pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return rows.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def streams(turns: DataFrame) -> DataFrame:
    """conv_id, seg, text, loss: each conversation as one stream of text in segments."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seg, plain, out = None, 0, [], []

        def put(text: str, loss: bool) -> None:
            nonlocal seg
            if text:
                out.append((now[0], seg, text, loss))
                seg += 1

        for b in batches:
            for conv, text, s, e in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["loss_start"].to_pylist(), b["loss_end"].to_pylist(), strict=True):
                if now != (conv,):
                    put("".join(plain), False)
                    now, seg, plain = (conv,), 0, []
                if e > s:
                    put("".join([*plain, text[:s]]), False)
                    put(text[s:e], True)
                    plain = [text[e:]]
                else:
                    plain.append(text)
                if len(plain) >= SEGMENT_TURNS:
                    put("".join(plain), False)
                    plain = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "seg", "text", "loss"])
                out.clear()
        put("".join(plain), False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "seg", "text", "loss"])

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.mapInArrow(run, "conv_id long, seg long, text string, loss boolean")


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation, from the segments of its stream alone."""
    f = Formatter(template)
    states, final = template["states"], set(template["final"])
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    class Conversation:
        def __init__(self, conv: int | None):
            self.conv, self.n, self.chars, self.loss_chars, self.state, self.ok, self.rest = conv, 0, 0, 0, "start", True, ""
            self.said, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, text: str, loss: bool) -> None:
            self.chars += len(text)
            if loss:
                said = f.unescape(text)
                self.loss_chars += len(said)
                self.loss.update(said.encode())
            found, self.rest = f.turns(self.rest + text)
            for role, said in found:
                self.n += 1
                self.said.update(f"{role}\n{said}\n".encode())
                self.ok = self.ok and role in states.get(self.state, ())
                self.state = role

        def row(self) -> list:
            return [self.conv, self.n, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.ok and self.state in final and not self.rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for conv, text, loss in zip(b["conv_id"].to_pylist(), b["text"].to_pylist(), b["loss"].to_pylist(), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        out.append(now.row())
                    now = Conversation(conv)
                now.add(text, loss)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), types, strict=True)], names)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


ship(__name__)


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(cut(streams(format_turns(rows.unionByName(extra))), "streams"))


_ESC = r"replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
SQL = {
    "op9_chat_format": f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
f AS (SELECT *, CASE role WHEN 'system' THEN '### System:' WHEN 'user' THEN '### User:' WHEN 'assistant' THEN '### Assistant:' ELSE '### [' || role || ']:' END || chr(10) || {_ESC} || '</turn>' || chr(10) AS formatted FROM rows),
g AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, formatted))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN role = 'assistant' THEN coalesce(before = 'user', false) WHEN role = 'user' THEN coalesce(before IN ('system', 'assistant'), true)
    WHEN role = 'system' THEN before IS NULL AND after IS NOT NULL ELSE false END) AS valid
FROM g GROUP BY conv_id"""
}
