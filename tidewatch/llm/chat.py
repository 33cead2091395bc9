r"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " ROLE ": " BODY "\n</turn>\n"

ROLE is percent-encoded outside [A-Za-z0-9_-]. In a BODY the control strings ``### `` and ``</turn>`` are
only allowed behind a backslash. Rendering starts with the plain texts; the deterministic parser reads the
result back; turns that do not come back as they were get one backslash in front of each control string
(and of the backslashes before it), until the recovered turns equal the source. Reading takes that
backslash off again.

Defined results
* null text: the empty text; null role: the empty role; null turn: sorted last;
* turns with the same number are ordered by role and text; repeated rows stay repeated;
* null conv_id: one conversation of its own; empty table: empty result;
* a conversation is one output record, so it must fit one, however many turns; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship_package

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_HEADER = re.compile(r"### ([A-Za-z0-9_%.~-]*): ")
_ESCAPED = re.compile(r"\\(\\*)(### |</turn>)")

Turn = tuple[str, str]


class NotInGrammar(ValueError):
    """The text is not a rendered conversation."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(body: str) -> str:
    return _ESCAPED.sub(r"\1\2", body)


def render_turn(role: str, body: str) -> str:
    return f"{OPEN}{quote(role, safe='')}: {body}\n{CLOSE}\n"


def parse(rendered: str) -> list[tuple[str, int, int]]:
    """(role, body start, body end) of each turn; raises NotInGrammar."""
    turns, at = [], 0
    while at < len(rendered):
        header = _HEADER.match(rendered, at)
        if not header:
            raise NotInGrammar(at)
        start = at = header.end()
        for control in _CONTROL.finditer(rendered, start):
            if not control[1]:
                break
        else:
            raise NotInGrammar(start)
        end = control.start(2) - 1
        if control[2] != CLOSE or end < start or rendered[end] != "\n" or rendered[control.end():control.end() + 1] != "\n":
            raise NotInGrammar(end)
        turns.append((unquote(header[1]), start, end))
        at = control.end() + 1
    return turns


def read_back(rendered: str) -> list[Turn]:
    return [(role, unescape(rendered[a:b])) for role, a, b in parse(rendered)]


def _comes_back(rendered: str, turns: list[Turn]) -> bool:
    try:
        return read_back(rendered) == turns
    except NotInGrammar:
        return False


def render(turns: list[Turn]) -> str:
    """Render, reparse, escape what conflicts, until the turns come back unchanged."""
    bodies = [text for _, text in turns]
    rendered = "".join(render_turn(role, body) for (role, _), body in zip(turns, bodies))
    while not _comes_back(rendered, turns):
        conflicts = [i for i, turn in enumerate(turns)
                     if bodies[i] == turn[1] and not _comes_back(render_turn(turn[0], bodies[i]), [turn])]
        if not conflicts:
            raise NotInGrammar("turns can't be rendered")
        for i in conflicts:
            bodies[i] = escape(turns[i][1])
        rendered = "".join(render_turn(role, body) for (role, _), body in zip(turns, bodies))
    return rendered


def loss_spans(rendered: str, trained_role: str = "assistant") -> list[tuple[int, int]]:
    """Where in the rendered text the loss applies: the bodies of the trained role."""
    return [(a, b) for role, a, b in parse(rendered) if role == trained_role]


_FORMATTED = "conv_id long, formatted string, loss array<struct<start:int,end:int>>"


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted text and loss spans (code points) of each conversation."""
    ship_package(rows.sparkSession)
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select(F.col("conv_id").cast("long"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column(1).to_pylist():
                text = render([(t["role"], t["text"]) for t in turns])
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in loss_spans(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["conv_id", "formatted", "loss"])

    return grouped.mapInArrow(work, _FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss spans give when they are read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The extra conversation whose texts hold the control strings themselves.
TRAP_TEXT = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + length(text) + len(regexp_extract_all(text, '### |</turn>')) + 9) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
