"""Chat formatting with any template, treated as a black box.

The template is a function from a list of messages to a string. The operator renders the first
turn, the first two turns and so on. Where each output begins with the one before, the rest of it
is the new turn's span; where it does not, the template has rewritten history. A turn's text is
found inside its span by rendering once more with a stand-in character for the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import arrow
from linkrank.llm.registry import query
from linkrank.llm.stages import given_id, known_id, read

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

#: Strings that mean something to the model; none of them may come out of a text.
CONTROLS = ("<|turn|>", "<|text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
GUARD = "\u241b"
_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROLS))
_GUARDED = re.compile(f"{GUARD}({GUARD}?)")
_TURN = re.compile(re.escape("<|turn|>") + "(.*?)" + re.escape("<|text|>") + "(.*?)" + re.escape("</s>"), re.DOTALL)

#: One of these letters for private use stands for a text while its place is looked for.
STAND_INS = range(0xE000, 0xF900)


def escape(text: str) -> str:
    """Put the guard after the first letter of each control string, and double the guard itself."""
    text = text.replace(GUARD, GUARD * 2)
    return _CONTROL.sub(lambda m: m[0][0] + GUARD + m[0][1:], text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"\1", text)


def marked_turns(messages: list[Message]) -> str:
    """The default template: each turn with its role, its text and an end mark."""
    return "<s>" + "".join(f"<|turn|>{escape(role)}<|text|>{escape(text)}</s>" for role, text in messages)


def parse(formatted: str) -> list[Message]:
    """Roles and texts back from the default template's output."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _stand_in(out: str) -> str:
    """A letter that the rendered turns do not hold, neither in texts nor in roles; else nothing."""
    return next((chr(x) for x in STAND_INS if chr(x) not in out), "")


def _text_place(render: Template, before: list[Message], role: str, after: list[Message], out: str) -> tuple[int, int] | None:
    """Where a text begins in the rendered conversation, and how much follows it; None if the
    template shows it never or several times, or if something else depends on it."""
    letter = _stand_in(out)
    marks = render([*before, (role, letter), *after]) if letter else ""
    if not letter or marks.count(letter) != 1:
        return None
    at = marks.index(letter)
    rest = len(marks) - at - 1
    same = at + rest <= len(out) and marks[:at] == out[:at] and marks[at + 1 :] == out[len(out) - rest :]
    return (at, rest) if same else None


def locate(render: Template, messages: list[Message]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The formatted conversation; (span start, span end, text start, text end) of each turn; and
    whether the template rewrites history. Places are code points; -1 where a text is not found.
    """
    spans, before, rewrites = [], "", False
    for k, (role, _) in enumerate(messages):
        out = render(messages[: k + 1])
        if not out.startswith(before):
            rewrites = True
            break
        place = _text_place(render, messages[:k], role, [], out)
        spans.append((len(before), len(out), *((place[0], len(out) - place[1]) if place else (-1, -1))))
        before = out
    if not rewrites:
        return before, spans, False
    whole, spans = render(messages), []
    for k, (role, _) in enumerate(messages):
        place = _text_place(render, messages[:k], role, messages[k + 1 :], whole)
        spans.append((-1, -1, *((place[0], len(whole) - place[1]) if place else (-1, -1))))
    return whole, spans, True


_FORMATTED = (
    "conv bigint, formatted string, roles array<string>, spans array<struct<start:int,end:int,text_start:int,text_end:int>>, "
    "rewrites_history boolean"
)
_SPAN = pa.struct([(x, pa.int32()) for x in ("start", "end", "text_start", "text_end")])


def _render(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column(1).to_pylist():
                messages = [(t["role"], t["text"]) for t in turns]
                whole, spans, rewrites = locate(template, messages)
                out.append((whole, [m[0] for m in messages], spans, rewrites))
            texts, roles, spans, rewrites = zip(*out, strict=True) if out else ((), (), (), ())
            rows = [[dict(zip(_SPAN.names, s, strict=True)) for s in x] for x in spans]
            columns = [
                batch.column(0),
                pa.array(texts, pa.string()),
                pa.array(roles, pa.list_(pa.string())),
                pa.array(rows, pa.list_(_SPAN)),
                pa.array(rewrites, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "formatted", "roles", "spans", "rewrites_history"])

    return run


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = marked_turns,
) -> DataFrame:
    """One row per conversation: conv, formatted, roles, spans of turns and texts, rewrites_history.

    Turns are ordered by turn number, then role, then text, NULL first, so ties and repeated rows
    have a fixed order and each stays a turn. A NULL role or text is empty; rows with a NULL
    conversation id form one conversation. An empty table gives no rows; other columns are
    ignored. A conversation is one training example, so its turns meet in one task; different
    conversations never do more than share a partition.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = turns.select(known_id(conv_col).alias("conv"), turn.alias("turn"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return grouped.mapInArrow(_render(template), _FORMATTED)


def _read_back(loss_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                messages = parse(formatted)
                turns, loss, n_loss = hashlib.sha256(), hashlib.sha256(), 0
                for (role, text), span in zip(messages, spans, strict=True):
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == loss_role:
                        under_mask = unescape(formatted[span["text_start"] : span["text_end"]])
                        loss.update(under_mask.encode())
                        n_loss += len(under_mask)
                rows.append((len(messages), turns.hexdigest(), n_loss, loss.hexdigest(), len(formatted)))
            n_turns, turns, n_loss, loss, chars = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            columns = [
                batch.column(0),
                arrow.longs(n_turns),
                pa.array(turns, pa.string()),
                arrow.longs(n_loss),
                pa.array(loss, pa.string()),
                arrow.longs(chars),
            ]
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def digest(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Read conversations back from the default template's output; the loss mask covers the texts
    of ``loss_role``."""
    schema = "conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    found = formatted.select("conv", "formatted", "spans").mapInArrow(_read_back(loss_role), schema)
    return found.select(given_id("conv").alias("conv_id"), *found.columns[1:])


_TEST_TEXT = "</s>[INST] ok [/INST]"


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '{GUARD}', '{GUARD * 2}')"
    for x in CONTROLS:
        out = f"replace({out}, '{x}', '{x[0]}{GUARD}{x[1:]}')"
    return out


_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_TEST_TEXT}'), (-7, 1, 'assistant', '{_TEST_TEXT}')
), escaped AS (
  SELECT *, length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len("<|turn|><|text|></s>")} AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op3_chat_format", _SQL)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    test = [(-7, 0, "user", _TEST_TEXT), (-7, 1, "assistant", _TEST_TEXT)]
    extra = spark.createDataFrame(test, "conv_id bigint, turn bigint, role string, text string")
    return digest(format_conversations(rows.unionByName(extra)))
