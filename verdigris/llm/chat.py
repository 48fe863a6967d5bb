"""Conversations as training text: a compiled template, reversible escaping, and a loss mask.

Turns are marked by control strings. Inside texts every control string is broken by a backslash after its
first character (and backslashes are doubled), so a text can imitate no turn, and reading back is exact.
The loss mask covers what the template writes under its generation marker.

A conversation's turns are streamed in order through one task and rendered one by one, so memory does not grow with a
conversation. Its digest is sequential by nature; different conversations are independent.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import table
from verdigris.llm.template import Template

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")

#: Control strings, then role and text of each turn; what an assistant says is to be learned.
CHAT_TEMPLATE = (
    "{{ bos }}{% for m in messages %}[TURN]{{ m.role | line }}\n[/TURN]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ eos }}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}\n{% endfor %}"
)


def escape(text: str) -> str:
    """Text in which no control string occurs."""
    doubled = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", doubled)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_line(text: str) -> str:
    """Like ``escape``; line ends are told apart from the one that ends a role."""
    return escape(text.replace("\x1a", "\x1a\x1a").replace("\n", "\x1an"))


def unescape_line(text: str) -> str:
    return re.sub("\x1a(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


FILTERS = {"escape": escape, "line": escape_line, "trim": str.strip}


def chat_template(source: str = CHAT_TEMPLATE) -> Template:
    return Template(source, {"bos": "<s>", "eos": "</s>"}, FILTERS)


_PIECES = "conv_id long, seq long, formatted string, spans array<struct<start:int,end:int>>"


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order; equal turns are ordered by role and text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _stream(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c] for c in columns))


def _none(value):
    return None if value is None or value is pd.NA or value != value else value


def formatted(conversations: DataFrame, source: str = CHAT_TEMPLATE) -> DataFrame:
    """The formatted text of every conversation in pieces (``seq`` from 0) with the spans under the loss mask.

    The pieces of a conversation, joined in order, are its training text. Null roles and texts are empty; rows
    without a conversation id are one conversation; an empty table gives no rows; other columns are not read.
    """

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = chat_template(source)
        rows = []
        stream = _stream(batches, ["conv_id", "role", "text"])
        for conv_id, turns in groupby(stream, key=lambda r: _none(r[0])):
            messages = ({"role": _none(role) or "", "text": _none(text) or ""} for _, role, text in turns)
            for seq, out in enumerate(template.pieces(messages)):
                rows.append((conv_id, seq, out.text(), [{"start": s, "end": e} for s, e in out.spans]))
                if len(rows) >= 2000:
                    yield _frame(rows, ["conv_id", "seq", "formatted", "spans"])
                    rows = []
        if rows:
            yield _frame(rows, ["conv_id", "seq", "formatted", "spans"])

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return _ordered(turns).mapInPandas(rendered, _PIECES)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.assign(conv_id=pd.array([r[0] for r in rows], dtype="Int64"))


class Reader:
    """Reads turns back out of formatted text that arrives in parts."""

    def __init__(self):
        self.waiting = ""
        self.turns: list[tuple[str, str]] = []

    def feed(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of the turns completed by ``text``."""
        self.waiting += text
        done = []
        while (start := self.waiting.find("[TURN]")) >= 0:
            head = self.waiting.find("\n[/TURN]", start)
            if head < 0:
                break
            body = head + len("\n[/TURN]")
            asked = self.waiting.startswith("[INST]", body)
            body += len("[INST]") if asked else 0
            close = "[/INST]\n" if asked else "</s>\n"
            end = self.waiting.find(close, body)
            if end < 0:
                break
            role = unescape_line(self.waiting[start + len("[TURN]") : head])
            done.append((role, unescape(self.waiting[body:end])))
            self.waiting = self.waiting[end + len(close) :]
        return done


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of what the formatted pieces say, and of what their loss masks cover.

    ``pieces`` come as ``formatted`` leaves them: a conversation's rows together and in order.
    """

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        stream = _stream(batches, ["conv_id", "formatted", "spans"])
        for conv_id, parts in groupby(stream, key=lambda r: _none(r[0])):
            reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, text, spans in parts:
                chars += len(text)
                for role, said in reader.feed(text):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                for span in spans:
                    learned = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(learned)
                    loss.update(learned.encode("utf-8", "replace"))
            rows.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield _frame(rows, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return pieces.mapInPandas(folded, schema)


def with_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one more, -7, whose texts imitate control strings."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return conversations.unionByName(probe)


def format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(formatted(with_probe(spark, sf_dir)))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for word in CONTROL:
        out = f"replace({out}, '{word}', '{word[0]}\\{word[1:]}')"
    return out


def _sql() -> str:
    role = "coalesce(role, '')"
    line = _escaped_sql(f"replace(replace({role}, chr(26), chr(26) || chr(26)), chr(10), chr(26) || 'n')")
    frame = f"CASE WHEN {role} = 'assistant' THEN {len('</s>')} ELSE {len('[INST][/INST]')} END"
    per_turn = f"length({line}) + length({_escaped_sql('said')}) + {len('[TURN]' + chr(10) + '[/TURN]' + chr(10))} + {frame}"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS said, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', ''
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', ''
), folded AS (
  SELECT conv_id,
    count(*) AS n_turns,
    string_agg({role} || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, said) AS turns,
    coalesce(string_agg(said, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, said) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({per_turn}) + {len('<s>')} AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM folded
"""


SQL = _sql()
