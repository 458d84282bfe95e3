"""Chat formatting by a compiled template, and its exact reading back.

Rows of one conversation are sorted next to each other and stream through the compiled template, so memory holds a turn,
not a conversation. ``format_conversations`` returns the formatted texts with the spans to learn; ``digests`` reads the
pieces back by the marks alone and returns what it has read.

Defined cases: a null text or role is empty; null turns come first, equal turns by role and text; rows with a null
conversation id form one conversation with that id; rows repeated in full are turns of their own; an empty table gives
no rows; other columns are not read. Roles may hold any text: they are escaped like the rest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_escape import unescape
from .chat_template import compile_template
from .common import table

TEMPLATE = (
    "{% for message in messages %}<turn>{{ message.role | escape }}<says>"
    '{% if message.role == "assistant" %}{% generation %}{{ message.text | escape }}{% endgeneration %}'
    "{% else %}{{ message.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
_HEAD, _MID, _TAIL = "<turn>", "<says>", "</turn>\n"
#: A mark's first sign, not escaped: any pairs of backslash and sign before it are skipped as wholes.
_PLAIN = re.compile(r"(?:[^\\<]|\\.)*", re.S)


class Reader:
    """Reads formatted text that comes in pieces; knows only the marks. After each turn it calls back."""

    def __init__(self, turn):
        self.turn, self.held, self.spans, self.n = turn, "", [], 0

    def feed(self, text: str, learned: bool) -> None:
        if learned:
            self.spans.append((len(self.held), len(self.held) + len(text)))
        self.held += text
        self.n += len(text)
        if self.held.endswith(_TAIL):
            if not self.held.startswith(_HEAD):
                raise ValueError("a turn's head is missing")
            middle = _PLAIN.match(self.held, len(_HEAD)).end()
            start = middle + len(_MID)
            if self.held.startswith(_MID, middle) and (end := _PLAIN.match(self.held, start).end()) == len(self.held) - len(_TAIL):
                learned = [unescape(self.held[a:b]) for a, b in self.spans]
                role, said = unescape(self.held[len(_HEAD) : middle]), unescape(self.held[start:end])
                self.held, self.spans = "", []
                self.turn(role, said, learned)


def pieces(messages: Iterable[dict], template=None) -> Iterator[tuple[str, bool]]:
    return (template or compile_template(TEMPLATE))(messages=messages)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Neighbouring rows of one conversation, each group a lazy iterator that is to be used up before the next."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True)

    for conv, part in groupby(rows(), key=lambda r: r[0]):
        yield conv, ({"role": r[1], "text": r[2]} for r in part)


def _dealt(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    role = F.coalesce(F.col("role"), F.lit("")).alias("role")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, formatted, learned: array of (start, end) spans in code points."""

    def run(batches):
        render = compile_template(template)
        for conv, messages in _groups(batches):
            out, spans, n, turns = [], [], 0, 0

            def counted(messages=messages):
                nonlocal turns
                for m in messages:
                    turns += 1
                    yield m

            for text, learned in render(messages=counted()):
                if learned and text:
                    spans.append({"start": n, "end": n + len(text)})
                out.append(text)
                n += len(text)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "n_turns": turns, "formatted": "".join(out), "learned": spans}], _FORMATTED)

    return _dealt(conversations).mapInArrow(run, "conv_id long, n_turns long, formatted string, learned array<struct<start:long,end:long>>")


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("learned", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation, in memory bounded by a turn."""

    def run(batches):
        render = compile_template(TEMPLATE)
        rows = []
        for conv, messages in _groups(batches):
            turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0]

            def turn(role, text, learned, turns=turns, loss=loss, counts=counts):
                counts[0] += 1
                turns.update(f"{role}\n{text}\n".encode())
                for x in learned:
                    counts[1] += len(x)
                    loss.update(x.encode())

            reader = Reader(turn)
            for text, learned in render(messages=messages):
                reader.feed(text, learned)
            if reader.held:
                raise ValueError(f"conversation {conv}: the end of the formatted text can't be read back")
            rows.append({"conv_id": conv, "n_turns": counts[0], "turns_sha256": turns.hexdigest(), "loss_chars": counts[1], "loss_sha256": loss.hexdigest(), "formatted_chars": reader.n})
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist(rows, _DIGEST)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, _DIGEST)

    return _dealt(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


HARD = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return digests(rows.unionByName(hard))


SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD}' UNION ALL SELECT -7, 1, 'assistant', '{HARD}'
), x AS (
  SELECT *, regexp_replace(role, '([\\<])', '\\\1', 'g') AS r, regexp_replace(text, '([\\<])', '\\\1', 'g') AS t FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length('<turn><says></turn>') + 1 + length(r) + length(t)) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""
