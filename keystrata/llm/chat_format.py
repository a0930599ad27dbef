"""Chat formatting: conversations rendered through a compiled template, with loss masks, and read back.

Turns of a conversation are brought together by a shuffle on its id and sorted inside their partition (the sort
spills); rendering and reading back are streams that hold one turn, so a conversation of any length stays in bounded
memory. A digest of a conversation is sequential by nature, so its turns can't be split over tasks.

Defined results: null text and null role count as empty; a null conversation id is a conversation of its own; turns go
by turn (null first), then role, then text, so ties and repeated rows have one order and all count; an empty table
gives no rows (the query still has conversation -1). Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_template import Template, unescape
from .common import slices, table

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>{{ '\\n' }}{% endfor %}"
)


class Reader:
    """Reads a formatted conversation back, piece by piece; holds the part of it that isn't a whole turn yet."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.pieces: list[str] = []
        self.masked: list[str] = []

    def feed(self, piece: str, masked: bool) -> None:
        self.formatted_chars += len(piece)
        if masked:
            self.masked.append(piece)
        elif self.masked:
            self.close_mask()
        self.pieces.append(piece)
        if END in piece:
            self.read_turns()

    def close_mask(self) -> None:
        text = unescape("".join(self.masked))
        self.masked.clear()
        self.loss_chars += len(text)
        self.loss.update(text.encode("utf-8", "surrogatepass"))

    def read_turns(self) -> None:
        *whole, rest = "".join(self.pieces).split(END)
        for turn in whole:
            head, role_and_text = turn.split(START, 1)
            role, text = role_and_text.split(SEPARATOR, 1)
            if head:
                raise ValueError("text stands outside the turns")
            self.n_turns += 1
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
        self.pieces[:] = [rest] if rest else []

    def result(self) -> tuple:
        if self.pieces:
            raise ValueError("the last turn is not whole")
        if self.masked:
            self.close_mask()
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _ordered(conversations: DataFrame) -> DataFrame:
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterable[dict]]]:
    """Each conversation with its messages as a stream."""
    rows = (
        (conv, {"role": role, "text": text})
        for piece in slices(batches)
        for conv, role, text in zip(*(piece.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)
    )
    for conv, group in groupby(rows, key=lambda r: r[0]):
        yield conv, (message for _, message in group)


def _by_conversation(conversations: DataFrame, handle: Callable, schema: str, kinds: list[pa.DataType], names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for conv, messages in _turns(batches):
            row, weight = handle(messages)
            rows.append((conv, *row))
            size += weight
            if len(rows) >= 1000 or size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _ordered(conversations).mapInArrow(run, schema)


def format_chat(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, and loss_spans: the parts of ``formatted`` under the loss mask, in code points."""
    compiled: list[Template] = []

    def handle(messages: Iterable[dict]) -> tuple[tuple, int]:
        compiled[:] = compiled or [Template(template)]
        text, spans = compiled[0].text(messages)
        return (text, [{"start": a, "end": b} for a, b in spans]), len(text)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds, names = [pa.int64(), pa.string(), span], ["conv_id", "formatted", "loss_spans"]
    return _by_conversation(conversations, handle, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>", kinds, names)


def chat_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Each conversation is rendered, and what is written is read back as a stream; gives digests of what was read."""
    compiled: list[Template] = []

    def handle(messages: Iterable[dict]) -> tuple[tuple, int]:
        compiled[:] = compiled or [Template(template)]
        reader = Reader()
        compiled[0].render(messages, reader.feed)
        return reader.result(), 0

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return _by_conversation(conversations, handle, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", kinds, names)


#: Fixed values of the contract: a conversation whose texts hold control strings.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in EXTRA) + " AS t(conv_id, turn, role, text)")
    return chat_digests(own.unionByName(extra))


ORACLE_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, 33 + length(role) + length(text)
        + len(regexp_extract_all(role || ' ' || text, '<\\*(?:s>|/s>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|user\|>|\|assistant\|>|\|system\|>|\|end\|>)|\[\\*(?:INST\]|/INST\])')) AS chars
    FROM turns
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
