"""Chat formatting that survives a grammar round trip.

A turn is rendered as a marker with its role, the text, and an end mark on a line of its own:

    ### Assistant: text
    </turn>

The rendered turn is read back by a deterministic parser. Where what comes back is not the one
turn that went in, the text holds control strings: they are escaped (a backslash before each,
beside those already there) and the turn is read again, until it is identical. The parser takes
one backslash off every control string that has any before it, so a text that happens to look
escaped is a conflict, too. A turn that reads back alone reads back the same in a conversation,
since its end is certain; conversations are thus rendered turn by turn, on all executors, and
``digests`` reads the text of the whole conversation back as a stream, without knowing where a
turn was. Work grows with a text's length, whatever is in it.

Null texts and null roles count as empty; turns are in order of turn (nulls first), then role,
then text; repeated rows are repeated turns. Very long texts are rendered whole. A conversation
without rows does not exist; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.llm.tables import table

START, END = "### ", "</turn>"
#: Names in markers; any other role is spelled after an equals sign, in hexadecimal.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_BY_NAME = {v: k for k, v in ROLES.items()}
_HEAD = re.compile(r"### (?:(System|User|Assistant)|=([0-9a-f]*)): ")
#: A run of backslashes is tried from its start only, and as a whole.
_CONTROL = re.compile(r"(?<!\\)(\\*+)(### |</turn>)")
#: The role whose texts a model learns to write.
LOSS_ROLE = "assistant"


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescaped(body: str) -> str:
    return _CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], body)


def _render(role: str, body: str) -> str:
    name = ROLES.get(role) or "=" + role.encode().hex()
    return f"{START}{name}: {body}\n{END}\n"


class Reader:
    """Reads turns from a stream of text, cut anywhere."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, start and end of its body in what was held) of each turn that ends in the text so far."""
        text, at = self.rest + piece, 0
        while at < len(text):
            head = _HEAD.match(text, at)
            stop = text.find(f"\n{END}\n", head.end()) if head else -1
            if stop < 0:
                break
            body = text[head.end() : stop]
            if _unsafe(body):
                raise ValueError("a control string without an escape")
            role = _BY_NAME[head[1]] if head[1] else bytes.fromhex(head[2]).decode("utf-8", "surrogatepass")
            yield role, unescaped(body), head.end(), stop
            at = stop + len(END) + 2
        self.rest = text[at:]

    def close(self) -> None:
        if self.rest:
            raise ValueError("the text ends within a turn")


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of its body) of each turn; None if the text isn't a row of turns."""
    reader = Reader()
    try:
        turns = list(reader.feed(formatted))
        reader.close()
    except ValueError:
        return None
    return turns


def _unsafe(body: str) -> bool:
    """A control string without an escape inside a body."""
    return any(not m[1] for m in _CONTROL.finditer(body))


def render(role: str | None, text: str | None) -> tuple[str, int]:
    """The rendered turn and how often its text was escaped."""
    role, text = role or "", text or ""
    body, times = text, 0
    while True:
        formatted = _render(role, body)
        turns = parse(formatted)
        if turns is not None and [t[:2] for t in turns] == [(role, text)]:
            return formatted, times
        if times == 2:
            raise ValueError("a turn does not survive its round trip")
        body, times = escaped(text) if times == 0 else escaped(body), times + 1


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, escapes: every turn rendered and read back."""

    @F.pandas_udf("formatted string, escapes int")
    def of(role: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([render(r, t) for r, t in zip(role, text, strict=True)], columns=["formatted", "escapes"])

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("made", of("role", "text")).select("conv_id", "turn", "role", "text", "made.*")


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end of each text to learn, in code points) from format_turns()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.int64()))
        held: tuple[object, list[str]] | None = None

        def out() -> pa.RecordBatch:
            formatted = "".join(held[1])
            spans = [[a, b] for role, _, a, b in parse(formatted) if role == LOSS_ROLE]
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([formatted]), pa.array([spans], kind)], ["conv_id", "formatted", "loss_spans"])

        for b in batches:
            for conv, text in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        yield out()
                    held = (conv, [])
                held[1].append(text)
        if held is not None:
            yield out()

    return _in_order(turns).select("conv_id", "formatted").mapInArrow(run, "conv_id long, formatted string, loss_spans array<array<long>>")


def digests(turns: DataFrame) -> DataFrame:
    """What reading each conversation's formatted text back gives: memory holds one turn of it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def close() -> None:
            state["reader"].close()
            done.append((conv, state["n"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

        for b in batches:
            for own, formatted in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), strict=True):
                if state is None or own != conv:
                    if state is not None:
                        close()
                    conv, state = own, {"n": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "reader": Reader()}
                for role, text, _, _ in state["reader"].feed(formatted):
                    state["n"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == LOSS_ROLE:
                        state["chars"] += len(text)
                        state["loss"].update(text.encode("utf-8", "surrogatepass"))
                state["size"] += len(formatted)
            if done:
                yield out()
        if state is not None:
            close()
        if done:
            yield out()

    return _in_order(turns).select("conv_id", "formatted").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(format_turns(rows.union(extra)))
