r"""Chat formatting with a grammar round trip.

Grammar of the output: conversation = turn*, turn = "<|im_start|>" role LF text "<|im_end|>" LF. A control string is
"<|" and what follows; roles and texts are escaped by one more backslash in every "<", backslashes, "|", so that
neither can hold a control string, and the escape is undone by one backslash less. In a role, a line feed is written
"<\n|" and treated alike. Each turn is first rendered as it is; the deterministic parser reads it again, and where role
or text differ from the source, the conflicting content is escaped until they are identical.

Defined results: null texts and roles count as empty, null conversation ids form a conversation of their own, rows are
ordered by turn (null first), ties by role and text, repeated rows stay repeated turns; an empty table gives an empty
table. A conversation's rows are sorted and streamed, so that one of any length needs the memory of one turn for its
digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemello.llm.text import through

START, END = "<|im_start|>", "<|im_end|>"
_CONFLICT = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_CONFLICT = re.compile(r"<(\\*n?)\|")
_ROLE_ESCAPED = re.compile(r"<\\(\\*n?)\|")


class GrammarError(ValueError):
    """A text doesn't follow the grammar."""


def escape(text: str) -> str:
    return _CONFLICT.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return _ROLE_CONFLICT.sub(r"<\\\1|", role).replace("\n", "<n|")


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(r"<\1|", role.replace("<n|", "\n"))


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, both unescaped; start and end bound the text as it stands in the output."""
    at, n = 0, len(formatted)
    while at < n:
        if not formatted.startswith(START, at):
            raise GrammarError(f"no turn begins at {at}")
        line = formatted.find("\n", at)
        lo = line + 1
        hi = formatted.find(END, lo) if line >= 0 else -1
        role = formatted[at + len(START) : line]
        if hi < 0 or "<|" in role or formatted.find("<|", lo) != hi or formatted[hi + len(END) : hi + len(END) + 1] != "\n":
            raise GrammarError(f"the turn at {at} isn't closed")
        yield unescape_role(role), unescape(formatted[lo:hi]), lo, hi
        at = hi + len(END) + 1


def turn(role: str, text: str) -> str:
    """A rendered turn that parses to exactly this role and text."""
    shown = (role, text)
    for write_role, write_text in ((str, str), (str, escape), (escape_role, escape)):
        shown = f"{START}{write_role(role)}\n{write_text(text)}{END}\n"
        try:
            if [x[:2] for x in parse(shown)] == [(role, text)]:
                return shown
        except GrammarError:
            continue
    raise GrammarError("the turn can't be rendered")


def rendered(turns: list[tuple[str, str]]) -> str:
    return "".join(turn(role, text) for role, text in turns)


def loss_spans(formatted: str, roles: tuple[str, ...] = ("assistant",)) -> list[tuple[int, int]]:
    """Where the output's characters count for the loss."""
    return [(lo, hi) for role, _, lo, hi in parse(formatted) if role in roles]


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role and text: each conversation in one partition, its turns in order."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
    """Conversations of a sorted partition, each as an iterator of turns."""
    import itertools

    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv, ((role, text) for _, role, text in own)


FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: the rendered text and the spans under the loss mask (code points, end exclusive)."""

    def run(batches):
        for conv, turns in _grouped(batches):
            text = rendered(list(turns))
            spans = [{"start": a, "end": b} for a, b in loss_spans(text)]
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "formatted": text, "loss_spans": spans}], schema=pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return through(_sorted_turns(conversations), run, FORMATTED)


def digests(conversations: DataFrame) -> DataFrame:
    """What the output of each conversation reads back as; turns are rendered, parsed again and digested one at a time."""
    names = [(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in DIGEST.fields]

    def run(batches):
        out = []
        for conv, turns in _grouped(batches):
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for role, text in turns:
                shown = turn(role, text)
                chars += len(shown)
                for got_role, got_text, _, _ in parse(shown):
                    n += 1
                    all_turns.update(f"{got_role}\n{got_text}\n".encode())
                    if got_role == "assistant":
                        loss_chars += len(got_text)
                        loss.update(got_text.encode())
            out.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), names, strict=True)], schema=pa.schema(names))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), names, strict=True)], schema=pa.schema(names))

    return through(_sorted_turns(conversations), run, DIGEST)
