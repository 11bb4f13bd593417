"""Chat formatting with offset-aligned loss masks.

A conversation becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control strings inside
texts and roles are escaped: a backslash is doubled and ``<|`` becomes ``<\\|`` (in roles, a line end
becomes ``\\n``), so no text can open or close a turn, and unescaping gives the text back.

Turns are sorted over all partitions and rendered in blocks of whole turns: a conversation is one
block unless it is very long or a partition ends inside it. Control strings are tokens of their own
and nothing merges across them, so blocks have the tokens that the whole conversation has. A block
is encoded once, with offsets; the assistants' text spans are intersected with the token spans by
binary search, which gives the token mask and the characters under it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path
from .encoding import encoder

START, END = "<|im_start|>", "<|im_end|>"
#: Characters of a block.
BLOCK = 1_000_000
FORMATTED = "conv_id bigint, part int, block bigint, n_turns int, formatted string, ids array<int>, mask array<tinyint>, loss_spans array<struct<a:int,b:int>>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted block."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def render(block: list[tuple[str, str]], roles: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted turns, and the spans of the texts of ``roles``."""
    out, spans, at = [], [], 0
    for role, text in block:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role in roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def intersect(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask of the tokens that cover characters of ``spans``, and the characters that both cover."""
    mask, found = np.zeros(len(tokens), np.int8), []
    for a, b in spans:
        lo, hi = np.searchsorted(tokens[:, 1], a, "right"), np.searchsorted(tokens[:, 0], b, "left")
        if a < b and lo < hi:
            mask[lo:hi] = 1
            found.append((max(a, int(tokens[lo, 0])), min(b, int(tokens[hi - 1, 1]))))
    return mask, found


def format_chats(rows: DataFrame, path: str, tokenizer: str, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Writes formatted conversations as Parquet to ``path`` and returns them, read back.

    Input columns: conv_id, turn, role, text; turns are ordered by turn (null last), then role and
    text. Null texts and roles count as empty. ``mask`` is 1 for the tokens that cover text of
    ``roles``; ``loss_spans`` are the characters of ``formatted`` under it. Other columns are
    ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part = encoder(tokenizer, (START, END)), TaskContext.get().partitionId()
        key, block, size, number, ready, held = None, [], 0, 0, [], 0
        names = ["conv_id", "part", "block", "n_turns", "formatted", "ids", "mask", "loss_spans"]

        def made() -> Iterator[pa.RecordBatch]:
            keys, numbers, n_turns, texts, spans = zip(*ready, strict=True)
            row = 0
            for ids, stops, tokens, _ in library.encode(pa.array(texts, pa.large_string()), True):
                n = len(stops) - 1
                found = [intersect(tokens[a:b], x) for a, b, x in zip(stops[:-1].tolist(), stops[1:].tolist(), spans[row : row + n], strict=True)]
                lists = pa.array(stops, pa.int32())
                masks = pa.ListArray.from_arrays(lists, pa.array(np.concatenate([x for x, _ in found]), pa.int8()))
                under = pa.array([[{"a": a, "b": b} for a, b in x] for _, x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                head = [pa.array(keys[row : row + n], pa.int64()), pa.array([part] * n, pa.int32()), pa.array(numbers[row : row + n], pa.int64()), pa.array(n_turns[row : row + n], pa.int32())]
                yield pa.RecordBatch.from_arrays([*head, pa.array(texts[row : row + n]), pa.ListArray.from_arrays(lists, pa.array(ids, pa.int32())), masks, under], names=names)
                row += n

        def close() -> None:
            text, spans = render(block, roles)
            ready.append((key, number, len(block), text, spans))

        for batch in batches:
            for conv, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if block and (conv != key or size > BLOCK):
                    close()
                    block, held, size, number = [], held + size, 0, number + 1
                    if held > BLOCK:
                        yield from made()
                        ready, held = [], 0
                key = conv
                block.append((role or "", text or ""))
                size += len(text or "")
        if block:
            close()
        if ready:
            yield from made()

    # dealt by ranges of (conversation, turn), so that no texts are sampled; equal turns stay together
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = rows.select("conv_id", "turn", "role", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(FORMATTED).parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """What the files at ``path`` say of each conversation: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``. A conversation's blocks are streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        done: list = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> None:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text, spans in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for x in spans:
                    loss = unescape(text[x["a"] : x["b"]])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if len(done) > 1000:
                yield made()
        if state is not None:
            close()
            yield made()

    blocks = spark.read.schema(FORMATTED).parquet(path).select("conv_id", "part", "block", "formatted", "loss_spans")
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def chat_format(rows: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Formats to ``path`` (a new one in the shared folder if none is given) and returns its digests."""
    path = path or shared_path(rows.sparkSession, "chats")
    format_chats(rows, path, tokenizer)
    return digests(rows.sparkSession, path)
