"""Token counts of a document's fields or sections.

A whole document is encoded once, with the characters that each token covers. The sections are
sorted, touching spans of the same characters; tokens are joined to them by binary search over the
section ends. A token that reaches over a boundary is allocated by a rule:

``start``  to the section of its first character
``end``    to the section of its last character
``share``  to each section by its part of the token's characters
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder

RULES = ("start", "end", "share")
COUNTED = "doc_id bigint, n_chars bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<double>"


def line_ends(text: str) -> np.ndarray:
    """Where each line ends, its line end included; the last ends with the text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(codes == 10) + 1
    return ends if len(ends) and ends[-1] == len(codes) else np.append(ends, len(codes))


def allocate(spans: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens reach over a boundary. ``spans``: (start, end) of tokens."""
    first = np.searchsorted(ends, spans[:, 0], "right").clip(0, len(ends) - 1)
    last = np.searchsorted(ends, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right").clip(0, len(ends) - 1)
    crossing = np.flatnonzero(first != last)
    counts = np.bincount(last if rule == "end" else first, minlength=len(ends)).astype(float)
    if rule == "share":
        for k in crossing.tolist():  # few: only tokens over a boundary
            a, b = spans[k].tolist()
            counts[first[k]] -= 1
            for section in range(first[k], last[k] + 1):
                begin = int(ends[section - 1]) if section else 0
                counts[section] += (min(b, int(ends[section])) - max(a, begin)) / (b - a)
    return counts, len(crossing)


def count_tokens(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] | None = None, rule: str = "start", id_col: str = "doc_id", text_col: str = "text", joiner: str = "\n") -> DataFrame:
    """One row per input row: ``doc_id, n_chars, n_tokens, n_sections, n_crossing, section_tokens``.

    The sections are the lines of ``text_col`` (a line end belongs to its line), or, with
    ``fields``, these columns, joined by ``joiner``, which belongs to the field before it. The counts
    add up to ``n_tokens``. Null texts and fields count as empty; an empty text is one section
    without tokens. Rows that repeat an id are counted apart; other columns are ignored; an empty
    table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if fields:
        parts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    else:
        parts = F.col(text_col).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        for batch in batches:
            parts = batch.column(1).to_pylist() if fields else None
            texts = pa.array([joiner.join(x) for x in parts], pa.large_string()) if fields else batch.column(1)
            raw = texts.cast(pa.large_binary())
            row = 0
            for _, stops, spans, size in library.encode(texts, True):
                out = []
                for k, (a, b) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)):
                    if fields:
                        ends = np.cumsum([len(x) + len(joiner) for x in parts[row + k]])
                        ends[-1] -= len(joiner)
                    else:
                        ends = line_ends((raw[row + k].as_py() or b"").decode(errors="replace"))
                    counts, crossing = allocate(spans[a:b], ends, rule)
                    out.append((b - a, len(ends), crossing, counts))
                tokens, sections, crossing, counts = zip(*out, strict=True)
                columns = [pa.array(size, pa.int64()), *[pa.array(x, pa.int64()) for x in (tokens, sections, crossing)], pa.array(counts, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(out)), *columns], names=["doc_id", "n_chars", "n_tokens", "n_sections", "n_crossing", "section_tokens"])
                row += len(out)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), parts.alias("parts")).mapInArrow(run, COUNTED)
