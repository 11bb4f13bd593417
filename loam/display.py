"""Tables for a console."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows shown unless all are asked for, and characters of a column.
ROWS, WIDTH = 10, 50


def cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.2f}"
    text = str(value)
    return text if len(text) <= WIDTH else f"{text[: WIDTH - 3]}..."


def table(columns: list[str], rows: list[tuple], more: int | None = None) -> str:
    """Centred columns and a footer; ``more``: how many rows there are in all, if not all are shown."""
    lines = [[cell(c) for c in columns], *[[cell(v) for v in r] for r in rows]]
    widths = [max(len(line[i]) for line in lines) for i in range(len(columns))]
    shown = [" | ".join(x.center(w) for x, w in zip(line, widths, strict=True)) for line in lines]
    rule = "-+-".join("-" * w for w in widths)
    n = len(rows)
    footer = f"({more} rows total, showing {n})" if more is not None and more != n else f"({n} row{'' if n == 1 else 's'})"
    return "\n".join([shown[0], rule, *shown[1:], footer])


def show(df: DataFrame, full: bool = False) -> str:
    """A result as text. Without ``full`` only ROWS rows are fetched; the rest are counted."""
    if full:
        return table(df.columns, [tuple(x) for x in df.collect()])
    head = [tuple(x) for x in df.limit(ROWS + 1).collect()]
    return table(df.columns, head[:ROWS], df.count() if len(head) > ROWS else None)
