"""A console: ``python -m loam.cli [path]``."""

from __future__ import annotations

import sys

from .engine import Engine
from .session import get_spark

HELP = """SELECT ...        run a query (10 rows are shown)
full SELECT ...   show all rows
\\d, \\tables       about the connection
\\schema           its columns
\\refresh          read its metadata anew
\\c path           connect to a table
help, \\q, exit"""


def answer(engine: Engine, line: str) -> str | None:
    """What the console says to ``line``; None ends it."""
    text = line.strip()
    word = text.split(" ", 1)[0].lower().rstrip(";")
    if not text:
        return ""
    if word in ("\\q", "exit", "quit"):
        return None
    if word == "help":
        return HELP
    if word in ("head", "tail"):
        return f"{word} is no command; use SELECT * ... LIMIT n"
    try:
        if word == "\\c":
            c = engine.connect(text.split(" ", 1)[1].strip())
            return f"connected to {c.path} ({c.kind})"
        if word in ("\\d", "\\tables"):
            return "\n".join(f"{k}: {v}" for k, v in engine.info().items())
        if word == "\\schema":
            return "\n".join(f"{f.name} {f.dataType.simpleString()}" for f in engine.schema())
        if word == "\\refresh":
            engine.refresh()
            return "refreshed"
        return engine.show(text)
    except Exception as e:  # noqa: BLE001  a console goes on
        return f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"


def main() -> None:
    engine = Engine(get_spark())
    if len(sys.argv) > 1:
        print(answer(engine, f"\\c {sys.argv[1]}"))
    while True:
        try:
            said = answer(engine, input("loam> "))
        except EOFError:
            break
        if said is None:
            break
        print(said)


if __name__ == "__main__":
    main()
