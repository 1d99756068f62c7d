"""Command line: the tables of a workbook as text."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .errors import InspectorError

#: What a format makes of a result; JSON always holds every row.
WRITERS = {"markdown": lambda result, rows: result.to_markdown(rows), "json": lambda result, rows: result.to_json(indent=2)}


def _rows(text: str) -> int:
    try:
        n = int(text)
    except ValueError:
        n = -1
    if n < 0:
        raise argparse.ArgumentTypeError(f"not a number of rows: {text!r}")
    return n


def _shown(path: str, kind: str, rows: int) -> str:
    """The text asked for; what can't be read ends in an error that says why."""
    place = Path(path)
    if not place.exists():
        raise FileNotFoundError(f"file not found: {path}")
    if place.is_dir():
        raise IsADirectoryError(f"not a file: {path}")
    from .plans.extraction import extract
    from .session import local_session

    with extract(local_session(), path) as result:
        return WRITERS[kind](result, rows)


def main(argv: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    cli.add_argument("path", help="the workbook")
    cli.add_argument("--format", choices=sorted(WRITERS), default="markdown")
    cli.add_argument("--max-rows", type=_rows, default=20, help="rows of a table in Markdown")
    given = cli.parse_args(argv)
    try:
        print(_shown(given.path, given.format, given.max_rows))
    except (InspectorError, OSError) as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
