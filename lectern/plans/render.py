"""Results as text, row by row from the cluster, in the formats that command-line tools print."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame

MODES = ("list", "csv", "tabs", "json", "line", "markdown", "html", "column", "box")
#: Rows whose widths ``column`` and ``box`` measure before they print; longer cells further on widen their own line.
MEASURED = 1000


def _cell(value: object) -> str:
    return "" if value is None else value.hex().upper() if isinstance(value, (bytes, bytearray)) else str(value)


def render(df: DataFrame, mode: str = "list", header: bool | None = None) -> Iterator[str]:
    """The lines of ``df`` in one of MODES; ``list`` separates by a bar and has no header unless asked for."""
    if mode not in MODES:
        raise ValueError(f"{mode} isn't one of {', '.join(MODES)}")
    names = df.columns
    rows = df.toLocalIterator(prefetchPartitions=True)
    header = mode in ("markdown", "html", "csv") if header is None else header
    if mode == "json":
        for k, row in enumerate(rows):
            yield ("[" if not k else ",") + json.dumps({n: v if v is None or isinstance(v, (bool, int, float, str)) else _cell(v) for n, v in zip(names, row)}, ensure_ascii=False)
        yield "]"
        return
    if mode == "line":
        width = max(map(len, names), default=0)
        for row in rows:
            yield "\n".join(f"{n:>{width}} = {_cell(v)}" for n, v in zip(names, row)) + "\n"
        return

    if mode in ("column", "box"):
        yield from _aligned(names, ([_cell(v) for v in row] for row in rows), mode == "box")
        return

    def line(cells: list[str], head: bool = False) -> str:
        if mode == "csv":
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow(cells)
            return out.getvalue()
        if mode == "markdown":
            return "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
        if mode == "html":
            tag = "TH" if head else "TD"
            return "<TR>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</TR>"
        return ("\t" if mode == "tabs" else "|").join(cells)

    if header:
        yield line(names, head=True)
        if mode == "markdown":
            yield "|" + "---|" * len(names)
    for row in rows:
        yield line([_cell(v) for v in row])


def _aligned(names: list[str], rows: Iterator[list[str]], boxed: bool) -> Iterator[str]:
    few = list(islice(rows, MEASURED))
    widths = [max(len(c) for c in column) for column in zip(names, *few)]
    pad = lambda cells: [c.ljust(w) for c, w in zip(cells, widths)]
    rule = lambda left, middle, right: left + middle.join("─" * (w + 2) for w in widths) + right
    line = (lambda cells: "│ " + " │ ".join(pad(cells)) + " │") if boxed else (lambda cells: "  ".join(pad(cells)).rstrip())
    if boxed:
        yield rule("┌", "┬", "┐")
    yield line(names)
    yield rule("├", "┼", "┤") if boxed else "  ".join("-" * w for w in widths)
    for row in chain(few, rows):
        yield line(row)
    if boxed:
        yield rule("└", "┴", "┘")
