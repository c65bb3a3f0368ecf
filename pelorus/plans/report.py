"""Documents: templates, Markdown tables and a plain HTML rendering. Small results only, on the driver."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

_PLACE = re.compile(r"\{\{\s*([A-Za-z_][\w.]*)\s*\}\}")


def fill(template: str, values: dict[str, object]) -> str:
    """``{{ name }}`` and ``{{ name.part }}`` replaced; an unknown name raises ``KeyError``."""

    def value(m: re.Match) -> str:
        name, *rest = m[1].split(".")
        found = values[name]
        for part in rest:
            found = found[part] if isinstance(found, dict) else getattr(found, part)
        return str(found)

    return _PLACE.sub(value, template)


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A Markdown table of a small result: floats with two decimals. More than ``most`` rows raise ``ValueError``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")

    def cell(x: object) -> str:
        return "" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)

    lines = [df.columns, ["---"] * len(df.columns), *([cell(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def _table(lines: Sequence[str]) -> str:
    cells = [[c.strip() for c in line.strip("|").split("|")] for line in lines]
    out = "<table>\n<tr>" + "".join(f"<th>{c}</th>" for c in cells[0]) + "</tr>\n"
    return out + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>\n" for row in cells[2:]) + "</table>"


def markdown_to_html(text: str, title: str) -> str:
    """Headings, paragraphs, lists and tables of a Markdown text; anything else is shown as it is."""
    out = [f"<!doctype html>\n<title>{html.escape(title)}</title>"]
    for block in re.split(r"\n\s*\n", html.escape(text, quote=False).strip()):
        lines = block.split("\n")
        if (m := re.match(r"(#{1,6})\s+(.*)", lines[0])) and len(lines) == 1:
            out.append(f"<h{len(m[1])}>{m[2]}</h{len(m[1])}>")
        elif len(lines) > 1 and all(x.startswith("|") for x in lines):
            out.append(_table(lines))
        elif all(x.startswith("- ") for x in lines):
            out.append("<ul>\n" + "\n".join(f"<li>{x[2:]}</li>" for x in lines) + "\n</ul>")
        else:
            out.append(f"<p>{block}</p>")
    return "\n".join(out) + "\n"
