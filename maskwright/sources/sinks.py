"""Report sinks: tables for large results, JSON and Markdown for small ones."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Rows that a rendered report may have: it passes through the driver.
MOST = 10_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).format(fmt).partitionBy(*partition_by).save(path)


def small(df: DataFrame, most: int = MOST) -> list[dict]:
    """The rows of a report; more than `most` is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows: write it as a table")
    return [r.asDict(recursive=True) for r in rows]


def json_report(sections: dict[str, DataFrame], ascii_only: bool = False) -> str:
    """Pretty JSON of {section: rows}."""
    return json.dumps({name: small(df) for name, df in sections.items()}, indent=2, ensure_ascii=ascii_only, default=str)


def shown(v: object, digits: int = 1) -> str:
    return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def markdown_table(df: DataFrame, digits: int = 1) -> str:
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(v, digits).replace("|", "\\|") for v in r.values()) + " |" for r in small(df)])


def text_table(df: DataFrame, digits: int = 1) -> str:
    """For a console: columns as wide as their widest value, numbers to the right."""
    rows = [list(r.values()) for r in small(df)]
    cells = [list(df.columns), *([shown(v, digits) for v in r] for r in rows)]
    width = [max(len(r[c]) for r in cells) for c in range(len(df.columns))]
    right = [all(v is None or isinstance(v, (int, float)) for v in column) for column in zip(*rows, strict=True)] if rows else [False] * len(width)
    return "\n".join("  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(row, width, right, strict=True)).rstrip() for row in cells)


def text_report(title: str, sections: dict[str, DataFrame], notes: Sequence[str] = ()) -> str:
    parts = [title, *(f"{name}\n\n{text_table(df)}" for name, df in sections.items()), *notes]
    return "\n\n".join(parts) + "\n"


def markdown_report(title: str, sections: dict[str, DataFrame], notes: Sequence[str] = ()) -> str:
    parts = [f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())]
    if notes:
        parts.append("## Notes\n\n" + "\n".join(f"- {n}" for n in notes))
    return "\n\n".join(parts) + "\n"
