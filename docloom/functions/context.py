"""Compact presentation of content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunking import lines_of


def compact(text: str) -> str:
    """Trimmed lines; a line followed at once by ': definition' lines is one line; blank lines don't repeat."""
    out: list[str] = []
    lines = [x.strip() for x in lines_of(text)]
    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if not line:
            if out and out[-1]:
                out.append("")
            continue
        if at < len(lines) and lines[at].startswith(":") and not line.startswith(":"):
            term = line[1:-1].strip() if len(line) > 1 and line.startswith("`") and line.endswith("`") else line
            meaning = lines[at].lstrip(":").strip()
            at += 1
            line = f"{term} — {meaning}" if meaning else term
        out.append(line)
    return "\n".join(out).strip()


def _compact(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else compact(t))


def compact_column(text: Column) -> Column:
    return F.pandas_udf(_compact, T.StringType())(text)
