"""Markdown to chunks: sections by heading, typed blocks, packing, kind-specific splitting and merging of short chunks.

All lengths are code points. `chunks` is the pure function; `chunk_column` is its Arrow UDF form, an array of structs, and
`chunk_rows` gives a row for each chunk. Keys and hashes are native columns (`docloom.plans.stages`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of chunks that a worker holds before it hands them on.
HELD = 1 << 20
#: Sizes in code points.
TARGET, OVERLAP, HARD, SHORT = 1200, 120, 1600, 80
LOWEST_CUT, HIGHEST_CUT, ROW_KEY, CONTINUED = 980, 1320, 120, 64

HEADING = re.compile(r"(#{1,6}) (.*)")
ANCHOR = re.compile(r"(.*)\{#(.*)\}")
LIST_START = re.compile(r"\s*(?:[*+-] |[0-9]+\. )")
MEMBERS = (" * [", " * `", " * <")
#: What a cut prefers to stand behind, best first.
TEXT_CUTS = (re.compile(r"[.!?…](?=\s|\Z)"), re.compile(r"[;:](?=\s)"), re.compile(r",(?=\s)"), re.compile(r"\n"), re.compile(r"\s"))
LINE_CUTS = (re.compile(r"\n"), re.compile(r"\s"))


@dataclass
class Section:
    path: list[str]
    anchor: str | None
    title: str | None
    text: str


@dataclass
class Chunk:
    text: str
    path: list[str] = field(default_factory=list)
    anchor: str | None = None
    title: str = ""
    has_code: bool = False
    has_table: bool = False
    has_list: bool = False
    table_id: str | None = None
    table_ordinal: int | None = None
    row_ordinal: int | None = None
    row_key: str | None = None
    column_headers: list[str] | None = None
    cell_ordinal: int | None = None
    cell_part_index: int | None = None
    cell_part_total: int | None = None
    is_table_continuation: bool = False

    @property
    def fixed(self) -> bool:
        """Parts of table cells are never merged."""
        return self.cell_part_total is not None


def lines_of(text: str) -> list[str]:
    """Lines between LF or CRLF only, without an empty one at the end."""
    parts = text.split("\n")
    if parts and not parts[-1]:
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def heading(line: str) -> tuple[int, str, str | None] | None:
    found = HEADING.fullmatch(line.rstrip())
    if not found:
        return None
    title, anchor = found[2].strip().rstrip("#").strip(), None
    if (m := ANCHOR.fullmatch(title)) and m[2].strip():
        title, anchor = m[1].strip(), m[2].strip()
    return (len(found[1]), title, anchor) if title else None


def sections(text: str) -> list[Section]:
    """A heading ends the section before it and begins its own. A heading of level n leaves n - 1 titles above it at
    most, however deep those were."""
    out: list[Section] = []
    stack: list[str] = []
    now, held = Section([], None, None, ""), []

    def close() -> None:
        body = "\n".join(held)
        if body.strip():
            out.append(replace(now, text=body))

    for line in lines_of(text):
        if found := heading(line):
            close()
            level, title, anchor = found
            stack = [*stack[: level - 1], title]
            now, held = Section(list(stack), anchor, title, ""), []
        held.append(line)
    close()
    return out


def is_table(line: str) -> bool:
    t = line.strip()
    return t.startswith("|") and t.endswith("|")


def kind_of(line: str) -> str:
    if line.lstrip().startswith("```"):
        return "code"
    return "table" if is_table(line) else "list" if LIST_START.match(line) else "text"


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of runs of lines; blank lines separate."""
    lines = lines_of(text)
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        kind, end = kind_of(lines[at]), at + 1
        while end < len(lines):
            line = lines[end]
            if kind == "code":
                end += 1
                if line.lstrip().startswith("```"):
                    break
                continue
            own = bool(line.strip()) and (is_table(line) if kind == "table" else (bool(LIST_START.match(line)) or line.startswith(("  ", "\t"))) if kind == "list" else kind_of(line) == "text")
            if not own:
                break
            end += 1
        yield kind, "\n".join(lines[at:end])
        at = end


def cut_in(text: str, low: int, high: int, cuts: Iterable[re.Pattern[str]]) -> int | None:
    """The last place in [low, high] behind the most preferred mark."""
    for mark in cuts:
        found = [m.end() for m in mark.finditer(text, max(0, low - 1), min(len(text), high + 1)) if low <= m.end() <= high]
        if found:
            return found[-1]
    return None


def split_text(text: str, cuts: tuple[re.Pattern[str], ...] = TEXT_CUTS, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most HARD characters; each next one begins `overlap` before the cut."""
    n, start, out = len(text), 0, []
    if n <= HARD:
        return [text.strip()] if text.strip() else []
    while n - start > HARD:
        cut = cut_in(text, max(start + LOWEST_CUT, start + 1), min(start + HIGHEST_CUT, n), cuts)
        cut = cut or cut_in(text, start + 1, min(start + HARD, n), LINE_CUTS) or start + TARGET
        out.append(text[start:cut].strip())
        after = cut - min(overlap, cut - start - 1)
        start = after if after > start else cut
    out.append(text[start:].strip())
    return [p for p in out if p]


def pack(parts: Iterable[str], joint: str, target: int) -> Iterator[str]:
    """Parts joined while they fit."""
    held = ""
    for p in parts:
        if held and len(held) + len(joint) + len(p) > target:
            yield held
            held = p
        else:
            held = f"{held}{joint}{p}" if held else p
    if held:
        yield held


def list_items(text: str) -> list[str]:
    items: list[str] = []
    lines = [x for x in lines_of(text) if x.strip()]
    if len(lines) > 1:
        for line in lines:
            if LIST_START.match(line):
                items.append(line.rstrip())
            elif items:
                items[-1] += "\n" + line.rstrip()
        items = [i.strip() for i in items]
        if len(items) > 1:
            return items
    one = text.strip()
    if one.startswith(("* ", "- ", "+ ")):
        for mark in MEMBERS:
            first, *more = one.split(mark)
            first = first.strip()
            items = [first if first[1:2] == " " else f"* {first}"] + [mark[1:] + m.strip() for m in more if m.strip()]
            if len(items) > 1:
                return items
    return []


def split_list(text: str) -> list[str]:
    items = list_items(text)
    if len(items) < 2:
        return split_text(text)
    out, run = [], []
    for item in items:
        if len(item) > HARD:
            out += pack(run, "\n\n", TARGET)
            out += split_text(item, overlap=0)
            run = []
        else:
            run.append(item)
    return [*out, *pack(run, "\n\n", TARGET)]


def split_code(text: str) -> list[str]:
    lines = lines_of(text)
    if len(lines) < 2 or not (lines[0].lstrip().startswith("```") and lines[-1].lstrip().startswith("```")):
        return split_text(text, LINE_CUTS)
    opening, closing = lines[0].rstrip(), lines[-1].rstrip()
    if len(lines) == 2:
        return [f"{opening}\n{closing}"]
    around = len(opening) + len(closing) + 2
    target, hard = max(TARGET - around, SHORT), max(HARD - around, 120)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            out.append("\n".join([opening, *run, closing]))
            run.clear()

    for line in lines[1:-1]:
        if len(line) + 1 > hard:
            flush()
            out += ["\n".join([opening, p, closing]) for p in split_text(line, LINE_CUTS)]
            continue
        if run and sum(len(x) + 1 for x in run) + len(line) + 1 > target:
            flush()
        run.append(line)
    flush()
    return out


def cells_of(row: str) -> list[str]:
    return [c.strip() for c in row.strip().removeprefix("|").removesuffix("|").split("|")]


def row_of(cells: list[str]) -> str:
    return f"| {' | '.join(cells)} |"


def is_separator(line: str) -> bool:
    t = line.strip()
    return is_table(line) and not t.strip("|-: \t")


def split_cell(cell: str, target: int) -> list[str]:
    """Parts of a cell, at <br/> where there is one; later parts don't begin with a separator."""
    if len(cell) <= target:
        return [cell]
    if "<br/>" not in cell:
        parts = split_text(cell, overlap=0)
    else:
        parts, held = [], ""
        for token in (t.strip() for t in cell.split("<br/>")):
            if not token:
                continue
            if held and len(held) + 5 + len(token) <= target:
                held += "<br/>" + token
            elif held:
                parts.append(held)
                held = token
            elif len(token) <= target:
                held = token
            else:
                parts += split_text(token, overlap=0)
        parts += [held] if held else []
    later = [re.sub(r"^(?:<br/>\s*)*[\s,;:]*", "", p) for p in parts[1:]]
    return [p for p in [*parts[:1], *later] if p] or [cell.strip()]


def table_shape(lines: list[str]) -> tuple[list[str], list[str]]:
    """(header lines, data rows)."""
    rows = [x for x in lines if not is_separator(x)]
    if len(lines) >= 3 and is_separator(lines[1]):
        first = lines[0]
        data_like = len(first) > 220 or first.count("`") >= 4 or "<br/>" in first
        if not data_like and not any(map(is_separator, lines[2:])):
            return lines[:2], lines[2:]
        return [], rows
    if len(lines) == 2 and is_separator(lines[1]):
        return [], lines[:1]
    return [], lines


def split_table(text: str) -> list[dict]:
    """Pieces with the header repeated; fields of Chunk. Only parts of a row that is too long tell of row and cell."""
    lines = lines_of(text)
    header, rows = table_shape(lines)
    names = cells_of(lines[0])
    around = sum(len(x) + 1 for x in header) + 1
    target, hard = max(TARGET - around, SHORT), max(HARD - around, 120)
    out: list[dict] = []
    run: list[str] = []

    def piece(rows: list[str], **more: object) -> dict:
        return {"text": "\n".join([*header, *rows]).strip(), **more}

    def flush() -> None:
        if run:
            out.append(piece(list(run)))
            run.clear()

    for number, row in enumerate(rows):
        if len(row) + 1 <= hard:
            if run and sum(len(x) + 1 for x in run) + len(row) + 1 > target:
                flush()
            run.append(row)
            continue
        flush()
        cells = cells_of(row)
        longest = max(range(len(cells)), key=lambda k: len(cells[k]))
        parts = split_cell(cells[longest], min(max(hard - CONTINUED, SHORT), TARGET))
        for k, part in enumerate(parts):
            made = [*cells[:longest], part, *cells[longest + 1 :]]
            if len(parts) > 1:
                made[0] += f" (cont. {k + 1}/{len(parts)})"
            line = row_of(made)
            for p in [line] if len(line) <= hard else split_text(line, LINE_CUTS):
                out.append(piece([p], row_ordinal=number, row_key=" ".join(cells[0].split())[:ROW_KEY], column_headers=names, cell_ordinal=longest, cell_part_index=k, cell_part_total=len(parts), is_table_continuation=len(parts) > 1))
    flush()
    return out


SPLITTERS = {"text": split_text, "list": split_list, "code": split_code}


def packed(section: Section, source: str) -> Iterator[Chunk]:
    """A section's blocks, joined up to TARGET; larger ones alone, and split beyond HARD."""
    base = Chunk("", section.path, section.anchor, section.title or "")
    held: Chunk | None = None
    tables = 0
    for kind, block in blocks(section.text):
        text = block.strip()
        own = replace(base, text=text, **({f"has_{kind}": True} if kind != "text" else {}))
        ordinal = tables
        tables += kind == "table"
        if len(text) <= TARGET:
            if held is not None and len(held.text) + 2 + len(text) <= TARGET:
                held = joined(held, own)
            else:
                if held is not None:
                    yield held
                held = own
            continue
        if held is not None:
            yield held
            held = None
        if len(text) <= HARD:
            yield own
        elif kind == "table":
            key = f"{source}|{' > '.join(section.path)}|{section.anchor or ''}|table#{ordinal}"
            of = {"table_id": hashlib.sha1(key.encode()).hexdigest(), "table_ordinal": ordinal}
            yield from (replace(own, **p, **(of if "cell_ordinal" in p else {})) for p in split_table(block) if p["text"])
        else:
            yield from (replace(own, text=p.strip()) for p in SPLITTERS[kind](block) if p.strip())
    if held is not None:
        yield held


def joined(a: Chunk, b: Chunk, of: Chunk | None = None) -> Chunk:
    """Both texts, with the fields of `of` (a by default) and the flags of both."""
    of = of or a
    return replace(of, text=f"{a.text}\n\n{b.text}", has_code=a.has_code or b.has_code, has_table=a.has_table or b.has_table, has_list=a.has_list or b.has_list)


def merged(chunks: list[Chunk]) -> list[Chunk]:
    """Short chunks go to the one before, else to the next; a short last one to the one before."""

    def fits(a: Chunk, b: Chunk) -> bool:
        return not a.fixed and not b.fixed and len(a.text) + 2 + len(b.text) <= HARD

    if len(chunks) < 2:
        return chunks
    out: list[Chunk] = []
    for c in chunks:
        if out and len(c.text) < SHORT and fits(out[-1], c):
            out[-1] = joined(out[-1], c)
        else:
            out.append(c)
    at = 0
    while at + 1 < len(out):
        if len(out[at].text) < SHORT and fits(out[at], out[at + 1]):
            out[at : at + 2] = [joined(out[at], out[at + 1], out[at + 1])]
        else:
            at += 1
    if len(out) > 1 and len(out[-1].text) < SHORT and fits(out[-2], out[-1]):
        out[-2:] = [joined(out[-2], out[-1])]
    return out


def chunks(text: str, source: str = "") -> list[Chunk]:
    """The chunks of a Markdown document; source goes into table ids."""
    parts = sections(text)
    title = next((s.path[-1] for s in parts if s.path), "Document")
    made = [replace(c, title=s.title or title) for s in parts for c in packed(s, source)]
    return merged([c for c in made if c.text.strip()])


CHUNK = T.StructType([
    T.StructField("content", T.StringType()), T.StructField("heading_path", T.ArrayType(T.StringType())), T.StructField("section_anchor", T.StringType()),
    T.StructField("source_title", T.StringType()), T.StructField("has_code", T.BooleanType()), T.StructField("has_table", T.BooleanType()),
    T.StructField("has_list", T.BooleanType()), T.StructField("table_id", T.StringType()), T.StructField("table_ordinal", T.LongType()),
    T.StructField("row_ordinal", T.LongType()), T.StructField("row_key", T.StringType()), T.StructField("column_headers", T.ArrayType(T.StringType())),
    T.StructField("cell_ordinal", T.LongType()), T.StructField("cell_part_index", T.LongType()), T.StructField("cell_part_total", T.LongType()),
    T.StructField("is_table_continuation", T.BooleanType()),
])


def _row(c: Chunk) -> dict:
    return {"content": c.text, "heading_path": c.path, "section_anchor": c.anchor, "source_title": c.title} | {f.name: getattr(c, f.name) for f in CHUNK.fields[4:]}


def _chunks(text: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([[_row(c) for c in chunks(t or "", s or "")] for t, s in zip(text, source, strict=True)])


def chunk_column(text: Column, source: Column) -> Column:
    return F.pandas_udf(_chunks, T.ArrayType(CHUNK))(text, source)


def chunk_rows(docs: DataFrame, text: str, source: str) -> DataFrame:
    """A row for each chunk of docs(text, source, ...): the other columns and source, chunk_count_in_doc, chunk_index and the
    fields of CHUNK. A plan can't ask for the chunks twice, as it does for an array to be exploded."""
    own = [f for f in docs.schema.fields if f.name != text]
    kept = [f.name for f in own]
    schema = T.StructType([*own, T.StructField("chunk_count_in_doc", T.LongType()), T.StructField("chunk_index", T.LongType()), *CHUNK.fields])
    arrow = to_arrow_schema(T.StructType(schema.fields[len(kept) :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: list[int] = []
            rows: list[dict] = []
            held = 0

            def made(b: pa.RecordBatch = b) -> pa.RecordBatch:
                old = [b.column(c).take(pa.array(of, pa.int64())) for c in kept]
                new = [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
                return pa.RecordBatch.from_arrays([*old, *new], [*kept, *arrow.names])

            for k, (t, s) in enumerate(zip(b.column(text), b.column(source), strict=True)):
                found = chunks(t.as_py() or "", s.as_py() or "")
                for n, c in enumerate(found):
                    of.append(k)
                    rows.append(_row(c) | {"chunk_count_in_doc": len(found), "chunk_index": n})
                    held += len(c.text)
                    if held > HELD:
                        yield made()
                        of, rows, held = [], [], 0
            if rows:
                yield made()

    return docs.select(*kept, text).mapInArrow(run, schema)
