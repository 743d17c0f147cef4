"""HTML to Markdown, one row at a time: a small tree builder after the HTML parsing rules, and a renderer.

The builder knows void and raw-text elements, implied ends (p, li, dt, dd, option, table parts) and reopens formatting
elements that a block end closed. It doesn't move misplaced table content out of tables. `page_to_markdown` is the
column form: an Arrow UDF, no shuffle; nulls stay null.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Generator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
CLOSE_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = frozenset(("html", "body", "section", "article", "div"))
#: For a start tag: what it ends, and the elements that bound the search.
IMPLIED = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody"), ("table",)),
}


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Element)]

    def first(self, test) -> Element | None:
        return next((e for e in self.walk() if test(e)), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]


class Builder(HTMLParser):
    """Builds a tree; `open` is the stack of open elements, `active` the formatting elements that text reopens."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.open = [self.root]
        self.count = Counter(["html"])  # of the tags in `open`
        self.active: list[Element] = []
        self.lost = False  # whether an active element may have been closed

    def _close(self, k: int) -> None:
        """Close open[k] and what is in it."""
        gone = self.open[k:]
        del self.open[k:]
        self.count.subtract(e.tag for e in gone)
        self.lost = self.lost or any(e.tag in FORMATTING for e in gone)

    def _end(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in bounds:
                return
            if self.open[k].tag in tags:
                self._close(k)
                return

    def _put(self, element: Element, stay: bool) -> None:
        self.open[-1].children.append(element)
        if stay:
            self.open.append(element)
            self.count[element.tag] += 1

    def _reopen(self) -> None:
        if not self.lost:
            return
        self.lost = False
        there = {id(e) for e in self.open}
        for k, e in enumerate(self.active):
            if id(e) not in there:
                again = Element(e.tag, e.attrs)
                self._put(again, True)
                self.active[k] = again

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        got: dict[str, str] = {}
        for k, v in attrs:
            got.setdefault(k, v or "")
        element = Element(tag, got)
        if tag in ("body", "head"):
            if tag == "body":
                self._end(("head",), ())
                if (old := self.root.first(lambda e: e.tag == "body")) is not None and old is not self.root:
                    return
            self._put(element, True)
            return
        if tag in CLOSE_P:
            self._end(("p",), ("td", "th", "table", "button"))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._close(len(self.open) - 1)
        if tag in IMPLIED:
            while True:
                size = len(self.open)
                self._end(*IMPLIED[tag])
                if len(self.open) == size:
                    break
        if tag in FORMATTING:
            if tag == "a" and any(e.tag == "a" for e in self.active):
                self.handle_endtag("a")
            self._reopen()
            self._put(element, True)
            self.active.append(element)
            return
        if tag not in CLOSE_P and tag not in IMPLIED and tag not in ("script", "style", "head", "title", "link", "meta", "tbody", "thead"):
            self._reopen()
        self._put(element, tag not in VOID)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # A slash means nothing on an element that has content; parse_starttag calls only this.
        if tag in ("script", "style"):
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in FORMATTING:
            last = next((k for k in range(len(self.active) - 1, -1, -1) if self.active[k].tag == tag), None)
            if last is not None:
                del self.active[last]
        if tag == "p" and not self.count["p"]:
            self._put(Element("p"), False)
            return
        match = HEADINGS if tag in HEADINGS else (tag,)
        self._end(match, () if tag == "table" else ("table", "td", "th") if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot") else ("table",))

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in ("script", "style", "title") and data.strip():
            self._reopen()
        kids = self.open[-1].children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str) -> Element:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


#: White space as Unicode defines it.
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def normalize_ws(text: str) -> str:
    return BLANKS.sub(" ", text)


def article(html: str) -> list:
    """The nodes of the article: content of the embedded page JSON, else `article .prose`, else body, else everything."""
    root = parse(html)
    data = root.first(lambda e: e.tag == "script" and e.attrs.get("id") == "__NEXT_DATA__")
    if data is not None:
        try:
            value = json.loads(data.text())
            for key in ("props", "pageProps", "content"):
                value = value[key] if isinstance(value, dict) else None
        except (ValueError, KeyError):
            value = None
        if isinstance(value, str) and value.strip():
            return parse(value).children
    for holder in root.walk():
        if holder.tag == "article":
            prose = next((e for e in holder.walk() if e is not holder and "prose" in e.attrs.get("class", "").split()), None)
            if prose is not None and (prose.elements() or prose.text().strip()):
                return prose.children
    body = root.first(lambda e: e.tag == "body")
    return body.children if body is not None and (body.elements() or body.text().strip()) else root.children


def fenced(text: str, least: int = 1) -> str:
    """A run of backticks longer than any in the text."""
    return "`" * max(least, 1 + max((len(r) for r in re.findall("`+", text)), default=0))


def run(made: Generator | str) -> str:
    """What a renderer method returns. Methods yield the methods they need the text of, so that depth is no recursion."""
    stack, value = [made], None
    while stack:
        if isinstance(stack[-1], str):
            value = stack.pop()
            continue
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


class Renderer:
    """One method for each kind of block; of everything else the content is an inline paragraph. See run()."""

    def blocks(self, nodes: list, depth: int = 0):
        out = []
        for n in nodes:
            out.append((yield self.block(n, depth)))
        return "".join(out)

    def block(self, node, depth: int = 0):
        if isinstance(node, str):
            text = normalize_ws(node).strip()
            return f"{text}\n\n" if text else ""
        if node.tag in CONTAINERS:
            return (yield self.blocks(node.children, depth))
        kind = "heading" if node.tag in HEADINGS else "list" if node.tag in ("ul", "ol") else node.tag
        made = getattr(self, f"block_{kind}", None)
        if made is not None:
            return (yield made(node, depth))
        return (yield self.block_p(node, depth))

    def block_heading(self, node: Element, depth: int):
        text = (yield self.inlines(node.children)).strip()
        if not text:
            return ""
        anchor = self.anchor(node)
        return "#" * int(node.tag[1]) + f" {text}" + (f" {{#{anchor}}}" if anchor else "") + "\n\n"

    @staticmethod
    def anchor(node: Element) -> str | None:
        """The id of a hidden span that stands first."""
        lead = next((c for c in node.children if not isinstance(c, str) or normalize_ws(c).strip()), None)
        hidden = isinstance(lead, Element) and lead.tag == "span" and "position: absolute" in lead.attrs.get("style", "").lower()
        return lead.attrs.get("id") if hidden else None

    def block_p(self, node: Element, depth: int):
        text = (yield self.inlines(node.children)).strip()
        return f"{text}\n\n" if text else ""

    def block_hr(self, node: Element, depth: int) -> str:
        return "---\n\n"

    def block_list(self, node: Element, depth: int):
        out = []
        for k, e in enumerate((e for e in node.elements() if e.tag == "li"), 1):
            out.append((yield self.item(e, depth, f"{k}. " if node.tag == "ol" else "* ")))
        return "".join(out) + "\n"

    def item(self, node: Element, depth: int, bullet: str):
        line, below = [], []
        for c in node.children:
            if isinstance(c, Element) and c.tag in ("ul", "ol", "pre", "table"):
                below.append((yield self.block(c, depth + 1)))
                continue
            if isinstance(c, str):
                text = normalize_ws(c).strip()
            else:
                text = (yield self.inlines(c.children) if c.tag == "p" else self.inline(c)).strip()
            line += [text] if text else []
        return "  " * depth + bullet + " ".join(line).strip() + "\n" + "".join(below)

    def block_pre(self, node: Element, depth: int) -> str:
        code = node.first(lambda e: e.tag == "code")
        names = code.attrs.get("class", "").split() if code is not None else []
        language = next((x.removeprefix("language-") for x in names if x.startswith("language-")), "")
        body = (code is not None and code.text() or node.text()).rstrip("\n")
        fence = "````" if "```" in body else "```"
        return f"{fence}{language}\n{body}\n{fence}\n\n"

    def block_blockquote(self, node: Element, depth: int):
        inner = collapse((yield self.blocks(node.children, depth))).strip()
        return "".join(f"> {x}\n" if x.strip() else ">\n" for x in inner.split("\n")) + "\n" if inner else ""

    def block_table(self, node: Element, depth: int):
        rows = [cells for e in node.walk() if e.tag == "tr" and (cells := [c for c in e.elements() if c.tag in ("th", "td")])]
        if not rows:
            return ""
        width = len(rows[0])
        marks = {"left": ":--", "right": "--:", "center": ":-:"}
        lines = []
        for r in rows:
            cells = []
            for c in r[:width]:
                cells.append((yield self.cell(c)))
            lines.append(cells + [""] * (width - len(cells)))
        lines.insert(1, [marks.get(self.align(c), "---") for c in rows[0]])
        return "".join(f"| {' | '.join(x)} |\n" for x in lines) + "\n"

    @staticmethod
    def align(cell: Element) -> str:
        if (given := cell.attrs.get("align", "").lower()) in ("left", "right", "center"):
            return given
        found = re.search(r"text-align: ?(left|right|center)", cell.attrs.get("style", "").lower())
        return found[1] if found else ""

    def cell(self, node: Element):
        """One line; breaks and blocks are separated by <br/>."""
        out: list[str] = []

        def block(texts: list[str]) -> None:
            if texts and out and out[-1] != "<br/>":
                out.append("<br/>")
            out.extend(texts)

        for c in node.children:
            if isinstance(c, Element) and c.tag == "br":
                out.append("<br/>")
            elif isinstance(c, Element) and c.tag in ("p", "div"):
                text = (yield self.inlines(c.children)).strip()
                block([text] if text else [])
            elif isinstance(c, Element) and c.tag in ("ul", "ol"):
                texts = []
                for e in c.elements():
                    if e.tag == "li":
                        texts.append((yield self.inlines(e.children)).strip())
                block([f"* {t}" for t in texts if t])
            else:
                text = (normalize_ws(c) if isinstance(c, str) else (yield self.inline(c))).strip()
                out += [text] if text else []
        line = ""
        for part in out:
            if part == "<br/>":
                line = line.rstrip() + part
            else:
                line += part if not line or line.endswith("<br/>") else f" {part}"
        return line.strip().replace("|", "\\|")

    def block_dl(self, node: Element, depth: int):
        entries: list[list[str]] = []
        for e in node.elements():
            text = (yield self.inlines(e.children)).strip() if e.tag in ("dt", "dd") else ""
            if e.tag == "dt":
                entries.append([text + (f" {{#{e.attrs['id']}}}" if text and "id" in e.attrs else "")])
            elif e.tag == "dd" and entries and text:
                entries[-1].append(f": {text}")
        kept = ["\n".join(x) for x in entries if x[0]]
        return "\n\n".join(kept).strip() + "\n\n" if kept else ""

    def inlines(self, nodes: list):
        out = []
        for n in nodes:
            out.append(normalize_ws(n) if isinstance(n, str) else (yield self.inline(n)))
        return "".join(out)

    def inline(self, node: Element):
        if node.tag == "code":
            return self.code(node.text())
        inner = yield self.inlines(node.children)
        match node.tag:
            case "a":
                href = node.attrs.get("href", "").strip()
                return f"[{inner.strip() or href}]({href})"
            case "img":
                return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '').strip()})"
            case "strong" | "b":
                return f"**{inner.strip()}**"
            case "em" | "i":
                return f"*{inner.strip()}*"
            case "br":
                return "<br/>"
            case "span" if "id" in node.attrs and "position: absolute" in node.attrs.get("style", "").lower():
                return ""
        return inner

    @staticmethod
    def code(text: str) -> str:
        text = text.replace("\n", " ").strip()
        mark, pad = fenced(text), " " if text.startswith("`") or text.endswith("`") else ""
        return f"{mark}{pad}{text}{pad}{mark}" if text else "``"


def collapse(text: str) -> str:
    """Blank lines are empty, and at most two stand together."""
    text = "\n".join(x if x.strip() else "" for x in text.split("\n"))
    return re.sub(r"\n{4,}", "\n\n\n", text)


def normalize_markdown(text: str) -> str:
    """LF line ends, at most two blank lines together, one line end at the end."""
    return collapse(text.replace("\r\n", "\n")).strip() + "\n"


def html_to_markdown(html: str) -> str:
    return normalize_markdown(run(Renderer().blocks(article(html))))


def links_of(html: str, base: str) -> list[str]:
    """Addresses of all links, resolved against base, each once in order."""
    from urllib.parse import urljoin

    out: dict[str, None] = {}
    for e in parse(html).walk():
        href = e.attrs.get("href", "").strip() if e.tag == "a" else ""
        if href and not re.match(r"#|javascript:|mailto:|tel:", href):
            try:
                out.setdefault(urljoin(base, href))
            except ValueError:
                continue
    return list(out)


def attempt(html: str | None) -> tuple[str | None, str | None]:
    """(Markdown, error): a page that can't be converted, or has no content, is an error and not the end of a job."""
    if html is None:
        return None, "no page"
    try:
        text = html_to_markdown(html)
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:500]
    return (text, None) if text.strip() else (None, "no content")


def _markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else attempt(h)[0] or "")


def _attempts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([attempt(h) for h in html], columns=["md", "error"], dtype=object)


def _links(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else links_of(h, b or "") for h, b in zip(html, base, strict=True)])


def page_to_markdown(html: Column) -> Column:
    return F.pandas_udf(_markdown, T.StringType())(html)


def page_attempt(html: Column) -> Column:
    """struct<md, error>, one of them null."""
    return F.pandas_udf(_attempts, T.StructType().add("md", "string").add("error", "string"))(html)


def page_links(html: Column, base: Column) -> Column:
    return F.pandas_udf(_links, T.ArrayType(T.StringType()))(html, base)
