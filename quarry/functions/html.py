"""A small reader of HTML for pandas functions: visible text, links, and sections of the main content.

A page is read once into a list of marks (an element opens, an element closes, a text); each result is one pass over
the marks, or over those of one element. There is no tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

#: Elements without content, elements that end an open one of the same family, and what is not content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SIBLINGS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
NOT_CONTENT = {"script", "style", "nav", "footer", "header", "svg", "noscript"}
NOT_VISIBLE = {"script", "style", "noscript", "head"}
IN_TEXT = {"p", "blockquote", "dd", "figcaption", "dl", "figure"}
NO_LINK = ("mailto:", "javascript:", "tel:", "data:")
SELECTORS: dict[str, Callable[[str, dict], bool]] = {
    "main": lambda tag, attrs: tag == "main", "article": lambda tag, attrs: tag == "article", '[role="main"]': lambda tag, attrs: attrs.get("role") == "main",
    ".content": lambda tag, attrs: "content" in attrs.get("class", "").split(), "#content": lambda tag, attrs: attrs.get("id") == "content",
}
#: Elements open at once; deeper ones count as closed where they open.
DEEPEST = 200


@dataclass
class Mark:
    """An element that opens (close: the place of the mark that closes it), one that closes (tag only), or a text."""

    tag: str | None = None
    attrs: dict[str, str] | None = None
    text: str = ""
    close: int = 0


class _Marks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.marks: list[Mark] = []
        self.open: list[Mark] = []

    def shut(self) -> None:
        mark = self.open.pop()
        mark.close = len(self.marks)
        self.marks.append(Mark(mark.tag))

    def handle_starttag(self, tag, attrs) -> None:
        if self.open and self.open[-1].tag in SIBLINGS.get(tag, ()):
            self.shut()
        self.open.append(Mark(tag, {k: v or "" for k, v in attrs}))
        self.marks.append(self.open[-1])
        if tag in VOID or len(self.open) > DEEPEST:
            self.shut()

    def handle_startendtag(self, tag, attrs) -> None:
        self.open.append(Mark(tag, {k: v or "" for k, v in attrs}))
        self.marks.append(self.open[-1])
        self.shut()

    def handle_endtag(self, tag) -> None:
        if any(m.tag == tag for m in self.open):
            while self.open[-1].tag != tag:
                self.shut()
            self.shut()

    def handle_data(self, data) -> None:
        self.marks.append(Mark(text=data))


def parsed(html: str) -> list[Mark]:
    reader = _Marks()
    reader.feed(html or "")
    reader.close()
    while reader.open:
        reader.shut()
    return reader.marks


def without(marks: list[Mark], tags: set[str]) -> list[Mark]:
    """The marks but those of elements with these tags and of all inside them, places brought in line."""
    out, again, i = [], {}, 0
    while i < len(marks):
        mark = marks[i]
        if mark.attrs is not None and mark.tag in tags:
            i = mark.close + 1
            continue
        again[i] = len(out)
        out.append(Mark(mark.tag, mark.attrs, mark.text, mark.close))
        i += 1
    for mark in out:
        if mark.attrs is not None:
            mark.close = again[mark.close]
    return out


def _inside(marks: list[Mark], at: int | None) -> list[Mark]:
    """What the element at a place holds; all marks for no place. Places in the result still count from the whole."""
    return marks if at is None else marks[at + 1 : marks[at].close]


def _first(marks: list[Mark], test: Callable[[str, dict], bool]) -> int | None:
    return next((i for i, m in enumerate(marks) if m.attrs is not None and test(m.tag, m.attrs)), None)


def visible_text(html: str) -> str:
    marks = parsed(html)
    out, hidden = [], 0
    for m in _inside(marks, _first(marks, lambda tag, _: tag == "body")):
        if m.tag in NOT_VISIBLE:
            hidden += 1 if m.attrs is not None else -1
        elif not hidden:
            out.append(m.text)
    return "".join(out).strip()


def links(html: str, base: str) -> list[str]:
    """Pages of the same origin that a page links to, without fragment and trailing slash, each once, in order."""
    out: dict[str, None] = {}
    own = urlsplit(base)
    for mark in parsed(html):
        href = mark.attrs.get("href", "").strip() if mark.attrs is not None and mark.tag == "a" else ""
        if not href or href.startswith("#") or href.lower().startswith(NO_LINK):
            continue
        try:
            url = urldefrag(urljoin(base, href)).url
            there = urlsplit(url)
        except ValueError:
            continue
        if (there.scheme, there.netloc) == (own.scheme, own.netloc):
            out[url.rstrip("/")] = None
    return list(out)


def content_selector(marks: list[Mark]) -> tuple[str, int] | None:
    """The first of main, article, role main, class content and id content that a page has, and its place."""
    found = ((name, _first(marks, test)) for name, test in SELECTORS.items())
    return next((f for f in found if f[1] is not None), None)


def _squeezed(lines: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@dataclass
class _Scope:
    """Where the marks of an element go. kind: flow (lines of the section), lines (of a block), raw (text as it stands), list, cells (of a table) or none."""

    kind: str
    tag: str = ""
    lines: list[str] = field(default_factory=list)
    #: Of a table, its rows as lists of cells, each a list of texts; rows and cells that are open.
    rows: list[list[list[str]]] = field(default_factory=list)
    open_rows: list[list[list[str]]] = field(default_factory=list)
    open_cells: list[list[str]] = field(default_factory=list)


class _Outline:
    """Sections of the marks that it is fed: lines gather in the innermost scope and go to the one around it when its element closes."""

    def __init__(self) -> None:
        self.sections: list[tuple[str | None, int, str]] = []
        self.heading, self.level = None, 0
        self.scopes = [_Scope("flow")]

    def end_section(self) -> None:
        if text := _squeezed(self.scopes[0].lines):
            self.sections.append((self.heading, self.level, text))
        self.scopes[0].lines = []

    def scope_of(self, mark: Mark, outer: _Scope) -> _Scope:
        tag = mark.tag
        if outer.kind in ("none", "raw", "cells"):
            # the same place, whatever opens there
            return outer
        if outer.kind == "list":
            return _Scope("lines" if tag == "li" else "none", tag)
        if tag == "pre" or re.fullmatch("h[1-6]", tag):
            return _Scope("raw", tag)
        if tag in ("ul", "ol"):
            return _Scope("list", tag)
        if tag == "table":
            return _Scope("cells", tag)
        if outer.kind == "flow" and tag not in IN_TEXT:
            return outer
        return _Scope("lines", tag)

    def put(self, scope: _Scope, line: str) -> None:
        if line or scope.kind == "list":
            scope.lines.append(line)

    def feed(self, marks: list[Mark]) -> None:
        for mark in marks:
            scope = self.scopes[-1]
            if mark.tag is None:
                self.text(scope, mark.text)
            elif mark.attrs is not None:
                if mark.tag == "img" and scope.kind in ("flow", "lines") and mark.attrs.get("alt"):
                    self.put(scope, f"[image: {mark.attrs['alt']}]")
                inner = self.scope_of(mark, scope)
                if inner.kind == "cells" and mark.tag == "tr":
                    inner.rows.append([])
                    inner.open_rows.append(inner.rows[-1])
                if inner.kind == "cells" and mark.tag in ("th", "td"):
                    inner.open_cells.append([])
                    for row in inner.open_rows:
                        row.append(inner.open_cells[-1])
                if scope.kind == "flow" and inner.kind == "raw" and mark.tag in ("h1", "h2", "h3"):
                    self.end_section()
                self.scopes.append(inner)
            else:
                self.scopes.pop()
                self.closed(mark.tag, scope)
        self.end_section()

    def text(self, scope: _Scope, text: str) -> None:
        if scope.kind == "raw":
            scope.lines.append(text)
        elif scope.kind == "cells":
            for cell in scope.open_cells:
                cell.append(text)
        elif scope.kind in ("flow", "lines"):
            self.put(scope, text.strip())

    def closed(self, tag: str, scope: _Scope) -> None:
        outer = self.scopes[-1]
        if scope.kind == "cells" and tag == "tr":
            scope.open_rows.pop()
        if scope.kind == "cells" and tag in ("th", "td"):
            scope.open_cells.pop()
        if scope is outer or scope.kind == "none":
            return
        if scope.kind == "raw" and scope.tag == "pre":
            self.put(outer, f"\n```\n{''.join(scope.lines)}\n```\n")
        elif scope.kind == "raw" and outer.kind == "flow" and scope.tag in ("h1", "h2", "h3"):
            self.heading, self.level = "".join(scope.lines).strip(), int(scope.tag[1])
        elif scope.kind == "raw":
            if heading := "".join(scope.lines).strip():
                self.put(outer, heading if outer.kind == "lines" else "\n" + heading)
        elif scope.kind == "list":
            for i, line in enumerate(scope.lines, 1):
                self.put(outer, f"{i}. {line}" if scope.tag == "ol" else f"- {line}")
        elif scope.kind == "cells":
            for row in scope.rows:
                if row:
                    self.put(outer, " | ".join("".join(cell).strip() for cell in row))
        else:
            self.put(outer, _squeezed(scope.lines))


def _named(marks: list[Mark], tag: str) -> str | None:
    """The text of the first element with this tag that has any."""
    texts = ("".join(x.text for x in _inside(marks, i)).strip() for i, m in enumerate(marks) if m.attrs is not None and m.tag == tag)
    return next((t for t in texts if t), None)


def sections(html: str) -> tuple[str | None, list[tuple[str | None, int, str]]]:
    """The title of a page and, of its main content, (heading, level, text) between headings of level 1 to 3."""
    marks = without(parsed(html), NOT_CONTENT)
    found = content_selector(marks)
    top = found[1] if found else _first(marks, lambda tag, _: tag == "body")
    name = _named(marks, "title")
    outline = _Outline()
    outline.feed(_inside(marks, top))
    return re.sub(r"^(.+)\s+[—\-|]\s+.+$", r"\1", name) if name else _named(marks, "h1"), outline.sections
