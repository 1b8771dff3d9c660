"""Markdown and HTML: headings are declarations nested by level, blocks of text are regions under the last heading."""

from __future__ import annotations

import html as entities
import re

from lodestrata.functions.ids import Descriptor
from lodestrata.functions.text import collapse

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\Z")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def parse(facts) -> None:
    (_html if facts.module.lower().endswith((".html", ".htm")) else _markdown)(facts)


class _Outline:
    """Open headings by level; sections end where a heading of the same or a higher level starts."""

    def __init__(self, facts):
        self.facts, self.open, self.names = facts, [], {}

    def heading(self, level: int, title: str, start: int, end: int, name_start: int, name_end: int) -> None:
        while self.open and self.open[-1]["level"] >= level:
            self._close(start)
        outer = self.open[-1] if self.open else None
        name = collapse(title) or "heading"
        path = (*(outer["path"] if outer else ()), Descriptor("namespace", name))
        key = (outer["id"] if outer else None, name)
        self.names[key] = self.names.get(key, 0) + 1
        if self.names[key] > 1:
            self.facts.note(f"repeated heading {name}", start=name_start, end=name_end)
            path = (*path[:-1], Descriptor("namespace", name, occurrence=self.names[key]))
        self.open.append({"level": level, "path": path, "id": self.facts.symbol(*path), "start": start, "name": (name_start, name_end), "outer": outer["id"] if outer else None})

    def _close(self, end: int) -> None:
        h = self.open.pop()
        self.facts.declare(h["path"], "heading", h["start"], end, *h["name"], h["outer"])

    def finish(self, end: int) -> None:
        while self.open:
            self._close(end)
        self.facts.declarations.sort(key=lambda d: (d["startLine"], d["startChar"]))

    def region(self, start: int, end: int, fenced: bool = False, raw: str | None = None) -> None:
        raw = self.facts.text[start:end] if raw is None else raw
        if raw.strip():
            anchor = self.open[-1]["id"] if self.open else None
            self.facts.docs.append({"raw": raw, "normalized": collapse(raw), "fenced": fenced, "anchorId": anchor, **self.facts.span(start, end)})


def _markdown(facts) -> None:
    lines, at = [], 0
    for line in facts.text.split("\n"):
        lines.append((at, line.rstrip("\r")))
        at += len(line) + 1
    out, i = _Outline(facts), 0
    if lines and lines[0][1].lstrip("\ufeff").rstrip() == "---":
        close = next((k for k in range(1, len(lines)) if lines[k][1].rstrip() in ("---", "...")), None)
        if close is not None:
            for a, line in lines[1:close]:
                if m := re.match(r"([A-Za-z0-9_-]+):[ \t]*(\S.*?)[ \t]*\Z", line):
                    facts.literal(m[2].strip("'\""), a + m.start(2), a + m.end(2))
            i = close + 1
    block: int | None = None

    def flush(upto: int) -> None:
        nonlocal block
        if block is not None:
            out.region(lines[block][0], lines[upto - 1][0] + len(lines[upto - 1][1]))
            block = None

    while i < len(lines):
        a, line = lines[i]
        fence, atx = _FENCE.match(line), _ATX.match(line)
        if fence and not ("`" in fence[1] and "`" in line[fence.end() :]):
            flush(i)
            mark = fence[1]
            j = i + 1
            while j < len(lines) and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*\Z", lines[j][1]):
                j += 1
            if j > i + 1:
                out.region(lines[i + 1][0], lines[j - 1][0] + len(lines[j - 1][1]), True)
            i = j + 1
            continue
        if line.lstrip().startswith("<!--"):
            end = facts.text.find("-->", a)
            if end >= 0:
                flush(i)
                s = a + len(line) - len(line.lstrip())
                facts.comments.append({"raw": facts.text[s : end + 3], **facts.span(s, end + 3)})
                while i < len(lines) and lines[i][0] < end + 3:
                    i += 1
                continue
        if atx:
            flush(i)
            title = atx[2] or ""
            s = a + (atx.start(2) if atx[2] else atx.end(1))
            out.heading(len(atx[1]), title, a, a + len(line), s, s + len(title))
        elif block is not None and _SETEXT.match(line) and not re.match(r" {0,3}([-*+>]|\d+[.)])[ \t]", lines[block][1]):
            s, e = lines[block][0], lines[i - 1][0] + len(lines[i - 1][1])
            block = None
            out.heading(1 if "=" in line else 2, facts.text[s:e], s, a + len(line), s, e)
        elif not line.strip():
            flush(i)
        elif block is None:
            block = i
        i += 1
    flush(len(lines))
    out.finish(len(facts.text))


_TAG = re.compile(r"<!--(.*?)-->|<(h[1-6])\b[^>]*>(.*?)</\2>|<(p|li|td|blockquote|pre|div|footer)\b[^>]*>([^<]*)|<(?:a|link)\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^>]*>|<(script|style)\b[^>]*>.*?</\8>", re.S | re.I)


def _html(facts) -> None:
    out = _Outline(facts)
    for m in _TAG.finditer(facts.text):
        if m[1] is not None:
            facts.comments.append({"raw": m.group(), **facts.span(*m.span())})
        elif m[2]:
            title = entities.unescape(re.sub(r"<[^>]*>", "", m[3]))
            out.heading(int(m[2][1]), title, m.start(), m.end(), m.start(3), m.end(3))
        elif m[4]:
            out.region(m.start(5), m.end(5), m[4].lower() == "pre", entities.unescape(m[5]))
        elif m[6] is not None or m[7] is not None:
            k = 6 if m[6] is not None else 7
            facts.imports.append({"specifier": m[k], "reExport": False, "name": None, "localName": None, **facts.span(m.start(k), m.end(k))})
    out.finish(len(facts.text))
