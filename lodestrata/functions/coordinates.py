"""Positions in UTF-16 code units, and text edits addressed by them."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

Position = tuple[int, int]
_BREAK = re.compile(r"\r\n|\n|\r")


def utf16_length(text: Column | str) -> Column:
    c = text if isinstance(text, Column) else F.col(text)
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


class Coordinates:
    """Offsets and positions of one text; a position outside the text, or inside a CRLF or a surrogate pair, is refused."""

    def __init__(self, text: str):
        self.text = text
        self.units = text.encode("utf-16-le")
        n = len(self.units) // 2
        breaks = [m.span() for m in _BREAK.finditer(text)]
        if n > len(text):  # characters of two units move what comes after them
            wide = [i for i, c in enumerate(text) if c > "\uffff"]
            breaks = [(a + (k := bisect.bisect_left(wide, a)), z + k) for a, z in breaks]
        self._ends = [a for a, _ in breaks] + [n]
        self._starts = [0] + [z for _, z in breaks]

    def line_count(self) -> int:
        return len(self._starts)

    def line_text(self, line: int) -> str | None:
        if not 0 <= line < len(self._starts):
            return None
        return self.units[2 * self._starts[line] : 2 * self._ends[line]].decode("utf-16-le", "surrogatepass")

    def offset(self, at: Position) -> int | None:
        line, character = at
        if not 0 <= line < len(self._starts) or not 0 <= character <= self._ends[line] - self._starts[line]:
            return None
        offset = self._starts[line] + character
        if 0 < offset < len(self.units) // 2 and 0xDC <= self.units[2 * offset + 1] <= 0xDF and 0xD8 <= self.units[2 * offset - 1] <= 0xDB:
            return None
        return offset

    def position(self, offset: int) -> Position | None:
        if not 0 <= offset <= len(self.units) // 2:
            return None
        line = bisect.bisect_right(self._starts, offset) - 1
        character = offset - self._starts[line]
        return (line, character) if offset <= self._ends[line] else None

    def span(self, start: Position, end: Position) -> tuple[int, int] | None:
        a, b = self.offset(start), self.offset(end)
        return None if a is None or b is None or a > b else (a, b)

    def cut(self, start: Position, end: Position) -> str | None:
        span = self.span(start, end)
        return None if span is None else self.units[2 * span[0] : 2 * span[1]].decode("utf-16-le", "surrogatepass")


@dataclass(frozen=True)
class Edit:
    start: Position
    end: Position
    text: str


@dataclass
class EditPlan:
    """Edits in order of place; refused ones with why; insertion points where several were joined."""

    edits: list[tuple[int, int, str]]
    conflicts: list[tuple[Edit, str]]
    joined: list[int]


def plan_edits(at: Coordinates, edits: list[Edit]) -> EditPlan:
    """Equal edits count once, insertions at one point are joined, others that meet are conflicts."""
    plan = EditPlan([], [], [])
    by: dict[tuple[int, int], tuple[Edit, str]] = {}
    for e in edits:
        span = at.span(e.start, e.end)
        if span is None:
            plan.conflicts.append((e, "unaddressable"))
        elif span not in by:
            by[span] = (e, e.text)
        elif by[span][1] == e.text:
            continue
        elif span[0] == span[1]:
            by[span] = (e, by[span][1] + e.text)
            if span[0] not in plan.joined:
                plan.joined.append(span[0])
        else:
            plan.conflicts.append((e, "duplicate"))
    end = -1
    for span in sorted(by):
        if span[0] < end:
            plan.conflicts.append((by[span][0], "overlapping"))
        else:
            plan.edits.append((*span, by[span][1]))
            end = max(end, span[1])
    return plan


def apply_edits(text: str, edits: list[Edit]) -> tuple[str | None, str | None]:
    """(new text, None), or (None, problem): nothing is applied where the result would depend on order."""
    at = Coordinates(text)
    plan = plan_edits(at, edits)
    if plan.conflicts:
        e, why = plan.conflicts[0]
        return None, f"edit at {e.start[0]}:{e.start[1]} is {why}"
    if plan.joined:
        return None, f"several insertions at offset {plan.joined[0]}"
    units, out, done = at.units, [], 0
    for a, b, new in plan.edits:
        out += [units[2 * done : 2 * a], new.encode("utf-16-le", "surrogatepass")]
        done = b
    return b"".join([*out, units[2 * done :]]).decode("utf-16-le", "surrogatepass"), None
