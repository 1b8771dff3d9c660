"""Prose: what searches run over, for comments and document regions alike."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# White space as text tools on the web see it. Fixed values.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACE = re.compile(f"[{SPACES}]+")
_RULE = re.compile(r"[-=*_/#~+]{3,}\Z")
# Comment delimiters and line markers, longest first. Fixed values.
BLOCKS = (("/*", "*/"), ("<!--", "-->"))
MARKERS = ("///", "//!", "//", "##", "#!", "#")
PREVIEW_LINES, PREVIEW_CHARS = 8, 200


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def is_block_comment(raw: str) -> bool:
    return raw.startswith(tuple(b[0] for b in BLOCKS))


def normalize_comment(raw: str) -> str:
    """A comment without markers, gutters and rules, on one line; a shape that isn't known stays whole."""
    for opener, closer in BLOCKS:
        if raw.startswith(opener):
            body = raw[len(opener) :].removesuffix(closer)
            lines = [x.lstrip() for x in re.sub(r"\A[*!]+", "", body).split("\n")]
            lines = [x[1:] if x.startswith("*") and not x.startswith("*/") else x for x in lines]
            return collapse(" ".join(x for x in lines if not _RULE.match(x.strip())))
    lines, known = [], False
    for line in map(str.lstrip, raw.split("\n")):
        marker = next((m for m in MARKERS if line.startswith(m)), None)
        if marker:
            known = True
            line = line.lstrip(marker[0])  # a longer run of the marker's character is a rule, not prose
        lines.append(line)
    return collapse(" ".join(x for x in lines if not _RULE.match(x.strip()))) if known else collapse(raw)


def normalize_doc(text: Column | str) -> Column:
    """White space, in the web's sense, collapsed and trimmed: a JVM expression."""
    c = text if isinstance(text, Column) else F.col(text)
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def ascii_fold(text: Column | str) -> Column:
    c = text if isinstance(text, Column) else F.col(text)
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mentions(text: Column | str, term: str, case: bool = False) -> Column:
    """``term`` as written somewhere in the text: no wildcard has a meaning, ASCII case is ignored unless ``case``."""
    c = text if isinstance(text, Column) else F.col(text)
    return F.contains(c, F.lit(term)) if case else F.contains(ascii_fold(c), ascii_fold(F.lit(term)))


def preview(raw: Column | str) -> Column:
    """The first lines, each shortened, and how many lines are left out."""
    c = raw if isinstance(raw, Column) else F.col(raw)
    lines = F.split(c, "\n", -1)
    shown = F.array_join(F.transform(F.slice(lines, 1, PREVIEW_LINES), lambda x: F.when(F.length(x) > PREVIEW_CHARS, F.concat(F.substring(x, 1, PREVIEW_CHARS), F.lit("…"))).otherwise(x)), "\n")
    more = F.size(lines) - PREVIEW_LINES
    return F.when(more > 0, F.concat(shown, F.lit("\n… "), more.cast("string"), F.lit(" more lines"))).otherwise(shown)
