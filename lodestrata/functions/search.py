"""Search patterns, terms and globs, checked before they reach a plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

TERM_LIMIT = PATTERN_LIMIT = 2000
_FORM = re.compile(r"/((?:\\.|[^/])*)/([a-z]*)\Z", re.S)


def _refuse_unbounded(body: str) -> None:
    """Refuse what a linear-time engine lacks: lookaround, backreferences, possessive and atomic forms."""
    at, in_class, quantifier = 0, False, False
    while at < len(body):
        c = body[at]
        if c == "\\":
            nxt = body[at + 1 : at + 2]
            if not in_class and (nxt.isdigit() and nxt != "0" or nxt == "k"):
                raise ValueError("pattern refused: backreferences are not supported")
            if nxt == "G":
                raise ValueError("pattern refused: \\G is not supported")
            at, quantifier = at + 2, False
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if body[at + 1 : at + 2] == "^":
                at += 1
            if body[at + 1 : at + 2] == "]":
                at += 1
        elif c == "(" and re.match(r"\(\?(?:[=!>]|<[=!])", body[at:]):
            raise ValueError("pattern refused: lookaround and atomic groups are not supported")
        elif c == "+" and quantifier:
            raise ValueError("pattern refused: possessive quantifiers are not supported")
        quantifier = not in_class and (c in "*+?" or c == "}" and bool(re.search(r"\{\d+(?:,\d*)?\}\Z", body[: at + 1])))
        at += 1


def compile_pattern(source: str) -> str:
    """``/pattern/flags`` as a Java expression that finds anywhere; i, m and s apply, g, u and y change nothing."""
    m = _FORM.match(source)
    if m is None:
        raise ValueError("pattern refused: expected /pattern/flags")
    body, flags = m.groups()
    if len(body) > PATTERN_LIMIT:
        raise ValueError(f"pattern refused: longer than {PATTERN_LIMIT} characters")
    if wrong := set(flags) - set("imsguy"):
        raise ValueError(f"pattern refused: unsupported flag {sorted(wrong)[0]}")
    _refuse_unbounded(body)
    body = body.replace("\\/", "/")
    used = "".join(f for f in "ims" if f in flags)
    return f"(?{used}){body}" if used else body


def pattern_matches(text: Column | str, source: str) -> Column:
    return (text if isinstance(text, Column) else F.col(text)).rlike(compile_pattern(source))


def check_term(term: str) -> str:
    if "\0" in term:
        raise ValueError("term refused: it holds a NUL")
    if len(term) > TERM_LIMIT:
        raise ValueError(f"term refused: longer than {TERM_LIMIT} characters")
    return term


def text_filter(text: Column | str, term: str | None = None, pattern: str | None = None) -> Column:
    """Exactly one of a term and a pattern."""
    from lodestrata.functions.text import mentions

    if (term is None) == (pattern is None):
        raise ValueError("give a text or a pattern, not both")
    return mentions(text, check_term(term)) if term is not None else pattern_matches(text, pattern)


def word_pattern(name: str) -> str:
    """Finds ``name`` as a whole word."""
    return rf"(^|[^A-Za-z0-9_])\Q{name.replace(chr(92) + 'E', chr(92) + 'E' + chr(92) * 2 + 'E' + chr(92) + 'Q')}\E([^A-Za-z0-9_]|$)"


def glob_pattern(glob: str) -> str:
    """Anchored expression of a path glob: * stays in a segment, ** spans any number of them, ``d/**`` includes d."""
    out, rest = "", glob
    rules = (("/**/", "/(?:.*/)?"), ("/**", "(?:/.*)?"), ("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"))
    while rest:
        token, expression = next(((t, e) for t, e in rules if rest.startswith(t)), (rest[0], re.escape(rest[0]) if not rest[0].isalnum() else rest[0]))
        out += expression
        rest = rest[len(token) :]
    return f"^{out}$"


def any_glob(module: Column | str, globs: list[str]) -> Column:
    c = module if isinstance(module, Column) else F.col(module)
    found = F.lit(False)
    for g in globs:
        found = found | c.rlike(glob_pattern(g))
    return found
