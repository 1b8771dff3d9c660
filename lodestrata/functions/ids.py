"""Identities: module paths, symbol ids with structured descriptors, and content digests of facts.

A symbol id reads ``sym <language> <module> <descriptors>``; a fact id reads ``fact <kind> <module> <16 hex>``.  A fact's
digest covers its content, so an id that no longer resolves is a fact that has changed.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

from lodestrata.schema import FACT_KINDS

SYMBOL, FACT = "sym", "fact"
# Descriptor suffixes by kind, and the characters that force a name into backticks. Fixed values.
SUFFIX = {"namespace": "/", "type": "#", "term": ".", "meta": ":"}
STRUCTURAL = frozenset(" /#.:()[]`")
_DISAMBIGUATOR = re.compile(r"[A-Za-z0-9._-]+\Z")
_DRIVE = re.compile(r"[A-Za-z]:/")
_LOCAL = re.compile(r"local(0|[1-9][0-9]*)\Z")


def normalize_module(raw: str) -> str:
    """Workspace-relative, NFC, forward slashes; absolute, escaping, empty or control-character paths are refused."""
    path = unicodedata.normalize("NFC", raw).replace("\\", "/")
    if path.startswith("/") or _DRIVE.match(path):
        raise ValueError(f"absolute module path: {raw!r}")
    if any(unicodedata.category(c) == "Cc" for c in path):
        raise ValueError(f"control character in module path: {raw!r}")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"module path leaves the workspace: {raw!r}")
    if not parts:
        raise ValueError(f"empty module path: {raw!r}")
    return "/".join(parts)


@functools.lru_cache(1024)
def is_module(path: str) -> bool:
    try:
        return normalize_module(path) == path
    except ValueError:
        return False


def encode_module(module: str) -> str:
    return module.replace("%", "%25").replace(" ", "%20")


def decode_module(field: str) -> str:
    return re.sub("%(25|20)", lambda m: "%" if m[1] == "25" else " ", field)


@dataclass(frozen=True)
class Descriptor:
    kind: str
    name: str
    disambiguator: str | None = None
    occurrence: int | None = None


@dataclass(frozen=True)
class SymbolId:
    language: str
    module: str
    descriptors: tuple[Descriptor, ...] = ()
    local: int | None = None


def _quoted(name: str) -> str:
    if not name:
        raise ValueError("a descriptor needs a name")
    if not name.isascii():
        name = unicodedata.normalize("NFC", name)
    return name if STRUCTURAL.isdisjoint(name) else "`" + name.replace("`", "``") + "`"


def _written(d: Descriptor) -> str:
    name = _quoted(d.name)
    nth = "" if d.occurrence is None else f"[{d.occurrence}]"
    if d.occurrence is not None and (d.occurrence < 2 or d.kind in ("parameter", "typeParameter")):
        raise ValueError(f"no occurrence {d.occurrence} for a {d.kind}")
    if d.kind == "method":
        if d.disambiguator is not None and not _DISAMBIGUATOR.match(d.disambiguator):
            raise ValueError(f"bad disambiguator: {d.disambiguator!r}")
        return f"{name}{nth}({d.disambiguator or ''})."
    if d.kind == "parameter":
        return f"({name})"
    if d.kind == "typeParameter":
        return f"[{name}]"
    return name + nth + SUFFIX[d.kind]


def written(descriptors: tuple[Descriptor, ...]) -> str:
    return "".join(map(_written, descriptors))


def compose_symbol(s: SymbolId) -> str:
    tail = f"local{s.local}" if s.local is not None else written(s.descriptors)
    if not is_module(s.module):
        raise ValueError(f"not a canonical module: {s.module!r}")
    if not s.language or " " in s.language:
        raise ValueError(f"bad language: {s.language!r}")
    return f"{SYMBOL} {s.language} {encode_module(s.module)} {tail}"


_NAME = r"(`(?:[^`]|``)+`|[^ /#.:()\[\]`]+)"
_DESCRIPTOR = re.compile(rf"\({_NAME}\)|\[{_NAME}\]|{_NAME}(?:\[([1-9][0-9]*)\])?(?:\(([A-Za-z0-9._-]*)\)\.|([/#.:]))")
_NUMBERED = re.compile(r"\[[0-9]+\](?:\([^()]*\)\.|[/#.:])\Z")
_OF_SUFFIX = {v: k for k, v in SUFFIX.items()}


def _bare(name: str) -> str:
    return name[1:-1].replace("``", "`") if name.startswith("`") else name


def parse_symbol(text: str) -> SymbolId | None:
    """The parts of a canonical id; None for anything that the composer would not write."""
    parts = text.split(" ", 3)
    if len(parts) != 4 or parts[0] != SYMBOL or not parts[3]:
        return None
    language, module, tail = parts[1], decode_module(parts[2]), parts[3]
    if m := _LOCAL.match(tail):
        out = SymbolId(language, module, (), int(m[1]))
    else:
        found, at = [], 0
        while at < len(tail):
            m = _DESCRIPTOR.match(tail, at)
            if m is None:
                return None
            parameter, type_parameter, name, nth, dis, suffix = m.groups()
            if parameter or type_parameter:
                found.append(Descriptor("parameter" if parameter else "typeParameter", _bare(parameter or type_parameter)))
            else:
                kind = _OF_SUFFIX[suffix] if suffix else "method"
                found.append(Descriptor(kind, _bare(name), dis or None, int(nth) if nth else None))
            at = m.end()
        out = SymbolId(language, module, tuple(found))
    try:
        return out if compose_symbol(out) == text else None
    except ValueError:
        return None


def module_of(symbol: str) -> str | None:
    parsed = parse_symbol(symbol)
    return parsed.module if parsed else None


def owner_of(symbol: str) -> str | None:
    """The id with the last descriptor dropped; None at the top and for locals."""
    s = parse_symbol(symbol)
    if s is None or s.local is not None or len(s.descriptors) < 2:
        return None
    return compose_symbol(replace(s, descriptors=s.descriptors[:-1]))


def is_within(symbol: str, ancestor: str) -> bool:
    """The symbol itself, or one below it in the same module."""
    a, b = parse_symbol(symbol), parse_symbol(ancestor)
    if a is None or b is None or (a.language, a.module) != (b.language, b.module):
        return False
    if a.local is not None or b.local is not None:
        return a == b
    return a.descriptors[: len(b.descriptors)] == b.descriptors


def rebase(symbol: str, old: str, new: str) -> str | None:
    """The id that ``symbol`` has once ``old`` is called ``new``; None if it isn't within ``old``."""
    if not is_within(symbol, old):
        return None
    s, o, n = parse_symbol(symbol), parse_symbol(old), parse_symbol(new)
    return compose_symbol(replace(n, descriptors=n.descriptors + s.descriptors[len(o.descriptors) :])) if n else None


# ---- fact ids ------------------------------------------------------------------------------------------------------


def field_text(value) -> str | None:
    """Canonical text of a digest field: integers without fraction, shortest decimals, lower-case booleans."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def digest(kind: str, module: str, *fields) -> str:
    parts = []
    for f in (kind, module, *fields):
        text = field_text(f)
        parts.append("0:-" if text is None else f"{len(text.encode())}:={text}")
    return hashlib.sha256("".join(parts).encode()).hexdigest()[:16]


def fact_id(kind: str, module: str, *fields) -> str:
    if kind not in FACT_KINDS:
        raise ValueError(f"unknown fact kind {kind!r}")
    return f"{FACT} {kind} {encode_module(module)} {digest(kind, module, *fields)}"


def parse_fact(text: str) -> tuple[str, str, str] | None:
    """(kind, module, digest) of a well-formed fact id."""
    m = re.fullmatch(rf"{FACT} ({'|'.join(FACT_KINDS)}) (\S+) ([0-9a-f]{{16}})", text)
    return (m[1], decode_module(m[2]), m[3]) if m and is_module(decode_module(m[2])) else None


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def digest_column(*fields: Column | str) -> Column:
    """The digest as a JVM expression over string, integer or boolean columns."""
    parts = []
    for f in fields:
        text = _col(f).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":="), text), F.lit("0:-")))
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def fact_id_column(kind: str, module: Column | str, *fields: Column | str) -> Column:
    m = _col(module)
    field = F.replace(F.replace(m, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    return F.concat(F.lit(f"{FACT} {kind} "), field, F.lit(" "), digest_column(F.lit(kind), m, *fields))


def content_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, 32)


# ---- occurrences ---------------------------------------------------------------------------------------------------


def _with_nth(s: SymbolId, n: int | None) -> SymbolId:
    return replace(s, descriptors=(*s.descriptors[:-1], replace(s.descriptors[-1], occurrence=n)))


def number_occurrences(declarations: list[dict]) -> dict[int, str]:
    """Index -> final id where a name path is declared again in one file: the 2nd is ``[2]`` and so on, in source order.

    A declaration takes its place by start, then the wider range first, then input order; what lies inside a renamed
    declaration moves with it.
    """
    if len({d["symbolId"] for d in declarations}) == len(declarations) and not any(_NUMBERED.search(d["symbolId"]) for d in declarations):
        return {i: d["symbolId"] for i, d in enumerate(declarations)}
    order = sorted(range(len(declarations)), key=lambda i: (*declarations[i]["start"], *(-x for x in declarations[i]["end"]), i))
    used: dict[str, set[int]] = {}
    moved: list[tuple[str, str, tuple, tuple]] = []
    out: dict[int, str] = {}
    for i in order:
        d = declarations[i]
        current = d["symbolId"]
        for old, new, start, end in reversed(moved):
            if old != d["symbolId"] and start <= tuple(d["start"]) and tuple(d["end"]) <= end and (to := rebase(current, old, new)):
                current = to
                break
        s = parse_symbol(current)
        if s and s.descriptors and s.descriptors[-1].kind not in ("parameter", "typeParameter"):
            nth, base = s.descriptors[-1].occurrence or 1, compose_symbol(_with_nth(s, None))
            taken = used.setdefault(base, set())
            if nth in taken:
                nth = next(n for n in range(2, len(taken) + 3) if n not in taken)
                current = compose_symbol(_with_nth(s, nth))
            taken.add(nth)
        if current != d["symbolId"]:
            moved.append((d["symbolId"], current, tuple(d["start"]), tuple(d["end"])))
        out[i] = current
    return out
