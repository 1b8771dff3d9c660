"""A shared reader for brace languages and GDScript: declarations by keyword, imports, literals, comments, references.

One tokenizer, set up by a table for each language, splits a text into comments, strings, numbers, words and marks.  The
declaration reader follows blocks (braces, or indentation for GDScript) and looks for the language's declaration keywords;
references are words that are called, instantiated, extended or used as a value, bound to a declaration of the same file
where exactly one has the name, ambiguous where several do.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from lodestrata.functions.ids import Descriptor
from lodestrata.functions.numbers import decode_number, decode_string


@dataclass(frozen=True)
class Language:
    kinds: dict[str, str]  # keyword -> symbol kind
    modifiers: dict[str, str] = field(default_factory=dict)  # keyword -> visibility
    line: str = "//"
    block: bool = True
    nested: bool = False
    quotes: str = "\"'"
    chars: bool = False  # single quotes hold characters
    imports: tuple[str, ...] = ()
    default: str = "public"
    member_default: str = "public"
    exported: str | None = None  # keyword without which nothing is exported
    typed_functions: bool = False  # functions are written type name(…)


# What declares what in each language. Fixed values.
LANGUAGES = {
    "typescript": Language(
        {"class": "class", "interface": "interface", "enum": "enum", "function": "function", "type": "interface", "namespace": "namespace", "module": "module", "const": "constant", "let": "variable", "var": "variable"},
        {"public": "public", "private": "private", "protected": "protected"}, quotes="\"'`", imports=(r"^\s*(?:import|export)\b[^'\";]*?\bfrom\s*['\"]([^'\"]+)['\"]", r"^\s*import\s*['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)"), default="fileLocal", exported="export",
    ),
    "rust": Language(
        {"fn": "function", "struct": "struct", "enum": "enum", "trait": "interface", "mod": "module", "const": "constant", "static": "variable", "type": "interface", "union": "struct"},
        {"pub": "public"}, nested=True, quotes='"', chars=True, imports=(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;{]+?)(?:::\{[^}]*\})?\s*;", r"^\s*extern\s+crate\s+(\w+)"), default="private", member_default="private", exported="pub",
    ),
    "kotlin": Language(
        {"class": "class", "interface": "interface", "object": "class", "fun": "function", "val": "property", "var": "property", "typealias": "interface"},
        {"public": "public", "private": "private", "protected": "protected", "internal": "internal"}, nested=True, quotes='"', chars=True, imports=(r"^\s*import\s+([\w.*]+)",),
    ),
    "csharp": Language(
        {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "record": "class", "namespace": "namespace", "delegate": "interface", "event": "event"},
        {"public": "public", "private": "private", "protected": "protected", "internal": "internal"}, quotes='"', chars=True, imports=(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",), default="internal", member_default="private", typed_functions=True,
    ),
    "cpp": Language(
        {"class": "class", "struct": "struct", "enum": "enum", "namespace": "namespace", "union": "struct", "concept": "interface", "using": "interface"},
        {"public": "public", "private": "private", "protected": "protected"}, quotes='"', chars=True, imports=(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", r"^\s*import\s+([\w.:]+)\s*;"), typed_functions=True,
    ),
    "c": Language({"struct": "struct", "enum": "enum", "union": "struct"}, {"static": "fileLocal"}, quotes='"', chars=True, imports=(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",), typed_functions=True),
    "gdscript": Language(
        {"class": "class", "func": "function", "var": "property", "const": "constant", "signal": "event", "enum": "enum"}, line="#", block=False, imports=(r"\b(?:preload|load)\(\s*[\"']([^\"']+)[\"']\s*\)", r"^\s*extends\s+[\"']([^\"']+)[\"']"),
    ),
}
# Words that are followed by a parenthesis without being called. Fixed values.
_NOT_CALLS = frozenset("if for while switch catch return function fun fn func match when using lock foreach sizeof typeof await new throw super this else do in is as not and or elif assert".split())
# Words that may stand before a declaration and say nothing about its visibility, and lines that import. Fixed values.
_BESIDE = frozenset("export default static abstract async declare readonly final open data sealed override virtual inline unsafe extern partial const volatile mutable required new constexpr lateinit".split())
_STATEMENTS = {
    "kotlin": r"^[ \t]*(?:package|import)\b[^\n]*", "csharp": r"^[ \t]*(?:global[ \t]+)?using\b[^\n(]*;", "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use\b[^;]*;",
    "typescript": r"^[ \t]*import\b[^;\n(]*", "c": r"^[ \t]*#[^\n]*", "cpp": r"^[ \t]*#[^\n]*",
}
_HOLDS = {"class": "type", "interface": "type", "enum": "type", "struct": "type", "namespace": "namespace", "module": "namespace"}
_WORD = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_']+|0[bB][01_']+|0[oO][0-7_]+|(?:\d[\d_']*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)\w*")


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, mark, newline
    text: str
    start: int
    end: int


def tokens(facts, lang: Language) -> list[Token]:
    text, out, i, n = facts.text, [], 0, len(facts.text)
    while i < n:
        c = text[i]
        if m := _WORD.match(text, i):
            out.append(Token("word", m.group(), i, m.end()))
            i = m.end()
        elif c == "\n":
            out.append(Token("newline", "\n", i, i + 1))
            i += 1
        elif c.isspace():
            i += 1
        elif text.startswith(lang.line, i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            raw = text[i:end].rstrip("\r")
            facts.comments.append({"raw": raw, **facts.span(i, i + len(raw))})
            i = end
        elif lang.block and text.startswith("/*", i):
            depth, j = 1, i + 2
            while depth and j < n:
                if text.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                elif lang.nested and text.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                else:
                    j += 1
            if depth:
                raise ValueError("a comment does not end")
            facts.comments.append({"raw": text[i:j], **facts.span(i, j)})
            i = j
        elif c in lang.quotes or lang.chars and c == "'":
            triple = text[i : i + 3] == c * 3 and c != "`" and facts.language in ("kotlin", "gdscript", "csharp")
            quote = c * 3 if triple else c
            if c == "'" and facts.language == "rust" and not re.match(r"'(?:\\.[^']*|[^'\\])'", text[i:]):
                i += 1  # a lifetime
                continue
            j = i + len(quote)
            while j < n and not text.startswith(quote, j):
                if text[j] == "\n" and not triple and c != "`" and facts.language != "rust":
                    raise ValueError(f"a string does not end at {i}")
                j += 2 if text[j] == "\\" else 1
            if j >= n:
                raise ValueError(f"a string does not end at {i}")
            out.append(Token("string", text[i + len(quote) : j], i, j + len(quote)))
            i = j + len(quote)
        elif (c.isdigit() or c == "." and i + 1 < n and text[i + 1].isdigit()) and (m := _NUMBER.match(text, i)):
            out.append(Token("number", m.group(), i, m.end()))
            i = m.end()
        else:
            out.append(Token("mark", c, i, i + 1))
            i += 1
    return out


def _closing(ts: list[Token]) -> dict[int, int]:
    """Index of an opening bracket -> index of the one that closes it."""
    pairs, stack, of = {}, [], {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(ts):
        if t.kind == "mark":
            if t.text in "([{":
                stack.append(i)
            elif t.text in of:
                while stack and ts[stack[-1]].text != of[t.text]:
                    if t.text != "}":
                        raise ValueError(f"unmatched {t.text} at {t.start}")
                    stack.pop()
                if not stack:
                    raise ValueError(f"unmatched {t.text} at {t.start}")
                pairs[stack.pop()] = i
    if any(ts[i].text == "{" for i in stack):
        raise ValueError("a block does not end")
    return pairs


def parse(facts) -> None:
    lang = LANGUAGES[facts.language]
    every = tokens(facts, lang)
    ts = [t for t in every if t.kind != "newline"]
    pairs = _closing(ts)
    ends = _indent_ends(facts) if facts.language == "gdscript" else None
    owner: list[tuple[int, int, str, tuple, str]] = []  # start, end, symbol, path, kind
    names: dict[str, list[str]] = {}
    declared_at: set[int] = set()

    implementing: list[tuple[Token, Token]] = []
    if facts.language == "rust":
        _impl_blocks(facts, ts, pairs, owner, implementing)

    def around(at: int):
        held = [o for o in owner if o[0] <= at < o[1]]
        return max(held, key=lambda o: o[0], default=None)

    levels = _levels(ts)
    starts = [t.start for t in ts]
    labels: dict[str, str] = {}  # the access label that holds now, by class

    def directly(i: int, outer) -> bool:
        """Token i stands in the body of ``outer`` itself, or of the file: in no block, bracket or parameter list inside it."""
        return levels[i] == ((levels[bisect.bisect_left(starts, outer[0])][0] + 1, 0) if outer else (0, 0))

    i = 0
    while i < len(ts):
        t = ts[i]
        if t.kind != "word":
            i += 1
            continue
        after, before = (ts[i + 1] if i + 1 < len(ts) else None), (ts[i - 1] if i else None)
        kind = lang.kinds.get(t.text) if not (before and before.text in (".", "?")) else None
        name = None
        if kind and after and after.kind == "word" and after.text not in lang.kinds:
            name, k = after, i + 1
        elif kind and after and after.kind == "word" and t.text in ("enum", "record", "const", "companion") and i + 2 < len(ts) and ts[i + 2].kind == "word":
            name, k, kind = ts[i + 2], i + 2, lang.kinds.get(after.text, kind)  # enum class X
        elif after and after.text == "(" and i + 1 in pairs and t.text not in _NOT_CALLS:
            close = pairs[i + 1]
            nxt = ts[close + 1].text if close + 1 < len(ts) else ""
            outer = around(t.start)
            typed = lang.typed_functions and before and (before.kind == "word" and before.text not in _NOT_CALLS | {"return", "new"} or before.text in "*&>]")
            method = facts.language == "typescript" and outer and outer[4] in ("class", "interface") and directly(i, outer) and (nxt in ("{", ":", ";"))
            if typed and nxt in ("{", ";", "=", ":", "const", "noexcept", "override", "where") and (outer is None or outer[4] in _HOLDS) or method:
                name, k, kind = t, i, "function"
        elif after and t.text in lang.modifiers and after.text == ":" and facts.language == "cpp" and (outer := around(t.start)):
            labels[outer[2]] = lang.modifiers[t.text]
        elif after and after.kind == "mark" and before and not (kind or t.text in lang.modifiers or t.text in _BESIDE or t.text in _NOT_CALLS):
            outer = around(t.start)
            if field_ := _field_kind(facts.language, before, after, outer, lang):
                if directly(i, outer):
                    name, k, kind = t, i, field_
        if name is None:
            i += 1
            continue
        outer = around(name.start)
        inside_function = outer is not None and outer[4] in ("function", "method")
        if inside_function and kind in ("variable", "constant", "property"):
            declared_at.add(name.start)  # a local
            i = k + 1
            continue
        if outer and outer[4] in ("class", "interface", "struct", "enum") and kind in ("function", "variable"):
            kind = "method" if kind == "function" else "property"
        if kind == "method" and outer and name.text in (outer[3][-1].name, "constructor", "_init"):
            kind = "constructor"
        words = []
        j = i - 1
        ahead = lambda j: ts[j].kind == "word" and (ts[j].text in lang.modifiers or ts[j].text in _BESIDE)
        if lang.typed_functions and name is t:  # the type stands between the modifiers and the name
            while j >= 0 and not ahead(j) and (ts[j].kind == "word" and ts[j].text not in _NOT_CALLS or ts[j].text in "<>[],.?*&" or ts[j].text == ":" and ts[j - 1].text == ":" or ts[j].text == ":" and j + 1 < i and ts[j + 1].text == ":"):
                j -= 1
        while j >= 0 and ahead(j):
            words.append(ts[j].text)
            j -= 1
        start = ts[j + 1].start
        body = _field_end(ts, pairs, k) if kind == "field" and facts.language == "rust" else _body(ts, pairs, k)
        end = ends(name.start) if ends else body[1]
        descriptor = Descriptor("method" if kind in ("function", "method", "constructor") else _HOLDS.get(kind, "term"), name.text)
        path = (*(outer[3] if outer else ()), descriptor)
        member = outer is not None and outer[4] in ("class", "interface", "struct", "enum")
        visible = next((lang.modifiers[w] for w in words if w in lang.modifiers), None)
        exported = None
        if lang.exported:
            exported = lang.exported in words if not member or facts.language == "rust" else None
            visible = visible or ("public" if exported else lang.default if not member else lang.member_default)
        elif facts.language == "gdscript":
            visible = "private" if name.text.startswith("_") else "public"
        else:
            usual = "private" if facts.language == "cpp" and outer and outer[4] == "class" else lang.member_default
            visible = visible or (("public" if outer[4] in ("interface", "enum") else labels.get(outer[2], usual)) if member else lang.default)
            exported = visible in ("public", "internal") and not inside_function
        head = facts.text[start : body[0] if body[0] > start else end].split("\n", 1)[0].strip()
        lines = facts.text.count("\n", start, end) + 1
        more = {}
        if kind in ("function", "method", "constructor") and k + 1 < len(ts) and ts[k + 1].text == "(" and k + 1 in pairs:
            more["mParameters"] = _parameters(ts, pairs, k + 1)
            more["mBranches"] = 1 + sum(x.kind == "word" and x.text in ("if", "for", "while", "case", "catch", "elif", "foreach") for x in ts[k : bisect.bisect_left(starts, end)])
        symbol = facts.declare(path, kind, start, end, name.start, name.end, outer[2] if outer else None, visibility="local" if inside_function else visible, exported=exported, signature=head or None, mLines=lines, **more)
        owner.append((start, end, symbol, path, kind))
        names.setdefault(name.text, [])
        if symbol not in names[name.text]:
            names[name.text].append(symbol)
        declared_at.add(name.start)
        i = k + 1

    known = {d["symbolId"] for d in facts.declarations}
    for d in facts.declarations:  # an impl block of a type that is declared elsewhere holds nothing here
        if d["containerId"] not in known:
            d["containerId"] = None
    owner = [o for o in owner if o[2] in known]
    for trait, own in implementing:
        mine, theirs = (names.get(t.text, []) for t in (own, trait))
        facts.refer(trait.text, "implements", trait.start, trait.end, theirs[0] if len(theirs) == 1 else None, mine[0] if len(mine) == 1 else None)
    _imports(facts, lang)
    taken = [(x["startLine"], x["startChar"]) for x in facts.imports]
    statements = [m.span() for m in re.finditer(_STATEMENTS[facts.language], facts.text, re.M)] if facts.language in _STATEMENTS else []
    heads = [a for a, _ in statements]
    waiting, open_ = sorted(owner, key=lambda o: (o[0], -o[1]), reverse=True), []
    for i, t in enumerate(ts):
        while waiting and waiting[-1][0] <= t.start:
            open_.append(waiting.pop())
        while open_ and open_[-1][1] <= t.start:
            open_.pop()
        origin = next((o[2] for o in reversed(open_) if t.start < o[1]), None)
        if t.kind == "string" and t.text and not _is_import(facts, t, taken):
            if not ("`" == facts.text[t.start] and "${" in t.text):
                facts.literal(decode_string(t.text), t.start, t.end, origin)
        elif t.kind == "number":
            v = decode_number(t.text, facts.language)
            if v is not None:
                facts.literal(int(v) if v.is_integer() else v, t.start, t.end, origin)
        elif t.kind == "word" and t.text in ("true", "false"):
            facts.literal(t.text == "true", t.start, t.end, origin)
        elif t.kind == "word" and t.start not in declared_at and t.text not in lang.kinds and t.text not in lang.modifiers and t.text not in _NOT_CALLS:
            at = bisect.bisect_right(heads, t.start) - 1
            if at >= 0 and t.start < statements[at][1]:
                continue  # part of an import, which is a fact of its own
            _reference(facts, ts, i, names, origin)


def _impl_blocks(facts, ts: list[Token], pairs: dict[int, int], owner: list, implementing: list) -> None:
    """Rust: members of ``impl T`` and ``impl Trait for T`` belong to T."""
    for i, t in enumerate(ts):
        if t.kind != "word" or t.text != "impl":
            continue
        j, depth, words, after_for = i + 1, 0, [], None
        while j < len(ts) and not (ts[j].text == "{" and depth == 0) and ts[j].text != ";":
            depth += (ts[j].text == "<") - (ts[j].text == ">" and ts[j - 1].text != "-")
            if ts[j].kind == "word" and depth == 0:
                if ts[j].text == "where":
                    depth = 0
                    while j < len(ts) and ts[j].text != "{":
                        j += 1
                    break
                if ts[j].text == "for":
                    after_for = len(words)
                else:
                    words.append(ts[j])
            j += 1
        if j >= len(ts) or j not in pairs or not words:
            continue
        own = words[-1]
        if after_for:
            implementing.append((words[after_for - 1], own))
        path = (Descriptor("type", own.text),)
        owner.append((t.start, ts[pairs[j]].end, facts.symbol(*path), path, "struct"))


def _levels(ts: list[Token]) -> list[tuple[int, int]]:
    """(open braces, open parentheses and brackets) before each token."""
    out, braces, others = [], 0, 0
    for t in ts:
        if t.kind == "mark" and t.text in "}])":
            braces, others = braces - (t.text == "}"), others - (t.text != "}")
        out.append((braces, others))
        if t.kind == "mark" and t.text in "{[(":
            braces, others = braces + (t.text == "{"), others + (t.text != "{")
    return out


def _field_kind(language: str, before: Token, after: Token, outer, lang: Language) -> str | None:
    """What a word declares without a keyword, judged by its neighbours: a field, a property, a variable, or nothing."""
    kind = outer[4] if outer else None
    if language == "typescript":
        if kind in ("class", "interface") and after.text in (":", "=", ";", "?", "!") and (before.text in ("{", ";", "}", ",") or before.text in lang.modifiers or before.text in _BESIDE):
            return "property"
    elif language == "rust":
        if kind == "struct" and after.text == ":" and (before.text in ("{", ",", ")", "]") or before.text in lang.modifiers):
            return "field"
    elif language in ("csharp", "cpp", "c") and (before.kind == "word" and before.text not in _NOT_CALLS and before.text not in lang.kinds and before.text not in lang.modifiers and before.text not in _BESIDE - {"const"} or before.text in (">", "]", "*", "&", "?")):
        if kind in ("class", "struct", "interface") and after.text in ("=", ";", ","):
            return "field"
        if language == "csharp" and kind in ("class", "struct", "interface") and after.text == "{":
            return "property"
        if language != "csharp" and outer is None and after.text in ("=", ";", "["):
            return "variable"
    return None


def _body(ts: list[Token], pairs: dict[int, int], k: int) -> tuple[int, int]:
    """(where the body starts, where the declaration ends): its braces, or the next semicolon, or the line."""
    j = k + 1
    line_end = None
    while j < len(ts):
        x = ts[j]
        if x.text == "{" and x.kind == "mark" and j in pairs:
            return x.start, ts[pairs[j]].end
        if x.text in ("(", "[") and j in pairs:
            j = pairs[j] + 1
            continue
        if x.text in (";", "}") and x.kind == "mark":
            return x.start, ts[j].end if x.text == ";" else ts[j - 1].end
        if x.kind == "word" and x.text in ("class", "interface", "enum", "fun", "fn", "func", "function", "struct", "val", "const", "let") and j > k + 1:
            break
        line_end = x.end
        j += 1
    end = line_end or ts[k].end
    return end, end


def _field_end(ts: list[Token], pairs: dict[int, int], k: int) -> tuple[int, int]:
    """A field that ends at a comma outside all brackets, or with its block."""
    j, angle = k + 1, 0
    while j < len(ts) and not (ts[j].text == "}" or ts[j].text == "," and angle <= 0):
        angle += (ts[j].text == "<") - (ts[j].text == ">" and ts[j - 1].text != "-")
        j = pairs.get(j, j) + 1
    return ts[j - 1].end, ts[j - 1].end


def _parameters(ts: list[Token], pairs: dict[int, int], at: int) -> int:
    depth, commas, any_ = 0, 0, False
    for t in ts[at + 1 : pairs[at]]:
        depth += (t.text in "([{<" and t.kind == "mark") - (t.text in ")]}>" and t.kind == "mark")
        commas += t.text == "," and depth <= 0
        any_ = True
    return commas + any_


def _indent_ends(facts):
    lines, starts, at = facts.text.split("\n"), [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1

    def end(offset: int) -> int:
        n = bisect.bisect_right(starts, offset) - 1
        indent = len(lines[n]) - len(lines[n].lstrip())
        last = n
        for k in range(n + 1, len(lines)):
            if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent:
                break
            if lines[k].strip():
                last = k
        return starts[last] + len(lines[last])

    return end


def _imports(facts, lang: Language) -> None:
    for pattern in lang.imports:
        for m in re.finditer(pattern, facts.text, re.M):
            head = facts.text[m.start() : m.end()]
            base = {"specifier": m[1].strip(), "reExport": bool(re.match(r"\s*(?:export|pub)\b", head)), **facts.span(m.start(1), m.end(1))}
            named = re.search(r"\{([^}]*)\}", head)
            if named and facts.language in ("typescript", "rust"):
                for one in filter(None, (x.strip() for x in named[1].split(","))):
                    name, _, local = re.sub(r"^type\s+", "", one).partition(" as ")
                    facts.imports.append(base | {"name": name.strip(), "localName": local.strip() or None})
            elif facts.language == "typescript" and (d := re.match(r"\s*import\s+(?:type\s+)?(\w+)", head)) and d[1] != "type":
                facts.imports.append(base | {"name": "default", "localName": d[1]})
            else:
                facts.imports.append(base | {"name": None, "localName": None})


def _is_import(facts, t: Token, taken: list) -> bool:
    s = facts.span(t.start + 1, t.end)
    return (s["startLine"], s["startChar"]) in taken


def _reference(facts, ts: list[Token], i: int, names: dict[str, list[str]], origin: str | None) -> None:
    t = ts[i]
    before, after = ts[i - 1].text if i else "", ts[i + 1].text if i + 1 < len(ts) else ""
    member = before in (".", "->") or before == ">" and i > 1 and ts[i - 2].text == "-"
    if LANGUAGES[facts.language].typed_functions and after in ("=", ";") and i and ts[i - 1].kind == "word" and before not in _NOT_CALLS:
        return  # a local variable behind its type
    then = ts[i + 2].text if i + 2 < len(ts) else ""
    if before == "new":
        role = "instantiate"
    elif before == "impl":
        role = "typeUse"
    elif before in ("extends", "implements"):
        role = before
    elif after == "(":
        role = "call"
    elif after == "=" and then not in ("=", ">"):
        role = "write"
    elif after in ("+", "-", "*", "/", "%", "&", "|", "^") and then == "=" or after in ("+", "-") and then == after or before in ("+", "-") and i > 1 and ts[i - 2].text == before:
        role = "write"  # compound assignment, increment, decrement
    elif t.text in names or member:
        role = "read"
    else:
        return  # a word that nothing here declares and nothing calls
    found = names.get(t.text, [])
    if member and before == "." and (i < 2 or ts[i - 2].text not in ("this", "self", "Self")):
        facts.refer(t.text, role, t.start, t.end, None, origin, "DynamicallyTyped")
    elif len(found) == 1:
        facts.refer(t.text, role, t.start, t.end, found[0], origin)
    elif found:
        facts.refer(t.text, role, t.start, t.end, None, origin, "Ambiguous", sorted(found))
    else:
        facts.refer(t.text, role, t.start, t.end, None, origin, "NotIndexed")
