"""JSON, JSON lines and YAML: keys become property declarations, scalars literals of their key.

Array elements are ordinal namespaces ``[i]`` without a declaration; a repeated key keeps its last value and is noted.
"""

from __future__ import annotations

import json
import re

from lodestrata.functions.ids import Descriptor

DEEPEST = 1000
_TOKEN = re.compile(r'[ \t\r\n\ufeff]+|//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[{}\[\],:]', re.S)


def parse(facts) -> None:
    suffix = facts.module.rsplit(".", 1)[-1].lower()
    if suffix in ("yml", "yaml"):
        _yaml(facts)
    elif suffix in ("jsonl", "ndjson"):
        at = n = 0
        for line in facts.text.split("\n"):
            if line.strip():
                _json(facts, at, at + len(line), (Descriptor("namespace", f"[{n}]"),))
                n += 1
            at += len(line) + 1
    else:
        _json(facts, 0, len(facts.text), ())


def _tokens(facts, at: int, end: int) -> list[tuple[str, int, int]]:
    out, depth = [], 0
    strict = facts.module.lower().endswith(".json")
    seen = set()
    while at < end:
        m = _TOKEN.match(facts.text, at, end)
        if m is None:
            raise ValueError(f"unexpected {facts.text[at]!r} at {at}")
        s, at = m.group(), m.end()
        if s.startswith(("//", "/*")):
            facts.comments.append({"raw": s, **facts.span(m.start(), at)})
            if strict and "comment" not in seen:
                seen.add("comment")
                facts.note("comments are not JSON", start=m.start(), end=at)
        elif s[0] not in " \t\r\n\ufeff":
            depth += (s in "{[") - (s in "}]")
            if depth > DEEPEST:
                raise ValueError("nested too deeply")
            out.append((s, m.start(), at))
    return out


def _json(facts, start: int, end: int, path: tuple) -> None:
    tokens = _tokens(facts, start, end)
    if not tokens:
        return
    strict, noted = facts.module.lower().endswith(".json"), []
    # an explicit stack: containers may nest deeper than the interpreter's own
    stack: list[dict] = []
    i = 0

    def comma_before_end(s: int) -> None:
        if strict and not noted:
            noted.append(1)
            facts.note("a trailing comma is not JSON", start=s, end=s + 1)

    def value(tok: tuple, path: tuple, container: str | None, declared: tuple | None) -> None:
        s, a, z = tok
        if s in ("{", "["):
            stack.append({"kind": s, "path": path, "container": container, "keys": {}, "n": 0, "declared": declared, "state": "first"})
        elif s in ("}", "]", ",", ":"):
            raise ValueError(f"unexpected {s} at {a}")
        else:
            if s != "null":
                v = json.loads(s)
                if not isinstance(v, float) or v - v == 0:
                    facts.literal(v, a, z, container)
            close(declared, z)

    def close(declared: tuple | None, end_: int) -> None:
        if declared:
            p, key_start, key_end, outer, first = declared
            facts.declare(p, "property", key_start, end_, key_start, key_end, outer)

    value(tokens[0], path, None, None)
    i = 1
    while stack:
        if i >= len(tokens):
            raise ValueError("unexpected end")
        top = stack[-1]
        s, a, z = tokens[i]
        closer = "}" if top["kind"] == "{" else "]"
        if top["state"] == "more":
            i += 1
            if s == closer:
                stack.pop()
                close(top["declared"], z)
            elif s == ",":
                top["state"], top["comma"] = "next", a
            else:
                raise ValueError(f"expected , or {closer} at {a}")
            continue
        if s == closer:
            if top["state"] == "next":
                comma_before_end(top["comma"])
            i += 1
            stack.pop()
            close(top["declared"], z)
            continue
        top["state"] = "more"
        if top["kind"] == "[":
            p = (*top["path"], Descriptor("namespace", f"[{top['n']}]"))
            top["n"] += 1
            i += 1
            value((s, a, z), p, top["container"], None)
            continue
        if s[0] != '"' or i + 2 >= len(tokens) or tokens[i + 1][0] != ":":
            raise ValueError(f"expected a key at {a}")
        name = json.loads(s)
        if name == "":
            facts.note("an empty key has no declaration", start=a, end=z)
            p, container, declared = (*top["path"], Descriptor("namespace", '""')), top["container"], None
        else:
            p = (*top["path"], Descriptor("term", name))
            container, declared = facts.symbol(*p), (p, a, z, top["container"], None)
            if name in top["keys"]:
                facts.note(f"repeated key {name}: the last wins", "warning", a, z)
                _drop(facts, container)
            top["keys"][name] = True
        value(tokens[i + 2], p, container, declared)
        i += 3
    if i < len(tokens):
        raise ValueError(f"unexpected {tokens[i][0]} at {tokens[i][1]}")


def _drop(facts, symbol: str) -> None:
    """Forget an earlier value of a repeated key."""
    from lodestrata.functions.ids import is_within

    facts.declarations[:] = [d for d in facts.declarations if not is_within(d["symbolId"], symbol)]
    facts.literals[:] = [x for x in facts.literals if x["containerId"] is None or not is_within(x["containerId"], symbol)]


def _yaml(facts) -> None:
    try:
        import yaml
    except ImportError as e:
        raise ValueError("the YAML extractor needs PyYAML") from e
    try:
        roots = _composed(facts.text)
    except yaml.YAMLError as e:
        raise ValueError(str(e).split("\n")[0]) from e
    marks = list(re.finditer(r"(?m)(?:^|[ \t])(#[^\n]*)", facts.text))
    scalars = list(_scalars(roots)) if marks else []
    for m in marks:
        inside = any(t.start_mark.index < m.start(1) < t.end_mark.index for t in scalars)
        if not inside:
            facts.comments.append({"raw": m[1].rstrip("\r"), **facts.span(m.start(1), m.start(1) + len(m[1].rstrip("\r")))})
    loader = yaml.constructor.SafeConstructor()
    for n, root in enumerate(roots):
        head = (Descriptor("namespace", f"[{n}]"),) if len(roots) > 1 else ()
        work = [(root, head, None, 0)]
        seen: set[int] = set()
        while work:
            node, path, container, depth = work.pop()
            if node is None or id(node) in seen:  # an alias is not expanded
                continue
            if depth > DEEPEST:
                raise ValueError("nested too deeply")
            if isinstance(node, yaml.MappingNode):
                seen.add(id(node))
                keys: dict[str, int] = {}
                for key, value in node.value:
                    a, z = key.start_mark.index, key.end_mark.index
                    if key.tag == "tag:yaml.org,2002:merge":
                        continue
                    if not isinstance(key, yaml.ScalarNode):
                        facts.note("a key that is no scalar has no declaration", start=a, end=z)
                        continue
                    if key.value == "":
                        facts.note("an empty key has no declaration", start=a, end=z)
                        continue
                    p = (*path, Descriptor("term", key.value))
                    symbol = facts.symbol(*p)
                    if key.value in keys:
                        facts.note(f"repeated key {key.value}: the last wins", "warning", a, z)
                        _drop(facts, symbol)
                        work[:] = [w for w in work if w[2] != symbol]
                    keys[key.value] = 1
                    facts.declare(p, "property", a, max(z, value.end_mark.index), a, z, container)
                    work.append((value, p, symbol, depth + 1))
            elif isinstance(node, yaml.SequenceNode):
                seen.add(id(node))
                work += [(v, (*path, Descriptor("namespace", f"[{i}]")), container, depth + 1) for i, v in enumerate(node.value)]
            else:
                v = loader.construct_object(node) if node.tag.rsplit(":", 1)[-1] in ("bool", "int", "float") else node.value if node.tag.endswith(":str") else None
                if v is not None and (not isinstance(v, float) or v - v == 0):
                    facts.literal(v, node.start_mark.index, node.end_mark.index, container)
    facts.declarations.sort(key=lambda d: (d["startLine"], d["startChar"]))


#: Short lines of plain block YAML: here libyaml, ten times faster, gives the same nodes; a nesting this shallow suits both.
_PLAIN = re.compile(r"(?:[A-Za-z0-9 :_.\-]{0,80}\n)*[A-Za-z0-9 :_.\-]{0,80}")


def _composed(text: str) -> list:
    """The nodes of all documents; PyYAML's own loader decides about everything that is not plain, and words every error."""
    import yaml

    if hasattr(yaml, "CSafeLoader") and _PLAIN.fullmatch(text):
        try:
            return list(yaml.compose_all(text, Loader=yaml.CSafeLoader))
        except yaml.YAMLError:
            pass
    return list(yaml.compose_all(text, Loader=yaml.SafeLoader))


def _scalars(roots: list):
    import yaml

    work, seen = list(roots), set()
    while work:
        n = work.pop()
        if n is None or id(n) in seen:
            continue
        seen.add(id(n))
        if isinstance(n, yaml.ScalarNode):
            yield n
        elif isinstance(n, yaml.MappingNode):
            work += [x for kv in n.value for x in kv]
        else:
            work += n.value
