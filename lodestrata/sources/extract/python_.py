"""Python by its own grammar: declarations, references bound inside the file, imports, literals, comments, metrics."""

from __future__ import annotations

import ast
import io
import tokenize

from lodestrata.functions.ids import Descriptor

MAX_INTEGER = 1 << 53
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case, ast.Assert)
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def parse(facts) -> None:
    text = facts.text.removeprefix("\ufeff")
    shift = len(facts.text) - len(text)
    tree = ast.parse(text)
    _Reader(facts, text, shift).read(tree)
    if "#" not in text and "\r" not in text:
        return
    starts = _line_starts(text)
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                s = starts[t.start[0] - 1] + t.start[1] + shift
                facts.comments.append({"raw": t.string, **facts.span(s, s + len(t.string))})
    except (tokenize.TokenError, IndentationError) as e:
        raise SyntaxError(str(e)) from e


def _line_starts(text: str) -> list[int]:
    out = [0]
    for line in io.StringIO(text, newline=""):
        out.append(out[-1] + len(line))
    return out


class _Scope:
    def __init__(self, kind: str, symbol: str | None, path: tuple, outer: _Scope | None):
        self.kind, self.symbol, self.path, self.outer = kind, symbol, path, outer
        self.names: dict[str, list[str]] = {}
        self.opaque: set[str] = set()  # bound to something without a declaration here: imports, parameters
        self.star = False

    def add(self, name: str, symbol: str) -> None:
        self.names.setdefault(name, [])
        if symbol not in self.names[name]:
            self.names[name].append(symbol)


class _Reader:
    def __init__(self, facts, text: str, shift: int):
        self.facts, self.text, self.shift = facts, text, shift
        self.lines = text.encode().split(b"\n")
        self.starts = _line_starts(text)
        self.exports: set[str] | None = None
        self.pending: list[tuple] = []

    def at(self, line: int, col: int) -> int:
        """Character offset of an ast position (1-based line, UTF-8 column)."""
        return self.shift + self.starts[line - 1] + len(self.lines[line - 1][:col].decode("utf-8", "ignore"))

    def span(self, n: ast.AST) -> tuple[int, int]:
        return self.at(n.lineno, n.col_offset), self.at(n.end_lineno, n.end_col_offset)

    def read(self, tree: ast.Module) -> None:
        for n in tree.body:
            if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
                self.exports = {e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
        self.root = _Scope("module", None, (), None)
        self.block(tree.body, self.root)
        for node, scope, role in self.pending:
            self.bind(node, scope, role)

    def visibility(self, name: str, scope: _Scope) -> tuple[str, bool | None]:
        if scope.kind == "function":
            return "local", False
        if scope.kind == "class":
            return ("private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") and not name.startswith("__") else "public"), None
        if self.exports is not None:
            return ("public", True) if name in self.exports else ("fileLocal", False)
        return ("fileLocal", False) if name.startswith("_") else ("public", True)

    def block(self, body: list[ast.stmt], scope: _Scope) -> None:
        doc = body[0].value if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str) else None
        for n in body:
            if not (doc is not None and n is body[0]):
                self.statement(n, scope)

    def statement(self, n: ast.AST, scope: _Scope) -> None:
        if isinstance(n, _DEFS):
            self.definition(n, scope)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            self.imported(n, scope)
        elif isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            for t in targets:
                self.target(t, n, scope, isinstance(n, ast.AugAssign))
            if isinstance(n, ast.AnnAssign):
                self.expression(n.annotation, scope, "typeUse")
            if n.value is not None:
                self.expression(n.value, scope)
        else:
            for field, value in ast.iter_fields(n):
                for v in value if isinstance(value, list) else [value]:
                    if isinstance(v, ast.stmt):
                        self.statement(v, scope)
                    elif isinstance(v, ast.expr):
                        if field == "target":
                            self.target(v, n, scope, False)
                        else:
                            self.expression(v, scope)
                    elif isinstance(v, ast.AST):
                        self.statement(v, scope)

    def target(self, t: ast.expr, n: ast.AST, scope: _Scope, both: bool) -> None:
        if isinstance(t, ast.Name):
            if scope.kind != "function" and t.id not in scope.names and not both:
                kind = "property" if scope.kind == "class" else "constant" if t.id.isupper() else "variable"
                path = (*scope.path, Descriptor("term", t.id))
                visible, exported = self.visibility(t.id, scope)
                a, z = self.span(t)
                end = self.span(n)[1] if isinstance(n, (ast.Assign, ast.AnnAssign)) else z
                scope.add(t.id, self.facts.declare(path, kind, a, end, a, z, scope.symbol, visibility=visible, exported=exported))
            elif scope.kind == "function":
                scope.opaque.add(t.id)
            self.pending.append((t, scope, "write"))
            if both:
                self.pending.append((t, scope, "read"))
        elif isinstance(t, (ast.Tuple, ast.List)):
            for e in t.elts:
                self.target(e, n, scope, both)
        elif isinstance(t, ast.Starred):
            self.target(t.value, n, scope, both)
        elif isinstance(t, ast.Attribute):
            self.expression(t.value, scope)
            self.pending.append((t, scope, "write"))
        else:
            self.expression(t, scope)

    def definition(self, n, scope: _Scope) -> None:
        is_class = isinstance(n, ast.ClassDef)
        kind = "class" if is_class else ("constructor" if n.name == "__init__" else "method") if scope.kind == "class" else "function"
        a, z = self.span(n)
        if n.decorator_list:
            a = self.span(n.decorator_list[0])[0] - 1
        name_at = self.text.index(n.name, self.at(n.lineno, n.col_offset) - self.shift + (6 if is_class else 4)) + self.shift
        visible, exported = self.visibility(n.name, scope)
        metrics = {"mLines": n.end_lineno - n.lineno + 1}
        if not is_class:
            args = n.args
            inner = [x for x in ast.walk(n) if x is not n]
            metrics |= {
                "mParameters": len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) + bool(args.vararg) + bool(args.kwarg),
                "mBranches": 1 + sum(isinstance(x, _BRANCHES) for x in inner) + sum(len(x.values) - 1 for x in inner if isinstance(x, ast.BoolOp)), "mNesting": _nesting(n.body, 0),
            }
        if scope.kind == "function":
            path = (*scope.path, Descriptor("type" if is_class else "method", n.name))
        else:
            path = (*scope.path, Descriptor("type" if is_class else "method", n.name))
        head = self.text[self.at(n.lineno, n.col_offset) - self.shift : z - self.shift].split("\n", 1)[0].rstrip()
        symbol = self.facts.declare(path, kind, a, z, name_at, name_at + len(n.name), scope.symbol, visibility=visible, exported=exported, signature=head, **metrics)
        scope.add(n.name, symbol)
        inner = _Scope("class" if is_class else "function", symbol, path, scope)
        for d in n.decorator_list:
            self.expression(d, scope)
        if is_class:
            for b in n.bases:
                self.expression(b, scope, "extends", symbol)
            for k in n.keywords:
                self.expression(k.value, scope)
        else:
            for p in (*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs, *filter(None, (n.args.vararg, n.args.kwarg))):
                inner.opaque.add(p.arg)
                if p.annotation:
                    self.expression(p.annotation, scope, "typeUse")
            for d in (*n.args.defaults, *filter(None, n.args.kw_defaults)):
                self.expression(d, scope)
            if n.returns:
                self.expression(n.returns, scope, "typeUse")
        self.block(n.body, inner)

    def imported(self, n, scope: _Scope) -> None:
        is_from = isinstance(n, ast.ImportFrom)
        specifier = "." * (n.level if is_from else 0) + ((n.module or "") if is_from else "")
        for x in n.names:
            a, z = self.span(x)
            name = x.name if is_from else None
            local = x.asname or (x.name if is_from else x.name.split(".")[0])
            re_export = bool(self.exports and local in self.exports) or (x.asname is not None and x.asname == x.name)
            self.facts.imports.append({"specifier": specifier if is_from else x.name, "reExport": re_export, "name": name, "localName": x.asname, **self.facts.span(a, z)})
            if x.name == "*":
                scope.star = True
            else:
                scope.opaque.add(local)

    def expression(self, e: ast.AST, scope: _Scope, role: str = "read", origin: str | None = None) -> None:
        if isinstance(e, ast.Call):
            if isinstance(e.func, ast.Name):
                self.pending.append((e.func, scope, "call"))
            elif isinstance(e.func, ast.Attribute):
                self.pending.append((e.func, scope, "call"))
                self.expression(e.func.value, scope)
            else:
                self.expression(e.func, scope)
            for x in (*e.args, *(k.value for k in e.keywords)):
                self.expression(x, scope)
        elif isinstance(e, ast.Name):
            self.pending.append((e, scope, role if origin is None else (role, origin)))
        elif isinstance(e, ast.Attribute):
            self.pending.append((e, scope, role if origin is None else (role, origin)))
            self.expression(e.value, scope)
        elif isinstance(e, ast.Constant):
            v = e.value
            if isinstance(v, str) or isinstance(v, bool) or isinstance(v, float) and v - v == 0 or isinstance(v, int) and abs(v) <= MAX_INTEGER:
                self.facts.literal(v, *self.span(e), self.named(scope))
        elif isinstance(e, ast.UnaryOp) and isinstance(e.op, (ast.USub, ast.UAdd)) and isinstance(e.operand, ast.Constant) and type(e.operand.value) in (int, float):
            v = -e.operand.value if isinstance(e.op, ast.USub) else e.operand.value
            if abs(v) <= MAX_INTEGER:
                self.facts.literal(v, *self.span(e), self.named(scope))
        elif isinstance(e, ast.JoinedStr):
            if all(isinstance(v, ast.Constant) for v in e.values):
                self.facts.literal("".join(v.value for v in e.values), *self.span(e), self.named(scope))
            else:
                for v in e.values:
                    if isinstance(v, ast.FormattedValue):
                        self.expression(v.value, scope)
        elif isinstance(e, (ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            inner = _Scope("function", scope.symbol, scope.path, scope)
            if isinstance(e, ast.Lambda):
                inner.opaque |= {a.arg for a in (*e.args.posonlyargs, *e.args.args, *e.args.kwonlyargs, *filter(None, (e.args.vararg, e.args.kwarg)))}
                self.expression(e.body, inner)
            else:
                for g in e.generators:
                    inner.opaque |= {x.id for x in ast.walk(g.target) if isinstance(x, ast.Name)}
                    self.expression(g.iter, scope if g is e.generators[0] else inner)
                    for c in g.ifs:
                        self.expression(c, inner)
                for x in (e.key, e.value) if isinstance(e, ast.DictComp) else (e.elt,):
                    self.expression(x, inner)
        elif isinstance(e, ast.NamedExpr):
            self.target(e.target, e, scope, False)
            self.expression(e.value, scope)
        else:
            for x in ast.iter_child_nodes(e):
                if isinstance(x, ast.expr):
                    self.expression(x, scope, role if role == "typeUse" else "read")

    @staticmethod
    def named(scope: _Scope) -> str | None:
        while scope is not None and scope.symbol is None:
            scope = scope.outer
        return scope.symbol if scope else None

    def bind(self, e, scope: _Scope, role) -> None:
        role, origin = role if isinstance(role, tuple) else (role, self.named(scope))
        a, z = self.span(e)
        if isinstance(e, ast.Attribute):
            a = z - len(e.attr)
            own = scope
            while own is not None and own.kind != "class":
                own = own.outer
            if isinstance(e.value, ast.Name) and e.value.id in ("self", "cls") and own is not None and (found := own.names.get(e.attr)):
                self.facts.refer(e.attr, role, a, z, found[0] if len(found) == 1 else None, origin, candidates=found if len(found) > 1 else None, reason="Ambiguous")
            else:
                self.facts.refer(e.attr, role, a, z, None, origin, "DynamicallyTyped")
            return
        at, first = scope, True
        while at is not None:
            if at.kind != "class" or first:
                if found := at.names.get(e.id):
                    self.facts.refer(e.id, role, a, z, found[0] if len(found) == 1 else None, origin, candidates=sorted(found) if len(found) > 1 else None, reason="Ambiguous")
                    return
                if e.id in at.opaque:
                    if at.kind != "function":
                        self.facts.refer(e.id, role, a, z, None, origin, "NotIndexed")
                    return  # a parameter or a local
                if at.star:
                    self.facts.refer(e.id, role, a, z, None, origin, "Ambiguous")
                    return
            at, first = at.outer, False
        import builtins

        self.facts.refer(e.id, role, a, z, None, origin, "ExternalDependency" if hasattr(builtins, e.id) else "RuntimeConstructed" if e.id in ("exec", "eval") else "NotIndexed")


def _nesting(body: list[ast.stmt], depth: int) -> int:
    most = depth
    for n in body:
        if isinstance(n, _DEFS):
            continue
        deeper = depth + isinstance(n, _NESTS)
        most = max(most, deeper)
        for name in ("body", "orelse", "finalbody"):
            inner = getattr(n, name, None)
            if isinstance(inner, list) and inner and isinstance(inner[0], ast.stmt):
                chained = name == "orelse" and len(inner) == 1 and isinstance(n, ast.If) and isinstance(inner[0], ast.If)
                most = max(most, _nesting(inner, depth if chained else deeper))
        for h in getattr(n, "handlers", []):
            most = max(most, _nesting(h.body, deeper))
        for c in getattr(n, "cases", []):
            most = max(most, _nesting(c.body, deeper))
    return most
