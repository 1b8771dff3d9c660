import pytest

from lodestrata.operators.resolve import bind_across, candidates, resolve_imports
from lodestrata.sources.extract.base import explode_facts, extract


@pytest.mark.parametrize(
    "module,specifier,want",
    [
        ("p/a.py", ".b", "p/b.py"), ("p/q/a.py", "..c.d", "p/c/d.py"), ("p/a.py", "p.b", "p/b.py"), ("p/a.py", ".", "p/__init__.py"), ("s/a.ts", "./b", "s/b.ts"), ("s/a.ts", "../b.js", "b.ts"), ("s/a.ts", "./d", "s/d/index.ts"),
        ("src/x/a.rs", "crate::y::Z", "src/y.rs"), ("src/a.c", "b.h", "src/b.h"), ("g/a.gd", "res://h/b.gd", "h/b.gd"), ("d/a.html", "/x/y.html#z", "x/y.html"), ("d/a.md", "../r.md", "r.md"),
    ],
)
def test_candidates(module, specifier, want):
    assert want in candidates(module, specifier)


def test_nothing_leaves_the_root():
    assert candidates("a.ts", "../../x") == [] and candidates("a.ts", "react") == [] and candidates("a.rs", "std::io") == []


def test_binding(spark):
    texts = {
        "p/a.py": "from .b import f as g, gone\nfrom .c import *\nimport os\nfrom ext import q\ng()\nh()\nq()\ngone()\nx.f()\n",
        "p/b.py": "def f(): pass\n", "p/c.py": "def h(): pass\n", "s/m.ts": "import { k } from './n';\nk();\n", "s/n.ts": "export function k() { return 1; }\n",
    }
    facts = explode_facts(extract(spark.createDataFrame(list(texts.items()), "module string, text string")))
    files = spark.createDataFrame([(m,) for m in texts], "module string")
    resolved = resolve_imports(facts["imports"], files)
    got = {(r.module, r.specifier): (r.status, r.target) for r in resolved.collect()}
    assert got["p/a.py", ".b"] == ("resolved", "p/b.py") and got["p/a.py", "os"] == ("external", None) and got["s/m.ts", "./n"] == ("resolved", "s/n.ts")
    bound = {(r.module, r.name): (r.status, r.targetId, r.reason) for r in bind_across(facts["refs"], resolved, facts["symbols"]).filter("role = 'call'").collect()}
    assert bound["p/a.py", "g"] == ("bound", "sym python p/b.py f().", None) and bound["s/m.ts", "k"] == ("bound", "sym typescript s/n.ts k().", None)
    assert bound["p/a.py", "h"][0] == "ambiguous" and bound["p/a.py", "q"] == ("unbound", None, "ExternalDependency") and bound["p/a.py", "gone"][0] == "unbound" and bound["p/a.py", "f"] == ("unbound", None, "DynamicallyTyped")


def test_modules_are_not_gathered_on_the_driver(spark):
    imports = spark.range(50).selectExpr("concat('s/a', id, '.ts') as module", "concat('./m', id) as specifier")
    modules = spark.range(0, 50, 2).selectExpr("concat('s/m', id, '.ts') as module")
    got = resolve_imports(imports, modules)
    assert sum(r.target is not None for r in got.collect()) == 25
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    none = "cast(null as string)"
    refs = imports.selectExpr("module", "'go' as name", "'unbound' as status", f"{none} as targetId", "cast(array() as array<string>) as candidates", f"{none} as provenance", "'NotIndexed' as reason")
    named = got.selectExpr("module", "'go' as name", f"{none} as localName", "target", "status")
    bound = bind_across(refs, named, modules.selectExpr("module", "'go' as name", "concat('sym', module) as symbolId", f"{none} as containerId"))
    assert "Broadcast" not in bound._jdf.queryExecution().executedPlan().toString()
