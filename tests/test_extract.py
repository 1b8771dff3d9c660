import pytest
from pyspark.sql import functions as F

from lodestrata.functions.coordinates import Coordinates
from lodestrata.sources.extract.base import Facts, explode_facts, extract, parse_file


def names(f):
    return [(d["symbolId"].split(" ", 3)[3], d["kind"]) for d in f.declarations]


def test_json():
    f = parse_file("d/a.json", '{"a": {"b": [1, true, {"c": "é"}]}, // n\n "a": 2, "": 3,}')
    assert names(f) == [("a.", "property")] and [x["value"] for x in f.literals] == ["2", "3"]
    assert sorted(n["message"].split()[0] for n in f.notes) == ["a", "an", "comments", "repeated"]
    assert [x["value"] for x in parse_file("x.jsonl", '{"a": 1}\n\n{"a": 2}\n').literals] == ["1", "2"]
    assert [d["symbolId"] for d in parse_file("x.jsonl", '{"a": 1}\n\n{"a": 2}\n').declarations] == ["sym json x.jsonl `[0]`/a.", "sym json x.jsonl `[1]`/a."]
    for bad in ("{", '{"a" 1}', "[1 2]", '{"a": 1}}', "[" * 1200 + "]" * 1200, "nope"):
        assert parse_file("b.json", bad).error
    assert parse_file("e.json", "").error is None


def test_yaml():
    f = parse_file("a.yml", "base: &b\n  x: 1\nuse:\n  <<: *b\n  y: [true, 'q']\nuse: 3\n? [k]\n: v\n# note\n")
    assert ("use.", "property") in names(f) and [x["value"] for x in f.literals if x["containerId"].endswith("use.")] == ["3"]
    assert {n["severity"] for n in f.notes} == {"warning", "info"} and f.comments[0]["normalized"] == "note"
    assert parse_file("a.yml", "a: [1").error


def test_markdown():
    f = parse_file("r.md", "---\nk: v\n---\nintro\n\n# One #\nbody\nmore\n## Two\n~~~\n# no\n~~~\n# One\nSet\n===\n<!-- c -->\n")
    assert names(f) == [("One/", "heading"), ("One/Two/", "heading"), ("One[2]/", "heading"), ("Set/", "heading")]
    assert [(d["normalized"], d["fenced"], (d["anchorId"] or "").split(" ")[-1]) for d in f.docs] == [("intro", False, ""), ("body more", False, "One/"), ("# no", True, "One/Two/")]
    assert f.literals[0]["value"] == "v" and f.comments[0]["raw"] == "<!-- c -->"


def test_python():
    f = parse_file("p/m.py", 'import os as o\nfrom .k import *\n__all__ = ["run"]\nclass A(Base):\n    """doc"""\n    X = -2\n    def __init__(self, a: "T"):\n        self.go()\n    def go(self): return other(self.X)\ndef run(n=1):\n    if n and n > 2:\n        for i in range(n):\n            run(i)\n    return f"{n}"\nrun2 = run\n')
    got = {d["name"]: d for d in f.declarations}
    assert got["run"]["exported"] and not got["A"]["exported"] and got["__init__"]["kind"] == "constructor" and got["X"]["kind"] == "property"
    assert (got["run"]["mBranches"], got["run"]["mNesting"], got["run"]["mParameters"]) == (4, 2, 1)
    refs = {(r["name"], r["role"]): r for r in f.references}
    assert refs["run", "call"]["targetId"].endswith("run().") and refs["go", "call"]["targetId"].endswith("A#go().") and refs["X", "read"]["status"] == "bound"
    assert refs["other", "call"]["reason"] == "Ambiguous" and refs["Base", "extends"]["targetId"] is None
    assert "doc" not in [x["value"] for x in f.literals] and "-2" in [x["value"] for x in f.literals]
    assert parse_file("m.py", "def f(:").error


CODE = {
    "a.ts": ("import { x as y } from './m';\nexport class K extends B {\n  go(n: number) { return help(n); }\n}\nfunction help(n) { return 'q'; } // t\n", [("K#", "class"), ("K#go().", "method"), ("help().", "function")]),
    "a.rs": ("use std::io;\npub fn add(a: i32) -> i32 { help(a) }\nfn help(a: i32) -> i32 { a + 0x10 }\nstruct S { x: i32 }\n", [("add().", "function"), ("help().", "function"), ("S#", "struct"), ("S#x.", "field")]),
    "a.kt": ("import a.b\nclass K { fun go(x: Int) = help(x) }\nprivate fun help(x: Int) = 3\n", [("K#", "class"), ("K#go().", "method"), ("help().", "function")]),
    "a.cs": ("using System;\nnamespace N { public class C { int Go(int a) { return Help(a); } int Help(int a) { return 1; } } }\n", [("N/", "namespace"), ("N/C#", "class"), ("N/C#Go().", "method"), ("N/C#Help().", "method")]),
    "a.cpp": ("#include <x>\nclass C { int go(int a) { return help(a); } };\nint help(int a) { return 1; }\n", [("C#", "class"), ("C#go().", "method"), ("help().", "function")]),
    "a.c": ("#include \"x.h\"\nint help(int a) { return 017; }\nint go(void) { return help(1); }\n", [("help().", "function"), ("go().", "function")]),
    "a.gd": ("extends Node\nsignal hit\nfunc go(a):\n\thelp(a)\nfunc help(a):\n\tpass\n", [("hit.", "event"), ("go().", "function"), ("help().", "function")]),
}


@pytest.mark.parametrize("module", CODE)
def test_code(module):
    text, want = CODE[module]
    f = parse_file(module, text)
    assert f.error is None and names(f) == want
    assert [r["targetId"] is not None for r in f.references if r["name"].lower() == "help" and r["role"] == "call"] == [True]
    assert len(f.imports) == (0 if module == "a.gd" else 1)
    assert parse_file(module, text + "\n/* open" if module != "a.gd" else "var s = 'open").error


MEMBERS = {
    "a.ts": ("import { x as y } from './m';\nexport class P extends Q {\n  private size = 11;\n  name?: string;\n  area(a: number): number { const z = { q: 1 }; this.size += 2; return y(a); }\n}\nlet v = 1;\nv++;\n", [("P", "class", "public"), ("size", "property", "private"), ("name", "property", "public"), ("area", "method", "public"), ("v", "variable", "fileLocal")], {"size": "write", "v": "write", "y": "call"}),
    "a.rs": ("use crate::m::x;\npub struct P { pub size: Map<u8, u32>, n: u8 }\nimpl P { pub fn area(&self) -> u32 { x(1) } }\n", [("P", "struct", "public"), ("size", "field", "public"), ("n", "field", "private"), ("area", "method", "public")], {"P": "typeUse", "x": "call"}),
    "a.kt": ("package p.q\nimport a.b.c\nclass P { private val size = 1\n fun area(): Int { return size } }\n", [("P", "class", "public"), ("size", "property", "private"), ("area", "method", "public")], {"size": "read"}),
    "a.cs": ("using System;\nclass P { private int size = 1; public List<int> Names { get; set; } public int Area(int a) { int loc = 3; return size; } int Hid() { return 1; } }\n", [("P", "class", "internal"), ("size", "field", "private"), ("Names", "property", "public"), ("Area", "method", "public"), ("Hid", "method", "private")], {"size": "read"}),
    "a.c": ("#include \"m.h\"\nstatic int size = 1;\nstruct S { int a; char *b; };\nstatic int area(int c) { int q = 1; return size; }\n", [("size", "variable", "fileLocal"), ("S", "struct", "public"), ("a", "field", "public"), ("b", "field", "public"), ("area", "function", "fileLocal")], {"size": "read"}),
    "a.cpp": ("class P { int hid; public: int shown = 2; int area(int a) { return shown; } private: std::string s; };\n", [("P", "class", "public"), ("hid", "field", "private"), ("shown", "field", "public"), ("area", "method", "public"), ("s", "field", "private")], {"shown": "read"}),
}


@pytest.mark.parametrize("module", MEMBERS)
def test_members_visibility_and_roles(module):
    text, want, roles = MEMBERS[module]
    f = parse_file(module, text)
    assert f.error is None and [(d["name"], d["kind"], d["visibility"]) for d in f.declarations] == want
    got = {r["name"]: r["role"] for r in f.references}
    assert {n: got.get(n) for n in roles} == roles and not set(got) & {"loc", "q", "b", "c", "z", "System"}


def test_rust_impls():
    f = parse_file("a.rs", "struct S<T> { x: T }\ntrait Go { fn go(&self); }\nimpl<T: Copy> Go for S<T> where T: Eq { fn go(&self) { helper(); } }\nimpl Other { fn f() {} }\nfn helper() {}\n")
    assert [(i, d["containerId"] and d["containerId"].split(" ")[-1]) for (i, _), d in zip(names(f), f.declarations)] == [("S#", None), ("S#x.", "S#"), ("Go#", None), ("Go#go().", "Go#"), ("S#go().", "S#"), ("Other#f().", None), ("helper().", None)]
    assert [(r["name"], r["targetId"].split(" ")[-1], r["fromId"].split(" ")[-1]) for r in f.references if r["role"] == "implements"] == [("Go", "Go#", "S#")]


def test_attachment():
    text = "# lead a\n# lead b\ndef f(): pass  # trail\n\n# far\n\ndef g():\n    # inside\n    return 1\n"
    f = parse_file("m.py", text)
    got = [(c["normalized"], c["form"], c["placement"], (c["anchorId"] or "").split(" ")[-1]) for c in f.comments]
    assert got == [("lead a lead b", "leading", "above", "f()."), ("trail", "trailing", "after", "f()."), ("far", "standalone", "inside", ""), ("inside", "standalone", "inside", "g().")]


def test_utf16_positions():
    f = parse_file("m.py", "s = '😀'; t = 1\n")
    assert [(d["name"], d["nameChar"]) for d in f.declarations] == [("s", 0), ("t", 10)]


def test_tables(spark):
    files = spark.createDataFrame([(m, t) for m, (t, _) in CODE.items()] + [("x.bin", "?"), ("bad.json", "{"), ("n.json", None)], "module string, text string")
    facts = extract(files)
    tables = explode_facts(facts)
    assert facts.count() == len(CODE) + 2 and [r.module for r in tables["parse_failures"].collect()] == ["bad.json"]
    ids = [r.factId for t in ("symbols", "refs", "literals", "imports", "comments") for r in tables[t].select("factId").collect()]
    assert len(ids) == len(set(ids)) and all(i.startswith("fact ") for i in ids)


@pytest.mark.parametrize("module,text", [("a.yaml", "a: 1\n---\nb: x\n"), ("a.ts", "class P { private n = 1; }\nnew P();\n"), ("a.py", "# c\ndef f(a):\n    return f(1)\n"), ("a.gd", "var a = 1\n"), ("a.kt", "class A { val b = 1 }\n"), ("a.cs", "class A { int b = 1; }\n"), ("a.jsonl", '{"a": 1}\n')])
def test_files_of_one_partition_are_dealt_out(spark, module, text):
    files = spark.createDataFrame([(f"{i}/{module}", text) for i in range(64)], "module string, text string").coalesce(1)
    got = extract(files, only=("declarations", "literals")).withColumn("_t", F.spark_partition_id())
    assert got.columns == ["module", "provider", "error", "declarations", "literals", "_t"]
    rows = got.collect()
    assert len(rows) == 64 and len({r["_t"] for r in rows}) >= 4
    want = parse_file(f"7/{module}", text)
    mine = next(r for r in rows if r["module"] == f"7/{module}")
    assert [d.asDict() for d in mine["declarations"]] == want.declarations and [x.asDict() for x in mine["literals"]] == want.literals


def test_spans_of_wide_characters_and_line_ends():
    text = "a😀\r\nb\r😀c\n😀"
    at, f = Coordinates(text), Facts("m.ts", "typescript", text)
    assert [at.line_text(i) for i in range(at.line_count())] == ["a😀", "b", "😀c", "😀"] and at.position(4) is None
    assert f.span(6, 8) == {"startLine": 2, "startChar": 0, "endLine": 2, "endChar": 3} and f.span(0, 2)["endChar"] == 3


def test_plain_yaml_reads_as_by_the_pure_loader(monkeypatch):
    import random

    import yaml

    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b 1", ": ", ":\n  ", "\n", "\n- ", "- ", "---\n", " ", ".5", "yes", "...\n"]) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    read = lambda: [vars(parse_file("a.yaml", t)) | {"at": None} for t in texts]
    fast = read()
    monkeypatch.delattr(yaml, "CSafeLoader", raising=False)
    assert fast == read() and sum(f["error"] is None for f in fast) > 300
    calls = []
    monkeypatch.setattr(yaml, "CSafeLoader", calls.append, raising=False)
    assert parse_file("a.yaml", "a: {b: 1}\n").error is None and parse_file("a.yaml", "a: 'é'\n").error is None and not calls
