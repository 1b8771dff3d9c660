from pyspark.sql import functions as F
import pytest

from lodestrata import paging
from lodestrata.operators import graph, history, ingest, knowledge, read, refactor
from lodestrata.operators.refactor import Journal


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def brute_scc(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= {y for x in set(reach[n]) for y in reach[x]}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("pairs", [
    ["ab", "bc", "cd"], ["ab", "ba"], ["ab", "bc", "cd", "da"], ["aa", "ab"], ["ab", "ba", "cd", "dc", "bc"], ["ab", "bc", "cd", "db", "de"], ["zy", "yx", "xz", "xa", "ab", "ba", "cz"], [],
])
def test_strong_components(spark, pairs):
    pairs = [tuple(p) for p in pairs]
    got = {r.node: r.component for r in graph.strong_components(edges(spark, pairs)).collect()}
    assert got == brute_scc(pairs)


def test_walks(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    got = {(r.start, r.ancestor): r.depth for r in graph.ancestors(e.toDF("child", "parent")).collect()}
    assert got["a", "d"] == 3 and ("a", "a") not in got and len(got) == 9
    assert {r.node: r.depth for r in graph.reachable(e, spark.createDataFrame([("b",)], "node string")).collect()} == {"b": 0, "c": 1, "a": 2, "d": 2}
    assert {r.node: r.depth for r in graph.recursive_walk(spark, e, "a", 4).collect()} == {"b": 1, "c": 2, "a": 3, "d": 3}
    chain = spark.createDataFrame([("h1", "H1", "heading", None, "m"), ("h2", "H2", "heading", "h1", "m"), ("f", "f", "file", None, "m"), ("h3", "H3", "heading", "f", "m")], "symbolId string, name string, kind string, containerId string, module string")
    assert sorted(map(tuple, graph.container_path(chain, "heading").collect())) == [("h1", "H1", 0), ("h2", "H1", 1), ("h2", "H2", 0), ("h3", "H3", 0)]


def test_paging(spark):
    df = spark.range(60)
    assert paging.probed(df, 50, "id").count == 51 and paging.probed(df, 50, "id").reason == "pageCapped"
    assert (paging.probed(df, 100, "id").kind, paging.probed(df, 100, "id").count) == ("exact", 60)
    assert paging.probed(df, 50, "id", scan=(9, 9)).reason == "pageAndScanCapped" and paging.probed(df, 100, "id", scan=(9, 9)).wire()["scanIncomplete"]
    assert paging.counted(df, 5, "id").wire() == {"total": 60, "truncated": True} and paging.scanned(df, 5, 10, 20, "id").kind == "exact"
    assert paging.scanned(df, 5, 20, 20, "id").reason == "pageAndScanCapped"
    assert [paging.clamp(x) for x in (None, float("nan"), -3, 7.9, 9999)] == [50, 50, 1, 7, 200]


def test_search_and_filters(spark):
    s = spark.createDataFrame([("a", "get_100%", "function", "M/x"), ("b", "GET_1000", "class", "m/y"), ("c", "Größe", "class", "m/z")], "symbolId string, name string, kind string, module string")
    ids = lambda df: sorted(r.symbolId for r in df.collect())
    assert ids(read.search_symbols(s, term="100%")) == ["a"] and ids(read.search_symbols(s, term="get_100")) == ["a", "b"] and ids(read.search_symbols(s, term="GRÖ")) == []
    assert ids(read.search_symbols(s, pattern="/^get/i", kind="class", module="m/")) == ["b"]
    with pytest.raises(ValueError):
        read.search_symbols(s, term="a", pattern="/a/")
    refs = spark.createDataFrame([("n", None), ("n", "t"), ("n", "u"), ("o", None)], "name string, targetId string")
    assert read.spelled_elsewhere(refs, "n", "t").count() == 2
    lits = spark.createDataFrame([("1", 1.0), ("x", None), ("5", 5.0)], "value string, number double")
    assert [r.value for r in read.literals(lits, low=2).collect()] == ["5"] and read.literals(lits, value="x").count() == 1
    with pytest.raises(ValueError):
        read.literals(lits)
    with pytest.raises(ValueError):
        read.find_imports(refs, specifier="a", module="b")


def test_history(spark):
    changes = [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c2", "c"), ("c3", "b")] + [("wide", f"f{i}") for i in range(50)] + [("wide", "a")]
    ch = spark.createDataFrame([(h, p, 2, 1) for h, p in changes], "hash string, path string, added long, deleted long")
    co = {r.module: (r.together, r.outOf) for r in history.co_changed(ch, "a").collect()}
    assert co == {"b": (2, 2), "c": (1, 2)} and history.skipped_wide(ch).first()[0] == 1
    commits = spark.createDataFrame([("c1", 1, "fix run(x)\nmore"), ("c2", 2, "rerun"), ("c3", 3, "run"), ("wide", 9, "x")], "hash string, at long, message string")
    assert [r.hash for r in history.mentioning(commits, "run").collect()] == ["c3", "c1"] and history.mentioning(commits, "ru").count() == 0
    h = {r.path: r for r in history.file_history(ch, commits).collect()}
    assert (h["a"].commits, h["a"].linesAdded, h["a"].firstSeen, h["a"].lastTouched, h["a"].truncated) == (3, 6, 1, 9, True)
    assert h["a"].recent[-1].subject == "fix run(x)" and not h["f1"].truncated


def test_log_parsing(spark):
    from lodestrata.sources.vcs import parse_log

    blocks = [("abc 12\nTitle\n\nbody\n\x01\n\n1\t2\ta b.py\n-\t-\tc.png\n",), ("def 13\n\x01\n",), ("\n",)]
    commits, changes = parse_log(spark.createDataFrame(blocks, "block string"))
    assert sorted(map(tuple, commits.collect())) == [("abc", 12, "Title\n\nbody"), ("def", 13, "")]
    assert sorted(map(tuple, changes.collect())) == [("abc", "a b.py", 1, 2), ("abc", "c.png", 0, 0)]


def test_ingest_rules(spark):
    ev = spark.createDataFrame([("a", 1, "changed", "h1", 1), ("a", 2, "deleted", None, 0), ("b", 3, "changed", "same", 1), ("c", 4, "changed", "x", 2), ("d", 5, "changed", "x", 0), ("e", 6, "changed", "x", 1)], "module string, seq int, kind string, contentHash string, owners int")
    files = spark.createDataFrame([("b", "same")], "module string, contentHash string")
    got = {r.module: (r.action, r.reason) for r in ingest.decide(ingest.coalesce(ev, "seq"), files).collect()}
    assert got == {"a": ("forget", None), "b": ("ignore", "unchanged"), "c": ("ignore", "contested"), "d": ("ignore", "unclaimed"), "e": ("reindex", None)}
    raw = spark.createDataFrame([("a", bytearray(b"x\0y"), 3), ("b", bytearray("é".encode()), 2), ("c", bytearray(b""), 5 << 20)], "m string, content binary, length long")
    assert [(r.state, r.text) for r in ingest.guarded(raw).orderBy("m").collect()] == [("binary", None), ("ok", "é"), ("tooLarge", None)]
    f = spark.createDataFrame([("src/a.py",), ("node_modules/x.js",), ("gen/b.py",), ("src/secret.py",)], "module string")
    known = spark.createDataFrame([("src/a.py",), ("src/secret.py",)], "module string")
    got = {r.module: (r.allowed, r.denied) for r in ingest.in_scope(f, ["gen/**"], ["gen/**"], ["**/secret.py"], known).collect()}
    assert got == {"src/a.py": (True, False), "node_modules/x.js": (False, False), "gen/b.py": (True, False), "src/secret.py": (False, True)}
    assert [r[0] for r in f.select(ingest.is_external("module")).collect()] == [False, True, False, False]
    exts = spark.createDataFrame([("a/.env",), ("a/B.PY",), ("x",)], "module string").select(ingest.extension_of("module")).collect()
    assert [r[0] for r in exts] == ["", ".py", ""]
    imports = spark.createDataFrame([("m", "./a"), ("m", "zzz")], "module string, specifier string")
    cand = F.array(F.concat("specifier", F.lit(".ts")), F.concat("specifier", F.lit("/index.ts")))
    hit = ingest.resolve_candidates(imports, cand, spark.createDataFrame([("./a/index.ts",)], "module string"))
    assert {r.specifier: r.target for r in hit.collect()} == {"./a": "./a/index.ts", "zzz": None}


def test_knowledge(spark):
    a = spark.createDataFrame([("A", ["B"], None), ("B", ["C", "gone"], None), ("C", ["A"], "d"), ("D", ["f"], None)], "factId string, citations array<string>, doubtId string")
    facts = a.select("factId").union(spark.createDataFrame([("f",)], "factId string"))
    got = {r.answerId: (r.stale, r.inheritedStale, r.doubtedUpstream) for r in knowledge.cascade(a, facts).collect()}
    assert got == {"A": (False, True, True), "B": (True, True, True), "C": (False, True, True), "D": (False, False, False)}
    f = lambda i: f"fact doc m {i:016x}"
    ok = lambda c: c != f(9)
    check = lambda prose="p", cites=(f(1),), about=frozenset({f(1)}), **k: knowledge.check_answer("s", "why", prose, list(cites), ok, set(about), **k)
    assert check() is None and "prose" in check(" ") and "4000" in check("x" * 4001) and "at least one" in check(cites=()) and "not a fact id" in check(cites=("x",))
    assert "resolve" in check(cites=(f(9),)) and "about" in check(cites=(f(2),)) and "unknown question" in knowledge.check_answer("s", "nope", "p", [f(1)], ok, {f(1)})
    held = {"citations": [f(1), f(2)], "doubtId": None}
    assert "leaves out" in check(incumbent=held) and check(incumbent=held, omitting="old") is None and check(incumbent=held | {"doubtId": "d"}) is None
    assert "doubt" in check(incumbent=held | {"doubtId": "d"}, doubt="e")
    row = knowledge.answer_row("s", "m", "why", "p", [f(1)], 5, incumbent={"doubtId": "d", "doubtReason": "r", "citations": []})
    assert row["thin"] and row["doubtId"] == "d" and knowledge.answer_row("s", "m", "why", "p", [f(1)], 5, incumbent={"doubtId": "d"}, doubt="d")["doubtId"] is None


def test_refactor(spark):
    files = spark.createDataFrame([("m", "x = 1\n"), ("n", "y\n"), ("o", "abc")], "module string, text string")
    e = spark.createDataFrame([("m", 0, 0, 0, 1, "zz"), ("o", 0, 0, 0, 2, "q"), ("o", 0, 1, 0, 3, "r")], "module string, startLine int, startChar int, endLine int, endChar int, newText string")
    got = {r.module: (r.text, r.problem is None) for r in refactor.apply_to_files(files, e).collect()}
    assert got == {"m": ("zz = 1\n", True), "n": ("y\n", True), "o": (None, False)}
    s = spark.createDataFrame([("sym py m.py A#",), ("sym py m.py A#f().",), ("sym py m.py AB#",)], "symbolId string")
    assert {r.oldKey: r.newKey for r in refactor.id_map(s, "sym py m.py A#", "sym py m.py Z#").collect()} == {"sym py m.py A#": "sym py m.py Z#", "sym py m.py A#f().": "sym py m.py Z#f()."}
    assert graph.subtree(s, "sym py m.py A#").count() == 2
    with pytest.raises(ValueError):
        refactor.source_of("x", (0, 0), (0, 1), "0")


def test_journal():
    j = Journal({"a": b"1", "b": b"2"})
    j.start()
    j.step("rename", {"a": b"9", "c": b"new"})
    j.step("move", {"b": None})
    assert j.files == {"a": b"9", "c": b"new"} and j.undo() == [] and j.files["b"] == b"2"
    j.files["c"] = b"touched"
    assert j.undo() == ["c"] and j.files["a"] == b"9"
    j.issues.append({"kind": "unbound"})
    with pytest.raises(ValueError):
        j.commit()
    j.revert()
    assert j.files == {"a": b"1", "b": b"2"}
    j.start()
    j.steps.append({"stepNo": 1, "kind": "x", "phase": "journaled", "images": {"a": (j._keep(b"1"), j._keep(b"5"))}})
    assert j.recover() == {"a": "before"}
    j.commit(force=True)
    assert j.state == "committed"


def test_rename_plan_and_gap_tree(spark):
    from lodestrata.sources.extract.base import explode_facts, extract

    files = spark.createDataFrame([("m.py", "def f():\n    return h()\ndef h():\n    return 1\nf()\n"), ("n.py", "def z(): pass\n")], "module string, text string")
    facts = explode_facts(extract(files))
    f, h = "sym python m.py f().", "sym python m.py h()."
    plan = refactor.plan_rename(facts["symbols"], facts["refs"], facts["imports"], files, h, "h", "help")
    assert plan["sites"].count() == 2 and plan["collisions"].count() == 0 and plan["unbound"].count() == 0
    assert [(r.text, r.problem) for r in plan["files"].collect()] == [("def f():\n    return help()\ndef help():\n    return 1\nf()\n", None)]
    assert [(r.oldKey, r.newKey) for r in plan["moves"].collect()] == [(h, "sym python m.py help().")]
    assert refactor.plan_rename(facts["symbols"], facts["refs"], facts["imports"], files, h, "h", "f")["collisions"].count() == 1
    answers = spark.createDataFrame([(h,)], "symbolId string")
    assert [(*r[:3], r.total) for r in knowledge.gap_tree(f, facts["refs"], facts["symbols"], answers).collect()] == [(h, 1, True, 2), (f, 0, False, 2)]


def test_history_counts_a_commit_once_and_in_one_task(spark):
    changes = spark.createDataFrame([(h, p, 1, 0) for h in range(40) for p in ("a", "a", f"f{h % 4}")], "hash long, path string, added long, deleted long")
    commits = spark.range(40).selectExpr("id as hash", "timestamp_seconds(id) as at", "'m' as message")
    got = history.file_history(changes, commits)
    rows = {r.path: r for r in got.collect()}
    assert (rows["a"].commits, rows["a"].linesAdded, len(rows["a"].recent), rows["f1"].commits) == (40, 80, 20, 10) and rows["f0"].truncated and not rows["f1"].truncated
    lean = got.select("path", "commits", "truncated")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in lean and "RepartitionByExpression" in lean
