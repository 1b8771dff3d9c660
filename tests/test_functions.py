import re

import pytest
from hypothesis import given, settings, strategies as st

from lodestrata.functions.coordinates import Coordinates, Edit, apply_edits, plan_edits
from lodestrata.functions.ids import Descriptor, SymbolId, compose_symbol, decode_module, digest, digest_column, encode_module, fact_id
from lodestrata.functions.ids import is_within, normalize_module, number_occurrences, owner_of, parse_fact, parse_symbol, rebase
from lodestrata.functions.numbers import decode_number, decode_string
from lodestrata.functions.search import check_term, compile_pattern, glob_pattern, word_pattern
from lodestrata.functions.text import normalize_comment, normalize_doc, preview

NAMES = st.text(alphabet="aZ_é`.#/ ()[]:", min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["namespace", "type", "term", "meta", "method", "parameter", "typeParameter"]), NAMES), min_size=1, max_size=4))
def test_symbol_round_trip(parts):
    s = SymbolId("py", "a b%/c.py", tuple(Descriptor(k, n) for k, n in parts))
    assert parse_symbol(compose_symbol(s)) == s


def test_symbol_structure():
    s = "sym py m.py A#f[2](x1)."
    assert parse_symbol(s).descriptors[1] == Descriptor("method", "f", "x1", 2) and owner_of(s) == "sym py m.py A#"
    assert is_within(s, "sym py m.py A#") and not is_within("sym py m.py AB#", "sym py m.py A#") and is_within(s, s)
    assert rebase(s, "sym py m.py A#", "sym py n.py B#") == "sym py n.py B#f[2](x1)." and rebase(s, "sym py m.py C#", "sym py n.py B#") is None
    for bad in ("sym py m.py ", "sym py m.py A", "sym py ../m.py A#", "other py m.py A#", "sym py m.py A[1]#"):
        assert parse_symbol(bad) is None
    assert parse_symbol("sym py m.py local3") == SymbolId("py", "m.py", (), 3)


def test_modules():
    assert normalize_module("a\\b/./c//d") == "a/b/c/d" and decode_module(encode_module("a %20b")) == "a %20b"
    for bad in ("/a", "C:/a", "a/../b", "", ".", "a\x00b"):
        with pytest.raises(ValueError):
            normalize_module(bad)


def test_digests(spark):
    assert digest("doc", "m", None, 1.0, True) == digest("doc", "m", None, 1, "true") != digest("doc", "m", "", 1, True)
    f = fact_id("doc", "a b.md", "x")
    assert parse_fact(f)[:2] == ("doc", "a b.md") and parse_fact("fact nope m 0123456789abcdef") is None
    df = spark.createDataFrame([("m é", 3, None), ("", 0, "x")], "a string, n int, b string")
    from pyspark.sql import functions as F

    got = df.select(digest_column(F.lit("doc"), "a", "n", "b")).collect()
    assert [r[0] for r in got] == [digest("doc", "m é", 3, None), digest("doc", "", 0, "x")]


def test_occurrences():
    row = lambda i, a, z: {"symbolId": f"sym py m.py {i}", "start": (a, 0), "end": (z, 0)}
    got = number_occurrences([row("A#", 0, 5), row("A#f().", 1, 2), row("A#", 6, 9), row("A#f().", 7, 8), row("A#f().", 8, 9)])
    assert [got[i] for i in range(5)] == [f"sym py m.py {x}" for x in ("A#", "A#f().", "A[2]#", "A[2]#f().", "A[2]#f[2]().")]


def test_patterns():
    assert compile_pattern("/a/") == "a" and compile_pattern("/a\\/b/gi") == "(?i)a/b" and compile_pattern("/[(?=]+/") == "[(?=]+"
    for bad in ("a", "/(?=a)/", "/(?<!a)b/", "/(a)\\1/", "/a*+/", "/a{2}+/", "/a/x", "/" + "a" * 2001 + "/", "/(?>a)/"):
        with pytest.raises(ValueError):
            compile_pattern(bad)
    with pytest.raises(ValueError):
        check_term("a\0")
    assert re.search(word_pattern("f.g").replace(r"\Q", "").replace(r"\E", "").replace(".", r"\."), "x f.g y")


@pytest.mark.parametrize(
    "glob,yes,no",
    [("dist/**", ["dist", "dist/a/b"], ["adist", "distx"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab", "a/xb"]), ("*.ts", ["a.ts"], ["d/a.ts", "ats"]), ("**/x.py", ["x.py", "a/b/x.py"], ["ax.py"]), ("a+b?", ["a+b?"], ["aab"])],
)
def test_globs(glob, yes, no):
    assert all(re.search(glob_pattern(glob), m) for m in yes) and not any(re.search(glob_pattern(glob), m) for m in no)


@pytest.mark.parametrize(
    "raw,want",
    [("// a\n//   b", "a b"), ("/** One\n * two\n * ----\n */", "One two"), ("<!-- x\n y -->", "x y"), ("# ---\n# text", "text"), ("//// note", "note"), ("-- sql", "-- sql"), ("#! shebang", "! shebang"), ("/*!*/", "")],
)
def test_comments(raw, want):
    assert normalize_comment(raw) == want


def test_prose_columns(spark):
    df = spark.createDataFrame([(" a\u00a0\ufeff b\n\tc ",), ("\n".join(map(str, range(11))),)], "t string")
    got = df.select(normalize_doc("t").alias("n"), preview("t").alias("p")).collect()
    assert got[0].n == "a b c" and got[1].p.endswith("7\n… 3 more lines")


def test_coordinates_and_edits():
    at = Coordinates("a😀b\r\nc")
    assert at.offset((0, 2)) is None and at.offset((0, 3)) == 3 and at.offset((0, 5)) is None and at.offset((1, 1)) == 7 and at.position(5) is None
    assert at.cut((0, 0), (0, 3)) == "a😀" and at.line_text(0) == "a😀b"
    e = lambda a, b, t: Edit((0, a), (0, b), t)
    assert apply_edits("abcdef", [e(1, 2, "X"), e(4, 4, "_"), e(1, 2, "X")]) == ("aXcd_ef", None)
    assert apply_edits("abc", [e(0, 2, "x"), e(1, 3, "y")])[1].endswith("overlapping") and apply_edits("abc", [e(0, 9, "x")])[1].endswith("unaddressable")
    assert apply_edits("abc", [e(1, 1, "x"), e(1, 1, "y")])[0] is None and plan_edits(Coordinates("abc"), [e(1, 1, "x"), e(1, 1, "y")]).joined == [1]
    assert apply_edits("abc", [e(0, 1, "x"), e(0, 1, "y")])[1].endswith("duplicate")


def test_numbers_and_strings():
    cases = [("0xFFu8", "rust", 255), ("1_000i64", "rust", 1000), ("2.5f32", "rust", 2.5), ("017", "c", 15), ("08", "c", None), ("1'000'000", "cpp", 10**6), ("10UL", "c", 10), ("3j", "python", None), ("9007199254740993", "python", None), ("0b101", "kotlin", 5), ("1e3", "typescript", 1000), ("12n", "typescript", 12), ("-5", "gdscript", -5)]
    for text, language, want in cases:
        assert decode_number(text, language) == want, (text, language)
    assert decode_string(r"a\n\x41\u{1F600}\q\\") == "a\nA😀q\\"
