import base64
import os
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from lodestrata.llm.mixing import fill_targets
from lodestrata.llm.pii import base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, by name; the input under ``documents``."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, "en", "src0", None), (9002, "", None, None, 0), (9003, "a b c d e f", "en", "src1", 11), (9003, "a b c d e f", "en", "src1", 11), (None, "idiot " * 9 + "x", "en", "src2", 3)],
        docs.schema,
    )
    docs = docs.union(odd)
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(str(at / name))
        if name != "byte_bpe":
            assert made.columns == docs.columns
        docs = spark.read.parquet(str(at / name))
        out[name] = docs.collect()
    return out


def shingles(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_toxicity(spark, stages):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    kept = {r.doc_id for r in stages["toxicity"]}
    assert not kept & toxic and clean <= kept and {9001, 9002, 9003} <= kept


def test_near_dedup(stages):
    before, kept = stages["toxicity"], stages["simhash_near_dedup"]
    assert set(kept) <= set(before) and len(kept) == len(set(kept))
    sets = [(r.doc_id, shingles(r.text)) for r in kept]
    jac = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    assert not [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if jac(a, b) >= 0.8]
    gone = [r for r in set(before) if r not in set(kept)]
    every = [shingles(r.text) for r in before]
    assert all(any(jac(shingles(r.text), s) >= 0.8 for s, o in zip(every, before) if o != r) for r in gone)


def test_pii(stages):
    before = {(r.doc_id, r.source): r for r in stages["simhash_near_dedup"]}
    assert len(stages["pii"]) == len(before)
    for r in stages["pii"]:
        old = before[r.doc_id, r.source]
        assert not base_spans(r.text or "") and (r.text is None or r.n_chars == len(r.text))
        if not base_spans(old.text or ""):
            assert r.text == old.text


def test_mixing(stages):
    before, after = stages["pii"], stages["mixing"]
    words = lambda t: len((t or "").encode().split())
    size, got = defaultdict(int), defaultdict(int)
    for r in before:
        size[r.source] += words(r.text)
    for r in after:
        got[r.source] += words(r.text)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = fill_targets([size[s] for s in order], [i % 3 + 1 for i in range(len(order))], sum(size.values()))
    for s, t in zip(order, targets):
        assert abs(got[s] - t) <= max(10, 0.02 * t)


def test_encoding(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    key = lambda i, ids: (str(i), tuple(ids))
    assert sorted(key(r.doc_id, enc.encode_ordinary(r.text)) for r in stages["mixing"]) == sorted(key(r.doc_id, r.ids) for r in stages["byte_bpe"])
    assert all(r.n_tokens == len(r.ids) for r in stages["byte_bpe"])


def test_run_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
    assert corpus_pipeline.run(spark, SF).count() > 0


NAMES = ["_severity", "_grade", "_h", "_id", "_th", "_turn", "_size", "_taken", "_slot", "_at", "_of", "_row", "_no", "_text", "_a", "_b", "key", "kept", "uid", "source_size"]


def test_clashing_columns_and_long_texts(spark):
    """Columns named like the stages' own come out as they went in; a very long text goes through whole."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    words = [f"w{i % 977}x{i % 13}" for i in range(70_000)]
    rows = [(i, " ".join(f"t{i}n{j}" for j in range(30 + i)), "en", f"src{i % 2}", 1) for i in range(12)] + [(50, " ".join(words), "en", "src0", 1)]
    rows = [(*r, *(f"{n}{r[0]}" for n in NAMES)) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *NAMES]
        got = docs.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in NAMES)
        docs = spark.createDataFrame(got, docs.schema)
    assert sum(r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) > 70_000


def test_near_copies_without_ids(spark):
    base = [f"w{i}" for i in range(300)]
    a, b, c = " ".join(base), " ".join([*base[:-1], "y"]), " ".join([*base[:-1], "z"])
    near = corpus_pipeline.STAGES[1][1]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for ids, left in (((1, 2, 3), [1]), ((1, None, None), [1]), ((None, None, 5), [5]), ((None, None, None), [None])):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, (a, b, c))] + [(9, "one two", "en", "s", 1)], schema)
        assert sorted([r.doc_id for r in near(spark, docs, SF).collect()], key=str) == sorted([9, *left], key=str)
    same = spark.createDataFrame([(1, a, "en", "s1", 1), (1, a, "en", "s2", 1), (1, a, "en", "s2", 1)], schema)
    assert len({near(spark, d, SF).collect()[0] for d in (same, same.repartition(3), same.orderBy("source"))}) == 1
