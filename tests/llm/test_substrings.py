import hashlib
import random

import pytest

from lodestrata.llm import substrings
from lodestrata.llm.substrings import remove_repeats


def brute(rows, w=20):
    docs = sorted({(i is None, i, t) for i, t in rows}, key=lambda r: (r[0], r[1] or 0))
    seen, out = set(), {}
    for _, i, t in docs:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - w + 1):
            key = tuple(words[s : s + w])
            if key in seen:
                gone[s : s + w] = [True] * w
            seen.add(key)
        kept = [x for x, g in zip(words, gone) if not g]
        out[i, t] = (i, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return sorted((out[i, t] for i, t in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice(["", "é", "xy", ","])
    shared = [" ".join(word() for _ in range(rng.randrange(15, 70))) for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 50))))
        texts.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    texts += texts[:15] + [shared[0], "la " * 100, "la la " * 30, "", None, " \n", "a b c"] + [t.replace(" ", "  ", 1) for t in texts[:5]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i * 2, texts[j]) for i, j in enumerate(order)]
    return rows + [rows[3], rows[3], (None, texts[0]), (None, shared[1])][: 2 + 1]


@pytest.mark.parametrize("seed,size,window,phrase", [(1, 4 << 20, 20, 5), (2, 300, 20, 5), (3, 3000, 20, 7), (4, 2000, 100, 5), (5, 1000, 4, 4)])
def test_against_brute_force(spark, monkeypatch, seed, size, window, phrase):
    for name, n in (("SLICE_BYTES", size), ("PHRASES_PER_BUCKET", 100), ("WORDS_PER_BUCKET", 500), ("HELD", 1 + size // 10)):
        monkeypatch.setattr(substrings, name, n)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, place int, th string, slice int, doc int").repartition(3)
    assert sorted(map(tuple, remove_repeats(df, window, phrase).collect()), key=str) == brute(rows, window)


def test_occurrences_come_from_the_automata(spark, monkeypatch):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(df).collect()} == {1: 0, 2: 30}
    line, gaps = substrings._line(b"a b c d b c d".split())
    assert substrings._Shard([b"b c", b"c d"], 2).hits(line, gaps).tolist() == [1, 2, 4, 5]

    class Blind(substrings._Shard):
        def hits(self, line, gaps):
            return gaps[:0]

    monkeypatch.setattr(substrings, "_Shard", Blind)
    assert {r.doc_id: r.n_removed for r in remove_repeats(df).collect()} == {1: 0, 2: 0}


def test_very_long_text_and_common_passage(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_PLACE", 6)  # the way of texts beyond 2^24 phrases
    monkeypatch.setattr(substrings, "_WORD_BITS", 5)
    rng = random.Random(8)
    shared = " ".join(f"s{rng.randrange(99)}" for _ in range(60))
    long_ = " ".join([*(f"w{rng.randrange(30)}" for _ in range(4000)), shared, *(f"w{rng.randrange(30)}" for _ in range(3000)), "x" * 70000, shared])
    rows = [(i, f"own{i} words{i} {shared} end{i}") for i in range(60)] + [(100, long_), (101, long_ + " y"), (7, "another text of the id " + shared), (None, None), (None, long_)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, remove_repeats(df).collect()), key=str)
    want = brute(rows)
    assert [r for r in got if r[0] != 7] == [r for r in want if r[0] != 7] and sorted(r[1:3] for r in got) == sorted(r[1:3] for r in want)


def test_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "x " * 45), (2, " ".join(map(str, range(30))) + " y")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in remove_repeats(df, texts=True).collect()}
    assert got == {1: "x", 2: " ".join(map(str, range(30))) + " y"}
    assert remove_repeats(df.limit(0)).collect() == []


def test_least_positions():
    import numpy as np

    from lodestrata.llm import substrings as s

    rng = np.random.default_rng(1)
    for span in (1, 2, 5, 16, 19):
        h = rng.integers(0, 6, 300).astype(np.uint64) << np.uint64(50)
        want = np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1) + np.arange(len(h) - span + 1)
        assert (s._least(h, span) == want).all()


def test_word_hashes_in_pieces(monkeypatch):
    import numpy as np

    from lodestrata.llm import substrings as s

    rng = random.Random(4)
    data = b"".join(rng.choice([b" ", b"\n", b"  ", b"\t"]) + bytes(rng.choice(b"abc\xc3\x00") for _ in range(rng.randrange(1, 30))) for _ in range(400)) + b" " + b"x" * 900 + b" y"
    whole = s.word_hashes(data)
    of = dict(zip(data.split(), whole.tolist()))
    assert len(whole) == len(data.split()) and [of[w] for w in data.split()] == whole.tolist() and len(set(of.values())) == len(of)
    monkeypatch.setattr(s, "_PIECE", 64)
    assert (s.word_hashes(data) == whole).all() and len(s.word_hashes(b" \n")) == 0 and len(s.word_hashes(b"")) == 0
