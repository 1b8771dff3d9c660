import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from lodestrata.llm.bpe import Bpe, encode_table, load, round_trip

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return load(FILE, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(both, text):
    ours, theirs = both
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert ours.decode(ours.encode(text)) == text.encode()


def test_hard_pieces(both):
    ours, theirs = both
    rng = random.Random(1)
    texts = ["a" * 5000, "ab" * 3000, " " * 777, "<|endoftext|> x", "\n\n \t\r\n", "né" * 900, "1" * 400, "日本語" * 50, "🙂" * 99]
    texts += ["".join(rng.choice("abcdehilnorst") for _ in range(400)) for _ in range(60)]
    texts += ["".join(rng.choice("!?.-=*#_") for _ in range(300)) for _ in range(30)]
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t)


def test_backtracking_on_random_tables():
    rng = random.Random(2)
    for _ in range(60):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(ranks) < 14:
            a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
            ranks.setdefault(a + b, len(ranks))
        bpe = Bpe(ranks, ".+")
        for _ in range(40):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25)))
            assert bpe.encode_piece(data) == ([ranks[data]] if data in ranks else bpe._merged(data))


def test_table(spark):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (None, None, "y"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, round_trip(docs, FILE, P.PATTERN).collect()), key=str)
    ids = load(FILE, P.PATTERN).encode("Hello  world")
    sha = lambda s: hashlib.sha256(s).hexdigest()
    one = (1, len(ids), sha(" ".join(map(str, ids)).encode()), sha(b"Hello  world"))
    assert got == sorted([one, one, (None, 0, sha(b""), sha(b"")), (4, 0, sha(b""), sha(b""))], key=str)
    assert [r.ids for r in encode_table(docs, FILE, P.PATTERN).collect()] == [ids, ids, [], []]
    assert round_trip(docs.limit(0), FILE, P.PATTERN).collect() == []


def test_neighbours_by_the_merge_rule(both):
    ours, _ = both
    rng = random.Random(7)
    tokens = list(ours.bytes_of)
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert ours._fit(a, b) == (ours._merged(ours.bytes_of[a] + ours.bytes_of[b]) == [a, b])
    ranks = {bytes([c]): i for i, c in enumerate(b"ab")}
    while len(ranks) < 12:
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        ranks.setdefault(a + b, len(ranks))
    bpe = Bpe(ranks, ".+")
    for a in bpe.bytes_of:
        for b in bpe.bytes_of:
            assert bpe._fit(a, b) == (bpe._merged(bpe.bytes_of[a] + bpe.bytes_of[b]) == [a, b])
