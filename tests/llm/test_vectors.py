import math
import random

import numpy as np
import pytest

from lodestrata.llm import mtree
from lodestrata.llm.mtree import MTree, top_k
from lodestrata.llm.spherical import embedding_groups

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, e int"


def sample(n=300, dim=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.12) for x in c]
        rows.append((i, v, rng.choice([0, 1, 2]), "s", 1))
    for i in range(n, n + 40):
        rows.append((i, rows[i % 7][1], rows[i % 7][2], "s", 1))
    odd = [None, [], [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [math.nan] * dim, [math.inf] * dim, [1.0, 2.0]]
    rows += [(1000 + 20 * i, v, 1, "s", 1) for i, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None, "s", 1)]
    return rows


def brute_top(rows, k=20):
    use = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, x) in enumerate(use):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for m, (c, y) in enumerate(use) if m != n)[:k]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(want)


def test_top_k(spark, monkeypatch):
    rows = sample() + [(None, [1.0] * 8, 1, "s", 1)]
    assert sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA)).collect())) == brute_top(rows)
    for name, n in (("SHARD_ROWS", 40), ("TREE_ROWS", 60), ("LEAF", 8), ("PAGE", 4), ("QUERY_BLOCK", 5), ("TREES_PER_FILE", 2)):
        monkeypatch.setattr(mtree, name, n)
    rng = random.Random(9)
    even = [(i % 260, [rng.gauss(0, 1) for _ in range(24)], 1, "s", 1) for i in range(400)]  # nothing can be left out, ids repeat
    for own in (rows, even):
        assert sorted(map(tuple, top_k(spark.createDataFrame(own, SCHEMA).repartition(3)).collect())) == brute_top(own)


def test_rows_of_one_id_are_separate(spark):
    rows = [(0, [1.0, 0.0], 1, "", 1), (1, [1.0, 0.0], 1, "", 1), (1, [2.0, 0.0], 1, "", 1), (2, [1.25, 0.0], 1, "", 1), (20, [1.0], 1, "", 1), (20, [-1.0], 1, "", 1)]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute_top(rows) and (0, 1, 1, 8192) in got and (20, 5, 20, -4096) in got


def test_large_components(spark):
    rows = [(i, [float(np.float32(x * 1.1e7 + i)), float(np.float32(0.7e7 * (i % 3)))], 1, "", 1) for i, x in enumerate([1, -1, 1.5, 0.25] * 6)]
    assert sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA)).collect())) == brute_top(rows)
    with pytest.raises(ValueError):
        top_k(spark.createDataFrame([(0, [1e18], 1, "", 1)], SCHEMA))


def test_tree_prunes_and_handles_copies():
    rng = np.random.default_rng(3)
    v = (np.repeat(rng.normal(0, 40, (40, 12)), 60, axis=0) + rng.normal(0, 2, (2400, 12))).astype(np.int64)
    v[:300] = v[0]
    for prunes, v in ((True, v), (True, np.repeat(v[:1], 700, axis=0)), (False, rng.normal(0, 40, (2400, 64)).astype(np.int64))):
        tree = MTree(np.arange(len(v)), v, float(np.sqrt((v.astype(float) ** 2).sum(axis=1).max())) * (1 + 1e-12))
        q = np.arange(0, len(v), 20)
        found = mtree.Found.none(len(q), 20)
        tree.search(v[q], q, found)
        want = [sorted((-int(v[i] @ v[c]), c) for c in range(len(v)) if c != i)[:20] for i in q]
        assert [[(-s, c) for s, c in zip(a, b)] for a, b in zip(found.scores.tolist(), found.ids.tolist())] == want
        assert tree.avoided > 0 or not prunes or len(np.unique(v, axis=0)) == 1


def test_few_rows(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert top_k(spark.createDataFrame([(0, [1.0], 1, "", 1)], SCHEMA)).collect() == []
    assert top_k(spark.createDataFrame([(0, [], 1, "", 1), (20, None, 1, "", 1), (3, [], 1, "", 1)], SCHEMA)).collect() == [(0, 1, 3, 0)]


def brute_groups(rows, t=0.98):
    f = lambda v: [float(np.float32(x)) for x in v]
    ok = lambda v, l: l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            (_, a, la, *_), (_, b, lb, *_) = rows[i], rows[j]
            if la == lb and ok(a, la) and ok(b, lb) and len(a) == len(b):
                x, y = f(a), f(b)
                if sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x)) / math.sqrt(sum(q * q for q in y)) >= t:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


def test_groups(spark, monkeypatch):
    import lodestrata.llm.spherical as s

    rows = sample()
    want = brute_groups(rows)
    assert sorted(map(tuple, embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect())) == want
    monkeypatch.setattr(s, "BLOCK", 24)
    monkeypatch.setattr(s, "POINTS_PER_CELL", 40)
    assert sorted(map(tuple, embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect())) == want
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).collect() == []
