import math
import random
from collections import defaultdict
from fractions import Fraction

from lodestrata.llm import mixing
from lodestrata.llm.mixing import fill_targets, mix, mixed_documents, mixture_report

SCHEMA = "doc_id long, text string, lang string, source string, target double, size int"


def docs(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "b", "b", "b", "a", "é", None])
        rows.append((i, " ".join("w" for _ in range(rng.randrange(60))) or None, "en", source, 1.0, 1))
    rows += [(400 + i, "x y\tz\n" * 2, "en", "tiny", 1.0, 1) for i in range(3)] + [(402, "x y\tz\n" * 2, "en", "tiny", 1.0, 1), (None, "u v", "en", "none", 1.0, 1), (9, None, "en", "empty", 1.0, 1)]
    return rows


def brute_targets(sizes, weights, total, cap=3):
    out, free = [Fraction(0)] * len(sizes), list(range(len(sizes)))
    rest = Fraction(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / w
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
        rest -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def test_targets():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 1000, rng.randrange(10**6)]) for _ in range(rng.randrange(1, 9))]
        weights = [i % 3 + 1 for i in range(len(sizes))]
        got = fill_targets(sizes, weights, sum(sizes))
        assert got == brute_targets(sizes, weights, sum(sizes)) and sum(got) == sum(sizes)


def test_report(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 16)
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = docs()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixture_report(df).collect()
    assert len(got) == len(rows)
    assert sorted(got, key=str) == sorted(mixture_report(df.repartition(7)).collect(), key=str)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([size[s] for s in order], [i % 3 + 1 for i in range(len(order))], sum(size.values()))))
    of = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = of[r.doc_id] if r.doc_id != 9 else None if r.source_size == 0 else of[9]
        if r.source_size:
            assert math.isclose(r.target, want[of[r.doc_id]], rel_tol=1e-12) or r.doc_id == 9
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size, r.target] += r.taken
    for (_, target), n in taken.items():
        assert abs(n - target) <= max(6, 0.02 * target)


def test_fills_and_documents(spark):
    rows = docs(5)
    df = spark.createDataFrame(rows, SCHEMA)
    per, fills = mix(df)
    total = {r.uid: r.taken for r in per.collect()}
    spans = defaultdict(list)
    for f in fills.collect():
        spans[f.uid].append((f.start, f.end))
    for uid, own in spans.items():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][1] == total[uid]
    out = mixed_documents(df)
    assert out.columns == df.columns
    words = lambda rs: sum(len((r.text or "").split()) for r in rs)
    assert words(out.collect()) == sum(total.values())


def test_empty(spark):
    assert mixture_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixture_report(spark.createDataFrame([(1, None, "", None, 0.0, 0)], SCHEMA).select("doc_id", "source", "text")).collect()[0].taken == 0


def test_small_sources(spark, monkeypatch):
    """Sources below a block, a one-document source among them, take their targets to the word."""
    monkeypatch.setattr(mixing, "SLOTS", 64)
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 200))), "en", "hot", 1.0, 1) for i in range(400)]
    sizes = [7, 20, 100, 300, 500, 1000]
    for i in range(24):
        n = sizes[i % 6]
        rows += [(1000 + 10 * i + j, " ".join("v" for _ in range(n // 2 if i % 2 else n)), "en", f"s{i:02}", 1.0, 1) for j in range(1 + i % 2)]
    block = sum(len(r[1].split()) for r in rows) // 64
    assert 300 < block < mixing.BLOCK
    of, target, taken = {r[0]: r[3] for r in rows}, {}, defaultdict(int)
    for r in mixture_report(spark.createDataFrame(rows, SCHEMA)).collect():
        target[of[r.doc_id]] = r.target
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert sum(taken.values()) == sum(len(r[1].split()) for r in rows)


def test_schedule_spreads_sources(spark):
    counts = [500, 0, 1, 300, 3, 196]
    got = sorted((r.slot, r.no, r["rank"]) for r in mixing.schedule(counts, spark.range(1)).collect())
    seen = [0] * len(counts)
    for n, (_, no, rank) in enumerate(got, 1):
        assert rank == seen[no]
        seen[no] += 1
        assert all(abs(s - c * n / 1000) < 4 for s, c in zip(seen, counts))
    assert seen == counts


def plain_taken(rows, h, block, cap=3):
    """The schedule and its blocks in plain Python: words taken, and first slot, of each row; h gives a row's shuffle key."""
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = [len((r[1] or "").split()) for r in rows]
    of = [names.index(r[3]) for r in rows]
    total = [sum(n for n, o in zip(size, of) if o == i) for i in range(len(names))]
    targets = brute_targets(total, [i % 3 + 1 for i in range(len(names))], sum(size))
    words, done, acc = [], 0, Fraction(0)
    for t in targets:
        acc += t
        words.append(math.floor(acc) - done)
        done += words[-1]
    counts = [-(-n // block) for n in words]
    step, span = 1, 1
    while span < sum(counts):
        step, span = span, step + span
    slots = {i: [] for i in range(len(names))}  # slots of each source in order
    edge = [sum(counts[: i + 1]) for i in range(len(counts))]
    for n in range(span):
        point = n * step % span
        if point < sum(counts):
            slots[next(i for i, e in enumerate(edge) if point < e)].append(n)
    taken, first = [0] * len(rows), [None] * len(rows)
    for i in range(len(names)):
        line = sorted((h[r], r) for r in range(len(rows)) if of[r] == i and size[r])
        at = 0
        for _turn in range(cap):
            for _, r in line:
                part = max(0, min(size[r], words[i] - at))
                if part:
                    taken[r] += part
                    got = [slots[i][b] for b in range(at // block, (at + part - 1) // block + 1)]
                    first[r] = min(got if first[r] is None else [*got, first[r]])
                at += size[r]
    return taken, first


def test_taken_against_a_plain_schedule(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lodestrata.llm.shared import row_hash

    monkeypatch.setattr(mixing, "SLOTS", 100)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 16)
    rows = [r for r in docs(7) if r[0] not in (402, 9, None)]
    rows.append((9000, "w " * 3000, "en", "a", 1.0, 1))
    for own in (rows, [(*r[:3], "one", *r[4:]) for r in rows]):
        df = spark.createDataFrame(own, SCHEMA)
        h = {r.doc_id: r.h % (1 << 64) for r in df.select("doc_id", F.xxhash64("doc_id", row_hash(df), F.lit(1)).alias("h")).collect()}
        block = max(1, min(mixing.BLOCK, sum(len((r[1] or "").split()) for r in own) // 100))
        taken, first = plain_taken(own, [h[r[0]] for r in own], block)
        got = {r.doc_id: (r.taken, r.first_slot) for r in mixture_report(df).collect()}
        assert block > 1
        assert got == {r[0]: (t, f) for r, t, f in zip(own, taken, first)}


def test_rows_of_one_id_and_text_in_two_sources(spark):
    rows = [(1, "a b c", "s1"), (1, "a b c", "s2"), (2, "d e f", "s1"), (None, "a b c", "s2"), (None, "a b c", "s2")]
    df = spark.createDataFrame([(*r, i % 2, 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, source string, _size int, _taken int, _turn int")
    got = mixed_documents(df)
    assert got.columns == df.columns
    out = got.collect()
    assert {r.source for r in out} == {"s1", "s2"} and sum(len(r.text.split()) for r in out) == 15
    assert sorted((r.source, r.text) for r in out) == sorted((r.source, r.text) for r in mixed_documents(df.repartition(3)).collect())
