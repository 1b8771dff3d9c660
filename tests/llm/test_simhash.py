import random
from collections import defaultdict

import xxhash

from lodestrata.llm.components import connected_components
from lodestrata.llm.simhash import near_links, simhash_groups


def brute_fp(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for x in nodes:
        out[find(x)].add(x)
    return {frozenset(v) for v in out.values()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["ab", "Cd", "ef", "É", "x,"]) + str(rng.randrange(30)) for _ in range(60)) for _ in range(25)]
    texts = base + [b.rsplit(" ", 1)[0] + " zz" for b in base] + [b.upper() for b in base[:5]] + ["", None, " \t\n", "one", "one two", "ONE  two"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fp(t) for i, t in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{v:016x}" for i, v in fp.items()}
    want = classes([(a, b) for a in fp for b in fp if (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    assert {r.doc_id: r.component_id for r in got} == {x: min(c) for c in want for x in c}


def test_dense_neighbourhoods_and_blocks(spark, monkeypatch):
    import lodestrata.llm.simhash as s

    monkeypatch.setattr(s, "BLOCK", 16)
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(30):
            x = c
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = near_links(spark.createDataFrame(signed, "fp long")).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 2 for r in links)
    want = classes([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2], fps)
    assert classes([(r.a & mask, r.b & mask) for r in links], fps) == want


def test_components_of_chains_and_empty(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)]
    got = {r.node: r.rep for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[200] == got[201] and 100 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table_and_extra_columns(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string, fp long")).collect() == []
    got = simhash_groups(spark.createDataFrame([(1, "a b c d", "x", 2)], "doc_id long, text string, fingerprint string, rep long")).collect()
    assert got[0].component_id == 1


def shingles(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates(spark, monkeypatch):
    import lodestrata.llm.simhash as s

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(3, 200))]
        texts.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for _ in range(max(1, len(t) // 80)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [passage + " " + " ".join(word() for _ in range(150)) for _ in range(40)] + ["", None, " \n", "one two", "ONE two", texts[0].upper()]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    sets = [shingles(t) for t in texts]
    jac = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    sure = [(i, j) for i in range(len(texts)) for j in range(i) if jac(sets[i], sets[j]) >= 0.8]
    want = classes(sure, range(len(texts)))
    for block in (s.BLOCK, 16):
        monkeypatch.setattr(s, "BLOCK", block)
        got = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
        assert len(got) == len(rows)
        own = {r.doc_id: r.component_id for r in got}
        assert all(own[x] >= min(next(c for c in want if x in c)) for x in own)  # nothing is linked below 0.8
        assert sum(own[i] == own[j] for i, j in sure) >= 0.99 * len(sure)
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_near_duplicates(spark):
    """Edits at the ends of texts of 9 to 20 words, and of some just below and above the size of short ones."""
    import lodestrata.llm.simhash as s

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for n in [*range(9, 21)] * 12 + [66, 68] * 6:
        base = [word() for _ in range(n)]
        more = max(1, (n - 4) // 4)
        texts += [" ".join(base), " ".join([*base, word()]), " ".join([*base[:-1], word()]), " ".join([word(), *base]), " ".join(base + [word() for _ in range(more)])]
    sets = [shingles(t) for t in texts]
    jac = lambda a, b: len(a & b) / len(a | b)
    sure = [(i, j) for i in range(len(texts)) for j in range(i) if jac(sets[i], sets[j]) >= 0.8]
    assert len(sure) > 300
    want = {x: min(c) for c in classes(sure, range(len(texts))) for x in c}
    got = s.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_recurring_lines_do_not_part_near_copies(spark):
    import lodestrata.llm.simhash as s

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(12):
        body, line = " ".join(word() for _ in range(200)), " ".join(word() for _ in range(3))
        texts += [body + f" {line}" * 3, body + f" {line}" * 200]
    got = s.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(len(texts))}


def test_near_copies_of_texts_without_id(spark):
    import lodestrata.llm.simhash as s

    rng = random.Random(13)
    rows = []
    for i in range(12):
        base = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150))
        rows += [(None, base), (i, base + " end")]
    got = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in got) == sorted([*range(12)] * 2)
