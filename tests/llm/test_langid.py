import random
import zlib

import numpy as np

from lodestrata.llm.langid import EMBED, FILTERS, WIDTHS, _gradients, as_bytes, fit, predict_languages, train, windows


def text(lang, rng):
    parts = {"aa": ["tion", "ing", "the", "shre"], "bb": ["éau", "que", "ment", "çon"], "cc": ["ung", "sch", "keit", "ü"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 80)))


def test_tables_equal_the_network():
    rng = random.Random(1)
    m = fit([(lang, windows(as_bytes(text(lang, rng)))[0].tobytes()) for lang in ("aa", "bb") for _ in range(20)])
    x = windows(as_bytes(text("bb", rng) * 5))
    emb = m.embed[x]
    pooled = []
    for w in WIDTHS:
        f, b = m.filters[w]
        r = sum(emb[:, i : x.shape[1] - w + 1 + i] @ f[i * emb.shape[2] : (i + 1) * emb.shape[2]] for i in range(w))
        pooled.append(np.maximum(r.max(axis=1) + b, 0))
    z = np.concatenate(pooled, axis=1) @ m.out[0] + m.out[1]
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(m.probabilities(x), want, atol=1e-4) and pooled[0].shape[1] == FILTERS


def test_held_out_accuracy_and_cases(spark):
    rng = random.Random(2)
    rows = [(i, text(lang, rng), lang, "s") for i in range(400) for lang in [rng.choice(["aa", "bb", "cc"])]]
    odd = [(900, None, "aa", "s"), (901, "12 !?", "bb", "s"), (902, "", None, "s"), (None, rows[0][1], "aa", "s"), (903, "çon que " * 3000, None, "s"), rows[0]]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, held_out string")
    got = predict_languages(df, train(df)).collect()
    assert len(got) == len(rows) + len(odd)
    lang = {i: la for i, _, la, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902)) and by[903].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    empty = df.limit(0)
    assert predict_languages(empty, train(empty)).collect() == []
    assert {r.lang_pred for r in predict_languages(df, train(empty)).collect()} == {"und"}


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(3)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "v": rng.normal(0, 0.5, (FILTERS * len(WIDTHS), 3)), "c": rng.normal(0, 0.1, 3)}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, 0.5, (w * EMBED, FILTERS)), rng.normal(0, 0.1, FILTERS)
    x, y = np.stack([windows(as_bytes(text(lang, random.Random(i))))[0] for i, lang in enumerate(["aa", "bb", "cc", "aa"])]), np.array([0, 1, 2, 0])

    def loss():
        pooled = []
        for w in WIDTHS:
            emb = p["e"][x]
            r = sum(emb[:, i : x.shape[1] - w + 1 + i] @ p[f"f{w}"][i * EMBED : (i + 1) * EMBED] for i in range(w))
            pooled.append(np.maximum(r.max(axis=1) + p[f"b{w}"], 0))
        z = np.concatenate(pooled, axis=1) @ p["v"] + p["c"]
        return -(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(4), y].mean()

    for name, grad in _gradients(p, x, y).items():
        flat, want = p[name].reshape(-1), grad.reshape(-1)
        for i in [int(j) for j in np.argsort(-np.abs(want))[:6]] + rng.integers(0, len(flat), 6).tolist():
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - want[i]) < 1e-5, name


def test_ties_take_the_first_language(spark):
    rows = [(i, "ababab abab", lang) for i in range(80) for lang in ["bb", "aa"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = predict_languages(df, train(df)).collect()
    assert len({(r.lang_pred, round(r.score, 9)) for r in got}) == 1
