"""Language identification with a byte convolutional network, trained in numpy.

A text is lower-cased, its ASCII non-letters become single spaces, and its UTF-8 bytes are cut into windows of ``WINDOW``
bytes that cover it wholly.  A window goes through a byte embedding, filters of widths 2, 3 and 4, max pooling over the
window and a softmax; a text's probabilities are the mean over its windows.

For prediction the embedding and the filters are folded into tables over byte pairs (the network is linear up to the
pooling), so a filter costs one or two table rows a byte.  Training uses a bounded sample (``TEXTS_PER_LANG`` labelled
texts a language, ``WINDOWS_PER_TEXT`` windows of each); prediction reads every text whole.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.shared import pieces

WINDOW = 128
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 16
TEXTS_PER_LANG, WINDOWS_PER_TEXT, MAX_LANGS = 1500, 3, 400
EPOCHS, BATCH, RATE = 5, 64, 4e-3
UNKNOWN = "und"
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}").search
_CHUNK = 512


def as_bytes(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_TABLE).split())


def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes that cover ``data``, the last padded with spaces; at least one."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray
    filters: dict[int, tuple[np.ndarray, np.ndarray]]
    out: tuple[np.ndarray, np.ndarray]
    _pairs: dict | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def tables(self) -> dict:
        """Filter responses by byte pair: width -> (table of the first pair, of the rest)."""
        if self._pairs is None:
            at = {}
            for w, (f, _) in self.filters.items():
                one = [(self.embed @ f[i * EMBED : (i + 1) * EMBED]).astype(np.float32) for i in range(w)]
                pair = lambda i: (one[i][:, None] + one[i + 1][None]).reshape(1 << 16, FILTERS)  # noqa: E731, B023
                at[w] = (pair(0), None if w == 2 else one[2] if w == 3 else pair(2))
            self._pairs = at
        return self._pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) bytes -> (windows, languages)."""
        tables, probs = self.tables(), np.empty((len(x), len(self.langs)))
        for i in range(0, len(x), _CHUNK):
            c = x[i : i + _CHUNK]
            two = c[:, :-1].astype(np.int32) * 256 + c[:, 1:]
            pooled = []
            for w, (first, rest) in tables.items():
                r = first[two[:, : WINDOW - w + 1]]
                if w == 3:
                    r += rest[c[:, 2:]]
                elif w == 4:
                    r += rest[two[:, 2:]]
                pooled.append(np.maximum(r.max(axis=1) + self.filters[w][1], 0))
            z = np.concatenate(pooled, axis=1) @ self.out[0] + self.out[1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            probs[i : i + _CHUNK] = z / z.sum(axis=1, keepdims=True)
        return probs

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 without a letter or without a trained language."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.langs and _LETTER(t)]
        at = 0
        while at < len(known):  # several texts at a time, about 4 MB of windows
            some, size, own = [], 0, []
            while at < len(known) and size < 1 << 15:
                some.append(windows(as_bytes(texts[known[at]])))
                own.append(known[at])
                size += len(some[-1])
                at += 1
            n = np.array([len(s) for s in some])
            p = np.add.reduceat(self.probabilities(np.concatenate(some)), np.concatenate(([0], n.cumsum()[:-1])), axis=0) / n[:, None]
            for i, best, score in zip(own, p.argmax(axis=1), p.max(axis=1)):
                langs[i], scores[i] = self.langs[best], min(1.0, score)
        return langs, scores


def fit(samples: list[tuple[str, bytes]], seed: int = 5) -> ByteCnn:
    """(language, window) rows -> network, by Adam on the cross entropy."""
    langs = sorted({s[0] for s in samples})
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.3, (256, EMBED))}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)), np.zeros(FILTERS)
    p["v"], p["c"] = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))), np.zeros(len(langs))
    if samples:
        x = np.stack([np.frombuffer(s[1], np.uint8) for s in samples])
        y = np.array([langs.index(s[0]) for s in samples])
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(order), BATCH):
                t += 1
                for k, g in _gradients(p, x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    filters = {w: (p[f"f{w}"], p[f"b{w}"].astype(np.float32)) for w in WIDTHS}
    return ByteCnn(langs, p["e"], filters, (p["v"].astype(np.float32), p["c"].astype(np.float32)))


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> dict:
    n, rows = len(x), np.arange(len(x))
    emb = p["e"][x]
    acts, picks = [], []
    for w in WIDTHS:
        patches = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
        r = patches @ p[f"f{w}"]
        at = r.argmax(axis=1)
        picks.append((patches[rows[:, None], at], at))
        acts.append(np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0] + p[f"b{w}"], 0))
    h = np.concatenate(acts, axis=1)
    z = h @ p["v"] + p["c"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    dz = z / z.sum(axis=1, keepdims=True)
    dz[rows, y] -= 1
    dz /= n
    out = {"v": h.T @ dz, "c": dz.sum(axis=0), "e": np.zeros_like(p["e"])}
    dh = (dz @ p["v"].T) * (h > 0)
    for j, w in enumerate(WIDTHS):
        g = dh[:, j * FILTERS : (j + 1) * FILTERS]
        patch, at = picks[j]
        out[f"f{w}"] = np.einsum("nfk,nf->kf", patch, g)
        out[f"b{w}"] = g.sum(axis=0)
        back = g[:, :, None] * p[f"f{w}"].T  # (n, filters, w * EMBED)
        for i in range(w):
            np.add.at(out["e"], x[rows[:, None], at + i], back[:, :, i * EMBED : (i + 1) * EMBED])
    return out


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCnn:
    """Fit on texts with a language whose crc32(id as text) mod 5 is not 0; rows without an id don't count."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang is not null and doc_id is not null").filter(~held_out())
    counts = rows.filter("text is not null").groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    cuts = spark.createDataFrame([(r.lang, min(1.0, 1.3 * TEXTS_PER_LANG / r["count"])) for r in counts], "lang string, share double")
    # a hash of the id thins the rows where they are read; then the exact bound a language
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    thin = rows.join(F.broadcast(cuts), "lang").withColumn("key", key).filter("key < share")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            langs, keys, some = [], [], []
            for lang, key, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not text or not _LETTER(text):
                    continue
                w = windows(as_bytes(text))
                langs.append(lang)
                keys.append(key)
                some.append([w[i].tobytes() for i in sorted(random.Random(key).sample(range(len(w)), min(len(w), WINDOWS_PER_TEXT)))])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.float64()), pa.array(some, pa.list_(pa.binary()))], names=["lang", "key", "w"])

    found = thin.select("lang", "key", "text").mapInArrow(cut, "lang string, key double, w array<binary>").collect()
    by: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.key, [bytes(x) for x in r.w])):
        by.setdefault(r.lang, []).append(r.w)
    return fit([(lang, bytes(w)) for lang, own in by.items() for ws in own[:TEXTS_PER_LANG] for w in ws])


def predict_languages(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row.

    Defined cases: a null text, one without a letter, and any text where nothing could be learned give ``und`` with score
    0; a null id is not held out; repeated rows give repeated rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            langs, scores = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
