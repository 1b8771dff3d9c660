"""Toxicity severity by cumulative-link (proportional-odds) regression on sparse word features.

A text's features are the hashed distinct words of the whole text and the distinct beginnings of these words (3 to 8
letters), which carry over to inflected and compound forms that no labelled text had.  One weight vector w is shared by all grades; ordered
thresholds t_1 < ... < t_{K-1} cut the score: P(grade >= k) = sigmoid(w.x - t_k).  The expected severity is the sum of
these probabilities weighted by the steps between grades.  w is kept sparse by soft thresholding, so the many words that
say nothing about severity weigh nothing, however long the text.

Fitted on a bounded sample of the labelled rows (``SAMPLE_PER_GRADE`` a grade, by hash of the id, reweighted to the grades'
true shares); applied to every row.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.shared import with_text_columns

SAMPLE_PER_GRADE = 2500
MAX_GRADES = 32
BUCKETS = 1 << 22
STEMS = range(3, 9)
#: A feature must occur in this many sampled texts to have a weight.
MIN_TEXTS = 3
EPOCHS, MIN_STEPS, BATCH, RATE, L1 = 25, 1500, 128, 0.3, 1e-4
_WORDS = re.compile(r"[^\W_]+").findall
_MEMO = 100_000
_NONE: list = []


def word_buckets(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    return [zlib.crc32(x.encode()) % BUCKETS for x in (word, *(f"^{word[:n]}" for n in STEMS if n <= len(word)))]


def buckets(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    words = set(_WORDS(text.lower())) if text else ()
    return np.array(sorted({b for w in words for b in word_buckets(w)}), np.int64)


@dataclass
class CumulativeLink:
    """grades: ascending values; w: {bucket: weight}; cuts: one threshold between neighbouring grades."""

    grades: list[float]
    w: dict[int, float]
    cuts: np.ndarray

    def severity(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity, and the index of the grade: thresholds passed with probability over one half."""
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -40, 40)))
        return self.grades[0] + above @ np.diff(self.grades), (above > 0.5).sum(axis=1)


def gradients(eta: np.ndarray, y: np.ndarray, s: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log likelihood of the grades ``y`` at the scores ``eta``; its gradients by score and by cut."""
    k = len(cuts) + 1
    wide = np.concatenate(([-np.inf], cuts, [np.inf]))
    upper, lower = (1 / (1 + np.exp(-np.clip(wide[y + j] - eta, -40, 40))) for j in (1, 0))
    p = np.maximum(upper - lower, 1e-9)
    dc = np.bincount(np.minimum(y, k - 2), np.where(y < k - 1, -upper * (1 - upper) / p * s, 0), k - 1)
    dc += np.bincount(np.maximum(y - 1, 0), np.where(y > 0, lower * (1 - lower) / p * s, 0), k - 1)
    return float(-(s * np.log(p)).sum()), (1 - upper - lower) * s, dc


def fit(samples: list[tuple[float, np.ndarray, float]]) -> CumulativeLink:
    """(grade, buckets, weight) rows -> model."""
    x = [np.asarray(x, np.int32) for _, x, _ in samples]
    return fit_rows(np.array([g for g, _, _ in samples], float), np.concatenate([np.zeros(0, np.int32), *x]), np.array([len(v) for v in x], np.int64), np.array([w for *_, w in samples], float))


def fit_rows(grade: np.ndarray, every: np.ndarray, size: np.ndarray, sw: np.ndarray) -> CumulativeLink:
    """Proximal Adagrad over the ordinal likelihood; ``every`` holds the rows' sorted buckets end to end, ``size`` how many each has."""
    grades, y = np.unique(grade, return_inverse=True)
    k, n = len(grades), len(grade)
    if k < 2:
        return CumulativeLink(grades.tolist() or [0.0], {}, np.zeros(max(0, k - 1)))
    used_buckets, df = np.unique(every, return_counts=True)
    used_buckets = used_buckets[df >= MIN_TEXTS]
    width = len(used_buckets)
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    known = np.isin(every, used_buckets)
    indices = np.searchsorted(used_buckets, every[known]).astype(np.int32)
    size = np.bincount(row[known], minlength=n)
    del row, known
    first = np.concatenate(([0], size.cumsum()))[:-1]
    sw = sw / sw.mean()
    share = np.array([sw[y >= i].sum() for i in range(1, k)]) / sw.sum()
    cuts = -np.log(share / (1 - share))
    w, g2, c2 = np.zeros(width), np.full(width, 1e-8), np.full(k - 1, 1e-8)
    rng = np.random.default_rng(7)
    for _ in range(max(EPOCHS, MIN_STEPS * BATCH // n)):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            rows = order[i : i + BATCH]
            ends = size[rows].cumsum()
            if not ends[-1]:
                continue
            owner = np.repeat(np.arange(len(rows)), size[rows])
            flat = indices[np.arange(ends[-1]) + (first[rows] - ends + size[rows])[owner]]
            eta = np.bincount(owner, w[flat], len(rows))
            _, de, dc = gradients(eta, y[rows], sw[rows] / len(rows), cuts)
            grad = np.bincount(flat, de[owner], width)
            used = np.flatnonzero(np.bincount(flat, minlength=width))
            g = grad[used]
            g2[used] += g**2
            step = RATE / np.sqrt(g2[used])
            moved = w[used] - step * g
            w[used] = np.sign(moved) * np.maximum(0.0, np.abs(moved) - step * L1)
            c2 += dc**2
            cuts = np.maximum.accumulate(cuts - RATE * dc / np.sqrt(c2))
            cuts += np.arange(k - 1) * 1e-6
    kept = np.flatnonzero(w)
    return CumulativeLink(grades.tolist(), dict(zip(used_buckets[kept].tolist(), w[kept].tolist())), cuts)


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink:
    """Fit on labelled rows of ``docs``; rows without grade or id don't count, several labels of one id count as the highest."""
    spark = docs.sparkSession
    graded = labels.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("double").alias("grade")).filter("doc_id is not null and grade is not null and not isnan(grade)")
    graded = graded.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    counts = {r.grade: r["count"] for r in graded.groupBy("grade").count().limit(MAX_GRADES + 1).collect()}
    if len(counts) > MAX_GRADES:
        raise ValueError(f"more than {MAX_GRADES} grades")
    picks, per = [], {}
    for grade, n in sorted(counts.items()):
        own = graded.filter(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_GRADE).collect()
        picks += [(r.doc_id, r.grade) for r in own]
        per[grade] = n / len(own)
    if not picks:
        return fit([])
    some = F.broadcast(spark.createDataFrame(picks, "doc_id long, grade double"))  # at most MAX_GRADES * SAMPLE_PER_GRADE rows

    @F.pandas_udf("binary")
    def features(texts):
        return texts.map(lambda t: buckets(t).astype("<i4").tobytes())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(some, "doc_id")
    found = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("doc_id", "grade", features("text").alias("x")).collect()
    found.sort(key=lambda r: r.doc_id)
    grade, size = np.array([r.grade for r in found]), np.array([len(r.x) // 4 for r in found], np.int64)
    every = np.frombuffer(b"".join([r.x for r in found]), "<i4")
    del found
    return fit_rows(grade, every, size, np.array([per[g] for g in grade.tolist()]))


def grade_documents(
    docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text", severity_col: str = "severity", grade_col: str = "grade"
) -> DataFrame:
    """``docs`` with the expected severity and the grade (both double) of each whole text.

    Defined cases: a null or wordless text has no features and gets the severity of an empty text; a model fitted without
    labels, or with one grade only, gives that grade (0 without any); existing columns of these names are replaced.
    """
    weight_of: dict[str, list[tuple[int, float]]] = {}  # filled in each worker

    def score(texts: list) -> list[pa.Array]:
        scores = np.zeros(len(texts))
        for i, text in enumerate(texts):
            hit: dict[int, float] = {}
            for word in set(_WORDS(text.lower())) if text else ():
                at = weight_of.get(word)
                if at is None:
                    if len(weight_of) >= _MEMO:
                        weight_of.clear()
                    at = weight_of[word] = [(b, model.w[b]) for b in word_buckets(word) if b in model.w] or _NONE
                if at:
                    hit.update(at)
            scores[i] = sum(hit.values())
        severity, grade = model.severity(scores)
        return [pa.array(severity, pa.float64()), pa.array(np.array(model.grades)[grade], pa.float64())]

    return with_text_columns(docs, text_col, score, f"`{severity_col}` double, `{grade_col}` double")
