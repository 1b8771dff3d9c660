"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative a group.

Rows are compared only within a label.  Centroids come from a bounded sample; every vector goes to its nearest centroid's
cell.  A pair may fall into two cells, so a vector also visits each lower-numbered cell whose bisecting plane with its own
is nearer than the chord of the threshold: any partner there is within that chord, hence no pair is lost, and a pair is
compared in the lower of its two cells only.

Equal vectors are one point with a multiplicity, so a group of copies costs one point.  A cell of more than ``BLOCK``
points is compared block by block in separate groups, each of which sends out link *counts* a point and a spanning forest
of its links: never a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.components import connected_components
from lodestrata.llm.shared import pieces, written

#: Vectors used to fit the centroids, at least and for each cell; every vector is assigned to a cell.
SAMPLE, SAMPLE_PER_CELL = 20_000, 4
POINTS_PER_CELL = 4000
#: Cells are one row each on the driver and in every task: this many hold 32 million points a label before they grow.
MAX_CELLS = 8192
BLOCK = 2048
ROUNDS = 12


def fit_centroids(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Unit centroids of k cells by spherical k-means; an emptied cell restarts at the worst-served row."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        cos = x @ c.T
        own = cos.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        norm = np.linalg.norm(new, axis=1)
        for i in np.flatnonzero(norm < 1e-12):
            new[i], norm[i] = x[cos.max(axis=1).argmin()], 1.0
        c = new / norm[:, None]
    return np.unique(c, axis=0)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _forest(a: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Spanning forest of the links in ``a``: (row, column) edges; ``same``: rows and columns are the same points."""
    out, rows_left, cols_left = [], np.ones(a.shape[0], bool), np.ones(a.shape[1], bool)
    for start in np.flatnonzero(a.any(axis=1)):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        if same:
            cols_left[start] = False
        stack = [(0, start)]
        while stack:
            side, at = stack.pop()
            if side == 0:
                hit = np.flatnonzero(a[at] & cols_left)
                cols_left[hit] = False
                out += [(at, j) for j in hit]
                if same:
                    rows_left[hit] = False
                stack += [(0 if same else 1, j) for j in hit]
            else:
                hit = np.flatnonzero(a[:, at] & rows_left)
                rows_left[hit] = False
                out += [(i, at) for i in hit]
                stack += [(0, i) for i in hit]
    return out


def embedding_groups(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Defined cases: a vector that is null, empty, zero or holds null or non-finite components, and any row with a null
    label, links with nothing and is its own component; vectors of unequal length never link; repeated rows link to each
    other and each gives a row; a null id never names a component that has another id, and is not kept; other columns
    are ignored.
    """
    e = F.col("e")
    ok = e.isNotNull() & F.col("label").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("e"))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    points = written(
        rows.filter("ok").groupBy("label", "e").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
        .select(F.monotonically_increasing_id().alias("pid"), "label", F.col("e"), "first", "m"),
        "points",
    )
    widths = points.groupBy(F.size("e").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 0
    n = widths[0]["count"] if widths else 0
    usual = points.filter(F.size("e") == width)
    cells = max(1, min(MAX_CELLS, n // POINTS_PER_CELL))
    sample = usual.orderBy(F.xxhash64("pid"), "pid").limit(max(SAMPLE, SAMPLE_PER_CELL * cells)).select("e").toPandas()["e"].to_list() if n else []
    centroids = fit_centroids(_unit(np.array(sample, np.float64)), min(cells, len(sample))) if sample else np.zeros((1, width))
    del sample
    chord = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2048):
            is_usual = np.asarray(b.column(2).value_lengths()) == width
            take, cell, home = [np.flatnonzero(~is_usual)], [np.full((~is_usual).sum(), -1)], [np.ones((~is_usual).sum(), bool)]
            at = np.flatnonzero(is_usual)
            if len(at):
                cos = _unit(np.asarray(b.column(2).take(pa.array(at)).flatten()).reshape(len(at), width)) @ centroids.T
                own = cos.argmax(axis=1)
                take.append(at)
                cell.append(own)
                home.append(np.ones(len(at), bool))
                homes, of = np.unique(own, return_inverse=True)
                gaps = np.sqrt(np.maximum(0.0, 2 - 2 * (centroids[homes] @ centroids.T))) + 1e-7
                margin = (cos[np.arange(len(at)), own][:, None] - cos) <= chord * gaps[of]
                margin &= np.arange(len(centroids)) < own[:, None]
                i, c = np.nonzero(margin)
                take.append(at[i])
                cell.append(c)
                home.append(np.zeros(len(i), bool))
            t = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(t) for i in range(4)] + [pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(home))],
                names=["pid", "label", "e", "m", "cell", "home"],
            )

    kind = points.schema["label"].dataType.simpleString()
    placed = points.select("pid", "label", "e", "m").mapInArrow(assign, f"pid long, label {kind}, e array<double>, m long, cell int, home boolean")
    placed = placed.withColumn("w", F.size("e"))
    keys = ["label", "w", "cell"]
    large = placed.groupBy(*keys).count().filter(F.col("count") > BLOCK).select(*keys, F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    parts = F.coalesce("n", F.lit(1))
    dealt = (
        placed.join(large, keys, "left").withColumn("own", F.pmod(F.xxhash64("pid"), parts.cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "pid", "m", "home", "e")
    )

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        same = g.lo.iloc[0] == g.hi.iloc[0]
        left, right = (g, g) if same else (g[g.own == g.lo], g[g.own == g.hi])
        none = pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        if not len(left) or not len(right):
            return none
        x, y = _unit(np.stack(left.e.to_list())), _unit(np.stack(right.e.to_list()))
        hit = (x @ y.T >= threshold) & (left.home.to_numpy()[:, None] | right.home.to_numpy()[None])
        if same:
            np.fill_diagonal(hit, False)
        lp, rp = left.pid.to_numpy(), right.pid.to_numpy()
        counts = [(lp, hit @ right.m.to_numpy())] + ([] if same else [(rp, left.m.to_numpy() @ hit)])
        edges = _forest(hit, same)
        out = [pd.DataFrame({"a": p[c > 0], "b": pd.array([pd.NA] * int((c > 0).sum()), "Int64"), "n": c[c > 0]}) for p, c in counts]
        if edges:
            i, j = np.array(edges).T
            out.append(pd.DataFrame({"a": lp[i], "b": pd.array(rp[j], "Int64"), "n": np.zeros(len(i), np.int64)}))
        return pd.concat(out) if out else none

    found = written(dealt.groupBy(*keys, "lo", "hi").applyInPandas(compare, "a long, b long, n long"), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("pid")).agg(F.sum("n").alias("near"))
    reps = connected_components(found.filter("b is not null").select("a", "b")).toDF("pid", "rep")
    known = points.join(reps, "pid", "left").withColumn("rep", F.coalesce("rep", "pid")).join(counts, "pid", "left")
    named = known.join(known.groupBy("rep").agg(F.min("first").alias("component_id")), "rep")
    named = written(named.select("label", "e", (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id"), "named")
    linked = rows.filter("ok").join(named, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
