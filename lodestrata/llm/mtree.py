"""Exact top-k by inner product with an M-tree.

Integer vectors x get one more coordinate sqrt(M^2 - |x|^2), M the largest norm, and queries q the coordinate 0.  Then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the highest inner products are the nearest points of a metric space.

The root level of the tree is spread over shards: each row joins the shard of its nearest routing vector, large shards are
split by hash, and each (shard, part) is one tree whose covering radius is its largest distance from the routing vector.
A tree has paged nodes; every entry stores its distance to the parent's routing vector and, above the leaves, a covering
radius.  Trees are built once and written, ``TREES_PER_FILE`` to a file, into the shared folder; their balls are the sparse
directory.

Queries are packed into blocks of at most ``QUERY_BLOCK`` rows that lie near one another.  A block first searches its
rows' home trees, which gives each query a bound on its k-th best; then it is sent to the files that hold a tree whose ball
some bound can't exclude.  Inside a tree each query takes its nodes best first; an entry whose stored parent distance
already excludes it (triangle inequality) is passed over without computing its distance.  A query waits at its best node
until that node has the longest queue, so the queries at a node share one matrix product; its own order stays best first.

Bounds carry a slack above rounding errors, and scores are exact integers, so the result is exact.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.llm.shared import SharedFile, fresh_path, parallelism, read_shared, written

SHARD_ROWS = 4096
MAX_SHARDS = 1024
#: Rows of one tree; a shard of more is split by hash.
TREE_ROWS = 4 * SHARD_ROWS
TREES_PER_FILE = 4
QUERY_BLOCK = 512
#: Rows for choosing routing vectors: this many a shard, so at most ``8 * MAX_SHARDS`` in all.  Every row is indexed.
SAMPLE_PER_SHARD = 8
#: Children of a node at most, and rows of a leaf.
PAGE, LEAF = 64, 256
#: Block rows that one task takes in the second phase.
ROWS_PER_TASK = 32
#: Scores are sums in double precision up to this bound, in 64-bit integers beyond it, and refused beyond ``TOO_LARGE``.
EXACT, TOO_LARGE = float(1 << 53), float(1 << 62)
_NONE = -(1 << 63)


@dataclass
class Found:
    """The best ``k`` of some queries so far: scores falling, of equal ones smaller ids first; -1 in ``uids`` for none."""

    scores: np.ndarray
    ids: np.ndarray
    uids: np.ndarray

    @classmethod
    def none(cls, n: int, k: int) -> Found:
        return cls(np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1))

    def least(self, qi: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The k-th score, -inf where there are fewer."""
        last = self.scores[qi, -1]
        return np.where(last == _NONE, -np.inf, last.astype(np.float64))

    def offer(self, qi: np.ndarray, s: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Take in the scores ``s`` (queries qi by candidates), doubles or longs; the lowest value stands for none."""
        k = self.scores.shape[1]
        i, j = np.nonzero((s >= self.scores[qi, -1][:, None]) & (s > _NONE))
        if not len(i):
            return
        some, i = np.unique(i, return_inverse=True)
        w = qi[some]
        row = np.concatenate([np.repeat(np.arange(len(w)), k), i])
        score = np.concatenate([self.scores[w].ravel(), s[some[i], j].astype(np.int64)])
        id_, uid = np.concatenate([self.ids[w].ravel(), ids[j]]), np.concatenate([self.uids[w].ravel(), uids[j]])
        o = np.lexsort((uid, id_, ~score, row))  # ~score falls as the score rises, without overflow
        rank = np.arange(len(o)) - np.searchsorted(row[o], row[o])
        o = o[rank < k]
        self.scores[w], self.ids[w], self.uids[w] = (x[o].reshape(len(w), k) for x in (score, id_, uid))


class MTree:
    """Bulk-loaded M-tree over int64 vectors ``v`` with ids and row ids; ``top`` is the norm bound M.

    Vectors lie in the order of the leaves.  Node n has the entries ``first[n]`` to ``first[n + 1]``: of a leaf (``leaf[n]``
    >= 0, the place of its first vector) the vectors, of an inner node the routing vectors ``rows`` with ``radius`` and
    ``child``; ``parent`` is the entry's distance to the node's own routing vector.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, top: float, uids: np.ndarray | None = None):
        self.top = top
        f = v.astype(np.float64)
        self._f, self._sq = f, (f * f).sum(axis=1)
        self._extra = np.sqrt(np.maximum(0.0, top * top - self._sq))
        self._nodes: list[tuple] = []
        self._order: list[np.ndarray] = []
        self._placed = 0
        self.computed = self.avoided = 0
        if len(ids):
            self._build(np.arange(len(ids)), None)
        order = np.concatenate(self._order) if self._order else np.zeros(0, np.int64)
        where = np.empty_like(order)
        where[order] = np.arange(len(order))
        self.ids, self.uids, self.f = ids[order], (ids if uids is None else uids)[order], f[order]
        self.first = np.cumsum([0, *(len(n[1]) for n in self._nodes)])
        cat = lambda i, kind: np.concatenate([np.asarray(n[i], kind) for n in self._nodes]) if self._nodes else np.zeros(0, kind)
        self.leaf = np.array([n[0] for n in self._nodes], np.int64)
        self.parent, self.radius, self.child = cat(1, float), cat(3, float), cat(4, np.int64)
        self.rows = np.concatenate([where[n[2]] for n in self._nodes]) if self._nodes else where
        self.by_uid = np.argsort(self.uids, kind="stable")
        del self._f, self._sq, self._extra, self._nodes, self._order

    def _dist(self, rows: np.ndarray, at: int) -> np.ndarray:
        d = self._sq[rows] + self._sq[at] - 2 * (self._f[rows] @ self._f[at]) + (self._extra[rows] - self._extra[at]) ** 2
        return np.sqrt(np.maximum(0.0, d))

    def _build(self, rows: np.ndarray, routing: int | None) -> int:
        """Append the node of ``rows`` and those below it; its number."""
        me = len(self._nodes)
        if len(rows) <= LEAF:
            to_parent = self._dist(rows, routing) if routing is not None else np.zeros(len(rows))
            self._nodes.append((self._placed, to_parent, rows, np.zeros(len(rows)), np.full(len(rows), -1)))
            self._order.append(rows)
            self._placed += len(rows)
            return me
        self._nodes.append(())
        fan = min(PAGE, -(-len(rows) // LEAF) + 1)
        picks = rows[np.random.default_rng(len(rows)).permutation(len(rows))[:fan]]
        near, owner = self._dist(rows, picks[0]), np.zeros(len(rows), np.int64)
        for i, p in enumerate(picks[1:], 1):
            d = self._dist(rows, p)
            closer = d < near
            near[closer], owner[closer] = d[closer], i
        if np.bincount(owner, minlength=fan).max() > 0.9 * len(rows):  # (nearly) equal points: an even split
            owner = np.arange(len(rows)) * fan // len(rows)
            picks = rows[np.searchsorted(owner, np.arange(fan))]
        used = [i for i in range(fan) if (owner == i).any()]
        radius = [self._dist(rows[owner == i], picks[i]).max() for i in used]
        kids = [self._build(rows[owner == i], picks[i]) for i in used]
        pick = picks[used]
        to_parent = self._dist(pick, routing) if routing is not None else np.zeros(len(pick))
        self._nodes[me] = (-1, to_parent, pick, np.array(radius), np.array(kids))
        return me

    def own_places(self, uids: np.ndarray) -> np.ndarray:
        """The place of each row id in this tree, -1 where it isn't here."""
        if not len(self.uids):
            return np.full(len(uids), -1)
        at = np.minimum(np.searchsorted(self.uids[self.by_uid], uids), len(self.uids) - 1)
        place = self.by_uid[at]
        return np.where(self.uids[place] == uids, place, -1)

    def search(self, q: np.ndarray, uids: np.ndarray, found: Found, which: np.ndarray | None = None) -> None:
        """Bring the best of the queries ``which`` (all by default) of ``q`` into ``found``; a query's own row takes no part."""
        live = np.arange(len(q)) if which is None else which
        if not len(self.ids) or not len(live):
            return
        f = q.astype(np.float64)
        base = (f * f).sum(axis=1) + self.top**2
        slack = 1e-7 * (1.0 + np.sqrt(base))
        whole = np.sqrt(base.max()) * self.top >= EXACT
        own = self.own_places(uids)

        def reach(qi: np.ndarray) -> np.ndarray:
            """Distance beyond which nothing can enter query qi's list."""
            return np.sqrt(np.maximum(0.0, base[qi] - 2.0 * found.least(qi))) + slack[qi]

        low = np.full((len(q), len(self.leaf)), np.inf)  # least possible distance of anything in a waiting node
        dist = np.zeros((len(q), len(self.leaf)))  # of the node's routing vector
        low[live, 0] = 0.0
        at = np.full(len(q), -1)
        at[live] = 0
        while True:
            queue = np.bincount(at[at >= 0], minlength=1)
            node = int(queue.argmax())
            if not queue[node]:
                return
            qi = np.flatnonzero(at == node)
            a, z = self.first[node], self.first[node + 1]
            most, parent = reach(qi), self.parent[a:z]
            if node:
                may = np.abs(dist[qi, node][:, None] - parent) - self.radius[a:z] <= most[:, None]
            else:
                may = np.ones((len(qi), z - a), bool)
            used = np.flatnonzero(may.any(axis=0))
            self.computed += len(qi) * len(used)
            self.avoided += len(qi) * (z - a - len(used))
            if self.leaf[node] >= 0:
                place = self.leaf[node] + (used if len(used) < (z - a) // 2 else np.arange(z - a))
                vectors = self.f[place] if len(place) < z - a else self.f[place[0] : place[0] + z - a] if z > a else self.f[:0]
                s = f[qi].astype(np.int64) @ vectors.T.astype(np.int64) if whole else f[qi] @ vectors.T
                if len(place):
                    col = np.searchsorted(place, own[qi])
                    hit = np.flatnonzero(place[np.minimum(col, len(place) - 1)] == own[qi])
                    s[hit, col[hit]] = _NONE
                    found.offer(qi, s, self.ids[place], self.uids[place])
            elif len(used):
                kid = self.child[a:z][used]
                d = np.sqrt(np.maximum(0.0, base[qi][:, None] - 2.0 * (f[qi] @ self.f[self.rows[a:z][used]].T)))
                least = np.maximum(0.0, d - self.radius[a:z][used])
                least[~may[:, used] | (least > most[:, None])] = np.inf
                low[qi[:, None], kid] = least
                dist[qi[:, None], kid] = d
            low[qi, node] = np.inf
            best = low[qi].argmin(axis=1)
            at[qi] = np.where(low[qi, best] <= np.minimum(reach(qi), np.finfo(float).max), best, -1)


def scaled(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows that take no part are left out."""
    ok = F.col("e").isNotNull() & F.col("vec_id").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).filter(F.coalesce(ok, F.lit(False)))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width``, shorter lists padded with zeros."""
    flat, n = np.asarray(column.flatten()), np.asarray(column.value_lengths())
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), flat.dtype)
    out[np.arange(width) < n[:, None]] = flat
    return out


class _Trees:
    """Trees by file, those of the last file kept."""

    def __init__(self, folder: str):
        self.folder, self.name, self.trees = folder, "", []

    def of(self, name: str) -> list[MTree]:
        if name != self.name:
            self.trees = []
            self.name, self.trees = name, pickle.loads(read_shared(self.folder, name))
        return self.trees


def _build_trees(dealt: DataFrame, folder: str, top: float, width: int) -> DataFrame:
    """Write the trees; (file, slot, shard, part, radius) of each.  A file has its own name in every attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trees, places = [], [], []

        def flush() -> None:
            if trees:
                name = f"trees-{uuid.uuid4().hex}"
                out = SharedFile(folder, name)
                out.write(pickle.dumps(trees, protocol=5))
                out.close()
                places.extend((name, i, *p) for i, p in enumerate(waiting))
                trees.clear()
                waiting.clear()

        waiting: list[tuple] = []

        def close() -> None:
            uid, id_, v, d = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
            trees.append(MTree(id_, v, top, uid))
            waiting.append((*held[0][0], float(d.max())))
            held.clear()
            if len(trees) == TREES_PER_FILE:
                flush()

        for b in batches:
            if not b.num_rows:
                continue
            shard, part, uid, id_, d = (np.asarray(b.column(i)) for i in (0, 1, 2, 3, 5))
            v = matrix(b.column(4), width)
            edge = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]))))
            for a, z in zip(edge, [*edge[1:], len(shard)]):
                key = int(shard[a]), int(part[a])
                if held and held[0][0] != key:
                    close()
                held.append((key, uid[a:z], id_[a:z], v[a:z], d[a:z]))
        if held:
            close()
        flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in places], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))],
            names=["file", "slot", "shard", "part", "radius"],
        )

    ordered = dealt.select("shard", "part", "uid", "vec_id", "v", "d").repartition(parallelism(dealt), "shard", "part").sortWithinPartitions("shard", "part")
    return written(ordered.mapInArrow(run, "file string, slot int, shard int, part int, radius double"), "balls")


_STATE = "block string, n int, uid binary, qid binary, shard binary, part binary, v binary, scores binary, ids binary, uids binary"


def _pack(state: dict) -> list[pa.Array]:
    return [pa.array([state["block"]]), pa.array([state["n"]], pa.int32()), *(pa.array([state[c].tobytes()]) for c in ("uid", "qid", "shard", "part", "v")), *(pa.array([x.tobytes()]) for x in (state["found"].scores, state["found"].ids, state["found"].uids))]


def _unpack(row: dict, width: int, k: int) -> dict:
    n, at = row["n"], lambda c, t: np.frombuffer(row[c], t)
    best = Found(at("scores", np.int64).reshape(n, k).copy(), at("ids", np.int64).reshape(n, k).copy(), at("uids", np.int64).reshape(n, k).copy())
    return {"uid": at("uid", np.int64), "qid": at("qid", np.int64), "shard": at("shard", np.int32), "part": at("part", np.int32), "v": at("v", float).reshape(n, width), "found": best}


def _results(uid: np.ndarray, qid: np.ndarray, found: Found, keep: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(keep & (found.uids >= 0))
    cols = [uid[i], qid[i], found.ids[i, j], found.scores[i, j], found.uids[i, j]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["quid", "query_id", "vec_id", "score", "cuid"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k best other rows.

    Defined cases: vectors null or holding null or non-finite components, and null ids, take no part; vectors of unequal
    length are compared as if padded with zeros; rows that share an id are separate, as candidates and as queries (each
    such query has ranks of its own, and the others of its id are candidates); ties go to the smaller id; fewer than k
    other rows give that many; vectors whose scores might not fit a long are refused with an error; other columns are ignored.
    """
    spark = vectors.sparkSession
    base = written(scaled(vectors, scale, id_col, vec_col).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, width, most = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    if most >= TOO_LARGE:
        raise ValueError("scores of these vectors may not fit a long")
    top, width = float(np.sqrt(most)) * (1 + 1e-12), max(1, width)
    shards = max(1, min(MAX_SHARDS, -(-total // SHARD_ROWS)))
    some = base.orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(SAMPLE_PER_SHARD * shards).collect()
    # routing vectors: farthest-first over the sample
    x = matrix(pa.array([r.v for r in some], pa.list_(pa.float64())), width) if some else np.zeros((1, width))
    x = np.column_stack([x, np.sqrt(np.maximum(0.0, top * top - (x * x).sum(axis=1)))])
    picks, near = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picks) < shards and near.max() > 0:
        picks.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[picks[-1]], axis=1))
    routes = x[picks]
    routes_sq = (routes * routes).sum(axis=1)
    del some, x

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), width)
            sq = (v * v).sum(axis=1)
            wide = np.column_stack([v, np.sqrt(np.maximum(0.0, top * top - sq))])
            d = np.sqrt(np.maximum(0.0, top * top + routes_sq - 2 * wide @ routes.T))
            s = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.astype(np.int32)), pa.array(d[np.arange(len(s)), s])], names=["vec_id", "v", "uid", "shard", "d"])

    near = base.select("vec_id", "v", "uid").mapInArrow(deal, "vec_id long, v array<double>, uid long, shard int, d double")
    sizes = near.groupBy("shard").agg(F.ceil(F.count("*") / TREE_ROWS).cast("int").alias("parts"))
    parts_of = {r.shard: r.parts for r in sizes.filter("parts > 1").collect()}  # at most MAX_SHARDS rows
    parts = F.coalesce(F.create_map(*(F.lit(x) for kv in parts_of.items() for x in kv))[F.col("shard")], F.lit(1)) if parts_of else F.lit(1)
    dealt = written(near.withColumn("part", F.pmod(F.xxhash64("uid"), parts.cast("long")).cast("int")), "shards")

    folder = fresh_path(spark, "mtree")
    balls = [tuple(r) for r in _build_trees(dealt, folder, top, width).select("file", "slot", "shard", "part", "radius").collect()]
    home = {(s, p): (f, i) for f, i, s, p, _ in balls}
    files: dict[str, list[tuple]] = {}
    for f, i, s, p, r in sorted(balls):
        files.setdefault(f, []).append((i, s, p, r))
    names = sorted(files)

    def bounds(q: np.ndarray, found: Found) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each query to the routing vectors, and that beyond which nothing can enter its list."""
        square = (q * q).sum(axis=1) + top * top
        d = np.sqrt(np.maximum(0.0, square[:, None] - 2.0 * q @ routes[:, :-1].T))
        return d, np.sqrt(np.maximum(0.0, square - 2.0 * found.least())) + 2e-7 * (1.0 + np.sqrt(square))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees(folder)
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                c = b.slice(at, QUERY_BLOCK)
                uid, qid, shard, part = (np.asarray(c.column(i)) for i in range(4))
                v = matrix(c.column(4), width)
                found = Found.none(len(uid), k)
                for s, p in sorted(set(zip(shard.tolist(), part.tolist())), key=home.__getitem__):
                    f, i = home[s, p]
                    trees.of(f)[i].search(v, uid, found, np.flatnonzero((shard == s) & (part == p)))
                state = {"block": uuid.uuid4().hex, "n": len(uid), "uid": uid, "qid": qid, "shard": shard, "part": part, "v": v, "found": found}
                yield pa.RecordBatch.from_arrays(_pack(state), names=[c.split()[0] for c in _STATE.split(", ")])

    queries = dealt.filter(F.col("vec_id") % every == 0).select("uid", F.col("vec_id").alias("query_id"), "shard", "part", "v")
    near_by = queries.repartitionByRange(max(1, min(parallelism(queries), -(-total // every // QUERY_BLOCK))), "shard", "part", "uid").sortWithinPartitions("shard", "part", "uid")
    blocks = written(near_by.mapInArrow(at_home, _STATE), "blocks")
    n_blocks = blocks.count()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                state = _unpack({n: b.column(n)[i].as_py() for n in b.schema.names}, width, k)
                d, most = bounds(state["v"], state["found"])
                wanted = [no for no, f in enumerate(names) if any((d[:, s] - r <= most).any() for _, s, _, r in files[f])]
                one = b.slice(i, 1)
                for no in wanted:
                    yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), *one.columns], names=["file", *b.schema.names])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees(folder)
        for b in batches:
            for i in range(b.num_rows):
                state = _unpack({n: b.column(n)[i].as_py() for n in b.schema.names}, width, k)
                q, found, f = state["v"], state["found"], names[b.column("file")[i].as_py()]
                before = found.uids.copy()
                d, _ = bounds(q, found)
                for slot, s, p, r in files[f]:
                    _, most = bounds(q, found)
                    which = np.flatnonzero((d[:, s] - r <= most) & ~((state["shard"] == s) & (state["part"] == p)))
                    if len(which):
                        trees.of(f)[slot].search(q, state["uid"], found, which)
                new = (found.uids[:, :, None] != before[:, None, :]).all(axis=2)
                yield _results(state["uid"], state["qid"], found, new)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                state = _unpack({n: b.column(n)[i].as_py() for n in b.schema.names}, width, k)
                yield _results(state["uid"], state["qid"], state["found"], np.ones(state["found"].uids.shape, bool))

    hit = "quid long, query_id long, vec_id long, score long, cuid long"
    tasks = max(1, -(-n_blocks * max(1, len(names)) // ROWS_PER_TASK), min(parallelism(queries), n_blocks * len(names)))
    sent = blocks.mapInArrow(route, f"file int, {_STATE}").repartition(tasks, "file", "block").sortWithinPartitions("file")
    hits = blocks.mapInArrow(first, hit).union(sent.mapInArrow(further, hit))
    rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "cuid"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
