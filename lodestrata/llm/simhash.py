"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the set-bit counts of its 32 two-bit segments.  The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints, so fingerprints within ``distance`` bits lie within
``distance`` of each other on that grid.  The grid range join uses this: with the segments dealt into ``g`` groups, two
points within Manhattan distance d differ in at most d groups, hence share a cell in one of the C(g, d) projections that
leave out d groups.  Each fingerprint is sent to its cell of every projection; within a cell the Manhattan bound is
tested first and the exact Hamming distance after it.

Scale: only *distinct* fingerprints are joined, a cell sends out a spanning forest of its links (fewer edges than
members, never all pairs), and a cell of more than ``BLOCK`` fingerprints is split into blocks whose pairs are separate
groups.

``simhash_groups`` links whole-text fingerprints.  ``near_duplicates`` finds near copies by shingle similarity: a document
gets fingerprints of ``VIEWS`` short passages that start at its min-wise shingles, so near copies share some passage
fingerprint almost surely.  Most passages of a short text run to its end, so texts of at most ``SHORT`` shingles meet by an
exact prefix filter instead.  Documents that share a key are compared by size, by parity sketches of their shingle sets,
which bound the similarity from above, and then exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.components import connected_components
from lodestrata.llm.shared import parallelism, pieces, written

SEED = 42
SEGMENTS = 32
#: Most fingerprints of one cell that one group compares; larger cells are compared block by block.
BLOCK = 8192
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16
_EVEN = 0x5555555555555555


def shingle_hashes(text: bytes | None, shingle: int) -> tuple[np.ndarray, bytes]:
    """XXH64 of each shingle in order, and the lower-cased words joined by spaces; none for a wordless text."""
    words = text.translate(_LOWER).split() if text else []
    joined = b" ".join(words)
    if not words:
        return np.zeros(0, "<u8"), joined
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8"), joined
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], "<u8"), joined


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text over ``shingle``-word shingles, repeats included; 0 where there is no word."""
    return _majority(shingle_hashes(text, shingle)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long.  Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _masks(distance: int, groups: int) -> list[int]:
    """For each choice of ``distance`` groups to leave out, the bits of the segments that remain, as signed longs."""
    cuts = [round(i * SEGMENTS / groups) for i in range(groups + 1)]
    bits = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    full = (1 << 64) - 1
    out = [full & ~sum(bits[i] for i in left) for left in combinations(range(groups), distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


_BYTE_L1 = np.abs(
    (np.arange(256)[:, None, None] >> np.arange(0, 8, 2) & 3) - (np.arange(256)[None, :, None] >> np.arange(0, 8, 2) & 3)
).sum(axis=2).astype(np.uint8)


def embed(fps: np.ndarray) -> np.ndarray:
    """Counts of set bits in each two-bit segment, packed two bits a segment."""
    odd = fps >> np.uint64(1)
    even = np.uint64(_EVEN)
    return ((fps ^ odd) & even) | (((fps & odd) & even) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings."""
    a, b = np.broadcast_arrays(a, b)
    x, y = (np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8) for v in (a, b))
    return _BYTE_L1[x, y].sum(axis=1)


def _near(fp, point, fps: np.ndarray, points: np.ndarray, distance: int) -> np.ndarray:
    """Indices of ``fps`` within ``distance`` bits of ``fp``: Manhattan lower bound, then the exact distance."""
    maybe = np.flatnonzero(manhattan(points, point) <= distance)
    return maybe[np.bitwise_count(fps[maybe] ^ fp) <= distance]


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph of one cell, each vertex expanded once (breadth first)."""
    points, edges = embed(fps), []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _near(fps[at], points[at], fps[left], points[left], distance)
            if len(hit):
                found = left[hit]
                edges += [(at, x) for x in found]
                queue += list(found)
                left = np.delete(left, hit)
    return edges


def near_links(fps: DataFrame, distance: int = 2, groups: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose connected components are those of all pairs within ``distance``.

    Exact: no pair within ``distance`` is missed and none beyond it is linked.
    """
    groups = groups or distance + 3
    masks = _masks(distance, groups)
    even = F.lit(_EVEN).cast("long")
    odd = F.shiftrightunsigned("fp", 1)
    point = F.col("fp").bitwiseXOR(odd).bitwiseAND(even).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(odd).bitwiseAND(even), 1))
    cells = fps.select("fp", F.posexplode(F.array(*[point.bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("view", "cell"))
    large = (
        cells.groupBy("view", "cell").count().filter(F.col("count") > BLOCK)
        .select("view", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    )
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("n", F.lit(1)).cast("long")).cast("int")
    dealt = (
        cells.join(large, ["view", "cell"], "left").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)))
        .select("view", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    keys = ["view", "cell", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None

        def links(rows: np.ndarray) -> pa.RecordBatch | None:
            """Edges of the complete cells in ``rows`` (columns view, cell, lo, hi, fp; sorted)."""
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            at, to = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
            fp = rows[:, 4].view(np.uint64)
            two = at[to - at == 2]
            x, y = fp[two], fp[two + 1]
            ok = np.flatnonzero(manhattan(embed(x), embed(y)) <= distance) if len(two) else two
            ok = ok[np.bitwise_count(x[ok] ^ y[ok]) <= distance]
            a, b = [x[ok]], [y[ok]]
            for i in np.flatnonzero(to - at > 2):
                own = fp[at[i] : to[i]]
                if edges := _forest(own, distance):
                    i, j = np.array(edges).T
                    a.append(own[i])
                    b.append(own[j])
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(k)).astype(np.int64) for k in [*keys, "fp"]])
            rows = rows if rest is None else np.concatenate([rest, rows])
            if not len(rows):
                continue
            last = len(rows) - 1 - int(np.argmax((rows[::-1, :4] != rows[-1, :4]).any(axis=1))) if (rows[:, :4] != rows[-1, :4]).any() else -1
            rest = rows[last + 1 :]
            if last >= 0:
                yield links(rows[: last + 1])
        if rest is not None and len(rest) > 1:
            yield links(rest)

    n = parallelism(fps)
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id reachable by links of at most ``distance`` differing bits.  Defined cases: null
    and wordless texts have fingerprint 0 and link to each other; repeated rows give repeated rows; a null id never
    names a component unless all of its component's ids are null; an empty table gives none; other columns are ignored.
    """
    rows = written(with_fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    per = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    reps = connected_components(near_links(per.select("fp"), distance)).toDF("fp", "rep")
    per = per.join(reps, "fp", "left").withColumn("rep", F.coalesce("rep", "fp"))
    least = per.groupBy("rep").agg(F.min("first").alias("component_id"))
    named = written(per.join(least, "rep").select("fp", "component_id"), "components")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", hex16.alias("fingerprint"), "component_id")


#: Bytes of shingle sets in one block of a group; a group of more is compared block by block, too.
BLOCK_BYTES = 32 << 20
VIEWS = 6
#: Shingles of a passage that a view fingerprints.
VIEW_SHINGLES = 8
#: Texts of at most this many distinct shingles are compared with every text that shares a shingle of the prefix filter.
SHORT = 64
#: Bits of a parity sketch.
SKETCH = 1024
_MIX = np.random.default_rng(23).integers(1 << 62, 1 << 63, VIEWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def view_fingerprints(h: np.ndarray) -> list[int]:
    """Fingerprints of the passages that start at the min-wise shingle of each view, as signed longs, distinct."""
    if not len(h):
        return [0]
    at = ((h * _MIX[:, None]) ^ ((h * _MIX[:, None]) >> np.uint64(31))).argmin(axis=1)
    rows = np.minimum(at[:, None] + np.arange(VIEW_SHINGLES), len(h) - 1)
    used = (at[:, None] + np.arange(VIEW_SHINGLES) < len(h))[:, :, None]
    bits = np.unpackbits(h[rows].view(np.uint8).reshape(VIEWS, VIEW_SHINGLES, 8), axis=2, bitorder="little")
    ones = (bits * used).sum(axis=1, dtype=np.int64) * 2 > used.sum(axis=1)
    return np.unique(np.packbits(ones, axis=1, bitorder="little").view("<i8")).tolist()


def prefix(s: np.ndarray, similarity: float) -> np.ndarray:
    """The least members of the sorted set ``s`` of which two sets of at least this Jaccard similarity share one."""
    return s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]


def sketch(s: np.ndarray) -> np.ndarray:
    """For each residue modulo ``SKETCH``, the parity of its members in the set: no more bits differ than members do."""
    return np.packbits((np.bincount(s & np.uint32(SKETCH - 1), minlength=SKETCH) & 1).astype(bool)).view("<u8")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, component_id, kept) for each row: near-copy classes by Jaccard similarity of the sets of word shingles.

    th is xxhash64 of the text; kept marks the row of smallest (doc_id, th) of each class, its repeats too.  Every link found has at least ``similarity`` (sets of 32-bit shingle hashes).  Every pair
    with a text of at most ``SHORT`` shingles is a candidate; a pair of longer ones at exactly 0.8 is one with probability
    over 0.99, closer ones more.  Texts with the same lower-cased words always
    share a class, wordless and null texts theirs.  A null id comes after all others and names a class only if all of its
    ids are null; rows with null ids link like any other.  Repeated rows give repeated rows; an empty table gives none; other
    columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th"), text.alias("text"))
    longest = int(SHORT / similarity + 1e-9)  # a longer text is not similar enough to a short one

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keys, views, heads, sets = [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                h, joined = shingle_hashes(t, shingle)
                keys.append(xxhash.xxh3_128_hexdigest(joined))
                s = np.unique((h >> np.uint64(32)).astype("<u4"))
                views.append(view_fingerprints(h) if len(s) > SHORT or not len(s) else [])
                heads.append(prefix(s, similarity).astype(np.int64) if len(s) <= longest else [])
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys), pa.array(views, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                names=["doc_id", "th", "key", "views", "heads", "sh"],
            )

    known = written(rows.mapInArrow(features, "doc_id long, th long, key string, views array<long>, heads array<long>, sh binary"), "features")
    firsts = written(
        known.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.first("views").alias("views"), F.first("heads").alias("heads"), F.first(F.octet_length("sh")).alias("bytes")).withColumn("rid", F.monotonically_increasing_id()), "firsts"
    )
    shown = firsts.select("rid", "key", "bytes", F.explode("views").alias("fp"))
    linked = connected_components(near_links(shown.select("fp").distinct(), distance=1)).toDF("fp", "rep")
    shared = firsts.select("rid", "key", "bytes", F.explode("heads").alias("g"))
    grouped = shown.join(linked, "fp", "left").select("rid", "key", "bytes", F.coalesce("rep", "fp").alias("g")).union(shared).distinct()
    sizes = grouped.groupBy("g").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes")).filter("count > 1")
    crowd = written(
        grouped.drop("bytes").join(sizes, "g").withColumn("n", F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("rid"), F.col("n").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rid", "key"),
        "crowd",
    )
    one = known.select("key", "sh").join(crowd.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("sh").alias("sh"))
    keys = ["g", "lo", "hi"]
    dealt = crowd.join(one, "key").select(*keys, "rid", "sh")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def links() -> tuple[list, list]:
            rid, sets = np.array([r[3] for r in held]), [np.frombuffer(r[4], "<u4") for r in held]
            size, bits = np.array([len(x) for x in sets]), np.array([sketch(x) for x in sets])
            left, a, b = np.arange(len(rid)), [], []
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    at = queue.pop()
                    small, big = np.minimum(size[left], size[at]), np.maximum(size[left], size[at])
                    maybe = np.flatnonzero(small >= similarity * big - 1e-9)
                    apart = np.bitwise_count(bits[left[maybe]] ^ bits[at]).sum(axis=1, dtype=np.int64)
                    maybe = maybe[apart <= (1 - similarity) / (1 + similarity) * (size[left[maybe]] + size[at]) + 1e-6]
                    hit = []
                    for i in maybe:
                        both = len(np.intersect1d(sets[at], sets[left[i]], assume_unique=True))
                        if both >= similarity * (size[at] + size[left[i]] - both) - 1e-9:
                            hit.append(i)
                    if hit:
                        found = left[hit]
                        a += [rid[at]] * len(found)
                        b += rid[found].tolist()
                        queue += list(found)
                        left = np.delete(left, hit)
            return a, b

        def batch(a: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for rows_ in batches:
            a, b = [], []
            for r in zip(*(rows_.column(i).to_pylist() for i in range(5))):
                if r[:3] != group:
                    x, y = links()
                    a += x
                    b += y
                    group, held = r[:3], []
                held.append(r)
            yield batch(a, b)
        yield batch(*links())

    edges = dealt.repartition(parallelism(docs), *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")
    reps = connected_components(edges).toDF("rid", "rep")
    named = firsts.select("rid", "key", "first").join(reps, "rid", "left").withColumn("rep", F.coalesce("rep", "rid"))
    least = named.groupBy("rep").agg(F.min("first").alias("least"))
    final = written(named.join(least, "rep").select("key", "least"), "classes")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    return known.select("doc_id", "th", "key").join(final, "key").select("doc_id", "th", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))
