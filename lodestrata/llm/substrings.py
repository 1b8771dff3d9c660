"""Substring dedup: remove every word inside a window of ``window`` words that occurred earlier in the corpus.

1. Slices.  The documents are written once to the shared folder, cut into slices of about ``SLICE_BYTES``; every later step
   is a map over that table.  Of the ``phrase``-word phrases inside a window, the one of least hash (leftmost of equals) is
   its anchor.  Equal windows have equal anchors, so a window can only recur if its anchor does; about one phrase in nine
   is one.  Each slice lists its distinct anchors' words.
2. Confirmed passages.  The lists meet by phrase; a phrase that is in two lists, or twice in one, is confirmed and goes back
   to the slices that have it.
3. Automata.  Each slice has a shard of the confirmed phrases: its own.  The shard is compiled into an Aho-Corasick automaton
   and every document of the slice is streamed through it; its hits are the occurrences.  Windows that hold one are
   candidates, those without can't recur.
4. Owners.  The candidates' digests (128 bits of their words) meet by digest; all but the first place of a digest repeat it.
5. Removal.  The words of repeating windows are cut out of each document.

Exact copies of a text are found by a 128-bit digest; the smallest id stands for them, and the others lose all their words
without being streamed.  Both digests decide: at 10^13 of them a collision has odds below 10^-12.  Lists and candidates
travel packed, one row for each slice and bucket, so no key grows with a passage's copies: a slice sends each phrase and
each window once.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.shared import SharedFile, filesystem, fresh_path, parallelism, pieces, written

WINDOW = 20
PHRASE = 5
#: Text of one slice, which bounds its automaton; one longer document is a slice of its own.
SLICE_BYTES = 4 << 20
#: Phrases, and words, behind one bucket on average where they meet.
PHRASES_PER_BUCKET, WORDS_PER_BUCKET = 50_000, 400_000
#: Buckets that one task takes on average, so that tasks are even.
BUCKETS_PER_TASK = 8
#: Phrases and candidate windows that a worker holds before it sends them.
HELD = 400_000
_LAST = (1 << 63) - 1
#: Bits of a position beside a hash; longer texts take a slower way to the same result.
_PLACE = 24
#: A place is a partition, a segment of that partition, and a word of the segment; a text has a segment for every 2^19 words.
_WORD_BITS, _SEGMENT_BITS = 19, 23


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE, _PIECE + 1), _powers(_INVERSE, _PIECE + 1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as a polynomial, from prefix sums over the text.

    Long texts go piece by piece, cut at white space; a word longer than a piece makes its piece longer.
    """
    out, at = [np.zeros(0, np.uint64)], 0
    every = np.frombuffer(data, np.uint8)
    while at < len(every):
        end = min(len(every), at + _PIECE)
        while end < len(every) and not _SPACE[every[end - 1]]:
            gaps = np.flatnonzero(_SPACE[every[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else min(len(every), at + 2 * (end - at))
        b = every[at:end]
        power, inverse = (_POWERS, _INVERSES) if len(b) <= _PIECE else (_powers(_BASE, len(b) + 1), _powers(_INVERSE, len(b) + 1))
        edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * power[: len(b)], out=sums[1:])
        out.append((sums[ends] - sums[starts]) * inverse[starts])
        at = end
    return out[1] if len(out) == 2 else np.concatenate(out)


def anchors(data: bytes, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hashes by position, anchor position of each window), both empty below ``window`` words."""
    w = word_hashes(data)
    if len(w) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(w) - phrase + 1
    h = np.zeros(n, np.uint64)
    for i in range(phrase):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[i : i + n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h, _least(h, window - phrase + 1)


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the least hash in each stretch of ``span``, the leftmost of equals, by doubling stretches.

    Position takes the place of the low bits, so hashes that differ only there count as equal: leftmost again.
    """
    n = len(h)
    if n >= 1 << _PLACE:
        return np.lib.stride_tricks.sliding_window_view(h >> np.uint64(_PLACE), span).argmin(axis=1) + np.arange(n - span + 1)
    m, have = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(n, dtype=np.uint64), 1
    while have * 2 <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < span:
        m = np.minimum(m[: n - span + 1], m[span - have : span - have + n - span + 1])
    return (m & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def _sorted_distinct(at: np.ndarray) -> np.ndarray:
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


class _Shard:
    """The automaton of some phrases of ``phrase`` words; a text is its words joined, and surrounded, by one space."""

    def __init__(self, phrases: list[bytes], phrase: int):
        self.phrase, self.trie = phrase, ahocorasick.Automaton()
        for p in phrases:
            self.trie.add_word(f" {p.decode('latin-1')} ", 0)
        if phrases:
            self.trie.make_automaton()
        self.empty = not phrases

    def hits(self, line: bytes, gaps: np.ndarray) -> np.ndarray:
        """Word positions at which one of the phrases starts; ``gaps``: where the line has its spaces."""
        if self.empty:
            return np.zeros(0, np.int64)
        ends = np.fromiter((end for end, _ in self.trie.iter(line.decode("latin-1"))), np.int64)
        return np.searchsorted(gaps, ends) - self.phrase


def _line(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined and surrounded by single spaces, and the positions of these spaces."""
    line = b" ".join([b"", *words, b""])
    return line, np.flatnonzero(np.frombuffer(line, np.uint8) == 32)


def _row(names: str, *columns: list) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    """Digests as they are, documents and places, which lie close together, as compressed steps."""
    return keys.tobytes() + _small(np.diff(doc, prepend=0).tobytes() + np.diff(place, prepend=0).tobytes()) + len(doc).to_bytes(8, "little")


def _unpack(data: bytes) -> np.ndarray:
    """(high digest, low digest, document, place) rows."""
    n = int.from_bytes(data[-8:], "little")
    steps = np.frombuffer(_whole(data[16 * n : -8]), "<i8").reshape(2, n).cumsum(axis=1)
    return np.column_stack([np.frombuffer(data, "<i8", 2 * n).reshape(n, 2), steps.T])


_SLICED = "doc_id long, doc long, place long, th binary, n_words long, text string, slice long, phrases binary, n long"


def _sliced(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """The documents, each with its place and slice, and among them each slice's list of anchors (``phrases`` is not null).

    A list has a line for each phrase, headed by ``+`` if it was met more than once; a slice may have several lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        segment = no = size = 0
        once, again, copies = set(), set(), set()

        def listed() -> pa.RecordBatch:
            lines = b"\n".join(sorted((b"+" if p in again else b"-") + p for p in once))
            n = len(once)
            once.clear()
            again.clear()
            return _row(_SLICED, [None], [None], [None], [None], [None], [None], [pid << 20 | no], [lines], [n])

        for b in pieces(batches, 256):
            out: list[list] = [[] for _ in range(7)]
            for id_, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                data = text.encode() if text else b""
                words, th = data.split(), xxhash.xxh3_128_digest(data)
                for column, x in zip(out, (id_, doc, pid << _SEGMENT_BITS + _WORD_BITS | segment << _WORD_BITS, th, len(words), text, pid << 20 | no)):
                    column.append(x)
                segment += (len(words) >> _WORD_BITS) + 1
                size += len(data)
                if len(words) >= window and th not in copies:
                    copies.add(th)
                    line, gaps = _line(words)
                    _, at = anchors(data, window, phrase)
                    at = _sorted_distinct(at)
                    for a, z in zip((gaps[at] + 1).tolist(), gaps[at + phrase].tolist()):
                        p = line[a:z]
                        (again if p in once else once).add(p)
                    if len(once) >= HELD:
                        yield listed()
                if size >= SLICE_BYTES:
                    yield _row(_SLICED, *out, [None] * len(out[0]), [None] * len(out[0]))
                    out = [[] for _ in range(7)]
                    if once:
                        yield listed()
                    copies.clear()
                    no, size = no + 1, 0
            if segment >> _SEGMENT_BITS or no >> 20 or pid >> 63 - _SEGMENT_BITS - _WORD_BITS:
                raise ValueError("too many rows in one partition, or partitions, to number their words")
            if out[0]:
                yield _row(_SLICED, *out, [None] * len(out[0]), [None] * len(out[0]))
        if once:
            yield listed()

    return written(rows.select("doc_id", "doc", "text").mapInArrow(run, _SLICED), "slices", compression="zstd")


def _files(rows: DataFrame, folder: str, name: str, merge: Callable[[list[bytes]], bytes]) -> None:
    """Write ``rows`` (pid, kind, data) to a file for each pid, which maps each kind to its data, merged.

    ``merge`` does not depend on the order of its parts, so a file is the same whichever attempt writes it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, kind, parts, content, done = None, None, [], {}, 0

        def close(whole: bool) -> None:
            nonlocal content, parts, done
            if parts:
                content[kind] = merge(parts)
                parts = []
            if whole and content:
                out = SharedFile(folder, f"{name}-{pid}")
                out.write(pickle.dumps(content))
                out.close()
                content, done = {}, done + 1

        for b in batches:
            for p, k, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (p, k) != (pid, kind):
                    close(p != pid)
                    pid, kind = p, k
                parts.append(data)
        close(True)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["files"])

    dealt = rows.repartition(parallelism(rows), "pid").sortWithinPartitions("pid", "kind")
    dealt.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def _of_file(folder: str, name: str, pid: int) -> dict:
    """What :func:`_files` wrote for ``pid``; empty if there was nothing."""
    at, root = filesystem(folder)
    path = f"{root}/{name}-{pid}"
    if at.get_file_info(path).type == pafs.FileType.NotFound:
        return {}
    with at.open_input_file(path) as f:
        return pickle.loads(f.read())


def _lines(parts: list[bytes]) -> bytes:
    return b"\n".join(sorted({x for p in parts for x in p.split(b"\n")}))


def _places(parts: list[bytes]) -> bytes:
    return np.sort(np.frombuffer(b"".join(parts), "<i8")).tobytes()


def _confirmed(lists: DataFrame, buckets: int) -> DataFrame:
    """(pid, kind, data): the phrases of each slice that recur; kind is the slice."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for slice_, lines in zip(*(b.column(i).to_pylist() for i in range(2))):
                by: dict[int, list[bytes]] = {}
                for x in lines.split(b"\n"):
                    by.setdefault(digest(x[1:]) % buckets, []).append(x)
                yield _row("bucket long, slice long, data binary", list(by), [slice_] * len(by), [_small(b"\n".join(x)) for x in by.values()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def found() -> pa.RecordBatch:
            first, again = {}, set()
            for at, (_, lines) in enumerate(held):
                for x in lines.split(b"\n"):
                    if x[:1] == b"+" or first.setdefault(x[1:], at) != at:
                        again.add(x[1:])
            first.clear()
            out = [(s >> 20, s, b"\n".join(own)) for s, lines in held if (own := [x[1:] for x in lines.split(b"\n") if x[1:] in again])]
            return _row("pid long, kind long, data binary", *([r[i] for r in out] for i in range(3)))

        for b in batches:
            for k, s, lines in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != bucket:
                    if held:
                        yield found()
                    bucket, held = k, []
                held.append((s, _whole(lines)))
        if held:
            yield found()

    dealt = lists.select("slice", "phrases").mapInArrow(deal, "bucket long, slice long, data binary")
    n = max(parallelism(lists), -(-buckets // BUCKETS_PER_TASK))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "pid long, kind long, data binary")


def _candidates(docs: DataFrame, folder: str, window: int, phrase: int, buckets: int) -> DataFrame:
    """(bucket, data): the digests, documents and places of the windows that hold a confirmed phrase, each once a slice;
    and with the digests 0 the places of windows that repeat one of the same slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        count, pid, slice_, phrases, copies, shard = 0, None, None, {}, frozenset(), None
        digest = xxhash.xxh3_128_digest

        def flush() -> pa.RecordBatch:
            nonlocal count
            keys = np.frombuffer(b"".join(h[0] for h in held), ">u8").astype(np.uint64).reshape(-1, 2)
            doc = np.repeat(np.array([h[1] for h in held], np.int64), [len(h[2]) for h in held])
            place = np.concatenate([h[2] for h in held])
            held.clear()
            count = 0
            o = np.lexsort((place, doc, keys[:, 1], keys[:, 0]))
            keys, doc, place = keys[o], doc[o], place[o]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
            again = np.sort(place[~new])
            keys, doc, place = keys[new], doc[new], place[new]
            dealt = (keys[:, 0] % np.uint64(buckets)).astype(np.int64)
            o = np.lexsort((place, dealt))
            keys, doc, place, dealt = keys[o].view(np.int64), doc[o], place[o], dealt[o]
            edge = [*np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1]))).tolist(), len(dealt)]
            names, data = dealt[edge[:-1]].tolist(), [_pack(keys[a:z], doc[a:z], place[a:z]) for a, z in zip(edge, edge[1:])]
            if len(again):
                names.append(int(again[0]) % buckets)
                data.append(_pack(np.zeros((len(again), 2), np.int64), np.zeros(len(again), np.int64), again))
            return _row("bucket long, data binary", names, data)

        for b in pieces(batches, 256):
            for place, doc, own, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if own != slice_:
                    if own >> 20 != pid:
                        pid = own >> 20
                        phrases = _of_file(folder, "phrases", pid)
                        copies = frozenset(np.frombuffer(_of_file(folder, "copies", pid).get(0, b""), "<i8").tolist())
                    slice_ = own
                    shard = _Shard(phrases[own].split(b"\n") if own in phrases else [], phrase)
                words = text.encode().split() if text and place not in copies and not shard.empty else []
                if len(words) < window:
                    continue
                line, gaps = _line(words)
                hits = shard.hits(line, gaps)
                if not len(hits):
                    continue
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, np.maximum(0, hits + phrase - window), 1)
                np.add.at(cover, hits + 1, -1)
                starts = np.flatnonzero(cover.cumsum()[: len(words) - window + 1] > 0)
                for i in range(0, len(starts), HELD):
                    some = starts[i : i + HELD]
                    keys = b"".join([digest(line[a:z]) for a, z in zip((gaps[some] + 1).tolist(), gaps[some + window].tolist())])
                    held.append([keys, doc, place + some])
                    count += len(some)
                    if count >= HELD:
                        yield flush()
        if held:
            yield flush()

    return docs.select("place", "doc", "slice", "text").mapInArrow(run, "bucket long, data binary")


def _later(candidates: DataFrame, n: int) -> DataFrame:
    """(pid, kind, data): places of the windows that repeat another of smaller document, or earlier in the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def found() -> pa.RecordBatch:
            rows = np.concatenate([_unpack(h) for h in held])
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
            again = np.concatenate(([False], (rows[1:, :2] == rows[:-1, :2]).all(axis=1))) | (rows[:, :3] == 0).all(axis=1)
            place = np.sort(rows[again, 3])
            pid = place >> _SEGMENT_BITS + _WORD_BITS
            edge = [*np.flatnonzero(np.concatenate(([True], pid[1:] != pid[:-1]))).tolist(), len(place)] if len(place) else [0]
            return _row("pid long, kind long, data binary", pid[edge[:-1]].tolist(), [0] * (len(edge) - 1), [place[a:z].tobytes() for a, z in zip(edge, edge[1:])])

        for b in batches:
            for k, data in zip(*(b.column(i).to_pylist() for i in range(2))):
                if k != bucket:
                    if held:
                        yield found()
                    bucket, held = k, []
                held.append(data)
        if held:
            yield found()

    return candidates.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "pid long, kind long, data binary")


def _cut(docs: DataFrame, folder: str, window: int, texts: bool) -> DataFrame:
    """(doc_id, doc, th, n_words, n_removed, kept_sha256, kept) of each document, but for repeated rows."""
    schema = "doc_id long, doc long, th binary, n_words long, n_removed long, kept_sha256 string, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, gone, copies = None, np.zeros(0, np.int64), {}
        for b in pieces(batches, 256):
            out: list[list] = [[] for _ in range(7)]
            for id_, doc, th, place, n, text in zip(*(b.column(i).to_pylist() for i in range(6))):
                if place >> _SEGMENT_BITS + _WORD_BITS != pid:
                    pid = place >> _SEGMENT_BITS + _WORD_BITS
                    gone = np.frombuffer(_of_file(folder, "later", pid).get(0, b""), "<i8")
                    marks = _of_file(folder, "copies", pid)
                    copies = {p: k for k in (1, 2) for p in np.frombuffer(marks.get(k, b""), "<i8").tolist()}
                kind, removed = copies.get(place), 0
                if kind == 2:
                    continue  # a repeated row: the first one's result
                words = text.encode().split() if text else []
                if kind == 1 and n >= window:
                    words, removed = [], n
                elif len(starts := gone[slice(*np.searchsorted(gone, (place, place + n)))] - place):
                    cover = np.zeros(n + 1, np.int64)
                    cover[starts] += 1
                    np.add.at(cover, starts + window, -1)
                    stays = cover.cumsum()[:-1] == 0
                    removed = n - int(stays.sum())
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                line = b" ".join(words)
                for column, x in zip(out, (id_, doc, th, n, removed, hashlib.sha256(line).hexdigest(), line.decode() if texts else None)):
                    column.append(x)
            yield _row(schema, *out)

    return docs.select("doc_id", "doc", "th", "place", "n_words", "text").mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text", texts: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and ``kept`` itself if ``texts``, for each row.

    Defined cases: a null text has no words; texts of fewer than ``window`` words lose none; a null id comes after all
    others; rows equal in id and text are one document and get the same result; rows with one id and different texts are
    separate, in the order in which they are read; an empty table gives no rows; other columns are ignored.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase has at least one word, and no more than a window")
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(_LAST)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    folder = fresh_path(docs.sparkSession, "phrases")
    table = _sliced(rows, window, phrase)
    sliced, lists = table.filter("phrases is null"), table.filter("phrases is not null")
    words, phrases = table.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    light = sliced.filter("n_words > 0").select("doc", "place", "th")
    firsts = written(light.groupBy("th").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "firsts")
    later = light.join(firsts, "th").filter(F.col("place") != F.col("first.place"))
    repeat = F.when(F.col("doc") == F.col("first.doc"), 2).otherwise(1)
    # of a later text's repeated rows all are copies; repeats are rows of the first one's id
    marks = later.select((F.shiftright("place", _SEGMENT_BITS + _WORD_BITS)).alias("pid"), repeat.cast("long").alias("kind"), "place")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pid, kind, place = (np.asarray(b.column(i)) for i in range(3))
            keys = [(int(p), k) for p in np.unique(pid) for k in (0, 1, 2)]
            data = [place[(pid == p) & ((kind == k) | (k == 0))] for p, k in keys]
            yield _row("pid long, kind long, data binary", [p for p, _ in keys], [k for _, k in keys], [d.tobytes() for d in data])

    _files(marks.mapInArrow(packed, "pid long, kind long, data binary"), folder, "copies", _places)
    _files(_confirmed(lists, max(1, -(-phrases // PHRASES_PER_BUCKET))), folder, "phrases", _lines)
    buckets = max(1, -(-words // WORDS_PER_BUCKET))
    found = _candidates(sliced, folder, window, phrase, buckets)
    _files(_later(found, max(parallelism(docs), -(-buckets // BUCKETS_PER_TASK))), folder, "later", _places)
    cut = written(_cut(sliced, folder, window, texts), "cut")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])]
    repeats = later.filter(repeat == 2).select("doc", "th")
    once = cut.select("doc", "th", *columns).join(repeats.select("doc", "th").distinct(), ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"])
    return cut.select(*columns).union(repeats.join(once, ["doc", "th"]).select(*columns))
