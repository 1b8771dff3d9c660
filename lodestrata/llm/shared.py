"""What the operators of this subpackage have in common: shared folders, written tables, word splitting."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where the session names no shared folder (tests, one machine).
LOCAL_SHARED = f"/tmp/checkpoints/lodestrata-{os.getuid()}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one where that is unset on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"file://{LOCAL_SHARED}").rstrip("/")


_MADE: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lodestrata-{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the folders that operators make inside, once the block ends, but for those of the tables put in the list.

    Results must be written by then: ``with scratch(spark) as keep: keep.append(written(operator(df), "result"))``.
    """
    first, keep = len(_MADE), []
    try:
        yield keep
    finally:
        stays = {getattr(df, "_lodestrata_path", None) for df in keep}
        for path in [p for p in _MADE[first:] if p not in stays]:
            _delete(spark, path)
        _MADE[first:] = [p for p in _MADE[first:] if p in stays]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, read again.

    A lost executor then costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    if path := getattr(df, "_lodestrata_path", None):
        _delete(df.sparkSession, path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class SharedFile:
    """A file of the shared folder that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root)
        self.at, self.tmp, self.size = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}", 0
        self.f = self.fs.open_output_stream(self.tmp)

    def write(self, data: bytes) -> tuple[int, int]:
        """(offset, length) of ``data`` in the file."""
        self.f.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)

    def close(self) -> None:
        self.f.close()
        self.fs.move(self.tmp, self.at)


def read_shared(folder: str, name: str) -> bytes:
    at, root = filesystem(folder)
    with at.open_input_file(f"{root}/{name}") as f:
        return f.read()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker's Python copies of long texts stay small whatever the batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def with_text_columns(docs: DataFrame, text_col: str, fn: Callable[[list], list[pa.Array]], added: str, keep: list[str] | None = None, rows: int = 512) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and those of the DDL ``added``, made by ``fn`` from the texts.

    A column of ``docs`` that is also in ``added`` is replaced.  A worker holds ``rows`` texts at a time.
    """
    new = T.StructType.fromDDL(added)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    base = docs.select(*kept, F.col(text_col).cast("string").alias(unused(docs, "_text")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, rows):
            made = fn(b.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *made], names=[*kept, *new.names])

    out = base.mapInArrow(run, T.StructType([*base.schema.fields[: len(kept)], *new.fields]))
    order = [c for c in (docs.columns if keep is None else keep) if c in out.columns]
    return out.select(*order, *[c for c in new.names if c not in order])


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each stem."""
    held, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> F.Column:
    """xxhash64 of a whole row, so that rows that differ in any column can be told apart; nulls count."""
    cols = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*(x for c in cols for x in (c, c.isNull())))


def parallelism(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def word_count(text) -> F.Column:
    """Words of a text column, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
