"""The change feed as a stream: events -> last of each module -> decision -> one idempotent apply a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestrata.operators.ingest import coalesce, decide


def read_feed(spark: SparkSession, path: str, schema: str | StructType, per_trigger: int = 100) -> DataFrame:
    """Event files (module, kind, contentHash, seq, …) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def apply_feed(feed: DataFrame, files: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, seq: str = "seq", available_now: bool = True, lake=None) -> StreamingQuery:
    """Each micro-batch is coalesced, decided against the files held now, and applied; batches are serial.

    A batch may come again after a failure; with ``lake``, whose ``meta`` then names the last batch of this feed that was
    applied, it is passed over, else ``apply(decisions, batch_id)`` must do nothing new for a batch id it has seen.
    """

    name = f"feed {checkpoint}"

    def one(batch: DataFrame, batch_id: int) -> None:
        if lake is not None and int((lake.meta(name) or {name: -1})[name]) >= batch_id:
            return
        decided = decide(coalesce(batch, seq), files()).filter("action <> 'ignore'")
        decided.persist()
        try:
            apply(decided, batch_id)
            if lake is not None:
                lake.put_meta(**{name: str(batch_id)})
        finally:
            decided.unpersist()

    out = feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def counted(feed: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Demand by key as a stream; events more than ``late`` behind are dropped from the state."""
    return feed.withWatermark(at, late).groupBy(*keys).agg(F.count("*").alias("askCount"), F.max(at).alias("lastAsked"))


def windowed(feed: DataFrame, at: str, width: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Event-time windows with a watermark."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return feed.withWatermark(at, late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"))


def sessions(feed: DataFrame, at: str, gap: str, keys: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """R2: bursts of events as session windows."""
    return feed.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("burst"), *keys).agg(F.count("*").alias("n"))


def once(feed: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Events without the repeats that a feed may deliver again."""
    return feed.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
