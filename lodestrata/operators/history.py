"""Change history: churn, co-change, mentions.  Commits are (hash, at, message), changes (hash, path, added, deleted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.functions.search import word_pattern
from lodestrata.runtime import tasks

WIDTH, RECENT, MENTIONS, SHORTEST_NAME = 40, 20, 20, 3


def narrow(changes: DataFrame, width: int = WIDTH) -> DataFrame:
    """OP15: changes of commits that touch at most ``width`` files, cut before any pairing."""
    ok = changes.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") <= width).select("hash")
    return changes.join(ok, "hash", "left_semi")


def co_changed(changes: DataFrame, module: str | DataFrame, width: int = WIDTH) -> DataFrame:
    """(module, together, outOf): files that changed in the target's commits, most often first.

    Commits with the target are found first, and only their files are read for partners: no pairing of all files.
    """
    distinct = narrow(changes.select("hash", "path").distinct(), width)
    target = distinct.filter(F.col("path") == module) if isinstance(module, str) else distinct.join(module.select("path").distinct(), "path", "left_semi")
    hit = target.select("hash", F.col("path").alias("_target"))
    pairs = distinct.join(hit, "hash").filter("path <> _target")
    return pairs.groupBy(F.col("path").alias("module")).agg(F.count("*").alias("together")).crossJoin(F.broadcast(target.agg(F.count("*").alias("outOf"))))


def skipped_wide(changes: DataFrame, width: int = WIDTH) -> DataFrame:
    return changes.groupBy("hash").count().filter(F.col("count") > width).agg(F.count("*").alias("skippedWideCommits"))


def file_history(changes: DataFrame, commits: DataFrame, recent: int = RECENT) -> DataFrame:
    """A12 for every file: commits, lines, first and last time, the newest commits, and whether history was cut short.

    The newest are ranked under a limit, which each task applies before the shuffle: a file that every commit touches sends
    ``recent`` rows a task.  Both sides are dealt out by commit into a number of tasks that is not lowered again, so that a
    task sorts and counts its share alone; a commit is then in one task, which counts its files once and sends sums.
    """
    n = tasks(changes.sparkSession)
    subjects = commits.select("hash", "at", F.substring_index("message", "\n", 1).alias("subject")).repartition(n, "hash")
    joined = changes.repartition(n, "hash").join(subjects.hint("merge"), "hash")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"), F.desc("hash")))
    newest = joined.withColumn("_r", rank).filter(F.col("_r") <= recent).groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "hash", "at", "added", "deleted", "subject"))), lambda x: F.struct(x["hash"], x["at"], x["added"], x["deleted"], x["subject"])).alias("recent")
    )
    oldest = commits.orderBy("at", "hash").limit(1).select("hash")
    cut = changes.join(F.broadcast(oldest), "hash", "left_semi").select("path").distinct().withColumn("truncated", F.lit(True))
    once = joined.groupBy("hash", "path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.min("at").alias("first"), F.max("at").alias("last"))
    sums = once.groupBy("path").agg(F.count("hash").alias("commits"), F.sum("added").alias("linesAdded"), F.sum("deleted").alias("linesDeleted"), F.min("first").alias("firstSeen"), F.max("last").alias("lastTouched"))
    # a left join, so that Spark leaves the newest out where nobody reads them
    return sums.join(newest, "path", "left").join(cut, "path", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def mentioning(commits: DataFrame, name: str, limit: int | None = MENTIONS, text: str = "message") -> DataFrame:
    """Commits whose message has ``name`` as a word, newest first; names under three characters find none."""
    if len(name) < SHORTEST_NAME:
        return commits.limit(0)
    found = commits.filter(F.col(text).rlike(word_pattern(name)))
    return found.orderBy(F.desc("at"), "hash").limit(limit) if limit else found
