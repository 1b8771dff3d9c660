"""Version control history as (commits, changes)."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

DEPTH = 1000
_END = "\x01"


def log_text(root: str, depth: int = DEPTH) -> str:
    """The raw log, newest first; empty where there is no repository."""
    if not os.path.exists(os.path.join(root, ".git")):
        return ""
    wanted = ["git", "log", "--no-merges", "--no-renames", "--numstat", f"--format=%x00%H %at%n%B{_END}", f"-n{depth}"]
    return subprocess.run(wanted, cwd=root, capture_output=True, check=False).stdout.decode("utf-8", "replace")


def parse_log(blocks: DataFrame, column: str = "block") -> tuple[DataFrame, DataFrame]:
    """Log blocks, one a row -> commits (hash, at, message) and changes (hash, path, added, deleted), all in the JVM.

    A binary file's dashes count as 0.
    """
    head = F.element_at(F.split(column, _END, 2), 1)
    tail = F.element_at(F.split(column, _END, 2), 2)
    first = F.substring_index(head, "\n", 1)
    rows = blocks.filter(F.trim(F.regexp_replace(column, r"\s", "")) != "").select(
        F.split(first, " ")[0].alias("hash"), F.split(first, " ")[1].cast("long").alias("at"),
        F.regexp_replace(F.regexp_replace(head, r"\A[^\n]*\n?", ""), r"\A\s+|\s+\z", "").alias("message"),
        tail.alias("_tail"),
    )
    commits = rows.select("hash", "at", "message")
    lines = rows.select("hash", F.explode(F.split(F.coalesce("_tail", F.lit("")), "\n")).alias("l")).filter(F.contains("l", F.lit("\t")))
    part = F.split("l", "\t", 3)
    count = lambda i: F.coalesce(F.expr(f"try_cast(split(l, '\t', 3)[{i}] as bigint)"), F.lit(0))
    changes = lines.select("hash", part[2].alias("path"), count(0).alias("added"), count(1).alias("deleted")).filter("path is not null and path <> ''")
    return commits, changes


def history(spark: SparkSession, root: str, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Commits and changes of a repository on the driver's disk; at most ``depth`` commits."""
    blocks = [(b,) for b in log_text(root, depth).split("\0") if b.strip()]
    return parse_log(spark.createDataFrame(blocks, "block string"))
