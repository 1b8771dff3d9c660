"""Files as rows: listings, guarded reads, project models.  Paths in results are canonical modules of the root."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions.ids import content_hash, normalize_module
from lodestrata.functions.search import glob_pattern
from lodestrata.operators.ingest import extension_of, guarded
from lodestrata.sources.extract.base import CLAIMS

# Directories that a walk never enters, and the name of a root's scope file. Fixed values.
EXCLUDED = frozenset("node_modules .git .hg .svn dist build out target coverage .venv venv __pycache__".split())
SCOPE_FILE = "facts.json"
INCLUDE_DEPTH = 12


def tracked(root: str) -> list[str] | None:
    """What version control lists, ignored files left out; None where there is no repository."""
    if not os.path.exists(os.path.join(root, ".git")):
        return None
    done = subprocess.run(["git", "ls-files", "--cached", "--others", "--exclude-standard", "-z"], cwd=root, capture_output=True, check=False)
    return sorted({x for x in done.stdout.decode("utf-8", "replace").split("\0") if x}) if done.returncode == 0 else None


def walk(root: str, extensions: set[str] | None = None, excluded: frozenset[str] = EXCLUDED) -> list[str]:
    """Files under the root by suffix, sorted; unreadable directories are passed over."""
    out = []
    for at, dirs, names in os.walk(root, onerror=lambda e: None):
        dirs[:] = sorted(d for d in dirs if d not in excluded)
        rel = os.path.relpath(at, root)
        for n in names:
            if extensions is None or os.path.splitext(n)[1].lower() in extensions:
                out.append(n if rel == "." else f"{rel}/{n}".replace(os.sep, "/"))
    return sorted(out)


def included(root: str, globs: list[str]) -> list[str]:
    """Files that an include glob names, at most ``INCLUDE_DEPTH`` directories deep."""
    import re

    patterns = [re.compile(glob_pattern(g)) for g in globs]
    return [m for m in walk(root, None, frozenset({".git"})) if m.count("/") <= INCLUDE_DEPTH and any(p.match(m) for p in patterns)]


def generated(root: str, modules: list[str]) -> set[str]:
    """Modules that version control marks as generated."""
    if not modules or not os.path.exists(os.path.join(root, ".git")):
        return set()
    done = subprocess.run(["git", "check-attr", "-z", "--stdin", "linguist-generated"], cwd=root, input="\0".join(modules).encode(), capture_output=True, check=False)
    parts = done.stdout.decode("utf-8", "replace").split("\0")
    return {parts[i] for i in range(0, len(parts) - 2, 3) if parts[i + 2] not in ("unspecified", "unset")}


def scope_of(root: str) -> dict[str, list[str]]:
    """Include, exclude, deny and bundles of the root's scope file, each a list of globs."""
    path = os.path.join(root, SCOPE_FILE)
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except (OSError, ValueError):
        held = {}
    return {k: [g for g in held.get(k, []) if isinstance(g, str)] for k in ("include", "exclude", "deny", "bundles")}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """S3: (module, provider, known) of a root's files that an extractor owns."""
    names = tracked(root)
    every = names if names is not None else walk(root)
    rows = [(m,) for m in sorted({normalize_module(m) for m in every})]
    files = spark.createDataFrame(rows, "module string")
    claims = F.create_map(*[F.lit(x) for kv in CLAIMS.items() for x in kv])
    return files.withColumn("provider", claims[extension_of("module")]).withColumn("known", F.lit(names is not None)).filter("provider is not null")


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(module, state, text, contentHash, length) of the files under a root, in any store Spark reads.

    Files over 4 MiB and files with a NUL in their first 8 KiB have no text.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    head = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    at = F.instr("path", head)
    module = F.substring(F.col("path"), at + len(head), F.length("path"))
    base = raw.select("path", "length", "content")
    return guarded(base.filter(at > 0).withColumn("module", module)).select("module", "state", "text", content_hash("text").alias("contentHash"), "length")
