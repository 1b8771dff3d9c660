"""The fact lake: Parquet tables in versioned snapshots behind a pointer.

``root/data/<writer>/<table>`` holds what one writer wrote, ``root/current/v=<n>`` names the manifest of a published
snapshot; the highest counts.  Writers add files of their own and then publish by creating the next marker, which only one
of them can: the others get :class:`Conflict` and start over from the new snapshot (``retried``).  Readers keep the version
they opened, so nothing is changed under them.  Fact tables are laid out by ``bucket = pmod(xxhash64(module), buckets)``, so replacing modules rewrites only their
buckets: the others are linked into the new snapshot by path, not copied.
"""

from __future__ import annotations

import functools
import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors.exceptions.captured import CapturedException
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.schema import FACT_TABLES, KEYS, KNOWLEDGE_TABLES, TABLES, schema

BUCKETS = 64
#: Times that a write starts over, and tables that it writes at once.
ATTEMPTS, WRITERS = 5, 4


class Conflict(RuntimeError):
    """Another writer has published since this one read."""


def retried(write):
    """A write that starts over from the newest snapshot when another writer was first."""

    @functools.wraps(write)
    def run(*args, **kw):
        for left in reversed(range(ATTEMPTS)):
            try:
                return write(*args, **kw)
            except Conflict:
                if not left:
                    raise

    return run


class FactLake:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._views: dict[tuple[int, str], DataFrame] = {}
        self._manifests: dict[int, dict] = {}

    # ---- files ---------------------------------------------------------------------------------------------------------

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _read_text(self, path: str) -> str | None:
        at, fs = self._path(path)
        return "\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect()) if fs.exists(at) else None

    def _write_text(self, path: str, text: str) -> None:
        at, fs = self._path(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    # ---- versions ------------------------------------------------------------------------------------------------------

    def _markers(self) -> dict[int, str]:
        at, fs = self._path(f"{self.root}/current")
        if not fs.exists(at):
            return {}
        found = [s for s in fs.listStatus(at) if s.getPath().getName().startswith("v=")]
        return {int(s.getPath().getName()[2:]): s.getPath().toString() if s.getLen() else "" for s in found}

    def version(self) -> int:
        """The published snapshot, 0 for none.  A marker that is still empty is not published."""
        return max((v for v, path in self._markers().items() if path), default=0)

    def _manifest(self, version: int) -> dict[str, dict[str, str]]:
        if not version:
            return {}
        if version not in self._manifests:
            self._manifests[version] = json.loads(self._read_text(self._read_text(f"{self.root}/current/v={version}")))
        return self._manifests[version]

    def _publish(self, old: int, manifest: dict) -> int:
        """The version after ``old``, unless somebody else has made one."""
        new, at = old + 1, f"{self.root}/manifests/{uuid.uuid4().hex}.json"
        if self.version() != old:
            raise Conflict(f"version {old} is no longer the newest")
        new = max([old, *self._markers()]) + 1  # a marker that its writer left empty is passed over
        self._write_text(at, json.dumps(manifest, sort_keys=True))
        marker, fs = self._path(f"{self.root}/current/v={new}")
        try:
            out = fs.create(marker, False)  # the one atomic step: fails where the marker exists
        except (Py4JJavaError, CapturedException) as e:
            raise Conflict(f"version {new} was published meanwhile") from e
        out.write(bytearray(at.encode()))
        out.close()
        return new

    def _data(self) -> str:
        """A folder of this write's own."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    # ---- reads ---------------------------------------------------------------------------------------------------------

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of a snapshot (the published one by default), as an empty one where nothing was written yet."""
        if table not in TABLES:
            raise KeyError(table)
        v = self.version() if version is None else version
        if (v, table) not in self._views:
            paths = sorted(set(self._manifest(v).get(table, {}).values()))
            want = schema(table)
            self._views[v, table] = self.spark.read.schema(want).parquet(*paths) if paths else self.spark.createDataFrame([], want)
        return self._views[v, table]

    # ---- writes --------------------------------------------------------------------------------------------------------

    def _conform(self, table: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])

    def bucket(self, column: str = "module"):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    @retried
    def replace_modules(self, tables: dict[str, DataFrame], modules: DataFrame) -> int:
        """K1, K2, K3: in one new snapshot, the modules' old rows go and ``tables``' rows take their place.

        ``modules`` (module) names everything that is replaced, also what has no new rows (forgetting).  Only buckets that
        hold such a module are rewritten.
        """
        return self._replaced(tables, modules)

    def _replaced(self, tables: dict[str, DataFrame], modules: DataFrame, also: dict[str, DataFrame] | None = None) -> int:
        """``also``: tables laid out by module that get rows for other modules in the same snapshot."""
        old, data = self.version(), self._data()
        manifest = {t: dict(p) for t, p in self._manifest(old).items()}
        every = modules.select("module")
        for rows in (also or {}).values():
            every = every.union(rows.select("module"))
        touched = sorted(r[0] for r in every.distinct().select(self.bucket()).distinct().collect())  # at most ``buckets`` numbers

        def write(table: str) -> dict[str, str] | None:
            """Rewrite the touched buckets of one table: paths by bucket."""
            held, fresh, more = self.read(table, old), tables.get(table), (also or {}).get(table)
            if fresh is None and more is None and not manifest.get(table):
                return None
            gone = modules.select("module") if more is None else modules.select("module").union(more.select("module"))
            rows = held.withColumn("_b", self.bucket()).filter(F.col("_b").isin(touched)).drop("_b").join(gone.distinct(), "module", "left_anti")
            for new in (fresh, more):
                rows = rows if new is None else rows.unionByName(self._conform(table, new))
            rows = self._conform(table, rows).withColumn("bucket", self.bucket())
            out = f"{data}/{table}"
            order = ["module"] + ["startLine"] * ("startLine" in held.columns)
            rows.repartition("bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(out)
            at, fs = self._path(out)
            made = {s.getPath().getName() for s in fs.listStatus(at)}
            return {str(b): f"{out}/bucket={b}" for b in touched if f"bucket={b}" in made}

        names = [*FACT_TABLES, "files", "parse_failures"] if touched else []
        with ThreadPoolExecutor(WRITERS) as pool:  # the tables are independent jobs
            for table, parts in zip(names, pool.map(write, names)):
                if parts is not None:
                    own = manifest.setdefault(table, {})
                    for b in touched:
                        own.pop(str(b), None)
                    own.update(parts)
        return self._publish(old, manifest)

    def forget_modules(self, modules: DataFrame) -> int:
        return self.replace_modules({}, modules)

    def _with_table(self, table: str, rows) -> int:
        """A new snapshot with ``rows(held)`` for a knowledge or meta table."""
        old = self.version()
        out = f"{self._data()}/{table}"
        self._conform(table, rows(self.read(table, old))).write.parquet(out)
        return self._publish(old, self._manifest(old) | {table: {"all": out}})

    @retried
    def write_table(self, table: str, df: DataFrame) -> int:
        """A whole knowledge or meta table in a new snapshot."""
        return self._with_table(table, lambda held: df)

    @retried
    def upsert(self, table: str, rows: DataFrame) -> int:
        """K3: last write wins by the table's key."""
        rows, key = self._conform(table, rows).dropDuplicates(KEYS[table]), KEYS[table]
        return self._with_table(table, lambda held: held.join(rows.select(*key), key, "left_anti").unionByName(rows))

    @retried
    def insert_absent(self, table: str, rows: DataFrame) -> int:
        """K5: only keys that are not there yet."""
        rows, key = self._conform(table, rows).dropDuplicates(KEYS[table]), KEYS[table]
        return self._with_table(table, lambda held: held.unionByName(rows.join(held.select(*key), key, "left_anti")))

    @retried
    def update_where_null(self, table: str, rows: DataFrame, column: str) -> int:
        """K7: set ``column`` on existing keys that lack it; other keys are ignored."""
        key = KEYS[table]
        new = rows.select(*key, F.col(column).alias("_new")).dropDuplicates(key)
        return self._with_table(table, lambda held: held.join(new, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new"))

    def set_doubt(self, answers: DataFrame) -> tuple[int, int]:
        """K7: doubt (symbolId, question, doubtId, doubtReason, doubtAt, doubtBy) on answers that exist; (version, answers affected)."""
        return self._update("answers", answers, ["doubtId", "doubtReason", "doubtAt", "doubtBy"])

    def complete_step(self, steps: DataFrame, phase: str = "finalized") -> tuple[int, int]:
        """K7: the phase of steps (transactionId, stepNo) that exist and are not there yet; (version, steps affected)."""
        return self._update("refactor_steps", steps.select("transactionId", "stepNo", F.lit(phase).alias("phase")), ["phase"], F.lit(phase) != F.col("phase"))

    def _update(self, table: str, rows: DataFrame, columns: list[str], only=None) -> tuple[int, int]:
        key = KEYS[table]
        new = rows.select(*key, F.struct(*columns).alias("_new")).dropDuplicates(key)
        hit = self.read(table).filter(F.lit(True) if only is None else only).join(new, key, "left_semi").count()
        take = F.col("_new").isNotNull() & (F.lit(True) if only is None else only)

        @retried
        def write() -> int:
            return self._with_table(table, lambda held: held.join(new, key, "left").select(*key, *(F.when(take, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in held.columns if c not in key)))

        return write(), hit

    def put_meta(self, **values: str) -> int:
        """Small facts about a scan, by name."""
        return self.upsert("meta", self.spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string"))

    def meta(self, *names: str) -> dict[str, str] | None:
        """The values of all ``names``, or None if one is missing."""
        held = {r["key"]: r["value"] for r in self.read("meta").filter(F.col("key").isin(*names)).collect()}
        return held if set(names) <= set(held) else None

    @retried
    def rebuild(self) -> int:
        """K9: facts go, what people and agents wrote stays."""
        old = self.version()
        return self._publish(old, {t: p for t, p in self._manifest(old).items() if t in KNOWLEDGE_TABLES})

    def drop(self) -> None:
        """K12."""
        at, fs = self._path(self.root)
        fs.delete(at, True)

    # ---- ingest --------------------------------------------------------------------------------------------------------

    def ingest(self, files: DataFrame, at: int, depth: str = "full") -> int:
        """Index files (module, text, contentHash[, content]): skip what is current, extract, admit, replace.

        A file that doesn't parse, or whose facts are refused, keeps its old facts and gets a row in ``parse_failures``.
        """
        from lodestrata.operators.ingest import admit, needs_indexing
        from lodestrata.sources.extract import explode_facts, extract

        asked = needs_indexing(files.withColumn("depth", F.lit(depth)), self.read("files"))
        out = f"{self.root}/staging/{uuid.uuid4().hex}"
        extract(asked, depth).write.parquet(out)  # parsed once, read by every table below
        facts = self.spark.read.parquet(out)
        good, refused = admit(facts.filter("error is null"))
        tables = explode_facts(good.unionByName(facts.filter("error is not null")))
        failures = tables.pop("parse_failures").unionByName(refused)
        content = F.when(F.col("provider").isin("json", "yaml"), "data").when(F.col("provider").isin("markdown", "html"), "document").otherwise("code")
        done = good.select("module", content.alias("content"))
        tables["files"] = asked.drop("content").join(done, "module").withColumn("indexedAt", F.lit(at))
        version = self._ingested(tables, done, failures.withColumn("failedAt", F.lit(at)))
        path, fs = self._path(out)
        fs.delete(path, True)
        return version

    @retried
    def _ingested(self, tables: dict[str, DataFrame], done: DataFrame, failures: DataFrame) -> int:
        """Facts and failures in one snapshot."""
        return self._replaced(tables, done, {"parse_failures": failures})

    def pending(self, files: DataFrame, depth: str = "full") -> DataFrame:
        """Files that are held at less than ``depth``, or not at all."""
        from lodestrata.operators.ingest import needs_indexing

        return needs_indexing(files.withColumn("depth", F.lit(depth)), self.read("files"))

    def upgrade(self, files: DataFrame, at: int, modules: DataFrame | None = None) -> int:
        """The second phase after an outline: full facts of ``modules`` (all that are pending by default).

        Ask for a module and its neighbourhood (``graph.neighbourhood``) before a graph query; what is full already is skipped.
        """
        asked = files if modules is None else files.join(modules.select("module").distinct(), "module", "left_semi")
        return self.ingest(asked, at, "full")


class ResultCache:
    """Results by query and snapshot: a new snapshot makes all old ones useless; the oldest go beyond ``entries``."""

    def __init__(self, lake: FactLake, entries: int = 500):
        self.lake, self.entries, self.version, self.held = lake, entries, -1, {}

    def get(self, key, make) -> DataFrame:
        if (v := self.lake.version()) != self.version:
            self.clear()
            self.version = v
        if key not in self.held:
            if len(self.held) >= self.entries:
                self.held.pop(next(iter(self.held))).unpersist()
            self.held[key] = make().cache()
        return self.held[key]

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held = {}


def inventory(spark: SparkSession, folder: str) -> list[dict]:
    """The lakes right below a folder, with their published version and size in bytes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = []
    for s in fs.listStatus(at) if fs.exists(at) else []:
        root = s.getPath().toString()
        version = FactLake(spark, root).version() if s.isDirectory() else 0
        if version:
            out.append({"root": root, "version": version, "bytes": fs.getContentSummary(s.getPath()).getLength()})
    return sorted(out, key=lambda x: x["root"])
