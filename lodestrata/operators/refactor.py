"""Planning renames and moves, and the journal that can undo them."""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.functions.coordinates import Coordinates, Edit, apply_edits
from lodestrata.operators.graph import kept
from lodestrata.operators.read import BIN, bins
from lodestrata.schema import schema


def increases(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more often than before."""
    was, now = before.groupBy(*keys).agg(F.count("*").alias("was")), after.groupBy(*keys).agg(F.count("*").alias("now"))
    return now.join(was, keys, "left").withColumn("was", F.coalesce("was", F.lit(0))).filter("now > was")


def sites_by_module(*places: DataFrame) -> DataFrame:
    """Declaration, reference and import sites together, counted by module."""
    out = places[0].select("module")
    for p in places[1:]:
        out = out.union(p.select("module"))
    return out.groupBy("module").agg(F.count("*").alias("sites"))


def rename_sites(symbols: DataFrame, refs: DataFrame, imports: DataFrame, target: str, name: str) -> DataFrame:
    """(module, place, 4 x span) of everything that spells the symbol."""
    span = ["startLine", "startChar", "endLine", "endChar"]
    own = symbols.filter(F.col("symbolId") == target).select(
        "module", F.lit("declaration").alias("place"), F.col("nameLine").alias("startLine"), F.col("nameChar").alias("startChar"), F.col("nameEndLine").alias("endLine"), F.col("nameEndChar").alias("endChar")
    )
    used = refs.filter(F.col("targetId") == target).select("module", F.lit("reference").alias("place"), *span)
    modules = used.select("module").distinct()
    taken = imports.filter((F.col("name") == name) & F.col("startLine").isNotNull()).join(modules, "module", "left_semi").select("module", F.lit("import").alias("place"), *span)
    return own.union(used).union(taken).distinct()


def collisions(symbols: DataFrame) -> DataFrame:
    """Names that a module declares more than once."""
    return symbols.groupBy("module", "name").agg(F.count_distinct("symbolId").alias("n")).filter("n > 1").select("module", "name")


def would_collide(symbols: DataFrame, touched: DataFrame, new_name: str) -> DataFrame:
    """Declarations of the new name in the touched modules."""
    return symbols.filter(F.col("name") == new_name).join(touched.select("module").distinct(), "module", "left_semi")


def refs_inside(refs: DataFrame, body: DataFrame) -> DataFrame:
    """References whose start lies in the body's range, end left out: an interval join inside a bin of a module."""
    at = F.struct("startLine", "startChar")
    span = body.select("module", F.explode(bins("startLine", "endLine")).alias("_bin"), F.struct("startLine", "startChar").alias("_from"), F.struct("endLine", "endChar").alias("_to"))
    near = refs.withColumn("_bin", F.floor(F.col("startLine") / BIN)).join(span, ["module", "_bin"])
    return near.filter((F.col("_from") <= at) & (at < F.col("_to"))).select(*refs.columns)


def move_dependencies(refs: DataFrame, body: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """What a moved body needs: a sibling of its file, an import, something unbound, or nothing."""
    inside = refs_inside(refs, body).select("module", "name", "targetId", "status")
    target = symbols.select(F.col("symbolId").alias("targetId"), F.col("module").alias("targetModule"), "visibility")
    taken = imports.select("module", F.coalesce("localName", "name").alias("name"), "specifier").distinct()
    joined = inside.join(target, "targetId", "left").join(taken, ["module", "name"], "left")
    need = (
        F.when(F.col("specifier").isNotNull(), "import").when(F.col("status") != "bound", "unbound")
        .when((F.col("targetModule") == F.col("module")) & F.col("visibility").isin("private", "fileLocal", "local"), "privateSibling")
        .when(F.col("targetModule") == F.col("module"), "sibling").otherwise("elsewhere")
    )
    return joined.withColumn("need", need).select("module", "name", "targetId", "specifier", "need").distinct()


def orphans(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References whose bound target is declared nowhere any more."""
    return refs.filter("targetId is not null").join(symbols.select(F.col("symbolId").alias("targetId")), "targetId", "left_anti")


def unbound_tally(refs: DataFrame) -> DataFrame:
    """Unbound references by role and name, with the least reason."""
    return refs.groupBy("role", "name").agg(F.count("*").alias("n"), F.min("reason").alias("reason"))


def id_map(symbols: DataFrame, old: str, new: str) -> DataFrame:
    """(oldKey, newKey) of a declaration and everything under it."""
    from lodestrata.operators.graph import subtree

    below = subtree(symbols, old).select(F.col("symbolId").alias("oldKey"))
    return below.withColumn("newKey", F.concat(F.lit(new), F.expr(f"substring(oldKey, {len(old) + 1})")))


def new_ids(before: DataFrame, after: DataFrame, key: str = "symbolId") -> DataFrame:
    """U4: ids that are there now and were not before."""
    return after.select(key).distinct().join(before.select(key), key, "left_anti")


def garbage(blobs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """K6: blobs that no image names."""
    used = before.select("hash").union(after.select("hash")).filter("hash is not null").distinct()
    return blobs.join(used, "hash", "left_anti")


def apply_to_files(files: DataFrame, edits: DataFrame) -> DataFrame:
    """T13 over a table: files (module, text), edits (module, 4 x span, newText) -> (module, text, problem).

    All edits of a file are applied or none; a file without edits passes through.
    """
    gathered = edits.groupBy("module").agg(F.collect_list(F.struct("startLine", "startChar", "endLine", "endChar", "newText")).alias("edits"))

    def run(batches):
        for b in batches:
            done = [
                apply_edits(text, [Edit((e["startLine"], e["startChar"]), (e["endLine"], e["endChar"]), e["newText"]) for e in some]) if some and text is not None else (text, None)
                for text, some in zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["module", "text", "problem"])

    kind = files.schema["module"].dataType.simpleString()
    return files.join(gathered, "module", "left").select("module", "text", "edits").mapInArrow(run, f"module {kind}, text string, problem string")


def rename_edits(sites: DataFrame, new_name: str) -> DataFrame:
    return sites.select("module", "startLine", "startChar", "endLine", "endChar", F.lit(new_name).alias("newText")).distinct()


def source_of(text: str, start: tuple[int, int], end: tuple[int, int], held_hash: str) -> str:
    """The text of a declaration, refused once the file has moved on."""
    if hashlib.sha256(text.encode()).hexdigest()[:32] != held_hash:
        raise ValueError("the file has changed since it was indexed")
    cut = Coordinates(text).cut(start, end)
    if cut is None:
        raise ValueError("the range is not in the text")
    return cut


def write_sources(root: str, changes: dict[str, bytes | None]) -> list[str]:
    """Write files of one checkout, None to delete: all are staged beside their places before the first is renamed."""
    staged = []
    try:
        for module, content in sorted(changes.items()):
            at = os.path.join(root, *module.split("/"))
            if os.path.commonpath([os.path.realpath(root), os.path.realpath(at)]) != os.path.realpath(root):
                raise ValueError(f"outside the workspace: {module}")
            tmp = None
            if content is not None:
                os.makedirs(os.path.dirname(at), exist_ok=True)
                tmp = f"{at}.{uuid.uuid4().hex}.tmp"
                with open(tmp, "wb") as f:
                    f.write(content)
                    f.flush()
                    os.fsync(f.fileno())
            staged.append((module, at, tmp))
        for _, at, tmp in staged:
            if tmp is not None:
                os.replace(tmp, at)
            elif os.path.exists(at):
                os.remove(at)
    finally:
        for *_, tmp in staged:
            if tmp is not None and os.path.exists(tmp):
                os.remove(tmp)
    return [m for m, *_ in staged]


# ---- journal -----------------------------------------------------------------------------------------------------------

PHASES = ("journaled", "written", "reindexed", "finalized")


@dataclass
class Journal:
    """Transactions over files: every step keeps what it found and what it left, by content hash.

    Only one transaction is open.  Undo restores the newest step, and only files that still hold what it wrote; revert
    restores the state before the transaction; commit refuses while issues are open, unless forced.
    """

    files: dict[str, bytes]
    blobs: dict[str, bytes] = field(default_factory=dict)
    steps: list[dict] = field(default_factory=list)
    issues: list[dict] = field(default_factory=list)
    state: str | None = None

    def _keep(self, content: bytes | None) -> str | None:
        if content is None:
            return None
        h = hashlib.sha256(content).hexdigest()[:32]
        self.blobs.setdefault(h, content)
        return h

    def start(self) -> None:
        if self.state == "open":
            raise ValueError("a transaction is open")
        self.state, self.steps, self.issues = "open", [], []

    def step(self, kind: str, changes: dict[str, bytes | None]) -> int:
        """Journal, write and finalize one step: new content by module, None to delete."""
        if self.state != "open":
            raise ValueError("no transaction is open")
        images = {m: (self._keep(self.files.get(m)), self._keep(c)) for m, c in changes.items()}
        self.steps.append({"stepNo": len(self.steps) + 1, "kind": kind, "phase": PHASES[0], "images": images})
        for module, (_, after) in images.items():
            self._put(module, after)
        self.steps[-1]["phase"] = PHASES[-1]
        return len(self.steps)

    def _put(self, module: str, h: str | None) -> None:
        if h is None:
            self.files.pop(module, None)
        else:
            self.files[module] = self.blobs[h]

    def _hash(self, module: str) -> str | None:
        c = self.files.get(module)
        return None if c is None else hashlib.sha256(c).hexdigest()[:32]

    def undo(self) -> list[str]:
        """Restore the newest step; returns the modules that stand in the way, in which case nothing is done."""
        if self.state != "open" or not self.steps:
            raise ValueError("nothing to undo")
        step = self.steps[-1]
        if moved := [m for m, (_, after) in step["images"].items() if self._hash(m) != after]:
            return moved
        for m, (before, _) in step["images"].items():
            self._put(m, before)
        self.steps.pop()
        return []

    def revert(self) -> None:
        if self.state != "open":
            raise ValueError("no transaction is open")
        for step in reversed(self.steps):
            for m, (before, _) in step["images"].items():
                self._put(m, before)
        self.state, self.steps = "reverted", []

    def commit(self, force: bool = False) -> None:
        if self.state != "open":
            raise ValueError("no transaction is open")
        if self.issues and not force:
            raise ValueError(f"{len(self.issues)} open issues")
        self.state = "committed"
        self.prune()

    def recover(self) -> dict[str, str]:
        """After a crash: each file of an unfinished step by its content: before, after or changed."""
        out = {}
        for step in self.steps:
            if step["phase"] != PHASES[-1]:
                for m, (before, after) in step["images"].items():
                    now = self._hash(m)
                    out[m] = "after" if now == after else "before" if now == before else "changed"
        return out

    def save(self, lake, id_: str, at: int) -> None:
        """Write the transaction to the lake's ``refactor_*`` tables; blobs first, so that what is named exists."""
        spark = lake.spark
        make = lambda rows, table: spark.createDataFrame(rows, schema(table))
        lake.insert_absent("refactor_blobs", make([(h, bytearray(b)) for h, b in self.blobs.items()], "refactor_blobs"))
        images = [(id_, "step", s["stepNo"], m, b is not None, b, a is not None, a) for s in self.steps for m, (b, a) in s["images"].items()]
        for table, rows in (
            ("refactor_images", images), ("refactor_steps", [(id_, s["stepNo"], s["kind"], s["phase"], None, at) for s in self.steps]), ("refactor_transactions", [(id_, self.state, at)]),
        ):
            column = "id" if table == "refactor_transactions" else "transactionId"
            others = kept(lake.read(table).filter(F.col(column) != id_))  # steps that were undone go
            lake.write_table(table, others.unionByName(make(rows, table)))

    @classmethod
    def load(cls, lake, id_: str, files: dict[str, bytes]) -> Journal:
        """The transaction as it was last saved, over the files as they are now; ``recover`` tells what a crash left."""
        mine = lambda table, column="transactionId": lake.read(table).filter(F.col(column) == id_).collect()
        state = mine("refactor_transactions", "id")
        if not state:
            raise ValueError(f"no transaction {id_}")
        images: dict[int, dict] = {}
        for r in mine("refactor_images"):
            images.setdefault(r.stepNo, {})[r.module] = (r.beforeHash, r.afterHash)
        steps = [{"stepNo": r.stepNo, "kind": r.kind, "phase": r.phase, "images": images.get(r.stepNo, {})} for r in sorted(mine("refactor_steps"), key=lambda r: r.stepNo)]
        wanted = [h for i in images.values() for pair in i.values() for h in pair if h]
        blobs = {r.hash: bytes(r.bytes) for r in lake.read("refactor_blobs").filter(F.col("hash").isin(wanted)).collect()} if wanted else {}
        return cls(files, blobs, steps, [], state[0].state)

    def prune(self) -> None:
        used = {h for s in self.steps for pair in s["images"].values() for h in pair if h}
        self.blobs = {h: b for h, b in self.blobs.items() if h in used}


def plan_rename(symbols: DataFrame, refs: DataFrame, imports: DataFrame, files: DataFrame, target: str, name: str, new_name: str) -> dict[str, DataFrame]:
    """A rename as tables: its sites, declarations it would collide with, other spellings of the old name, the new texts, and the id moves.

    files is (module, text).  Nothing is written; a file whose edits conflict has no text but a problem.
    """
    from lodestrata.functions.ids import SymbolId, compose_symbol, parse_symbol

    old = parse_symbol(target)
    if old is None or not old.descriptors:
        raise ValueError(f"not a symbol id: {target!r}")
    last = old.descriptors[-1]
    new = compose_symbol(SymbolId(old.language, old.module, (*old.descriptors[:-1], type(last)(last.kind, new_name, last.disambiguator))))
    sites = rename_sites(symbols, refs, imports, target, name)
    touched = sites.select("module").distinct()
    return {
        "sites": sites, "collisions": would_collide(symbols, touched, new_name),
        "unbound": refs.filter((F.col("name") == name) & ~F.col("targetId").eqNullSafe(F.lit(target))).join(touched, "module", "left_semi"),
        "files": apply_to_files(files.join(touched, "module", "left_semi"), rename_edits(sites, new_name)), "moves": id_map(symbols, target, new),
    }
