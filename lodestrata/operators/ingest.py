"""What happens between a file's change and its facts: routing, guards, scope, admission, attachment, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.functions.search import any_glob

LARGEST_FILE, BINARY_PROBE = 4 * 1024 * 1024, 8192


def _depth_rank(c: Column) -> Column:
    """Depths by how much they hold; a file is current if it is held at no less than what is asked."""
    return F.when(c == "outline", 0).otherwise(1)


def guarded(files: DataFrame) -> DataFrame:
    """(…, content binary, length) -> state ok, tooLarge or binary, and the text where it is ok."""
    state = F.when(F.col("length") > LARGEST_FILE, "tooLarge").when(F.expr(f"position(X'00', substring(content, 1, {BINARY_PROBE})) > 0"), "binary").otherwise("ok")
    return files.withColumn("state", state).withColumn("text", F.when(F.col("state") == "ok", F.decode("content", "UTF-8")))


def extension_of(module: Column | str) -> Column:
    """Lower-cased; a leading dot is not an extension."""
    c = module if isinstance(module, Column) else F.col(module)
    return F.lower(F.regexp_extract(F.element_at(F.split(c, "/"), -1), r"^.+(\.[^.]+)$", 1))


def route(files: DataFrame, claims: DataFrame, key: str = "module") -> DataFrame:
    """Provider of each file by its extension, or by its name where a claim names it; contested files get none.

    ``claims`` (provider, extension [, filename]) is the fixed table of extractors, so it is broadcast.
    """
    if "filename" in claims.columns:
        by_name = claims.filter("filename is not null").select(F.col("provider").alias("_p"), "filename")
        named = files.join(F.broadcast(by_name), F.element_at(F.split("module", "/"), -1) == by_name["filename"], "left").drop("filename")
    else:
        named = files.withColumn("_p", F.lit(None).cast("string"))
    exts = claims.filter("extension is not null").select(F.col("provider").alias("_e"), "extension").groupBy("extension").agg(F.collect_set("_e").alias("_all"))
    joined = named.join(F.broadcast(exts), "extension", "left").withColumn("_all", F.when(F.col("_p").isNotNull(), F.array("_p")).otherwise(F.coalesce("_all", F.array().cast("array<string>"))))
    return joined.withColumns({"owners": F.size("_all"), "provider": F.when(F.size("_all") == 1, F.element_at("_all", 1))}).drop("_all", "_p")


def in_scope(files: DataFrame, include: list[str] = (), exclude: list[str] = (), deny: list[str] = (), known: DataFrame | None = None) -> DataFrame:
    """Deny beats include beats exclude beats what version control knows; adds allowed and denied."""
    denied, included, excluded = any_glob("module", list(deny)), any_glob("module", list(include)), any_glob("module", list(exclude))
    out = files
    listed = F.lit(True)
    if known is not None:
        out = out.join(known.select("module").distinct().withColumn("_known", F.lit(True)), "module", "left")
        listed = F.coalesce("_known", F.lit(False))
    allowed = F.when(denied, False).when(included, True).when(excluded, False).otherwise(listed)
    return out.withColumns({"denied": denied, "allowed": allowed}).drop("_known")


def is_external(module: Column | str) -> Column:
    """S7."""
    c = module if isinstance(module, Column) else F.col(module)
    return F.startswith(c, F.lit("../")) | (c == "..") | F.startswith(c, F.lit("/")) | F.array_contains(F.split(c, "/"), "node_modules")


def ignored(module: Column | str, names: list[str]) -> Column:
    """Any path segment is one of ``names``."""
    c = module if isinstance(module, Column) else F.col(module)
    return F.arrays_overlap(F.split(c, "/"), F.array(*map(F.lit, names)))


def without_generated(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attributes (module, value) of the generated marker; unspecified and unset mean no."""
    return files.join(attributes.filter("value not in ('unspecified', 'unset')"), "module", "left_anti")


def needs_indexing(now: DataFrame, held: DataFrame) -> DataFrame:
    """R6, OP9: files whose content changed, that are new, or that are held at too little depth."""
    have = held.select("module", F.col("contentHash"), _depth_rank(F.col("depth")).alias("_have"))
    asked = now.withColumn("_want", _depth_rank(F.col("depth")))
    current = (asked["module"] == have["module"]) & (asked["contentHash"] == have["contentHash"]) & (have["_have"] >= asked["_want"])
    return asked.join(have, current, "left_anti").drop("_want")


def coalesce(feed: DataFrame, seq: str) -> DataFrame:
    """The last event of each module, and where its first one stood."""
    rest = [c for c in feed.columns if c not in ("module", seq)]
    last = feed.groupBy("module").agg(F.max_by(F.struct(seq, *rest), seq).alias("_e"), F.min(seq).alias("firstSeq"))
    return last.select("module", "_e.*", "firstSeq")


def decide(events: DataFrame, files: DataFrame) -> DataFrame:
    """Forget, ignore (why) or reindex for each event (module, kind, contentHash, owners)."""
    joined = events.join(files.select("module", F.col("contentHash").alias("_held")), "module", "left")
    same = F.col("contentHash").isNotNull() & (F.col("contentHash") == F.col("_held"))
    reason = F.when(F.col("kind") == "deleted", F.lit(None)).when(same, "unchanged").when(F.col("owners") > 1, "contested").when(F.col("owners") == 0, "unclaimed")
    action = F.when(F.col("kind") == "deleted", "forget").when(reason.isNotNull(), "ignore").otherwise("reindex")
    return joined.withColumns({"action": action, "reason": reason}).drop("_held")


def bursts(events: DataFrame, keys: list[str], at: str, tie: str, gap: str) -> DataFrame:
    """R2: runs of events no more than ``gap`` apart, numbered by key."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    new = F.when(F.col(at) - F.lag(at).over(w) <= F.expr(f"interval {gap}"), 0).otherwise(1)
    numbered = events.withColumn("_new", new).withColumn("sid", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "sid").agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("end"))


def nearest_below(rows: DataFrame, keys: list[str], order: list[str], what: str) -> DataFrame:
    """The next declaration below each row, by key."""
    return rows.withColumn("anchor", F.lead(what).over(Window.partitionBy(*keys).orderBy(*order)))


# ---- admission ---------------------------------------------------------------------------------------------------------


def repeated_ids(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("module", "symbolId").agg(F.count("*").alias("n")).filter("n > 1")


def unknown_containers(rows: DataFrame, symbols: DataFrame, column: str = "containerId") -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).join(symbols.select(F.col("symbolId").alias(column)).distinct(), column, "left_anti")


def admit(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """1.6: extracted files -> (admitted, refused (module, reason)): one violation refuses the file, old facts stand.

    Ids must be canonical, of this module and unique; containers and origins declared here and not the row itself; a
    bound target canonical; a document's anchor a heading of this file.
    """
    from lodestrata.functions.ids import parse_symbol

    @F.udf("string")
    def why(module, declarations, references, literals, docs):
        known = {}
        for d in declarations or ():
            s = parse_symbol(d["symbolId"])
            if s is None or s.module != module:
                return f"not an id of this module: {d['symbolId']}"
            if d["symbolId"] in known:
                return f"declared twice: {d['symbolId']}"
            known[d["symbolId"]] = d["kind"]
        for d in declarations or ():
            if d["containerId"] is not None and (d["containerId"] == d["symbolId"] or d["containerId"] not in known):
                return f"unknown container: {d['containerId']}"
        for r in references or ():
            if r["fromId"] is not None and r["fromId"] not in known:
                return f"unknown origin: {r['fromId']}"
            if r["targetId"] is not None and parse_symbol(r["targetId"]) is None:
                return f"bad target: {r['targetId']}"
        for x in literals or ():
            if x["containerId"] is not None and x["containerId"] not in known:
                return f"unknown container: {x['containerId']}"
        for x in docs or ():
            if x["anchorId"] is not None and known.get(x["anchorId"]) != "heading":
                return f"not a heading: {x['anchorId']}"
        return None

    checked = facts.withColumn("_why", why("module", "declarations", "references", "literals", "docs"))
    return checked.filter("_why is null").drop("_why"), checked.filter("_why is not null").select("module", F.col("_why").alias("reason"))


# ---- imports -----------------------------------------------------------------------------------------------------------


def resolve_specifiers(imports: DataFrame, modules: DataFrame, base: Column | None = None) -> DataFrame:
    """A specifier that names a known module is resolved; a rooted or relative one that doesn't is unresolved; else external.

    Distinct specifiers are resolved once and joined back.
    """
    target = base if base is not None else F.col("specifier")
    asked = imports.select("specifier").distinct().withColumn("_t", target)
    found = asked.join(modules.select(F.col("module").alias("target")).distinct(), F.col("_t") == F.col("target"), "left")
    local = F.startswith("specifier", F.lit("/")) | F.startswith("specifier", F.lit("."))
    status = F.when(F.col("target").isNotNull(), "resolved").when(local, "unresolved").otherwise("external")
    reason = F.when(status == "unresolved", "NotIndexed").when(status == "external", "ExternalDependency")
    return imports.join(found.select("specifier", "target", status.alias("status"), reason.alias("reason")), "specifier", "left")


def resolve_candidates(imports: DataFrame, candidates: Column, modules: DataFrame) -> DataFrame:
    """The first of an array of candidate paths that exists.

    Modules and answers grow with the workspace, and a file's size says little about its rows once they are paths: both
    joins are merged, so that neither side is ever gathered on the driver to be broadcast.
    """
    asked = imports.select("module", "specifier").distinct().withColumn("_c", candidates)
    each = asked.select("module", "specifier", F.posexplode("_c").alias("_i", "target"))
    hit = each.join(modules.select(F.col("module").alias("target")).distinct().hint("merge"), "target")
    first = hit.groupBy("module", "specifier").agg(F.min_by("target", "_i").alias("target"))
    return imports.join(first.hint("merge"), ["module", "specifier"], "left")


def unreachable(files: DataFrame, reached: DataFrame) -> DataFrame:
    """G7."""
    return files.join(reached.select(F.col("node").alias("module")), "module", "left_anti")
