"""The reference graph: hubs, hierarchies, calls, closures, components.

Edges are rows; traversals are bounded recursive SQL where a depth bound exists, else frontier joins whose rounds are
written to the shared folder, so lineage stays short and a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_DEPTH = 16
_LOCAL = "/tmp/checkpoints/lodestrata"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one where that is unset on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"file://{_LOCAL}").rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Rows written to the session's checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hubs(refs: DataFrame, symbols: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """The most referenced targets, with their declarations where these are known."""
    ranked = refs.filter(F.col("targetId").isNotNull()).groupBy(F.col("targetId").alias("symbolId")).agg(F.count("*").alias("fanIn"))
    top = ranked.orderBy(F.desc("fanIn"), "symbolId").limit(limit)
    return top if symbols is None else F.broadcast(top).join(symbols.select("symbolId", "name", "module", "kind"), "symbolId", "left")


def distinct_edges(refs: DataFrame) -> DataFrame:
    """U2."""
    return refs.select(F.col("fromId").alias("a"), F.col("targetId").alias("b")).filter("a is not null and b is not null").distinct()


def unreferenced(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """U6."""
    return symbols.join(refs.select(F.col("targetId").alias("symbolId")).filter("symbolId is not null"), "symbolId", "left_anti")


def fan_in_out(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """References to the symbol itself, and distinct targets of the symbol and its direct members."""
    fan_in = refs.filter("targetId is not null").groupBy(F.col("targetId").alias("symbolId")).agg(F.count("*").alias("fanIn"))
    own = refs.filter("fromId is not null and targetId is not null").select(F.col("fromId").alias("symbolId"), "targetId").distinct()
    lifted = own.join(symbols.filter("containerId is not null").select("symbolId", "containerId"), "symbolId").select(F.col("containerId").alias("symbolId"), "targetId")
    fan_out = own.union(lifted).groupBy("symbolId").agg(F.count_distinct("targetId").alias("fanOut"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return symbols.select("symbolId").join(fan_in, "symbolId", "left").join(fan_out, "symbolId", "left").select("symbolId", zero("fanIn"), zero("fanOut"))


def heritage(refs: DataFrame) -> DataFrame:
    """(sub, super, role) edges."""
    return refs.filter(F.col("role").isin("extends", "implements") & F.col("targetId").isNotNull() & F.col("fromId").isNotNull()).select(
        F.col("fromId").alias("sub"), F.col("targetId").alias("super"), "role"
    ).distinct()


def calls(refs: DataFrame, symbol: str, incoming: bool = True) -> DataFrame:
    """Peers that call the symbol, or that it calls, with the number of sites and their lines."""
    own, peer = ("targetId", "fromId") if incoming else ("fromId", "targetId")
    found = refs.filter((F.col("role") == "call") & (F.col(own) == symbol) & F.col(peer).isNotNull())
    return found.groupBy(F.col(peer).alias("peer")).agg(F.count("*").alias("sites"), F.min("startLine").alias("firstLine"), F.max("startLine").alias("lastLine"))


def ancestors(edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(start, ancestor, depth) along (child, parent) edges, least depth of each, the start itself left out.

    Cycles are cut by keeping a pair at its least depth, so the rows never exceed the closure.
    """
    front = edges.select(F.col("child").alias("start"), F.col("parent").alias("ancestor")).distinct().filter("start <> ancestor").withColumn("depth", F.lit(1))
    found = front
    for d in range(2, depth + 1):
        step = front.join(edges, front["ancestor"] == edges["child"]).select("start", F.col("parent").alias("ancestor")).distinct().filter("start <> ancestor")
        front = kept(step.join(found, ["start", "ancestor"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def container_path(symbols: DataFrame, kind: str | None = None, depth: int = MAX_DEPTH) -> DataFrame:
    """(leaf, name, depth) up the containers, outermost last; with ``kind`` the walk ends at another kind."""
    t = symbols.select("symbolId", "name", "kind", "containerId", "module")
    front = t.select(F.col("symbolId").alias("leaf"), "name", F.lit(0).alias("depth"), "containerId", "module", "kind")
    if kind is not None:
        front = front.filter(F.col("kind") == kind)
    found = front.select("leaf", "name", "depth")
    for d in range(1, depth + 1):
        up = t.select(F.col("symbolId").alias("_id"), F.col("name").alias("_n"), F.col("kind").alias("_k"), F.col("containerId").alias("_c"), F.col("module").alias("_m"))
        step = front.join(up, (F.col("containerId") == F.col("_id")) & (F.col("module") == F.col("_m")))
        if kind is not None:
            step = step.filter(F.col("_k") == kind)
        front = kept(step.select("leaf", F.col("_n").alias("name"), F.lit(d).alias("depth"), F.col("_c").alias("containerId"), "module", F.col("_k").alias("kind")))
        if front.isEmpty():
            break
        found = found.union(front.select("leaf", "name", "depth"))
    return found


def _repeated(step, df: DataFrame, times: int = 3) -> DataFrame:
    """Several steps of an iteration in one plan, then written."""
    for _ in range(times):
        df = step(df)
    return kept(df)


def _trimmed(live: DataFrame) -> DataFrame:
    """Edges whose start has an edge in and whose end has an edge out."""
    into, out_of = live.select(F.col("b").alias("a")).distinct(), live.select(F.col("a").alias("b")).distinct()
    return live.join(into, "a", "left_semi").join(out_of, "b", "left_semi").select("a", "b")


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """G1: (node, component) of every node that lies on a cycle; the component is its least node.

    Nodes without an edge in or out are trimmed first, again and again.  What is left is coloured forward: each node takes
    the least label that reaches it.  Nodes that reach their colour's root back inside the colour form its component; they
    leave the graph, and the rest starts over.  A single node counts only with an edge to itself.
    """
    edges = kept(edges.select("a", "b").filter("a is not null and b is not null").distinct())
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    live, found = kept(edges.filter("a <> b")), None
    for _ in range(max_rounds):
        while True:
            n, live = live.count(), _repeated(_trimmed, live)
            if live.count() == n:
                break
        if live.isEmpty():
            break
        colour = kept(live.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:  # the least label that reaches a node
            push = lambda c: c.union(live.join(c, live["a"] == c["node"]).select(F.col("b").alias("node"), "colour")).groupBy("node").agg(F.min("colour").alias("colour"))  # noqa: E731, B023
            old, colour = colour, _repeated(push, colour)
            if colour.join(old, ["node", "colour"], "left_anti").isEmpty():
                break
        ca, cb = colour.toDF("a", "ca"), colour.toDF("b", "cb")
        inside = kept(live.join(ca, "a").join(cb, "b").filter("ca = cb").select("a", "b", F.col("ca").alias("of")))
        part = kept(colour.filter("node = colour"))
        while True:  # back from each root, inside its colour
            back = lambda p: p.union(inside.join(p, (inside["b"] == p["node"]) & (inside["of"] == p["colour"])).select(F.col("a").alias("node"), F.col("of").alias("colour"))).distinct()  # noqa: E731, B023
            n, part = part.count(), _repeated(back, part)
            if part.count() == n:
                break
        many = part.groupBy("colour").count().filter("count > 1").select("colour")
        got = kept(part.join(many, "colour", "left_semi").select("node", F.col("colour").alias("component")))
        found = got if found is None else found.union(got)
        gone = part.select(F.col("node"))
        live = kept(live.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b"))
    if found is None:
        return loops
    return found.union(loops.join(found, "node", "left_anti"))


def cycles(edges: DataFrame, limit: int = 20) -> DataFrame:
    """G1: components by size, the largest first."""
    return strong_components(edges).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(limit)


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, depth) from ``roots`` (node) along (a, b), each at its least depth."""
    found = front = kept(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, max_rounds):
        step = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        front = kept(step.join(found, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            return found
        found = kept(found.union(front))
    raise RuntimeError("the closure did not end")


def modules_exposing(imports: DataFrame, start: DataFrame) -> DataFrame:
    """Modules from which the start modules' names can be had through re-exports; imports has ``target``."""
    edges = imports.filter("reExport").select(F.col("target").alias("a"), F.col("module").alias("b")).filter("a is not null").distinct()
    return reachable(edges, start)


def subtree(symbols: DataFrame, root: str) -> DataFrame:
    """The symbol and all below it.  Every descriptor ends in its own suffix, so what starts with the root's id is below it."""
    from lodestrata.functions.ids import parse_symbol

    parsed = parse_symbol(root)
    if parsed is None:
        return symbols.limit(0)
    own = F.col("symbolId") == root
    return symbols.filter(own if parsed.local is not None or not parsed.descriptors else own | F.startswith("symbolId", F.lit(root)))


def cycle_of(edges: DataFrame, node: str | DataFrame) -> DataFrame:
    """(node, component) of the cycle that a node lies on, with all who lie on it; no rows if it is on none."""
    parts = kept(strong_components(edges))
    mine = parts.filter(F.col("node") == node) if isinstance(node, str) else parts.join(F.broadcast(node.select("node").limit(1)), "node", "left_semi")
    return parts.join(mine.select("component").distinct(), "component", "left_semi").select("node", "component")


def neighbourhood(imports: DataFrame, module: str | DataFrame, limit: int = 32) -> DataFrame:
    """(module) a module and what it imports directly, at most ``limit``, in order of name; imports has ``target``."""
    own = imports.filter(F.col("module") == module) if isinstance(module, str) else imports.join(F.broadcast(module.select("module").limit(1)), "module", "left_semi")
    return own.select("module").union(own.filter("target is not null").select("target")).distinct().orderBy("module").limit(limit)


def recursive_walk(spark: SparkSession, edges: DataFrame, start: str, depth: int = MAX_DEPTH) -> DataFrame:
    """G3 as recursive SQL: least depth of every node reached from ``start`` within ``depth`` steps."""
    edges.createOrReplaceTempView("_walk_edges")
    return spark.sql(
        f"""with recursive w(node, depth) as (
              select b, 1 from _walk_edges where a = :start
              union all select e.b, w.depth + 1 from w join _walk_edges e on e.a = w.node where w.depth < {int(depth)})
            select node, min(depth) as depth from w group by node""",
        args={"start": start},
    )
