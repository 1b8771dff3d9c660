"""Recorded answers: citations, staleness, demand, and the rules of writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.functions.ids import fact_id, fact_id_column, parse_fact
from lodestrata.operators.graph import kept
from lodestrata.schema import QUESTIONS

CAP, MAX_PROSE = 40, 4000


def all_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """(factId, kind) of everything a citation can resolve to; doubts never do."""
    kinds = {"symbols": "declaration", "refs": "reference", "imports": "import", "literals": "literal", "comments": "comment", "docs": "doc", "answers": "answer"}
    out = None
    for name, kind in kinds.items():
        if name in tables:
            one = tables[name].select("factId", F.lit(kind).alias("kind"))
            out = one if out is None else out.union(one)
    return out


def facts_for(subject: str, tables: dict[str, DataFrame], cap: int = CAP) -> DataFrame:
    """Up to ``cap`` facts of each kind about a symbol, and whether a kind had more."""
    from lodestrata.operators.read import per_kind_cap

    keys = {
        "symbols": ("declaration", F.col("symbolId") == subject), "refs": ("reference", (F.col("targetId") == subject) | (F.col("fromId") == subject)),
        "literals": ("literal", F.col("containerId") == subject), "comments": ("comment", F.col("anchorId") == subject), "docs": ("doc", F.col("anchorId") == subject),
        "answers": ("answer", F.col("symbolId") == subject),
    }
    out = None
    for name, (kind, condition) in keys.items():
        if name in tables:
            one = tables[name].filter(condition).select(F.lit(kind).alias("kind"), "factId")
            out = one if out is None else out.union(one)
    return per_kind_cap(out, "kind", ["factId"], cap)


def resolve(citations: DataFrame, facts: DataFrame, live: bool = True) -> DataFrame:
    """Rows (…, factId) whose fact exists, or with ``live=False`` those whose fact is gone."""
    return citations.join(facts.select("factId").distinct(), "factId", "left_semi" if live else "left_anti")


def cited(answers: DataFrame) -> DataFrame:
    return answers.select(F.col("factId").alias("answerId"), F.explode("citations").alias("factId"))


def stale_answers(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Answers with a citation that no longer resolves, and how many of them."""
    gone = resolve(cited(answers), facts, live=False)
    return gone.groupBy("answerId").agg(F.count("*").alias("gone"))


def cascade(answers: DataFrame, facts: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(answerId, stale, inheritedStale, doubtedUpstream) along answer-cites-answer edges.

    Both flags spread to the citing answer until nothing changes; a cycle adds nothing new, so this ends.
    """
    own = answers.select(F.col("factId").alias("answerId"), F.col("doubtId").isNotNull().alias("doubted"))
    base = own.join(stale_answers(answers, facts).select("answerId", F.lit(True).alias("stale")), "answerId", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    edges = kept(cited(answers).join(own.select(F.col("answerId").alias("factId")), "factId", "left_semi").filter("answerId <> factId"))
    flags = kept(base.withColumns({"inheritedStale": F.lit(False), "doubtedUpstream": F.lit(False)}))
    front = kept(flags.select("answerId", F.col("stale").alias("s"), F.col("doubted").alias("d")).filter("s or d"))
    for _ in range(max_rounds):
        if front.isEmpty():
            return flags.drop("doubted")
        up = edges.join(front.toDF("factId", "s", "d"), "factId").groupBy("answerId").agg(F.max("s").alias("s"), F.max("d").alias("d"))
        both = flags.join(up, "answerId", "left")
        new_s, new_d = F.coalesce("s", F.lit(False)) & ~F.col("inheritedStale"), F.coalesce("d", F.lit(False)) & ~F.col("doubtedUpstream")
        both = kept(both.withColumns({"ns": new_s, "nd": new_d}))
        flags = both.select("answerId", "doubted", "stale", (F.col("inheritedStale") | F.col("ns")).alias("inheritedStale"), (F.col("doubtedUpstream") | F.col("nd")).alias("doubtedUpstream"))
        front = both.select("answerId", F.col("ns").alias("s"), F.col("nd").alias("d")).filter("s or d")
        front = kept(front)
    raise RuntimeError("the cascade did not end")


def answer_counts(answers: DataFrame) -> DataFrame:
    """A16."""
    return answers.groupBy("model").agg(F.count("*").alias("answers"), F.count("doubtId").alias("doubted"))


def ask_ledger(asks: DataFrame, key: list[str], at: str) -> DataFrame:
    """K4: demand by key from an append-only log of asks."""
    return asks.groupBy(*key).agg(F.count("*").alias("askCount"), F.max(at).alias("lastAsked"))


def gaps_ranked(gaps: DataFrame, answers: DataFrame, stale: DataFrame, refs: DataFrame) -> DataFrame:
    """What to write next: answers to recheck first, then missing ones by demand, recency and fan-in."""
    held = answers.select("symbolId", "question", F.col("factId").alias("answerId")).join(stale.select("answerId", F.lit(True).alias("_stale")), "answerId", "left")
    fan = refs.filter("targetId is not null").groupBy(F.col("targetId").alias("symbolId")).agg(F.count("*").alias("fanIn"))
    joined = gaps.join(held, ["symbolId", "question"], "left").join(fan, "symbolId", "left")
    state = F.when(F.col("_stale"), "recheck").when(F.col("answerId").isNull(), "missing")
    ranked = joined.withColumn("state", state).filter("state is not null")
    return ranked.select("symbolId", "question", "askCount", "lastAsked", F.coalesce("fanIn", F.lit(0)).alias("fanIn"), "state").orderBy(
        F.desc("state"), F.desc("askCount"), F.desc("lastAsked"), F.desc("fanIn"), "symbolId", "question"
    )


def gap_tree(root: str, refs: DataFrame, symbols: DataFrame, answers: DataFrame, depth: int = 8, limit: int = 500) -> DataFrame:
    """(symbolId, depth, answered, external, total) of what ``root`` uses, directly or not, the deepest first.

    ``external`` counts the targets of a symbol that are declared nowhere here; ``total`` is the number of symbols before the
    limit of rows, so a cut shows.  Symbols at equal depth come by id: the exact post-order of a walk is a driver-side notion.
    """
    own = symbols.select(F.col("symbolId").alias("node"))
    every = refs.filter("fromId is not null and targetId is not null").select(F.col("fromId").alias("a"), F.col("targetId").alias("b")).distinct()
    uses = every.join(own.toDF("b"), "b", "left_semi")
    front = found = own.filter(F.col("node") == root).withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = front.join(uses, front["node"] == uses["a"]).select(F.col("b").alias("node")).distinct()
        front = kept(step.join(found, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        found = kept(found.union(front))
    held = answers.select(F.col("symbolId").alias("node"), F.lit(True).alias("answered")).distinct()
    outside = every.join(own.toDF("b"), "b", "left_anti").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("external"))
    tree = found.join(held, "node", "left").join(outside, "node", "left").select(
        F.col("node").alias("symbolId"), "depth", F.coalesce("answered", F.lit(False)).alias("answered"), F.coalesce("external", F.lit(0)).alias("external")
    )
    return tree.crossJoin(F.broadcast(found.agg(F.count("*").alias("total")))).orderBy(F.desc("depth"), "symbolId").limit(limit)  # one row


def migrate_keys(rows: DataFrame, moves: DataFrame, key: str, within: list[str]) -> DataFrame:
    """K8: rows moved along (oldKey, newKey) unless the new place is taken; what can't move is dropped."""
    moving = rows.join(moves, rows[key] == moves["oldKey"])
    taken = rows.select(F.col(key).alias("newKey"), *within).distinct()
    ok = moving.join(taken, ["newKey", *within], "left_anti").withColumn(key, F.col("newKey")).select(*rows.columns)
    return rows.join(moves.select(F.col("oldKey").alias(key)), key, "left_anti").select(*rows.columns).union(ok)


def check_answer(subject: str, question: str, prose: str, citations: list[str], resolves, subject_facts: set[str], incumbent: dict | None = None, omitting: str | None = None, doubt: str | None = None) -> str | None:
    """The rules an answer must meet before it is written; the first that it breaks, or None.

    ``resolves`` maps a fact id to whether it exists.  An incumbent with live citations and without doubt may only be
    replaced by an answer that covers these or says what it omits; a doubt token must be the incumbent's.
    """
    if question not in QUESTIONS:
        return f"unknown question {question}"
    if not prose.strip():
        return "an answer needs prose"
    if len(prose) > MAX_PROSE:
        return f"an answer has at most {MAX_PROSE} characters"
    if not citations:
        return "an answer cites at least one fact"
    if bad := [c for c in citations if parse_fact(c) is None]:
        return f"not a fact id: {bad[0]}"
    if gone := [c for c in citations if not resolves(c)]:
        return f"does not resolve: {gone[0]}"
    if not subject_facts & set(citations):
        return f"no cited fact is about {subject}"
    if doubt is not None and (incumbent or {}).get("doubtId") != doubt:
        return "the doubt cited is not the answer's"
    if incumbent and not incumbent.get("doubtId") and not omitting:
        old = incumbent["citations"]
        if old and all(resolves(c) for c in old) and (left := set(old) - set(citations)):
            return f"leaves out a live citation: {sorted(left)[0]}"
    return None


def judge(proposed: DataFrame, facts: DataFrame, subjects: DataFrame, held: DataFrame) -> DataFrame:
    """The rules of writing over a table: proposed answers (symbolId, question, prose, citations[, omitting, doubt]) with the
    first rule each breaks in ``refused``, null if it may be written.

    facts (factId) is what resolves; subjects (symbolId, factId) says which facts are about a symbol; held is the answers
    table.  One write of a batch judges all its rows against what was held before.
    """
    key = ["symbolId", "question"]
    have = set(proposed.columns)
    text = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
    rows = proposed.select(*key, "prose", "citations", text("omitting"), text("doubt"))
    cites = rows.select(*key, F.explode(F.array_distinct("citations")).alias("factId"))
    known = facts.select("factId").distinct().withColumn("_live", F.lit(True))
    about = subjects.select("symbolId", "factId").distinct().withColumn("_about", F.lit(True))
    met = cites.join(known, "factId", "left").join(about, ["symbolId", "factId"], "left").groupBy(*key).agg(
        F.min(F.when(F.col("_live").isNull(), F.col("factId"))).alias("_gone"), F.bool_or(F.coalesce("_about", F.lit(False))).alias("_about")
    )
    old = held.select(*key, F.col("doubtId").alias("_doubt"), F.col("citations").alias("_old"))
    was = old.select(*key, F.explode("_old").alias("factId")).join(known, "factId", "left").groupBy(*key).agg(F.bool_and(F.coalesce("_live", F.lit(False))).alias("_all"))
    joined = rows.join(met, key, "left").join(old, key, "left").join(was, key, "left")
    left = F.array_min(F.array_except("_old", "citations"))
    standing = F.col("_all") & F.col("_doubt").isNull() & (F.coalesce("omitting", F.lit("")) == "")
    refused = (
        F.when(~F.col("question").isin(*QUESTIONS), F.concat(F.lit("unknown question "), "question"))
        .when(F.trim(F.coalesce("prose", F.lit(""))) == "", "an answer needs prose")
        .when(F.length("prose") > MAX_PROSE, f"an answer has at most {MAX_PROSE} characters")
        .when(F.size(F.coalesce("citations", F.array().cast("array<string>"))) == 0, "an answer cites at least one fact")
        .when(F.col("_gone").isNotNull(), F.concat(F.lit("does not resolve: "), "_gone"))
        .when(~F.coalesce("_about", F.lit(False)), F.concat(F.lit("no cited fact is about "), "symbolId"))
        .when(F.col("doubt").isNotNull() & ~F.col("doubt").eqNullSafe(F.col("_doubt")), "the doubt cited is not the answer's")
        .when(F.coalesce(standing, F.lit(False)) & left.isNotNull(), F.concat(F.lit("leaves out a live citation: "), left))
    )
    return joined.select(*rows.columns, refused.alias("refused"))


def record(lake, proposed: DataFrame, facts: DataFrame, subjects: DataFrame, at: int, thin_below: int = 2) -> DataFrame:
    """Write the answers that may be written, each over the one held for its subject and question; returns what was judged.

    A doubt that the new answer doesn't cite rides on.
    """
    held = lake.read("answers")
    judged = kept(judge(proposed, facts, subjects, held))
    good = judged.filter("refused is null").dropDuplicates(["symbolId", "question"])
    carried = held.select("symbolId", "question", F.struct("doubtId", "doubtReason", "doubtAt", "doubtBy").alias("_d"))
    rides = F.col("_d.doubtId").isNotNull() & ~F.col("_d.doubtId").eqNullSafe(F.col("doubt"))
    rows = good.join(carried, ["symbolId", "question"], "left").select(
        "symbolId", "question", fact_id_column("answer", F.element_at(F.split("symbolId", " "), 3), "symbolId", "question", "prose", F.array_join("citations", ",")).alias("factId"), "prose", "citations",
        (F.size(F.array_distinct("citations")) < thin_below).alias("thin"), F.lit(at).cast("long").alias("createdAt"), *(F.when(rides, F.col(f"_d.{c}")).alias(c) for c in ("doubtId", "doubtReason", "doubtAt", "doubtBy")),
    )
    lake.upsert("answers", kept(rows))
    return judged


def invalidate(lake, doubts: DataFrame) -> tuple[int, int]:
    """Cast doubt on answers that exist: (symbolId, question, doubtReason, doubtBy, doubtAt); the doubt's id is of its content."""
    module = F.element_at(F.split("symbolId", " "), 3)
    return lake.set_doubt(doubts.withColumn("doubtId", fact_id_column("doubt", module, "symbolId", "question", "doubtReason", "doubtBy", F.col("doubtAt").cast("string"))))


def reaffirm(lake, answers: DataFrame) -> tuple[int, int]:
    """Lift the doubts (symbolId, question, doubtId) that are the ones held; (version, answers affected)."""
    same = lake.read("answers").join(answers.select("symbolId", "question", F.col("doubtId").alias("_d")), ["symbolId", "question"]).filter("doubtId = _d")
    none = F.lit(None).cast("string")
    return lake.set_doubt(same.select("symbolId", "question", none.alias("doubtId"), none.alias("doubtReason"), F.lit(None).cast("long").alias("doubtAt"), none.alias("doubtBy")))


def recall(answers: DataFrame, facts: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Answers, of the symbols in ``subjects`` if given, with how far they can be trusted: live and gone citations, doubt."""
    asked = answers if subjects is None else answers.join(subjects.select("symbolId").distinct(), "symbolId", "left_semi")
    cites = asked.select("symbolId", "question", F.explode("citations").alias("factId")).join(facts.select("factId").distinct().withColumn("_live", F.lit(1)), "factId", "left")
    n = cites.groupBy("symbolId", "question").agg(F.count("_live").alias("live"), F.count_if(F.col("_live").isNull()).alias("gone"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    state = F.when(F.col("doubtId").isNotNull(), "doubted").when(F.coalesce("gone", F.lit(0)) > 0, "stale").otherwise("standing")
    return asked.join(n, ["symbolId", "question"], "left").select("symbolId", "question", "prose", "thin", zero("live"), zero("gone"), state.alias("state"))


def answer_row(subject: str, module: str, question: str, prose: str, citations: list[str], at: int, model: str | None = None, thin_below: int = 2, incumbent: dict | None = None, doubt: str | None = None) -> dict:
    """A row of ``answers``: identity over subject, question, prose and citations; a doubt not cited rides on."""
    carried = incumbent if incumbent and incumbent.get("doubtId") and incumbent["doubtId"] != doubt else {}
    return {
        "symbolId": subject, "question": question, "factId": fact_id("answer", module, subject, question, prose, ",".join(citations)), "prose": prose, "citations": citations,
        "thin": len(set(citations)) < thin_below, "model": model, "createdAt": at, **{k: carried.get(k) for k in ("doubtId", "doubtReason", "doubtAt", "doubtBy")},
    }
