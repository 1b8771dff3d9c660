"""Which declaration a comment belongs to, by position alone.

Line comments that stand alone in consecutive lines at one column are one comment.  A comment of its own line leads the
nearest declaration below it, if neither a blank line nor another declaration lies between and the scope around the
comment reaches that far; of several, the nearest wins and the rest stand alone.  Beside code, it belongs to a declaration
named on its line: the nearest to its left, else the first to its right.  Otherwise it stands inside what encloses it.
"""

from __future__ import annotations

from lodestrata.functions.text import is_block_comment, normalize_comment


def _start(d: dict) -> tuple[int, int]:
    return d["startLine"], d["startChar"]


def _end(d: dict) -> tuple[int, int]:
    return d["endLine"], d["endChar"]


def _enclosing(declarations: list[dict], c: dict) -> dict | None:
    around = [d for d in declarations if _start(d) <= _start(c) and _end(c) <= _end(d)]
    return max(around, key=_start, default=None)


def _grouped(facts) -> list[dict]:
    lines = [facts.at.line_text(i) or "" for i in range(facts.at.line_count())]
    units = lambda s, n: s.encode("utf-16-le")[: 2 * n].decode("utf-16-le", "ignore")
    out: list[dict] = []
    for c in sorted(facts.comments, key=_start):
        own = not units(lines[c["startLine"]], c["startChar"]).strip()
        last = lines[c["endLine"]]
        after = bool(last[len(units(last, c["endChar"])) :].strip())
        lone = own and not after and c["startLine"] == c["endLine"] and not is_block_comment(c["raw"])
        prev = out[-1] if out else None
        if lone and prev and prev["lone"] and prev["startChar"] == c["startChar"] and prev["endLine"] + 1 == c["startLine"]:
            prev |= {"endLine": c["endLine"], "endChar": c["endChar"]}
            prev["raw"] = facts.at.cut(_start(prev), _end(prev))
        else:
            out.append(c | {"own": own, "after": after, "lone": lone})
    return out


def attach_comments(facts) -> list[dict]:
    if not facts.comments:
        return []
    groups, declared = _grouped(facts), facts.declarations
    blank = {i for i in range(facts.at.line_count()) if not (facts.at.line_text(i) or "").strip()}
    heads = {d["startLine"] for d in declared}
    leads: dict[str, int] = {}
    for i, g in enumerate(groups):
        if not g["own"] or g["after"]:
            continue
        target = next((d for d in declared if _start(d) == _start(g)), None)
        if target is None:
            below = [d for d in declared if d["startLine"] > g["endLine"]]
            target = min(below, key=lambda d: d["startLine"], default=None)
            if target is None or any(x in blank or x in heads for x in range(g["endLine"] + 1, target["startLine"])):
                continue
            scope = _enclosing(declared, g)
            if scope is not None and _end(scope) < _start(target):
                continue
        held = leads.get(target["symbolId"])
        if held is None or g["endLine"] > groups[held]["endLine"]:
            leads[target["symbolId"]] = i
    leading = {i: s for s, i in leads.items()}
    out = []
    for i, g in enumerate(groups):
        form, place, anchor = "standalone", "inside", None
        on_line = [d for d in declared if d["nameLine"] == g["startLine"]] if not g["own"] else []
        if i in leading:
            form, place, anchor = "leading", "above", leading[i]
        elif on_line:
            left = [d for d in on_line if d["nameChar"] < g["startChar"]]
            pick = max(left, key=lambda d: d["nameChar"]) if left else min(on_line, key=lambda d: d["nameChar"])
            place, anchor = "after" if left else "before", pick["symbolId"]
            form = "trailing" if left and not g["after"] else "inline"
        else:
            around = _enclosing(declared, g)
            anchor = around["symbolId"] if around else None
        out.append({k: g[k] for k in ("raw", "startLine", "startChar", "endLine", "endChar")} | {"normalized": normalize_comment(g["raw"]), "form": form, "placement": place, "anchorId": anchor})
    return out
