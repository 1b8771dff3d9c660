"""Personal data: exact base rules, and spans added by boosted trees over overlapping candidates.

The base rules find emails, IPv4 addresses, cards (Luhn) and international phones as the contract states them; what they
find always stays.  Beside them high-recall generators propose overlapping spans of the same kinds (local phone formats,
cards glued to other numbers, obfuscated addresses, ...).  Gradient-boosted trees grade each candidate by its format and
its surroundings, a Platt fit turns the margin into a probability, and each kind has the smallest threshold that keeps the
wanted precision on held-out cases.  Candidates above it are taken best first, none overlapping another or a base span.

The trees are trained here, on two kinds of cases: generated sentences with known spans (``training_cases``, seeded), and
contexts of the corpus (``train_on``), a bounded sample of at most ``CONTEXTS`` stretches.  A context around a span of the
base rules shows how the corpus writes before and after personal data; the span is kept or written in another of its
formats, and is true either way.  A context around other digits is a look-alike; what in it may still be personal data
(digits that pass Luhn, spelled-out addresses) is left out of the fit.  Thresholds are set on cases the trees didn't see.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.shared import pieces, with_text_columns

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995
Span = tuple[str, int, int]

# ---- base rules ----------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from each @ outwards, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The contract's spans, by kind as listed and then by start."""
    out = list(_emails(text))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ---- candidates and features -----------------------------------------------------------------------------------------

_CLUSTER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,3}[0-9])*")
_GROUP = re.compile(r"[0-9]+")
_HINT = re.compile(r"@|[\[({] ?(?:at|AT) ?[\])}]|[\[({] ?(?:dot|DOT) ?[\])}]|\b(?:dot|DOT)\b| (?:at|AT) (?=[\w-]{1,63}\.\w)")
_LOOSE = re.compile(
    r"(?<![\w.%+-])[\w%+-](?:[\w.%+-]{0,62}[\w%+-])?(?: ?@ ?| ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) )[\w-]{1,63}"
    r"(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) )[\w-]{1,63}){1,5}"
)
#: An address is at most this long: a local part of 64 and six labels of 63 (the limits of mail), with what stands between.
_WINDOW = 64 + 6 * (63 + 8)
# Words beside a number that speak for a kind or against any. Fixed values.
_SPEAKS = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write|address|reach)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|addr|address|client|login from)\b"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|debit|pan)\b"),
    "phone": re.compile(r"(?i)\b(tel|phone|call|fax|mobile|cell|whatsapp|dial|ring)\b"),
}
# Top-level domains that an obfuscated address usually ends in. Fixed values.
_TLDS = frozenset("com org net edu gov info io co fr nl eu uk ch de".split())
_AGAINST = re.compile(r"(?i)(\b(order|invoice|version|isbn|ref|ticket|page|chapter|serial|part|total|price|sku|build|year|token|id|section|figure|no)\b|[#$€£v]\.?)\W*$")
_DATE = re.compile(r"(?:19|20)\d\d[-. ]\d{1,2}[-. ]\d{1,2}\Z|\d{1,2}[-. ]\d{1,2}[-. ](?:19|20)\d\d\Z")


def candidates(text: str) -> list[Span]:
    """High recall, overlapping: runs of digit groups as phone, card or ip, and loosely written addresses."""
    out: list[Span] = []
    for m in _CLUSTER.finditer(text):
        groups = list(_GROUP.finditer(text, m.start(), m.end()))
        lens = [len(g.group()) for g in groups]
        for i in range(len(groups)):
            n = 0
            for j in range(i, len(groups)):
                n += lens[j]
                if n > 19:
                    break
                start = groups[i].start()
                while start > m.start() and text[start - 1] in "+(":
                    start -= 1
                end = groups[j].end()
                if 7 <= n <= 15:
                    out.append(("phone", start, end))
                if 13 <= n:
                    out.append(("card", groups[i].start(), end))
                if j - i == 3 and 4 <= n <= 12 and max(lens[i : j + 1]) <= 3:
                    out.append(("ip", groups[i].start(), end))
    done = 0
    for h in _HINT.finditer(text):
        for m in _LOOSE.finditer(text, max(done, h.start() - _WINDOW), min(len(text), h.end() + _WINDOW)):
            out.append(("email", *m.span()))
            done = m.end()
    return out


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    groups = [len(g) for g in _GROUP.findall(s)]
    d = _digits(s)
    body = re.split(r" ?@ ?| ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) ", s, maxsplit=1)
    labels = re.split(r"\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) ", body[-1])
    before, after = text[start - 1 : start], text[end : end + 1]
    return [
        KINDS.index(kind), len(s), len(d), len(groups), max(groups, default=0), min(groups, default=0), s.startswith(("+", "(+")), "(" in s,
        s.count(" "), s.count("."), s.count("-"), len(d) > 12 and luhn(d), all(int(g) <= 255 for g in _GROUP.findall(s)) if len(groups) == 4 and max(groups) < 4 else 0,
        len(set(groups)) == 1, _side(before), _side(after), before in tuple("-./:=\"'#$"), after in tuple("-/:=\"'%$"), bool(_SPEAKS[kind].search(left)),
        any(p.search(left) for k, p in _SPEAKS.items() if k != kind), bool(_AGAINST.search(left)), bool(_DATE.match(s)), "@" in s,
        len(labels[-1]) if labels[-1].isalpha() else 0, len(labels), "(" in s or "[" in s or "{" in s, bool(re.search(r"\d[ ().-]{0,2}$", left)), bool(re.match(r"[ ().-]{0,2}\d", right)),
        labels[-1].lower() in _TLDS, groups[0] if groups else 0, groups[-1] if groups else 0, d[:1] == "0", bool(re.fullmatch(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", s)),
    ]


# ---- training cases ----------------------------------------------------------------------------------------------------


def _card(rng: random.Random, n: int = 16) -> str:
    head = "".join(str(rng.randrange(10)) for _ in range(n - 1))
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def training_cases(n: int, seed: int) -> list[tuple[str, set[Span]]]:
    """Generated sentences with their true spans: personal data in many formats among look-alikes."""
    rng = random.Random(seed)
    num = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvéü") for _ in range(rng.randrange(2, 11)))
    name = lambda: "".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randrange(3, 9)))

    def email() -> str:
        at, dot = rng.choice([("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), ("[at]", ".")])
        return name() + rng.choice(["", ".", "_"]) + rng.choice([name(), num(2)]) + at + name() + dot + rng.choice(["com", "org", "net", "de", "io"])

    def phone() -> tuple[str, str]:
        a, b, c = str(rng.randrange(2, 10)) + num(2), num(3), num(4)
        bare = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{num(2)} {num(3)} {num(4)}", f"0{num(3)}-{num(6)}", f"0{num(4)} {num(6)}"]
        bare += [f"00{rng.choice(['', ' '])}{rng.randrange(20, 99)} {rng.choice([f'{num(2)} {num(4)} {num(4)}', f'{num(4)} {num(6)}', f'{num(3)} {num(3)} {num(3)}'])}" for _ in range(2)]
        if rng.random() < 0.3:
            return "", rng.choice([f"+{rng.randrange(1, 99)} ({a}) {b}-{c}", f"+{rng.randrange(1, 99)} {a} {b} {c}", f"+{rng.randrange(1, 99)}{a}{b}{c}"])
        return rng.choice(["tel ", "phone: ", "call ", "fax ", "mobile: ", "cell "]), rng.choice(bare)

    def card() -> tuple[str, str]:
        n = rng.choice([16, 16, 16, 19])
        c = _card(rng, n)
        parts = [c[i : i + 4] for i in range(0, n, 4)]
        if rng.random() < 0.3:  # a card, then a number that is none
            return rng.choice(["", "", "card ", "visa "]), rng.choice([c, " ".join(parts), "-".join(parts)]) + " \0" + num(rng.choice([3, 4, 4, 5]))
        return rng.choice(["", "", "card ", "visa: ", "credit card "]), rng.choice([c, " ".join(parts), "-".join(parts)])

    def ip() -> tuple[str, str]:
        return rng.choice(["", "", "ip ", "host ", "server: "]), ".".join(str(rng.randrange(256)) for _ in range(4))

    def other() -> str:
        year = str(rng.randrange(1950, 2030))
        return rng.choice([
            f"order {num(rng.randrange(5, 17))}", f"#{num(rng.randrange(4, 13))}", f"{year}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", f"version {rng.randrange(9)}.{rng.randrange(20)}",
            f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}.{num(4)}", f"{num(3)}.{300 + rng.randrange(600)}.{num(2)}.{num(3)}", f"{rng.randrange(10, 99)}.{num(3)}.{num(3)}", num(16), num(rng.randrange(5, 15)),
            f"${num(2)}.{num(2)}", f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"invoice {num(4)}-{num(4)}-{num(4)}", hashlib.sha1(num(9).encode()).hexdigest(),
            f'token = "{hashlib.md5(num(9).encode()).hexdigest()}"', f"{num(2)}:{num(2)}", f"pages {num(3)}-{num(3)}", f"section {rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}",
            f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{word()} at {word()} dot", f"{word()} at {word()} dot {word()}", f"{num(2)} at {word()} dot dot {word()}", f"{word()} at {word()} dot {word()} dot {word()} dot",
            " ".join(rng.choice([year, num(1), num(2), num(3), f"{num(1)}.{num(1)}"]) for _ in range(rng.randrange(2, 8))), f"{year} {year} {year}", f"{num(3)} {num(3)} {num(4)}", f"{num(3)}-{num(2)}", f"@{word()}", f"{num(1)},{num(3)},{num(3)}",
        ])

    out = []
    for _ in range(n):
        text, spans = "", set()
        for _ in range(rng.randrange(1, 5)):
            text += " ".join(word() for _ in range(rng.randrange(1, 6))) + rng.choice([" ", " ", " ", ", ", ": ", "\n"])
            kind = rng.choice([*KINDS, "", "", "", ""])
            lead, s = {"email": lambda: (rng.choice(["", "mail ", "contact "]), email()), "ip": ip, "card": card, "phone": phone, "": lambda: ("", other())}[kind]()
            true, _, rest = s.partition(" \0")
            text += lead
            if kind:
                spans.add((kind, len(text), len(text) + len(true)))
            text += true + (f" {rest}" if rest else "") + rng.choice(["", "", "", ".", ",", "!!", "###", "$$$"]) + " "
        out.append((text, spans))
    return out


# ---- boosted trees -------------------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees as (feature, threshold, left, right, value) arrays, a Platt fit, and a threshold for each kind."""

    trees: list[tuple[np.ndarray, ...]]
    start: float
    platt: tuple[float, float] = (1.0, 0.0)
    least: dict[str, float] | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f < 0, at, go)
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -40, 40)))


DEPTH, TREES, SHRINK, BINS = 5, 80, 0.2, 32


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic gradient boosting with histogram splits."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    base = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Boosted([], float(np.log(base / (1 - base))))
    margin = np.full(len(x), model.start)
    width = x.shape[1]
    offset = np.arange(width) * (BINS + 1)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        tree: list[list[float]] = []
        grown = np.zeros(len(x))

        def grow(rows: np.ndarray, depth: int) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            me = len(tree)
            tree.append([-1, 0.0, 0, 0, SHRINK * gs / (hs + 1.0)])
            if depth < DEPTH and len(rows) >= 10:
                flat = (binned[rows] + offset).ravel()
                gh = np.bincount(flat, np.repeat(g[rows], width), width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1]
                hh = np.bincount(flat, np.repeat(h[rows], width), width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1]
                gain = gh**2 / (hh + 1.0) + (gs - gh) ** 2 / (hs - hh + 1.0) - gs**2 / (hs + 1.0)
                gain[(hh < 1e-3) | (hs - hh < 1e-3)] = -1
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] > 1e-4 and b < len(cuts[f]):
                    low = binned[rows, f] <= b
                    tree[me][:4] = [int(f), float(cuts[f][b]), grow(rows[low], depth + 1), grow(rows[~low], depth + 1)]
                    return me
            grown[rows] = tree[me][4]
            return me

        grow(np.arange(len(x)), 0)
        margin += grown
        t = np.array(tree)
        model.trees.append((t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4]))
    return model


# ---- contexts of the corpus ----------------------------------------------------------------------------------------------

#: Contexts that a fit takes at most, those of one document, and characters on either side of a span.
CONTEXTS, PER_DOC, SIDE = 4000, 4, 48


def contexts(text: str) -> list[tuple[str | None, str, str, str]]:
    """(kind, left, span, right) of up to ``PER_DOC`` stretches: spans of the base rules first, then other runs of digits (no kind)."""
    base = sorted(base_spans(text), key=lambda s: s[1])
    cut = lambda k, a, z: (k, text[max(0, a - SIDE) : a], text[a:z], text[z : z + SIDE])
    out = [cut(*s) for s in base[: PER_DOC // 2]]
    for m in _CLUSTER.finditer(text):
        if len(out) >= PER_DOC:
            break
        if 4 <= len(_digits(m.group())) and m.end() - m.start() <= 2 * SIDE and not any(a < m.end() and m.start() < z for _, a, z in base):
            out.append(cut(None, *m.span()))
    return out


def rewritten(kind: str, value: str, rng: random.Random) -> tuple[str, str]:
    """A known span in one of the formats that people write it in, and what may follow it."""
    d = _digits(value)
    if kind == "email" and rng.random() < 0.6:
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("[at]", "."), (" at ", ".")])
        local, _, domain = value.partition("@")
        return local + at + domain.replace(".", dot), ""
    if kind == "phone" and rng.random() < 0.6 and len(d) >= 10:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{d[:-10]} {a} {b} {c}", f"00{d[:-10]} {a[:2]} {a[2:]}{b[0]} {b[1:]} {c[:2]} {c[2:]}"]), ""
    if kind == "card":
        new = rng.choice([value, d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))])
        return new, f" {rng.randrange(100, 9999)}" if rng.random() < 0.3 else ""
    return value, ""


def _of_contexts(found: list[tuple], seed: int) -> list[tuple[str, set[Span], bool]]:
    """(text, true spans, whether other candidates that may be personal data are unknown) of each context."""
    rng, out = random.Random(seed), []
    for kind, left, value, right in found:
        new, more = rewritten(kind, value, rng) if kind else (value, "")
        text = left + new + more + right
        true = set(base_spans(text)) if not more else {s for s in base_spans(text) if s[2] <= len(left) or s[1] >= len(left) + len(new)}
        if kind:
            true.add((kind, len(left), len(left) + len(new)))
        out.append((text, true, True))
    return out


def _cases(cases: list[tuple[str, set[Span], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of what the trees are asked about: candidates beside the base spans."""
    x, y = [], []
    for text, true, partial in cases:
        base = base_spans(text)
        for c in sorted(set(candidates(text))):
            if any(a < c[2] and c[1] < z for _, a, z in base):
                continue
            if partial and c not in true and (c[0] == "email" or c[0] == "card" and luhn(_digits(text[c[1] : c[2]]))):
                continue
            x.append(features(text, c))
            y.append(c in true)
    return np.array(x, float).reshape(len(x), -1), np.array(y, float)


def _fit(to_fit: list, to_set: list, precision: float) -> Boosted:
    """Trees on ``to_fit``; the Platt fit and the thresholds on ``to_set``."""
    model = boost(*_cases(to_fit))
    x, y = _cases(to_set)
    m = model.margin(x)
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps of the Platt fit
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, [((y - p) * m).sum(), (y - p).sum()])
    model.platt, model.least = (float(a), float(b)), {}
    p = model.probability(x)
    for i, kind in enumerate(KINDS):
        own = np.flatnonzero(x[:, 0] == i)
        order = own[np.argsort(-p[own], kind="stable")]
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        model.least[kind] = max(0.5, float(p[order[good[-1]]])) if len(good) else 1.1
    return model


def _generated(n: int, seed: int) -> list[tuple[str, set[Span], bool]]:
    return [(text, true, False) for text, true in training_cases(n, seed)]


@lru_cache(maxsize=4)
def train(n: int = 2500, seed: int = 17, precision: float = PRECISION) -> Boosted:
    """Fit on ``n`` generated sentences, calibrate and set thresholds on others; the same on every run."""
    return _fit(_generated(n, seed), _generated(n, seed + 1), precision)


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2500, seed: int = 17, precision: float = PRECISION) -> Boosted:
    """Fit on generated sentences and on at most ``CONTEXTS`` contexts of ``docs``, two thirds of them; thresholds on the rest.

    The sample is by hash of id and text, so the same rows give the same model.  A table without digits or addresses gives
    the model of :func:`train`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = [(h, i, *c) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, c in enumerate(contexts(t))]
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["h", "i", "kind", "left", "span", "right"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("h"), text.alias("text"))
    # a hash thins the rows where they are read: so many documents that one in eight with a context is enough
    share = min(1.0, 8 * CONTEXTS / max(1, docs.count()))
    thin = rows.filter((F.shiftrightunsigned("h", 11) < F.lit(int(share * (1 << 53)))) & text.rlike("[0-9]{2}|@"))
    some = thin.mapInArrow(run, "h long, i int, kind string, left string, span string, right string")
    found = some.dropDuplicates(["h", "i"]).orderBy("h", "i").limit(CONTEXTS).collect()
    part = lambda ok: _of_contexts([(r.kind, r.left, r.span, r.right) for r in found if (r.h % 3 != 0) == ok], seed)
    return _fit(_generated(n, seed) + part(True), _generated(n, seed + 1) + part(False), precision)


def all_spans(texts: list[str], model: Boosted) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, both by kind as listed and then by start."""
    base = [base_spans(t) for t in texts]
    asked: list[tuple[int, Span]] = []
    for i, t in enumerate(texts):
        ranges = sorted((s, e) for _, s, e in base[i])
        for c in dict.fromkeys(candidates(t)):
            if not any(s < c[2] and c[1] < e for s, e in ranges):
                asked.append((i, c))
    added: dict[int, list[Span]] = {}
    if asked:
        p = model.probability(np.array([features(texts[i], c) for i, c in asked], float))
        for k in np.lexsort((np.arange(len(asked)), -p)):
            i, c = asked[k]
            if p[k] >= model.least[c[0]] and not any(s < c[2] and c[1] < e for _, s, e in added.get(i, ())):
                added.setdefault(i, []).append(c)
    key = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return [(sorted(b, key=key), sorted(b + added.get(i, []), key=key)) for i, b in enumerate(base)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added, has_pii) for each whole text.

    The counts by kind and the digest are of the base spans, ``spans`` and ``n_spans`` of all, ``n_added`` of those that the
    trees add; ``has_pii`` says whether there is any.  Offsets are code points, ends exclusive.  A null text
    counts as empty; repeated rows give repeated rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = all_spans([t or "" for t in b.column(1).to_pylist()], model)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([_joined(every) for _, every in found], pa.string()), pa.array([len(every) for _, every in found], pa.int64()),
                 pa.array([len(every) - len(base) for base, every in found], pa.int64()), pa.array([bool(every) for _, every in found], pa.bool_())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added", "has_pii"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long, has_pii boolean")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by ``[KIND]`` of the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Boosted, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` masked; null stays null."""

    def cover(texts: list) -> list[pa.Array]:
        found = all_spans([t or "" for t in texts], model)
        return [pa.array([t if t is None else masked(t, every) for t, (_, every) in zip(texts, found)], pa.string())]

    return with_text_columns(docs, text_col, cover, f"`{text_col}` string")
