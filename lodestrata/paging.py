"""Pages of results whose counts say how sure they are."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

DEFAULT_LIMIT, MAX_LIMIT = 50, 200


def clamp(limit: float | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    """A usable page size: the default for nothing and NaN, else within 1..most."""
    if limit is None or math.isnan(limit):
        return default
    return int(max(1, min(most, limit)))


@dataclass(frozen=True)
class Page:
    """``items`` is at most the page; ``kind`` is ``exact`` or ``atLeast``, with what stopped the count in ``reason``."""

    items: list
    kind: str
    count: int
    reason: str | None = None

    def wire(self) -> dict:
        out = {"total": self.count, "truncated": self.count > len(self.items)}
        return out | {"scanIncomplete": True} if self.kind == "atLeast" and self.reason != "pageCapped" else out


def counted(df: DataFrame, limit: int, *order: Column | str) -> Page:
    """A page and the exact count of the same rows."""
    return Page(df.orderBy(*order).limit(limit).collect(), "exact", df.count())


def probed(df: DataFrame, limit: int, *order: Column | str, scan: tuple[int, int] | None = None) -> Page:
    """One row more than the page tells whether there are more; ``scan`` is (rows read, cap) of a bounded scan."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    cut = scan is not None and scan[0] >= scan[1]
    if len(rows) > limit:
        return Page(rows[:limit], "atLeast", limit + 1, "pageAndScanCapped" if cut else "pageCapped")
    return Page(rows, "atLeast", len(rows), "scanCapped") if cut else Page(rows, "exact", len(rows))


def scanned(df: DataFrame, limit: int, read: int, cap: int, *order: Column | str) -> Page:
    """Matches of a scan that read ``read`` rows under ``cap``: exact only if it ended before the cap."""
    n = df.count()
    items = df.orderBy(*order).limit(limit).collect()
    return Page(items, "exact", n) if read < cap else Page(items, "atLeast", n, "pageAndScanCapped" if n > limit else "scanCapped")
