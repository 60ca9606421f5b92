"""Spans of code points in a text: their order, their written form and their digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[int, int, str]


def ordered(spans: Iterable[Span], kinds: list[str]) -> list[Span]:
    """By start, then by the kinds' order."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1]))


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def without_overlap(extra: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """Spans of ``extra``, longest first, that overlap neither ``taken`` nor one another.

    Both lists are merged in order of position, so long texts with many spans stay cheap.
    """
    used = sorted((s, e) for s, e, _ in taken)
    kept: list[Span] = []
    at, last = 0, -1
    for span in sorted(extra, key=lambda s: (s[0], -(s[1] - s[0]), s[2])):
        while at < len(used) and used[at][1] <= span[0]:
            at += 1
        if span[0] >= last and not (at < len(used) and used[at][0] < span[1]):
            kept.append(span)
            last = span[1]
    return kept
