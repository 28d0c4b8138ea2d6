"""A plain interpreter of expression trees, for tests: slow and direct."""

from __future__ import annotations

from textmesh.plans import expr as E
from textmesh.plans import symbols as S


def _word(units, at: int) -> bool:
    return 0 <= at < len(units) and S.contains(S.WORD, units[at])


def _holds(kind: str, units, at: int, start: int) -> bool:
    if kind == E.LINE_START:
        return at == 0 or units[at - 1] == 10
    if kind == E.LINE_END:
        return at > start and (at == len(units) or units[at] == 10)
    border = _word(units, at - 1) != _word(units, at)
    return border == (kind == E.WORD_BOUNDARY)


def _ends(tree, units, at: int, start: int) -> set[int]:
    kind = tree[0]
    if kind == "never":
        return set()
    if kind == "empty":
        return {at}
    if kind == "assert":
        return {at} if _holds(tree[1], units, at, start) else set()
    if kind == "set":
        return {at + 1} if at < len(units) and S.contains(tree[1], units[at]) else set()
    if kind == "alt":
        return set().union(*(_ends(x, units, at, start) for x in tree[1]))
    if kind == "seq":
        now = {at}
        for x in tree[1]:
            now = set().union(*(_ends(x, units, p, start) for p in now)) if now else set()
        return now
    _, item, least, most = tree
    now = {at}
    for _ in range(least):
        now = set().union(*(_ends(item, units, p, start) for p in now)) if now else set()
    out, k = set(now), least
    while now and (most is None or k < most):
        now = set().union(*(_ends(item, units, p, start) for p in now)) - out
        out |= now
        k += 1
    return out


def find(patterns, units) -> list[tuple[int, int, int]]:
    """patterns: (id, tree).  Sorted (id, start, end)."""
    out = []
    for pattern_id, tree in patterns:
        for start in range(len(units)):
            end = max(_ends(tree, units, start, start), default=start)
            if end > start:
                out.append((pattern_id, start, end))
    return sorted(out)
