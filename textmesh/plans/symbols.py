"""Sets of UTF-16 code units, and the case table.

A set is a sorted tuple of disjoint, non-adjacent inclusive ranges.
"""

from __future__ import annotations

from functools import cache

import numpy as np

Ranges = tuple[tuple[int, int], ...]
LAST = 0xFFFF
EMPTY: Ranges = ()
ANY: Ranges = ((0, LAST),)
DIGIT: Ranges = ((0x30, 0x39),)
WORD: Ranges = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
#: Tab, line feed, vertical tab, form feed, carriage return; space.
SPACE: Ranges = ((0x09, 0x0D), (0x20, 0x20))


def union(*sets: Ranges) -> Ranges:
    out: list[list[int]] = []
    for lo, hi in sorted(r for s in sets for r in s):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def complement(s: Ranges) -> Ranges:
    edges = [-1, *(x for r in s for x in r), LAST + 1]
    return tuple((a + 1, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if a + 1 <= b - 1)


def contains(s: Ranges, unit: int) -> bool:
    return any(lo <= unit <= hi for lo, hi in s)


@cache
def case_table() -> np.ndarray:
    """uint16[65536, 2]: lower and upper case of each code unit, one to one
    and without locale.  Where Python maps to several units, or out of the
    basic plane, a unit stays as it is, but for the fixed cases below."""
    t = np.empty((LAST + 1, 2), np.uint16)
    for unit in range(LAST + 1):
        for k, mapped in enumerate((chr(unit).lower(), chr(unit).upper())):
            t[unit, k] = ord(mapped) if len(mapped) == 1 and ord(mapped) <= LAST else unit
    t[0x130, 0] = 0x69
    for lo in (0x1F80, 0x1F90, 0x1FA0):  # Greek with iota below: the title-case letter
        t[lo : lo + 8, 1] = np.arange(lo + 8, lo + 16)
    for unit, title in ((0x1FB3, 0x1FBC), (0x1FC3, 0x1FCC), (0x1FF3, 0x1FFC)):
        t[unit, 1] = title
    return t


def cases(unit: int) -> tuple[int, int]:
    lower, upper = case_table()[unit]
    return int(lower), int(upper)


def fold_literal(unit: int) -> Ranges:
    """What a literal matches without regard to case: both cases, and the unit
    itself only if it has no case."""
    lower, upper = cases(unit)
    return union(((lower, lower),), ((upper, upper),)) if lower != upper else ((unit, unit),)


def fold_member(unit: int) -> Ranges:
    """What a class member adds: itself and both cases."""
    return union(*(((u, u),) for u in (unit, *cases(unit))))


def fold_range(lo: int, hi: int) -> Ranges | None:
    """What a class range adds; None if a mapped range is reversed."""
    out = [((lo, hi),)]
    (l1, u1), (l2, u2) = cases(lo), cases(hi)
    if l1 != u1 and l2 != u2:
        for a, b in ((l1, l2), (u1, u2)):
            if a > b:
                return None
            out.append(((a, b),))
    return union(*out)
