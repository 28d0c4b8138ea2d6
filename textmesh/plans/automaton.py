"""A set of patterns as one automaton, and its vectorised scan.

A scan runs all start positions of a batch of texts in lock step: one array
holds the state of every start that is still alive, and each step reads the
next code unit of all of them.  States are sets of positions in the patterns,
made when they are first needed and kept from batch to batch; a full table is
cleared, and the sets that are alive are entered anew, so results never depend
on its size.

Whether an assertion holds depends only on the place in the text, so the three
facts about a place (line start, line end, word border) are part of the column
of the transition table.

Before the lock step, a table over the next few units' classes tells at which
places a match can begin at all.  A start keeps one best end for each pattern
and not its accepting visits; and starts that come to one state at one place
have the same future, so from `MEET` steps on a start ends where another one
went on from the same state after `MEET` steps, and takes over its ends.  A
state that most units lead back to itself, as that of `.+`, is left in one step
for the next place where it changes.  A match that runs to the end of a long
text thus costs no more than a few steps for each start.

With a budget of 0 no states are made: sets of positions advance as rows
(start, position), the plain simulation of the nondeterministic automaton.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np

from textmesh.plans import expr as E
from textmesh.plans import symbols as S
from textmesh.plans.errors import InputTooLarge, PatternSetTooLarge

MAX_POSITIONS = 2_000_000
#: Starts that advance together.
CHUNK = 1 << 18
#: Bytes of a transition table whose size isn't told.
TABLE_BYTES = 64 << 20
#: Steps from which starts that come to one state at one place go on as one.
MEET = 16
#: States whose runs are passed in one step, and lists of the places where such
#: a run ends that a scan makes, at most; the share of the starts from which,
#: and the step from which such a list is worth making, also for all places.
LOOPS, RUNS, RUNNING, LONG, SPARSE = 8, 32, 1 / 16, 32, 256
#: Cells (start, pattern) of a chunk whose ends are kept in one array.
DENSE_ENDS = 1 << 22
#: Visits that are held before they are reduced to the last for each start and pattern.
VISITS = 1 << 20
#: Units that the table of possible beginnings looks at, and its cells, at most.
DEPTH, CELLS = 5, 1 << 20
#: Work of making that table, in paths and in cells set.
PATHS, MARKS = 100_000, 1 << 23
#: Places that tell whether the table excludes enough, and the share admitted from which it doesn't.
SAMPLE, DENSE = 1 << 16, 0.5
#: Rows (start, position) that the plain simulation advances together.
ROWS = 1 << 22

#: What a scan counts: starts, those that a match can begin at, steps, places
#: read, transitions found in the table and not, plain steps of a row, states
#: and transitions made, clearings of the table, longest list of states, its
#: greatest bytes, places tested by the table of beginnings, scans that passed
#: it by as it excludes too little, starts that met another, accepting visits
#: and events.
COUNTERS = ["starts", "admitted_starts", "steps", "places_read", "cache_hits", "cache_misses", "fallback_transitions", "states_made", "transitions_made", "evictions", "peak_states", "retained_bytes", "masked_places", "mask_bypasses", "met_starts", "accepting_visits", "events"]
#: Counters of which the greatest counts, not the sum.
PEAKS = {"peak_states", "retained_bytes"}

_FACTS = {E.LINE_START: (1, 1), E.LINE_END: (2, 2), E.WORD_BOUNDARY: (4, 4), E.NOT_WORD_BOUNDARY: (4, 0)}
_IS_WORD = np.zeros(65536, bool)
for _lo, _hi in S.WORD:
    _IS_WORD[_lo : _hi + 1] = True


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... (n[i] of them) for every i."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _last(who: np.ndarray, ordinal: np.ndarray, end: np.ndarray):
    """The greatest end of each (who, ordinal), sorted by these."""
    if not len(who):
        return who, ordinal, end
    order = np.lexsort((end, ordinal, who))
    who, ordinal, end = who[order], ordinal[order], end[order]
    last = np.ones(len(who), bool)
    last[:-1] = (who[1:] != who[:-1]) | (ordinal[1:] != ordinal[:-1])
    return who[last], ordinal[last], end[last]


_NOTHING = tuple(np.zeros(0, np.int64) for _ in range(3))


class Ends:
    """Visits (start, patterns, end) of n starts, of which the last for each
    start and pattern are kept: in an array if the patterns are few."""

    def __init__(self, automaton: Automaton, n: int):
        self.expand, self.kept, self.new, self.size = automaton._expand, _NOTHING, [], 0
        self.ordinals, self.rank, self.n, self.best = automaton.ordinals, automaton.rank, n, None
        self.dense = n * len(self.ordinals) <= DENSE_ENDS

    def array(self) -> np.ndarray:
        """The last ends by start and pattern; 0: none."""
        if self.best is None:
            self.best = np.zeros(self.n * len(self.ordinals), np.int32)
        return self.best

    def empty(self) -> bool:
        return self.best is None and not self.new and not len(self.kept[0])

    def add(self, who: np.ndarray, accept: np.ndarray, end: np.ndarray) -> None:
        if len(who):
            self.put(*self.expand(who, accept, end))

    def put(self, who: np.ndarray, ordinal: np.ndarray, end: np.ndarray) -> None:
        """Of each start and pattern one visit in a call."""
        if self.dense:
            best, cell = self.array(), who * len(self.ordinals) + self.rank[ordinal]
            best[cell] = np.maximum(best[cell], end)
            return
        self.new.append((who, ordinal, end))
        self.size += len(who)
        if self.size > max(VISITS, len(self.kept[0])):
            self.get()

    def get(self):
        if self.dense:
            if self.best is None:
                return _NOTHING
            cell = np.flatnonzero(self.best)
            who, rank = np.divmod(cell, len(self.ordinals)) if len(self.ordinals) > 1 else (cell, np.zeros(len(cell), np.int64))
            return who, self.ordinals[rank], self.best[cell].astype(np.int64)
        if self.new:
            self.kept = _last(*(np.concatenate(x) for x in zip(self.kept, *self.new, strict=True)))
            self.new, self.size = [], 0
        return self.kept


class Meeting:
    """Where starts of the texts of a scan were after `MEET` steps, in which
    state, and the ends that they found later."""

    def __init__(self, n: int):
        self.n, self.state, self.owner, self.tails = n, None, None, _NOTHING

    def enter(self, start: np.ndarray, state: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Enters the starts, but those that meet another one: these are told."""
        if self.state is None:
            self.state, self.owner = np.full(self.n + 1, -1, np.int32), np.zeros(self.n + 1, np.int32)
        new = np.flatnonzero(self.state[pos] != state)
        self.owner[pos[new]] = start[new]
        new = new[self.owner[pos[new]] == start[new]]
        self.state[pos[new]] = state[new]
        return (self.state[pos] == state) & (self.owner[pos] != start)


class Places:
    """Columns of the transition table for the places of a batch of texts;
    worked out for all places at once if many starts are tried."""

    def __init__(self, automaton: Automaton, units: np.ndarray, rows: np.ndarray, starts: int):
        self.class_of, self.contexts, self.units, self.rows = automaton.class_of, automaton.contexts, units, rows
        self.all, self.used, self.runs, self.made = None, None, {}, 0
        if 8 * starts > len(units):
            self.whole()

    def whole(self) -> np.ndarray:
        """The columns of all places."""
        if self.all is None:
            units, self.all = self.units, np.empty(len(self.units), np.int32)
            for lo in range(0, len(units), SAMPLE):
                hi = min(len(units), lo + SAMPLE)
                self.all[lo:hi] = self._made(np.arange(lo, hi)) if self.contexts > 1 else np.take(self.class_of, units[lo:hi], mode="clip")
        return self.all

    def columns(self) -> np.ndarray:
        """The columns that some place has."""
        if self.used is None:
            self.used = np.flatnonzero(np.bincount(self.whole()))
        return self.used

    def run_ends(self, state: int, stays: np.ndarray) -> np.ndarray:
        """The places of columns with which a state doesn't stay, and the end."""
        if state not in self.runs:
            every, out = self.whole(), []
            for lo in range(0, len(every), SAMPLE):
                out.append(lo + np.flatnonzero(~stays[every[lo : lo + SAMPLE]]))
            self.runs[state] = np.concatenate((*out, [len(every)]))
            self.made += 1
        return self.runs[state]

    def limit(self, at: np.ndarray) -> np.ndarray:
        """The ends of the texts of places."""
        return self.rows[np.searchsorted(self.rows, at, side="right")]

    def column(self, at: np.ndarray) -> np.ndarray:
        return self.all[at] if self.all is not None else self._made(at)

    def _made(self, at: np.ndarray) -> np.ndarray:
        unit = self.units[at]
        kind = self.class_of[unit].astype(np.int32)
        if self.contexts == 1:
            return kind
        end = self.rows[np.searchsorted(self.rows, at, side="right")] == at + 1
        follower = np.where(end, 0x0A, self.units[np.minimum(at + 1, len(self.units) - 1)])
        border = _IS_WORD[unit] != (_IS_WORD[follower] & ~end)
        return kind * self.contexts + (unit == 0x0A) + ((follower == 0x0A).astype(np.int32) << 1) + (border.astype(np.int32) << 2)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The facts about places that are starts."""
        first = self.rows[np.searchsorted(self.rows, at, side="right") - 1] == at
        earlier = np.where(first, 0x0A, self.units[np.maximum(at - 1, 0)])
        border = _IS_WORD[self.units[at]] != (_IS_WORD[earlier] & ~first)
        return (earlier == 0x0A).astype(np.int32) | (border.astype(np.int32) << 2)


class Automaton:
    """Patterns (ordinal, tree), without or with assertions."""

    def __init__(self, trees: list[tuple[int, tuple]], budget: int | None = None, limit: int = MAX_POSITIONS):
        self.limit = limit
        # of each position: its set (-1: none) and the next position; few have jumps (fact, position)
        self.set_of, self.next = array("i"), array("i")
        self.jumps: dict[int, list[tuple[tuple[int, int] | None, int]]] = {}
        self.ends: dict[int, int] = {}
        self.sets: dict[S.Ranges, int] = {}
        self.root = self._new()
        old = sys.getrecursionlimit()
        sys.setrecursionlimit(max(old, 20_000))
        try:
            for ordinal, tree in trees:
                last = self._new()
                self.ends[last] = ordinal
                first = self._add(tree, last)
                if first is not None:
                    self.jumps.setdefault(self.root, []).append((None, first))
        finally:
            sys.setrecursionlimit(old)
        self.facts = any(E.assertions(t) for _, t in trees)
        # the patterns that may have ends, and their places in this order
        self.ordinals = np.array(sorted(self.ends.values()), np.int64)
        self.rank = np.zeros(int(self.ordinals[-1]) + 1, np.int64)
        self.rank[self.ordinals] = np.arange(len(self.ordinals))
        self.accept_sets: list[np.ndarray] = [np.zeros(0, np.int64)]
        self._accept_of: dict[tuple, int] = {(): 0}
        self._sizes, self._plain = np.zeros(0, np.int64), None
        self._classify()
        self.budget = max(8192, TABLE_BYTES // (4 * self.width)) if budget is None else budget
        self.filter_starts = True
        self.counters = dict.fromkeys(COUNTERS, 0)
        self._reset()

    # construction

    def _new(self) -> int:
        if len(self.set_of) >= self.limit:
            raise PatternSetTooLarge(self.limit)
        self.set_of.append(-1)
        self.next.append(-1)
        return len(self.set_of) - 1

    def _add(self, tree, after: int) -> int | None:
        """First position of tree, which goes on at `after`; None: no match."""
        kind = tree[0]
        if kind == "empty":
            return after
        if kind == "never" or (kind == "set" and not tree[1]):
            return None
        if kind == "set":
            at = self._new()
            self.set_of[at], self.next[at] = self.sets.setdefault(tree[1], len(self.sets)), after
            return at
        if kind == "assert":
            at = self._new()
            self.jumps[at] = [(_FACTS[tree[1]], after)]
            return at
        if kind == "seq":
            for item in reversed(tree[1]):
                after = self._add(item, after)
                if after is None:
                    return None
            return after
        if kind == "alt":
            heads = [h for x in tree[1] if (h := self._add(x, after)) is not None]
            return self._fork(heads)
        _, item, least, most = tree
        if most is None:
            loop = self._new()
            head = self._add(item, loop)
            self.jumps[loop] = [(None, after)] + ([(None, head)] if head is not None else [])
            after, most = loop, least
        for k in range(most, 0, -1):
            head = self._add(item, after)
            if k > least:
                after = self._fork([x for x in (head, after) if x is not None])
            elif head is None:
                return None
            else:
                after = head
        return after

    def _fork(self, heads: list[int]) -> int | None:
        if len(heads) < 2:
            return heads[0] if heads else None
        at = self._new()
        self.jumps[at] = [(None, h) for h in heads]
        return at

    def _classify(self) -> None:
        """Units that no set tells apart share a class."""
        cuts = sorted({0, *(x for s in self.sets for lo, hi in s for x in (lo, hi + 1) if x <= S.LAST)})
        index = {c: i for i, c in enumerate(cuts)}
        members: list[list[int]] = [[] for _ in cuts]
        for s, k in self.sets.items():
            for lo, hi in s:
                for i in range(index[lo], index.get(hi + 1, len(cuts))):
                    members[i].append(k)
        kinds: dict[tuple, int] = {}
        of_cut = [kinds.setdefault(tuple(m), len(kinds)) for m in members]
        self.class_of = np.array(of_cut, np.uint8 if len(kinds) <= 256 else np.int32)[np.searchsorted(cuts, np.arange(S.LAST + 1), side="right") - 1]
        self.in_set = np.zeros((max(1, len(self.sets)), len(kinds)), bool)
        for m, k in kinds.items():
            self.in_set[list(m), k] = True
        # classes with which a match can begin, whatever the place
        heads = {self.set_of[p] for context in (range(8) if self.facts else (0,)) for p in self._closure([self.root], context)} - {-1}
        self.first_classes = self.in_set[sorted(heads)].any(axis=0) if heads else np.zeros(len(kinds), bool)
        self.contexts = 8 if self.facts else 1
        self.width = len(kinds) * self.contexts
        self._plan_beginnings(len(kinds))

    def _plan_beginnings(self, kinds: int) -> None:
        """A table over the classes of the next `depth` units: whether a match
        can begin with them.  Assertions are taken to hold."""
        most = max([d for d in range(1, DEPTH + 1) if kinds**d <= CELLS], default=1)
        done, level, best = [], {(): self._closure([self.root], None)}, None
        sizes = self.in_set.sum(axis=1)
        for depth in range(1, most + 1):
            after: dict[tuple, set] = {}
            for path, at in level.items():
                for p in at:
                    k, to = self.set_of[p], self.next[p]
                    if k >= 0:
                        after.setdefault((*path, k), set()).add(to)
            if len(done) + len(after) > PATHS:
                break
            level = {}
            for path, seeds in after.items():
                at = self._closure(seeds, None)
                if any(p in self.ends for p in at):
                    done.append(path)
                elif at:
                    level[path] = at
            paths = [*done, *level]
            if sum(int(np.prod(sizes[list(x)])) * kinds ** (depth - len(x)) for x in paths) > MARKS:
                break
            best = depth, paths
        self.depth, self.near, self.beginnings = 0, 0, None
        if best is not None:
            self.depth, paths = best
            self.beginnings = np.zeros((kinds,) * self.depth, bool)
            members = [np.flatnonzero(row) for row in self.in_set]
            for path in paths:
                self.beginnings[np.ix_(*(members[k] for k in path), *[np.arange(kinds)] * (self.depth - len(path)))] = True
            # the same over fewer units, for keys of 16 bits
            self.near = max([k for k in range(1, self.depth + 1) if kinds**k <= 1 << 16], default=0)
            self.near_beginnings = self.beginnings.any(axis=tuple(range(self.near, self.depth))).ravel()
            self.beginnings = self.beginnings.ravel()
            if not self.near:
                self.depth = 0

    # lazy states

    def _reset(self) -> None:
        self.table = np.full((64, self.width), -1, np.int32)
        self.state_sets: list[tuple[int, ...]] = []
        self.index: dict[tuple[int, ...], int] = {}
        self.accept = np.zeros(64, np.int32)
        self.seeds: dict[int, int] = {}
        self.loops: dict[int, int] = {}
        self._intern(())

    def __getstate__(self):
        kept = dict(self.__dict__)
        kept["sets"] = {}  # needed to build only
        for name in ("table", "state_sets", "index", "accept", "seeds", "loops", "_plain"):
            kept.pop(name)
        return kept

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._plain = None
        self._reset()

    def _closure(self, seeds, context: int | None) -> tuple[int, ...]:
        """context None: all assertions hold."""
        seen, stack = set(seeds), list(seeds)
        while stack:
            for fact, to in self.jumps.get(stack.pop(), ()):
                if to not in seen and (fact is None or context is None or context & fact[0] == fact[1]):
                    seen.add(to)
                    stack.append(to)
        return tuple(sorted(p for p in seen if self.set_of[p] >= 0 or p in self.ends))

    def _intern(self, positions: tuple[int, ...]) -> int:
        at = self.index.get(positions)
        if at is None:
            at = self.index[positions] = len(self.state_sets)
            self.state_sets.append(positions)
            self.counters["states_made"] += 1
            self.counters["peak_states"] = max(self.counters["peak_states"], len(self.state_sets))
            if at >= len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
                self.accept = np.concatenate((self.accept, np.zeros_like(self.accept)))
            ends = tuple(sorted(self.ends[p] for p in positions if p in self.ends))
            if ends not in self._accept_of:
                self._accept_of[ends] = len(self.accept_sets)
                self.accept_sets.append(np.array(ends, np.int64))
            self.accept[at] = self._accept_of[ends]
            if not positions:
                self.table[at] = 0
        return at

    def _seed(self, context: int) -> int:
        if context not in self.seeds:
            self.seeds[context] = self._intern(self._closure([self.root], context))
        return self.seeds[context]

    def _advance(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        new = self.table[state, column]
        unknown = np.flatnonzero(new < 0)
        if len(unknown):
            self.counters["cache_misses"] += len(unknown)
            pair = np.unique(state[unknown].astype(np.int64) * self.width + column[unknown])
            for p in pair.tolist():
                s, c = divmod(p, self.width)
                kind, context = divmod(c, self.contexts)
                member = self.in_set[:, kind]
                to = {self.next[q] for q in self.state_sets[s] if self.set_of[q] >= 0 and member[self.set_of[q]]}
                self.table[s, c] = self._intern(self._closure(to, context) if to else ())
            self.counters["transitions_made"] += len(pair)
            new[unknown] = self.table[state[unknown], column[unknown]]
        self.counters["cache_hits"] += len(new) - len(unknown)
        return new

    def _evict(self, live: np.ndarray) -> np.ndarray:
        used, at = np.unique(live, return_inverse=True)
        sets = [self.state_sets[s] for s in used]
        self.counters["evictions"] += 1
        self.counters["retained_bytes"] = max(self.counters["retained_bytes"], self.table.nbytes)
        self._reset()
        return np.array([self._intern(s) for s in sets], np.int32)[at] if len(used) else live

    def _find_loops(self, stayed: np.ndarray) -> None:
        """States that many starts stay in are passed in runs from now on."""
        state, n = np.unique(stayed, return_counts=True)
        for k in np.argsort(-n)[:LOOPS].tolist():
            if len(self.loops) < LOOPS and n[k] * LOOPS >= len(stayed):
                self.loops.setdefault(int(state[k]), len(self.loops))

    def _pass_runs(self, state, me, pos, limit, places, step: int) -> np.ndarray:
        """The places at which the starts leave their states, or their texts end."""
        for s in self.loops:
            at = np.flatnonzero(state == s)
            if not len(at):
                continue
            if s not in places.runs:
                if places.made >= RUNS or (places.all is None and step < SPARSE) or (step < LONG and len(at) < RUNNING * len(limit)):
                    continue
                used = places.columns()
                unknown = used[self.table[s, used] < 0]
                self._advance(np.full(len(unknown), s), unknown)
            ends = places.run_ends(s, self.table[s] == s)
            pos[at] = np.minimum(ends[np.searchsorted(ends, pos[at])], limit[me[at]])
        return pos

    # scan

    def scan(self, units: np.ndarray, rows: np.ndarray, lo: int = 0, hi: int | None = None, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, ordinal, end) of the longest match of each pattern at each
        start; rows: offsets of the texts in units; lo, hi: bounds of starts; only:
        a mask of the starts that need be tried."""
        out = [*self.scan_chunks(units, rows, lo, hi, only)][::-1]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _NOTHING

    def scan_chunks(self, units: np.ndarray, rows: np.ndarray, lo: int = 0, hi: int | None = None, only: np.ndarray | None = None):
        """As scan, in parts from the last to the first; what the caller takes
        from `only` in between isn't tried any more."""
        n = len(units)
        if n >= 1 << 31:
            raise InputTooLarge
        hi = n if hi is None else hi
        if n == 0 or lo >= hi:
            return
        may = self._admitted(units)
        places = Places(self, units, rows, n if may is None else len(may))
        meeting = Meeting(n)
        first, last = (lo, hi) if may is None else np.searchsorted(may, (lo, hi)).tolist()
        self.counters["starts"] += hi - lo
        for b in range(last, first, -CHUNK):
            a = max(first, b - CHUNK)
            start = np.arange(a, b) if may is None else may[a:b]
            if only is not None:
                start = start[only[start]]
            self.counters["admitted_starts"] += len(start)
            got = self._chunk_plain(start, places) if self.budget == 0 else self._chunk(start, places, meeting)
            self.counters["events"] += len(got[0])
            yield got
        self.counters["retained_bytes"] = max(self.counters["retained_bytes"], self.table.nbytes)

    def _admitted(self, units: np.ndarray) -> np.ndarray | None:
        """The places where a match can begin; None: all may.  A small table
        over fewer units leaves out most places before the other is asked."""
        if not self.filter_starts:
            return None
        n, d, near, kinds = len(units), self.depth, self.near, len(self.first_classes)
        out = []
        for lo in range(0, n, SAMPLE):  # parts that stay in the processor's cache
            hi = min(n, lo + SAMPLE)
            kind = np.take(self.class_of, units[lo : hi + max(0, d - 1)], mode="clip")
            if d < 2:
                out.append(lo + np.flatnonzero(self.first_classes[kind]))
                continue
            if len(kind) < hi - lo + d - 1:
                kind = np.concatenate((kind, np.zeros(hi - lo + d - 1 - len(kind), kind.dtype)))
            key = kind[: hi - lo].astype(np.uint16)
            for k in range(1, near):
                key *= np.uint16(kinds)
                key += kind[k : hi - lo + k].astype(np.uint16)
            at = np.flatnonzero(np.take(self.near_beginnings, key, mode="clip"))
            if d > near:
                key = key[at].astype(np.int32)
                for k in range(near, d):
                    key = key * np.int32(kinds) + kind[at + k]
                at = at[np.take(self.beginnings, key, mode="clip")]
            if not lo and len(at) > DENSE * hi:
                self.counters["mask_bypasses"] += 1
                d, at = 1, np.flatnonzero(self.first_classes[kind[:hi]])
            out.append(lo + at)
        if d > 1:
            self.counters["masked_places"] += n
        return np.concatenate(out)

    def _expand(self, who, accept, end):
        """A row for each pattern of the accepting sets."""
        if len(self._sizes) < len(self.accept_sets):
            self._sizes = np.array([len(s) for s in self.accept_sets])
            self._flat = np.concatenate(self.accept_sets)
            self._begin = np.cumsum(self._sizes) - self._sizes
        n = self._sizes[accept]
        if (n == 1).all():
            return who, self._flat[self._begin[accept]], end
        which = np.repeat(np.arange(len(accept)), n)
        return who[which], self._flat[_spread(self._begin[accept], n)], end[which]

    def _chunk(self, start, places, meeting):
        limit = places.limit(start)
        if not self.facts:
            state = np.full(len(start), self._seed(0), np.int32)
        else:
            context = places.before(start)
            seeds = np.zeros(8, np.int32)
            for c in np.unique(context):
                seeds[c] = self._seed(int(c))
            state = seeds[context]
        pos, me = start, np.arange(len(start))
        # of each start: the patterns and the end of its last visit
        at, end = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        ends, heads, link, step = Ends(self, len(start)), None, None, 0
        while len(pos):
            step += 1
            self.counters["steps"] += 1
            self.counters["places_read"] += len(pos)
            old, state = state, self._advance(state, places.column(pos))
            live = np.flatnonzero(state)
            if step & (step - 1) == 0 and step > 1 and len(self.loops) < LOOPS and len(stayed := np.flatnonzero((state == old) & (state != 0))) * 8 > len(live):
                self._find_loops(state[stayed])
            state, me, pos = state[live], me[live], pos[live] + 1
            if self.loops:
                pos = self._pass_runs(state, me, pos, limit, places, step)
            accept = self.accept[state]
            hit = np.flatnonzero(accept)
            if len(hit):
                who, what = me[hit], accept[hit]
                was = at[who]
                other = np.flatnonzero((was != 0) & (was != what))
                ends.add(who[other], was[other], end[who[other]])
                at[who], end[who] = what, pos[hit]
                self.counters["accepting_visits"] += len(hit)
            more = np.flatnonzero(pos < limit[me])
            state, me, pos = state[more], me[more], pos[more]
            if len(self.state_sets) > self.budget + 1:
                state = self._evict(state)
                places.runs.clear()
                if meeting.state is not None:
                    meeting.state[:] = -1
            if step >= MEET and len(pos):
                if step == MEET:
                    some = np.flatnonzero(at)
                    ends.add(some, at[some], end[some])
                    heads, ends, link = ends, Ends(self, len(start)), np.full(len(start), -1, np.int64)
                    at[:] = 0
                    met = meeting.enter(start[me], state, pos)
                else:
                    met = meeting.state[pos] == state
                if met.any():
                    link[me[met]] = meeting.owner[pos[met]]
                    self.counters["met_starts"] += int(met.sum())
                    state, me, pos = state[~met], me[~met], pos[~met]
        some = np.flatnonzero(at)
        if heads is None and ends.empty():
            return self._expand(start[some], at[some], end[some])
        ends.add(some, at[some], end[some])
        if heads is None:
            who, ordinal, end = ends.get()
            return start[who], ordinal, end
        if ends.dense:
            self._take_over_dense(start, link, ends, meeting)
            who, ordinal, end = ends.get()
        else:
            who, ordinal, end = self._take_over(start, link, *ends.get(), meeting)
        meeting.tails = tuple(np.concatenate(x) for x in zip((start[who], ordinal, end), meeting.tails, strict=True))
        if ends.dense:
            np.maximum(heads.array(), ends.array(), out=heads.array())
            who, ordinal, end = heads.get()
        else:
            who, ordinal, end = _last(*(np.concatenate(x) for x in zip(heads.get(), (who, ordinal, end), strict=True)))
        return start[who], ordinal, end

    @staticmethod
    def _take_over_dense(start, link, ends, meeting):
        """As `_take_over`, where the ends are in an array."""
        far = np.flatnonzero(link > start[-1])
        if len(far):
            owner = meeting.tails[0]
            lo = np.searchsorted(owner, link[far])
            n = np.searchsorted(owner, link[far], side="right") - lo
            at = _spread(lo, n)
            ends.put(np.repeat(far, n), meeting.tails[1][at], meeting.tails[2][at])
        best = ends.array().reshape(len(start), -1)
        to = np.where((link >= 0) & (link <= start[-1]), np.searchsorted(start, link), -1)
        while (some := np.flatnonzero(to >= 0)).size:
            best[some] = np.maximum(best[some], best[to[some]])
            to[some] = to[to[some]]

    @staticmethod
    def _take_over(start, link, who, ordinal, end, meeting):
        """The ends of every start with those of the starts that it met: of a
        later chunk's, which are known, and along the links inside the chunk,
        which double in length in every round."""

        def of(owner, src, dst):
            lo, hi = np.searchsorted(owner, dst), np.searchsorted(owner, dst, side="right")
            return np.repeat(src, hi - lo), _spread(lo, hi - lo)

        far = np.flatnonzero(link > start[-1])
        if len(far):
            src, at = of(meeting.tails[0], far, link[far])
            who, ordinal, end = _last(np.concatenate((who, src)), np.concatenate((ordinal, meeting.tails[1][at])), np.concatenate((end, meeting.tails[2][at])))
        near = (link >= 0) & (link <= start[-1])
        to = np.where(near, np.searchsorted(start, link), -1)
        while (some := np.flatnonzero(to >= 0)).size:
            src, at = of(who, some, to[some])
            who, ordinal, end = _last(np.concatenate((who, src)), np.concatenate((ordinal, ordinal[at])), np.concatenate((end, end[at])))
            to[some] = to[to[some]]
        return who, ordinal, end

    # without states

    def _plain_tables(self):
        """Of each position: its set; of each position and context, the
        positions that reading it leads to; the same of the root."""
        if self._plain is None:
            sets = np.array(self.set_of)
            ordinal = np.full(len(sets), -1, np.int64)
            ordinal[list(self.ends)] = list(self.ends.values())
            after = [self._closure([to], c) if k >= 0 else () for k, to in zip(self.set_of, self.next, strict=True) for c in range(self.contexts)]
            roots = [np.array([p for p in self._closure([self.root], c) if self.set_of[p] >= 0], np.int64) for c in range(self.contexts)]
            size = np.array([len(x) for x in after])
            flat = np.array([p for x in after for p in x], np.int64)
            self._plain = sets, ordinal, np.cumsum(size) - size, size, flat, roots
        return self._plain

    def _chunk_plain(self, start, places):
        roots = self._plain_tables()[-1]
        each = max(1, ROWS // max(1, max(map(len, roots))))
        out = [self._plain_part(start[lo : lo + each], places) for lo in range(0, len(start), each)]
        return tuple(np.concatenate(x) for x in zip(_NOTHING, *out, strict=True))

    def _plain_part(self, start, places):
        sets, ordinal, begin, size, flat, roots = self._plain_tables()
        n = np.array([len(r) for r in roots])
        context = places.before(start).astype(np.int64) if self.facts else np.zeros(len(start), np.int64)
        limit = places.limit(start)
        who = np.repeat(np.arange(len(start)), n[context])
        at = np.concatenate(roots)[_spread((np.cumsum(n) - n)[context], n[context])]
        ends, pos = Ends(self, len(start)), start.copy()
        while len(who):
            self.counters["steps"] += 1
            self.counters["fallback_transitions"] += len(who)
            kind, context = np.divmod(places.column(pos[who]), self.contexts)
            ok = self.in_set[sets[at], kind]
            who, cell = who[ok], at[ok] * self.contexts + context[ok]
            pos += 1
            k = size[cell]
            pair = np.unique(np.repeat(who, k) * len(sets) + flat[_spread(begin[cell], k)])
            who, at = np.divmod(pair, len(sets))
            hit = np.flatnonzero(ordinal[at] >= 0)
            if len(hit):
                self.counters["accepting_visits"] += len(hit)
                ends.put(who[hit], ordinal[at[hit]], pos[who[hit]])
            on = (sets[at] >= 0) & (pos[who] < limit[who])
            who, at = who[on], at[on]
        who, found, end = ends.get()
        return start[who], found, end
