"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Texts are cut before every run of spaces (no piece of the model goes on past
one), distinct words of a batch are grouped by length, and all words of one
length advance together: at each position the hashes of the substrings that
end there probe the sorted keys of the pieces, and vectorised maxima over the
pieces' values store backpointers.  A process remembers the ids of the words
it has met, up to `MEMORY` ids, and searches only for new ones; words are told
apart by 64 bits of hash.

For a unigram model the value of a path is the sum of its pieces' scores.  For
a BPE model that sum is not what merging gives, so an edge of the lattice is
open only if its piece is compatible with the last piece of the path it
extends: two neighbours are compatible if no merge over their border comes
before the merges inside them.  Exactly one path of compatible pieces leads to
each position, and it is the result of merging.  A word of more than `LONG`
characters is searched in overlapping blocks of one length that advance
together, and put together where neighbouring blocks agree.  Runs of several
spaces, whose pieces some models score out of order, and long words whose
blocks don't come to agree are merged with a heap; the ids are the same.

Characters without a piece become byte pieces, or the unknown id where the
model has none.  Only models with the identity normaliser are accepted.

Defined results: null and empty texts have no ids; U+2581 is read as a space,
as the format defines; decoding skips control pieces, and bytes that form no
UTF-8 become U+FFFD; decoding null gives null; other columns are kept.  Memory is bounded by the
batch step and the longest text.
"""

from __future__ import annotations

import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmesh.llm.common import batches, mix64, powers, run_hashes, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
STEP_BYTES = 2 << 20
#: Longer words of BPE models are merged with a heap.
LONG = 96
#: Ids that a process remembers of words met before.
MEMORY = 1 << 22
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
SPACE = 0x2581
_NO_CHARACTER = 0x110000

_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _fields(b: bytes):
    """(number, value) of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        r = s = 0
        while True:
            c = b[i]
            i += 1
            r |= (c & 127) << s
            s += 7
            if c < 128:
                return r

    while i < len(b):
        t = varint()
        kind = t & 7
        if kind == 0:
            yield t >> 3, varint()
        elif kind == 2:
            n = varint()
            yield t >> 3, b[i : i + n]
            i += n
        elif kind == 5:
            yield t >> 3, struct.unpack_from("<f", b, i)[0]
            i += 4
        elif kind == 1:
            i += 8
        else:
            raise ValueError("not a SentencePiece model")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _hash(codes: np.ndarray) -> int:
    h = (codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(codes))
    return int(mix64(np.array([h.sum(dtype=np.uint64) + np.uint64(len(codes))]))[0])


class Model:
    """A parsed model, with the tables of the search."""

    def __init__(self, blob: bytes):
        self.pieces, self.scores, self.types = [], [], []
        kind, prefix, extra, name, charsmap, self.unk = UNIGRAM, True, True, b"identity", b"", 0
        self.byte_fallback = False
        for f, v in _fields(blob):
            if f == 1:
                p = dict(_fields(v))
                self.pieces.append(p[1].decode())
                self.scores.append(p.get(2, 0.0))
                self.types.append(p.get(3, NORMAL))
            elif f == 2:
                t = dict(_fields(v))
                kind, self.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
            elif f == 3:
                n = dict(_fields(v))
                name, charsmap, prefix, extra = n.get(1, b""), n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1))
        if kind not in (UNIGRAM, BPE) or charsmap or extra or name not in (b"identity", b""):
            raise ValueError("only unigram and BPE models with the identity normaliser that keep white space are read")
        if any("▁" in p.lstrip("▁") for p in self.pieces) or USER in self.types:
            raise ValueError("pieces over several words aren't supported")
        self.kind, self.prefix = kind, prefix
        self.merged = 0  # characters that were merged with a heap
        self.unk = self.types.index(UNKNOWN)
        usable = [i for i, t in enumerate(self.types) if t == NORMAL]
        self.index = {self.pieces[i]: i for i in usable}
        self.bytes_ids = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int32) if self.byte_fallback else None
        n = len(self.pieces)
        self.score = np.array(self.scores, np.float64)
        if kind == BPE:
            self._merge_tables(usable)
            usable = [i for i in usable if self.reached[i]]
        keys = np.array([_hash(_codes(self.pieces[i])) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(usable, np.int32)[order]
        if len(keys) and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace("▁", " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        low = min((self.scores[i] for i in usable), default=0.0)
        self.unk_score = low - 10.0
        self.n = n

    def _merge_tables(self, usable: list[int]) -> None:
        """Ranks, merge trees' borders and the sorted table of mergeable pairs."""
        n = len(self.pieces)
        self.rank = np.full(n + 2, np.inf)
        values = sorted({-self.scores[i] for i in usable})
        at = {v: k for k, v in enumerate(values)}
        for i in usable:
            self.rank[i] = at[-self.scores[i]]
        pairs = {}
        for i in usable:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.index.get(p[:k]), self.index.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = pairs
        key = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_keys, self.pair_ids = key[order], np.array(list(pairs.values()), np.int32)[order]
        # the last merge of each piece that merging its own characters gives
        self.reached = np.zeros(n, bool)
        parts: dict[int, tuple[int, int]] = {}
        for i in usable:
            p = self.pieces[i]
            if len(p) == 1:
                self.reached[i] = True
                continue
            made, last = self._merge([self.index.get(c, -1) for c in p])
            if made == [i]:
                self.reached[i] = True
                parts[i] = last
        # borders: the nodes of a piece's tree at its right (left) end, each with the rank that ends it
        right, left = [], []
        for i in range(n):
            r, l = [(i, np.inf)], [(i, np.inf)]
            while r[-1][0] in parts:
                r.append((parts[r[-1][0]][1], self.rank[r[-1][0]]))
            while l[-1][0] in parts:
                l.append((parts[l[-1][0]][0], self.rank[l[-1][0]]))
            right.append(r)
            left.append(l)
        # n: a character without piece, n + 1: nothing; neither merges
        right += [[(-1, -1.0)]] * 2
        left += [[(-1, -1.0)]] * 2

        def table(rows):
            d = max(map(len, rows))
            ids, ends = np.full((d, len(rows)), -1, np.int64), np.full((d, len(rows)), -1.0)
            for i, row in enumerate(rows):
                for k, (x, e) in enumerate(row):
                    ids[k, i], ends[k, i] = x, e
            return ids, ends

        self.right, self.left = table(right), table(left)

    def _merge(self, ids: list[int]) -> tuple[list[int], tuple[int, int]]:
        """Merging by a heap: best score first, then the leftmost pair."""
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ids, heap, last = list(ids), [], (-1, -1)

        def offer(i):
            if i >= 0 and nxt[i] < len(ids) and (z := self.pairs.get((ids[i], ids[nxt[i]]))) is not None:
                heapq.heappush(heap, (-self.scores[z], i, z, ids[i], ids[nxt[i]]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, z, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], last = z, -2, (a, b)
            nxt[i] = nxt[j]
            if nxt[j] < len(ids):
                prv[nxt[j]] = i
            offer(prv[i])
            offer(i)
        return [x for x in ids if x != -2], last

    def prepare(self) -> Model:
        """Per process: a direct-mapped memory of tested neighbours, and the ids
        of words met before, sorted by hash."""
        self.seen = np.full(1 << 20, -1, np.int64)
        self.fits = np.zeros(1 << 20, bool)
        self._forget()
        return self

    def _forget(self) -> None:
        self.met, self.met_at, self.met_n, self.met_ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def remembered(self, h: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, number, flat ids) of distinct words, sorted by hash."""
        at = np.minimum(np.searchsorted(self.met, h), max(len(self.met) - 1, 0))
        new = self.met[at] != h if len(self.met) else np.ones(len(h), bool)
        place, number = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        place[~new], number[~new] = self.met_at[at[~new]], self.met_n[at[~new]]
        unknown = np.flatnonzero(new)
        if not len(unknown):
            return place, number, self.met_ids
        number[unknown], ids = self.words(codes, start[unknown], size[unknown])
        place[unknown] = len(self.met_ids) + np.cumsum(number[unknown]) - number[unknown]
        flat = np.concatenate((self.met_ids, ids))
        if len(flat) > MEMORY or len(self.met) > MEMORY // 4:
            self._forget()
        elif int(size[unknown].max()) <= LONG:
            into = np.searchsorted(self.met, h[unknown])
            self.met, self.met_at, self.met_n = (np.insert(old, into, x[unknown]) for old, x in ((self.met, h), (self.met_at, place), (self.met_n, number)))
            self.met_ids = flat
        else:  # long words are seldom met again
            kept = unknown[size[unknown] <= LONG]
            into = np.searchsorted(self.met, h[kept])
            own = ids[np.repeat(place[kept] - len(self.met_ids) - (np.cumsum(number[kept]) - number[kept]), number[kept]) + np.arange(number[kept].sum())]
            where = len(self.met_ids) + np.cumsum(number[kept]) - number[kept]
            self.met, self.met_at, self.met_n = (np.insert(old, into, x) for old, x in ((self.met, h[kept]), (self.met_at, where), (self.met_n, number[kept])))
            self.met_ids = np.concatenate((self.met_ids, own))
        return place, number, flat

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) * (self.n + 2) + b
        slot = (mix64(pair.view(np.uint64)) & np.uint64((1 << 20) - 1)).astype(np.int64)
        miss = np.flatnonzero(self.seen[slot] != pair)
        out = self.fits[slot]
        if len(miss):
            x, y = a[miss], b[miss]
            ok = np.ones(len(miss), bool)
            for r in range(len(self.right[0])):
                rx, re = self.right[0][r][x], self.right[1][r][x]
                if (rx < 0).all():
                    break
                for k in range(len(self.left[0])):
                    ly, le = self.left[0][k][y], self.left[1][k][y]
                    some = np.flatnonzero(ok & (rx >= 0) & (ly >= 0))
                    if not len(some):
                        continue
                    key = rx[some] * self.n + ly[some]
                    at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                    hit = self.pair_keys[at] == key
                    some, at = some[hit], at[hit]
                    rank = self.rank[self.pair_ids[at]]
                    ok[some[(rank < re[some]) & (rank <= le[some])]] = False
            out[miss] = ok
            self.seen[slot[miss]] = pair[miss]
            self.fits[slot[miss]] = ok  # of two pairs with one slot the same one is last in both
        return out

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes: words of one length as rows.  (ids, piece lengths) at each end
        position on the best path of each prefix; id n is a lone character."""
        n, size = codes.shape
        value = (codes.T.astype(np.uint64) + np.uint64(1)) * powers(_BASE, size)[:, None]
        prefix = np.zeros((size + 1, n), np.uint64)
        np.cumsum(value, axis=0, out=prefix[1:])
        inv, mask = powers(_INV, size + 1), np.uint64((1 << 20) - 1)
        # the edges of the lattices: pieces of each length, wherever they begin
        rows, pieces, ends, lengths = [], [], [], []
        for k in range(1, min(size, self.longest) + 1):
            key = mix64((prefix[k:] - prefix[:-k]) * inv[: size - k + 1, None] + np.uint64(k)).ravel()
            cell = np.flatnonzero(self.sieve[(key & mask).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, key[cell]), len(self.keys) - 1)
            found = self.keys[at] == key[cell]
            cell, piece = cell[found], self.key_ids[at[found]].astype(np.int64)
            if k == 1:
                whole = np.full(size * n, self.n, np.int64)
                whole[cell] = piece
                cell, piece = np.arange(size * n), whole
            rows.append(cell % n)
            ends.append(cell // n + k)
            pieces.append(piece)
            lengths.append(np.full(len(cell), k))
        row, piece, end, length = (np.concatenate(x) for x in (rows, pieces, ends, lengths))
        order = np.argsort(end, kind="stable")  # shorter pieces first
        row, piece, length = row[order], piece[order], length[order]
        cuts = np.searchsorted(end[order], np.arange(1, size + 2))
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        last = np.full((size + 1, n), self.n + 1, np.int64)
        back = np.zeros((size + 1, n), np.int64)
        for i in range(1, size + 1):
            part = slice(cuts[i - 1], cuts[i])
            r, x, k = row[part], piece[part], length[part]
            if self.kind == BPE:
                open_ = np.flatnonzero(best[i - k, r] == 0)
                open_ = open_[self.compatible(last[i - k[open_], r[open_]], x[open_])]
                r, x, k, new = r[open_], x[open_], k[open_], 0.0
            else:
                new = best[i - k, r] + np.where(x == self.n, self.unk_score, self.score[np.minimum(x, self.n - 1)])
                by = np.lexsort((k, new))
                r, x, k, new = r[by], x[by], k[by], new[by]
            # of several edges the last one stays: the greatest value, of equal ones the longest piece
            best[i, r], last[i, r], back[i, r] = new, x, k
        return last, back

    def long_word(self, codes: np.ndarray) -> np.ndarray | None:
        """Ids of a long word of a BPE model (n and more: lone characters), from
        searches over overlapping blocks that advance together; None if two
        blocks don't come to agree.

        What a prefix ends with depends on what the last `longest` shorter ones
        end with.  So where a search that began at a block's start agrees for so
        many positions with the one before it, it agrees from there on."""
        over = 2 * self.longest
        step = max(LONG, over)
        starts = np.arange(0, len(codes), step)
        padded = np.concatenate((codes, np.full(step + over, _NO_CHARACTER, codes.dtype)))
        last, back = np.empty(len(codes) + 1, np.int64), np.empty(len(codes) + 1, np.int64)
        each = max(1, (1 << 18) // (step + over))
        tail = None  # of the block before: what it found over the border
        for lo in range(0, len(starts), each):
            at = starts[lo : lo + each]
            found, length = self.viterbi(padded[at[:, None] + np.arange(step + over)])
            for k, s in enumerate(at.tolist()):
                mine = found[1:, k], length[1:, k]
                end = min(step + over, len(codes) - s)
                first = 0
                if tail is not None:
                    seen = min(over, end)
                    same = (tail[0][:seen] == mine[0][:seen]) & (tail[1][:seen] == mine[1][:seen])
                    run = np.convolve(same, np.ones(self.longest, int), "valid") if seen >= self.longest else np.zeros(0, int)
                    agreed = np.flatnonzero(run == self.longest)
                    if len(agreed):
                        first = int(agreed[0])
                    elif end <= over:  # the block before went on to the end
                        break
                    else:
                        return None
                last[s + 1 + first : s + 1 + end], back[s + 1 + first : s + 1 + end] = mine[0][first:end], mine[1][first:end]
                tail = last[s + 1 + step : s + 1 + step + over], back[s + 1 + step : s + 1 + step + over]
        ids, i = [], len(codes)
        last, back = last.tolist(), back.tolist()
        while i > 0:
            ids.append(last[i] if last[i] != self.n else self.n + int(codes[i - 1]))
            i -= back[i]
        return np.array(ids[::-1], np.int64)

    def words(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> list:
        """Ids of each word as (counts, flat ids) in the given order."""
        n = len(start)
        flat, owner, place = [], [], []
        runs = np.zeros(n, bool)
        two = size > 1
        runs[two] = (codes[start[two]] == SPACE) & (codes[start[two] + 1] == SPACE)
        slow = (runs | (size > LONG)) if self.kind == BPE else np.zeros(n, bool)
        for w in np.flatnonzero(slow):
            text = codes[start[w] : start[w] + size[w]]
            ids = None if runs[w] else self.long_word(text)
            if ids is None:
                made, _ = self._merge([self.index.get(chr(c), -1 - int(c) - 10) for c in text])
                ids = np.array([self.n - 11 - x if x < 0 else x for x in made], np.int64)
                self.merged += len(text)
            flat.append(ids)
            owner.append(np.full(len(ids), w))
            place.append(np.arange(len(ids)))
        fast = np.flatnonzero(~slow)
        for length in np.unique(size[fast]):
            group = fast[size[fast] == length]
            step = max(1, (1 << 18) // int(length))
            for lo in range(0, len(group), step):
                g = group[lo : lo + step]
                rows = codes[start[g][:, None] + np.arange(length)]
                last, back = self.viterbi(rows)
                at, live = np.full(len(g), length, np.int64), np.arange(len(g))
                while len(live):
                    ids = last[at[live], live]
                    lone = ids == self.n
                    ids = np.where(lone, self.n + rows[live, at[live] - 1].astype(np.int64), ids)
                    flat.append(ids)
                    owner.append(g[live])
                    place.append(at[live])
                    at[live] -= back[at[live], live]
                    live = live[at[live] > 0]
        if not flat:
            return np.zeros(n, np.int64), np.zeros(0, np.int32)
        flat, owner, place = np.concatenate(flat), np.concatenate(owner), np.concatenate(place)
        order = np.lexsort((place, owner))
        flat, owner = flat[order], owner[order]
        lone = np.flatnonzero(flat >= self.n)
        count = np.ones(len(flat), np.int64)
        if len(lone) and self.byte_fallback:
            raw = [chr(c).encode() for c in (flat[lone] - self.n).tolist()]
            count[lone] = [len(r) for r in raw]
            out = np.repeat(flat, count)
            inner = np.repeat(np.arange(len(flat)), count)
            out[flat[inner] >= self.n] = self.bytes_ids[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            out = np.where(flat >= self.n, self.unk, flat)
            if len(lone):  # neighbouring unknown characters are one unknown piece
                again = np.zeros(len(flat), bool)
                again[1:] = (flat[1:] >= self.n) & (flat[:-1] >= self.n) & (owner[1:] == owner[:-1])
                out, owner, count = out[~again], owner[~again], count[~again]
        return np.bincount(np.repeat(owner, count), minlength=n), out.astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        head = "▁" if self.prefix else ""
        full = [head + t if t else "" for t in texts]
        size = np.array([len(t) for t in full], np.int64)
        codes = _codes("".join(full).replace(" ", "▁"))
        offsets = np.zeros(len(texts) + 1, np.int64)
        if not len(codes):
            return offsets, np.zeros(0, np.int32)
        is_space = codes == SPACE
        cut = is_space.copy()
        cut[1:] &= ~is_space[:-1]
        begin = np.cumsum(size) - size
        cut[begin[size > 0]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(codes)))
        h = mix64(run_hashes(None, codes, start, start + length, _BASE, _INV) + length.astype(np.uint64))
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        at, count, ids = self.remembered(distinct, codes, start[first], length[first])
        each = count[which]
        out = ids[np.repeat(at[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        doc = np.searchsorted(np.cumsum(size), start, side="right")
        offsets[1:] = np.cumsum(np.bincount(doc, each, minlength=len(texts)).astype(np.int64))
        return offsets, out

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        end = np.concatenate(([0], np.cumsum(size)))
        data = self.raw[np.repeat(self.raw_at[ids] - end[:-1], size) + np.arange(end[-1])].tobytes()
        cut = 1 if self.prefix else 0
        out = []
        for a, b in zip(end[offsets[:-1]].tolist(), end[offsets[1:]].tolist(), strict=True):
            t = data[a:b].decode("utf-8", "replace")
            out.append(t[cut:] if t.startswith(" ") else t)
        return out


def load(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _share(spark, path):
    return spark.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, path: str = MODEL, ids: str = "ids") -> DataFrame:
    """doc_id and the piece ids of text, as array<int>; null text: no ids."""
    shared = _share(docs.sparkSession, path)

    def run(it):
        model = shared.value.prepare()
        for batch, buf, off in batches(it, STEP_BYTES):
            data = buf.tobytes()
            at, got = model.encode([data[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(got))], names=["doc_id", ids])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, `{ids}` array<int>")


def decode(tokens: DataFrame, path: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """doc_id and the text of the ids; null ids give null."""
    shared = _share(tokens.sparkSession, path)

    def run(it):
        model = shared.value
        for batch in it:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                col = part.column(1)
                size = np.array([0 if x is None else x for x in pc.list_value_length(col).to_pylist()], np.int64)
                got = model.decode(np.concatenate(([0], np.cumsum(size))), col.flatten().to_numpy().astype(np.int64))
                null = col.is_null().to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x else t for t, x in zip(got, null, strict=True)], pa.string())], names=["doc_id", text])

    return tokens.select("doc_id", ids).mapInArrow(run, f"doc_id long, `{text}` string")


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers),
    decoded_sha256 and round_trip (decoding gives the text, with U+2581 as a
    space) of every row, encoded and decoded in one pass."""
    shared = _share(docs.sparkSession, path)

    def run(it):
        model = shared.value.prepare()
        for batch, buf, off in batches(it, STEP_BYTES):
            data = buf.tobytes()
            texts = [data[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)]
            at, got = model.encode(texts)
            back = model.decode(at, got.astype(np.int64))
            flat = got.astype("<i4")
            sha = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            sha_back = [hashlib.sha256(t.encode()).hexdigest() for t in back]
            same = [a == b.replace("▁", " ") for a, b in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(sha), pa.array(sha_back), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def encode_checked(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip: whether decoding the ids gives the
    text back, with U+2581 as a space."""
    shared = _share(docs.sparkSession, path)

    def run(it):
        model = shared.value.prepare()
        for batch, buf, off in batches(it, STEP_BYTES):
            data = buf.tobytes()
            texts = [data[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)]
            at, got = model.encode(texts)
            back = model.decode(at, got.astype(np.int64))
            same = [a == b.replace("▁", " ") for a, b in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(got)), pa.array(np.diff(at)), pa.array(same)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def op10_sentencepiece(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


