"""Minimum-energy folding of a batch of alignments of one width.

A single sequence is an alignment of one row.  Cells are computed span by span for
all positions of all alignments of the batch at once, summed over rows;
``c[d, i]`` is the best energy with i and i + d paired.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from .energy import BULGE, INF, INTERIOR, LOG_SLOPE, MAX_LOOP, MULTI_CLOSING, MULTI_STEM, NINIO, NINIO_MOST, PAIR, TURNED, WEAK_END, Energies, tetraloop_bonus

TURN = 3
#: Least covariance score of a consensus pair.
LEAST_SCORE = -200
FORBIDDEN = -10_000
#: What stands for no energy in tables of short numbers: twice that and a loop's closing still fit.
SHORT_INF = 14_000
_CODE = np.zeros(256, np.int8)
for _letter, _code in zip(b"ACGUT", (1, 2, 3, 4, 4)):
    _CODE[_letter] = _code
#: Bonuses of hairpins are given to RNA letters alone.
_LOOP_CODE = np.where(np.arange(256) == ord("T"), 0, _CODE).astype(np.int8)

# How far two pair types (CG GC GU UG AU UA) differ.
PAIR_DISTANCE = np.array([[0, 2, 2, 1, 2, 2], [2, 0, 1, 2, 2, 2], [2, 1, 0, 2, 1, 2], [1, 2, 2, 0, 2, 1], [2, 2, 1, 2, 0, 2], [2, 2, 2, 1, 2, 0]])
SPECIAL = [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]


def encode(rows: list[str]) -> np.ndarray:
    return np.stack([_CODE[np.frombuffer(r.encode("latin-1", "replace"), np.uint8)] for r in rows])


def pair_scores(codes: np.ndarray) -> np.ndarray:
    """Covariance score of every two columns of one alignment (rows, n)."""
    s, n = codes.shape
    types = PAIR[codes[:, :, None], codes[:, None, :]]
    gaps = (codes[:, :, None] == 0) & (codes[:, None, :] == 0)
    f = np.stack([((types == k) & ~gaps).sum(0) for k in range(7)])
    both = gaps.sum(0)
    score = np.einsum("kij,lij,kl->ij", f[1:], f[1:], PAIR_DISTANCE) // 2
    out = np.trunc(100 * score // s - 100.0 * f[0] - 25.0 * both).astype(np.int32)
    return np.where(f[0] * 2 > s, FORBIDDEN, out)


@functools.lru_cache(maxsize=MAX_LOOP + 1)
def _loops(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l1, l2) of interior loops without a table of their own, in order, with at most ``most`` bases; and their cost but for mismatches."""
    l1, l2 = (x.ravel() for x in np.mgrid[:most + 1, :most + 1])
    few, total = np.minimum(l1, l2), l1 + l2
    keep = (total <= most) & (total >= 2) & ~((few == 1) & (total <= 3)) & ~((few == 2) & (total == 4))
    l1, l2, total, few = (x[keep] for x in (l1, l2, total, few))
    inner = np.array(INTERIOR)[total] + np.minimum(NINIO_MOST, np.abs(l1 - l2) * NINIO)
    return l1, l2, np.where(few == 0, np.array(BULGE)[total], inner).astype(np.int32)


def _scored(rows: list[list[int]], pairs: list[tuple[int, int]]) -> list[int]:
    """The same as :func:`pair_scores` for a few pairs of columns."""
    out, s = [], len(rows)
    for i, j in pairs:
        at = [(r[i], r[j]) for r in rows]
        fits = [p for p in at if p[0] + p[1] in (5, 7)]
        gaps = at.count((0, 0))
        none = s - len(fits) - gaps
        changes = sum((x[0] != y[0]) + (x[1] != y[1]) for n, x in enumerate(fits) for y in fits[:n])
        out.append(FORBIDDEN if none * 2 > s else 100 * changes // s - 100 * none - 25 * gaps)
    return out


class _Sums:
    """Up to four tables of one index, looked up together: their values lie in one number, 16 bits each."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables, self.least = tables, [int(t.min()) for t in tables]
        self.widest = max(int(t.max()) - low for t, low in zip(tables, self.least))
        self.packed = sum((t.astype(np.int64) - low) << 16 * k for k, (t, low) in enumerate(zip(tables, self.least)))

    def of(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The sum over rows of what each table has at their indices."""
        if self.widest * len(rows) >= 1 << 16 or len(self.tables) == 4 and self.widest * len(rows) >= 1 << 15:
            return [functools.reduce(np.add, [t.take(r) for r in rows]) for t in self.tables]
        total = functools.reduce(np.add, [self.packed.take(r) for r in rows])
        return [((total >> 16 * k) & 0xFFFF).astype(np.int32) + len(rows) * low for k, low in enumerate(self.least)]


class Room:
    """Memory for the tables of one fold after another; what a fold has in it is good until the next one."""

    def __init__(self):
        self.cells = np.empty(0, np.int32)

    def take(self, sizes: list[int], kind: type) -> list[np.ndarray]:
        need = sum(sizes) * np.dtype(kind).itemsize // 4 + 1
        if len(self.cells) < need:
            self.cells = np.empty(need, np.int32)
        ends = np.cumsum(sizes)
        return [self.cells.view(kind)[end - size:end] for end, size in zip(ends, sizes)]


class _Tables:
    """Energies by codes of bases instead of types of pairs: index 5 * (first base) + last base of a pair, times 25, plus the same of the bases inside or outside of it."""

    def __init__(self, e: Energies):
        kind = np.where(PAIR == 0, 7, PAIR).ravel()
        turned, weak = TURNED[kind], (kind > 2).astype(np.int32) * WEAK_END
        flat = lambda x: np.ascontiguousarray(x, np.int32).ravel()
        self.kind, self.turned, self.weak = kind.astype(np.intp), turned.astype(np.intp), weak
        self.hairpin = flat(e.mismatch_hairpin[kind])
        self.outer = flat(e.mismatch_interior[kind])
        self.inner = flat(e.mismatch_interior[turned].swapaxes(1, 2))
        self.stem = flat(e.dangle5[kind][:, :, None] + e.dangle3[kind][:, None, :] + weak[:, None, None])
        self.closing = flat(e.dangle3[turned][:, :, None] + e.dangle5[turned][:, None, :] + weak[:, None, None] + MULTI_CLOSING + MULTI_STEM)
        self.stack = flat(e.stack[kind[:, None], turned[None]])
        self.added = self._added(e)
        if self.added:
            of, self.least = self.added
            self.end = of[kind]
        wide = lambda table: np.repeat(table, 25)
        #: What the bases inside of a pair decide, and those outside of it.
        self.inside = _Sums([self.hairpin, self.outer, self.closing, self.stack])
        self.outside = _Sums([self.stem, self.inner, wide(weak), *([wide(self.end)] if self.added else [])])
        self.lists = {x: getattr(self, x).tolist() for x in ("weak", "hairpin", "outer", "closing", "stack", "kind", "turned")}

    @staticmethod
    def _added(e: Energies) -> tuple[np.ndarray, dict[tuple[int, int], int]] | None:
        """Of small interior loops that don't depend on unpaired bases, and on each pair alone: what a type of pair adds, and the rest."""
        ends, least = [], {}
        for name, loops in (("int11", [(1, 1)]), ("int21", [(1, 2), (2, 1)]), ("int22", [(2, 2)])):
            x = getattr(e, name).reshape(8, 8, -1).astype(np.int32)
            two, end = x[:, :, 0], x[:, 1, 0] - x[1, 1, 0]
            if not (x == x[:, :, :1]).all() or not (two[1:, 1:] == two[1, 1] + end[1:, None] + end[None, 1:]).all():
                return None
            ends.append(end[1:])
            least |= dict.fromkeys(loops, int(two[1, 1]))
        if not all((x == ends[0]).all() for x in ends) or not (ends[0] == ends[0][TURNED[1:] - 1]).all():
            return None
        return np.concatenate([[0], ends[0]]).astype(np.int32), least


_TABLES: dict[int, tuple[Energies, _Tables]] = {}


def _tables(e: Energies) -> _Tables:
    if id(e) not in _TABLES:
        if len(_TABLES) > 8:
            _TABLES.clear()
        _TABLES[id(e)] = e, _Tables(e)
    return _TABLES[id(e)][1]


@functools.cache
def _bonuses() -> np.ndarray:
    """Bonus of six bases by their number in base five."""
    out = np.zeros(5**6, np.int32)
    for loop, bonus in tetraloop_bonus().items():
        out[functools.reduce(lambda x, c: 5 * x + "_ACGU".index(c), loop, 0)] = bonus
    return out


class Fold:
    """The filled tables of a batch: ``rows`` is a list of alignments, each a list of equally long rows, or their codes (alignments, rows, columns).

    Narrower alignments get columns of gaps behind them, which pair with
    nothing and change no energy.  ``scores`` are those of every two columns;
    with ``consensus`` they are the alignments' own.  Tables lie in ``room``, if given.

    Tables lie by span, position and alignment, so that a slice of positions is
    one stretch of memory: ``c[d, i]`` for the first base, and ``ci_end[d, j]`` and the like for the last.
    What pairs cost is worked out for those that are free to form alone, by
    their numbers in such a stretch.
    """

    def __init__(self, rows: list[list[str]] | np.ndarray, e: Energies, *, scores: np.ndarray | None = None, consensus: bool = False, room: Room | None = None):
        self.e, self.tables, self.scores, self.consensus = e, _tables(e), scores, consensus
        if isinstance(rows, np.ndarray):
            codes = letters = rows
        else:
            width = max(len(r) for block in rows for r in block)
            raw = np.frombuffer("".join([r.ljust(width, "-") for block in rows for r in block]).encode("latin-1", "replace"), np.uint8).reshape(len(rows), -1, width)
            codes, letters = _CODE[raw], _LOOP_CODE[raw]
        self.codes = np.ascontiguousarray(codes.transpose(1, 2, 0))
        self.s, self.n, self.b = self.codes.shape
        self.bonus = np.zeros((self.n, self.b), np.int32)
        if self.n >= 6:
            x = letters.transpose(1, 2, 0).astype(np.intp)
            six = functools.reduce(lambda a, k: 5 * a + x[:, k:self.n - 5 + k], range(6), 0)
            self.bonus[:self.n - 5] = _bonuses()[six].sum(0)
        room, most = room or Room(), self._most()
        # short numbers take half the time; should energies turn out too low for them, all is filled again
        if not (most and self._fill(room, np.int16, SHORT_INF, most - SHORT_INF)):
            self._fill(room, np.int32, INF, -INF)

    def _most(self) -> int:
        """No pair has more energy than that, as it may close a hairpin; 0 where short numbers won't do."""
        x = self.tables
        if self.scores is not None or not x.added or self.n <= TURN + 1:
            return 0
        most = self.s * (max(map(self.e.hairpin, range(TURN, self.n))) + int(max(0, x.hairpin.max(), x.weak.max(), -x.closing.min()))) - LEAST_SCORE
        widest = self.s * max(*(int(np.abs(t).max()) for t in (*x.inside.tables, *x.outside.tables)), *map(abs, x.least.values()))
        loops = self.s * (NINIO_MOST + max(BULGE[1:] + INTERIOR[2:]))
        fits = max(2 * SHORT_INF + 2 * self.s * MULTI_STEM, SHORT_INF + loops) + widest < 32_500 and SHORT_INF - widest > most
        return most if fits else 0

    def _free(self, d: int) -> tuple[np.ndarray, np.ndarray | int]:
        """Numbers of the pairs of a span that may form, and their scores."""
        if self.scores is not None:
            score = np.diagonal(self.scores, d, 1, 2).T.ravel()
            at = np.flatnonzero(score >= LEAST_SCORE)
            return at, score[at]
        x, y = self.codes[:, :self.n - d], self.codes[:, d:]
        both = x + y
        fits = (both == 5) | (both == 7)  # A and U, C and G; G and U
        if not self.consensus:
            return np.flatnonzero(fits.all(0)), 0
        kind = np.int8 if self.s <= 11 else np.int32
        fit, gap = fits.view(np.int8), (both == 0).view(np.int8)
        none, gaps, changes = np.full(fits.shape[1:], self.s, kind), np.zeros(fits.shape[1:], kind), np.zeros(fits.shape[1:], kind)
        for i in range(self.s):
            none -= fit[i]
            gaps += gap[i]
            for j in range(i + 1, self.s):
                pairs = fits[i] & fits[j]
                changes += ((x[i] != x[j]) & pairs).view(np.int8)
                changes += ((y[i] != y[j]) & pairs).view(np.int8)
        none -= gaps
        at = np.flatnonzero(none <= self.s // 2)
        none, gaps, changes = (v.ravel()[at].astype(np.int32) for v in (none, gaps, changes))
        score = 100 * changes // self.s - 100 * none - 25 * gaps
        good = score >= LEAST_SCORE
        return at[good], score[good]

    def scores_of(self, k: int, pairs: list[tuple[int, int]]) -> list[int]:
        """The covariance scores of pairs of columns of alignment ``k``."""
        if self.scores is not None:
            return [int(self.scores[k, i, j]) for i, j in pairs]
        return _scored(self.codes[:, :, k].tolist(), pairs) if self.consensus else [0] * len(pairs)

    def _measured(self, at: np.ndarray, d: int, rows: np.ndarray) -> np.ndarray:
        """The least energy of small interior loops of which every unpaired base counts."""
        e, b, best = self.e, self.b, np.full(len(at), INF, np.int32)
        for l1, l2 in SPECIAL[3:]:
            if l1 + l2 > d - 3 - TURN:
                continue
            total = self.c[d - 2 - l1 - l2].ravel().take(at + (1 + l1) * b)
            for x in rows:
                def base(offset: int, x=x):
                    return x.take(at + offset * b)

                t = self.tables.kind[5 * base(0) + base(d)]
                t2 = self.tables.turned[5 * base(1 + l1) + base(d - 1 - l2)]
                after, before, near, far = base(1), base(d - 1), base(l1), base(d - l2)  # before the inner pair, and after it
                total = total + (e.int11[t, t2, after, before] if (l1, l2) == (1, 1) else e.int21[t, t2, after, far, before] if (l1, l2) == (1, 2)
                                 else e.int21[t2, t, far, after, near] if (l1, l2) == (2, 1) else e.int22[t, t2, after, near, far, before])
            best = np.minimum(best, total)
        return best

    def _fill(self, room: Room, kind: type, inf: int, lowest: int) -> bool:
        """Fill the tables; False as soon as an energy is under ``lowest``, where one that can't be might pass for one that can."""
        b, s, n, x = self.b, self.s, self.n, self.tables
        most = MAX_LOOP - 1
        *tables, work = room.take([n * n * b] * 12 + [max(most * n, n * n // 4 + 1) * b], kind)
        # ``small`` is ``c`` with what an end of a small loop adds; ``nested`` has interior loops by the span inside, of either parity, by their middle
        c, ci, ci_end, cb, cb_end, stem_end, small, f, f_end, split, *nested = (t.reshape(n, n * b) for t in tables)
        self.c, self.ci, self.ci_end, self.cb, self.cb_end, self.stem_end, _, self.f, self.f_end, self.split, *by_middle = (t.reshape(n, n, b) for t in tables)
        for table in (c, ci, ci_end, cb, cb_end, stem_end, small, f, f_end):
            table[:TURN + 1] = inf
        split[:2 * TURN + 3] = inf
        sizes = np.arange(MAX_LOOP, -1, -1)
        bulge, interior, skewed = (np.minimum(inf, s * np.array(v, np.int64)).astype(kind)[::-1] for v in (
            BULGE, INTERIOR, np.minimum(NINIO_MOST, np.abs(sizes[::-1] - 2) * NINIO)))
        wide = np.pad(self.codes, ((0, 0), (2, 2), (0, 0))).astype(np.intp)
        # parts of an index by the first base of a pair with one beside it, and by the last
        own, beside = wide[:, 2:-2], {k: wide[:, 2 + k:n + 2 + k] for k in (-2, -1, 1, 2)}
        first = {k: (125 * own + 5 * beside[k]).reshape(s, n * b) for k in (-1, 1, 2)}
        end_of = {k: (25 * own + beside[k]).reshape(s, n * b) for k in (-2, -1, 1)}
        own = np.ascontiguousarray(own).reshape(s, n * b)

        def least(one: np.ndarray, other: np.ndarray, cost: np.ndarray) -> np.ndarray:
            """Of every column, the least of the sums of both rows' lesser and the cost."""
            got = np.minimum(one, other, out=work[:one.size].reshape(one.shape))
            got += cost.reshape(-1, *[1] * (one.ndim - 1))
            return got.min(0)

        for d in range(TURN + 1, n):
            m, half, most = n - d, d // 2, min(MAX_LOOP, d - 3 - TURN)
            at, score = self._free(d)
            lo, hi = d - 2 - most, d - 3
            for table in (c, ci, cb, small):
                table[d, :m * b] = inf
            for table in (ci_end, cb_end, stem_end):
                table[d, d * b:] = inf
            if most >= 2:
                # loops of one size that lie at least two bases off both ends are those of the pair one step inside
                # with two bases less: what is new has one base on one side
                edge = work[:(most - 1) * m * b].reshape(most - 1, m, b)
                np.minimum(self.ci[lo:hi, 2:2 + m], self.ci_end[lo:hi, d - 2:d - 2 + m], out=edge)
                edge += skewed[MAX_LOOP - most:MAX_LOOP - 1, None, None]
                known = by_middle[d % 2][lo:hi, half:half + m]
                known[-2:] = inf
                np.minimum(known, edge, out=known)
                found = edge[most - 4].ravel().take(at) if most >= 4 else None
            if len(at):
                few, last = 3 * len(at) < m * b, at + d * b
                one, left, right, out = [], [], [], []
                for i in range(s):
                    start, end = first[1][i].take(at), end_of[-1][i].take(last)
                    one.append(start + end)
                    left.append(first[2][i].take(at) + end)
                    right.append(start + end_of[-2][i].take(last))
                    out.append(first[-1][i].take(at) + end_of[1][i].take(last))
                hairpin, outer, closing, stack = x.inside.of(one)
                stem, inner, weak, *end = x.outside.of(out)
                best = s * self.e.hairpin(d - 1) + (hairpin if d > TURN + 1 else weak)
                if d == 5:
                    best += self.bonus.ravel().take(at)
                if most >= 0:
                    np.minimum(best, c[d - 2].take(at + b) + stack, out=best)
                if most >= 1:
                    for place, index in ((at + b, right), (at + 2 * b, left)):
                        np.minimum(best, c[d - 3].take(place) + functools.reduce(np.add, [x.stack.take(i) for i in index]) + s * BULGE[1], out=best)
                if most >= 2:
                    if x.added:
                        loops = [small[d - 2 - l1 - l2].take(at + (1 + l1) * b) + s * cost for (l1, l2), cost in x.least.items() if l1 + l2 <= most]
                        np.minimum(best, functools.reduce(np.minimum, loops) + end[0], out=best)
                    else:
                        np.minimum(best, self._measured(at, d, own), out=best)
                    cost = bulge[MAX_LOOP - most:MAX_LOOP - 1]
                    if few:
                        bulged = least(cb[lo:hi].take(at + b, 1), cb_end[lo:hi].take(at + (d - 1) * b, 1), cost)
                    else:
                        bulged = least(self.cb[lo:hi, 1:1 + m], self.cb_end[lo:hi, d - 1:d - 1 + m], cost).ravel().take(at)
                    np.minimum(best, bulged + weak, out=best)
                if most >= 4:
                    found += interior[MAX_LOOP - 4]
                    if most > 4:
                        cost = interior[MAX_LOOP - most:MAX_LOOP - 4]
                        if few:
                            larger = (nested[d % 2][lo:d - 6].take(at + half * b, 1) + cost[:, None]).min(0)
                        else:
                            known = by_middle[d % 2][lo:d - 6, half:half + m]
                            larger = np.add(known, cost[:, None, None], out=work[:known.size].reshape(known.shape)).min(0).ravel().take(at)
                        np.minimum(found, larger, out=found)
                    np.minimum(best, found + outer, out=best)
                if d > 2 * TURN + 4:
                    np.minimum(best, split[d - 2].take(at + b) + closing, out=best)
                best -= score
                if best.min() <= lowest:
                    return False
                c[d][at] = best
                weak += best
                cb[d][at] = cb_end[d][last] = weak
                inner += best
                ci[d][at] = ci_end[d][last] = inner
                stem_end[d][last] = stem + best
                if x.added:
                    small[d][at] = end[0] + best
            f_now = np.add(self.stem_end[d, d:], s * MULTI_STEM, out=self.f[d, :m])
            np.minimum(f_now, self.f[d - 1, 1:m + 1], out=f_now)
            np.minimum(f_now, self.f[d - 1, :m], out=f_now)
            if d > 2 * TURN + 2:
                # the first part from TURN + 1 on, the second the rest
                parts = self.f[TURN + 1:d - TURN - 1, :m]
                np.add(parts, self.f_end[d - TURN - 2:TURN:-1, d:], out=work[:parts.size].reshape(parts.shape)).min(0, out=self.split[d, :m])
                np.minimum(f_now, self.split[d, :m], out=f_now)
            self.f_end[d, d:] = f_now
            if f_now.min() <= lowest:
                return False
        upto = np.zeros((n + 1, b), np.int32)
        for j in range(1, n + 1):
            upto[j] = upto[j - 1]
            if j > TURN + 1:
                ends = upto[:j - TURN - 1] + self.stem_end[j - 1:TURN:-1, j - 1]
                upto[j] = np.minimum(upto[j], ends.min(0))
        self.upto = upto.T
        return True

    def energy(self) -> np.ndarray:
        """kcal/mol of each alignment, the mean over its rows."""
        return (self.upto[:, self.n] / (100.0 * self.s)).astype(np.float32).astype(float)

    def pairs(self, k: int) -> list[tuple[int, int]]:
        """The pairs of one optimal structure of alignment ``k``; of equal ones, the first by a fixed order of cases."""
        out, todo, upto = [], [("end", self.n, 0)], self.upto[k].tolist()
        rows = self.codes[:, :, k].tolist()
        f, stems = self.f[:, :, k], self.stem_end[:, :, k]
        while todo:
            kind, i, d = todo.pop()
            if kind == "end":
                while i > TURN + 1 and upto[i] == upto[i - 1]:
                    i -= 1
                if i <= TURN + 1:
                    continue
                ends = self.upto[k, :i - TURN - 1] + stems[i - 1:TURN:-1, i - 1]
                p = int(np.flatnonzero(ends == upto[i])[-1])
                todo += [("end", p, 0), ("pair", p, i - 1 - p)]
            elif kind == "multi":
                want = f[d, i]
                if want == f[d - 1, i]:
                    todo.append(("multi", i, d - 1))
                elif want == f[d - 1, i + 1]:
                    todo.append(("multi", i + 1, d - 1))
                elif want == stems[d, i + d] + self.s * MULTI_STEM:
                    todo.append(("pair", i, d))
                else:
                    todo += self._halves(k, i, d)
            else:
                out.append((i, i + d))
                score, = _scored(rows, [(i, i + d)]) if self.scores is None and self.consensus else self.scores_of(k, [(i, i + d)])
                want = int(self.c[d, i, k]) + score
                pair = [5 * r[i] + r[i + d] for r in rows]
                if want == self._hairpin(rows, pair, k, i, d):
                    continue
                inner = self._inner_pair(rows, pair, k, i, d, want)
                if inner:
                    l1, l2 = inner
                    todo.append(("pair", i + 1 + l1, d - 2 - l1 - l2))
                else:
                    todo += self._halves(k, i + 1, d - 2)
        return sorted(out)

    def _hairpin(self, rows: list[list[int]], pair: list[int], k: int, i: int, d: int) -> int:
        base, x = self.s * self.e.hairpin(d - 1), self.tables.lists
        if d == TURN + 1:
            return base + sum(x["weak"][p] for p in pair)
        got = base + sum(x["hairpin"][25 * p + 5 * r[i + 1] + r[i + d - 1]] for p, r in zip(pair, rows))
        return got + int(self.bonus[i, k]) if d == 5 else got

    def _small(self, rows: list[list[int]], pair: list[int], k: int, i: int, d: int, l1: int, l2: int) -> int:
        """Energy of the interior loop that has a table of its own."""
        x, e, p, q = self.tables.lists, self.e, i + 1 + l1, i + d - 1 - l2
        total = int(self.c[q - p, p, k])
        if l1 + l2 < 2:
            return total + sum(x["stack"][25 * t + 5 * r[p] + r[q]] for t, r in zip(pair, rows)) + self.s * (BULGE[1] if l1 + l2 else 0)
        if self.tables.added:
            end = self.tables.end
            return total + self.s * self.tables.least[l1, l2] + sum(int(end[t]) + int(end[5 * r[p] + r[q]]) for t, r in zip(pair, rows))
        for a, r in zip(pair, rows):
            t, t2, after, before, near, far = x["kind"][a], x["turned"][5 * r[p] + r[q]], r[i + 1], r[i + d - 1], r[p - 1], r[q + 1]
            total += int(e.int11[t, t2, after, before] if (l1, l2) == (1, 1) else e.int21[t, t2, after, far, before] if (l1, l2) == (1, 2)
                         else e.int21[t2, t, far, after, near] if (l1, l2) == (2, 1) else e.int22[t, t2, after, near, far, before])
        return total

    def _inner_pair(self, rows: list[list[int]], pair: list[int], k: int, i: int, d: int, want: int) -> tuple[int, int] | None:
        """The first (l1, l2) of an interior loop that has the wanted energy."""
        most, x = min(MAX_LOOP, d - 3 - TURN), self.tables.lists
        if most >= 0 and want == self._small(rows, pair, k, i, d, 0, 0):
            return 0, 0
        found = [(l1, l2) for l1, l2 in SPECIAL[1:] if l1 + l2 <= most and want == self._small(rows, pair, k, i, d, l1, l2)]
        if most >= 2:
            l1, l2, cost = _loops(most)
            bulged = np.minimum(l1, l2) == 0
            span, p = d - 2 - l1 - l2, i + 1 + l1
            weak = sum(x["weak"][t] for t in pair)
            outer = sum(x["outer"][25 * t + 5 * r[i + 1] + r[i + d - 1]] for t, r in zip(pair, rows))
            value = self.s * cost + np.where(bulged, self.cb[span, p, k] + weak, self.ci[span, p, k] + outer)
            hit = np.flatnonzero(value == want)
            found += [(int(l1[h]), int(l2[h])) for h in hit[:1]]
        return min(found, default=None)

    def _halves(self, k: int, i: int, d: int):
        both = self.f[TURN + 1:d - TURN - 1, i, k] + self.f_end[d - TURN - 2:TURN:-1, i + d, k]
        found = np.flatnonzero(both == self.split[d, i, k])
        if not len(found):
            raise AssertionError("no split has the energy that was found")
        w = TURN + 1 + int(found[0])
        return [("multi", i, w), ("multi", i + w + 1, d - w - 1)]


def dot_bracket(n: int, pairs: list[tuple[int, int]]) -> str:
    out = ["."] * n
    for i, j in pairs:
        out[i], out[j] = "(", ")"
    return "".join(out)


def pair_list(structure: str) -> list[tuple[int, int]]:
    opened, out = [], []
    for i, c in enumerate(structure):
        if c == "(":
            opened.append(i)
        elif c == ")":
            out.append((opened.pop(), i))
    return sorted(out)


def _by_size(table: list[int], size: int) -> int:
    return table[size] if size <= MAX_LOOP else table[MAX_LOOP] + int(LOG_SLOPE * math.log(size / MAX_LOOP))


def structure_energy(seq: str, structure: str, e: Energies) -> float:
    """Energy of a given structure, the sum over its loops; the time is linear in the sequence."""
    n, code = len(seq), [*encode([seq])[0].tolist(), 0] if seq else [0]  # code[-1] and code[n] are beyond the ends
    partner = dict(pair_list(structure))

    def kind(i: int, j: int) -> int:
        return int(PAIR[code[i], code[j]]) or 7

    def weak(t: int) -> int:
        return WEAK_END if t > 2 else 0

    def stems(at: int, end: int) -> list[tuple[int, int]]:
        """The outermost pairs from ``at`` on, before ``end``."""
        out = []
        while at < end:
            if at in partner:
                out.append((at, partner[at]))
                at = partner[at]
            at += 1
        return out

    def stem(i: int, j: int) -> int:
        t = kind(i, j)
        return weak(t) + e.dangle5[t, code[i - 1]] + e.dangle3[t, code[j + 1]]

    def loop(i: int, j: int) -> int:
        """The loop that a pair closes."""
        t, after, before, inner = kind(i, j), code[i + 1], code[j - 1], stems(i + 1, j)
        if not inner:
            size = j - i - 1
            if size == 3:
                return e.hairpin(size) + weak(t)
            return e.hairpin(size) + e.mismatch_hairpin[t, after, before] + (tetraloop_bonus().get(seq[i:j + 1], 0) if size == 4 else 0)
        if len(inner) > 1:
            closing = e.dangle3[TURNED[t], after] + e.dangle5[TURNED[t], before] + weak(t)
            return MULTI_CLOSING + MULTI_STEM + closing + sum(MULTI_STEM + stem(*x) for x in inner)
        (p, q), = inner
        l1, l2, t2, near, far = p - i - 1, j - q - 1, kind(q, p), code[p - 1], code[q + 1]
        if l1 + l2 < 2:
            return e.stack[t, t2] + (BULGE[1] if l1 + l2 else 0)
        if not l1 or not l2:
            return _by_size(BULGE, l1 + l2) + weak(t) + weak(t2)
        if (l1, l2) == (1, 1):
            return e.int11[t, t2, after, before]
        if (l1, l2) == (1, 2):
            return e.int21[t, t2, after, far, before]
        if (l1, l2) == (2, 1):
            return e.int21[t2, t, far, after, near]
        if (l1, l2) == (2, 2):
            return e.int22[t, t2, after, near, far, before]
        mismatches = e.mismatch_interior[t, after, before] + e.mismatch_interior[t2, far, near]
        return _by_size(INTERIOR, l1 + l2) + min(NINIO_MOST, abs(l1 - l2) * NINIO) + mismatches

    total = sum(stem(*x) for x in stems(0, n)) + sum(loop(*x) for x in partner.items())
    return float(np.float32(int(total) / 100.0))
