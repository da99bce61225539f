"""Exact nearest rows of a matrix of whole numbers: rows lie in cells under a tree of boxes, and a cell is read only if its box can hold a nearer row."""

from __future__ import annotations

import numpy as np

#: Rows of a cell of points, cells or boxes under a box, rows asked at once, cells of a row that are read before the bounds are drawn again.
POINTS, FAN, ASKED, READ = 128, 8, 16384, (2, 8, 24)
#: Pairs of a row and a box that are held at once.
PAIRS = 1 << 20
#: Points around a start from which on a row is searched as if it had none.
MANY = 2048
#: Share of all variance from which on a coordinate is in the boxes.
LEAST = 0.03
_EXACT = 1 << 53


def cells(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the first place of each cell of up to `size` rows, cut at the middle of the coordinate that varies most."""
    order, starts, todo = np.arange(len(at)), [], [(0, len(at))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            starts.append(a)
            continue
        rows = order[a:b]
        own = at[rows]
        by, half = own[:, own.var(axis=0).argmax()] if own.shape[1] else np.zeros(b - a), (b - a) // 2
        order[a:b] = rows[np.argpartition(by, half)]
        todo += [(a + half, b), (a, a + half)]
    return order, np.array(starts, np.int64)


def _merged(kept: np.ndarray, row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The smallest keys of each row, of those kept and new ones."""
    m, k = kept.shape
    changed, at = np.unique(row, return_inverse=True)
    rows, keys = np.concatenate([np.repeat(np.arange(len(changed)), k), at]), np.concatenate([kept[changed].ravel(), key])
    order = np.lexsort((keys, rows))
    first = np.searchsorted(rows[order], np.arange(len(changed)))
    kept[changed] = keys[order][first[:, None] + np.arange(k)]
    return kept


def _gap(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row from its box, in 32 bits not above the true one."""
    out = np.maximum(low - q, q - high)
    np.maximum(out, 0.0, out=out)
    return np.einsum("ij,ij->i", out, out) * (np.float32(1 - 1e-5) if out.dtype == np.float32 else 1.0)


class _Tree:
    """Boxes of the cells, and above them boxes of FAN boxes each up to one."""

    def __init__(self, points: np.ndarray, size: int, scale: float):
        self.order, self.starts = cells(points, size)
        self.ends = np.r_[self.starts[1:], len(points)]
        self.scale, r = scale, points[self.order]
        # A key is distance * scale + place, a whole number below 2**53.
        self.rows, self.tail = r, (r * r).sum(axis=1) * scale + self.order
        # Boxes have the coordinates that vary; without the others they are no farther than they would be.
        spread = r.var(axis=0)
        self.dims = np.flatnonzero(spread >= LEAST * spread.sum())
        self.kind = np.float32 if len(r) and np.abs(r).max() < 1 << 22 else np.float64
        b = r[:, self.dims].astype(self.kind)
        self.levels = [(np.minimum.reduceat(b, self.starts, axis=0), np.maximum.reduceat(b, self.starts, axis=0))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, cut, axis=0), np.maximum.reduceat(high, cut, axis=0)))

    def _under(self, level: int, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The boxes a level below, FAN a box, and whether they are there."""
        found = box[:, None] * FAN + np.arange(FAN)
        n = len(self.levels[level - 1][0])
        return np.minimum(found, n - 1), found < n

    def boxed(self, q: np.ndarray) -> np.ndarray:
        return q[:, self.dims].astype(self.kind if np.abs(q).max(initial=0) < 1 << 22 else np.float64)

    def home(self, q: np.ndarray) -> np.ndarray:
        """A cell close to each row."""
        q = self.boxed(q)
        box = np.zeros(len(q), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            found, there = self._under(level, box)
            low, high = self.levels[level - 1]
            flat = found.ravel()
            gap = _gap(np.repeat(q, FAN, axis=0), low[flat], high[flat]).reshape(found.shape)
            # Inside of several boxes the middle decides.
            middle = ((low[flat] + high[flat]) / 2 - np.repeat(q, FAN, axis=0)) ** 2
            gap = np.where(there, gap + middle.sum(axis=1).reshape(found.shape) * self.kind(1e-6), np.inf)
            box = found[np.arange(len(q)), gap.argmin(axis=1)]
        return box

    def reached(self, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and cells whose box is not beyond the row's limit, and how far it is."""
        row, box = np.arange(len(q)), np.zeros(len(q), np.int64)
        q, gap = self.boxed(q), np.zeros(len(q))
        for level in range(len(self.levels) - 1, 0, -1):
            low, high = self.levels[level - 1]
            parts = []
            for a in range(0, len(row), PAIRS // FAN):
                found, there = self._under(level, box[a : a + PAIRS // FAN])
                own, found = np.repeat(row[a : a + PAIRS // FAN], FAN)[there.ravel()], found[there]
                g = _gap(q[own], low[found], high[found])
                near = np.flatnonzero(g <= limit[own])
                parts.append((own[near], found[near], g[near]))
            row, box, gap = (np.concatenate(x) for x in zip(*parts, strict=True))
        return row, box, gap

    def keys(self, q: np.ndarray, shift: np.ndarray, limit: np.ndarray, row: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and keys under their limits in the cells named, k of a cell where a row has no limit."""
        by = np.argsort(cell, kind="stable")
        row, cell = row[by], cell[by]
        cut = np.flatnonzero(np.r_[True, np.diff(cell) != 0]) if len(cell) else np.empty(0, np.int64)
        rows, found = [np.empty(0, np.int64)], [np.empty(0)]
        turned = q * (-2.0 * self.scale)
        for a, b, c in zip(cut, np.r_[cut[1:], len(cell)], cell[cut], strict=True):
            own, x, y = row[a:b], self.starts[c], self.ends[c]
            key = turned[own] @ self.rows[x:y].T
            key += self.tail[x:y]
            key += shift[own][:, None]
            if key.shape[1] > k and not np.isfinite(limit[own]).any():
                rows.append(np.repeat(own, k))
                found.append(np.partition(key, k - 1, axis=1)[:, :k].ravel())
                continue
            at = np.flatnonzero(key < limit[own][:, None])
            if len(at):
                rows.append(own[at // (y - x)])
                found.append(key.ravel()[at])
        return np.concatenate(rows), np.concatenate(found)


def nearest(asked: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest points of each asked row, in order; of equal distances the smaller
    place comes first. -1 where there are fewer than k points."""
    n, m = len(points), len(asked)
    place, distance = np.full((m, k), -1, np.int64), np.full((m, k), -1, np.int64)
    if not n or not m:
        return place, distance
    qq, rr = (asked * asked).sum(axis=1), (points * points).sum(axis=1)
    scale = float(1 << (n - 1).bit_length())
    if 4.0 * max(qq.max(), rr.max()) * scale + scale >= _EXACT and n > 1:
        # Distance and place don't fit one number: two halves.
        (p, d), (p2, d2) = nearest(asked, points[: n // 2], k), nearest(asked, points[n // 2 :], k)
        p, d = np.hstack([p, np.where(p2 < 0, -1, p2 + n // 2)]), np.hstack([d, d2])
        best = np.lexsort((p, d, p < 0), axis=1)[:, :k]
        return np.take_along_axis(p, best, 1), np.take_along_axis(d, best, 1)
    tree = _Tree(points, max(POINTS, 2 * k), scale)
    home = tree.home(asked) if m <= ASKED else np.concatenate([tree.home(asked[a : a + ASKED]) for a in range(0, m, ASKED)])
    rows = np.argsort(home, kind="stable")  # rows that are close together are asked together
    step = max(1, min(ASKED, PAIRS * 4 // k))
    for a in range(0, m, step):
        own = rows[a : a + step]
        q, shift, first = asked[own], qq[own] * scale, home[own]
        kept = np.full((len(own), k), np.inf)
        kept = _merged(kept, *tree.keys(q, shift, kept[:, -1], np.arange(len(own)), first, k))
        # A box as far as the k-th row may hold one of a smaller place.
        row, cell, gap = tree.reached(q, np.floor(kept[:, -1] / scale))
        other = np.flatnonzero(cell != first[row])
        row, cell, gap = row[other], cell[other], gap[other]
        by = np.lexsort((gap, row))
        row, cell, gap = row[by], cell[by], gap[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        low = 0
        for high in (*READ, len(tree.starts)):
            now = np.flatnonzero((rank >= low) & (rank < high) & (gap * scale <= kept[row, -1]))
            if len(now):
                found, key = tree.keys(q, shift, kept[:, -1], row[now], cell[now], k)
                if len(found):
                    kept = _merged(kept, found, key)
            low = high
        whole = np.where(np.isfinite(kept), kept, -1.0).astype(np.int64)
        place[own], distance[own] = np.where(whole < 0, -1, whole % int(scale)), np.where(whole < 0, -1, whole // int(scale))
    return place, distance


def nearest_from(asked: np.ndarray, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of the nearest point of each asked row, of equal ones the smallest place, where `start` is
    the place of any point, at best a close one: what is not farther than it lies within twice its distance around it."""
    near = ((asked - points[start]) ** 2).sum(axis=1)
    place = start.astype(np.int64)
    if not len(asked):
        return place, near.astype(np.int64)
    order = np.lexsort((near, start))
    first = np.flatnonzero(np.r_[True, np.diff(start[order]) != 0])
    ends, heads = np.r_[first[1:], len(order)], start[order][first]
    late = []
    reach, pp, qq = 4.0 * near[order][ends - 1], (points * points).sum(axis=1), (asked * asked).sum(axis=1)
    turned, step = -2.0 * points, max(1, PAIRS * 4 // len(points))
    for a in range(0, len(heads), step):
        own = heads[a : a + step]
        gap = points[own] @ turned.T
        gap += pp
        gap += pp[own][:, None]
        flat = np.flatnonzero(gap <= reach[a : a + step, None])
        found, far = flat % len(points), gap.ravel()[flat]
        cut = np.searchsorted(flat, np.arange(len(own) + 1) * len(points))
        for i in range(len(own)):
            every, distance = found[cut[i] : cut[i + 1]], far[cut[i] : cut[i + 1]]
            x, y = first[a + i], ends[a + i]
            while x < y:  # the closer half needs less of them
                z = y if y - x < 16 else (x + y) // 2
                rows = order[x:z]
                some = every if z == y else every[distance <= 4.0 * near[rows[-1]]]
                if len(some) > MANY:  # so have the farther rows of this start
                    late.append(order[x:y])
                    break
                z = min(z, x + PAIRS // len(some))
                rows = order[x:z]
                if len(some) > 1:
                    key = asked[rows] @ turned[some].T
                    key += pp[some]
                    best = key.argmin(axis=1)
                    place[rows] = some[best]
                    near[rows] = key[np.arange(len(rows)), best] + qq[rows]
                x = z
    if late:
        rows = np.concatenate(late)
        place[rows], near[rows] = (x[:, 0] for x in nearest(asked[rows], points, 1))
    return place, near.astype(np.int64)
