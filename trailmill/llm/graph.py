"""Navigable small-world graphs in numpy, built and searched in blocks of points.

A graph is built by insertion: each block of new points is searched for in
the graph so far, compared within itself, and linked both ways to near points
that are not nearer to one another than to the new point.  Search keeps a beam
of ``beam`` best points a query and expands the best unexpanded ones of all
queries of the block at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
#: Up to so many points an exhaustive search costs less than a walk; links are laid when a shard grows beyond.
EXHAUSTIVE = 512
EXPAND = 4


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest of each row, greatest first."""
    if sims.shape[1] > 4 * k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


class SmallWorld:
    """One shard: unit vectors, and up to ``2 * degree`` neighbours of each."""

    def __init__(self, dim: int, degree: int = 8, seed: int = 7) -> None:
        self.degree, self.width = degree, 2 * degree
        self.x = np.zeros((0, dim), np.float32)
        self.links = np.zeros((0, self.width), np.int32)
        self.fill = np.zeros(0, np.int32)
        self.seed = seed

    def __len__(self) -> int:
        return len(self.x)

    def add(self, new: np.ndarray, beam: int = 32) -> list[tuple[np.ndarray, np.ndarray]]:
        """Inserts the rows of ``new``; for each block: ids and similarities of points near, of those that stood before (-2: none)."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(new), BLOCK):
            block = new[at : at + BLOCK]
            base, n = len(self.x), len(block)
            ids, sims = self.search(block, beam)
            within = np.where(np.tri(n, k=-1, dtype=bool), block @ block.T, -2.0).astype(np.float32)
            own = _top(within, min(beam, n))
            ids = np.concatenate([ids, own + base], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(within, own, 1)], axis=1)
            order = _top(sims, beam)
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            found.append((ids, sims))
            self.x = np.concatenate([self.x, block])
            if len(self.x) > EXHAUSTIVE:
                self._lay(base, ids, sims)
        return found

    def _lay(self, base: int, ids: np.ndarray, sims: np.ndarray) -> None:
        """Links the points from ``base`` on; the first time, all points before them too."""
        laid = len(self.links)
        grow = len(self.x) - laid
        self.links = np.concatenate([self.links, np.full((grow, self.width), -1, np.int32)])
        self.fill = np.concatenate([self.fill, np.zeros(grow, np.int32)])
        for at in range(laid, base, BLOCK):
            end = min(base, at + BLOCK)
            all_sims = np.where(np.tri(end - at, base, at - 1, dtype=bool), self.x[at:end] @ self.x[:base].T, -2.0)
            order = _top(all_sims, min(24, base))
            self._connect(np.arange(at, end), order, np.take_along_axis(all_sims, order, 1))
        self._connect(np.arange(base, len(self.x)), ids, sims)

    def _connect(self, own: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Links ``own`` and its chosen neighbours both ways."""
        take = self._spread(ids, sims)
        i, k = np.nonzero(take)
        a, b, s = own[i], ids[i, k], sims[i, k]
        self._link(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]))

    def _spread(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Which neighbours to take: those not nearer to one taken already than to the point, then the nearest, up to half the degree."""
        near = self.x[np.maximum(ids, 0)]
        among = np.einsum("bkd,bjd->bkj", near, near)
        there = sims > -1.5
        take = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -2.0, np.float32)  # to the nearest one taken
        for k in range(ids.shape[1]):
            take[:, k] = there[:, k] & (closest[:, k] < sims[:, k]) & (take.sum(1) < self.degree)
            closest = np.where(take[:, k, None], np.maximum(closest, among[:, k]), closest)
        for k in range(ids.shape[1]):
            take[:, k] |= there[:, k] & (take.sum(1) < self.degree // 2)
        return take

    def _link(self, to: np.ndarray, new: np.ndarray, sims: np.ndarray) -> None:
        """Adds neighbours; where a point has too many, the farthest give way, but for its first two, long links."""
        order = np.lexsort((-sims, to))
        to, new, sims = to[order], new[order], sims[order]
        points, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        rows = np.repeat(np.arange(len(points)), count)
        keep = rank < self.width
        ids = np.full((len(points), 2 * self.width), -1, np.int64)
        s = np.full(ids.shape, -2.0, np.float32)
        old = self.links[points]
        ids[:, : self.width] = old
        s[:, : self.width] = np.where(old >= 0, np.einsum("pwd,pd->pw", self.x[np.maximum(old, 0)], self.x[points]), -2.0)
        s[:, :2] = np.where(old[:, :2] >= 0, 9.0, -2.0)
        ids[rows[keep], self.width + rank[keep]] = new[keep]
        s[rows[keep], self.width + rank[keep]] = sims[keep]
        twice = (ids[:, self.width :, None] == old[:, None, :]).any(2)
        s[:, self.width :][twice] = -2.0
        best = np.argsort(-s, axis=1, kind="stable")[:, : self.width]
        self.links[points] = np.where(np.take_along_axis(s, best, 1) > -1.5, np.take_along_axis(ids, best, 1), -1)
        self.fill[points] = (self.links[points] >= 0).sum(1)

    def walked(self, beam: int) -> bool:
        """Whether a search with this beam walks the links; if not, it looks at every point."""
        return len(self.links) == len(self.x) > 4 * beam

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of up to ``beam`` points near each query, nearest first; -2 marks places not filled."""
        n, b = len(self.x), len(q)
        if not n:
            return np.zeros((b, 0), np.int64), np.zeros((b, 0), np.float32)
        if not self.walked(beam):
            sims = q @ self.x.T
            ids = _top(sims, min(beam, n))
            return ids, np.take_along_axis(sims, ids, 1)
        rng = np.random.default_rng(self.seed)
        entry = np.unique(np.concatenate([[0], rng.integers(0, n, int(4 * n**0.5))]))
        first = q @ self.x[entry].T
        width = min(beam, len(entry))
        top = _top(first, width)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -2.0, np.float32)
        ids[:, :width], sims[:, :width] = entry[top], np.take_along_axis(first, top, 1)
        seen = np.zeros((b, n), bool)
        seen[np.arange(b)[:, None], ids[:, :width]] = True
        done = ids < 0
        live = np.arange(b)
        while len(live):
            open_sims = np.where(done[live], -3.0, sims[live])
            best = _top(open_sims, EXPAND)
            ok = np.take_along_axis(open_sims, best, 1) > -2.5
            keep = ok[:, 0]
            live, best, ok = live[keep], best[keep], ok[keep]
            if not len(live):
                break
            np.put_along_axis(d := done[live], best, True, 1)
            done[live] = d
            at = np.where(ok, np.take_along_axis(ids[live], best, 1), -1)
            around = np.where(at[:, :, None] >= 0, self.links[at], -1).reshape(len(live), -1)
            fresh = (around >= 0) & ~seen[live[:, None], around]
            around = np.sort(np.where(fresh, around, -1), axis=1)  # a point named twice in one step counts once
            fresh = around >= 0
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            r, c = np.nonzero(fresh)
            point = around[r, c]
            seen[live[r], point] = True
            s = np.full(around.shape, -2.0, np.float32)
            s[r, c] = np.einsum("kd,kd->k", self.x[point], q[live[r]])
            all_sims = np.concatenate([sims[live], s], 1)
            order = _top(all_sims, beam)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], around], 1), order, 1)
            sims[live] = np.take_along_axis(all_sims, order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), order, 1)
        return ids, sims

    def tuned_beam(self, recall: float = 0.99, start: int = 24, probes: int = 64, top: int = 4) -> int:
        """The least beam (doubled from ``start``) whose ``top`` answers reach ``recall`` of an exhaustive search."""
        n = len(self.x)
        if not self.walked(start):
            return start
        at = np.random.default_rng(self.seed + 1).choice(n, min(probes, n), replace=False)
        q = self.x[at]
        exact = np.sort(-(q @ self.x.T), axis=1)[:, :top]
        beam = start
        while self.walked(beam):
            _, sims = self.search(q, beam)
            if np.mean(-sims[:, :top] <= exact + 1e-5) >= recall:
                return beam
            beam *= 2
        return beam  # beyond, ``search`` looks at every point
