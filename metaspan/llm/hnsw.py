"""A hierarchical navigable small-world graph, built and searched for many vectors at once with numpy.

Layers are built from the top down: a layer holds the points whose level reaches it, in batches no larger than what the
layer already holds. Each batch is searched for in the layers above and in the layer so far, compared with itself, and
joined to its nearest points by the usual rule: a candidate is taken if it is nearer to the new point than to any one
already taken. Levels come from a hash, so a graph depends on its vectors alone.
"""

from __future__ import annotations

import numpy as np

M = 16
BATCH = 512


def levels(ids: np.ndarray, m: int = M) -> np.ndarray:
    """Level of each point: geometric with ratio 1/m, from the id's hash."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    u = (x >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-18
    return np.minimum(8, (-np.log(u) / np.log(m)).astype(np.int64))


def search_layer(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, widen: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search in one layer. links: (points, degree), -1 for none; entry: (queries, e) points, -1 for none.

    Returns (ids, similarities), ef wide, best first; -1 where the beam found fewer.
    """
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(q)[:, None]
    ids = np.full((q, ef), n, np.int64)
    sims = np.full((q, ef), -9.0, np.float32)
    done = np.ones((q, ef), bool)
    fresh = np.where(entry < 0, n, entry)
    active = np.arange(q)
    while len(active):
        r = rows[active]
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        fresh[seen[r, fresh]] = n
        seen[r, fresh] = True
        near = np.einsum("qd,qkd->qk", queries[active], vectors[np.minimum(fresh, n - 1)])
        near = np.where(fresh == n, np.float32(-9), near).astype(np.float32)
        all_ids = np.concatenate((ids[active], fresh), 1)
        all_sims = np.concatenate((sims[active], near), 1)
        all_done = np.concatenate((done[active], fresh == n), 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
        here = np.arange(len(active))[:, None]
        i, s, d = all_ids[here, order], all_sims[here, order], all_done[here, order]
        # expand the best points not yet expanded
        rank = np.cumsum(~d, axis=1)
        take = ~d & (rank <= widen)
        more = take.any(1)
        ids[active], sims[active], done[active] = i, s, d | take
        pick = np.where(take, i, n)
        pick = np.sort(pick, axis=1)[:, :widen]
        out = links[np.minimum(pick, n - 1)]
        out = np.where((pick == n)[:, :, None] | (out < 0), n, out).reshape(len(active), -1)
        active, fresh = active[more], out[more]
    return np.where(ids == n, -1, ids), sims


def _spread(vectors: np.ndarray, point: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """At most m of the candidates (best first), each nearer to the point than to those taken before; filled up in order."""
    keep = ids >= 0
    ids, sims = ids[keep], sims[keep]
    if len(ids) <= m:
        return ids
    cross = vectors[ids] @ vectors[ids].T
    taken: list[int] = []
    for k in range(len(ids)):
        if not taken or sims[k] > cross[k, taken].max():
            taken.append(k)
            if len(taken) == m:
                break
    rest = [k for k in range(len(ids)) if k not in set(taken)]
    return ids[(taken + rest)[:m]]


class Graph:
    """vectors: (n, d) float32 of length 1. links: one (n, degree) table per layer, bottom first; -1 for none."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, links: list[np.ndarray] | None = None, m: int = M, ef: int = 64):
        self.vectors, self.level, self.m, self.ef = np.ascontiguousarray(vectors, np.float32), levels(ids), m, ef
        top = int(self.level.max()) if len(ids) else 0
        self.links = links if links is not None else []
        self.tops = np.flatnonzero(self.level >= top)
        if links is None:
            self.links = [np.full((len(ids), 2 * m if layer == 0 else m), -1, np.int32) for layer in range(top + 1)]
            for layer in range(top, -1, -1):
                self._fill(layer, top)

    def _entry(self, queries: np.ndarray, down_to: int, ef: int = 4) -> np.ndarray:
        """Start points for a layer: the best of the layers above; the top layer's start anywhere in it."""
        entry = np.repeat(self.tops[None, :4], len(queries), 0)
        for layer in range(len(self.links) - 1, down_to, -1):
            entry, _ = search_layer(self.vectors, self.links[layer], queries, entry, ef)
        return entry

    def _fill(self, layer: int, top: int) -> None:
        links, degree = self.links[layer], self.links[layer].shape[1]
        # points from above come first: they are where searches enter
        points = np.flatnonzero(self.level >= layer)
        points = points[np.argsort(-self.level[points], kind="stable")]
        at = 0
        while at < len(points):
            batch = points[at : at + max(8, min(BATCH, at))]
            x = self.vectors[batch]
            inner = x @ x.T
            np.fill_diagonal(inner, -9)
            k = min(self.ef, len(batch))
            near = np.argsort(-inner, axis=1, kind="stable")[:, :k]
            ids, sims = batch[near], np.take_along_axis(inner, near, 1)
            ids = np.where(sims <= -8, -1, ids)
            if at:
                start = self._entry(x, layer) if layer < top else np.repeat(points[None, : min(4, at)], len(batch), 0)
                start = np.where(np.isin(start, points[:at]), start, points[0])
                found, s = search_layer(self.vectors, links, x, start, self.ef)
                ids, sims = np.concatenate((ids, found), 1), np.concatenate((sims, s), 1)
                order = np.argsort(-sims, axis=1, kind="stable")[:, : self.ef]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            back: dict[int, list[int]] = {}
            for p, i, s in zip(batch, ids, sims):
                near = _spread(self.vectors, p, i, s, self.m)
                links[p, : len(near)] = near
                for b in near.tolist():
                    back.setdefault(b, []).append(int(p))
            for b, new in back.items():
                have = links[b][links[b] >= 0]
                both = np.unique(np.concatenate((have, np.array(new))))
                if len(both) > degree:
                    s = self.vectors[both] @ self.vectors[b]
                    order = np.argsort(-s, kind="stable")
                    both = _spread(self.vectors, b, both[order], s[order], degree)
                links[b] = -1
                links[b, : len(both)] = both
            at += len(batch)

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the nearest points found, ef wide, -1 for none."""
        ef = min(ef, len(self.vectors))
        out = []
        for a in range(0, len(queries), BATCH):
            q = np.ascontiguousarray(queries[a : a + BATCH], np.float32)
            out.append(search_layer(self.vectors, self.links[0], q, self._entry(q, 0), ef))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
