"""Clustering of one recording's vectors: spectral for short ones, a neighbour graph with
density clustering for long ones; numpy inside one group function a file.

Spectral clustering runs below 20 minutes (some 2,500 windows) unless another boundary is set. Over
FULL_MATRIX windows it keeps only the pruned entries, in a scratch file, and asks for the few
eigenvectors that it needs. Longer recordings go through a k-nearest-neighbour graph in blocks.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import SPECTRAL_BELOW


DIFFUSION = 8  # steps
FULL_MATRIX = 3000  # rows
ENTRIES = 2_000_000  # of a matrix, held at once


@dataclass(frozen=True)
class SpectralConfig:
    min_speakers: int = 1
    max_speakers: int = 15
    pval: float = 0.012
    min_pnum: int = 6
    min_cluster: int = 4
    merge_cos: float | None = 0.875
    oracle_num: int | None = None
    line: int = 10  # fewer vectors are one speaker


@dataclass(frozen=True)
class DensityConfig:
    neighbours: int = 40
    components: int = 60
    min_samples: int = 20
    min_size: int = 10
    min_cluster: int = 10
    merge_cos: float | None = 0.875
    line: int = 10
    seed: int = 42
    reassign_noise: bool = False


def load_config(path: str) -> SpectralConfig | DensityConfig:
    """Reads a YAML file of one of the two; keys are the fields' names, `cluster_type` says which."""
    import yaml

    with open(path) as f:
        values = yaml.safe_load(f) or {}
    values = values.get("cluster", values)
    kinds = {"spectral": SpectralConfig, "umap_hdbscan": DensityConfig}
    kind = values.pop("cluster_type", "spectral")
    if kind not in kinds:
        raise ValueError(f"unknown cluster type {kind!r}; agglomerative clustering is not offered")
    known = kinds[kind].__dataclass_fields__
    unknown = set(values) - set(known)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return kinds[kind](**values)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x, dtype=np.float64), where=length > 0)


def kmeans(x: np.ndarray, k: int, seed: int = 0, tries: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels of the best of some seeded k-means++ runs."""
    rng = np.random.default_rng(seed)
    best, best_cost = np.zeros(len(x), int), np.inf
    square = (x * x).sum(axis=1)
    for _ in range(tries if k > 1 else 1):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = np.maximum(square[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0).min(axis=1)
            total = d.sum()
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))]])
        label = None
        for _ in range(rounds):
            d = square[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
            now = d.argmin(axis=1)
            if label is not None and (now == label).all():
                break
            label = now
            sums, n = np.zeros_like(centres), np.bincount(label, minlength=k)
            np.add.at(sums, label, x)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        cost = np.maximum(d[np.arange(len(x)), label], 0).sum()
        if cost < best_cost - 1e-12:
            best, best_cost = label, cost
    return best


def eigen_gap(values: np.ndarray, least: int, most: int) -> int:
    """The number of clusters: the place of the largest gap of the smallest eigenvalues, the first of equal ones."""
    gaps = np.diff(values[least - 1 : most + 1])
    return int(gaps.argmax()) + least if len(gaps) else least


def spectral_labels(x: np.ndarray, config: SpectralConfig = SpectralConfig()) -> np.ndarray:
    n = len(x)
    u = unit(x.astype(np.float64))
    drop = min(int((1 - config.pval) * n), n - config.min_pnum)
    if n > FULL_MATRIX:
        times, degree = pruned_laplacian(u, n - max(drop, 0))
        values, basis = smallest_eigen(times, n, config.oracle_num or config.max_speakers + 1, 2 * degree.max())
    else:
        sim = u @ u.T
        if drop > 0:
            low = np.argsort(sim, axis=1, kind="stable")[:, :drop]
            np.put_along_axis(sim, low, 0.0, axis=1)
        w = 0.5 * (sim + sim.T)
        np.fill_diagonal(w, 0.0)
        graph = np.diag(np.abs(w).sum(axis=1)) - w
        values, basis = np.linalg.eigh(graph)
    k = config.oracle_num or eigen_gap(values, config.min_speakers, config.max_speakers)
    return kmeans(basis[:, :k], k)


def pruned_laplacian(u: np.ndarray, keep: int) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """The product of a vector and the Laplacian of unit rows, each with its `keep` largest cosines, and
    the Laplacian's diagonal.

    Of equal cosines the later ones stay, as in the full matrix. The kept entries lie in scratch
    files without a name, so that memory holds a block of rows."""
    n = len(u)
    cols, vals = (np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n, keep)) for kind in (np.int32, np.float64))
    rows, step = max(1, ENTRIES // n), max(1, ENTRIES // keep)
    for a in range(0, n, rows):
        sim = u[a : a + rows] @ u.T
        least = np.partition(sim, n - keep, axis=1)[:, n - keep, None]
        hit = sim >= least
        for r in np.flatnonzero(hit.sum(axis=1) > keep):
            ties = np.flatnonzero(sim[r] == least[r])
            hit[r, ties[: hit[r].sum() - keep]] = False
        at = np.flatnonzero(hit)
        j, v = (at % n).reshape(-1, keep), 0.5 * sim.ravel()[at].reshape(-1, keep)
        v[j == np.arange(a, a + len(j))[:, None]] = 0.0
        cols[a : a + rows], vals[a : a + rows] = j, v

    def weights(y: np.ndarray, of: Callable[[np.ndarray], np.ndarray] = np.asarray) -> np.ndarray:
        """By the kept entries and their transpose: half of either is a weight."""
        out = np.zeros(n)
        for a in range(0, n, step):
            j, v = np.asarray(cols[a : a + step]), of(vals[a : a + step])
            out[a : a + step] += np.einsum("rk,rk->r", v, y.take(j))
            out += np.bincount(j.ravel(), (v * y[a : a + step, None]).ravel(), n)
        return out

    degree = weights(np.ones(n), np.abs)  # an entry and its transpose have one sign
    return lambda y: degree * y - weights(y), degree


def smallest_eigen(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, scale: float, room: int = 400, precision: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenvalues of a symmetric matrix, given by its product with a vector, and their
    vectors as columns: Lanczos with full orthogonalisation and thick restarts, from a seeded start.

    One start finds one vector of equal eigenvalues, so others follow, each orthogonal to all that was
    found, until one brings nothing smaller. `scale`: no eigenvalue is larger."""
    rng = np.random.default_rng(0)
    values, found = np.zeros(0), np.zeros((0, n))
    while len(found) < n:
        want = k if not len(found) else 1
        got, vectors = _lanczos(times, found, min(want, n - len(found)), values[-1] if len(values) >= k else np.inf, scale, room, precision, rng)
        if len(values) >= k and got[0] >= values[-1] - precision * scale:
            break
        values, found = np.append(values, got), np.vstack([found, vectors])
        order = np.argsort(values, kind="stable")[:k]
        values, found = values[order], found[order]
    return values, found.T


def _lanczos(times, locked, want, below, scale, room, precision, rng) -> tuple[np.ndarray, np.ndarray]:
    """The smallest pairs orthogonal to `locked`; ends early when the smallest can't be under `below`."""
    n = locked.shape[1]
    room = min(room, n - len(locked))
    basis, h, m = np.zeros((room + 1, n)), np.zeros((room, room)), 0

    def rest(w: np.ndarray, m: int) -> np.ndarray:
        for b in (locked, basis[:m], locked, basis[:m]):
            w = w - (b @ w) @ b
        return w

    w = rest(rng.normal(size=n), 0)
    basis[0] = w / np.linalg.norm(w)
    while True:
        w = times(basis[m])
        h[: m + 1, m] = h[m, : m + 1] = basis[: m + 1] @ w
        w = rest(w, m + 1)
        m, size = m + 1, np.linalg.norm(w)
        closed = size <= 1e-13 * scale  # what is found so far stays in itself: go on from another start
        if m % 20 == 0 or m == room or closed:
            value, part = np.linalg.eigh(h[:m, :m])
            off = (0.0 if closed else size) * np.abs(part[-1, :want])
            if len(off) == want and (off <= precision * scale).all() or value[0] - off[0] > below:
                return value[:want], part[:, :want].T @ basis[:m]
            if m == room:
                m = min(want + room // 4, room - 1)
                basis[:m] = part[:, :m].T @ basis[: len(part)]
                h[:] = 0
                np.fill_diagonal(h[:m, :m], value[:m])
        if closed:
            w = rest(rng.normal(size=n), m)
            size = np.linalg.norm(w)
        basis[m] = w / size


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """np.add.at(out, at, rows) by sums over runs of equal places."""
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def smallest_of_rows(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k smallest values in order, ties by column."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    most = np.partition(d, k - 1, axis=1)[:, k - 1, None]
    row, col = np.divmod(np.flatnonzero(d <= most), d.shape[1])
    order = np.lexsort((d[row, col], row))
    start = np.searchsorted(row, np.arange(len(d)))
    return col[order][start[:, None] + np.arange(k)]


def neighbours(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, cosine distances) of each row's k nearest rows, itself first; a block of rows at a time."""
    u = unit(x.astype(np.float64))
    n, k = len(x), min(k, len(x))
    block = max(1, ENTRIES // n)
    idx, dist = np.empty((n, k), int), np.empty((n, k))
    for a in range(0, n, block):
        d = np.maximum(1 - u[a : a + block] @ u.T, 0)
        rows = np.arange(len(d))
        d[rows, a + rows] = -1
        idx[a : a + block] = near = smallest_of_rows(d, k)
        dist[a : a + block] = np.maximum(np.take_along_axis(d, near, axis=1), 0)
    return idx, dist


def fuzzy_graph(idx: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, weight), i < j, of the fuzzy union of local neighbourhoods: each row's bandwidth is
    such that its weights sum to log2 of the number of neighbours."""
    n, k = idx.shape
    d = dist[:, 1:]
    nearest = np.where(d > 0, d, np.inf).min(axis=1)
    nearest = np.where(np.isfinite(nearest), nearest, 0)
    lo, hi = np.full(n, 1e-9), np.full(n, 1e3)
    for _ in range(50):
        mid = (lo + hi) / 2
        mass = np.exp(-np.maximum(d - nearest[:, None], 0) / mid[:, None]).sum(axis=1)
        hi, lo = np.where(mass > np.log2(max(k, 2)), mid, hi), np.where(mass > np.log2(max(k, 2)), lo, mid)
    p = np.exp(-np.maximum(d - nearest[:, None], 0) / ((lo + hi) / 2)[:, None])
    i, j = np.repeat(np.arange(n), k - 1), idx[:, 1:].ravel()
    low, high, forward = np.minimum(i, j), np.maximum(i, j), i < j
    order = np.lexsort((low, high))
    low, high, forward, p = low[order], high[order], forward[order], p.ravel()[order]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    miss = np.multiply.reduceat(1 - p, first)  # fuzzy union: a + b - ab
    return low[first], high[first], 1 - miss


def umap_layout(x: np.ndarray, config: DensityConfig = DensityConfig(), epochs: int = 80) -> np.ndarray:
    """A low-dimensional layout: a spectral start on the fuzzy graph, then attraction along its
    edges and repulsion from seeded random rows (min_dist 0)."""
    n = len(x)
    dims = max(2, min(config.components, n - 2))
    idx, dist = neighbours(x, config.neighbours)
    i, j, w = fuzzy_graph(idx, dist)
    rng = np.random.default_rng(config.seed)
    y = _spectral_start(n, i, j, w, min(dims, 16), rng)
    y = np.hstack([y, rng.normal(scale=1e-3, size=(n, dims - y.shape[1]))])
    edges = max(1, ENTRIES // dims // 4)  # at once
    a, b = 1.93, 0.79  # fixed values: the curve for min_dist 0 and spread 1
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        pick = rng.random(len(w)) < w / w.max()
        p, q = i[pick], j[pick]
        far = rng.integers(n, size=len(p))
        step = np.zeros_like(y)
        for c in range(0, len(p), edges):
            at = slice(c, c + edges)
            start = y[p[at]]
            diff = start - y[q[at]]
            d2 = np.maximum(np.einsum("ed,ed->e", diff, diff), 1e-9)
            pull = np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * diff, -4, 4)
            add_rows(step, q[at], -pull)
            diff = start - y[far[at]]
            d2 = np.einsum("ed,ed->e", diff, diff)
            pull += np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * diff, -4, 4)
            add_rows(step, p[at], pull)
        load = np.bincount(p, minlength=n) + np.bincount(q, minlength=n)
        y += rate * step / np.maximum(load, 1)[:, None]
    return y


def _spectral_start(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 60) -> np.ndarray:
    """The leading eigenvectors of the normalised graph by orthogonal iteration on its edges, each
    scaled by a power of its eigenvalue, as after so many steps of diffusion."""
    degree = np.bincount(i, w, n) + np.bincount(j, w, n)
    v = w / np.sqrt(np.maximum(degree[i] * degree[j], 1e-12))
    y = np.linalg.qr(rng.normal(size=(n, k)))[0]

    edges = max(1, ENTRIES // k // 4)  # at once

    def times(y: np.ndarray) -> np.ndarray:
        z = np.zeros_like(y)
        for c in range(0, len(v), edges):
            p, q, size = i[c : c + edges], j[c : c + edges], v[c : c + edges, None]
            add_rows(z, p, size * y[q])
            add_rows(z, q, size * y[p])
        return z

    for _ in range(rounds):  # the graph plus one, so that all eigenvalues are positive
        y = np.linalg.qr(y + times(y))[0]
    value = np.clip((y * times(y)).sum(axis=0), 0, 1)
    y = y * value**DIFFUSION
    return 10 * y / np.abs(y).max()


def hdbscan_labels(x: np.ndarray, min_samples: int = 20, min_size: int = 10, cosine: bool = False) -> np.ndarray:
    """HDBSCAN: mutual reachability, its minimum spanning tree, the condensed tree and the clusters of
    the largest excess of mass; -1 is noise. A block of distance rows is held at a time."""
    n = len(x)
    if n < max(2, min_size):
        return np.full(n, -1)
    y = unit(x.astype(np.float64)) if cosine else x.astype(np.float64)
    edges = from_first(reachability_tree(y, min(min_samples, n)), n)
    edges.sort(key=lambda e: e[0])
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    children: dict[int, tuple[int, int, float]] = {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for m, (d, a, b) in enumerate(edges):
        a, b = find(a), find(b)
        children[n + m] = (a, b, d)
        size[n + m] = size[a] + size[b]
        parent[a] = parent[b] = n + m
    return _excess_of_mass(children, size, n, min_size)


def reachability_tree(y: np.ndarray, samples: int, near: int = 32) -> list[tuple[float, int, int]]:
    """The edges (distance, a, b) of a minimum spanning tree of mutual reachability.

    Groups grow by the shortest edge that leaves them (which any tree of least length has), found
    among each row's nearest rows where those must hold it. Where they need not, rows are compared
    with all others, those of the smaller half of the groups at a time; the largest group waits."""
    n, square = len(y), (y * y).sum(axis=1)
    near = min(max(near, samples), n)
    block = max(1, ENTRIES // n)
    idx, dist = np.empty((n, near), np.int32), np.empty((n, near))

    def squares(rows) -> np.ndarray:
        return np.maximum(square + square[rows, None] - 2 * (y[rows] @ y.T), 0)

    for a in range(0, n, block):
        d = squares(np.arange(a, min(a + block, n)))
        idx[a : a + block] = best = smallest_of_rows(d, near)
        dist[a : a + block] = np.take_along_axis(d, best, axis=1)
    core, beyond = dist[:, samples - 1].copy(), dist[:, -1].copy()
    dist = np.maximum(np.maximum(dist, core[:, None]), core[idx])
    if near == n:
        beyond[:] = np.inf
    group, edges = np.arange(n), []
    while len(edges) < n - 1:
        size = np.bincount(group)
        largest = size.argmax()
        outside = np.where(group[idx] != group[:, None], dist, np.inf)
        place = outside.argmin(axis=1)
        length, to = outside[np.arange(n), place], idx[np.arange(n), place].astype(int)
        shortest = np.full(len(size), np.inf)
        np.minimum.at(shortest, group, length)
        unsure = np.maximum(beyond, core) < shortest[group]
        open_ = np.zeros(len(size), bool)
        open_[group[unsure]] = True
        ready = ~open_
        ready[largest] = len(size) == 2 and ready[largest]
        if not ready.any():
            others = np.delete(np.arange(len(size)), largest)
            ready[others[size[others] <= np.median(size[others])]] = True
            rows = np.flatnonzero(unsure & ready[group])
            for a in range(0, len(rows), block):
                r = rows[a : a + block]
                d = np.maximum(np.maximum(squares(r), core), core[r, None])
                d[group[r, None] == group] = np.inf
                to[r] = d.argmin(axis=1)
                length[r] = d[np.arange(len(r)), to[r]]
        rows = np.flatnonzero(ready[group])
        rows = rows[np.lexsort((rows, length[rows], group[rows]))]
        rows = rows[np.append(True, group[rows][1:] != group[rows][:-1])]
        parent = list(range(len(size)))

        def find(a: int) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        for r in rows[np.argsort(length[rows], kind="stable")].tolist():
            a, b = find(group[r]), find(group[to[r]])
            if a != b:  # else groups chose equal edges of a circle
                parent[a] = b
                edges.append((float(np.sqrt(length[r])), r, int(to[r])))
        group = np.unique(np.array([find(a) for a in range(len(size))])[group], return_inverse=True)[1]
    return edges


def from_first(edges: list[tuple[float, int, int]], n: int) -> list[tuple[float, int, int]]:
    """A tree's edges in the order in which it grows from row 0 by the shortest, each from the inside out:
    this order gives clusters their numbers."""
    beside: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]
    for d, a, b in edges:
        beside[a].append((d, b, a))
        beside[b].append((d, a, b))
    out, heap, seen = [], list(beside[0]), {0}
    heapq.heapify(heap)
    while heap:
        d, at, link = heapq.heappop(heap)
        if at not in seen:
            seen.add(at)
            out.append((d, link, at))
            for e in beside[at]:
                heapq.heappush(heap, e)
    return out


def _points(tree: dict, node: int, n: int) -> list[int]:
    out, todo = [], [node]
    while todo:
        a = todo.pop()
        if a < n:
            out.append(a)
        else:
            todo += tree[a][:2]
    return out


def _excess_of_mass(tree: dict, size: list[int], n: int, least: int) -> np.ndarray:
    """Clusters are runs of tree nodes that lose less than `least` points at a time; of a cluster and
    the clusters it parts into, those of the larger stability (sum of 1/distance lived) stay."""
    birth, stable, split, leaves = {}, {}, {}, {}
    todo = [(2 * n - 2, 0.0)]
    order = []
    while todo:
        head, born = todo.pop()
        order.append(head)
        birth[head], stable[head], split[head], leaves[head] = born, 0.0, (), []
        node = head
        while node >= n:
            a, b, d = tree[node]
            level = 1 / max(d, 1e-12)
            big = [c for c in (a, b) if size[c] >= least]
            if len(big) == 2:
                stable[head] += size[node] * (level - born)
                split[head] = (a, b)
                todo += [(a, level), (b, level)]
                break
            for c in (a, b):
                if c not in big:
                    stable[head] += size[c] * (level - born)
                    leaves[head] += _points(tree, c, n)
            if not big:
                break
            node = big[0]
    chosen: set[int] = set()
    value: dict[int, float] = {}
    for head in reversed(order):
        below = sum(value[c] for c in split[head])
        root = head == 2 * n - 2
        if split[head] and (below > stable[head] or root):
            value[head] = below
        else:
            value[head] = stable[head]
            if not root or not split[head]:
                chosen.add(head)
    label, next_label, todo = np.full(n, -1), 0, [2 * n - 2]
    while todo:  # from the top: a chosen cluster takes all that is under it
        head = todo.pop()
        if head in chosen and head != 2 * n - 2:
            label[_points(tree, head, n) if head >= n else [head]] = next_label
            next_label += 1
        else:
            todo += split[head][::-1]
    return label


def merge_labels_by_cosine(sums: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """For labels in order, with their vectors' sums and counts: the label each ends in when the most
    alike two are merged, the higher into the lower, while their cosine is `threshold` or more."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    sums, n = sums.astype(np.float64).copy(), n.astype(np.float64).copy()
    to, alive = np.arange(len(n)), list(range(len(n)))
    while len(alive) > 1:
        u = unit(sums[alive] / n[alive, None])
        sim = np.triu(u @ u.T, 1)
        sim[np.tril_indices(len(alive))] = -np.inf
        a, b = np.unravel_index(sim.argmax(), sim.shape)
        if sim[a, b] < threshold:
            break
        low, high = alive[a], alive[b]
        sums[low] += sums[high]
        n[low] += n[high]
        to[to == high] = low
        alive.pop(b)
    return to


def reassign_minor(x: np.ndarray, label: np.ndarray, least: int) -> np.ndarray:
    names, count = np.unique(label, return_counts=True)
    major = names[count >= least]
    if not len(major):
        return np.zeros_like(label)
    cents = unit(np.stack([x[label == m].mean(axis=0) for m in major]))
    out, minor = label.copy(), ~np.isin(label, major)
    out[minor] = major[(unit(x[minor].astype(np.float64)) @ cents.T).argmax(axis=1)] if minor.any() else out[minor]
    return out


def cluster(x: np.ndarray, config: SpectralConfig | DensityConfig) -> np.ndarray:
    """Labels of one recording's vectors: fewer than `line` are one speaker; otherwise clusters, then
    minor ones reassigned, then like ones merged. Noise counts as one more cluster (and may be a
    speaker, if it is large) unless the configuration reassigns it."""
    if len(x) < config.line:
        return np.ones(len(x), int)
    if isinstance(config, SpectralConfig):
        label = spectral_labels(x, config)
    else:
        label = hdbscan_labels(umap_layout(x, config), config.min_samples, config.min_size)
        if config.reassign_noise and (label >= 0).any() and (label < 0).any():
            cents = unit(np.stack([x[label == m].mean(axis=0) for m in range(label.max() + 1)]))
            label[label < 0] = (unit(x[label < 0].astype(np.float64)) @ cents.T).argmax(axis=1)
    label = reassign_minor(x, label, config.min_cluster)
    if config.merge_cos:
        names, at = np.unique(label, return_inverse=True)
        sums = np.zeros((len(names), x.shape[1]))
        np.add.at(sums, at, x)
        label = names[merge_labels_by_cosine(sums, np.bincount(at), config.merge_cos)[at]]
    return label


def cluster_files(vectors: DataFrame, short: SpectralConfig = SpectralConfig(), long: DensityConfig = DensityConfig(), boundary: float = SPECTRAL_BELOW) -> DataFrame:
    """(file_id, idx, label) of vectors (file_id, idx, end, embedding): spectral where the last window
    ends before `boundary` seconds, density clustering otherwise."""
    key = vectors.schema["file_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x = np.stack(pdf["embedding"].to_list()).astype(np.float64)
        config = short if pdf["end"].iloc[-1] < boundary else long
        return pd.DataFrame({"file_id": pdf["file_id"], "idx": pdf["idx"], "label": cluster(x, config).astype(np.int32)})

    return vectors.select("file_id", F.col("idx").cast("long").alias("idx"), F.col("end").cast("double").alias("end"), "embedding").groupBy("file_id").applyInPandas(one, f"file_id {key}, idx long, label int")
