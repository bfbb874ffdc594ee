"""Regions of interest on one image (a helper inside grouped tasks)."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np

#: The order in which neighbours are looked at decides ties.
STEPS = ((0, 1), (0, -1), (1, 0), (-1, 0))


def neighbours(px: int, height: int, width: int) -> Iterator[int]:
    d1, d2 = px % height, px // height
    for a, b in STEPS:
        if 0 <= d1 + a < height and 0 <= d2 + b < width:
            yield px + a + b * height


def falling(image: np.ndarray, nan_first: bool = False) -> list[int]:
    """Pixels by falling value, ties by number; NaN left out, or before all others."""
    order = np.argsort(-image, kind="stable")
    known = [int(p) for p in order if not np.isnan(image[p])]
    return np.flatnonzero(np.isnan(image)).tolist() + known if nan_first else known


def unit(weights: dict[int, float]) -> dict[int, float]:
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {p: w / norm for p, w in weights.items() if w > 0} if norm > 0 else {}


def flood_labels(image: np.ndarray, height: int, width: int, min_size: int, nan_first: bool = False) -> np.ndarray:
    """Clusters of a descending flood (0: none); a large neighbour absorbs small ones where they meet."""
    parent, size = [0], [0]
    label = np.zeros(len(image), int)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for p in falling(image, nan_first):
        near = [root(label[q]) for q in neighbours(p, height, width) if label[q]]
        if not near:
            parent.append(len(parent))
            size.append(1)
            label[p] = len(parent) - 1
            continue
        best = max(near, key=lambda r: size[r])
        label[p] = best
        size[best] += 1
        for r in dict.fromkeys(near):
            if r != best and size[r] < min_size:
                parent[r] = best
                size[best] += size[r]
    roots = np.array([root(k) for k in range(len(parent))])
    final = roots[label]
    return np.where(np.array(size)[final] >= min_size, final, 0)


def flood_tile(
    pixels: dict[int, float], known: dict[int, tuple[int, int]], size: dict[int, int], ring: dict[int, float], height: int, width: int, min_size: int
) -> tuple[dict[int, int], dict[int, int], list[int], dict[int, int], dict[int, int]]:
    """The flood of ``flood_labels`` on a tile, as far as it does not depend on pixels beyond.

    A pixel is settled if what is connected to it through earlier pixels lies
    within the tile; ``ring`` holds the pixels around the tile. ``known``
    (cluster, connected part) are pixels settled before that lie beside pixels
    that are not, ``size`` has the sizes of their clusters. A cluster is named
    by its first pixel. Returns the clusters and parts of settled pixels (known
    ones among them), the pixels left, the sizes of clusters, and the clusters
    that those of ``size`` are now.
    """
    parent, joined = dict.fromkeys(size), {}
    label, part, sizes = {p: k for p, (k, _) in known.items()}, {p: c for p, (_, c) in known.items()}, dict(size)
    beyond, outside, left = set(), set(), []

    def root(tree: dict, k: int) -> int:
        while tree.get(k) is not None:
            if tree.get(tree[k]) is not None:
                tree[k] = tree[tree[k]]
            k = tree[k]
        return k

    for _, p in sorted((-v, p) for table in (pixels, ring) for p, v in table.items()):
        beside = list(neighbours(p, height, width))
        near = [q for q in beside if q in part]
        if p in ring:
            outside.add(p)
            beyond.update(root(joined, part[q]) for q in near)
            continue
        parts = {root(joined, part[q]) for q in near}
        reaches = not beyond.isdisjoint(parts) or not outside.isdisjoint(beside)
        part[p] = p
        if reaches:  # its parts are joined when it is settled
            beyond.update(parts, (p,))
            left.append(p)
            continue
        joined.update(dict.fromkeys(parts, p))
        clusters = [root(parent, label[q]) for q in near]
        best = max(clusters, key=lambda k: sizes[k]) if clusters else p
        label[p] = best
        sizes[best] = sizes.get(best, 0) + 1
        for k in dict.fromkeys(clusters):
            if k != best and sizes[k] < min_size:
                parent[k] = best
                sizes[best] += sizes[k]
    return {p: root(parent, k) for p, k in label.items()}, {p: root(joined, part[p]) for p in label}, left, sizes, {k: root(parent, k) for k in size}


def log_chi2_tail(x: float, n: float) -> float:
    """log P(chi-square with n degrees of freedom > x)."""
    a, z = n / 2, x / 2
    if z <= 0:
        return 0.0
    front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:  # series of the lower part
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        lower = math.exp(front + math.log(total))
        return math.log1p(-lower) if lower < 1 else -math.inf
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10000):  # continued fraction of the upper part
        m = -k * (k - a)
        b += 2
        d = 1 / (m * d + b or tiny)
        c = b + m / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front + math.log(h)


def unionfind_regions(image: np.ndarray, height: int, width: int, min_size: int = 20, sens: float = 50.0, min_n: int = 1000, nan_first: bool = False) -> list[dict[int, float]]:
    """Footprints of the clusters that stand out of the pooled noise of those below them.

    With ``nan_first`` pixels without a value begin clusters of their own, which
    come last and never stand out.
    """
    label = flood_labels(image, height, width, min_size, nan_first)
    at = np.arange(len(image)) if nan_first else np.flatnonzero(~np.isnan(image))
    at = at[np.argsort(label[at], kind="stable")]
    names, first, sizes = np.unique(label[at], return_index=True, return_counts=True)
    energy = np.add.reduceat(image[at] ** 2, first) / sizes if len(at) else np.zeros(0)
    s = ss = n = 0.0
    out = []
    for k in np.lexsort((names, energy)):
        own = at[first[k] : first[k] + sizes[k]]
        v = image[own]
        if n > min_n and not np.isnan(v).any():
            mean = s / n
            var = ss / n - mean * mean
            if var > 0 and log_chi2_tail(float(((v - mean) ** 2).sum() / var), len(v)) < -sens:
                out.append(unit({int(p): float(max(0.0, w)) for p, w in zip(own, v, strict=True)}))
                continue
        s, ss, n = s + v.sum(), ss + (v * v).sum(), n + len(v)
    return out


def standing_out(groups: list[tuple[float, float, float]], sens: float, min_n: int) -> list[int]:
    """Of groups (pixels, sum, sum of squares) by rising energy, those that stand out of the pool of the others below them."""
    s = ss = n = 0.0
    out = []
    for k, (size, total, squares) in enumerate(groups):
        if n > min_n:
            mean = s / n
            var = ss / n - mean * mean
            if var > 0 and log_chi2_tail((squares - 2 * mean * total + size * mean * mean) / var, size) < -sens:
                out.append(k)
                continue
        s, ss, n = s + total, ss + squares, n + size
    return out


def peak_regions(image: np.ndarray, height: int, width: int, threshold: float) -> list[dict[int, float]]:
    """From each free pixel over the threshold, in falling order, downhill over free positive pixels."""
    taken, out = np.zeros(len(image), bool), []
    for seed in falling(image):
        if taken[seed] or not image[seed] > threshold:
            continue
        region, todo = [seed], deque([seed])
        taken[seed] = True
        while todo:
            p = todo.popleft()
            for q in neighbours(p, height, width):
                if not taken[q] and image[p] > image[q] > 0:
                    taken[q] = True
                    region.append(q)
                    todo.append(q)
        out.append(unit({p: float(image[p]) for p in region}))
    return [r for r in out if r]


def tolerance_regions(image: np.ndarray, height: int, width: int, tol: float) -> list[dict[int, float]]:
    """From each free pixel, in falling order; goes on from a pixel while it is above ``tol`` times the seed."""
    taken, out = np.zeros(len(image), bool), []
    for seed in falling(image):
        if taken[seed]:
            continue
        region, todo = [seed], deque([seed])
        taken[seed] = True
        while todo:
            p = todo.popleft()
            if not image[p] > tol * image[seed]:
                continue
            for q in neighbours(p, height, width):
                if not taken[q] and not np.isnan(image[q]):
                    taken[q] = True
                    region.append(q)
                    todo.append(q)
        out.append(unit({p: float(max(0.0, image[p])) for p in region}))
    return [r for r in out if r]


def connected_parts(pixels: list[int], height: int, width: int) -> dict[int, int]:
    """The least pixel that each of the given pixels is connected to through them."""
    part: dict[int, int] = {}
    there = set(pixels)
    for start in sorted(there):
        if start in part:
            continue
        part[start], todo = start, [start]
        while todo:
            for q in neighbours(todo.pop(), height, width):
                if q in there and q not in part:
                    part[q] = start
                    todo.append(q)
    return part


def grown_in_order(pixels: list[int], z: list[float], hot: list[bool], ratio: list[float], bar: tuple[float, float] | None, height: int, width: int) -> list[tuple[int, float, int, float]]:
    """(seed, ratio, pixel, z): regions of the seeds (those with a ratio) over hot pixels, by falling ratio, up to the seed ``bar`` (-ratio, pixel)."""
    of = {p: k for k, p in enumerate(pixels)}
    out, taken = [], set()
    for order, seed in sorted((-r, p) for p, r in zip(pixels, ratio, strict=True) if r is not None and not math.isnan(r)):
        if bar is not None and (order, seed) >= bar:
            break
        if seed in taken:
            continue
        taken.add(seed)
        region, todo = [seed], [seed]
        while todo:
            for q in neighbours(todo.pop(), height, width):
                if q in of and hot[of[q]] and q not in taken:
                    taken.add(q)
                    region.append(q)
                    todo.append(q)
        out += [(seed, -order, p, z[of[p]]) for p in region]
    return out
