"""Small numpy kernels that run inside tasks on one shape or one tile."""

from __future__ import annotations

import numpy as np


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return 0.5 * abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners in counter-clockwise order (monotone chain); one or two rows if degenerate."""
    pts = np.unique(points, axis=0)
    if len(pts) <= 2:
        return pts

    def half(seq):
        chain: list = []
        for p in seq:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (
                chain[-1][1] - chain[-2][1]
            ) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain

    rows = pts.tolist()
    lower, upper = half(rows), half(rows[::-1])
    return np.array(lower[:-1] + upper[:-1])


def nearest_other(own: np.ndarray, every: np.ndarray, block: int = 512) -> np.ndarray:
    """Distance from each own point to the nearest different point of `every`."""
    out = np.full(len(own), np.inf)
    for s in range(0, len(own), block):
        a = own[s : s + block]
        d2 = ((a[:, None, :] - every[None, :, :]) ** 2).sum(axis=2)
        d2[d2 == 0] = np.inf
        out[s : s + block] = np.sqrt(d2.min(axis=1))
    return out


def _circle(a, b, c):
    """Circumcentres and squared radii of triangles (row-wise)."""
    bx, by = b[..., 0] - a[..., 0], b[..., 1] - a[..., 1]
    cx, cy = c[..., 0] - a[..., 0], c[..., 1] - a[..., 1]
    det = 2 * (bx * cy - by * cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / det
        uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / det
    return ux + a[..., 0], uy + a[..., 1], ux * ux + uy * uy


def delaunay(points: np.ndarray) -> np.ndarray:
    """Index triples of the Delaunay triangles of one point set."""
    return delaunay_sets(points, np.array([len(points)]))[0]


def delaunay_sets(points: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triples, set): index triples of the Delaunay triangles whose circle is smaller than their point set.

    `points` holds many sets one after the other, of `count` points each; a step adds one
    point to every set. Points are added one by one in x order. The three helper corners lie a few spans
    away: far enough to stay out of such circles, near enough for exact arithmetic.
    Wider triangles at the rim may be missing.
    """
    n, sets = len(points), len(count)
    own, first = np.repeat(np.arange(sets), count), np.cumsum(count) - count
    lo, hi = np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)
    mid, far = (lo + hi) / 2, 8 * np.maximum((hi - lo).max(axis=1), 1.0)[:, None]
    p = np.vstack([points, mid + far * [-1, -1], mid + far * [1, -1], mid + far * [0, 1]])
    order = np.lexsort((points[:, 1], points[:, 0], own))
    at = np.arange(sets)
    open_t = n + np.column_stack([at, at + sets, at + 2 * sets])
    ox, oy, orr = _circle(p[open_t[:, 0]], p[open_t[:, 1]], p[open_t[:, 2]])
    done, done_at = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    for step in range(int(count.max())):
        ended = count[at] == step
        i = order[np.where(ended, 0, first[at] + step)]
        q = p[i]
        dx = q[:, 0] - ox
        d2 = dx * dx + (q[:, 1] - oy) ** 2
        slack = 1e-12 * orr
        past = ended | ((dx > 0) & (dx * dx > orr + slack))  # the sweep has left the circle for good
        if past.any():
            done.append(open_t[past])
            done_at.append(at[past])
        hit = ~past & (d2 < orr - slack)
        bad = open_t[hit]
        keep = ~past & ~hit
        edges = np.concatenate([bad[:, [0, 1]], bad[:, [1, 2]], bad[:, [2, 0]]])
        centre, home = np.tile(i[hit], 3), np.tile(at[hit], 3)
        low, high = edges.min(axis=1), edges.max(axis=1)
        # a side of the hollow belongs to one triangle that goes
        by = np.lexsort((high, low))
        same = (low[by][1:] == low[by][:-1]) & (high[by][1:] == high[by][:-1])
        rim = by[~(np.append(same, False) | np.insert(same, 0, False))[:len(by)]]
        new, home = np.column_stack([edges[rim], centre[rim]]), home[rim]
        nx, ny, nr = _circle(p[new[:, 0]], p[new[:, 1]], p[new[:, 2]])
        flat = ~np.isfinite(nr)
        new, home, nx, ny, nr = new[~flat], home[~flat], nx[~flat], ny[~flat], nr[~flat]
        open_t, at = np.concatenate([open_t[keep], new]), np.concatenate([at[keep], home])
        ox, oy, orr = np.concatenate([ox[keep], nx]), np.concatenate([oy[keep], ny]), np.concatenate([orr[keep], nr])
    tri, at = np.concatenate([*done, open_t]), np.concatenate([*done_at, at])
    real = (tri < n).all(axis=1)
    return tri[real], at[real]


def alpha_triangles(sets: list[np.ndarray], radius: np.ndarray, inflate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners (n, 3, 2), circumcentres and point set of the triangles with circumradius below the set's `radius`."""
    ang = np.arange(8) * (np.pi / 4)
    unit = np.column_stack([np.cos(ang), np.sin(ang)])
    inflated, moved, held = [], [], []
    for k, (points, wide) in enumerate(zip(sets, inflate)):
        every = np.concatenate([points, (points[:, None, :] + (unit * wide)[None, :, :]).reshape(-1, 2)])
        every = np.round(every, 6)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        every = every[np.concatenate([[True], (every[1:] != every[:-1]).any(axis=1)])]
        if len(every) < 3:
            continue
        # a fixed tiny shift of each point settles ties of points on one circle the same way in every tile
        h = np.sin(every[:, 0] * 12.9898 + every[:, 1] * 78.233) * 43758.5453
        jitter = np.column_stack([h - np.floor(h) - 0.5, 7 * h - np.floor(7 * h) - 0.5]) * max(1e-4 * wide, 1e-6)
        inflated.append(every)
        moved.append(every + jitter - every.mean(axis=0))
        held.append(k)
    if not held:
        return np.empty((0, 3, 2)), np.empty((0, 2)), np.zeros(0, np.int64)
    tri, at = delaunay_sets(np.concatenate(moved), np.array([len(m) for m in moved]))
    of = np.array(held)[at]
    c = np.concatenate(inflated)[tri]
    x, y, r2 = _circle(c[:, 0], c[:, 1], c[:, 2])
    ok = np.isfinite(r2) & (r2 < radius[of] * radius[of])
    return c[ok], np.column_stack([x, y])[ok], of[ok]


# --- polygon overlap -------------------------------------------------------


def _segments(rings) -> np.ndarray:
    out = []
    for ring in rings:
        r = np.asarray(ring, dtype=float)
        if len(r) >= 3:
            out.append(np.hstack([r, np.roll(r, -1, axis=0)]))
    return np.concatenate(out) if out else np.empty((0, 4))


def _crossing_heights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y of all proper crossings between two sets of segments."""
    p, r = a[:, None, :2], (a[:, 2:] - a[:, :2])[:, None, :]
    q, s = b[None, :, :2], (b[:, 2:] - b[:, :2])[None, :, :]
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    w = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * s[..., 1] - w[..., 1] * s[..., 0]) / den
        u = (w[..., 0] * r[..., 1] - w[..., 1] * r[..., 0]) / den
    ok = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    return (p[..., 1] + t * r[..., 1])[ok]


def _spans(seg: np.ndarray, y: float) -> np.ndarray:
    """Sorted x where the even-odd boundary meets the line at height y."""
    up = (seg[:, 1] <= y) != (seg[:, 3] <= y)
    s = seg[up]
    return np.sort(s[:, 0] + (y - s[:, 1]) * (s[:, 2] - s[:, 0]) / (s[:, 3] - s[:, 1]))


def overlap_area(rings_a, rings_b) -> float:
    """Area common to two even-odd polygons, exact up to rounding.

    Between two neighbouring heights of corners and crossings no edges cross, so
    the common width is linear there and its middle value gives the strip's area.
    """
    return _overlap(_segments(rings_a), _segments(rings_b))


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    lo, hi = max(a[:, 1].min(), b[:, 1].min()), min(a[:, 1].max(), b[:, 1].max())
    if lo >= hi:
        return 0.0
    ys = np.concatenate([a[:, 1], b[:, 1], _crossing_heights(a, b), [lo, hi]])
    ys = np.unique(ys[(ys >= lo) & (ys <= hi)])
    total = 0.0
    for y0, y1 in zip(ys[:-1], ys[1:]):
        mid = 0.5 * (y0 + y1)
        xa, xb = _spans(a, mid).reshape(-1, 2), _spans(b, mid).reshape(-1, 2)
        left = np.maximum(xa[:, None, 0], xb[None, :, 0])
        right = np.minimum(xa[:, None, 1], xb[None, :, 1])
        total += float(np.clip(right - left, 0, None).sum()) * (y1 - y0)
    return total


def overlap_areas(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, n: int) -> np.ndarray:
    """overlap_area of n pairs at once, from the segments (m, 4) of both sides and the pair that each belongs to, in order.

    Pairs with about as many segments share a call; one that would fill a call
    alone, or has no number for a corner, is worked on by itself.
    """
    out = np.zeros(n)
    count_a, count_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    some = np.flatnonzero((count_a > 0) & (count_b > 0))
    blank = np.zeros(n, bool)
    blank[of_a[~np.isfinite(a).all(axis=1)]] = True
    blank[of_b[~np.isfinite(b).all(axis=1)]] = True
    # to the next power of two, by segments without length
    wide_a, wide_b = (1 << np.ceil(np.log2(c[some])).astype(np.int64) for c in (count_a, count_b))
    for size in np.unique(np.column_stack([wide_a, wide_b]), axis=0):
        pairs = some[(wide_a == size[0]) & (wide_b == size[1])]
        heights = int(size.sum() + size.prod() + 2)
        step = DENSE // (heights * int(max(size.max(), size.prod())))
        odd = pairs if step < 2 else pairs[blank[pairs]]
        for k in odd:
            out[k] = _overlap(a[first_a[k]:first_a[k] + count_a[k]], b[first_b[k]:first_b[k] + count_b[k]])
        if step < 2:
            continue
        pairs = pairs[~blank[pairs]]
        for i in range(0, len(pairs), step):
            k = pairs[i:i + step]
            out[k] = _overlaps(_padded(a, first_a[k], count_a[k], size[0]), _padded(b, first_b[k], count_b[k], size[1]))
    return out


def _padded(seg: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """(pairs, size, 4): the segments of each pair, followed by its first corner as segments without length."""
    k = np.arange(size)
    more = k[None, :] >= count[:, None]
    out = seg[np.where(more, first[:, None], first[:, None] + k)]
    out[more] = np.tile(seg[np.broadcast_to(first[:, None], more.shape)[more], :2], 2)
    return out


def _widths(seg: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right ends (pairs, heights, spans) of the spans of _spans(); there may be spans at infinity."""
    x0, y0, x1, y1 = (seg[:, None, :, c] for c in range(4))
    y = y[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where((y0 <= y) != (y1 <= y), x0 + (y - y0) * (x1 - x0) / (y1 - y0), np.inf)
    if x.shape[2] % 2:
        x = np.concatenate([x, np.full((*x.shape[:2], 1), np.inf)], axis=2)
    x.sort(axis=2)
    return x[:, :, ::2], x[:, :, 1::2]


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """overlap_area of pairs (pairs, segments, 4); heights that one pair does not need make strips without height."""
    lo = np.maximum(a[:, :, 1].min(axis=1), b[:, :, 1].min(axis=1))[:, None]
    hi = np.maximum(np.minimum(a[:, :, 1].max(axis=1), b[:, :, 1].max(axis=1))[:, None], lo)
    p, q, r, s = a[:, :, None, :2], b[:, None, :, :2], (a[:, :, 2:] - a[:, :, :2])[:, :, None, :], (b[:, :, 2:] - b[:, :, :2])[:, None, :, :]
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    w = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * s[..., 1] - w[..., 1] * s[..., 0]) / den
        u = (w[..., 0] * r[..., 1] - w[..., 1] * r[..., 0]) / den
        met = np.where((den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1), p[..., 1] + t * r[..., 1], lo[:, :, None])
    ys = np.sort(np.clip(np.concatenate([a[:, :, 1], b[:, :, 1], met.reshape(len(a), -1), lo, hi], axis=1), lo, hi), axis=1)
    high = np.diff(ys, axis=1)
    mid = 0.5 * (ys[:, :-1] + ys[:, 1:])
    (la, ra), (lb, rb) = _widths(a, mid), _widths(b, mid)
    left, right = np.maximum(la[..., :, None], lb[..., None, :]), np.minimum(ra[..., :, None], rb[..., None, :])
    wide = np.where(left < right, right, 0.0) - np.where(left < right, left, 0.0)
    return (wide.sum(axis=(2, 3)) * high).sum(axis=1)


# --- points and outlines, in blocks ------------------------------------------


#: Numbers that one dense step of points against segments may hold.
DENSE = 1 << 21


def _blocks(n: int, m: int):
    step = max(1, DENSE // max(1, m))
    return [slice(i, i + step) for i in range(0, n, step)]


def inside(points: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Even-odd test of points against boundary segments, in blocks of bounded size."""
    parts = [_inside(points[b], seg) for b in _blocks(len(points), len(seg))]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _inside(points: np.ndarray, seg: np.ndarray) -> np.ndarray:
    x, y = points[:, 0, None], points[:, 1, None]
    cross = (seg[None, :, 1] <= y) != (seg[None, :, 3] <= y)
    with np.errstate(divide="ignore", invalid="ignore"):
        xi = seg[None, :, 0] + (y - seg[None, :, 1]) * (seg[None, :, 2] - seg[None, :, 0]) / (seg[None, :, 3] - seg[None, :, 1])
    return ((cross & (x < xi)).sum(axis=1) % 2).astype(bool)


def boundary_distance(points: np.ndarray, seg: np.ndarray) -> np.ndarray:
    parts = [_boundary_distance(points[b], seg) for b in _blocks(len(points), len(seg))]
    return np.concatenate(parts) if parts else np.zeros(0)


def _boundary_distance(points: np.ndarray, seg: np.ndarray) -> np.ndarray:
    d = seg[:, 2:] - seg[:, :2]
    n2 = np.maximum((d * d).sum(axis=1), 1e-30)
    w = points[:, None, :] - seg[None, :, :2]
    t = np.clip((w * d[None]).sum(axis=2) / n2, 0, 1)
    return np.sqrt(((w - t[..., None] * d[None]) ** 2).sum(axis=2)).min(axis=1)


# --- smooth surface --------------------------------------------------------


def multiquadric_fill(xy: np.ndarray, z: np.ndarray, at: np.ndarray, scale: float) -> np.ndarray:
    """Multiquadric surface sqrt((r / scale)^2 + 1) through (xy, z), read at new places.

    The matrix of distinct places has an inverse; only places told twice need the least squares, many times as slow.
    """
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    shape = np.sqrt((d / scale) ** 2 + 1)
    distinct = len(np.unique(xy, axis=0)) == len(xy)
    weights = np.linalg.solve(shape, z) if distinct else np.linalg.lstsq(shape, z, rcond=None)[0]
    e = np.sqrt(((at[:, None] - xy[None]) ** 2).sum(axis=2))
    return np.sqrt((e / scale) ** 2 + 1) @ weights
