"""Planar arrangement of the edges in one tile, in whole numbers.

Corners lie on odd places, the tile's borders on 0 and `size` (even), so no corner lies
on a border and every edge crosses a border squarely. An edge has one weight for each of
two layers: how often the layers' outlines run along it, less how often they run against
it; the layers lie on the left of their outlines. Crossings are rounded to odd places.

Many tiles can be arranged in one call: tile k stands at (k, k) * stride(size), so that
no two of them meet in x or in y, and nothing is ever compared between two tiles.
"""

from __future__ import annotations

import numpy as np

#: Pairs or tests that one dense step holds.
DENSE = 1 << 20


def stride(size: int) -> int:
    """From one tile of a call to the next; even, so that corners stay odd."""
    return size + 2


def tile_of(p: np.ndarray, size: int) -> np.ndarray:
    """Number of the tile that holds each point."""
    return p[:, 0] // stride(size)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every j in first[i]..last[i]-1."""
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]


def _steps(n: np.ndarray) -> list[slice]:
    """Slices of about DENSE items each, of rows with n items."""
    ends = np.cumsum(n)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + DENSE, DENSE)).clip(0, len(n)))
    return [slice(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(n))) if b > a]


def merged(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each edge once, from its smaller end, with summed weights; edges without weight or length go."""
    swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    lo, hi = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
    w = np.where(swap[:, None], -w, w)
    order = np.lexsort((hi[:, 1], hi[:, 0], lo[:, 1], lo[:, 0]))
    lo, hi, w = lo[order], hi[order], w[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(lo), 1), bool), (lo[1:] != lo[:-1]).any(axis=1) | (hi[1:] != hi[:-1]).any(axis=1)]))
    total = np.add.reduceat(w, first, axis=0) if len(first) else w
    lo, hi = lo[first], hi[first]
    keep = total.any(axis=1) & (lo != hi).any(axis=1)
    return lo[keep], hi[keep], total[keep]


def _side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])


def _cuts(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(edge, place) wherever an edge must be cut: crossings, rounded, and ends that lie on other edges."""
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    # edges stand in order of their smaller x, which is a's
    last = np.searchsorted(a[:, 0], b[:, 0], side="right")
    edges, places = [], []
    for rows in _steps(last - np.arange(len(a))):
        k, j = _ranges(np.arange(rows.start, rows.stop) + 1, last[rows])
        i = k + rows.start
        near = (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[near], j[near]
        d1, d2 = _side(a[i], b[i], a[j]), _side(a[i], b[i], b[j])
        d3, d4 = _side(a[j], b[j], a[i]), _side(a[j], b[j], b[i])
        for e, f, d, end in ((i, j, d1, a), (i, j, d2, b), (j, i, d3, a), (j, i, d4, b)):
            p = end[f]
            within = (np.minimum(a[e], b[e]) <= p).all(axis=1) & (p <= np.maximum(a[e], b[e])).all(axis=1)
            on = (d == 0) & within & (p != a[e]).any(axis=1) & (p != b[e]).any(axis=1)
            edges.append(e[on])
            places.append(p[on])
        cross = (np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0)
        i, j, d3, d4 = i[cross], j[cross], d3[cross], d4[cross]
        t = (d3 / (d3 - d4))[:, None]
        corner = tile_of(a[i], size)[:, None] * stride(size)
        p = (a[i] - corner) + t * (b[i] - a[i])
        p = (2 * np.rint((p - 1) / 2) + 1).astype(np.int64).clip(1, size - 1) + corner
        for e in (i, j):
            new = (p != a[e]).any(axis=1) & (p != b[e]).any(axis=1)
            edges.append(e[new])
            places.append(p[new])
    return np.concatenate([np.zeros(0, np.int64), *edges]), np.concatenate([np.zeros((0, 2), np.int64), *places])


def split(a: np.ndarray, b: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges that meet in their ends only. Rounding a crossing bends its edges, so it is looked again until none is left."""
    a, b, w = merged(a, b, w)
    while True:
        edge, place = _cuts(a, b, size)
        if not len(edge):
            return a, b, w
        d = b - a
        along = ((place - a[edge]) * d[edge]).sum(axis=1)
        order = np.lexsort((place[:, 1], place[:, 0], along, edge))
        edge, place = edge[order], place[order]
        all_e = np.concatenate([np.arange(len(a)), edge, np.arange(len(a))])
        rank = np.concatenate([np.zeros(len(a), np.int64), 1 + np.arange(len(edge)), np.full(len(a), len(edge) + 2)])
        points = np.concatenate([a, place, b])
        order = np.lexsort((rank, all_e))
        all_e, points = all_e[order], points[order]
        same = all_e[1:] == all_e[:-1]
        a, b, w = merged(points[:-1][same], points[1:][same], w[all_e[:-1][same]])


def windings(a: np.ndarray, b: np.ndarray, w: np.ndarray, corner: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers of the layers on the left and right of every edge (from a to b, a the smaller end).

    `corner` holds those at the tile's lower left corner, a row for each tile if there are many
    (then `size` must be given). A path goes up the left border
    and then east to the edge's middle, just above it (just below it for level edges).
    """
    n = len(a)
    level = a[:, 1] == b[:, 1]
    y2 = a[:, 1] + b[:, 1]  # twice the height of the middle
    corner = np.reshape(corner, (-1, 2))
    tile = np.zeros(n, np.int64) if size is None else tile_of(a, size)
    origin = tile * (0 if size is None else stride(size))
    start = a[:, 0] == origin
    height, gain = a[start, 1], w[start]
    order = np.argsort(height, kind="stable")
    height, gain = height[order], np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(gain[order], axis=0)])
    count = np.where(level, np.searchsorted(2 * height, y2, side="left"), np.searchsorted(2 * height, y2, side="right"))
    # less what the tiles before have gained
    base = corner[tile] + gain[count] - gain[np.searchsorted(height, origin, side="left")]
    up = b[:, 1] > a[:, 1]
    rises = np.flatnonzero(~level)
    lo, hi = np.where(up[:, None], a, b)[rises], np.where(up[:, None], b, a)[rises]
    n_up = np.where(up[:, None], w, -w)[rises]
    by_low = np.argsort(lo[:, 1], kind="stable")
    lo, hi, n_up, own = lo[by_low], hi[by_low], n_up[by_low], rises[by_low]
    top = np.maximum.accumulate(hi[:, 1]) if len(hi) else hi[:, 1]
    todo = np.argsort(y2, kind="stable")
    # edges that may hold a height: from the first whose running top reaches it to the last that starts by then
    first, last = np.searchsorted(2 * top, y2[todo], side="left"), np.searchsorted(2 * lo[:, 1], y2[todo], side="right")
    west = np.zeros((n, 2), np.int64)
    for rows in _steps(np.maximum(last - first, 0) + 1):
        k, j = _ranges(first[rows], last[rows])
        i = todo[rows][k]
        at = np.where(level[i], (2 * lo[j, 1] < y2[i]) & (y2[i] <= 2 * hi[j, 1]), (2 * lo[j, 1] <= y2[i]) & (y2[i] < 2 * hi[j, 1]))
        at &= own[j] != i
        i, j = i[at], j[at]
        # twice the middle, seen from an edge that rises: on its right is east of it
        side = (hi[j, 0] - lo[j, 0]) * (y2[i] - 2 * lo[j, 1]) - (hi[j, 1] - lo[j, 1]) * (a[i, 0] + b[i, 0] - 2 * lo[j, 0])
        east = side < 0
        np.add.at(west, i[east], -n_up[j[east]])
    west += base
    left, right = np.empty((n, 2), np.int64), np.empty((n, 2), np.int64)
    left[level], right[level] = west[level] + w[level], west[level]
    rise, fall = up & ~level, ~up & ~level
    left[rise], right[rise] = west[rise], west[rise] - w[rise]
    # an edge that falls has the west on its right
    right[fall], left[fall] = west[fall], west[fall] + w[fall]
    return left, right


#: Which points belong to the result, by whether they lie in the first and the second layer.
OPERATIONS = {
    "both": lambda p, q: p & q, "only_a": lambda p, q: p & ~q, "only_b": lambda p, q: q & ~p, "any": lambda p, q: p | q, "one": lambda p, q: p ^ q,
}


def outline(a, b, left, right, operation: str) -> tuple[np.ndarray, np.ndarray]:
    """The edges that bound a result, which lies on their left."""
    f = OPERATIONS[operation]
    on_left, on_right = f(left[:, 0] != 0, left[:, 1] != 0), f(right[:, 0] != 0, right[:, 1] != 0)
    forth, back = on_left & ~on_right, on_right & ~on_left
    return np.concatenate([a[forth], b[back]]), np.concatenate([b[forth], a[back]])


def border_lengths(a: np.ndarray, w: np.ndarray, corner: np.ndarray, size: int, operation: str) -> np.ndarray:
    """Length of each tile's left border that lies in a result; `corner` has a row for each tile."""
    n = len(corner)
    start = a[:, 0] == tile_of(a, size) * stride(size)
    tile = np.concatenate([np.arange(n), tile_of(a[start], size)])
    height = np.concatenate([np.arange(n) * stride(size), a[start, 1]])
    gain = np.concatenate([np.zeros((n, 2), np.int64), w[start]])
    order = np.argsort(height, kind="stable")
    tile, height, gain = tile[order], height[order], np.cumsum(gain[order], axis=0)
    wind = corner[tile] + gain - gain[np.searchsorted(tile, tile)]
    end = np.where(np.append(tile[1:] == tile[:-1], False), np.append(height[1:], 0), tile * stride(size) + size)
    inside = OPERATIONS[operation](wind[:, 0] != 0, wind[:, 1] != 0)
    out = np.zeros(n, np.int64)
    np.add.at(out, tile, (end - height) * inside)
    return out


def _followers(p: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """The edge that goes on from each edge's end, -1 at a border.

    Where outlines touch in a corner each goes on along its own inside, so rings do not
    cross and do not run through a corner twice.
    """
    n = len(p)
    local = q - tile_of(q, size)[:, None] * stride(size)
    inner = np.flatnonzero(((local != 0) & (local != size)).all(axis=1))
    every = np.concatenate([p, q[inner]])
    order = np.lexsort((every[:, 1], every[:, 0]))
    new = np.concatenate([np.ones(min(len(every), 1), bool), (every[order][1:] != every[order][:-1]).any(axis=1)])
    name = np.empty(len(every), np.int64)
    name[order] = np.cumsum(new)
    starts = np.argsort(name[:n], kind="stable")
    known = name[starts]
    first, last = np.searchsorted(known, name[n:], side="left"), np.searchsorted(known, name[n:], side="right")
    follow = np.full(n, -1, np.int64)
    one = last - first == 1
    follow[inner[one]] = starts[first[one]]
    many = np.flatnonzero(~one)
    i, at = _ranges(first[many], last[many])
    k, out = inner[many[i]], starts[at]
    d, o = q[k] - p[k], q[out] - p[out]
    turn = np.arctan2((d[:, 0] * o[:, 1] - d[:, 1] * o[:, 0]).astype(float), (d[:, 0] * o[:, 0] + d[:, 1] * o[:, 1]).astype(float))
    best = np.lexsort((out, -turn, k))
    k, out = k[best], out[best]
    lead = np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]])
    follow[k[lead]] = out[lead]
    return follow


def walks(p: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, count, closed): the edges of all paths one after the other, how many each path has, whether it is a ring."""
    n = len(p)
    follow = _followers(p, q, size)
    led = np.zeros(n, bool)
    led[follow[follow >= 0]] = True
    follow = follow.tolist()
    seen, walk, count, closed = [False] * n, [], [], []
    for k in [*np.flatnonzero(~led).tolist(), *range(n)]:
        if seen[k]:
            continue
        begun, e = len(walk), k
        while e >= 0 and not seen[e]:
            seen[e] = True
            walk.append(e)
            e = follow[e]
        count.append(len(walk) - begun)
        closed.append(e == k)
    return np.array(walk, np.int64), np.array(count, np.int64), np.array(closed, bool)


def chains(p: np.ndarray, q: np.ndarray, size: int) -> list[tuple[bool, np.ndarray]]:
    """(closed, corners) of the paths that edges p -> q make; open paths run from border to border."""
    walk, count, closed = walks(p, q, size)
    parts = np.split(walk, np.cumsum(count)[:-1]) if len(count) else []
    return [(bool(c), p[w] if c else np.vstack([p[w], q[w[-1:]]])) for c, w in zip(closed, parts)]


def straightened(points: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings one after the other, of `count` corners each, without repeated corners and corners on a straight line."""
    while True:
        count = np.where(count < 3, 0, count) if (gone := np.repeat(count < 3, count)).any() else count
        points = points[~gone]
        first = np.cumsum(count) - count
        at = np.arange(len(points)) - np.repeat(first, count)
        end = np.repeat(count, count) - 1
        k = np.arange(len(points))
        before, after = points - points[np.where(at == 0, k + end, k - 1)], points[np.where(at == end, k - end, k + 1)] - points
        cross = before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]
        far = np.flatnonzero((np.maximum(np.abs(before), np.abs(after)) >= 1 << 30).any(axis=1))
        if len(far):
            u, v = before[far].astype(object), after[far].astype(object)
            cross[far] = ((u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) != 0).astype(np.int64)
        flat = cross == 0
        if not flat.any():
            return points, count
        # neighbours are judged one after the other, so that a corner goes only with its neighbours in place
        drop = flat.copy()
        drop[1:] &= ~flat[:-1] | (at[1:] % 2 == 0) | (at[1:] == 0)
        live = count > 0
        last = (first + count - 1)[live]
        drop[last] &= ~drop[first[live]]
        ring = np.repeat(np.arange(len(count)), count)
        points, count = points[~drop], count - np.bincount(ring[drop], minlength=len(count))


def region_areas(a: np.ndarray, b: np.ndarray, w: np.ndarray, corner: np.ndarray, size: int, operation: str) -> np.ndarray:
    """Twice the area of a result within each tile; `corner` has a row for each tile.

    The boundary integral of x - size: level borders and the right border add nothing,
    the left border counts with its length inside the result.
    """
    a, b, w = split(a, b, w, size)
    left, right = windings(a, b, w, corner, size)
    p, q = outline(a, b, left, right, operation)
    tile = tile_of(p, size)
    around = np.zeros(len(corner), np.int64)
    np.add.at(around, tile, (p[:, 0] + q[:, 0] - 2 * (tile * stride(size) + size)) * (q[:, 1] - p[:, 1]))
    return around + 2 * size * border_lengths(a, w, corner, size, operation)
