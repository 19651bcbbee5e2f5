"""Front speed of one pair of rings, link by link: what the joins are held against."""

import numpy as np

from hotspark.functions.kernels import _blocks, _segments, boundary_distance, inside


def densify(ring: np.ndarray, parts: int = 5) -> np.ndarray:
    """Each side cut into `parts` equal pieces (open ring in, open ring out)."""
    nxt = np.roll(ring, -1, axis=0)
    f = np.arange(parts)[None, :, None] / parts
    return (ring[:, None, :] + (nxt - ring)[:, None, :] * f).reshape(-1, 2)


def front_speed(older: np.ndarray, newer: np.ndarray, seconds: float, top_speed: float = 10.0):
    """Mean and spread of the speed from the older outline to the newer one around it.

    Links join corners of the newer ring to corners of the older one; a link must
    run inside the newer ring, outside the older one, touch no boundary between its
    ends, and stay at or below `top_speed`. All corners count: those of the older ring
    are sorted, so that each outer corner meets only those within reach. Returns None
    when the older ring is not inside the newer one or no link is left.
    """
    outer, inner = densify(newer), densify(older)
    so, si = _segments([outer]), _segments([inner])
    near = boundary_distance(inner, so) < 1e-6
    if seconds <= 0 or not (near | inside(inner, so)).all():
        return None
    reach = top_speed * seconds
    pi = inner[np.argsort(inner[:, 0], kind="stable")]
    n, total, squares, sums = 0, 0.0, 0.0, np.zeros(4)
    for o in outer:
        lo, hi = np.searchsorted(pi[:, 0], [o[0] - reach, o[0] + reach], side="left")
        near_o = pi[lo:hi + 1]
        d = np.sqrt(((near_o - o) ** 2).sum(axis=1))
        cand = np.flatnonzero((d > 0) & (d / seconds <= top_speed))
        if not len(cand):
            continue
        link = np.hstack([np.repeat(o[None], len(cand), 0), near_o[cand]])
        mid = 0.5 * (link[:, :2] + link[:, 2:])
        ok = inside(mid, so) & ~inside(mid, si)
        ok[ok] = (boundary_distance(mid[ok], so) > 1e-3) & (boundary_distance(mid[ok], si) > 1e-3)
        ok[ok] = ~_touches(link[ok], np.vstack([so, si]))
        speeds = d[cand[ok]] / seconds
        n, total, squares, sums = n + len(speeds), total + speeds.sum(), squares + (speeds ** 2).sum(), sums + link[ok].sum(axis=0)
    if not n:
        return None
    mean = total / n
    return float(mean), float(np.sqrt(max(0.0, squares / n - mean ** 2))), sums[:2] / n, sums[2:] / n


def _touches(link: np.ndarray, seg: np.ndarray, tol: float = 1e-3) -> np.ndarray:
    """Whether each link meets a segment farther than `tol` from its own ends."""
    parts = [_touch(link[b], seg, tol) for b in _blocks(len(link), len(seg))]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def _touch(link: np.ndarray, seg: np.ndarray, tol: float) -> np.ndarray:
    r = (link[:, 2:] - link[:, :2])[:, None, :]
    s = (seg[:, 2:] - seg[:, :2])[None, :, :]
    w = seg[None, :, :2] - link[:, None, :2]
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * s[..., 1] - w[..., 1] * s[..., 0]) / den
        u = (w[..., 0] * r[..., 1] - w[..., 1] * r[..., 0]) / den
    edge = tol / np.maximum(np.sqrt((r * r).sum(axis=2)), tol)
    return ((den != 0) & (t > edge) & (t < 1 - edge) & (u >= 0) & (u <= 1)).any(axis=1)
