"""Front speed by joins: closed forms, another way round, walls, empty and odd input."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute_front import densify, front_speed as plain  # noqa: E402
from hotspark.operators import frontspeed as FS  # noqa: E402

SIDES = "pair string, layer int, x0 double, y0 double, x1 double, y1 double"


def sides_of(pair, layer, ring):
    ring = np.asarray(ring, float)
    return [(pair, layer, *map(float, a), *map(float, b)) for a, b in zip(ring, np.roll(ring, -1, axis=0))]


def speeds(spark, rows, times, **kw):
    found = FS.front_speed(spark.createDataFrame(rows, SIDES), "pair", spark.createDataFrame(times, "pair string, dt double"), 500.0, **kw)
    return {r["pair"]: r for r in found.collect()}


def square(a, b):
    return [(a, a), (b, a), (b, b), (a, b)]


def star(rng, n, low, high, x=0.0, y=0.0):
    t = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(low, high, n)
    return np.round(np.column_stack([x + r * np.cos(t), y + r * np.sin(t)]), 3)


def test_against_single_links(spark):
    """Ragged rings around ragged rings, rings with bays, a limit that leaves out the far links."""
    rng = np.random.default_rng(3)
    pairs = {}
    for k in range(6):
        pairs[f"star{k}"] = (star(rng, 9, 20, 90, 1e6, -5e5), star(rng, 11, 120, 260, 1e6, -5e5), (100.0, 30.0, 14.0)[k % 3])
    pairs["bay"] = ([(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30)], square(-20, 60), 100.0)
    pairs["far"] = (square(40, 60), square(0, 100), 1.0)
    pairs["out"] = (square(0, 100), square(40, 60), 100.0)
    pairs["shared"] = (square(0, 50), square(0, 100), 100.0)
    rows, times = [], []
    for k, (a, b, dt) in pairs.items():
        rows += sides_of(k, FS.OLDER, a) + sides_of(k, FS.NEWER, b)
        times.append((k, dt))
    got = speeds(spark, rows, times)
    seen = 0
    for k, (a, b, dt) in pairs.items():
        want = plain(np.asarray(a, float), np.asarray(b, float), dt)
        assert (want is None) == (k not in got), k
        if want is not None:
            seen += 1
            r = got[k]
            assert r["speed"] == pytest.approx(want[0], rel=1e-6), k
            assert r["speed_std"] == pytest.approx(want[1], rel=1e-5, abs=1e-9), k
            assert [r["tx"], r["ty"], r["fx"], r["fy"]] == pytest.approx([*want[2], *want[3]], rel=1e-9), k
    assert seen >= 8 and "far" not in got and "out" not in got


def test_nested_squares_in_closed_form(spark):
    """Corners only: each corner of the newer square sees its own corner of the older one and the two beside it."""
    r = speeds(spark, sides_of("p", 0, square(10, 20)) + sides_of("p", 1, square(0, 30)), [("p", 10.0)], parts=1)["p"]
    near, wide = np.hypot(10, 10) / 10, np.hypot(20, 10) / 10
    assert r["links"] == 12 and r["speed"] == pytest.approx((near + 2 * wide) / 3)
    assert [r[c] for c in ("fx", "fy", "tx", "ty")] == pytest.approx([15] * 4)


def test_walls_between_the_contours(spark):
    """A third contour right of the older one hides what lies behind it, wherever the tiles fall."""
    for shift in (0.0, 1234.567):
        def at(ring):
            return [(x + shift, y - shift) for x, y in ring]
        rows = sides_of("p", 0, at(square(40, 60))) + sides_of("p", 1, at(square(0, 100)))
        wall = sides_of("p", FS.OTHER, at([(80, 1), (81, 1), (81, 99), (80, 99)]))
        df = spark.createDataFrame(rows + wall, SIDES)
        links = FS.front_links(df, "pair", spark.createDataFrame([("p", 100.0)], "pair string, dt double"), 500.0).toPandas()
        assert len(links) and not (links.fx == 100 + shift).any()
        free = FS.front_links(spark.createDataFrame(rows, SIDES), "pair", spark.createDataFrame([("p", 100.0)], "pair string, dt double"), 500.0).toPandas()
        assert (free.fx == 100 + shift).any() and set(map(tuple, links.round(3).to_numpy().tolist())) < set(map(tuple, free.round(3).to_numpy().tolist()))


def test_many_corners_within_a_short_reach(spark):
    """Rings of 4,000 corners: only corners within the reach meet, and the speed is the gap's."""
    n, gap = 4000, 30.0
    t = np.arange(n) * 2 * np.pi / n
    ring = np.column_stack([np.cos(t), np.sin(t)])
    rows = sides_of("p", 0, ring * 20_000) + sides_of("p", 1, ring * (20_000 + gap))
    r = speeds(spark, rows, [("p", 10.0)], parts=1, top_speed=3.2)["p"]
    # the nearest corner lies straight across, its neighbours 31.4 m aside are out of reach
    assert r["links"] == n and r["speed"] == pytest.approx(gap / 10, rel=1e-6) and r["speed_std"] == pytest.approx(0, abs=1e-6)


def test_odd_input(spark):
    """Nulls, repeated sides, equal contours, missing times and empty tables."""
    good = sides_of("p", 0, square(40, 60)) + sides_of("p", 1, square(0, 100))
    odd = [(None, 0, 0.0, 0.0, 1.0, 1.0), ("p", 0, None, 0.0, 1.0, 1.0), ("p", 0, 50.0, 40.0, 50.0, 40.0)]
    same = sides_of("same", 0, square(0, 9)) + sides_of("same", 1, square(0, 9))
    times = [("p", 100.0), ("p", 100.0), ("same", 5.0), (None, 1.0), ("none", None), ("zero", 0.0)]
    zero = [("zero", *r[1:]) for r in good] + [("untold", *r[1:]) for r in good]
    got = speeds(spark, good + good + odd + same + zero, times)
    assert set(got) == {"p"} and got["p"]["links"] == speeds(spark, good, [("p", 100.0)])["p"]["links"]
    assert speeds(spark, [], []) == {} and speeds(spark, good, []) == {}
