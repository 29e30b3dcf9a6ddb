"""Simplified outlines are valid: no crossings, holes and parts keep their sides."""

import math
import random

import numpy as np
import pytest

from bloomgrid.operators import layers, outlines


def simplify(polys, tolerance):
    return outlines.simplifier(layers.by_distance(tolerance))(polys)


def edges(polys):
    return [(tuple(a), tuple(b)) for poly in polys for ring in poly for a, b in zip(ring, ring[1:])]


def cross(p, q):
    (a, b), (c, d) = p, q

    def turn(o, s, t):
        value = (s[0] - o[0]) * (t[1] - o[1]) - (s[1] - o[1]) * (t[0] - o[0])
        return (value > 0) - (value < 0)

    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def crossings(polys):
    own = edges(polys)
    return sum(cross(p, q) for i, p in enumerate(own) for q in own[:i])


def odd(ring, point):
    x, y = point
    hits = [(x2 - x1) * (y - y1) / (y2 - y1) + x1 > x
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]) if (y1 > y) != (y2 > y)]
    return sum(hits) % 2 == 1


def sides(polys):
    """Which ring holds which, and how each turns."""
    rings = [ring for poly in polys for ring in poly]
    held = [[odd(a, b[0]) for b in rings if a is not b] for a in rings]
    turns = [sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:])) > 0 for r in rings]
    return held, turns


def off(polys, slim):
    """Farthest point of the outline from its simplified one."""
    worst = 0.0
    for poly, thin in zip(polys, slim):
        for ring, kept in zip(poly, thin):
            a, b = np.array(kept[:-1]), np.array(kept[1:])
            for p in np.array(ring):
                line = b - a
                t = np.clip(((p - a) * line).sum(1) / np.maximum((line * line).sum(1), 1e-300), 0, 1)
                worst = max(worst, float(np.sqrt((((a + t[:, None] * line) - p) ** 2).sum(1)).min()))
    return worst


def wavy(rng, x, y, radius, noise, points):
    ring = []
    for k in range(points):
        r = radius * (1 + noise * rng.uniform(-1, 1))
        angle = 2 * math.pi * k / points
        ring.append([x + r * math.cos(angle), y + r * math.sin(angle)])
    return [*ring, ring[0]]


@pytest.mark.parametrize("seed", range(12))
def test_outlines_stay_valid(seed):
    rng = random.Random(seed)
    shell = wavy(rng, 0, 0, 1.0, rng.choice([0.02, 0.2, 0.5]), 180)
    holes = [wavy(rng, 0.3 * math.cos(k), 0.3 * math.sin(k), 0.03, 0.3, 25) for k in range(5)]
    # parts in the bays of the shell, nearer than the tolerance
    parts = []
    for k in range(0, 180, 6):
        angle = 2 * math.pi * k / 180
        r = math.hypot(*shell[k]) + 0.02
        parts.append([wavy(rng, r * math.cos(angle), r * math.sin(angle), 0.004, 0.3, 8)])
    polys = [[shell, *holes], *parts]
    if crossings(polys):
        polys = [[shell, *holes]]
    assert crossings(polys) == 0
    for tolerance in (0.01, 0.05, 0.3):
        slim = simplify(polys, tolerance)
        assert crossings(slim) == 0 and sides(slim) == sides(polys)
        assert off(polys, slim) <= tolerance + 1e-9
        assert sum(map(len, sum(slim, []))) < sum(map(len, sum(polys, [])))


def test_thin_outlines_do_not_cross_themselves():
    # a band along a wave, thinner than the tolerance
    xs = [k / 10 for k in range(100)]
    low = [[x, math.sin(x)] for x in xs]
    high = [[x, math.sin(x) + 0.01 + 0.004 * (-1) ** k] for k, x in enumerate(xs)]
    ring = [*low, *reversed(high), low[0]]
    assert crossings([[ring]]) == 0
    plain = layers.ring_simplifier(0.05)(ring)
    slim = simplify([[ring]], 0.05)
    assert crossings(slim) == 0 and sides(slim) == sides([[ring]])
    assert crossings([[plain]]) > 0 or plain == slim[0][0]
    assert off([[ring]], slim) <= 0.05 + 1e-9 and len(slim[0][0]) < len(ring)


def test_a_hole_is_not_cut_off():
    # the hole lies in a bulge that distance alone would cut away
    shell = [[0, 0], [4, 0], [4, 2], [2.4, 2], [2.2, 2.3], [1.8, 2.3], [1.6, 2], [0, 2], [0, 0]]
    hole = [[1.9, 2.1], [2.1, 2.1], [2.1, 2.2], [1.9, 2.2], [1.9, 2.1]]
    polys = [[shell, hole]]
    plain = layers.ring_simplifier(0.5)(shell)
    assert not odd(plain, hole[0])
    slim = simplify(polys, 0.5)
    assert crossings(slim) == 0 and sides(slim) == sides(polys)


def test_harmless_outlines_come_out_as_by_distance():
    rng = random.Random(1)
    ring = wavy(rng, 0, 0, 1.0, 0.02, 300)
    assert simplify([[ring]], 0.01) == [[layers.ring_simplifier(0.01)(ring)]]
    assert simplify([[[]], []], 0.1) == [[[]], []]
    # rings that touch in a point, and an outline that crosses itself already
    touching = [[[0, 0], [2, 0.01], [4, 0], [4, 4], [0, 4], [0, 0]]], [[[4, 4], [6, 4], [6, 5], [4, 5], [4, 4]]]
    assert simplify(list(touching), 0.1)[0][0] == [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    bow = [[[0, 0], [1, 0.001], [2, 2], [2, 0], [0, 2], [0, 0]]]
    assert len(simplify([bow], 0.01)[0][0]) >= 5


def test_a_long_outline_is_done_soon():
    import time

    ring = wavy(random.Random(2), 0, 0, 100.0, 0.01, 60_000)
    begin = time.perf_counter()
    slim = simplify([[ring]], 0.5)
    assert 4 < len(slim[0][0]) < 30_000
    assert time.perf_counter() - begin < 60
