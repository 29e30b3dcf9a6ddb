"""Simplified outlines that stay valid.

Points are left out by distance first (Douglas-Peucker, ring by ring). What this broke is then found
with a segment index over all rings of a zone, and points are put back until nothing is broken:

* two of the new segments meet elsewhere than in an end they share,
* a point of the outline lies between a new segment and the points left out beneath it, so that a
  hole, a part or another stretch of the ring would change sides,
* a ring turns over or loses its area.

The points put back are those farthest from the segments at fault, so the outline stays within the
tolerance, and outlines that simplify without harm come out as by distance alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Pairs of segments that are compared at a time.
PAIRS = 1 << 20


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `counts` rows: its number repeated, and 0, 1, ... within it."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


class Segments:
    """Segments in the cells of a grid about their own size."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        self.start, self.end = start, end
        low, high = np.minimum(start, end), np.maximum(start, end)
        origin = low.min(axis=0)
        side = max(2.0 * float((high - low).mean()), float((high.max(axis=0) - origin).max()) / 4096, 1e-12)
        first = ((low - origin) / side).astype(np.int64)
        width = ((high - origin) / side).astype(np.int64) - first + 1
        segment, place = _expanded(width[:, 0] * width[:, 1])
        x = first[segment, 0] + place % width[segment, 0]
        y = first[segment, 1] + place // width[segment, 0]
        cell = x << 32 | y
        order = np.argsort(cell, kind="stable")
        self.segment = segment[order]
        borders = np.flatnonzero(np.diff(cell[order], prepend=-1, append=-1))
        self.borders = borders

    def close_pairs(self):
        """Pairs of different segments that share a cell, in blocks; a pair may come twice."""
        sizes = np.diff(self.borders)
        cells, first = np.flatnonzero(sizes > 1), 0
        upto = np.cumsum(sizes[cells] ** 2)
        while first < len(cells):
            done = upto[first - 1] if first else 0
            last = max(int(np.searchsorted(upto, done + PAIRS)), first + 1)
            own = cells[first:last]
            cell, place = _expanded(sizes[own] ** 2)
            size, at = sizes[own][cell], self.borders[:-1][own][cell]
            a, b = self.segment[at + place // size], self.segment[at + place % size]
            yield a[a < b], b[a < b]
            first = last


def _turn(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sign of the turn from a over b to p."""
    return np.sign((b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0]))


def _within(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether p, on the line of a and b, lies between them or on an end."""
    return ((np.minimum(a, b) <= p) & (p <= np.maximum(a, b))).all(axis=1)


def meetings(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Whether segments meet, otherwise than in one end that both share."""
    t1, t2, t3, t4 = _turn(a1, a2, b1), _turn(a1, a2, b2), _turn(b1, b2, a1), _turn(b1, b2, a2)
    cross = (t1 * t2 < 0) & (t3 * t4 < 0)
    touches = [
        (t1 == 0) & _within(a1, a2, b1), (t2 == 0) & _within(a1, a2, b2),
        (t3 == 0) & _within(b1, b2, a1), (t4 == 0) & _within(b1, b2, a2),
    ]
    same = [(x == y).all(axis=1) for x in (a1, a2) for y in (b1, b2)]
    shared = same[0] | same[1] | same[2] | same[3]
    # sharing an end is two touches; more of them are a stretch in common
    return cross | (np.sum(touches, axis=0) > np.where(shared, 2, 0))


def inside(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even-odd test of points against a closed ring; points on it count as inside."""
    a, b = ring[:-1, None, :], ring[1:, None, :]
    turn = (b[..., 0] - a[..., 0]) * (points[:, 1] - a[..., 1]) - (points[:, 0] - a[..., 0]) * (
        b[..., 1] - a[..., 1])
    spans = (a[..., 1] > points[:, 1]) != (b[..., 1] > points[:, 1])
    odd = (spans & ((turn > 0) == (b[..., 1] > a[..., 1]))).sum(axis=0) % 2 == 1
    on = (turn == 0) & (np.minimum(a, b) <= points).all(axis=2) & (points <= np.maximum(a, b)).all(axis=2)
    return odd | on.any(axis=0)


def _area(ring: np.ndarray) -> float:
    moved = ring - ring[0]
    x, y = moved[:, 0], moved[:, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]))


def _farthest(points: np.ndarray) -> int:
    """The inner point of a stretch farthest from the segment between its ends."""
    line, offset = points[-1] - points[0], points[1:-1] - points[0]
    length2 = float(line @ line)
    if length2 > 0.0:
        offset = offset - np.clip(offset @ line / length2, 0.0, 1.0)[:, None] * line
    return 1 + int(np.argmax(np.einsum("ij,ij->i", offset, offset)))


class Outline:
    """The rings of a zone and which of their points are kept."""

    def __init__(self, rings: list[np.ndarray], kept: list[np.ndarray]):
        self.rings, self.kept = rings, kept

    def stretches(self):
        """Ring, first and last point of every new segment."""
        ring, first, last = [], [], []
        for number, mask in enumerate(self.kept):
            at = np.flatnonzero(mask)
            ring.append(np.full(len(at) - 1, number))
            first.append(at[:-1])
            last.append(at[1:])
        return tuple(map(np.concatenate, (ring, first, last)))

    def broken(self) -> set[int]:
        """Numbers of stretches to cut again."""
        ring, first, last = self.stretches()
        # rings lie behind each other in one list of points
        whole = np.concatenate(self.rings)
        offset = np.cumsum([0, *map(len, self.rings)])[ring]
        start, end = whole[offset + first], whole[offset + last]
        long = last - first > 1
        found: set[int] = set()
        for a, b in Segments(start, end).close_pairs():
            able = long[a] | long[b]
            a, b = a[able], b[able]
            met = meetings(start[a], end[a], start[b], end[b])
            found.update(a[met].tolist(), b[met].tolist())
        # kept points between a segment and the stretch beneath it
        by_x = np.argsort(start[:, 0], kind="stable")
        xs = start[by_x, 0]
        for n in np.flatnonzero(long).tolist():
            own = whole[offset[n] + first[n] : offset[n] + last[n] + 1]
            low, high = own.min(axis=0), own.max(axis=0)
            near = by_x[np.searchsorted(xs, low[0]) : np.searchsorted(xs, high[0], "right")]
            points = start[near]
            near = near[(points[:, 1] >= low[1]) & (points[:, 1] <= high[1])]
            points = start[near]
            ends = (points == own[0]).all(axis=1) | (points == own[-1]).all(axis=1)
            points = points[~ends]
            if len(points) and inside(np.vstack([own, own[:1]]), points).any():
                found.add(n)
        for number, (points, mask) in enumerate(zip(self.rings, self.kept, strict=True)):
            before, after = _area(points), _area(points[mask])
            if not mask.all() and (before > 0) != (after > 0):
                found.update(np.flatnonzero(ring == number).tolist())
        return {n for n in found if long[n]}

    def mend(self) -> None:
        """Put points back until no stretch is at fault; at worst all of them."""
        while True:
            broken = self.broken()
            if not broken:
                return
            ring, first, last = self.stretches()
            for n in broken:
                points = self.rings[ring[n]][first[n] : last[n] + 1]
                self.kept[ring[n]][first[n] + _farthest(points)] = True


def simplifier(choose: Callable[[np.ndarray], np.ndarray]) -> Callable[[list], list]:
    """A function from polygons to simplified ones. `choose` marks the points of a ring to keep."""

    def simplified(polys: list) -> list:
        rings = [np.array([list(p) for p in ring], float).reshape(-1, 2) for poly in polys for ring in poly]
        kept = [choose(ring) for ring in rings]
        able = [n for n, ring in enumerate(rings) if len(ring) > 1]
        if any(not kept[n].all() for n in able):
            outline = Outline([rings[n] for n in able], [kept[n] for n in able])
            outline.mend()
        slim = iter([ring[mask].tolist() for ring, mask in zip(rings, kept, strict=True)])
        return [[next(slim) for _ in poly] for poly in polys]

    return simplified
