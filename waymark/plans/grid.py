"""A map matcher over a road grid, by a hidden Markov model (Newson and Krumm, 2009).

Roads run along every multiple of `degrees` in latitude and longitude. A ping's candidates are the
nearest places on the roads around it; its distance from one is normally distributed, and between
pings the way along roads is about as long as the straight line. The likeliest sequence of places
is found by dynamic programming; where no pair of places can follow each other the trace breaks.
"""

from __future__ import annotations

import math

from waymark.operators.walk import metres
from waymark.plans.matching import Match, Point, without_repeats

#: Ways along a latitude have even numbers, those along a longitude odd ones.
Place = tuple[int, float, float]  # way, lat, lon


class GridRoads:
    """A matcher (see matching.Matcher) whose roads are a grid."""

    def __init__(self, degrees: float = 0.01, sigma_m: float = 20.0, beta_m: float = 100.0, radius_m: float = 200.0):
        self.degrees, self.sigma_m, self.beta_m, self.radius_m = degrees, sigma_m, beta_m, radius_m

    def places(self, lat: float, lon: float) -> list[Place]:
        """The nearest places on the two roads on either side, along and across, within the radius."""
        d = self.degrees
        rows, cols = math.floor(lat / d), math.floor(lon / d)
        found = [(2 * k, k * d, lon) for k in (rows, rows + 1)] + [(2 * k + 1, lat, k * d) for k in (cols, cols + 1)]
        return [p for p in found if metres(lat, lon, p[1], p[2]) <= self.radius_m]

    def between(self, a: Place, b: Place) -> list[Point]:
        """The way along roads: straight on one road, round the corner of two that cross, over a third between parallel ones."""
        start, end = (a[1], a[2]), (b[1], b[2])
        if a[0] == b[0]:
            return [start, end]
        if a[0] % 2 != b[0] % 2:
            corner = (a[1], b[2]) if a[0] % 2 == 0 else (b[1], a[2])
            return [start, corner, end]
        d = self.degrees
        if a[0] % 2 == 0:
            x = round((a[2] + b[2]) / 2 / d) * d
            return [start, (a[1], x), (b[1], x), end]
        y = round((a[1] + b[1]) / 2 / d) * d
        return [start, (y, a[2]), (y, b[2]), end]

    def route(self, start: Point, end: Point) -> list[Point]:
        """Along roads from the place nearest to the start to the one nearest to the end."""
        nearest = lambda p: min(GridRoads(self.degrees, radius_m=math.inf).places(*p), key=lambda q: metres(*p, q[1], q[2]))
        return self.between(nearest(start), nearest(end))

    def match(self, points: list[Point], times: list[float], request: dict) -> Match:
        breakage = float(request.get("breakage_distance", math.inf))
        ways: list[int] = []
        lines: list[list[Point]] = []
        found: list[tuple[float, float, float] | None] = [None] * len(points)
        open_: list[tuple[int, list[Place], list[float], list[int]]] = []  # ping, places, costs, places before

        def close() -> None:
            if not open_:
                return
            k = min(range(len(open_[-1][2])), key=open_[-1][2].__getitem__)
            path = []
            for ping, places, _, before in reversed(open_):
                path.append((ping, places[k]))
                k = before[k]
            path.reverse()
            line = [(path[0][1][1], path[0][1][2])]
            for (_, a), (_, b) in zip(path, path[1:]):
                line += self.between(a, b)[1:]
            lines.append(line)
            for ping, (way, lat, lon) in path:
                found[ping] = (lat, lon, metres(*points[ping], lat, lon))
                ways.append(way)
            open_.clear()

        for i, p in enumerate(points):
            places = self.places(*p)
            if not places:
                continue
            own = [(metres(*p, q[1], q[2]) / self.sigma_m) ** 2 / 2 for q in places]
            if open_:
                last, before, cost, _ = open_[-1]
                straight = metres(*points[last], *p)
                step = [[cost[j] + abs(length(self.between(a, b)) - straight) / self.beta_m for j, a in enumerate(before)] for b in places]
                if straight <= breakage:
                    come = [min(range(len(before)), key=s.__getitem__) for s in step]
                    open_.append((i, places, [o + s[c] for o, s, c in zip(own, step, come)], come))
                    continue
                close()
            open_.append((i, places, own, [0] * len(places)))
        close()
        if not lines:
            raise RuntimeError("no road near the trace")
        return Match(lines, without_repeats(ways), found)


def length(line: list[Point]) -> float:
    return sum(metres(*a, *b) for a, b in zip(line, line[1:]))
