"""Minimising a smooth function of few weights with L-BFGS, each value and gradient a Spark job over the rows.

The steps are those of the optimiser that Spark ML's logistic regression uses (memory of 10, strong Wolfe search with cubic
interpolation, first step of length 1), so that a fit that stops early stops at the same weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

MEMORY, TRIES, TOLERANCE = 10, 10, 1e-6
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class SearchFailed(Exception):
    pass


def direction(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the inverse Hessian's estimate times the gradient; ``steps`` has moves and their changes of gradient, latest first."""
    out, kept = gradient.copy(), []
    for s, y in steps:
        a = (s @ out) / (s @ y)
        out -= a * y
        kept.append(a)
    if steps:
        s, y = steps[0]
        if not s @ y >= 0:
            raise SearchFailed("the changes of gradient are no use")
        out *= (s @ y) / (y @ y)
    for (s, y), a in zip(reversed(steps), reversed(kept), strict=True):
        out += (a - (y @ out) / (s @ y)) * s
    if not np.isfinite(out).all():
        raise SearchFailed("the direction is not finite")
    return -out


def _between(a: tuple, b: tuple) -> float:
    """The cubic's minimum between two (length, value, slope), off the ends."""
    (lt, lf, ld), (rt, rf, rd) = (a, b) if a[0] <= b[0] else (b, a)
    d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
    d2 = math.sqrt(x) if (x := d1 * d1 - ld * rd) >= 0 else math.nan
    down = rd - ld + 2 * d2
    t = rt - (rt - lt) * (rd + d2 - d1) / down if down else math.nan
    return min(max(t, lt + 0.1 * (rt - lt)), lt + 0.9 * (rt - lt)) if t == t else t


def length(along: Callable[[float], tuple[float, float, float]], first: float) -> float:
    """A step that meets the strong Wolfe conditions; ``along`` gives (length, value, slope)."""
    start = low = along(0.0)
    value, slope = start[1:]
    if slope > 0:
        raise SearchFailed("the direction goes up")

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(TRIES):
            c = along(_between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed("no step found between two")

    t = first
    for i in range(TRIES):
        c = along(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed("no step found")


def minimised(f: Objective, start: np.ndarray) -> Iterator[np.ndarray]:
    """The weights after each iteration, until the gradient vanishes, the value stands still for 20 or the search fails twice."""
    x, (value, gradient) = start, f(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    values, n, failed = [math.inf], 0, False
    first_value = value
    while np.linalg.norm(gradient) > max(TOLERANCE * value, 1e-8):
        try:
            way = direction(gradient, steps)
            seen: dict[float, tuple[float, np.ndarray]] = {0.0: (value, gradient)}

            def along(t: float) -> tuple[float, float, float]:
                if t not in seen:
                    seen[t] = f(x + way * t)  # noqa: B023
                return t, seen[t][0], float(seen[t][1] @ way)  # noqa: B023

            t = length(along, 1.0 if n else 1 / float(np.linalg.norm(way)))
            if t * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed("the step vanishes")
        except SearchFailed:
            if failed:
                return
            failed, steps = True, []
            continue
        failed = False
        value, other = seen[t]
        steps = [(way * t, other - gradient), *steps][:MEMORY]
        x, gradient, n = x + way * t, other, n + 1
        values = [*values, value][-20:]
        yield x
        if abs(value - max(values)) <= TOLERANCE * first_value:
            return
