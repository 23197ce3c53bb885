"""Minimisers of a function whose value and gradient take a pass over a table, so that each is asked for once.

Both follow the library's optimisers step by step: limited-memory BFGS with ten corrections and a line search for the strong
Wolfe conditions, and plain gradient descent. Points and gradients are small arrays on the driver.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np

#: Value and gradient at a point.
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]

_CORRECTIONS, _MEMORY, _TRIES = 10, 20, 10
_DECREASE, _CURVATURE = 1e-4, 0.9


class _NoStep(Exception):
    """The line search found no step along this direction."""


class _Line:
    """The function along one direction; remembers what it was asked for."""

    def __init__(self, objective: Objective, x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray):
        self.objective, self.x, self.direction = objective, x, direction
        self.seen = {0.0: (value, grad)}

    def at(self, t: float) -> tuple[float, float, float]:
        """``t``, the value and the slope there."""
        if t not in self.seen:
            self.seen[t] = self.objective(self.x + t * self.direction)
        value, grad = self.seen[t]
        return t, value, float(grad @ self.direction)

    def step(self, first: float) -> float:
        """A step that satisfies the strong Wolfe conditions."""
        low = self.at(0.0)
        _, start, slope = low
        if not slope <= 0:
            raise _NoStep
        t = first
        for number in range(_TRIES):
            point = self.at(t)
            if not math.isfinite(point[1]):
                t /= 2.0
                continue
            if point[1] > start + _DECREASE * t * slope or (point[1] >= low[1] and number):
                return self._zoom(low, point, start, slope)
            if abs(point[2]) <= _CURVATURE * abs(slope):
                return t
            if point[2] >= 0:
                return self._zoom(point, low, start, slope)
            low, t = point, t * 1.5
        raise _NoStep

    def _zoom(self, low: tuple, high: tuple, start: float, slope: float) -> float:
        for _ in range(_TRIES):
            point = self.at(_between(*sorted((low, high))))
            if point[1] > start + _DECREASE * point[0] * slope or point[1] >= low[1]:
                high = point
                continue
            if abs(point[2]) <= _CURVATURE * abs(slope):
                return point[0]
            if point[2] * (high[0] - low[0]) >= 0:
                high = low
            low = point
        raise _NoStep


def _between(left: tuple, right: tuple) -> float:
    """The least place of the cubic through two points, not too near to either."""
    (a, fa, da), (b, fb, db) = left, right
    d1 = da + db - 3 * (fa - fb) / (a - b)
    under = d1 * d1 - da * db
    d2 = math.sqrt(under) if under >= 0 else math.nan
    apart = db - da + 2 * d2
    t = b - (b - a) * (db + d2 - d1) / apart if apart else math.nan
    if math.isnan(t):
        return (a + b) / 2
    return min(max(t, a + 0.1 * (b - a)), a + 0.9 * (b - a))


def _downhill(grad: np.ndarray, history: deque) -> np.ndarray:
    """Minus the gradient times the approximate inverse of the curvature."""
    out, charges = grad.copy(), []
    for step, change in reversed(history):
        charge = float(step @ out) / float(step @ change)
        charges.append(charge)
        out -= charge * change
    if history:
        step, change = history[-1]
        out *= float(step @ change) / float(change @ change)
    for (step, change), charge in zip(history, reversed(charges)):
        out += step * (charge - float(change @ out) / float(step @ change))
    return -out


def lbfgs(objective: Objective, x: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """The point after at most ``iterations`` steps, fewer if values or gradient no longer change."""
    value, grad = objective(x)
    first, values, history, done, failed = value, deque([math.inf], _MEMORY), deque(maxlen=_CORRECTIONS), 0, False
    while done < iterations:
        if np.linalg.norm(grad) <= max(tolerance * abs(value), 1e-8):
            break
        if len(values) >= 2 and abs(value - max(values)) <= tolerance * first:
            break
        try:
            direction = _downhill(grad, history)
            line = _Line(objective, x, value, grad, direction)
            t = line.step(1.0 if done else 1.0 / float(np.linalg.norm(direction)))
            if t * np.linalg.norm(grad) < 1e-10:
                raise _NoStep
        except _NoStep:
            if failed:
                break
            failed = True
            history.clear()
            continue
        (new_value, new_grad), step = line.seen[t], t * direction
        history.append((step, new_grad - grad))
        x, value, grad = x + step, new_value, new_grad
        values.append(value)
        done, failed = done + 1, False
    return x


def gradient_descent(objective: Objective, x: np.ndarray, iterations: int, tolerance: float, rate: float) -> np.ndarray:
    """The point after at most ``iterations`` steps down the gradient, fewer if the point no longer moves."""
    for _ in range(iterations):
        before, x = x, x - rate * objective(x)[1]
        if np.linalg.norm(x - before) < tolerance * max(float(np.linalg.norm(x)), 1.0):
            break
    return x
