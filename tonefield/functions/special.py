"""Driver scalars: the inverse incomplete gamma function and threshold factors."""

from __future__ import annotations

import math

from ..config import Cfar


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while abs(term) > 1e-17 * abs(total) and n < 100_000:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def gamma_p_inverse(a: float, p: float) -> float:
    low, high = 0.0, max(1.0, a)
    while gamma_p(a, high) < p and high < 1e8:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(a, mid) < p else (low, mid)
    return (low + high) / 2


def k_shape(mean: float | None, var: float | None) -> tuple[float, float]:
    """Shape and scale of K clutter from the mean and population variance; (2, 1) where there is no variance."""
    if not mean or not var:
        return 2.0, 1.0
    r = var / mean**2
    shape = 100.0 if 2 * r == 1 else 1 / (2 * r - 1)
    shape = min(100.0, max(0.5, shape))
    return shape, mean / (2 * shape)


def k_multiplier(pfa: float, shape: float) -> float:
    """Threshold over noise for K clutter; the scale cancels."""
    return max(gamma_p_inverse(shape, 1 - pfa) / shape, 0.01) if 0 < pfa < 1 else 1.0


def rayleigh_factor(pfa: float, n: int) -> float:
    return n * (pfa ** (-1 / n) - 1) if n else 1.0


def ring_cells(c: Cfar) -> int:
    return (2 * c.reach + 1) ** 2 - (2 * c.guard + 1) ** 2


def factor(c: Cfar) -> float:
    """The Rayleigh factor of a window, over its corner or ring cells; the order-statistic one for `os`."""
    n = 4 * c.train**2 if c.count == "corners" else ring_cells(c)
    if c.method == "os":
        n = ring_cells(c)
        share = order_rank(n) / n
        base = 1.5 if share < 0.6 else 2.0 if share < 0.8 else 2.5
        return base * (c.pfa ** (-1 / n) - 1)
    return rayleigh_factor(c.pfa, n) * (1.2 if c.method == "soca_bands" and c.value == "magnitude" else 1.0)


def order_rank(n: int) -> int:
    return max(1, int(0.75 * n))
