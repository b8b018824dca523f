"""Gauss-Lobatto rules on [0, 1], found from the Legendre polynomials."""

from __future__ import annotations

import numpy as np


def gauss_lobatto(n: int) -> tuple[list[float], list[float]]:
    """n nodes and weights, ends included; the rules in use have 2, 3, 5, 7, 9 and 17 nodes."""
    if n < 2:
        raise ValueError("a Lobatto rule has two nodes at least")
    p = np.polynomial.legendre.Legendre.basis(n - 1)
    x = np.concatenate([[-1.0], np.sort(p.deriv().roots().real), [1.0]])
    w = 2 / (n * (n - 1) * p(x) ** 2)
    return ((x + 1) / 2).tolist(), (w / 2).tolist()
