"""Logistic losses of groups of rows as polynomials about a pilot, from one pass over the rows.

Models on folds, inner folds and resamples of a large table lie close to each other.  About one set of
coefficients near all of them, the summed loss of a group of rows is a polynomial of the move away from it, whose
terms are sums over the rows: those of a training set are sums of groups.  So one pass gives all
groups, and models of any number of penalties are solved on the driver from small tables.

A move counts as ``near`` if the remainder of the gradient stays below ``REMAINDER`` for every possible row; models that
are not near are the caller's to fit by passes of their own.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from math import comb, factorial

import numpy as np

#: Tables below so many rows are cheaper to pass over again; rows from which lower degrees are enough.
LEAST_ROWS, DEGREES = 20_000, ((2_000_000, 5), (20_000_000, 4), (1 << 62, 3))
#: Largest remainder of the gradient for a row, terms of a polynomial, and bounds of the derivatives of the loss from the fourth on.
REMAINDER, TERMS, STEEPEST = 2e-6, 1024, {4: 0.125, 5: 0.13, 6: 0.25}


def degree_for(rows: int, variables: int) -> int:
    """The degree of the polynomials, 0 where passes are cheaper or the terms too many."""
    if rows < LEAST_ROWS:
        return 0
    degree = next(d for most, d in DEGREES if rows < most)
    return next((d for d in range(degree, 2, -1) if comb(variables + d, d) <= TERMS), 0)


class Polynomial:
    """Terms of up to ``degree`` in the moves of coefficients: those of ``fixed`` features and, last, of one that varies inside a subject if ``varying``."""

    def __init__(self, variables: int, degree: int, varying: bool = False):
        self.degree, self.varying = degree, varying
        fixed = variables - varying
        self.fixed = [list(combinations_with_replacement(range(fixed), d)) for d in range(degree + 1)]
        place = [{c: i for i, c in enumerate(level)} for level in self.fixed]
        self.parents = [(np.array([place[d - 1][c[:-1]] for c in level]), np.array([c[-1] for c in level])) for d, level in enumerate(self.fixed) if d]
        self.blocks = [(d, m) for d in range(degree + 1) for m in range(d + 1 if varying else 1)]
        exponents = []
        for d, m in self.blocks:
            for c in self.fixed[d - m]:
                e = [0] * variables
                for v in c:
                    e[v] += 1
                exponents.append((*e[:fixed], m) if varying else tuple(e))
        self.exponents = np.array(exponents)
        self.scale = np.array([1.0 / np.prod([float(factorial(k)) for k in e]) for e in exponents])
        at = {e: i for i, e in enumerate(exponents)}
        lower = lambda t, *down: at.get(tuple(k - down.count(v) for v, k in enumerate(t)), -1)
        self.first = np.array([[lower(e, v) for e in exponents] for v in range(variables)])
        self.pairs = np.triu_indices(variables)
        self.second = np.array([[lower(e, v, w) for e in exponents] for v, w in zip(*self.pairs, strict=True)])

    def columns(self, x: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
        """The terms of each row: ``x`` its fixed features, ``sums[d]`` the derivatives of order d times 1, v, v^2, ... of the varying feature, summed."""
        held = [np.ones((len(x), 1))]
        for parent, variable in self.parents:
            held.append(held[-1][:, parent] * x[:, variable])
        return np.concatenate([held[d - m] * sums[d][:, m, None] for d, m in self.blocks], axis=1)

    def _powers(self, move: np.ndarray) -> np.ndarray:
        powers = move[:, :, None] ** np.arange(self.degree + 1)
        out = np.ones((len(move), len(self.exponents) + 1))
        for v in range(move.shape[1]):
            out[:, :-1] *= powers[:, v][:, self.exponents[:, v]]
        out[:, -1] = 0  # for exponents below zero
        return out

    def value(self, table: np.ndarray, move: np.ndarray) -> np.ndarray:
        """The loss of each model's terms at its move."""
        return (table * self.scale * self._powers(move)[:, :-1]).sum(axis=1)

    def slopes(self, table: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of minus the loss, and the upper triangle of the hessian of the loss."""
        powers, c = self._powers(move), table * self.scale
        gradient = np.stack([(c * self.exponents[:, v] * powers[:, to]).sum(axis=1) for v, to in enumerate(self.first)], axis=1)
        upper = np.stack([(c * (self.exponents[:, v] * (self.exponents[:, w] - (v == w))) * powers[:, to]).sum(axis=1) for v, w, to in zip(*self.pairs, self.second, strict=True)], axis=1)
        return -gradient, upper

    def near(self, move: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the remainder is small for every row inside the box of the features, given in the order of the variables."""
        most = np.maximum(np.maximum(move * low, move * high).sum(axis=1), -np.minimum(move * low, move * high).sum(axis=1))
        return most**self.degree * STEEPEST[self.degree + 1] / factorial(self.degree) <= REMAINDER


def derivatives(eta: np.ndarray, y: np.ndarray, degree: int) -> list[np.ndarray]:
    """Logistic loss and its derivatives by eta."""
    s = 1 / (1 + np.exp(-np.clip(eta, -35, 35)))
    v = s * (1 - s)
    every = [np.logaddexp(0, eta) - y * eta, s - y, v, v * (1 - 2 * s), v * (1 - 6 * v), v * (1 - 2 * s) * (1 - 12 * v)]
    return every[: degree + 1]


def newton_many(step, penalty: np.ndarray, start: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of many logistic models and which of them settled; ``step`` gives gradients and upper Hessians of the models asked for."""
    beta = start.copy()
    m, q = beta.shape
    at = np.triu_indices(q)
    settled = np.zeros(m, bool)
    for _ in range(steps):
        active = np.flatnonzero(~settled)
        if not len(active):
            break
        gradient, upper = step(beta[active], active)
        hessian = np.zeros((len(active), q, q))
        hessian[:, at[0], at[1]] = upper
        hessian[:, at[1], at[0]] = upper
        hessian[:, np.arange(q), np.arange(q)] += penalty[active]
        gradient = gradient - penalty[active] * beta[active]
        change = (np.linalg.pinv(hessian, rcond=1e-12, hermitian=True) @ gradient[:, :, None])[:, :, 0]
        beta[active] += np.clip(change, -5, 5)
        settled[active] = np.abs(change).max(axis=1) < tolerance
    return beta, settled


def solved(polynomial: Polynomial, table: np.ndarray, pilot: np.ndarray, penalty: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of models with these terms, a row each, and which of them settled near the pilot."""
    step = lambda beta, active: polynomial.slopes(table[active], beta - pilot)
    beta, settled = newton_many(step, penalty, np.tile(pilot, (len(table), 1)), steps, tolerance)
    return beta, settled & polynomial.near(beta - pilot, low, high)
