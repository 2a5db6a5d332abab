"""Bidirectional gated recurrent network in numpy: training by backpropagation through time, lock-step inference.

Gates use x / (1 + |x|) in place of tanh and its half-scaled form in place of the logistic function: same shape,
a fraction of the cost. Inputs are ids of a table whose row holds the three gate inputs of that id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

f4 = np.float32


def soft(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + |x|)."""
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=out)


def gate(x: np.ndarray) -> np.ndarray:
    """Half-scaled soft: 0 to 1. Works in place."""
    soft(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def init(rng: np.random.Generator, hidden: int) -> np.ndarray:
    return (rng.standard_normal((3, hidden, hidden)) / np.sqrt(hidden)).astype(f4)


def forward(a: np.ndarray, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """a: gate inputs (T, B, 3, H); mask (T, B, 1). States (T, B, H) and what ``backward`` needs."""
    t_max, b, _, h_dim = a.shape
    h, states, tape = np.zeros((b, h_dim), f4), np.empty((t_max, b, h_dim), f4), []
    for t in range(t_max):
        z, r, q = gate(a[t, :, 0] + h @ u[0]), gate(a[t, :, 1] + h @ u[1]), h @ u[2]
        n = soft(a[t, :, 2] + r * q)
        tape.append((h, z, r, q, n))
        h = h + mask[t] * ((n - h) * (1 - z))
        states[t] = h
    return states, tape


def backward(d_states: np.ndarray, mask: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of u."""
    t_max, b, h_dim = d_states.shape
    da, du, dh = np.zeros((t_max, b, 3, h_dim), f4), np.zeros_like(u), np.zeros((b, h_dim), f4)
    for t in range(t_max - 1, -1, -1):
        h, z, r, q, n = tape[t]
        dh = dh + d_states[t]
        d = dh * mask[t]
        dn = d * (1 - z) * (1 - np.abs(n)) ** 2
        dz = d * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dq = dn * r
        dr = dn * q * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        da[t, :, 0], da[t, :, 1], da[t, :, 2] = dz, dr, dn
        du[0] += h.T @ dz
        du[1] += h.T @ dr
        du[2] += h.T @ dq
        dh = (dh - d) + d * z + dz @ u[0].T + dr @ u[1].T + dq @ u[2].T
    return da, du


class Adam:
    """Adam over a dict of arrays, updated in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= (self.rate * scale * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(f4)


def run(ids: np.ndarray, lengths: np.ndarray, fwd: tuple, bwd: tuple, visit: Callable[[int, int, np.ndarray, np.ndarray], None]) -> None:
    """Both directions over ``ids`` (T, B), rows ordered by falling length; calls visit(t, n, hf, hb) from the last
    position to the first with the states of the n rows that reach position t.

    fwd, bwd: (tables, u); tables are three arrays (ids, H) with the inputs of the update, reset and candidate gate.
    """
    t_max, b = ids.shape
    h_dim = fwd[1].shape[1]
    active = np.searchsorted(-lengths, -np.arange(t_max), side="left")  # rows longer than t

    def prepared(tables: tuple, u: np.ndarray) -> tuple:
        return (*tables, np.ascontiguousarray(u[0]), np.ascontiguousarray(u[1]), u[2] * f4(0.5))

    def step(h: np.ndarray, x: np.ndarray, tz, tr, tn, uz, ur, un) -> np.ndarray:
        """As in ``forward``, with the half-scaling of both gates folded into the products."""
        z = h @ uz
        z += tz.take(x, axis=0)
        soft(z, out=z)
        r = h @ ur
        r += tr.take(x, axis=0)
        soft(r, out=r)
        q = h @ un
        r *= q
        r += q
        r += tn.take(x, axis=0)
        soft(r, out=r)
        d = h - r
        d *= f4(0.5)
        z *= d
        z += d
        z += r
        return z

    ids = ids.astype(np.intp, copy=False)
    fwd, bwd = prepared(*fwd), prepared(*bwd)
    states, h = np.empty((t_max, b, h_dim), f4), np.zeros((b, h_dim), f4)
    for t in range(t_max):
        n = active[t]
        h = step(h[:n], ids[t, :n], *fwd)
        states[t, :n] = h
    h = np.zeros((b, h_dim), f4)
    for t in range(t_max - 1, -1, -1):
        n = active[t]
        if n:
            h[:n] = step(h[:n], ids[t, :n], *bwd)
            visit(t, n, states[t, :n], h[:n])
