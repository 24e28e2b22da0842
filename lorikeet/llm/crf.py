"""Linear-chain and skip-chain conditional random fields on score matrices."""

from __future__ import annotations

import numpy as np


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(u: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log forward and backward scores and the log partition of one chain."""
    n, k = u.shape
    a, b = np.empty((n, k)), np.zeros((n, k))
    a[0] = u[0] + start
    for t in range(1, n):
        a[t] = u[t] + logsumexp(a[t - 1][:, None] + trans, 0)
    for t in range(n - 2, -1, -1):
        b[t] = logsumexp(trans + (u[t + 1] + b[t + 1])[None, :], 1)
    return a, b, float(logsumexp(a[-1], 0))


def viterbi(u: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    n, k = u.shape
    back = np.zeros((n, k), dtype=np.int64)
    s = u[0] + start
    cols = np.arange(k)
    for t in range(1, n):
        m = s[:, None] + trans
        back[t] = m.argmax(0)
        s = m[back[t], cols] + u[t]
    out = np.empty(n, dtype=np.int64)
    out[-1] = s.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _steps(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines from the longest to the shortest, and how many are longer than each step."""
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(1, size.max() + 1), side="right") if len(size) else np.zeros(0, dtype=np.int64)


def viterbi_lines(u: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best labels of many lines at once; line ``k`` holds the rows ``first[k] .. first[k] + size[k]`` of ``u``."""
    out = np.zeros(len(u), dtype=np.int64)
    if not len(size):
        return out
    order, longer = _steps(size)
    at = first[order]
    s = u[at] + start
    back = np.zeros(u.shape, dtype=np.int8)
    for t, m in enumerate(longer[1:].tolist(), 1):
        both = s[:m, :, None] + trans
        best = both.argmax(axis=1)
        back[at[:m] + t] = best
        s[:m] = np.take_along_axis(both, best[:, None, :], axis=1)[:, 0] + u[at[:m] + t]
    out[at + size[order] - 1] = s.argmax(axis=1)
    for t in range(len(longer) - 1, 0, -1):
        here = at[: longer[t]] + t
        out[here - 1] = back[here, out[here]]
    return out


def marginals(u: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Log marginal of every label at every position of many lines, by scaled sums."""
    order, longer = _steps(size)
    at = first[order]
    e, tr = np.exp(u - u.max(axis=1, keepdims=True)), np.exp(trans)
    a, b = np.zeros(u.shape), np.ones(u.shape)
    a[at] = e[at] * np.exp(start - start.max())
    for t, m in enumerate(longer[1:].tolist(), 1):
        here = at[:m] + t
        before = a[here - 1]
        a[here] = e[here] * ((before / before.sum(axis=1, keepdims=True)) @ tr)
    for t in range(len(longer) - 1, 0, -1):
        here = at[: longer[t]] + t
        behind = (b[here] * e[here]) @ tr.T
        b[here - 1] = behind / behind.sum(axis=1, keepdims=True)
    p = a * b
    return np.log(p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300) + 1e-30)


def skip_messages(u: np.ndarray, first: np.ndarray, size: np.ndarray, edges: np.ndarray, kinds: np.ndarray, agree: np.ndarray, trans: np.ndarray, start: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Loopy message passing: ``u`` with the evidence of the skip edges, and the edges' beliefs.

    Edge ``e`` joins the rows ``edges[e]`` of ``u``; they share the log potential
    ``agree[kinds[e]]``.  Every round runs the exact messages along all lines and
    then one message each way over every edge.
    """
    inbox = np.zeros((2, len(edges), u.shape[1]))
    pull = np.exp(agree)[kinds]
    extra = np.zeros_like(u, dtype=np.float64)
    for _ in range(rounds):
        belief = marginals(u + extra, first, size, trans, start)
        out = [np.exp(belief[edges[:, side]] - inbox[side]) for side in (0, 1)]
        m = [np.einsum("ek,ekl->el", out[0], pull), np.einsum("el,ekl->ek", out[1], pull)]
        inbox = np.stack([np.log(np.maximum(x / x.max(axis=1, keepdims=True), 1e-30)) for x in (m[1], m[0])])
        extra[:] = 0
        for side in (0, 1):
            np.add.at(extra, edges[:, side], inbox[side])
    belief = marginals(u + extra, first, size, trans, start)
    out = [np.exp(belief[edges[:, side]] - inbox[side]) for side in (0, 1)]
    both = out[0][:, :, None] * pull * out[1][:, None, :]
    return u + extra, both / both.sum(axis=(1, 2), keepdims=True)


def train(data: list[tuple[np.ndarray, np.ndarray]], n_features: int, n_labels: int, epochs: int = 8, rate: float = 0.2, decay: float = 1e-6, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum likelihood by AdaGrad: feature weights, transitions, start scores.

    ``data`` holds per chain its feature numbers (positions x features) and labels.
    """
    rnd = np.random.default_rng(seed)
    w, trans, start = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    gw, gt, gs = np.full(n_features, 1e-2), np.full_like(trans, 1e-2), np.full_like(start, 1e-2)
    for epoch in range(epochs):
        loss = 0.0
        for k in rnd.permutation(len(data)):
            f, y = data[k]
            u = w[f].sum(1)
            a, b, z = forward_backward(u, trans, start)
            p = np.exp(a + b - z)
            loss += z - (u[np.arange(len(y)), y].sum() + start[y[0]] + trans[y[:-1], y[1:]].sum())
            g = -p
            g[np.arange(len(y)), y] += 1
            dt = np.zeros_like(trans)
            np.add.at(dt, (y[:-1], y[1:]), 1)
            if len(y) > 1:
                dt -= np.exp(a[:-1, :, None] + trans[None] + (u[1:] + b[1:])[:, None, :] - z).sum(0)
            ds = -p[0].copy()
            ds[y[0]] += 1
            gt += dt**2
            gs += ds**2
            trans += rate * dt / np.sqrt(gt)
            start += rate * ds / np.sqrt(gs)
            flat, grad = f.ravel(), np.repeat(g, f.shape[1], axis=0)
            hot = np.abs(grad).max(1) > 1e-4
            flat, grad = flat[hot], grad[hot]
            np.add.at(gw, flat, (grad**2).sum(1))
            np.add.at(w, flat, rate * grad / np.sqrt(gw[flat])[:, None])
        w *= 1 - decay * len(data)
        print(f"epoch {epoch}: loss per chain {loss / max(1, len(data)):.4f}", flush=True)
    return w, trans, start
