"""A bidirectional LSTM block labeller in numpy, forwards, backwards and trained."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

from brindle.llm.blocks import DIM, leaves, vectors
from brindle.llm.sample_pages import page

HIDDEN, PAGES, EPOCHS, BATCH, RATE = 20, 1200, 6, 24, 0.01
#: Pages that are labelled side by side, and steps that they fill together.
ROWS, STEPS = 64, 16_384
Model = dict[str, np.ndarray]


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(seed: int = 0, dim: int = DIM, hidden: int = HIDDEN) -> Model:
    rng = np.random.default_rng(seed)
    out: Model = {"v": rng.normal(0, 0.1, 2 * hidden).astype(np.float32), "c": np.zeros(1, np.float32)}
    for d in "fb":
        out[f"w{d}"] = rng.normal(0, 0.08, (dim, 4 * hidden)).astype(np.float32)
        out[f"u{d}"] = rng.normal(0, 0.08, (hidden, 4 * hidden)).astype(np.float32)
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1
        out[f"s{d}"] = bias
    return out


def _run(m: Model, d: str, x: np.ndarray, on: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, rows, hidden) of one direction; steps that are off leave the state as it was."""
    steps, rows, _ = x.shape
    n = m[f"u{d}"].shape[0]
    pre = x @ m[f"w{d}"] + m[f"s{d}"]
    h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    out = np.zeros((steps, rows, n), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = pre[t] + h @ m[f"u{d}"]
        i, f, o, g = _sig(z[:, :n]), _sig(z[:, n : 2 * n]), _sig(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        a = on[t][:, None]
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, a))
        h, c = np.where(a, h2, h), np.where(a, c2, c)
        out[t] = h
    return out


def score(m: Model, x: np.ndarray, on: np.ndarray) -> np.ndarray:
    h = np.concatenate([_run(m, "f", x, on), _run(m, "b", x, on)], axis=2)
    return h @ m["v"] + m["c"]


def gradient(m: Model, x: np.ndarray, on: np.ndarray, y: np.ndarray) -> tuple[float, Model]:
    """Mean logistic loss over the steps that are on, and its gradient by back-propagation through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    h = np.concatenate([_run(m, d, x, on, kept[d]) for d in "fb"], axis=2)
    p = _sig(h @ m["v"] + m["c"])
    total = on.sum()
    loss = -(on * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total
    e = (p - y) * on / total
    grad: Model = {"v": np.einsum("tr,trh->h", e, h), "c": np.array([e.sum()], np.float32)}
    n = m["uf"].shape[0]
    for k, d in enumerate("fb"):
        dh_out = e[:, :, None] * m["v"][k * n : (k + 1) * n]
        dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
        dh, dc = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
        gu = np.zeros_like(m[f"u{d}"])
        for t, h0, c0, i, f, o, g, tc, a in reversed(kept[d]):
            dh = dh + dh_out[t]
            dnew, dcell = dh * a, dc * a
            dcell = dcell + dnew * o * (1 - tc**2)
            dz = np.concatenate([dcell * g * i * (1 - i), dcell * c0 * f * (1 - f), dnew * tc * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
            dz_all[t] = dz
            gu += h0.T @ dz
            dh = dh * ~a + dz @ m[f"u{d}"].T
            dc = dc * ~a + dcell * f
        grad[f"u{d}"] = gu
        grad[f"w{d}"] = np.einsum("trd,trz->dz", x, dz_all, optimize=True)
        grad[f"s{d}"] = dz_all.sum((0, 1))
    return float(loss), grad


def padded(seqs: list[np.ndarray], marks: list[np.ndarray] | None = None):
    steps = max(len(s) for s in seqs)
    x = np.zeros((steps, len(seqs), seqs[0].shape[1]), np.float32)
    on = np.zeros((steps, len(seqs)), bool)
    y = np.zeros((steps, len(seqs)), np.float32)
    for k, s in enumerate(seqs):
        x[: len(s), k], on[: len(s), k] = s, True
        if marks is not None:
            y[: len(s), k] = marks[k]
    return x, on, y


def train(seqs: list[np.ndarray], marks: list[np.ndarray], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Adam over batches of pages of like length; the same input gives the same model."""
    m, rng = start(seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    order = np.argsort([len(s) for s in seqs], kind="stable")
    groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            x, on, y = padded([seqs[j] for j in groups[k]], [marks[j] for j in groups[k]])
            _, grad = gradient(m, x, on, y)
            step += 1
            norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for name, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g**2
                up = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                m[name] = (m[name] - RATE / (1 + epoch / 2) * up).astype(np.float32)
    return m


def examples(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = random.Random(seed)
    seqs, marks = [], []
    while len(seqs) < n:
        html, mark = page(rng)
        found = leaves(html)
        if found and len(found) == len(mark):
            seqs.append(vectors(found))
            marks.append(np.array(mark, np.float32))
    return seqs, marks


@lru_cache(2)
def labeller(pages: int = PAGES, seed: int = 0) -> Model:
    """Trained here on so many invented pages; no web page or label of the tables is used."""
    return train(*examples(pages, seed), seed=seed)


def label(m: Model, seqs: list[np.ndarray]) -> list[np.ndarray]:
    """Whether each block is main text, for each page; pages of like length go together, as many as fill so many steps with the longest; a page beyond that goes alone."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(seqs)
    group: list[int] = []

    def work() -> None:
        x, on, _ = padded([seqs[k] for k in group])
        s = score(m, x, on) > 0
        for c, k in enumerate(group):
            out[k] = s[: len(seqs[k]), c]
        group.clear()

    for k in np.argsort([len(s) for s in seqs], kind="stable"):
        if group and (len(group) == ROWS or (len(group) + 1) * len(seqs[k]) > STEPS):
            work()
        if len(seqs[k]):
            group.append(int(k))
    if group:
        work()
    return out
