"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters beyond ASCII share one code; the last code pads.
CODES, OTHER, PAD = 130, 128, 129
Params = dict[str, np.ndarray]


def codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), OTHER).astype(np.uint8)


def start_params(hidden: int, labels: int, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
    p = {"out": draw(2 * hidden, labels), "bias": np.zeros(labels, np.float32), "trans": draw(labels, labels, k=0.1)}
    for d in "fb":
        p[f"in_{d}"], p[f"rec_{d}"], p[f"gate_{d}"] = draw(CODES, 4 * hidden), draw(hidden, 4 * hidden), np.zeros(4 * hidden, np.float32)
        p[f"gate_{d}"][hidden : 2 * hidden] = 1
    return p


def _run(p: Params, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, hidden) of one direction; x is (batch, time)."""
    rec, table = p[f"rec_{d}"], p[f"in_{d}"] + p[f"gate_{d}"]
    n, hidden = rec.shape[0], rec.shape[0]
    half = np.full(4 * n, 0.5, np.float32)  # sigmoid(z) = tanh(z / 2) / 2 + 1 / 2; the last block is a plain tanh
    half[3 * n :] = 1
    table, rec = table * half, rec * half
    steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
    h, c = np.zeros((len(x), hidden), np.float32), np.zeros((len(x), hidden), np.float32)
    out, cache = np.empty((x.shape[1], len(x), hidden), np.float32), []
    for t in steps:
        z = table[x[:, t]]
        z += h @ rec
        np.tanh(z, out=z)
        s = z[:, : 3 * n] * 0.5 + 0.5
        i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], z[:, 3 * n :]
        c0, h0 = c, h
        c = f * c0 + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            cache.append((t, i, f, o, g, c0, h0, tc))
    return out, cache


def unary(p: Params, x: np.ndarray) -> np.ndarray:
    """Label scores, (time, batch, labels)."""
    n = p["rec_f"].shape[0]
    return _run(p, x, "f", False)[0] @ p["out"][:n] + _run(p, x, "b", False)[0] @ p["out"][n:] + p["bias"]


def viterbi(scores: np.ndarray, trans: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Best labels (batch, time); scores are (time, batch, labels); valid has each row's length."""
    time, batch, _ = scores.shape
    best, back = scores[0].copy(), np.zeros(scores.shape, np.int8)
    for t in range(1, time):
        step = best[:, :, None] + trans
        back[t] = step.argmax(axis=1)
        live = (t < valid)[:, None]
        best = np.where(live, step.max(axis=1) + scores[t], best)
        back[t] = np.where(live, back[t], np.arange(scores.shape[2]))
    out, label = np.zeros((batch, time), np.int8), best.argmax(axis=1)
    rows = np.arange(batch)
    for t in range(time - 1, -1, -1):
        out[:, t] = label
        label = back[t][rows, label]
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def loss_and_grads(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Negative log likelihood of labels y (batch, time) under the CRF, by character, and its gradients."""
    n, (batch, time) = p["rec_f"].shape[0], x.shape
    hf, cf = _run(p, x, "f", True)
    hb, cb = _run(p, x, "b", True)
    s = hf @ p["out"][:n] + hb @ p["out"][n:] + p["bias"]
    trans = p["trans"]
    a, b = np.empty_like(s), np.zeros_like(s)
    a[0] = s[0]
    for t in range(1, time):
        a[t] = s[t] + _lse(a[t - 1][:, :, None] + trans, 1)
    for t in range(time - 2, -1, -1):
        b[t] = _lse(trans + (s[t + 1] + b[t + 1])[:, None, :], 2)
    logz = _lse(a[-1], 1)
    yt = y.T
    gold = np.take_along_axis(s, yt[:, :, None], 2).sum(axis=(0, 2)) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
    scale = np.float32(1 / (batch * time))
    ds = np.exp(a + b - logz[None, :, None])
    pair = np.exp(a[:-1][:, :, :, None] + trans + (s[1:] + b[1:])[:, :, None, :] - logz[None, :, None, None]).sum(axis=(0, 1))
    np.subtract.at(pair, (y[:, :-1], y[:, 1:]), 1)
    ds[np.arange(time)[:, None], np.arange(batch), yt] -= 1
    ds *= scale
    g: Params = {"trans": pair * scale, "bias": ds.sum(axis=(0, 1)), "out": np.concatenate([np.einsum("tbh,tbk->hk", hf, ds), np.einsum("tbh,tbk->hk", hb, ds)])}
    for d, cache, w in (("f", cf, p["out"][:n]), ("b", cb, p["out"][n:])):
        rec = p[f"rec_{d}"]
        din, drec = np.zeros_like(p[f"in_{d}"]), np.zeros_like(rec)
        dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        dgate = np.zeros(4 * n, np.float32)
        for t, i, f, o, gg, c0, h0, tc in reversed(cache):
            dh = dh + ds[t] @ w.T
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
            np.add.at(din, x[:, t], dz)
            drec += h0.T @ dz
            dgate += dz.sum(axis=0)
            dh, dc = dz @ rec.T, dc * f
        g[f"in_{d}"], g[f"rec_{d}"], g[f"gate_{d}"] = din, drec, dgate
    return float((logz - gold).sum() * scale), g


def train(x: np.ndarray, y: np.ndarray, labels: int, hidden: int = 32, epochs: int = 10, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Params:
    """Adam over shuffled batches; the same rows and seed give the same parameters."""
    p, rng = start_params(hidden, labels, seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, g = loss_and_grads(p, x[rows], y[rows])
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            for k in p:
                d = g[k] * clip
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                p[k] = (p[k] - rate * (0.5 if epoch > epochs // 2 else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p
