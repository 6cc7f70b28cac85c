"""Character tagger in numpy: a bidirectional LSTM whose scores feed a CRF over tag transitions."""

from __future__ import annotations

import numpy as np

SYMBOLS = 99  # printable ASCII, then other letters, other digits, white space, the rest


def symbol_table() -> np.ndarray:
    """Code point to symbol number."""

    def one(c):
        s = chr(c)
        return c - 32 if 32 <= c < 127 else 95 if s.isalpha() else 96 if s.isdigit() else 97 if s.isspace() else 98

    return np.fromiter(map(one, range(0x110000)), np.uint8, 0x110000)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def start(tags: int, embed: int = 12, hidden: int = 20, seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"E": r.normal(0, 0.3, (SYMBOLS, embed)), "O": r.normal(0, 0.2, (2 * hidden, tags)), "ob": np.zeros(tags), "T": np.zeros((tags, tags))}
    for d in "fb":
        p |= {f"X{d}": r.normal(0, 0.3, (embed, 4 * hidden)), f"H{d}": r.normal(0, 0.2, (hidden, 4 * hidden)), f"c{d}": np.zeros(4 * hidden)}
        p[f"c{d}"][hidden : 2 * hidden] = 1  # forget little at first
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(p, d, x, keep):
    """Hidden states (n, T, h) of one direction; ``keep`` also returns what training needs."""
    n, steps, _ = x.shape
    h = p[f"H{d}"].shape[0]
    pre = x @ p[f"X{d}"] + p[f"c{d}"]
    hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    out, held = np.empty((n, steps, h), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g = pre[:, t] + hid @ p[f"H{d}"]
        gates, new = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        before, was = cell, hid
        cell = f * before + i * new
        squashed = np.tanh(cell)
        hid = o * squashed
        out[:, t] = hid
        if keep:
            held.append((t, i, f, o, new, before, was, squashed))
    return out, held


def scores(p, symbols):
    """Tag scores (n, T, tags) of rows of symbols (n, T)."""
    x = p["E"][symbols]
    return np.concatenate([_run(p, "f", x, False)[0], _run(p, "b", x, False)[0]], 2) @ p["O"] + p["ob"]


def decode(s, trans):
    """Best tag sequence of each row (Viterbi)."""
    n, steps, k = s.shape
    best, back = s[:, 0], np.empty((steps, n, k), np.int16)
    for t in range(1, steps):
        via = best[:, :, None] + trans
        back[t] = via.argmax(1)
        best = via.max(1) + s[:, t]
    tags = np.empty((n, steps), np.int16)
    tags[:, -1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t, rows, tags[:, t]]
    return tags


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def gradients(p, symbols, tags):
    """Mean negative log likelihood and its gradient."""
    n, steps = symbols.shape
    x = p["E"][symbols]
    (hf, kf), (hb, kb) = _run(p, "f", x, True), _run(p, "b", x, True)
    hidden = np.concatenate([hf, hb], 2)
    s = hidden @ p["O"] + p["ob"]
    trans, k = p["T"], s.shape[2]
    a, b = np.empty_like(s), np.zeros_like(s)
    a[:, 0] = s[:, 0]
    for t in range(1, steps):
        a[:, t] = s[:, t] + _lse(a[:, t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        b[:, t] = _lse(trans + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = _lse(a[:, -1], 1)
    ds = np.exp(a + b - z[:, None, None])
    rows, cols = np.arange(n)[:, None], np.arange(steps)[None]
    gold = s[rows, cols, tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
    ds[rows, cols, tags] -= 1
    pair = np.exp(a[:, :-1, :, None] + trans + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
    np.add.at(pair, (tags[:, :-1], tags[:, 1:]), -1)
    ds /= n
    g = {"T": pair / n, "O": np.einsum("nth,ntk->hk", hidden, ds), "ob": ds.sum((0, 1))}
    dh, dx, h = ds @ p["O"].T, np.zeros_like(x), hf.shape[2]
    for d, held, part in (("f", kf, dh[:, :, :h]), ("b", kb, dh[:, :, h:])):
        dg_all, dhid, dcell, gh = np.zeros((n, steps, 4 * h), np.float32), 0, 0, 0
        for t, i, f, o, new, before, was, squashed in reversed(held):
            dhid = part[:, t] + dhid
            dcell = dcell + dhid * o * (1 - squashed**2)
            dg = np.concatenate([dcell * new * i * (1 - i), dcell * before * f * (1 - f), dhid * squashed * o * (1 - o), dcell * i * (1 - new**2)], 1)
            dg_all[:, t] = dg
            gh = gh + was.T @ dg
            dhid, dcell = dg @ p[f"H{d}"].T, dcell * f
        g |= {f"H{d}": gh, f"X{d}": np.einsum("nte,ntg->eg", x, dg_all), f"c{d}": dg_all.sum((0, 1))}
        dx += dg_all @ p[f"X{d}"].T
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], symbols, dx)
    return float((z - gold).mean()), g


def train(symbols, tags, n_tags, epochs=6, batch=64, rate=0.01, seed=5):
    """Adam over shuffled batches."""
    p, rng = start(n_tags), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    step, loss = 0, 0.0
    for e in range(epochs):
        order = rng.permutation(len(symbols))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            loss, g = gradients(p, symbols[own], tags[own])
            step += 1
            lr = rate * (0.5 ** (e // 2))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p, loss
