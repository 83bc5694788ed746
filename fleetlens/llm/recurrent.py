"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried between windows.

Token ids: 0 is the end of a document, up to ``HEAD`` the most frequent words in falling order, then one id for each band of
rarer words and one for all others. Words below ``HEAD`` lie in classes of ``CLASS`` words; a band is a class of its own. The model gives
P(class | state) and, for head words, P(word | class, state); the share of a word within its band comes from counts.

Documents run in lanes beside each other, each whole in one lane. A lane goes from document to document; the state is zeroed after
each end. Windows of ``WINDOW`` steps (up to ``LONG_WINDOW`` in training where few lanes go on) bound the backward pass only: the state
goes on from window to window, so a document's likelihood is whole, and it is trained on with the context that it is scored with.
"""

from __future__ import annotations

import heapq

import numpy as np

HEAD, CLASS, BANDS, STATE = 2048, 64, 8, 16
HEAD_CLASSES = HEAD // CLASS
CLASSES = HEAD_CLASSES + BANDS
WINDOW, LONG_WINDOW, TRAIN_LANES, SCORE_LANES = 16, 256, 256, 512
RATE, DECAY_1, DECAY_2, TINY, CLIP, MEAN = 0.01, 0.9, 0.99, 1e-8, 1.0, 0.99
END = 0
SHAPES = {
    "inputs": (HEAD + BANDS, 3 * STATE), "recur": (STATE, 3 * STATE), "recur_bias": (STATE,),
    "classes": (STATE, CLASSES), "class_bias": (CLASSES,),
    "words": (HEAD_CLASSES, STATE, CLASS), "word_bias": (HEAD_CLASSES, CLASS),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(head_counts: np.ndarray, band_mass: np.ndarray, seed: int = 11) -> np.ndarray:
    """Parameters that give each word its smoothed share of the counts, whatever the state."""
    flat = np.zeros(SIZE, np.float32)
    p = views(flat)
    rng = np.random.default_rng(seed)
    p["inputs"][:] = rng.normal(0, 0.3, p["inputs"].shape)
    p["recur"][:] = rng.normal(0, STATE**-0.5, p["recur"].shape)
    p["inputs"][:, STATE : 2 * STATE] += 1.0  # states last
    held = np.where(head_counts > 0, head_counts + 1.0, 0.0).reshape(HEAD_CLASSES, CLASS)
    p["word_bias"][:] = np.where(held > 0, np.log(np.maximum(held, 1e-30)), -30)
    mass = np.r_[held.sum(axis=1), band_mass]
    p["class_bias"][:] = np.where(mass > 0, np.log(np.maximum(mass, 1e-30) / max(mass.sum(), 1e-30)), -30)
    p["word_bias"] -= p["word_bias"].max(axis=1, keepdims=True)
    return flat


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes of even length, longest first, then mixed within each lane; long lanes come first."""
    heap = [(0, i) for i in range(min(lanes, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for d in np.argsort(-lengths, kind="stable").tolist():
        load, i = heapq.heappop(heap)
        dealt[i].append(d)
        total[i] = load + int(lengths[d])
        heapq.heappush(heap, (total[i], i))
    rng = np.random.default_rng(len(lengths))
    order = sorted(range(len(dealt)), key=lambda i: (-total[i], i))
    return [rng.permutation(dealt[i]).tolist() for i in order]


class Lanes:
    """Documents in lanes, one after another in flat arrays: a long document takes its own room only. Longest lane first."""

    def __init__(self, documents: list[np.ndarray], lanes: int):
        lengths = np.array([len(d) for d in documents])
        dealt = lanes_of(lengths, lanes)
        order = np.array([d for lane in dealt for d in lane], np.int64)
        self.ids = np.concatenate([documents[d] for d in order]) if len(order) else np.zeros(0, np.uint16)
        self.owner = np.repeat(order.astype(np.int32), lengths[order])
        self.size = np.array([int(lengths[lane].sum()) for lane in dealt])
        self.first = np.cumsum(self.size) - self.size
        self.steps = -(-int(self.size[0]) // WINDOW) * WINDOW

    def live(self, lo: int) -> int:
        """How many lanes go on at a step."""
        return int(np.searchsorted(-self.size, -lo, "left"))

    def window(self, lo: int, hi: int, live: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (steps x lanes, ends beyond a lane) and the document of each place (-1 beyond a lane)."""
        step = np.arange(lo, min(hi, self.steps))[:, None]
        inside = step < self.size[:live]
        at = np.where(inside, self.first[:live] + step, 0)
        return np.where(inside, self.ids[at], END).astype(np.int32), np.where(inside, self.owner[at], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _steps(p: dict, ids: np.ndarray, h: np.ndarray, kept: list | None):
    """States before each step of a window (steps x lanes x state) and after it; ``kept`` gets what the backward pass needs."""
    states = np.empty((len(ids), *h.shape), np.float32)
    for t, x in enumerate(ids):
        states[t] = h
        fed = p["inputs"][x]
        again = h @ p["recur"]
        gates = fed[:, : 2 * STATE]
        gates += again[:, : 2 * STATE]
        _sigmoid(gates)
        r, z = gates[:, :STATE], gates[:, STATE:]
        inner = again[:, 2 * STATE :] + p["recur_bias"]
        n = np.tanh(fed[:, 2 * STATE :] + r * inner)
        on = (x != END).astype(np.float32)[:, None]
        if kept is not None:
            kept.append((r, z, inner, n, on))
        h = (n + z * (h - n)) * on
    return states, h


_ONES = {n: np.ones(n, np.float32) for n in (CLASS, CLASSES)}


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    np.minimum(logits, 80, out=logits)  # within the range of exp; states are in (-1, 1), so logits stay far below
    e = np.exp(logits)
    return e, e @ _ONES[e.shape[1]]


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    classes = np.where(ids < HEAD, ids // CLASS, ids - HEAD + HEAD_CLASSES)
    order = np.argsort(classes, kind="stable")
    return classes, order, np.searchsorted(classes[order], np.arange(HEAD_CLASSES + 1))


def likelihood(p: dict, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log of P(class) P(word | class) of each id; of bands, P(class) only."""
    classes, order, at = _by_class(ids)
    logits = states @ p["classes"] + p["class_bias"]
    e, total = _softmax(logits)
    out = logits[np.arange(len(ids)), classes] - np.log(total)
    for c in np.flatnonzero(np.diff(at)):
        rows = order[at[c] : at[c + 1]]
        if len(rows):
            inner = states[rows] @ p["words"][c] + p["word_bias"][c]
            _, total = _softmax(inner)
            out[rows] += inner[np.arange(len(rows)), ids[rows] % CLASS] - np.log(total)
    return out


def score(flat: np.ndarray, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole document (ids that end with ``END``)."""
    out = np.zeros(len(documents))
    if not documents:
        return out
    p = views(flat)
    lanes = Lanes(documents, SCORE_LANES)
    h = np.zeros((len(lanes.size), STATE), np.float32)
    for lo in range(0, lanes.steps, WINDOW):
        live = lanes.live(lo)
        part, own = lanes.window(lo, lo + WINDOW, live)
        own = own.ravel()
        states, h = _steps(p, part, h[:live], None)
        held = np.flatnonzero(own >= 0)
        value = likelihood(p, states.reshape(-1, STATE)[held], part.ravel()[held])
        out += np.bincount(own[held], value, len(documents))
    return out


def gradient(p: dict, g: dict, ids: np.ndarray, weight: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Adds the slope of the weighted mean loss of a window to ``g``; returns the state after the window."""
    kept: list = []
    states, after = _steps(p, ids, h, kept)
    flat, x = states.reshape(-1, STATE), ids.ravel()
    w = (weight.ravel() / max(weight.sum(), 1)).astype(np.float32)
    classes, order, at = _by_class(x)
    e, total = _softmax(flat @ p["classes"] + p["class_bias"])
    e *= (w / total)[:, None]
    e[np.arange(len(x)), classes] -= w
    back = e @ p["classes"].T
    g["classes"] += flat.T @ e
    g["class_bias"] += e.sum(axis=0)
    for c in np.flatnonzero(np.diff(at)):
        rows = order[at[c] : at[c + 1]]
        if len(rows):
            some = flat[rows]
            e, total = _softmax(some @ p["words"][c] + p["word_bias"][c])
            e *= (w[rows] / total)[:, None]
            e[np.arange(len(rows)), x[rows] % CLASS] -= w[rows]
            back[rows] += e @ p["words"][c].T
            g["words"][c] += some.T @ e
            g["word_bias"][c] += e.sum(axis=0)
    back = back.reshape(states.shape)
    fed = np.empty((len(ids), ids.shape[1], 3 * STATE), np.float32)
    again = np.empty_like(fed)  # as ``fed``, but for the part of the inner state that passes the reset gate
    turned = np.ascontiguousarray(p["recur"].T)
    d = np.zeros_like(h)
    for t in range(len(ids) - 1, -1, -1):
        r, z, inner, n, on = kept[t]
        d *= on
        dn = d * (1 - z)
        dn *= 1 - n * n
        f, g_t = fed[t], again[t]
        np.multiply(dn * inner, r * (1 - r), out=f[:, :STATE])
        np.multiply(d * (states[t] - n), z * (1 - z), out=f[:, STATE : 2 * STATE])
        f[:, 2 * STATE :] = dn
        g_t[:, : 2 * STATE] = f[:, : 2 * STATE]
        np.multiply(dn, r, out=g_t[:, 2 * STATE :])
        d = d * z
        d += g_t @ turned
        d += back[t]
    again = again.reshape(-1, 3 * STATE)
    g["recur"] += flat.T @ again
    g["recur_bias"] += again[:, 2 * STATE :].sum(axis=0)
    by = np.argsort(x, kind="stable")
    cut = np.flatnonzero(np.r_[True, x[by][1:] != x[by][:-1]])
    g["inputs"][x[by][cut]] += np.add.reduceat(fed.reshape(-1, 3 * STATE)[by], cut)
    return after


def train(flat: np.ndarray, blocks) -> tuple[np.ndarray, int]:
    """One pass over blocks (lists of documents) from given parameters; returns the new ones and the number of tokens."""
    flat = flat.copy()
    p = views(flat)
    slope = np.zeros(SIZE, np.float32)
    g = views(slope)
    first, second = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)
    mean, seen = np.zeros(SIZE), 0.0  # of the parameters on the way, the late ones most
    made = tokens = 0
    for documents in blocks:
        lanes = Lanes(documents, TRAIN_LANES)
        h = np.zeros((len(lanes.size), STATE), np.float32)
        lo = 0
        while lo < lanes.steps:
            live = lanes.live(lo)
            if not live:
                break
            # The last lanes, of the longest documents, take longer windows: about as many tokens to a step as before.
            hi = lo + min(WINDOW * max(TRAIN_LANES // live, 1), LONG_WINDOW)
            ids, owner = lanes.window(lo, hi, live)
            weight = (owner >= 0).astype(np.float32)
            slope[:] = 0
            h = gradient(p, g, ids, weight, h[:live])
            lo = hi
            norm = float(np.sqrt(slope @ slope))
            if norm > CLIP:
                slope *= CLIP / norm
            made += 1
            tokens += int(weight.sum())
            first += (1 - DECAY_1) * (slope - first)
            second += (1 - DECAY_2) * (slope * slope - second)
            share = float(weight.sum()) / (WINDOW * TRAIN_LANES)  # a token counts the same in a thin window
            step = RATE * share * (1 - DECAY_2**made) ** 0.5 / (1 - DECAY_1**made)
            flat -= step * first / (np.sqrt(second) + TINY)
            pull = share * (1 - MEAN)
            mean += pull * (flat - mean)
            seen += pull * (1 - seen)
    return (mean / seen).astype(np.float32) if seen else flat, tokens
