"""The stage-1 network over windows of bars: attention blocks behind learned positions, and its gradient.

Plain arrays of one chunk of windows; how windows, gradients and models are spread over tasks is in sequence_training.
Layers are normalised before each block; the class is read off a token put before the window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

CLASSES = 3
EPS = 1e-5


@dataclass(frozen=True)
class Shape:
    """Sizes of the network."""

    features: int
    length: int = 60
    width: int = 128
    heads: int = 8
    layers: int = 4
    inner: int = 256
    dropout: float = 0.1

    def parts(self) -> dict[str, tuple[int, ...]]:
        """Names and shapes of the parameters, in the order in which they lie in one vector."""
        d, f = self.width, self.inner
        out: dict[str, tuple[int, ...]] = {"in_w": (self.features, d), "in_b": (d,), "in_g": (d,), "in_c": (d,), "token": (d,), "place": (self.length + 1, d)}
        for k in range(self.layers):
            sizes = {"a_g": (d,), "a_c": (d,), "qkv_w": (d, 3 * d), "qkv_b": (3 * d,), "o_w": (d, d), "o_b": (d,), "f_g": (d,), "f_c": (d,), "f1_w": (d, f), "f1_b": (f,), "f2_w": (f, d), "f2_b": (d,)}
            out |= {f"{k}{n}": s for n, s in sizes.items()}
        return out | {"out_g": (d,), "out_c": (d,), "h1_w": (d, d // 2), "h1_b": (d // 2,), "h2_w": (d // 2, CLASSES), "h2_b": (CLASSES,)}

    @property
    def size(self) -> int:
        return sum(math.prod(s) for s in self.parts().values())

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """The vector's parts by name, without copying."""
        out, at = {}, 0
        for name, s in self.parts().items():
            out[name] = vector[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
        return out

    def start(self, seed: int) -> np.ndarray:
        """Matrices uniform within sqrt(6 / (rows + columns)), gains 1, the token near 0, positions normal, the rest 0."""
        rng, vector = np.random.default_rng(seed), np.zeros(self.size)
        for name, x in self.views(vector).items():
            if name.endswith("_w"):
                x[:] = rng.uniform(-1, 1, x.shape) * math.sqrt(6 / sum(x.shape))
            elif name.endswith("_g"):
                x[:] = 1
            elif name in ("token", "place"):
                x[:] = rng.normal(size=x.shape) * (0.02 if name == "token" else 1)
        return vector


class _Pass:
    """One forward pass that remembers how to go back. Each step returns its value and what takes a gradient through it."""

    def __init__(self, shape: Shape, p: dict[str, np.ndarray], grads: dict[str, np.ndarray] | None, rng: np.random.Generator | None):
        self.shape, self.p, self.grads, self.rng = shape, p, grads, rng

    def linear(self, x, name):
        w = self.p[name + "_w"]

        def back(dy):
            flat = dy.reshape(-1, w.shape[1])
            self.grads[name + "_w"] += x.reshape(-1, w.shape[0]).T @ flat
            self.grads[name + "_b"] += flat.sum(0)
            return dy @ w.T

        return x @ w + self.p[name + "_b"], back

    def norm(self, x, name):
        g = self.p[name + "_g"]
        centred = x - x.mean(-1, keepdims=True)
        scale = 1 / np.sqrt((centred**2).mean(-1, keepdims=True) + EPS)
        unit = centred * scale

        def back(dy):
            axes = tuple(range(dy.ndim - 1))
            self.grads[name + "_g"] += (dy * unit).sum(axes)
            self.grads[name + "_c"] += dy.sum(axes)
            d = dy * g
            return scale * (d - d.mean(-1, keepdims=True) - unit * (d * unit).mean(-1, keepdims=True))

        return unit * g + self.p[name + "_c"], back

    def bend(self, x):
        """Gaussian error linear unit, by its tanh form."""
        c = math.sqrt(2 / math.pi)
        t = np.tanh(c * (x + 0.044715 * x**3))
        return 0.5 * x * (1 + t), lambda dy: dy * (0.5 * (1 + t) + 0.5 * x * (1 - t**2) * c * (1 + 3 * 0.044715 * x**2))

    def drop(self, x, places=None):
        """places: how many there are, where x holds the first of them; what is drawn for these is the same."""
        if self.rng is None or not self.shape.dropout:
            return x, lambda dy: dy
        drawn = self.rng.random((*x.shape[:-2], places or x.shape[-2], x.shape[-1]) if x.ndim > 2 else x.shape)
        mask = ((drawn[..., : x.shape[-2], :] if x.ndim > 2 else drawn) >= self.shape.dropout) / (1 - self.shape.dropout)
        return x * mask, lambda dy: dy * mask

    def chain(self, x, *steps):
        backs = []
        for step in steps:
            x, back = step(x)
            backs.append(back)

        def back(dy):
            for b in reversed(backs):
                dy = b(dy)
            return dy

        return x, back

    def attend(self, x, k, asked):
        """Attention of the first `asked` places to all."""
        b, t, d = x.shape
        h = self.shape.heads
        both, back_in = self.linear(x, f"{k}qkv")
        q, key, v = both.reshape(b, t, 3, h, d // h).transpose(2, 0, 3, 1, 4)
        q = q[:, :, :asked]
        s = q @ key.swapaxes(-1, -2) / math.sqrt(d // h)
        s = np.exp(s - s.max(-1, keepdims=True))
        a = s / s.sum(-1, keepdims=True)
        seen, back_drop = self.drop(a, t)
        out, back_out = self.linear((seen @ v).transpose(0, 2, 1, 3).reshape(b, asked, d), f"{k}o")

        def back(dy):
            do = back_out(dy).reshape(b, asked, h, d // h).transpose(0, 2, 1, 3)
            da = back_drop(do @ v.swapaxes(-1, -2))
            ds = a * (da - (da * a).sum(-1, keepdims=True)) / math.sqrt(d // h)
            parts = np.zeros((3, b, h, t, d // h))
            parts[0, :, :, :asked], parts[1], parts[2] = ds @ key, ds.swapaxes(-1, -2) @ q, seen.swapaxes(-1, -2) @ do
            return back_in(parts.transpose(1, 3, 0, 2, 4).reshape(b, t, 3 * d))

        return out, back

    def logits(self, x):
        """The class is read off the token alone, so the last block is worked out for that one place."""
        p, (b, t, _) = self.p, x.shape
        y, back_in = self.chain(x, lambda v: self.linear(v, "in"), lambda v: self.norm(v, "in"), self.drop)
        y = np.concatenate([np.broadcast_to(p["token"], (b, 1, y.shape[-1])), y], 1) + p["place"][: t + 1]
        y, back_place = self.drop(y)
        backs = []
        drop = lambda v: self.drop(v, t + 1)
        for k in range(self.shape.layers):
            asked = 1 if k == self.shape.layers - 1 else t + 1
            steps = (
                (lambda v, k=k: self.norm(v, f"{k}a"), lambda v, k=k, n=asked: self.attend(v, k, n)),
                (lambda v, k=k: self.norm(v, f"{k}f"), lambda v, k=k: self.linear(v, f"{k}f1"), self.bend, drop, lambda v, k=k: self.linear(v, f"{k}f2"), drop),
            )
            for block in steps:
                more, back = self.chain(y, *block)
                y = y[:, :asked] + more
                backs.append(back)
        out, back_head = self.chain(y[:, 0], lambda v: self.norm(v, "out"), lambda v: self.linear(v, "h1"), self.bend, self.drop, lambda v: self.linear(v, "h2"))

        def back(dy):
            d = np.zeros_like(y)
            d[:, 0] = back_head(dy)
            for b_ in reversed(backs):
                before = b_(d)
                before[:, : d.shape[1]] += d
                d = before
            d = back_place(d)
            self.grads["place"][: t + 1] += d.sum(0)
            self.grads["token"] += d[:, 0].sum(0)
            back_in(d[:, 1:])

        return out, back


def probabilities(shape: Shape, vector: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each class, for windows x (windows, length, features)."""
    z, _ = _Pass(shape, shape.views(vector), None, None).logits(x)
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def loss_and_gradient(shape: Shape, vector: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray, rng: np.random.Generator | None = None, grad: np.ndarray | None = None) -> np.ndarray:
    """Sums over windows: weighted cross-entropy, weight, right ones, windows. The loss's gradient is added to grad, if given."""
    run = _Pass(shape, shape.views(vector), None if grad is None else shape.views(grad), rng)
    z, back = run.logits(x)
    z = z - z.max(-1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(-1, keepdims=True))
    w, at = weights[y], np.arange(len(y))
    if grad is not None:
        d = np.exp(logs) * w[:, None]
        d[at, y] -= w
        back(d)
    return np.array([-(w * logs[at, y]).sum(), w.sum(), (logs.argmax(-1) == y).sum(), len(y)])
