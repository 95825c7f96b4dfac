"""A gated recurrent language model in numpy: minimal gated unit, class-factored softmax, truncated backpropagation.

Each word belongs to one class. The network gives P(class | state); within a head class it gives P(word | class, state),
within a tail class P(word | class) comes from counts. Documents are laid end to end in lanes that step together; the
state is carried from window to window of a lane and set to zero where a document begins, so a document's log-likelihood
is that of the whole document however long. Gradients go back through one window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

F32 = np.float32


class Shape:
    """head classes of `per` words each, then tail classes. Head word k is in class k // per."""

    def __init__(self, head_classes: int = 32, per: int = 32, tail_classes: int = 32, hidden: int = 24):
        self.head_classes, self.per, self.tail_classes, self.hidden = head_classes, per, tail_classes, hidden
        self.head = head_classes * per
        self.classes = head_classes + tail_classes
        #: Symbols: head words, tail classes, the start.
        self.start = self.head + tail_classes
        self.symbols = self.start + 1

    def sizes(self) -> list[tuple[str, tuple]]:
        h = self.hidden
        # The output's matrices have a row more, for a state that is always one: the bias.
        return [("x", (self.symbols, 2 * h)), ("uf", (h, h)), ("uc", (h, h)), ("wc", (h + 1, self.classes)), ("wo", (self.head_classes, h + 1, self.per))]


def fresh(shape: Shape, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"x": 0.1, "uf": 0.2, "uc": 0.2, "wc": 0.1, "wo": 0.1}
    return {k: (rng.standard_normal(s) * scale.get(k, 0)).astype(F32) for k, s in shape.sizes()}


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in p])


def unflatten(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shape.sizes():
        n = int(np.prod(s))
        out[k] = np.asarray(flat[at : at + n], F32).reshape(s)
        at += n
    return out


class Lanes:
    """Documents' symbols in lanes, longest lane first."""

    def __init__(self, docs: list[np.ndarray], start: int, lanes: int):
        n = np.array([len(d) for d in docs], np.int64)
        order = np.argsort(-n, kind="stable")
        heap = [(0, k) for k in range(min(lanes, max(1, len(docs))))]
        lane, off = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for d in order.tolist():
            at, k = heapq.heappop(heap)
            lane[d], off[d] = k, at
            heapq.heappush(heap, (at + int(n[d]), k))
        size = np.zeros(len(heap), np.int64)
        for at, k in heap:
            size[k] = at
        place = np.argsort(np.argsort(-size, kind="stable"), kind="stable")
        lane = place[lane]
        self.sizes = np.sort(size)[::-1]
        rows = np.repeat(off, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at = (rows, np.repeat(lane, n))
        self.n = n
        length = int(self.sizes[0]) if len(self.sizes) else 0
        self.y = np.full((length, len(heap)), -1, np.int32)
        self.x = np.full((length, len(heap)), start, np.int32)
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        self.y[self.at] = flat
        self.x[1:] = self.y[:-1]
        self.fresh = np.zeros((length, len(heap)), bool)
        full = n > 0
        self.fresh[off[full], lane[full]] = True
        self.x[off[full], lane[full]] = start
        self.x[self.x < 0] = start

    def windows(self, steps: int) -> Iterator[tuple[slice, int]]:
        for a in range(0, len(self.y), steps):
            yield slice(a, a + steps), int(np.searchsorted(-self.sizes, -a, side="left"))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per document the sum of values laid out as the lanes are."""
        flat = values[self.at]
        cut = np.cumsum(self.n) - self.n
        out = np.zeros(len(self.n))
        full = self.n > 0
        if full.any():
            out[full] = np.add.reduceat(flat.astype(np.float64), cut[full])
        return out


#: Rows of the output layer that are worked at a time, so that they stay in a core's cache.
ROWS = 1024


def _softmax(z: np.ndarray) -> np.ndarray:
    """exp(z) in place, and its sums by row. Logits are small; only where one is large the rows are shifted."""
    if z.size and z.max() > 40:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


class Net:
    def __init__(self, shape: Shape, p: dict[str, np.ndarray]):
        self.s, self.p = shape, p

    def forward(self, x: np.ndarray, fresh_: np.ndarray, h: np.ndarray, keep: bool) -> tuple:
        """States after each step of a window, (steps, lanes, hidden + 1) with a last one of 1."""
        p, n = self.p, self.s.hidden
        out = np.ones((*x.shape, n + 1), F32)
        kept = []
        any_fresh = fresh_.any(axis=1).tolist()
        for t in range(len(x)):
            if any_fresh[t]:
                h = h * (~fresh_[t])[:, None]
            e = p["x"][x[t]]
            f = h @ p["uf"]
            f += e[:, :n]
            np.negative(f, out=f)
            np.exp(f, out=f)
            f += 1
            np.reciprocal(f, out=f)
            fh = f * h
            c = fh @ p["uc"]
            c += e[:, n:]
            np.tanh(c, out=c)
            new = c - h
            new *= f
            new += h
            if keep:
                kept.append((h, f, fh, c))
            out[t, :, :n] = new
            h = new
        return out, h, kept

    def output(self, h: np.ndarray, y: np.ndarray, grad: bool) -> tuple:
        """Natural log-probabilities of y (head word or tail class; -1 none) and, for training, the gradients."""
        s, p = self.s, self.p
        real = np.flatnonzero(y >= 0)
        y = y[real]
        head = y < s.head
        cls = np.where(head, y // s.per, y - s.head + s.head_classes)
        # Rows by class: a head class is one stretch, and tail classes follow.
        by = np.argsort(cls, kind="stable")
        real, y, cls = real[by], y[by], cls[by]
        h = h[real]
        lp = np.empty(len(y), F32)
        g = {k: np.zeros_like(p[k]) for k in ("wc", "wo")} if grad else {}
        dh = np.empty((len(y), s.hidden), F32) if grad else None
        for a in range(0, len(y), ROWS):
            part, own = h[a : a + ROWS], cls[a : a + ROWS]
            z = part @ p["wc"]
            i = np.arange(len(own))
            total = _softmax(z)
            hit = z[i, own]
            lp[a : a + ROWS] = np.log(hit / total)
            if grad:
                z *= (1 / total)[:, None]
                z[i, own] -= 1
                g["wc"] += part.T @ z
                dh[a : a + ROWS] = z @ p["wc"][:-1].T
        words = int(np.searchsorted(cls, s.head_classes))
        cut = np.searchsorted(cls, np.arange(s.head_classes + 1)).tolist()
        z = np.empty((words, s.per), F32)
        for k in range(s.head_classes):
            a, b = cut[k], cut[k + 1]
            if b > a:
                np.matmul(h[a:b], p["wo"][k], out=z[a:b])
        at = y[:words] - cls[:words] * s.per
        for a in range(0, words, ROWS):
            part, own = z[a : a + ROWS], at[a : a + ROWS]
            i = np.arange(len(own))
            total = _softmax(part)
            lp[a : a + ROWS][: len(own)] += np.log(part[i, own] / total)
            if grad:
                part *= (1 / total)[:, None]
                part[i, own] -= 1
        if grad:
            for k in range(s.head_classes):
                a, b = cut[k], cut[k + 1]
                if b > a:
                    np.matmul(h[a:b].T, z[a:b], out=g["wo"][k])
                    dh[a:b] += z[a:b] @ p["wo"][k][:-1].T
        return real, lp, g, dh

    def score(self, docs: list[np.ndarray], lanes: int = 768, steps: int = 32) -> np.ndarray:
        """Natural log-likelihood of each document's symbols, the count-based parts of tail words not included."""
        lay = Lanes(docs, self.s.start, lanes)
        out = np.zeros(lay.y.shape, F32)
        h = np.zeros((lay.y.shape[1], self.s.hidden), F32)
        for w, live in lay.windows(steps):
            # The state that predicts a token has seen the tokens before it: the start, then its predecessors.
            states, h, _ = self.forward(lay.x[w, :live], lay.fresh[w, :live], h[:live], False)
            y = lay.y[w, :live].ravel()
            real, lp, _, _ = self.output(states.reshape(-1, self.s.hidden + 1), y, False)
            part = np.zeros(len(y), F32)
            part[real] = lp
            out[w, :live] = part.reshape(-1, live)
        return lay.sums(out)


class Trainer:
    """Adam over windows of truncated backpropagation."""

    def __init__(self, shape: Shape, p: dict[str, np.ndarray], rate: float = 0.01):
        self.net, self.rate, self.k = Net(shape, {k: v.copy() for k, v in p.items()}), rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.tokens = 0

    def learn(self, docs: list[np.ndarray], lanes: int = 512, steps: int = 16) -> None:
        s = self.net.s
        lay = Lanes(docs, s.start, lanes)
        h = np.zeros((lay.y.shape[1], s.hidden), F32)
        for w, live in lay.windows(steps):
            x, fr, y = lay.x[w, :live], lay.fresh[w, :live], lay.y[w, :live]
            states, h, kept = self.net.forward(x, fr, h[:live], True)
            real, _, g, dh = self.net.output(states.reshape(-1, s.hidden + 1), y.ravel(), True)
            if not len(real):
                continue
            self.tokens += len(real)
            d = np.zeros((y.size, s.hidden), F32)
            d[real] = dh
            self._back(x, fr, kept, d.reshape(*y.shape, s.hidden), g)
            self._step(g, 1.0 / len(real))

    def _back(self, x, fresh_, kept, dout, g) -> None:
        p, n = self.net.p, self.net.s.hidden
        de = np.empty((*x.shape, 2 * n), F32)
        guf, guc = np.zeros_like(p["uf"]), np.zeros_like(p["uc"])
        up_f, up_c = np.ascontiguousarray(p["uf"].T), np.ascontiguousarray(p["uc"].T)
        dh = np.zeros_like(dout[0])
        any_fresh = fresh_.any(axis=1).tolist()
        for t in range(len(x) - 1, -1, -1):
            h, f, fh, c = kept[t]
            dh += dout[t]
            df = c - h
            df *= dh
            dc = c * c
            np.subtract(1, dc, out=dc)
            dc *= f
            dc *= dh
            dfh = dc @ up_c
            df += dfh * h
            keep = 1 - f
            df *= f
            df *= keep
            de[t, :, :n], de[t, :, n:] = df, dc
            guf += h.T @ df
            guc += fh.T @ dc
            dh *= keep
            dfh *= f
            dh += dfh
            dh += df @ up_f
            if any_fresh[t]:
                dh *= (~fresh_[t])[:, None]
        flat, ids = de.reshape(-1, 2 * n), x.ravel()
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        first = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
        gx = np.zeros_like(p["x"])
        gx[ids[first]] = np.add.reduceat(flat[by], first, axis=0)
        g["x"], g["uf"], g["uc"] = gx, guf, guc

    def _step(self, g, scale: float) -> None:
        self.k += 1
        b1, b2 = 0.9, 0.99
        rate = self.rate * np.sqrt(1 - b2**self.k) / (1 - b1**self.k)
        norm = scale * float(np.sqrt(sum(float(np.vdot(v, v)) for v in g.values())))
        scale *= min(1.0, 1.0 / max(norm, 1e-9))
        for k, v in g.items():
            m, q = self.m[k], self.v[k]
            v *= F32(scale)
            m *= F32(b1)
            m += F32(1 - b1) * v
            np.multiply(v, v, out=v)
            v *= F32(1 - b2)
            q *= F32(b2)
            q += v
            np.sqrt(q, out=v)
            v += F32(1e-8)
            np.divide(m, v, out=v)
            v *= F32(rate)
            self.net.p[k] -= v
