"""A gated recurrent language model in numpy, with a class-factored softmax and truncated backpropagation.

Word ids are ranks by frequency, and a class of the output is a range of ids: P(word) = P(class) * P(word | class), which
takes the softmax of two short vectors instead of one over the vocabulary.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

NAMES = ("wx", "wh", "wc", "bc", "wo", "bo")


@dataclass
class Net:
    """The weights. Its size is fixed by vocabulary, classes and hidden units, whatever it has read."""

    wx: np.ndarray  # word -> update gate, reset gate, candidate
    wh: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    bounds: np.ndarray  # where the classes begin, and the end of the last

    def __post_init__(self) -> None:
        kind = np.uint8 if len(self.bounds) <= 256 else np.uint16  # small types sort fastest
        self.class_of = np.repeat(np.arange(len(self.bounds) - 1, dtype=kind), np.diff(self.bounds))

    @staticmethod
    def new(counts: np.ndarray, classes: int, hidden: int, seed: int) -> "Net":
        """Start from the unigram model of ``counts`` (falling): biases are its logarithms, the output weights are small."""
        rng = np.random.default_rng(seed)
        size = len(counts)
        mass = np.cumsum(np.sqrt(counts + 1.0))
        cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes, "left") + 1
        bounds = np.unique(np.concatenate([[0], np.minimum(cuts, size), [size]]))
        share = (counts + 1.0) / (counts + 1.0).sum()
        per_class = np.add.reduceat(share, bounds[:-1])
        f = np.float32
        return Net(
            rng.normal(0, 0.1, (size, 3 * hidden)).astype(f),
            (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            rng.normal(0, 0.05, (len(per_class), hidden)).astype(f),
            np.log(per_class).astype(f),
            rng.normal(0, 0.05, (size, hidden)).astype(f),
            np.log(share / np.repeat(per_class, np.diff(bounds))).astype(f),
            bounds,
        )

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in (*NAMES, "bounds")})
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> "Net":
        with np.load(io.BytesIO(data)) as held:
            return Net(**{n: held[n] for n in (*NAMES, "bounds")})

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
        """States after each step of a window ``x`` (time x lanes), the last state, and what backpropagation needs.

        Within, lanes are the last axis, so that each gate is one piece of memory.
        """
        size = h.shape[1]
        gates = np.ascontiguousarray(self.wx[x].transpose(0, 2, 1))
        wht, h = np.ascontiguousarray(self.wh.T), np.ascontiguousarray(h.T)
        np.negative(gates[:, : 2 * size], out=gates[:, : 2 * size])  # a gate is 1 / (1 + exp(-a))
        np.negative(wht[: 2 * size], out=wht[: 2 * size])
        states = np.empty((len(x), size, x.shape[1]), np.float32)
        begins = fresh.any(axis=1)
        tape = []
        with np.errstate(over="ignore"):
            for t in range(len(x)):
                if begins[t]:
                    h = h * ~fresh[t]
                own = wht @ h
                zr = own[: 2 * size] + gates[t, : 2 * size]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:size], zr[size:]
                n = r * own[2 * size :]
                n += gates[t, 2 * size :]
                np.tanh(n, out=n)
                if keep:
                    tape.append((h, z, r, n, own[2 * size :]))
                h = h - n
                h *= z
                h += n
                states[t] = h
        return states.transpose(0, 2, 1), h.T, tape

    def emit(self, h: np.ndarray, y: np.ndarray, learn: bool = False) -> tuple[np.ndarray, tuple | None]:
        """Natural log-probability of each word ``y`` after state ``h``; with ``learn`` the gradients of minus their sum."""
        of = self.class_of[y]
        order = np.argsort(of, kind="stable")
        y, of = y[order], of[order]
        h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)[order]  # the last column meets the biases
        wc, wo = np.column_stack([self.wc, self.bc]), np.column_stack([self.wo, self.bo])
        # No logit is larger than this, so that exp() neither overflows nor vanishes where it is small.
        most = max(float(h.max()), -float(h.min()), 0.0)
        sizes = np.maximum.reduceat(np.abs(wo).sum(axis=1), self.bounds[:-1]) * most
        rows = np.arange(len(y))

        def soft(logits: np.ndarray, target: np.ndarray, at: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
            """Log-probabilities of the targets and a column of 1 / sums; with ``learn``, ``logits`` become the gradients
            but for that factor."""
            if not small:
                logits -= logits.max(axis=1, keepdims=True)
            chosen = logits[at, target]
            np.exp(logits, out=logits)
            total = logits @ np.ones(logits.shape[1], logits.dtype)
            if learn:
                logits[at, target] -= total
            return chosen - np.log(total), 1 / total[:, None]

        p = h @ wc.T
        logp, factor = soft(p, of, rows, float(np.abs(wc).sum(axis=1).max()) * most < 60)
        grads, back = None, None
        if learn:
            back = p @ self.wc
            back *= factor
            dw = p.T @ (h * factor)
            grads = [dw[:, :-1], dw[:, -1], []]
        edges = np.searchsorted(of, np.arange(len(self.bounds)))
        for c in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[c], edges[c + 1])
            words = slice(self.bounds[c], self.bounds[c + 1])
            held = h[part]
            q = held @ wo[words].T
            found, factor = soft(q, y[part] - self.bounds[c], rows[: len(q)], sizes[c] < 60)
            logp[part] += found
            if learn:
                more = q @ self.wo[words]
                more *= factor
                back[part] += more
                dw = q.T @ (held * factor)
                grads[2].append((words, dw[:, :-1], dw[:, -1]))
        out = np.empty_like(logp)
        out[order] = logp
        if learn:
            undone = np.empty_like(back)
            undone[order] = back
            return out, (*grads, undone)
        return out, None

    def back(self, x: np.ndarray, fresh: np.ndarray, tape: list, dstates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients for ``wh`` and for the rows of ``wx`` used at each step, within the window only."""
        size = self.wh.shape[0]
        dstates = np.ascontiguousarray(dstates.transpose(0, 2, 1))
        dgates = np.empty((len(x), 3 * size, x.shape[1]), np.float32)
        dwh = np.zeros_like(self.wh)
        down = np.empty((3 * size, x.shape[1]), self.wh.dtype)
        begins = fresh.any(axis=1)
        dh = np.zeros_like(dstates[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, own = tape[t]
            dh = dh + dstates[t]
            keeps = dh * z
            dn = dh - keeps
            dz = h - n
            dz *= z
            dz *= dn  # dh (h - n) z (1 - z)
            dn *= 1 - n * n
            rest = dn * r
            down[:size] = dz
            down[2 * size :] = rest
            rest *= 1 - r
            rest *= own
            down[size : 2 * size] = rest
            dgates[t, : 2 * size] = down[: 2 * size]
            dgates[t, 2 * size :] = dn
            dwh += h @ down.T
            dh = self.wh @ down
            dh += keeps
            if begins[t]:
                dh *= ~fresh[t]
        return dwh, dgates.transpose(0, 2, 1)


def lanes(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents dealt to at most ``most`` lanes of about equal length, the longest first: ``(owner, place)``, time x
    lanes, of each word (its document and its position there); -1 where a lane has ended."""
    sizes = [len(d) for d in docs]
    width = max(1, min(most, len(docs), -(-sum(sizes) // max(sizes))))
    heap = [(0, i) for i in range(width)]
    held: list[list[int]] = [[] for _ in range(width)]
    for d in sorted(range(len(docs)), key=lambda i: -sizes[i]):
        length, i = heapq.heappop(heap)
        held[i].append(d)
        heapq.heappush(heap, (length + sizes[d], i))
    deep = max(length for length, _ in heap)
    owner, place = np.full((width, deep), -1, np.int32), np.full((width, deep), -1, np.int32)
    for i, mine in enumerate(held):
        at = 0
        for d in mine:
            owner[i, at : at + sizes[d]] = d
            place[i, at : at + sizes[d]] = np.arange(sizes[d])
            at += sizes[d]
    return np.ascontiguousarray(owner.T), np.ascontiguousarray(place.T)


def windows(docs: list[np.ndarray], most: int, steps: int, start: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(input, target, fresh, owner)`` of ``steps`` words at a time; the state goes on from window to window and is
    cleared where ``fresh``. Each word is predicted from those before it, the first from ``start``."""
    owner, place = lanes(docs, most)
    flat = np.concatenate(docs)
    begin = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    y = np.where(owner >= 0, flat[np.maximum(begin[owner] + place, 0)], 0)
    x = np.full_like(y, start)
    x[1:] = np.where(place[1:] > 0, y[:-1], start)
    fresh = place <= 0
    for t in range(0, len(y), steps):
        s = slice(t, t + steps)
        yield x[s], y[s], fresh[s], owner[s]


def score(net: Net, docs: list[np.ndarray], start: int, most: int = 256, steps: int = 64) -> np.ndarray:
    """Natural log-likelihood of each document (ids, none empty), whole."""
    total = np.zeros(len(docs))
    h = None
    for x, y, fresh, owner in windows(docs, most, steps, start):
        h = np.zeros((x.shape[1], net.wh.shape[0]), np.float32) if h is None else h
        states, h, _ = net.run(x, fresh, h)
        real = owner >= 0
        logp, _ = net.emit(states[real], y[real])
        total += np.bincount(owner[real], logp, len(docs))
    return total


class Trainer:
    """AdaGrad over windows of ``steps`` words in ``most`` lanes."""

    def __init__(self, net: Net, rate: float, most: int = 384, steps: int = 16) -> None:
        self.net, self.rate, self.most, self.steps = net, rate, most, steps
        self.past = {n: np.full_like(getattr(net, n), 1e-3) for n in NAMES}

    def move(self, name: str, grad: np.ndarray) -> None:
        """One step against ``grad``, which is used up; weights whose gradient is zero stay."""
        past = self.past[name]
        scale = grad * grad
        past += scale
        np.sqrt(past, out=scale)
        grad *= self.rate
        grad /= scale
        weights = getattr(self.net, name)
        weights -= grad

    def learn(self, docs: list[np.ndarray], start: int) -> None:
        net, h = self.net, None
        for x, y, fresh, owner in windows(docs, self.most, self.steps, start):
            h = np.zeros((x.shape[1], net.wh.shape[0]), np.float32) if h is None else h
            states, h, tape = net.run(x, fresh, h, keep=True)
            real = owner >= 0
            n = np.float32(1 / max(1, real.sum()))
            _, (dwc, dbc, words, dh) = net.emit(states[real], y[real], learn=True)
            dstates = np.zeros_like(states)
            dstates[real] = dh
            dwh, dgates = net.back(x, fresh, tape, dstates)
            dwo, dbo, dwx = np.zeros_like(net.wo), np.zeros_like(net.bo), np.zeros_like(net.wx)
            for part, dw, db in words:
                dwo[part], dbo[part] = dw, db
            flat = x.ravel()
            order = np.argsort(flat.astype(np.uint16) if len(net.wx) <= 1 << 16 else flat, kind="stable")
            ids, first = np.unique(flat[order], return_index=True)
            dwx[ids] = np.add.reduceat(dgates.reshape(-1, dgates.shape[2])[order], first, axis=0)
            for name, grad in (("wc", dwc), ("bc", dbc), ("wo", dwo), ("bo", dbo), ("wx", dwx)):
                self.move(name, grad * n)
            self.move("wh", np.clip(dwh * n, -1, 1))
