"""A bidirectional gated recurrent network over bytes, in numpy: labels every position, trained by backpropagation through time.

Texts are cut into windows of at most WINDOW bytes; both directions start at zero at a window's edges, so every
position is read with all bytes of its window, from one side or the other. Windows of a batch are ordered by falling
length: at each place only the windows that reach it take part, the backward direction starting at their own ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WINDOW, HIDDEN = 128, 8
#: Windows of a training step, passes over the training windows, largest and last learning rate, largest norm of a step's gradient.
STEP_WINDOWS, EPOCHS, RATE, LAST_RATE, CLIP = 128, 6, 0.03, 0.001, 1.0
#: Windows scored at once.
AT_ONCE = 2048

#: Bytes that count as parts of letters: those of ASCII letters, and all that are not ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _over_one_plus(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place of x."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def windows_of(data: bytes, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes as rows, lengths) of a text's windows, at most `at_once` at a time; the last window may be short."""
    raw = np.frombuffer(data, np.uint8)
    for low in range(0, len(raw), WINDOW * at_once):
        part = raw[low : low + WINDOW * at_once]
        n = -(-len(part) // WINDOW)
        rows = np.zeros((n, WINDOW), np.uint8)
        rows.ravel()[: len(part)] = part
        length = np.full(n, WINDOW)
        length[-1] = len(part) - WINDOW * (n - 1)
        yield rows, length


@dataclass
class Network:
    """labels: the names of the outputs. Of each direction (f, b) and gate (r: reset, z: update, c: candidate): in_ (inputs by byte) and
    state_ (hidden to hidden); plus, the bias of the candidate's hidden part; out, hidden to labels. bias, of the labels."""

    labels: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def blank(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng, params = np.random.default_rng(seed), {"bias": np.zeros(len(labels), np.float32)}
        for way in "fb":
            for gate in "rzc":
                params[f"{way}_in_{gate}"] = rng.normal(0, 0.3, (256, hidden)).astype(np.float32)
                params[f"{way}_state_{gate}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)).astype(np.float32)
            params[f"{way}_plus"] = np.zeros(hidden, np.float32)
            params[f"{way}_out"] = rng.normal(0, 0.3, (hidden, len(labels))).astype(np.float32)
        return cls(labels, params)

    def forget(self, seen: np.ndarray) -> None:
        """Bytes that the training windows lack get the mean input of the seen ones."""
        for k, v in self.params.items():
            if "_in_" in k and seen.any():
                v[~seen] = v[seen].mean(0)

    def _run(self, way: str, columns: np.ndarray, active: np.ndarray, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place, hidden states of the active windows, valid until the next place), in the order in which the direction reads.

        keep: gets what backpropagation needs. Gates are sigmoids 1 / (1 + exp(-x)), candidates tanh x = 2 / (1 + exp(-2x)) - 1;
        the factors are put into the weights.
        """
        p = self.params
        weights = [(p[f"{way}_in_{g}"] * s, p[f"{way}_state_{g}"] * s) for g, s in (("r", -1), ("z", -1), ("c", -2))]
        (in_r, state_r), (in_z, state_z), (in_c, state_c) = weights
        plus = p[f"{way}_plus"] * -2
        shape, kind = (int(active.max(initial=0)), len(plus)), plus.dtype
        full, buffers = np.zeros(shape, kind), [np.empty(shape, kind) for _ in range(4)]
        for t in range(len(active)) if way == "f" else range(len(active) - 1, -1, -1):
            n = active[t]
            if not n:
                continue
            h, ids = full[:n], columns[t, :n]
            r, z, c, extra = (b[:n] for b in buffers) if keep is None else (np.empty((n, shape[1]), kind) for _ in range(4))
            for out, inputs, state in ((r, in_r, state_r), (z, in_z, state_z)):
                np.matmul(h, state, out=out)
                out += inputs.take(ids, 0)
                _over_one_plus(out)
            np.matmul(h, state_c, out=extra)
            extra += plus
            np.multiply(r, extra, out=c)
            c += in_c.take(ids, 0)
            _over_one_plus(c)
            c *= 2
            c -= 1
            if keep is not None:
                keep.append((t, h.copy(), r, z, extra / -2, c))
            h -= c
            h *= z
            h += c
            yield t, h

    def logits(self, columns: np.ndarray, active: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Label scores by place and window. columns: bytes by place and window; active: windows that reach each place."""
        out = np.zeros((len(active), columns.shape[1], len(self.labels)), self.params["bias"].dtype)
        out += self.params["bias"]
        for way in "fb":
            steps = None if keep is None else keep.setdefault(way, [])
            for t, h in self._run(way, columns, active, steps):
                out[t, : len(h)] += h @ self.params[f"{way}_out"]
                if steps is not None:
                    steps[-1] = (*steps[-1], h.copy())
        return out

    def weights(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, label weights by place and window, their sums) of the windows by falling length; weights over sums are probabilities."""
        order = np.argsort(-length, kind="stable")
        e = self.logits(np.ascontiguousarray(rows[order].T), reach(length[order], rows.shape[1]))
        np.clip(e, -60, 60, out=e)
        np.exp(e, out=e)
        return order, e, (e.reshape(-1, len(self.labels)) @ np.ones(len(self.labels), e.dtype)).reshape(e.shape[:2])

    def probabilities(self, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Label probabilities by window and position; void beyond a window's end."""
        order, e, total = self.weights(rows, length)
        out = np.empty((len(rows), rows.shape[1], len(self.labels)), e.dtype)
        out[order] = (e / total[..., None]).transpose(1, 0, 2)
        return out

    def sums(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label probabilities added over the letters, number of the letters) of each window."""
        order, e, total = self.weights(rows, length)
        live = (LETTERS[rows] & (np.arange(rows.shape[1]) < length[:, None]))[order].T
        e *= (live / total)[..., None]
        out, count = np.empty((len(rows), len(self.labels))), np.empty(len(rows))
        out[order], count[order] = e.sum(0), live.sum(0)
        return out, count

    def gradients(self, columns: np.ndarray, length: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the letters' positions, each window counting alike, and its gradients; windows by falling length."""
        active, keep = reach(length, len(columns)), {}
        p = softmax(self.logits(columns, active, keep))
        live = LETTERS[columns] & (np.arange(len(columns))[:, None] < length)
        weight = (live / np.maximum(1, live.sum(0)) / columns.shape[1]).astype(p.dtype)
        right = np.take_along_axis(p, target[None, :, None], 2)[..., 0]
        loss = float(-(weight * np.log(right + 1e-30)).sum())
        dy = p * weight[..., None]
        np.put_along_axis(dy, np.broadcast_to(target[None, :, None], (*dy.shape[:2], 1)), (right * weight - weight)[..., None], 2)
        g = {k: np.zeros_like(v) for k, v in self.params.items()}
        g["bias"] = dy.sum((0, 1))
        inside = np.arange(len(columns))[:, None] < length
        order = np.argsort(columns[inside], kind="stable")
        seen, first = np.unique(columns[inside][order], return_index=True)
        for way in "fb":
            out, size = self.params[f"{way}_out"], len(self.params[f"{way}_plus"])
            into = {k: np.zeros((*columns.shape, size), p.dtype) for k in "rzc"}
            dh = np.zeros((columns.shape[1], size), p.dtype)
            for t, before, r, z, extra, c, h in reversed(keep[way]):
                n = len(h)
                g[f"{way}_out"] += h.T @ dy[t, :n]
                d = dh[:n] + dy[t, :n] @ out.T
                dc = d * (1 - z) * (1 - c * c)
                hidden = {"r": dc * extra * r * (1 - r), "z": d * (before - c) * z * (1 - z), "c": dc * r}
                dh[:n] = d * z
                for k, v in hidden.items():
                    g[f"{way}_state_{k}"] += before.T @ v
                    dh[:n] += v @ self.params[f"{way}_state_{k}"].T
                    into[k][t, :n] = dc if k == "c" else v
                g[f"{way}_plus"] += hidden["c"].sum(0)
            for k, v in into.items():
                g[f"{way}_in_{k}"][seen] = np.add.reduceat(v[inside][order], first, 0)
        return loss, g


def softmax(y: np.ndarray) -> np.ndarray:
    y -= y.max(-1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(-1, keepdims=True)
    return y


def reach(length: np.ndarray, places: int) -> np.ndarray:
    """How many windows reach each place; lengths fall."""
    return np.searchsorted(-length, -np.arange(places), "left")


def train(rows: np.ndarray, length: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 7) -> Network:
    """Adam over shuffled windows, the learning rate falling along half a cosine; the same rows in the same order give the same network."""
    net, rng = Network.blank(labels, hidden, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.params.items()} for _ in range(2))
    steps, t = epochs * -(-len(rows) // STEP_WINDOWS), 0
    with np.errstate(over="ignore"):
        for _ in range(epochs):
            mixed = rng.permutation(len(rows))
            for low in range(0, len(rows), STEP_WINDOWS):
                at = mixed[low : low + STEP_WINDOWS]
                at = at[np.argsort(-length[at], kind="stable")]
                _, g = net.gradients(np.ascontiguousarray(rows[at].T), length[at], target[at])
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                rate = LAST_RATE + (RATE - LAST_RATE) * 0.5 * (1 + np.cos(np.pi * t / steps))
                t += 1
                for k, v in g.items():
                    v *= np.float32(min(1.0, CLIP / (norm + 1e-12)))
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v * v - second[k])
                    net.params[k] -= np.float32(rate / (1 - 0.9**t)) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.99**t)) + np.float32(1e-8))
    net.forget(np.bincount(rows[np.arange(rows.shape[1]) < length[:, None]], minlength=256) > 0)
    return net
