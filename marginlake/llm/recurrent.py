"""A bidirectional gated recurrent network in numpy: forward, backpropagation through time, Adam.

Arrays are laid out (units, batch): long inner loops, whatever the number of units.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = np.exp(x - x.max(axis=axis, keepdims=True))
    x /= x.sum(axis=axis, keepdims=True)
    return x


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m = self.m[k] / (1 - 0.9**self.t)
            v = self.v[k] / (1 - 0.99**self.t)
            self.params[k] -= F32(self.rate * rate) * m / (np.sqrt(v) + 1e-8)


class ByteTagger:
    """Probabilities of labels at every byte, from gated units that read from both sides.

    A unit has an update and a reset gate: h' = h + z * (c - h), with
    c = tanh(input + r * (U h)).
    """

    def __init__(self, labels: list[str], units: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.units = labels, units
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(F32)
        self.params = {}
        for d in "fb":
            self.params[f"E{d}"] = draw(3 * units, 256, scale=0.3)
            self.params[f"U{d}"] = draw(3 * units, units, scale=1 / np.sqrt(units))
            self.params[f"W{d}"] = draw(len(labels), units, scale=0.3)
        self.params["b"] = np.zeros((len(labels), 1), F32)

    # ---- reading

    def _read(self, x: np.ndarray, d: str) -> np.ndarray:
        """States (time, units, batch) of one direction for bytes (time, batch)."""
        n, (steps, batch) = self.units, x.shape
        # Gates are sigmoids; sigmoid(a) = tanh(a / 2) / 2 + 1 / 2.
        half = np.repeat(np.array([0.5, 0.5, 1], F32), n)[:, None]
        table, weights = self.params[f"E{d}"] * half, self.params[f"U{d}"] * half
        h, out = np.zeros((n, batch), F32), np.empty((steps, n, batch), F32)
        a, m = np.empty((3 * n, batch), F32), np.empty((3 * n, batch), F32)
        gates, c = a[: 2 * n], a[2 * n :]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(weights, h, out=m)
            gates += m[: 2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            m[2 * n :] *= a[n : 2 * n]
            c += m[2 * n :]
            np.tanh(c, out=c)
            c -= h
            c *= a[:n]
            h += c
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, labels, batch) for bytes (time, batch)."""
        p = self.params
        return softmax(p["Wf"] @ self._read(x, "f") + p["Wb"] @ self._read(x, "b") + p["b"], 1)

    # ---- learning

    def _forward(self, x: np.ndarray, d: str):
        n, (steps, batch) = self.units, x.shape
        table, weights = self.params[f"E{d}"], self.params[f"U{d}"]
        h, kept = np.zeros((n, batch), F32), [None] * steps
        states = np.empty((steps, n, batch), F32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, m = table[:, x[t]], weights @ h
            g = 1 / (1 + np.exp(-(a[: 2 * n] + m[: 2 * n])))
            z, r = g[:n], g[n:]
            c = np.tanh(a[2 * n :] + r * m[2 * n :])
            kept[t] = (h, z, r, c, m[2 * n :])
            h = h + z * (c - h)
            states[t] = h
        return states, kept

    def _backward(self, x: np.ndarray, d: str, kept, dstates: np.ndarray):
        n, (steps, batch) = self.units, x.shape
        weights = self.params[f"U{d}"]
        dh, du = np.zeros((n, batch), F32), np.zeros_like(weights)
        dinput = np.empty((steps, 3 * n, batch), F32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            h, z, r, c, mc = kept[t]
            dh = dh + dstates[t]
            dc = dh * z * (1 - c * c)
            dm = np.concatenate([dh * (c - h) * z * (1 - z), dc * mc * r * (1 - r), dc * r])
            dinput[t] = np.concatenate([dm[: 2 * n], dc])
            du += dm @ h.T
            dh = dh * (1 - z) + weights.T @ dm
        flat, rows = x.reshape(-1), dinput.transpose(1, 0, 2).reshape(3 * n, -1)
        table = np.stack([np.bincount(flat, row, 256) for row in rows]).astype(F32)
        return table, du

    def gradients(self, x: np.ndarray, y: np.ndarray, filled: np.ndarray | None = None):
        """Mean cross entropy over all positions, and its gradients; ``y``: a label for each column.

        Of each column the first ``filled`` positions count (default: all).
        """
        p = self.params
        sf, kf = self._forward(x, "f")
        sb, kb = self._forward(x, "b")
        prob = softmax(p["Wf"] @ sf + p["Wb"] @ sb + p["b"], 1)
        steps, _, batch = prob.shape
        inside = np.ones((steps, batch), F32) if filled is None else (np.arange(steps)[:, None] < filled).astype(F32)
        own = prob[:, y, np.arange(batch)]
        d = prob
        d[:, y, np.arange(batch)] -= 1
        d *= (inside / inside.sum())[:, None, :].astype(d.dtype)
        grads = {"b": d.sum(axis=(0, 2))[:, None]}
        for side, states, kept in (("f", sf, kf), ("b", sb, kb)):
            grads[f"W{side}"] = np.einsum("tlb,tub->lu", d, states, optimize=True)
            grads[f"E{side}"], grads[f"U{side}"] = self._backward(x, side, kept, p[f"W{side}"].T @ d)
        return float((-np.log(own + 1e-9) * inside).sum() / inside.sum()), grads

    def fit(
        self, x: np.ndarray, y: np.ndarray, passes: int, batch: int, rate: float, seed: int = 11, filled: np.ndarray | None = None
    ) -> list[float]:
        """Adam over shuffled batches, the rate falling to a tenth; returns the losses."""
        rng, adam, losses = np.random.default_rng(seed), Adam(self.params, rate), []
        total = passes * max(1, len(y) // batch)
        for _ in range(passes):
            order = rng.permutation(len(y))
            for i in range(0, max(1, len(y) - batch + 1), batch):
                at = order[i : i + batch]
                loss, grads = self.gradients(x[:, at], y[at], None if filled is None else filled[at])
                adam.step(grads, 1 - 0.9 * len(losses) / total)
                losses.append(loss)
        return losses


class SequenceLabeller:
    """Probability of "yes" for every element of sequences, by long short-term memory read from both sides.

    An element is a bag of marks (hashed, their vectors are summed), a bag of
    words (hashed, their vectors are averaged) and some numbers.
    """

    def __init__(self, marks: int, words: int, numbers: int, units: int, word_size: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.units, self.sizes = units, (marks, words)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(F32)
        self.params = {"words": draw(words, word_size, scale=0.1), "b": np.zeros(1, F32)}
        for d in "fb":
            self.params[f"marks{d}"] = draw(marks, 4 * units, scale=0.1)
            self.params[f"mean{d}"] = draw(word_size, 4 * units, scale=0.3)
            self.params[f"numbers{d}"] = draw(numbers, 4 * units, scale=0.2)
            self.params[f"bias{d}"] = np.zeros(4 * units, F32)
            self.params[f"bias{d}"][units : 2 * units] = 1  # remember at first
            self.params[f"U{d}"] = draw(4 * units, units, scale=1 / np.sqrt(units))
            self.params[f"o{d}"] = draw(units, scale=0.3)

    # Bags of all elements come one behind the other, with their sizes.

    def _inputs(self, bags, d: str):
        (mark, nm), (word, nw), numbers = bags
        p = self.params
        mean = _bag_sums(p["words"], word, nw) / np.maximum(1, nw)[:, None].astype(F32)
        a = _bag_sums(p[f"marks{d}"], mark, nm) + mean @ p[f"mean{d}"] + numbers @ p[f"numbers{d}"] + p[f"bias{d}"]
        return a, mean

    def _run(self, a: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States (time, units, batch) for inputs (time, 4 * units, batch); a masked element leaves a zero state."""
        n, (steps, _, batch) = self.units, a.shape
        u = self.params[f"U{d}"]
        h, c = np.zeros((n, batch), F32), np.zeros((n, batch), F32)
        states, kept = np.zeros((steps, n, batch), F32), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = a[t] + u @ h
            s = 1 / (1 + np.exp(-g[: 3 * n]))
            i, f, o = s[:n], s[n : 2 * n], s[2 * n :]
            new = np.tanh(g[3 * n :])
            before = c
            c = (f * c + i * new) * mask[t]
            tc = np.tanh(c)
            if keep:
                kept[t] = (h, before, i, f, o, new, tc)
            h = o * tc * mask[t]
            states[t] = h
        return states, kept

    def _backward(self, kept, mask, d: str, dstates: np.ndarray):
        n, (steps, _, batch) = self.units, dstates.shape
        u = self.params[f"U{d}"]
        dh, dc, du = np.zeros((n, batch), F32), np.zeros((n, batch), F32), np.zeros_like(u)
        da = np.zeros((steps, 4 * n, batch), F32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            h, before, i, f, o, new, tc = kept[t]
            dh = (dh + dstates[t]) * mask[t]
            dc = (dc + dh * o * (1 - tc * tc)) * mask[t]
            da[t] = np.concatenate(
                [dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)]
            )
            du += da[t] @ h.T
            dh, dc = u.T @ da[t], dc * f
        return da, du

    def _grid(self, lengths: np.ndarray):
        """Place of each element in (time, batch), and the mask."""
        steps, batch = int(lengths.max()), len(lengths)
        col = np.repeat(np.arange(batch), lengths)
        row = np.arange(len(col)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        mask = np.zeros((steps, 1, batch), F32)
        mask[row, 0, col] = 1
        return row, col, mask

    def probabilities(self, bags, lengths: np.ndarray, batch: int = 512) -> np.ndarray:
        """For all elements of sequences of the given lengths (none of them 0)."""
        inputs = {d: self._inputs(bags, d)[0] for d in "fb"}
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]) if len(ends) else 0, F32)
        order = np.argsort(lengths, kind="stable")
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            row, col, mask = self._grid(lengths[some])
            at = np.concatenate([np.arange(ends[s] - lengths[s], ends[s]) for s in some])
            score = np.full(len(at), self.params["b"][0], F32)
            for d in "fb":
                a = np.zeros((len(mask), 4 * self.units, len(some)), F32)
                a[row, :, col] = inputs[d][at]
                states, _ = self._run(a, mask, d, keep=False)
                score += states[row, :, col] @ self.params[f"o{d}"]
            out[at] = 1 / (1 + np.exp(-score))
        return out

    def gradients(self, bags, lengths: np.ndarray, y: np.ndarray):
        """Mean cross entropy over elements, and its gradients."""
        p, n = self.params, self.units
        (mark, nm), (word, nw), numbers = bags
        row, col, mask = self._grid(lengths)
        score, runs = np.full(len(y), p["b"][0], F32), {}
        for d in "fb":
            x, mean = self._inputs(bags, d)
            a = np.zeros((len(mask), 4 * n, len(lengths)), F32)
            a[row, :, col] = x
            states, kept = self._run(a, mask, d, keep=True)
            runs[d] = (states, kept, mean)
            score += states[row, :, col] @ p[f"o{d}"]
        prob = 1 / (1 + np.exp(-score))
        loss = float(-np.log(np.where(y > 0, prob, 1 - prob) + 1e-9).mean())
        ds = ((prob - y) / len(y)).astype(F32)
        grads = {"b": np.array([ds.sum()], F32), "words": np.zeros_like(p["words"])}
        for d in "fb":
            states, kept, mean = runs[d]
            grads[f"o{d}"] = states[row, :, col].T @ ds
            dstates = np.zeros_like(states)
            dstates[row, :, col] = ds[:, None] * p[f"o{d}"]
            da, grads[f"U{d}"] = self._backward(kept, mask, d, dstates)
            dx = da[row, :, col]
            grads[f"bias{d}"] = dx.sum(axis=0)
            grads[f"numbers{d}"] = numbers.T @ dx
            grads[f"mean{d}"] = mean.T @ dx
            grads[f"marks{d}"] = _bag_scatter(len(p[f"marks{d}"]), mark, nm, dx)
            dmean = (dx @ p[f"mean{d}"].T) / np.maximum(1, nw)[:, None].astype(F32)
            grads["words"] += _bag_scatter(len(p["words"]), word, nw, dmean)
        return loss, grads


def _bag_sums(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the table's rows for each bag."""
    out = np.zeros((len(sizes), table.shape[1]), F32)
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(table[ids], starts, axis=0)
    return out


def _bag_scatter(rows: int, ids: np.ndarray, sizes: np.ndarray, grads: np.ndarray) -> np.ndarray:
    spread = np.repeat(grads, sizes, axis=0)
    return np.stack([np.bincount(ids, spread[:, k], rows) for k in range(grads.shape[1])], axis=1).astype(F32)
