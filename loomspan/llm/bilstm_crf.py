"""A small character-level bidirectional LSTM with CRF transitions, in numpy: training, emissions, and Viterbi decoding."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class BiLstmCrf:
    """Parameters: an embedding, two LSTM directions, a linear layer to tag scores, transitions, and scores of first tags."""

    def __init__(self, symbols: int, tags: int, embed: int = 12, hidden: int = 20, seed: int = 1, never: np.ndarray | None = None):
        """never: (tags + 1, tags), true where a tag never follows another; the last row is for the first tag."""
        r = np.random.default_rng(seed)
        self.hidden = hidden
        bar = np.where(never, -1e4, 0).astype(np.float32) if never is not None else np.zeros((tags + 1, tags), np.float32)
        self.bar, self.bar_first = bar[:-1], bar[-1]
        w = {"E": r.normal(0, 0.3, (symbols, embed)), "O": r.normal(0, 0.2, (2 * hidden, tags)), "b": np.zeros(tags), "T": np.zeros((tags, tags)), "S": np.zeros(tags)}
        for d in "fr":
            w[f"W{d}"] = r.normal(0, 1 / np.sqrt(embed + hidden), (embed + hidden, 4 * hidden))
            w[f"c{d}"] = np.concatenate((np.ones(hidden), np.zeros(3 * hidden)))  # forget gates start open
        self.w = {k: v.astype(np.float32) for k, v in w.items()}

    def _direction(self, x: np.ndarray, d: str, keep: bool):
        """x: (time, rows, embed) in reading order. Outputs and what the way back needs."""
        h = c = np.zeros((x.shape[1], self.hidden), np.float32)
        w, b, n, kept, out = self.w[f"W{d}"], self.w[f"c{d}"], self.hidden, [], []
        for xt in x:
            z = np.concatenate((xt, h), 1)
            a = z @ w + b
            f, i, o, g = _sigmoid(a[:, :n]), _sigmoid(a[:, n:2 * n]), _sigmoid(a[:, 2 * n:3 * n]), np.tanh(a[:, 3 * n:])
            before, c = c, f * c + i * g
            t = np.tanh(c)
            h = o * t
            if keep:
                kept.append((z, f, i, o, g, before, t))
            out.append(h)
        return np.stack(out), kept

    def _emit(self, x: np.ndarray, keep: bool = True):
        e = self.w["E"][x.T]
        forward, a = self._direction(e, "f", keep)
        back, b = self._direction(e[::-1], "r", keep)
        h = np.concatenate((forward, back[::-1]), 2)
        return h @ self.w["O"] + self.w["b"], h, a, b

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: (rows, time) of symbols. Tag scores (rows, time, tags)."""
        return self._emit(x, False)[0].transpose(1, 0, 2)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y, and its gradients."""
        scores, h, kept_f, kept_r = self._emit(x)
        steps, rows, tags = scores.shape
        y = y.T
        trans, start = self.w["T"] + self.bar, self.w["S"] + self.bar_first
        alpha, beta = [start + scores[0]], [np.zeros((rows, tags), np.float32)]
        for t in range(1, steps):
            alpha.append(_logsum(alpha[-1][:, :, None] + trans[None], 1) + scores[t])
        for t in range(steps - 1, 0, -1):
            beta.append(_logsum(trans[None] + (scores[t] + beta[-1])[:, None, :], 2))
        beta = beta[::-1]
        whole = _logsum(alpha[-1], 1)
        at = np.arange(rows)
        gold = start[y[0]] + scores[0][at, y[0]]
        d_trans = np.zeros_like(trans)
        d_scores = np.empty_like(scores)
        for t in range(steps):
            d_scores[t] = np.exp(alpha[t] + beta[t] - whole[:, None])
            d_scores[t][at, y[t]] -= 1
            if t:
                gold = gold + trans[y[t - 1], y[t]] + scores[t][at, y[t]]
                pair = np.exp(alpha[t - 1][:, :, None] + trans[None] + (scores[t] + beta[t])[:, None, :] - whole[:, None, None])
                d_trans += pair.sum(0)
                np.add.at(d_trans, (y[t - 1], y[t]), -1)
        d_scores /= rows
        g = {"T": d_trans / rows, "S": d_scores[0].sum(0), "O": np.einsum("trh,trk->hk", h, d_scores), "b": d_scores.sum((0, 1)), "E": np.zeros_like(self.w["E"])}
        dh = d_scores @ self.w["O"].T
        n = self.hidden
        for d, kept, dout, order in (("f", kept_f, dh[:, :, :n], range(steps)), ("r", kept_r, dh[::-1, :, n:], range(steps - 1, -1, -1))):
            w = self.w[f"W{d}"]
            gw, gb, embed = np.zeros_like(w), np.zeros_like(self.w[f"c{d}"]), w.shape[0] - n
            next_h = next_c = np.zeros((rows, n), np.float32)
            places = list(order)
            for t in range(steps - 1, -1, -1):
                z, f, i, o, gg, before, tc = kept[t]
                th = dout[t] + next_h
                dc = next_c + th * o * (1 - tc * tc)
                da = np.concatenate((dc * before * f * (1 - f), dc * gg * i * (1 - i), th * tc * o * (1 - o), dc * i * (1 - gg * gg)), 1)
                gw += z.T @ da
                gb += da.sum(0)
                dz = da @ w.T
                np.add.at(g["E"], x.T[places[t]], dz[:, :embed])
                next_h, next_c = dz[:, embed:], dc * f
            g[f"W{d}"], g[f"c{d}"] = gw, gb
        return float((whole - gold).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 1) -> list[float]:
        """Adam over shuffled batches; gives the loss of each epoch."""
        r, m, v, step, losses = np.random.default_rng(seed), {k: np.zeros_like(p) for k, p in self.w.items()}, {k: np.zeros_like(p) for k, p in self.w.items()}, 0, []
        for epoch in range(epochs):
            order, total = r.permutation(len(x)), 0.0
            for a in range(0, len(order), batch):
                own = order[a:a + batch]
                loss, g = self._gradients(x[own], y[own])
                total += loss * len(own)
                step += 1
                size = np.sqrt(sum(float((p * p).sum()) for p in g.values()))
                lr = rate * (1 - 0.7 * epoch / max(1, epochs - 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, p in g.items():
                    p = p * min(1.0, 5 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * p
                    v[k] = 0.999 * v[k] + 0.001 * p * p
                    self.w[k] -= (lr * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
            losses.append(total / len(x))
        return losses

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tags for the scores of one stretch (time, tags)."""
        trans = self.w["T"] + self.bar
        best, back = self.w["S"] + self.bar_first + scores[0], []
        for s in scores[1:]:
            x = best[:, None] + trans
            back.append(x.argmax(0))
            best = x.max(0) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])
