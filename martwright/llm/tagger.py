"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Parameters = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
    """States of both directions and what the backward pass needs.

    ``x`` is (time, direction, batch, in), the second direction reversed in time; parameters have
    the direction first. The result is (time, direction, batch, hidden).
    """
    steps, _, batch, _ = x.shape
    hidden = wh.shape[1]
    pre = x @ wx + b[:, None]
    h, c = np.zeros((2, batch, hidden)), np.zeros((2, batch, hidden))
    states, cells = np.empty((2, steps, 2, batch, hidden))
    gates = np.empty((steps, 2, batch, 4 * hidden))
    for t in range(steps):
        z = pre[t] + h @ wh
        gate = gates[t]
        gate[..., : 3 * hidden] = _sigmoid(z[..., : 3 * hidden])
        np.tanh(z[..., 3 * hidden :], out=gate[..., 3 * hidden :])
        i, f, o, g = np.split(gate, 4, axis=2)
        c = f * c + i * g
        h = o * np.tanh(c)
        states[t], cells[t] = h, c
    return states, cells, gates


def _lstm_gradients(x, wx, wh, states, cells, gates, d_states):
    steps, _, batch, hidden = states.shape
    d_pre = np.empty_like(gates)
    dh_next, dc_next = np.zeros((2, batch, hidden)), np.zeros((2, batch, hidden))
    squashed = np.tanh(cells)
    back = wh.transpose(0, 2, 1)
    first = np.zeros((2, batch, hidden))
    for t in reversed(range(steps)):
        i, f, o, g = np.split(gates[t], 4, axis=2)
        dh = d_states[t] + dh_next
        dc = dc_next + dh * o * (1 - squashed[t] ** 2)
        before = cells[t - 1] if t else first
        dz = d_pre[t]
        dz[..., :hidden] = dc * g * i * (1 - i)
        dz[..., hidden : 2 * hidden] = dc * before * f * (1 - f)
        dz[..., 2 * hidden : 3 * hidden] = dh * squashed[t] * o * (1 - o)
        dz[..., 3 * hidden :] = dc * i * (1 - g**2)
        dh_next, dc_next = dz @ back, dc * f
    h_before = np.concatenate([first[None], states[:-1]])

    def summed(left: np.ndarray) -> np.ndarray:
        """Over time and batch: (direction, left's width, 4 * hidden)."""
        flat = left.transpose(1, 0, 2, 3).reshape(2, steps * batch, -1)
        return flat.transpose(0, 2, 1) @ d_pre.transpose(1, 0, 2, 3).reshape(2, steps * batch, -1)

    return d_pre @ wx.transpose(0, 2, 1), summed(x), summed(h_before), d_pre.sum(axis=(0, 2))


def _marginals(emissions: np.ndarray, p: Parameters) -> np.ndarray:
    return _sums(emissions, p)[0]


def _lattice(emissions: np.ndarray, p: Parameters):
    """Tag probabilities, transition weights of neighbours and log sums over all tag paths."""
    marginal, forward, ahead, move, total = _sums(emissions, p)
    return marginal, move * np.einsum("tbi,tbj->ij", forward[:-1], ahead), total


def _sums(emissions: np.ndarray, p: Parameters):
    """Tag probabilities, and what the weights of transitions are made of.

    Forward and backward sums are scaled to one at every step, so they need no logarithms.
    """
    steps = len(emissions)
    tops = emissions.max(axis=2, keepdims=True)
    weight, move = np.exp(emissions - tops), np.exp(p["move"])
    forward, backward = np.empty_like(weight), np.ones_like(weight)
    scales = np.empty(weight.shape[:2])
    step = weight[0] * np.exp(p["start"])
    for t in range(steps):
        if t:
            step = (forward[t - 1] @ move) * weight[t]
        scales[t] = step.sum(axis=1)
        forward[t] = step / scales[t][:, None]
    turned = move.T
    for t in reversed(range(steps - 1)):
        backward[t] = ((weight[t + 1] * backward[t + 1]) @ turned) / scales[t + 1][:, None]
    total = np.log(scales).sum(axis=0) + tops[..., 0].sum(axis=0)
    ahead = weight[1:] * backward[1:] / scales[1:][..., None]
    return forward * backward, forward, ahead, move, total


@dataclass
class Tagger:
    """Parameters of the network; ``ids`` below are character classes, (batch, time)."""

    parameters: Parameters

    @staticmethod
    def new(n_classes: int, n_tags: int, size: int, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        p = {"embed": rng.normal(0, 0.5, (n_classes, size))}
        p["wx"] = np.stack([normal(size, 4 * hidden) for _ in range(2)])
        p["wh"] = np.stack([normal(hidden, 4 * hidden) for _ in range(2)])
        p["bias"] = np.zeros((2, 4 * hidden))
        p["bias"][:, hidden : 2 * hidden] = 1.0
        p["out"], p["out_bias"] = normal(2 * hidden, n_tags), np.zeros(n_tags)
        p["move"], p["start"] = np.zeros((n_tags, n_tags)), np.zeros(n_tags)
        return Tagger(p)

    def _emissions(self, ids: np.ndarray):
        p = self.parameters
        plain = p["embed"][ids.T]
        x = np.stack([plain, plain[::-1]], axis=1)
        states, cells, gates = _lstm(x, p["wx"], p["wh"], p["bias"])
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        return both @ p["out"] + p["out_bias"], (x, states, cells, gates, both)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, Parameters]:
        """Mean negative log-likelihood of the tag paths, and its gradients."""
        p, batch = self.parameters, len(ids)
        emissions, (x, states, cells, gates, both) = self._emissions(ids)
        path = tags.T
        steps, hidden = len(path), states.shape[3]
        d_emit, d_move, total = _lattice(emissions, p)
        at = (np.arange(steps)[:, None], np.arange(batch), path)
        gold = p["start"][path[0]] + emissions[at].sum(axis=0)
        gold = gold + p["move"][path[:-1], path[1:]].sum(axis=0)
        d_emit[at] -= 1
        np.add.at(d_move, (path[:-1].ravel(), path[1:].ravel()), -1)
        d = {"move": d_move, "start": d_emit[0].sum(axis=0)}
        d["out"] = both.reshape(steps * batch, -1).T @ d_emit.reshape(steps * batch, -1)
        d["out_bias"] = d_emit.sum(axis=(0, 1))
        d_both = d_emit @ p["out"].T
        d_states = np.stack([d_both[..., :hidden], d_both[::-1, :, hidden:]], axis=1)
        dx, d["wx"], d["wh"], d["bias"] = _lstm_gradients(
            x, p["wx"], p["wh"], states, cells, gates, d_states
        )
        d["embed"] = np.zeros_like(p["embed"])
        np.add.at(d["embed"], ids.T, dx[:, 0] + dx[::-1, 1])
        return float((total - gold).mean()), {k: v / batch for k, v in d.items()}

    def fit(
        self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float, seed: int
    ) -> float:
        """Adam on shuffled batches; the mean loss of the last tenth of the steps."""
        rng, p = np.random.default_rng(seed), self.parameters
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        losses = []
        for step in range(1, steps + 1):
            take = rng.integers(0, len(ids), batch)
            loss, d = self.gradients(ids[take], tags[take])
            losses.append(loss)
            norm = np.sqrt(sum((v**2).sum() for v in d.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-12))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in d.items():
                first[k] = 0.9 * first[k] + 0.1 * scale * v
                second[k] = 0.99 * second[k] + 0.01 * (scale * v) ** 2
                p[k] -= (
                    pace
                    * (first[k] / (1 - 0.9**step))
                    / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                )
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path (batch, time) and the marginal probability of each of its tags.

        Probabilities of a path of zeros alone are not worked out and given as one.
        """
        p = self.parameters
        emissions, _ = self._emissions(ids)
        steps, batch, n_tags = emissions.shape
        score = emissions[0] + p["start"]
        came_from = np.zeros((steps, batch, n_tags), dtype=np.int8)
        # A running best over the tags before: few and short steps, each over the whole batch.
        for t in range(1, steps):
            best, origin = score[:, :1] + p["move"][0], came_from[t]
            for tag in range(1, n_tags):
                option = score[:, tag : tag + 1] + p["move"][tag]
                origin[option > best] = tag
                np.maximum(best, option, out=best)
            score = emissions[t] + best
        path = np.empty((steps, batch), dtype=np.int8)
        path[-1] = score.argmax(axis=1)
        rows = np.arange(batch)
        for t in reversed(range(1, steps)):
            path[t - 1] = came_from[t][rows, path[t]]
        # Where no tag but the first is on the path, nobody asks how sure it is.
        sure = np.ones((steps, batch))
        held = np.flatnonzero(path.any(axis=0))
        if len(held):
            marginal = _marginals(emissions[:, held], p)
            sure[:, held] = marginal[np.arange(steps)[:, None], np.arange(len(held)), path[:, held]]
        return path.T, sure.T
