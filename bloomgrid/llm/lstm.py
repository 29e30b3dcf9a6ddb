"""A small bidirectional LSTM with one logistic output per step, in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Steps x sequences x features, and which cells are real."""
    longest = max(map(len, sequences))
    x = np.zeros((longest, len(sequences), sequences[0].shape[1]), np.float32)
    real = np.zeros((longest, len(sequences)), bool)
    for i, own in enumerate(sequences):
        x[: len(own), i] = own
        real[: len(own), i] = True
    return x, real


@dataclass
class Direction:
    """Weights of one direction: input, recurrent and bias, gates in the order i, f, o, new."""

    w: np.ndarray
    u: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, real: np.ndarray):
        steps, count, _ = x.shape
        size = len(self.u)
        h = np.zeros((count, size), np.float32)
        c = np.zeros((count, size), np.float32)
        z = x @ self.w + self.b
        out, kept = np.zeros((steps, count, size), np.float32), []
        for t in range(steps):
            gates = z[t] + h @ self.u
            i, f, o = (sigmoid(gates[:, k * size : (k + 1) * size]) for k in range(3))
            new = np.tanh(gates[:, 3 * size :])
            cell = f * c + i * new
            squashed = np.tanh(cell)
            now = real[t][:, None]
            kept.append((i, f, o, new, c, h, squashed))
            h = np.where(now, o * squashed, h)
            c = np.where(now, cell, c)
            out[t] = h
        return out, kept

    def outputs(self, z: np.ndarray, real: np.ndarray) -> np.ndarray:
        """As forward, from inputs that have met the weights, and without what training keeps."""
        steps, count, _ = z.shape
        size = len(self.u)
        h = np.zeros((count, size), np.float32)
        c = np.zeros((count, size), np.float32)
        out = np.empty((steps, count, size), np.float32)
        for t in range(steps):
            gates = z[t] + h @ self.u
            open_gates = sigmoid(gates[:, : 3 * size])
            cell = open_gates[:, size : 2 * size] * c + open_gates[:, :size] * np.tanh(gates[:, 3 * size :])
            now = real[t][:, None]
            h = np.where(now, open_gates[:, 2 * size :] * np.tanh(cell), h)
            c = np.where(now, cell, c)
            out[t] = h
        return out

    def backward(self, x, real, kept, d_out):
        size = len(self.u)
        d_h = np.zeros_like(d_out[0])
        d_c = np.zeros_like(d_out[0])
        d_z = np.zeros((len(x), x.shape[1], 4 * size), np.float32)
        d_u = np.zeros_like(self.u)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, new, c, h, squashed = kept[t]
            now = real[t][:, None]
            d_h = d_h + d_out[t]
            d_cell = d_c + d_h * o * (1 - squashed**2)
            gates = np.concatenate((
                d_cell * new * i * (1 - i), d_cell * c * f * (1 - f),
                d_h * squashed * o * (1 - o), d_cell * i * (1 - new**2)), axis=1) * now
            d_z[t] = gates
            d_u += h.T @ gates
            d_h = np.where(now, gates @ self.u.T, d_h)
            d_c = np.where(now, d_cell * f, d_c)
        flat = d_z.reshape(-1, 4 * size)
        return x.reshape(-1, x.shape[2]).T @ flat, d_u, flat.sum(axis=0)


@dataclass
class Model:
    ahead: Direction
    back: Direction
    out: np.ndarray
    shift: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b,
                self.out, self.shift]

    def forward(self, x: np.ndarray, real: np.ndarray):
        """Chance of label 1 for every step, with the whole sequence as context."""
        first, kept = self.ahead.forward(x, real)
        second, kept_back = self.back.forward(x[::-1], real[::-1])
        both = np.concatenate((first, second[::-1]), axis=2)
        return sigmoid(both @ self.out + self.shift[0]), both, kept, kept_back

    def gradients(self, x, real, labels):
        chance, both, kept, kept_back = self.forward(x, real)
        d = np.where(real, chance - labels, 0).astype(np.float32) / real.sum()
        d_both = d[:, :, None] * self.out
        size = len(self.ahead.u)
        first = self.ahead.backward(x, real, kept, d_both[:, :, :size])
        second = self.back.backward(x[::-1], real[::-1], kept_back, d_both[::-1][:, :, size:])
        return [*first, *second, np.tensordot(d, both, ((0, 1), (0, 1))), np.array([d.sum()])]


def fresh(features: int, size: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)

    def direction() -> Direction:
        bias = np.zeros(4 * size, np.float32)
        bias[size : 2 * size] = 1
        return Direction(
            (rng.normal(size=(features, 4 * size)) * 0.2).astype(np.float32),
            (rng.normal(size=(size, 4 * size)) / np.sqrt(size)).astype(np.float32), bias)

    return Model(direction(), direction(), (rng.normal(size=2 * size) * 0.3).astype(np.float32),
                 np.zeros(1, np.float32))


def train(sequences, labels, size: int = 12, rounds: int = 12, seed: int = 7) -> Model:
    """Adam over batches of sequences of like length."""
    model = fresh(sequences[0].shape[1], size, seed)
    rng = np.random.default_rng(seed)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    batches = [order[i : i + 32] for i in range(0, len(order), 32)]
    ready = []
    for batch in batches:
        x, real = pad([sequences[i] for i in batch])
        ready.append((x, real, pad([labels[i][:, None] for i in batch])[0][:, :, 0]))
    mean = [np.zeros_like(p) for p in model.parameters()]
    square = [np.zeros_like(p) for p in model.parameters()]
    step = 0
    for _ in range(rounds):
        for at in rng.permutation(len(ready)):
            step += 1
            for p, g, m, s in zip(
                model.parameters(), model.gradients(*ready[at]), mean, square, strict=True
            ):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


#: Steps of a batch, padding included, and steps whose inputs are made at a time.
CELLS, CHUNK = 32_768, 2_048


def predict_rows(model: Model, lengths: list[int], rows: Callable[[int, int, int], np.ndarray],
                 ) -> list[np.ndarray]:
    """Chances per step. rows(i, a, b): the inputs of steps a to b of sequence i.

    Sequences of like length share a batch of at most CELLS steps; a longer one has a batch of its
    own, and none is cut. Of all steps only what the gates take in is held, not the inputs.
    """
    found: list[np.ndarray] = [np.empty(0, np.float32)] * len(lengths)
    order = [i for i in sorted(range(len(lengths)), key=lengths.__getitem__) if lengths[i]]
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and lengths[order[stop]] * (stop + 1 - start) <= CELLS:
            stop += 1
        batch, start = order[start:stop], stop
        longest, width = lengths[batch[-1]], model.ahead.w.shape[1]
        real = np.zeros((longest, len(batch)), bool)
        z = [np.zeros((longest, len(batch), width), np.float32) for _ in range(2)]
        for place, i in enumerate(batch):
            real[: lengths[i], place] = True
            for a in range(0, lengths[i], CHUNK):
                b = min(a + CHUNK, lengths[i])
                x = rows(i, a, b)
                for into, way in zip(z, (model.ahead, model.back), strict=True):
                    into[a:b, place] = x @ way.w + way.b
        size = len(model.ahead.u)
        line = model.ahead.outputs(z[0], real) @ model.out[:size] + model.shift[0]
        line += model.back.outputs(z[1][::-1], real[::-1])[::-1] @ model.out[size:]
        chance = sigmoid(line)
        for place, i in enumerate(batch):
            found[i] = chance[: lengths[i], place]
    return found


def predict(model: Model, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Chances per step of sequences whose inputs are at hand."""
    return predict_rows(model, [len(x) for x in sequences], lambda i, a, b: sequences[i][a:b])
