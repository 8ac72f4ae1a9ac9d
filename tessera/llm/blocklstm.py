"""A bidirectional LSTM in numpy that labels the blocks of a page as main text or not.

Inputs of a block: learnt vectors of its tag path's names, learnt vectors of its words (both hashed), and measures of
length, links and punctuation.  Both directions see the whole page, so a block is judged by all the others as well.
"""

from __future__ import annotations

from collections.abc import Iterable
from zlib import crc32

import numpy as np

from tessera.llm.htmlblocks import NAMES, Block

WORDS, NAME_SIZE, WORD_SIZE, MEASURES, HIDDEN = 1_024, 24, 8, 6, 24


def _hash(word: str, size: int) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % size


class _Hashes(dict):
    """A bounded cache of hashes of words."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = _hash(word, self.size)
        return found


NAME_HASHES, WORD_HASHES = _Hashes(NAMES), _Hashes(WORDS)


class Pages:
    """The blocks of some pages as arrays."""

    def __init__(self, pages: Iterable[list[Block]]):
        names, counts, name_block, words, word_block, measures, step, page = [], [], [], [], [], [], [], []
        sizes = []
        for number, blocks in enumerate(pages):
            sizes.append(len(blocks))
            for at, block in enumerate(blocks):
                row = len(step)
                own = block.path if block.counts else [NAME_HASHES[n] for n in block.path]
                names += own
                counts += block.counts or [1] * len(own)
                name_block += [row] * len(own)
                split = block.text.split()
                words += [WORD_HASHES[w] for w in split]
                word_block.append(len(split))
                n = len(block.text)
                marks = sum(block.text.count(c) for c in ".,;:!?")
                measures.append((np.log1p(n) / 5, np.log1p(len(split)) / 4, min(1.0, block.linked / n), min(1.0, 10 * marks / n), at / len(blocks), 1.0 if n and block.text[-1] in ".!?" else 0.0))
                step.append(at)
                page.append(number)
        self.names, self.name_block = np.array(names, dtype=np.int64), np.array(name_block, dtype=np.int64)
        self.counts = np.array(counts, dtype=np.float64)[:, None]
        self.words, self.word_block = np.array(words, dtype=np.int64), np.repeat(np.arange(len(step)), word_block)
        self.word_count = np.maximum(1, np.array(word_block, dtype=np.float64))
        self.measures = np.array(measures, dtype=np.float64).reshape(len(step), MEASURES)
        self.step, self.page = np.array(step, dtype=np.int64), np.array(page, dtype=np.int64)
        self.sizes = np.array(sizes, dtype=np.int64)


def _sum_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number (ascending)."""
    out = np.zeros((n, values.shape[1]))
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BlockLabeller:
    """Weights, forward pass and training."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        size = NAME_SIZE + WORD_SIZE + MEASURES
        scale = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.w = {"names": 0.3 * rng.standard_normal((NAMES, NAME_SIZE)), "words": 0.1 * rng.standard_normal((WORDS, WORD_SIZE)), "out": scale(2 * HIDDEN, 1)[:, 0], "out_b": np.zeros(1)}
        for side in "fb":
            self.w |= {f"x{side}": scale(size, 4 * HIDDEN), f"h{side}": scale(HIDDEN, 4 * HIDDEN), f"b{side}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}

    def _inputs(self, p: Pages) -> np.ndarray:
        n = len(p.step)
        names = _sum_rows(self.w["names"][p.names] * p.counts, p.name_block, n)
        words = _sum_rows(self.w["words"][p.words], p.word_block, n) / p.word_count[:, None]
        return np.concatenate([names, words, p.measures], axis=1)

    def _side(self, x: np.ndarray, p: Pages, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of each block, going forth or back; pages are in order of size, so that those still open come first."""
        order = np.argsort(-p.sizes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        step = p.step if side == "f" else p.sizes[p.page] - 1 - p.step
        row = np.full((int(p.sizes.max(initial=0)), len(order)), -1, dtype=np.int64)
        row[step, place[p.page]] = np.arange(len(step))
        ahead = x @ self.w[f"x{side}"] + self.w[f"b{side}"]
        hidden, w = np.zeros((len(step), HIDDEN)), self.w[f"h{side}"]
        h, c, tape = np.zeros((len(order), HIDDEN)), np.zeros((len(order), HIDDEN)), []
        for t in range(len(row)):
            n = int((row[t] >= 0).sum())
            rows, h0, c0 = row[t, :n], h[:n], c[:n]
            gates = ahead[rows] + h0 @ w
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            c1 = f * c0 + i * g
            squashed = np.tanh(c1)
            h1 = o * squashed
            hidden[rows] = h1
            if keep:
                tape.append((rows, h0, c0, i, f, o, g, squashed))
            h, c = h1, c1
        return hidden, tape

    def probabilities(self, p: Pages) -> np.ndarray:
        """For each block, in order, how likely it is main text."""
        if not len(p.step):
            return np.zeros(0)
        x = self._inputs(p)
        both = np.concatenate([self._side(x, p, side, False)[0] for side in "fb"], axis=1)
        return _sigmoid(both @ self.w["out"] + self.w["out_b"][0])

    def _gradients(self, p: Pages, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x, n = self._inputs(p), len(p.step)
        sides = {side: self._side(x, p, side, True) for side in "fb"}
        both = np.concatenate([sides[side][0] for side in "fb"], axis=1)
        guess = _sigmoid(both @ self.w["out"] + self.w["out_b"][0])
        loss = -np.mean(labels * np.log(guess + 1e-9) + (1 - labels) * np.log(1 - guess + 1e-9))
        error = (guess - labels) / n
        g = {"out": both.T @ error, "out_b": np.array([error.sum()])}
        back = np.outer(error, self.w["out"])
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            dh_all, w = back[:, k * HIDDEN : (k + 1) * HIDDEN], self.w[f"h{side}"]
            da, dw = np.zeros((n, 4 * HIDDEN)), np.zeros_like(w)
            dh, dc = np.zeros((0, HIDDEN)), np.zeros((0, HIDDEN))
            for rows, h0, c0, i, f, o, cand, squashed in reversed(sides[side][1]):
                grown = np.zeros((len(rows), HIDDEN))
                grown[: len(dh)] = dh
                grown_c = np.zeros((len(rows), HIDDEN))
                grown_c[: len(dc)] = dc
                dh1 = grown + dh_all[rows]
                dc1 = grown_c + dh1 * o * (1 - squashed**2)
                gates = np.concatenate([dc1 * cand * i * (1 - i), dc1 * c0 * f * (1 - f), dh1 * squashed * o * (1 - o), dc1 * i * (1 - cand**2)], axis=1)
                da[rows] = gates
                dw += h0.T @ gates
                dh, dc = gates @ w.T, dc1 * f
            g |= {f"x{side}": x.T @ da, f"h{side}": dw, f"b{side}": da.sum(axis=0)}
            dx += da @ self.w[f"x{side}"].T
        g["names"], g["words"] = np.zeros_like(self.w["names"]), np.zeros_like(self.w["words"])
        np.add.at(g["names"], p.names, dx[p.name_block, :NAME_SIZE] * p.counts)
        np.add.at(g["words"], p.words, (dx[:, NAME_SIZE : NAME_SIZE + WORD_SIZE] / p.word_count[:, None])[p.word_block])
        return float(loss), g

    def train(self, pages: list[list[Block]], labels: list[list[int]], epochs: int, batch: int = 16, rate: float = 0.01, seed: int = 2) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        rng, m, v, t, mean = np.random.default_rng(seed), {}, {}, 0, 0.0
        for epoch in range(epochs):
            losses, order = [], rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                loss, g = self._gradients(Pages([pages[i] for i in chosen]), np.concatenate([np.array(labels[i], dtype=np.float64) for i in chosen]))
                losses.append(loss)
                t += 1
                now = rate * (0.5 if epoch >= epochs * 2 // 3 else 1.0)
                size = np.sqrt(sum((x**2).sum() for x in g.values()))
                for key, x in g.items():
                    x = x * min(1.0, 5.0 / (size + 1e-12))
                    m[key] = 0.9 * m.get(key, 0.0) + 0.1 * x
                    v[key] = 0.999 * v.get(key, 0.0) + 0.001 * x**2
                    self.w[key] = self.w[key] - now * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.999**t)) + 1e-8)
            mean = float(np.mean(losses))
        return mean
