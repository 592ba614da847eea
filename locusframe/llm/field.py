"""A linear-chain conditional random field with two tags: part of an offending span, or not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import BITS, features

PART = 128  # words of a row of the padded arrays; a longer cue takes several rows, between which the messages are carried
SLICE = 1 << 20  # words whose features are held at once


class Field:
    """Weights of the field: per feature (for the offending tag), transitions and first tag."""

    def __init__(self) -> None:
        self.weight = np.zeros(1 << BITS)
        self.step = np.array([[0.0, -3.0], [-3.0, 0.0]])
        self.start = np.array([0.0, -3.0])

    def marginals(self, score: np.ndarray, size: np.ndarray, link: np.ndarray | None = None, gradient: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over padded emission scores [rows, words]: P(word offends), expected steps, P(first tag of a cue).

        link: True for rows that go on where the row before them ends. Both messages are odds (offending to not). Within a row they go word by word,
        for all rows at once; how a whole row turns the odds that enter it into those that leave it is a product of 2x2 matrices, by which they are carried
        from row to row first. So the result is that of the whole cue, however long it is.
        """
        rows, longest = score.shape
        (s00, s01), (s10, s11) = np.exp(self.step)
        odds = np.exp(np.clip(score, -30, 30)).T.copy()
        head = np.exp(self.start[1] - self.start[0])
        link = np.zeros(rows, bool) if link is None else link
        enters, leaves = np.ones(rows), np.ones(rows)  # forward odds before a row, backward odds at its last word
        if link.any():
            enters, leaves = self._carried(odds, size, link, head)
        forward, backward = np.empty((longest, rows)), np.empty((longest, rows))
        x = forward[0] = odds[0] * np.where(link, (s01 + enters * s11) / (s00 + enters * s10), head)
        for t in range(1, longest):
            x = forward[t] = odds[t] * (s01 + x * s11) / (s00 + x * s10)
        x = backward[longest - 1] = leaves
        for t in range(longest - 2, -1, -1):
            z = odds[t + 1] * x
            x = backward[t] = np.where(size > t + 1, (s10 + s11 * z) / (s00 + s01 * z), leaves)
        both = forward * backward
        p = (both / (1 + both)).T
        inside = np.arange(longest)[None, :] < size[:, None]
        steps, first = np.zeros((2, 2)), np.zeros(2)
        if gradient:
            live = inside[:, 1:].T
            pairs = [(forward[:-1], odds[1:] * backward[1:], live)]
            if link.any():
                at = np.flatnonzero(link)
                pairs.append((enters[at], odds[0, at] * backward[0, at], np.ones(len(at), bool)))
            for a, z, use in pairs:
                w = np.array([[np.full_like(a, s00), s01 * z], [a * s10, a * s11 * z]])
                steps += (w / w.sum((0, 1)))[:, :, use].sum(2)
            one = p[~link, 0].sum()
            first = np.array([(~link).sum() - one, one])
        return np.where(inside, p, 0.0), steps, first

    def _carried(self, odds: np.ndarray, size: np.ndarray, link: np.ndarray, head: float) -> tuple[np.ndarray, np.ndarray]:
        """Odds that enter each row forwards, and backward odds at each row's last word."""
        (s00, s01), (s10, s11) = np.exp(self.step)
        longest, rows = odds.shape

        def product(matrices: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            total = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
            for m, use in matrices:
                new = m @ total
                total = np.where(use[:, None, None], new / new.sum((1, 2), keepdims=True), total)
            return total

        def matrix(a: object, b: object, c: object, d: object) -> np.ndarray:
            out = np.empty((rows, 2, 2))
            out[:, 0, 0], out[:, 0, 1], out[:, 1, 0], out[:, 1, 1] = a, b, c, d
            return out

        def step_in(t: int) -> np.ndarray:
            m = matrix(odds[t] * s11, odds[t] * s01, s10, s00)
            return m if t else np.where(link[:, None, None], m, matrix(0.0, odds[0] * head, 0.0, 1.0))  # the first row of a cue takes nothing over

        along = product((step_in(t), size > t) for t in range(longest))
        back = product((matrix(s11 * odds[t], s10, s01 * odds[t], s00), size > t) for t in range(longest - 1, 0, -1))
        enters, leaves = np.ones(rows), np.ones(rows)
        x = 1.0
        for i in range(rows):
            if link[i]:
                enters[i] = x
            else:
                x = 1.0
            a = along[i]
            x = (a[0, 0] * x + a[0, 1]) / (a[1, 0] * x + a[1, 1])
        for i in range(rows - 2, -1, -1):
            if link[i + 1]:
                b = back[i + 1]
                z = odds[0, i + 1] * (b[0, 0] * leaves[i + 1] + b[0, 1]) / (b[1, 0] * leaves[i + 1] + b[1, 1])
                leaves[i] = (s10 + s11 * z) / (s00 + s01 * z)
        return enters, leaves

    @staticmethod
    def blocks(begin: np.ndarray, pick: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(cue, first word, words, link) of rows, about ``most`` rows a block, short cues in the order given; all rows of a long cue lie in one block."""
        size = begin[pick + 1] - begin[pick]
        out = []
        short = pick[size <= PART]
        for i in range(0, len(short), most):
            cue = short[i : i + most]
            out.append((cue, begin[cue], begin[cue + 1] - begin[cue], np.zeros(len(cue), bool)))
        long, held, n = pick[size > PART], [], 0
        for j, c in enumerate(long):
            held.append(c)
            n += -(-int(begin[c + 1] - begin[c]) // PART)
            if n >= most or j == len(long) - 1:
                of = np.array(held)
                many = -(-(begin[of + 1] - begin[of]) // PART)
                cue = np.repeat(of, many)
                nth = np.arange(len(cue)) - np.repeat(np.cumsum(many) - many, many)
                at = begin[cue] + PART * nth
                out.append((cue, at, np.minimum(PART, begin[cue + 1] - at), nth > 0))
                held, n = [], 0
        return out

    @staticmethod
    def padded(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, inside) [rows, longest]."""
        i = np.arange(size.max())
        inside = i[None, :] < size[:, None]
        return np.where(inside, at[:, None] + i[None, :], 0), inside

    def tag(self, emission: np.ndarray, begin: np.ndarray, most: int = 4096) -> np.ndarray:
        """P(word offends) for every word."""
        out = np.zeros(len(emission))
        order = np.argsort(np.diff(begin), kind="stable")
        for _, at, size, link in self.blocks(begin, order, most):
            where, inside = self.padded(at, size)
            p, _, _ = self.marginals(np.where(inside, emission[where], 0.0), size, link)
            out[where[inside]] = p[inside]
        return out

    def emission(self, code: np.ndarray, kind: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Score of the offending tag for every word."""
        weight = self.weight
        parts = [weight[features(code, kind, begin, a, min(a + SLICE, len(code)))].sum(1) for a in range(0, len(code), SLICE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def fit(self, feature: np.ndarray, begin: np.ndarray, pick: np.ndarray, bad: np.ndarray, trust: np.ndarray, past: np.ndarray, rounds: int, seed: list[int], block: int = 1024, decay: float = 5e-4) -> None:
        """Maximise the conditional likelihood of the picked cues by AdaGrad; bad: tag of each cue (all its words), trust: weight of each cue.

        past: summed squared gradients of each feature so far, added to in place.
        """
        rng = np.random.default_rng(seed)
        past_step, past_start = np.full((2, 2), 1.0), np.full(2, 1.0)
        size = np.diff(begin)[pick]
        for _ in range(rounds):
            blocks = self.blocks(begin, pick[np.argsort(size + rng.random(len(size)) * 3, kind="stable")], block)
            for b in rng.permutation(len(blocks)):
                cue, at, length, link = blocks[b]
                where, inside = self.padded(at, length)
                used, tag = feature[where[inside]], bad[cue]
                score = np.zeros(where.shape)
                score[inside] = self.weight[used].sum(1)
                p, steps, first = self.marginals(score, length, link, gradient=True)
                gap = ((tag[:, None] - p) * trust[cue][:, None])[inside]
                gradient = np.bincount(used.ravel(), weights=np.repeat(gap, used.shape[1]), minlength=1 << BITS)
                touched = np.flatnonzero(gradient)
                gradient = gradient[touched] - decay * self.weight[touched]
                past[touched] += gradient**2
                self.weight[touched] += 0.3 * gradient / np.sqrt(past[touched])
                moves = length - 1 + link
                stays, heads = np.array([((1 - tag) * moves).sum(), (tag * moves).sum()]), tag[~link]
                for value, seen, held in ((self.step, np.diag(stays) - steps, past_step), (self.start, np.array([(1 - heads).sum(), heads.sum()]) - first, past_start)):
                    held += seen**2
                    value += 0.1 * seen / np.sqrt(held)
                np.clip(self.step, -6, 6, out=self.step)
                np.clip(self.start, -6, 6, out=self.start)
