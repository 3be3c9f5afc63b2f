"""Additive quantisation of vectors: full-dimensional residual codebooks, beam-search encoding, table look-up scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Squared distances of unit vectors in single precision are off by no more.
SINGLE = 1e-5


@dataclass(frozen=True)
class Codebooks:
    """``words``: one array (size, dimensions) a level; a vector is approximated by the sum of one word of each level."""

    words: tuple[np.ndarray, ...]

    @property
    def levels(self) -> int:
        return len(self.words)

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate(self.words)

    @property
    def starts(self) -> np.ndarray:
        """Where each level's words begin among all."""
        return np.r_[0, np.cumsum([len(w) for w in self.words])][:-1]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of the centres for each vector, in blocks so that memory stays small."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[at : at + 4096] @ c.T - half, axis=1) for at in range(0, len(x), 4096)])


def _centres(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.r_[0, np.cumsum(n)[:-1]], len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c.astype(np.float32)


def train(sample: np.ndarray, sizes: list[int], rounds: int = 4, seed: int = 7) -> Codebooks:
    """Each level's words are the centres of what the levels before leave over of the sample.

    They are rounded and distinct, so that none differ by what single precision can't tell apart, and vectors of one
    direction get one code.
    """
    rng = np.random.default_rng(seed)
    left, words = sample.astype(np.float32), []
    for size in sizes:
        c = np.unique(np.round(_centres(left, size, rounds, rng), 3), axis=0)
        words.append(c)
        left = left - c[nearest(left, c)]
    return Codebooks(tuple(words))


def smallest(far: np.ndarray, n: int) -> np.ndarray:
    """Where the ``n`` smallest numbers of each row are, smallest first."""
    n = min(n, far.shape[1])
    at = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(at, np.argsort(np.take_along_axis(far, at, 1), axis=1, kind="stable"), 1)


def encode(books: Codebooks, x: np.ndarray, beam: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, levels) of unit vectors, how far what they stand for is from the vector at most, and the ``near`` nearest words of the first level.

    At each level every kept prefix is tried with every word and the ``beam`` nearest sums go on. Distances
    come from the products of the vectors with all words and of all words with each other.
    """
    m, flat, starts = books.levels, books.flat, books.starts
    later = flat[len(books.words[0]) :]
    # products of each word with the words of later levels only: the first level is the large one
    gram = flat @ later.T
    own = (flat * flat).sum(1)
    out = []
    for at in range(0, len(x), 1024):
        dots = x[at : at + 1024] @ flat.T
        n = len(dots)
        codes = np.zeros((n, 1, 0), np.int32)
        far = np.zeros((n, 1), np.float32)
        crossed = None
        for level in range(m):
            k, start = len(books.words[level]), starts[level]
            total = far[:, :, None] + (own[start : start + k] - 2 * dots[:, start : start + k])[:, None, :]
            if level:
                here = start - len(books.words[0])
                total += 2 * crossed[:, :, here : here + k]
            total = total.reshape(n, -1)
            if not level:
                closest = smallest(total, near)
            b = min(beam, total.shape[1])
            best = np.argpartition(total, b - 1, axis=1)[:, :b]
            far = np.take_along_axis(total, best, 1)
            order = np.argsort(far, axis=1, kind="stable")
            best, far = np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)
            parent, word = best // k, best % k
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], axis=2)
            if level + 1 < m:
                mine = gram[word + start]
                crossed = mine if crossed is None else np.take_along_axis(crossed, parent[:, :, None], 1) + mine
        # the distance kept lacks |x|^2, which is 1; single precision may have made it smaller
        error = np.sqrt(np.maximum(far[:, 0] + 1, 0) + SINGLE)
        out.append((codes[:, 0, :].astype(np.uint16), error.astype(np.float32), closest.astype(np.uint16)))
    if not out:
        return np.zeros((0, m), np.uint16), np.zeros(0, np.float32), np.zeros((0, min(near, len(books.words[0]))), np.uint16)
    return tuple(np.concatenate(p) for p in zip(*out))


def scores(books: Codebooks, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(codes, queries): the product of each query with what each code stands for, summed from one table per query."""
    total = None
    for level, words in enumerate(books.words):
        used, place = np.unique(codes[:, level], return_inverse=True)
        table = words[used] @ queries.T
        total = table[place] if total is None else total + table[place]
    return total
