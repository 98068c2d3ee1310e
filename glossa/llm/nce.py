"""A log-bilinear model over words, trained on every training token.

score(w | h) = (r(h1) C1 + r(h2) C2) . q(w) + b(w) over the symbols of a
lexicon, learnt by noise-contrastive estimation with unigram noise. Sums over
all symbols are too many to normalise by, so symbols of like frequency form a
class with vectors of its own, learnt the same way, and
P(w | h) = P(class | h) * exp(score(w | h)) / sum of it over the class.

Training is one pass over all texts in `ROUNDS` parts. In a part each task
starts from the broadcast parameters, takes a step for every `BATCH` of its
tokens, and returns by how much each row moved and how many updates moved it;
the mean of the moves, weighted by these, is added. All parameters are rows of
one matrix: the symbols, the classes and C1 over C2; columns are r, q with b,
and the two running sums of squared gradients.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

DIM, BATCH, NOISE, CLASS_NOISE = 24, 1024, 64, 32
ROUNDS = 3
RATES = (0.15, 0.1, 0.05)
BUFFER = 100_000
#: Steps whose equal ids are found at once: their keys stay in the processor's cache.
STEPS = 8
BLOCK = 1024
R, Q = slice(0, DIM), slice(DIM, 2 * DIM + 1)
WIDTH = 2 * DIM + 3
#: Rows that are normalised at once: their scores stay in the processor's cache.
CHUNK = 1_000
#: Sums of exponentials below this are taken again: their terms may have vanished.
SMALL = 1e-28
#: Rows among which equal contexts are found.
BLOCK_ROWS = 1 << 19


class Shape:
    """Unigram and classes of the symbols, numbered from the commonest class on."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = len(counts)
        weight = np.asarray(counts, float) + 0.5
        self.p = weight / weight.sum()
        order = np.argsort(-self.p, kind="stable")
        upto = np.cumsum(np.sqrt(self.p[order]))
        k = max(1, min(512, int(np.sqrt(self.n))))
        bins = np.minimum((upto - upto[0]) * k / upto[-1], k - 1).astype(int)
        self.cls = np.empty(self.n, np.int32)
        self.cls[order] = np.unique(bins, return_inverse=True)[1]
        self.k = int(self.cls.max()) + 1
        self.class_p = np.bincount(self.cls, self.p, self.k)
        self.members = [order[a:b] for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate([[0], np.cumsum(np.bincount(self.cls, minlength=self.k))])), strict=True)]

    def start(self, seed: int = 11) -> np.ndarray:
        rng = np.random.default_rng(seed)
        m = np.zeros((self.n + self.k + 2 * DIM, WIDTH), np.float32)
        m[: self.n, R] = rng.normal(0, 0.1, (self.n, DIM))
        m[: self.n + self.k, DIM : 2 * DIM] = rng.normal(0, 0.1, (self.n + self.k, DIM))
        m[: self.n, 2 * DIM], m[self.n : self.n + self.k, 2 * DIM] = np.log(self.p), np.log(self.class_p)
        m[-2 * DIM : -DIM, R], m[-DIM:, R] = np.eye(DIM), np.eye(DIM) * 0.5
        return m


def contexts(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (two before, one before, token) of the tokens of texts of so many
    words, each with its end, symbol 0; what is before a text is its end too."""
    n = len(symbols) + len(sizes)
    s = np.zeros(n + 2, np.int32)
    s[2 + np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols
    rows = np.stack([s[:-2], s[1:-1], s[2:]], 1)
    rows[np.cumsum(sizes + 1)[:-1], 0] = 0  # at a text's first token the word of the text before
    return rows


class Groups(NamedTuple):
    """Which of a step's rows have equal ids: the ids, how many rows each has, its
    first row; which ids have more, those rows, and where each id's begin."""

    ids: np.ndarray
    n: np.ndarray
    first: np.ndarray
    several: np.ndarray
    more: np.ndarray
    begin: np.ndarray

    def sums(self, rows: np.ndarray) -> np.ndarray:
        out = rows.take(self.first, 0)
        if len(self.several):
            more = rows.take(self.more, 0)
            if more.dtype == np.float32 and not more.shape[1] % 2:  # added by twos, which takes half the time
                out.view(np.complex64)[self.several] += np.add.reduceat(more.view(np.complex64), self.begin)
            else:
                out[self.several] += np.add.reduceat(more, self.begin)
        return out


def groups(of_steps: list[np.ndarray]) -> list[Groups]:
    """Those of the ids of some steps, by one sort of (step, id, place)."""
    sizes, ids = np.array([len(x) for x in of_steps]), np.concatenate(of_steps)
    ends = np.cumsum(sizes)
    place_bits, id_bits = int(sizes.max()).bit_length(), int(ids.max()).bit_length()
    step = np.repeat(np.arange(len(sizes)) << (id_bits + place_bits), sizes)
    key = np.sort(step + (ids.astype(np.int64) << place_bits) + np.arange(len(ids)) - np.repeat(ends - sizes, sizes))
    place, key = key & ((1 << place_bits) - 1), key >> place_bits
    again = np.concatenate([[False], key[1:] == key[:-1]])
    first, more = np.flatnonzero(~again), place[again]
    n = np.diff(np.append(first, len(key)))
    several = np.flatnonzero(n > 1)
    own, begin, at = key[first] & ((1 << id_bits) - 1), first[several] - several, place[first]
    out, x, y, z = [], 0, 0, 0
    for end, u, v in zip(ends.tolist(), (upto := np.searchsorted(first, ends)).tolist(), np.searchsorted(several, upto).tolist(), strict=True):
        w = end - u
        out.append(Groups(own[x:u], n[x:u], at[x:u], several[y:v] - x, more[z:w], begin[y:v] - z))
        x, y, z = u, v, w
    return out


def summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the rows of equal ids, and how many they are."""
    (own,) = groups([ids])
    return own.ids, own.sums(rows), own.n


class Learner:
    """Parameters that move with each batch, and how often each row was moved.
    They are kept apart as r, q and the running sums: whole rows are quick to
    take out and put back. What a step needs is made once, for a whole batch."""

    def __init__(self, shape: Shape, start: np.ndarray, rate: float, seed: int) -> None:
        self.shape, self.rate, self.rng = shape, rate, np.random.default_rng(seed)
        self.parts = [np.ascontiguousarray(start[:, R]), np.ascontiguousarray(start[:, Q])]
        self.sums = [start[:, 2 * DIM + 1 + side].copy() for side in (0, 1)]
        self.moved = np.zeros((2, len(start)), np.float32).T
        self.upto, self.class_upto = np.cumsum(shape.p), np.cumsum(shape.class_p)
        self.log_noise = np.log(np.concatenate([shape.p * NOISE, shape.class_p * CLASS_NOISE])).astype(np.float32)
        self.class_row = shape.cls + np.int32(shape.n)
        noise = NOISE + CLASS_NOISE
        self.space = [np.zeros(s, np.float32) for s in ((2 * BATCH, DIM), (BATCH, DIM + 1), (2 * BATCH, DIM + 1), (BATCH, noise), (2 * BATCH + noise, DIM + 2), (BATCH, DIM), (BATCH, DIM), (BATCH, 2 * DIM))]

    @property
    def m(self) -> np.ndarray:
        return np.concatenate([*self.parts, *(x[:, None] for x in self.sums)], 1)

    def move(self, u: np.ndarray, g: np.ndarray, side: int) -> None:
        """Take the gradients `g` of the rows `u`, each named once, off them; overwrites `g`."""
        acc = self.sums[side][u]
        acc += np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.sums[side][u] = acc
        g *= (self.rate / np.sqrt(acc + 1e-8))[:, None]
        np.subtract(self.parts[side].take(u, 0), g, out=g)
        self.parts[side][u] = g

    def step(self, before: np.ndarray, ids: np.ndarray, of_before: Groups, of_ids: Groups) -> None:
        """One step for the tokens after the pairs `before` and their classes: `ids`
        are their rows, then those of the noise that they share. With
        t = tanh(x / 2), the sigmoid of x is (1 + t) / 2."""
        n = len(before) // 2
        r, q = self.parts
        ctx, h, aim, t, gq, gh, part, gr = self.space if n == BATCH else (x[: len(x) - (BATCH - n) * k] for x, k in zip(self.space, (2, 1, 2, 1, 2, 1, 1, 1), strict=True))
        c, gq_rows, gq = r[-2 * DIM :].copy(), gq, gq[:, : DIM + 1]
        ctx = r.take(before, 0, out=ctx, mode="clip").reshape(n, 2 * DIM)
        np.matmul(ctx, c, out=h[:, :DIM])
        h[:, DIM] = 1
        log_noise = self.log_noise[ids]
        q.take(ids[: 2 * n], 0, out=aim, mode="clip")
        half = 0.5 * q.take(ids[2 * n :], 0)
        half[:, DIM] -= 0.5 * log_noise[2 * n :]
        np.tanh(np.matmul(h, half.T, out=t), out=t)
        t += 1
        np.matmul(t, half[:, :DIM], out=gh)
        for x in (slice(0, n), slice(n, 2 * n)):
            gt = np.einsum("ij,ij->i", h, aim[x])
            gt -= log_noise[x]
            gt = (0.5 * np.tanh(0.5 * gt) - 0.5)[:, None]
            np.multiply(gt, h, out=gq[x])
            gh += np.multiply(gt, aim[x, :DIM], out=part)
        np.matmul(t.T, h, out=gq[2 * n :])
        gq[2 * n :] *= 0.5
        self.move(of_ids.ids, of_ids.sums(gq_rows)[:, : DIM + 1], 1)
        self.move(of_before.ids, of_before.sums(np.matmul(gh, c.T, out=gr).reshape(2 * n, DIM)), 0)
        self.move(np.arange(len(r) - 2 * DIM, len(r)), ctx.T @ gh, 0)

    def learn(self, texts: Iterator[np.ndarray]) -> None:
        held, n = [], 0
        for t in texts:
            held.append(t)
            n += len(t)
            if n >= BUFFER:
                self.run(held)
                held, n = [], 0
        if held:
            self.run(held)

    def run(self, held: list[np.ndarray]) -> None:
        rows = np.concatenate(held)
        rows = rows[self.rng.permutation(len(rows))]
        before, w = rows[:, 1::-1].ravel(), rows[:, 2]
        steps, m = -(-len(rows) // BATCH), len(self.moved)
        drawn = self.rng.random((steps, NOISE + CLASS_NOISE))
        noise = np.empty(drawn.shape, np.int32)
        for x, upto, offset in ((slice(0, NOISE), self.upto, 0), (slice(NOISE, None), self.class_upto, self.shape.n)):
            noise[:, x] = np.searchsorted(upto, drawn[:, x] * upto[-1], side="right").clip(0, len(upto) - 1) + offset
        classes = self.class_row[w]
        for k in range(0, steps, STEPS):
            parts = [slice(i, i + BATCH) for i in range(k * BATCH, min(k + STEPS, steps) * BATCH, BATCH)]
            pairs = [before[2 * x.start : 2 * x.stop] for x in parts]
            ids = [np.concatenate([w[x], classes[x], noise[k + i]]) for i, x in enumerate(parts)]
            for args in zip(pairs, ids, groups(pairs), groups(ids), strict=True):
                self.step(*args)
        self.moved[:, 0] += np.bincount(before, minlength=m)
        for i in (w, classes, noise.ravel()):
            self.moved[:, 1] += np.bincount(i, minlength=m)
        self.moved[-2 * DIM :, 0] += steps


def pack(move: np.ndarray, moved: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, payload) of the rows that moved: their numbers, weights and moves."""
    for k in range(0, len(move), BLOCK):
        at = np.flatnonzero(moved[k : k + BLOCK].any(1))
        if len(at):
            w = moved[k : k + BLOCK][at]
            body = move[k : k + BLOCK][at]
            payload = at.astype(np.uint16).tobytes() + w.tobytes() + body[:, 2 * DIM + 1 :].astype(np.float32).tobytes() + body[:, : 2 * DIM + 1].astype(np.float16).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([payload], pa.binary())], names=["block", "payload"])


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(payload) // (2 + 8 + 8 + 2 * (2 * DIM + 1))
    at, w = np.frombuffer(payload, np.uint16, n), np.frombuffer(payload, np.float32, 2 * n, 2 * n).reshape(n, 2)
    acc = np.frombuffer(payload, np.float32, 2 * n, 10 * n).reshape(n, 2)
    body = np.frombuffer(payload, np.float16, n * (2 * DIM + 1), 18 * n).reshape(n, 2 * DIM + 1)
    return at, w, np.concatenate([body.astype(np.float32), acc], 1)


def side_weights(w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.repeat(w, [DIM, DIM + 1], 1), w], 1)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of the moves of each block that a task got."""
    total: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for k, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            at, w, body = unpack(payload)
            s = total.setdefault(k, [np.zeros((BLOCK, WIDTH), np.float32), np.zeros((BLOCK, 2), np.float32)])
            body *= side_weights(w)
            s[0][at] += body
            s[1][at] += w
    for k, (s, w) in total.items():
        yield from (pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), x.column(1)], names=["block", "payload"]) for x in pack(s / np.maximum(side_weights(w), 1), w.astype(np.float32)))


def add_to(m: np.ndarray, block: int, payload: bytes) -> None:
    at, _, body = unpack(payload)
    m[block * BLOCK + at.astype(int)] += body


class Scorer:
    """Normalised log-probabilities by the parameters `m`. Scores are written
    to the same place each time: fresh memory costs as much as a product."""

    def __init__(self, shape: Shape, m: np.ndarray) -> None:
        self.shape, c = shape, m[-2 * DIM :, R]
        self.after, self.later = m[: shape.n, R] @ c[:DIM], m[: shape.n, R] @ c[DIM:]
        self.q = np.ascontiguousarray(m[: shape.n + shape.k, Q])
        self.outer = np.ascontiguousarray(self.q[shape.n :].T)
        self.inner: dict[int, np.ndarray] = {}
        self.space = np.empty(CHUNK * max(shape.k, *map(len, shape.members)), np.float32)
        self.h = np.empty((BLOCK_ROWS, DIM + 1), np.float32)

    def members(self, of: int) -> np.ndarray:
        if of not in self.inner:
            self.inner[of] = np.ascontiguousarray(self.q[self.shape.members[of]].T)
        return self.inner[of]

    def log_sums(self, h: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Logarithms of the sums of exp(h . v) over the columns v of `vectors`."""
        z = np.matmul(h, vectors, out=self.space[: len(h) * vectors.shape[1]].reshape(len(h), -1))
        with np.errstate(over="ignore"):
            total = np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype)
        off = np.flatnonzero(~((total > SMALL) & (total < np.inf)))
        total[off] = 1
        out = np.log(total)
        if len(off):  # too large or too small for plain exponentials: from the largest on
            z = h[off] @ vectors
            top = z.max(1)
            out[off] = top + np.log(np.exp(z - top[:, None]).sum(1))
        return out

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """log10 P(token | the two before) of each row of `contexts`."""
        return np.concatenate([np.empty(0), *(self.block(rows[i : i + BLOCK_ROWS]) for i in range(0, len(rows), BLOCK_ROWS))]) / np.log(10)

    def block(self, rows: np.ndarray) -> np.ndarray:
        # the sum over the classes is taken once for each pair of words before a token
        pairs, at = np.unique(rows[:, 0].astype(np.int64) * self.shape.n + rows[:, 1], return_inverse=True)
        h, outer = self.h[: len(pairs)], np.empty(len(pairs), np.float32)
        for i in range(0, len(pairs), CHUNK):
            x = slice(i, i + CHUNK)
            b, a = np.divmod(pairs[x], self.shape.n)
            np.add(self.after.take(a, 0), self.later.take(b, 0), out=h[x, :DIM])
            h[x, DIM] = 1
            outer[x] = self.log_sums(h[x], self.outer)
        of_class, out = self.shape.cls[rows[:, 2]], np.empty(len(rows))
        order = np.argsort(of_class)
        for i in range(0, len(rows), CHUNK):
            part = order[i : i + CHUNK]
            own, w, pair = of_class[part], rows[part, 2], at[part]
            own_h = h.take(pair, 0)
            got = np.einsum("ij,ij->i", own_h, self.q.take(own + self.shape.n, 0)).astype(float)
            got -= outer[pair]
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])).tolist()
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if len(self.shape.members[own[x]]) > 1:
                    got[x:y] += np.einsum("ij,ij->i", own_h[x:y], self.q.take(w[x:y], 0)) - self.log_sums(own_h[x:y], self.members(int(own[x])))
            out[part] = got
        return out
