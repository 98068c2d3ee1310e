"""Languages of many spans of tokens at once.

A span's products with the profiles are sums over its tokens, and a combined
score holds them in proportion to the largest: the norm of the span matters only
where a similarity is near the threshold LOW. So it is bounded by the tokens' own
norms, from below as if they had no n-gram in common and from above as if they
had all in common. A span whose language these bounds leave open is scored in full.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from glossa.operators import lexicon as lex
from glossa.operators.scorer import CONTROL, LOW, SIZES, Scorer, tokenize, white_tokens

MAX_TOKENS = 100_000
#: Characters of texts that are loaded at once, and tokens that are scored in full at once.
LOAD_CHARS, FULL_TOKENS = 250_000, 50_000
#: Sums in another order differ by less: near the threshold, and between totals of six decimals.
NEAR, MARGIN = 1e-9, 2e-6


class Spans:
    def __init__(self, profiles: list[tuple[str, int, str, float]]) -> None:
        self.lexicon, self.scorer = lex.Lexicon(profiles), Scorer(profiles)
        self.langs = self.lexicon.langs
        self.clear()

    def clear(self) -> None:
        self.lexicon.clear()
        n = len(SIZES)
        self.known: dict[str, int] = {}
        # for each token: products, squared norm and norm if its words had no or all n-grams in common, count of n-grams, characters; where its words begin, their count
        self.sums = lex.Column(np.float64, n * len(self.langs) + 3 * n + 1)
        self.start, self.count, self.odd = lex.Column(np.int64), lex.Column(np.int64), lex.Column(np.bool_)
        self.words = lex.Column(np.int64)

    def learn(self, tokens: list[str]) -> None:
        parts = [tokenize(t) for t in tokens]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = self.lexicon.ids([w for p in parts for w in p])
        owner = np.repeat(np.arange(len(parts)), counts)
        value = 1.0 / self.lexicon.length.rows[ids]
        sizes = self.lexicon.sizes.rows[ids].astype(float)
        rows = np.concatenate([self.lexicon.dots.rows[ids] * value[:, None], sizes * (value * value)[:, None], np.sqrt(sizes) * value[:, None], sizes, np.zeros((len(ids), 1))], 1)
        sums = np.zeros((len(parts), rows.shape[1]))
        if len(ids):
            first = lex.first_of_runs(owner)
            sums[owner[first]] = np.add.reduceat(rows, first)
        sums[:, -1] = [len(t) for t in tokens]
        self.sums.add(sums)
        self.start.add(self.words.n + np.cumsum(counts) - counts)
        self.count.add(counts)
        self.odd.add(np.array([t[0] in CONTROL or t[-1] in CONTROL for t in tokens], bool))
        self.words.add(ids)
        for t in tokens:
            self.known[t] = len(self.known)

    def load(self, texts: Sequence[str]) -> None:
        """From now on spans are positions among the tokens of these texts."""
        if len(self.known) > MAX_TOKENS or len(self.lexicon.vocab) > lex.MAX_WORDS or len(self.lexicon.numbers) > lex.MAX_GRAMS:
            self.clear()
        split = [white_tokens(t) for t in texts]
        self.tokens = [t for s in split for t in s]
        self.ends = np.cumsum([len(s) for s in split])
        get = self.known.get
        at = list(map(get, self.tokens))
        if None in at:
            self.learn(list(dict.fromkeys(t for t, i in zip(self.tokens, at, strict=True) if i is None)))
            at = list(map(get, self.tokens))
        self.at = np.array(at, np.int64)

    def windows(self, width: int, where: np.ndarray | None = None) -> list[int]:
        """The language's number, or -1, of `width` tokens from each position (or
        those `where` it is needed) on where so many are left; -1 at the others too."""
        n = len(self.tokens)
        begin = np.arange(n)
        fits = begin + width <= np.repeat(self.ends, np.diff(self.ends, prepend=0))
        out = np.full(n, -1)
        begin = begin[fits if where is None else fits & where]
        if not len(begin):
            return out.tolist()
        rows = self.sums.rows
        total = rows[self.at[begin]]
        for i in range(1, width):
            total += rows[self.at[begin + i]]
        out[begin] = self.called(total, begin, begin + width)
        return out.tolist()

    def parts(self, begin: np.ndarray) -> list[int]:
        """The same of the parts that `begin` cuts all tokens into."""
        if not len(begin):
            return []
        return self.called(np.add.reduceat(self.sums.rows[self.at], begin), begin, np.append(begin[1:], len(self.tokens))).tolist()

    def called(self, total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        k, n = len(self.langs), len(SIZES)
        if not k:
            return np.full(len(begin), -1)
        dots = total[:, : n * k].reshape(-1, n, k)
        square, upper, count = (total[:, n * k + i * n : n * k + (i + 1) * n] for i in range(3))
        chars = total[:, -1] + (end - begin - 1)
        size = np.array(SIZES)
        # of m frequencies the largest k have k / m of the sum of squares at least
        lower = np.sqrt(square * np.minimum(1.0, lex.TOP[1:] / np.maximum(count, 1.0)))
        valid = ((chars[:, None] >= size) & (count > 0))[:, :, None] & (dots > 0)
        scaled = dots * size[:, None]
        sure = valid & (scaled >= LOW * (1 + NEAR) * upper[:, :, None])
        maybe = valid & ~sure & (scaled > LOW * (1 - NEAR) * lower[:, :, None])
        most = dots.max(2, keepdims=True)
        part = dots / np.where(most > 0, most * n, 1.0)
        least = np.zeros((len(begin), k))
        for i in range(n):
            least += np.where(sure[:, i], part[:, i], 0.0)
        some = sure.any(1)
        out = lex.best(least, some)
        unsure = np.flatnonzero(maybe.any((1, 2)))
        if len(unsure):
            low, high = least[unsure], least[unsure] + np.where(maybe[unsure], part[unsure], 0.0).sum(1)
            first, row = np.where(some[unsure], low, -1.0).argmax(1), np.arange(len(unsure))
            high[row, first] = 0.0
            open_ = ~(some[unsure].any(1) & (low[row, first] > high.max(1) + MARGIN))
            out[unsure] = first
            self.full(out, unsure[open_], begin, end, chars)
        odd = self.odd.rows[self.at]
        if odd.any():
            seen = np.concatenate([[0], np.cumsum(odd)])
            for i in np.flatnonzero(seen[end] > seen[begin]).tolist():
                lang = self.scorer.detect(" ".join(self.tokens[begin[i] : end[i]]))[0]
                out[i] = self.langs.index(lang) if lang is not None else -1
        return out

    def full(self, out: np.ndarray, which: np.ndarray, begin: np.ndarray, end: np.ndarray, chars: np.ndarray) -> None:
        a = 0
        upto = np.cumsum(end[which] - begin[which])
        while a < len(which):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + FULL_TOKENS, "right")))
            own = which[a:b]
            width = end[own] - begin[own]
            token = self.at[lex.ragged(begin[own], width)]
            counts = self.count.rows[token]
            ids = self.words.rows[lex.ragged(self.start.rows[token], counts)]
            segment = np.repeat(np.repeat(np.arange(len(own)), width), counts)
            sims = self.lexicon.similarities(len(own), segment, ids, 1.0 / self.lexicon.length.rows[ids], chars[own])
            out[own] = lex.best(*lex.combined(sims))
            a = b
