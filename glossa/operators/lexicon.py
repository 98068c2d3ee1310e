"""N-grams of many words at once, in numpy.

A worker numbers the words and n-grams that it meets. A word has the numbers of
its n-grams and, for each size and language, the sum of their weights. So a
text's products are sums over its words, and its n-gram frequencies come from one
sort of (text, n-gram) keys. `scorer.Scorer` holds the same sums text by text;
tests hold one against the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np

from glossa.operators.scorer import CONTROL, LOW, SIZES, category, tokenize, unwanted

#: Words and n-grams that are kept; beyond these a lexicon starts anew.
MAX_WORDS, MAX_GRAMS = 150_000, 1_500_000
#: Characters that six of fit into a key of 60 bits.
MAX_CHARS = 1 << 10
CHUNK_CHARS = 600_000
#: Bits of a sort key: segment, size and number of the n-gram, code of the value.
GRAM_BITS, CODE_BITS = 24, 20
TOP = np.array([0] + [min(50 * n, 150) + 1 for n in SIZES])


class Column:
    """Rows that are appended to, in an array that doubles."""

    def __init__(self, dtype: type, *shape: int) -> None:
        self.all, self.n = np.zeros((1024, *shape), dtype), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self.all):
            more = np.zeros((max(need, 2 * len(self.all)), *self.all.shape[1:]), self.all.dtype)
            more[: self.n] = self.all[: self.n]
            self.all = more
        self.all[self.n : need] = rows
        self.n = need

    @property
    def rows(self) -> np.ndarray:
        return self.all[: self.n]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def first_of_runs(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.empty(len(sorted_keys), bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.flatnonzero(new)


class Lexicon:
    def __init__(self, profiles: list[tuple[str, int, str, float]] = (), langs: list[str] | None = None, texts: bool = False) -> None:
        """With `texts` the n-grams themselves are kept too."""
        self.langs = sorted(langs or {p[0] for p in profiles})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.weights: dict[str, list[tuple[int, float]]] = {}
        for lang, _, gram, weight in profiles:
            self.weights.setdefault(gram, []).append((at[lang], weight))
        self.keep = texts
        self.clear()

    def clear(self) -> None:
        width = len(SIZES) * len(self.langs)
        self.vocab: dict[str, int] = {}
        self.numbers: dict[int | str, int] = {}
        self.grams: list[str] = []
        self.chars: dict[int, int] = {}
        self.wide = False
        # for each n-gram its weights; for each word its length, its count of n-grams and sum of weights by size, and where its n-grams begin
        self.gram_weight = Column(np.float64, len(self.langs))
        self.length, self.sizes, self.dots = Column(np.int64), Column(np.int32, len(SIZES)), Column(np.float64, width)
        self.start, self.number = Column(np.int64), Column(np.int32)

    def room(self) -> None:
        """Start anew where the lexicon is full; between two chunks only."""
        if len(self.vocab) > MAX_WORDS or len(self.numbers) > MAX_GRAMS:
            self.clear()

    def ids(self, words: Sequence[str]) -> np.ndarray:
        get = self.vocab.get
        out = list(map(get, words))
        if None in out:
            self.learn(list(dict.fromkeys(w for w, i in zip(words, out, strict=True) if i is None)))
            out = list(map(get, words))
        return np.array(out, np.int64)

    def learn(self, words: list[str]) -> None:
        text = "".join([f"${w}$" for w in words])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        word = np.repeat(np.arange(len(words)), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
        alphabet, char = np.unique(points, return_inverse=True)
        letter = np.array([category(int(c))[0] == "L" for c in alphabet], bool)[char]
        bad = np.concatenate([[0], np.cumsum(np.array([unwanted(chr(c)) for c in alphabet], bool)[char])])
        for c in alphabet.tolist():
            self.chars.setdefault(c, len(self.chars) + 1)
        if len(self.chars) >= MAX_CHARS and not self.wide:
            self.widen()
        code = np.array([self.chars[int(c)] for c in alphabet], np.int64)[char] if not self.wide else None
        at, size, key = [], [], np.zeros(len(points), np.int64)
        keys = []
        for n in SIZES:
            places = max(0, len(points) - n + 1)
            if code is not None:
                key[:places] = key[:places] << 10 | code[n - 1 :]
            p = np.flatnonzero(letter) if n == 1 else np.flatnonzero(left[:places] >= n)
            p = p if n == 1 else p[bad[p + n] == bad[p]]
            at.append(p)
            size.append(np.full(len(p), n))
            keys.append(key[p] if code is not None else np.array([text[i : i + n] for i in p.tolist()], object))
        at, size, keys = np.concatenate(at), np.concatenate(size), np.concatenate(keys)
        number = self.number_of(text, at, size, keys)
        # size in front of the number, so that sorted keys keep the sizes apart
        unique = word[at] << 32 | size << GRAM_BITS | number
        unique.sort()
        unique = unique[first_of_runs(unique)]
        owner, number = unique >> 32, (unique & 0xFFFFFFFF).astype(np.int32)
        cell = owner * len(SIZES) + (number >> GRAM_BITS) - 1
        cells = len(words) * len(SIZES)
        weight = self.gram_weight.rows[number & (1 << GRAM_BITS) - 1]
        dots = np.stack([np.bincount(cell, weight[:, i], cells) for i in range(len(self.langs))], 1) if self.langs else np.zeros((cells, 0))
        counts = np.bincount(owner, minlength=len(words))
        self.start.add(self.number.n + np.cumsum(counts) - counts)
        self.number.add(number)
        self.sizes.add(np.bincount(cell, minlength=cells).reshape(len(words), len(SIZES)))
        self.dots.add(dots.reshape(len(words), -1))
        self.length.add(lengths - 2)
        for w in words:
            self.vocab[w] = len(self.vocab)

    def widen(self) -> None:
        """Keys of so many characters would not fit: n-grams are known by their text."""
        back = {i: chr(c) for c, i in self.chars.items()}

        def text(key: int) -> str:
            out = ""
            while key:
                out, key = back[key & 1023] + out, key >> 10
            return out

        self.wide, self.numbers = True, {text(k): v for k, v in self.numbers.items()}

    def number_of(self, text: str, at: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if self.wide:
            unique, inverse, first = [], np.empty(len(keys), np.int64), []
            seen: dict[str, int] = {}
            for i, k in enumerate(keys.tolist()):
                if k not in seen:
                    seen[k] = len(seen)
                    unique.append(k)
                    first.append(i)
                inverse[i] = seen[k]
        else:
            order = np.argsort(keys)
            ordered = keys[order]
            runs = first_of_runs(ordered)
            inverse = np.empty(len(keys), np.int64)
            inverse[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(keys))))
            unique, first = ordered[runs].tolist(), order[runs].tolist()
        numbers, fresh = self.numbers, []
        out = list(map(numbers.get, unique))
        for j, i in enumerate(out):
            if i is None:
                out[j] = numbers[unique[j]] = len(numbers)
                fresh.append(first[j])
        rows = np.zeros((len(fresh), len(self.langs)))
        if fresh and (self.weights or self.keep):
            grams = [text[p : p + n] for p, n in zip(at[fresh].tolist(), size[fresh].tolist(), strict=True)]
            if self.keep:
                self.grams += grams
            for i, g in enumerate(grams):
                for lang, w in self.weights.get(g, ()):
                    rows[i, lang] = w
        self.gram_weight.add(rows)
        return np.array(out, np.int64)[inverse]

    def frequencies(self, segment: np.ndarray, ids: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words `ids` in rising segments, each worth `value`: (segment * 8 +
        size, number, frequency) of each segment's n-grams, in that order."""
        values, code = np.unique(value, return_inverse=True)
        counts = self.sizes.rows[ids].sum(1)
        number = self.number.rows[ragged(self.start.rows[ids], counts)].astype(np.int64)
        key = np.repeat(segment << (GRAM_BITS + 3 + CODE_BITS) | code, counts)
        key |= number << CODE_BITS
        key.sort()
        gram = key >> CODE_BITS
        first = first_of_runs(gram)
        freq = np.add.reduceat(values[key & (1 << CODE_BITS) - 1], first) if len(first) else np.zeros(0)
        gram = gram[first]
        return gram >> GRAM_BITS, gram & (1 << GRAM_BITS) - 1, freq

    def norms(self, segment: np.ndarray, ids: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment * 8 + size, norm) over the largest frequencies, where there are any."""
        group, _, freq = self.frequencies(segment, ids, value)
        first = first_of_runs(group)
        ends = np.append(first[1:], len(group))
        group = group[first]
        square = np.add.reduceat(freq * freq, first) if len(first) else np.zeros(0)
        top = TOP[group & 7]
        for i in np.flatnonzero(ends - first > top).tolist():
            f = freq[first[i] : ends[i]]
            k = len(f) - top[i]
            f = np.partition(f, k)[k:]
            square[i] = f @ f
        return group, np.sqrt(square)

    def similarities(self, segments: int, segment: np.ndarray, ids: np.ndarray, value: np.ndarray, trimmed: np.ndarray) -> np.ndarray:
        """[segments, sizes, languages]; `trimmed` are the texts' lengths."""
        out = np.zeros((segments, len(SIZES), len(self.langs)))
        if not len(ids):
            return out
        first = first_of_runs(segment)
        dots = np.add.reduceat(self.dots.rows[ids] * value[:, None], first).reshape(len(first), len(SIZES), len(self.langs))
        norm = np.zeros((segments, 8))
        group, found = self.norms(segment, ids, value)
        norm.reshape(-1)[group] = found
        norm = norm[:, 1:7]
        n = np.array(SIZES)
        norm = np.where(trimmed[:, None] >= n, norm, 0.0)
        own = norm[segment[first]]
        out[segment[first]] = np.where(own[:, :, None] > 0, dots / np.where(own > 0, own, 1.0)[:, :, None] * n[:, None], 0.0)
        return out


def combined(sims: np.ndarray, ignore_low: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Linear combination [rows, languages] of similarities, and whether any
    size counts."""
    most = sims.max(2, keepdims=True, initial=0.0)
    part = np.where(sims > 0, sims / np.where(most > 0, most * len(SIZES), 1.0), 0.0)
    counts = (sims != 0) & (sims >= LOW) if ignore_low else np.ones(sims.shape, bool)
    total = np.zeros((sims.shape[0], sims.shape[2]))
    for i in range(len(SIZES)):
        total += np.where(counts[:, i], part[:, i], 0.0)
    return total, counts.any(1)


def best(total: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of the language with the largest total of six decimals, the
    first on ties; -1 where none counts."""
    if not total.shape[1]:
        return np.full(len(total), -1)
    rounded = np.where(counts, np.round(total, 6), -1.0)
    return np.where(counts.any(1), rounded.argmax(1), -1)


def chunks(texts: Sequence[str], chars: int = 0) -> Iterator[tuple[int, int]]:
    """Runs of texts with some CHUNK_CHARS characters, or some `chars`."""
    a, size, most = 0, 0, chars or CHUNK_CHARS
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def words_of(lexicon: Lexicon, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, value) of each text's distinct words; a word counts one
    through its length."""
    words: list[str] = []
    counts: list[int] = []
    sizes = []
    for t in texts:
        own = Counter(tokenize(t))
        words += own.keys()
        counts += own.values()
        sizes.append(len(own))
    lexicon.room()
    ids = lexicon.ids(words)
    return np.repeat(np.arange(len(texts)), sizes), ids, np.array(counts, float) / lexicon.length.rows[ids]


def trimmed_lengths(texts: Sequence[str]) -> np.ndarray:
    return np.array([len(t.strip(CONTROL)) for t in texts], np.int64)
