"""Column functions on text: tokens, character n-grams, set and score functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate words. Dollar, angle brackets, digits and curly
#: single quotes are not among them.
DELIMITERS = r"""[ \t\n\r\f.()\[\]{}^+=|_*&%#"\x27,\-:;/\\?!@~\x{201C}\x{201D}\x{3000}»«]+"""
CONTROL = "".join(map(chr, range(33)))
#: What an n-gram must not hold: brackets, dashes, connectors, other
#: punctuation, ASCII white space and digits. Quotation marks of kind Pi and Pf
#: may stay.
UNWANTED = r"[\p{Pe}\p{Pd}\p{Ps}\p{Pc}\p{Po}\t\n\x0B\f\r 0-9]"
MARK = "$"
SIZES = range(1, 7)
MAX_WORD = 200
#: Cut points by adding 0.1 again and again, as the bins are defined.
CUTS = [0.0]
while CUTS[-1] + 0.1 < 1.0:
    CUTS.append(CUTS[-1] + 0.1)


def trim_control(text: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.btrim(text, F.lit(CONTROL))


def tokenize(text: Column, min_length: int = 1) -> Column:
    """Lower-case words in order, duplicates kept; null gives null."""
    parts = F.transform(F.split(F.lower(text), DELIMITERS), trim_control)
    return F.filter(parts, lambda w: (F.length(w) >= min_length) & (F.length(w) < MAX_WORD) & (w != ""))


def white_tokens(text: Column) -> Column:
    """Words between white space, case and punctuation kept."""
    return F.array_remove(F.split(text, "[ \\t\\n\\r\\f]+"), "")


def _windows(text: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(text) - n + 1
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.when(last >= 1, all_).otherwise(F.array().cast("array<string>"))


def ngrams(word: Column, n: Column | int, markers: bool = True) -> Column:
    """The set of the word's n-grams, with a mark at both ends of the word. What
    an n-gram must not hold becomes a space once for the whole word."""
    text = F.regexp_replace(F.concat(F.lit(MARK), word, F.lit(MARK)) if markers else word, UNWANTED, " ")
    size = F.lit(n) if isinstance(n, int) else n
    keep = lambda g: (F.instr(g, " ") == 0) & ((size > 1) | g.rlike(r"^\p{L}$"))
    return F.array_distinct(F.filter(_windows(text, n), keep))


def cross_word_ngrams(previous: Column, following: Column, n: Column | int) -> Column:
    """N-grams over the seam of two words: a mark strictly inside; none under 3."""
    size = F.lit(n) if isinstance(n, int) else n
    joined = ngrams(F.concat(previous, F.lit(MARK), following), n, markers=False)
    inner = F.filter(joined, lambda g: F.instr(F.substring(g, F.lit(2), size - 2), MARK) > 0)
    return F.when(size >= 3, inner).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two string arrays as sets; two empty ones give null."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def word_weight(word: Column) -> Column:
    """A query word counts one through its length."""
    return F.when(F.length(word) > 1, F.lit(1.0) / F.length(word)).otherwise(F.lit(1.0))


def top_k(n: Column) -> Column:
    """Entries of a profile that count: one more than min(50 n, 150)."""
    return F.least(50 * n, F.lit(150)) + 1


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def dot(weights: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(weights, values, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def entropy(positive: Column, total: Column) -> Column:
    """Binary entropy in bits; 0 for a pure or empty set."""
    p = positive / F.when(total > 0, total)
    return F.when((positive <= 0) | (positive >= total), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def bin_of(score: Column) -> Column:
    """Number of the half-open bin: 0 is below 0, 1 to 10 are tenths, 11 the rest."""
    return sum((F.when(score >= c, 1).otherwise(0) for c in CUTS), F.lit(0))


def length_status(text: Column, least: int = 25, most: int = 100_000) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < least, "too short").when(n > most, "too long").otherwise("ok")


def language_or_default(lang: Column, default: str = "en") -> Column:
    return F.coalesce(lang, F.lit(default))


def draw(seed: str, *keys: Column) -> Column:
    """A number below 2^32 that md5 of the seed and keys decides."""
    text = F.concat_ws("/", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
