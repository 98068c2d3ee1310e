"""Phrases of one language in multilingual texts, ten ways.

A text's tokens (split at white space, case and punctuation kept) are folded
from left to right; a fold needs only its own text, the profiles, and whether
each pair of neighbouring tokens is among the known bigrams. That comes by a join
of `bigrams`, as that table grows with the corpus; the fold itself is row-local, and
the languages of all windows and phrases of some texts are found at once (`spans`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import white_tokens
from glossa.operators import lexicon as lex
from glossa.operators.bigrams import Known, answered, pairs_of, with_known
from glossa.operators.scorer import white_tokens as split_white
from glossa.operators.spans import LOAD_CHARS, Spans
from glossa.session import ship_code, spread

MODES = ("one_word", "two_word", "three_word", "base_bigram", "window_2", "window_3", "window_4", "window_5", "window_6", "nested")
#: Where a window is cut first, counted from its end.
PREFERENCE = {2: [0], 3: [1, 0], 4: [1, 2, 0], 5: [2, 1, 3, 0], 6: [2, 3, 1, 4, 0]}
WIDTHS = {"one_word": 1, "two_word": 2, "three_word": 3}
#: Distinct bigrams that a task adds up before it hands them on.
MAX_BIGRAMS = 300_000
Tags = list[tuple[str, str | None]]
Detect = Callable[[int, int], str | None]


def by_word(tokens: Sequence[str], lang: Detect) -> Tags:
    """Break where two neighbours have different known languages; a phrase has
    the language of its last word."""
    out: Tags = []
    begin, before = 0, None
    for i in range(len(tokens)):
        own = lang(i, i + 1)
        if before is not None and own is not None and own != before:
            out.append((" ".join(tokens[begin:i]), before))
            begin = i
        before = own
    if tokens:
        out.append((" ".join(tokens[begin:]), before))
    return out


def by_words(tokens: Sequence[str], lang: Detect, width: int) -> Tags:
    """Break where neighbouring windows differ; the last width - 1 tokens are
    in no phrase."""
    out: Tags = []
    begin, before, last = 0, None, len(tokens) - width + 1
    for i in range(last):
        own = lang(i, i + width)
        if before is not None and own is not None and own != before:
            out.append((" ".join(tokens[begin : i + 1]), before))
            begin = i + 1
        before = own
    if begin < last:
        out.append((" ".join(tokens[begin:last]), before))
    return out


def merged(tokens: Sequence[str], cuts: list[int], lang: Detect) -> Tags:
    """Detect each phrase between the cuts and join equal neighbours."""
    out: Tags = []
    begin, before = 0, None
    for a, b in zip([0, *cuts], [*cuts, len(tokens)], strict=True):
        if a < b:
            own = lang(a, b) or "en"
            if before is not None and own != before:
                out.append((" ".join(tokens[begin:a]), before))
                begin = a
            before = own
    if before is not None:
        out.append((" ".join(tokens[begin:]), before))
    return out


def bigram_cuts(counts: Sequence[int]) -> list[int]:
    return [i + 1 for i, c in enumerate(counts) if not c]


def by_bigram(tokens: Sequence[str], counts: Sequence[int], lang: Detect) -> Tags:
    """Break at unknown bigrams. A text without any is one phrase."""
    return merged(tokens, bigram_cuts(counts[: max(0, len(tokens) - 1)]), lang)


def by_window(tokens: Sequence[str], counts: Sequence[int], lang: Detect, width: int, nested: bool = False) -> Tags:
    return merged(tokens, window_cuts(tokens, counts, lang, width, nested), lang)


def window_cuts(tokens: Sequence[str], counts: Sequence[int], lang: Detect, width: int, nested: bool = False) -> list[int]:
    """Slide a window; where its language changes, cut it at its rarest bigram
    if one of them is unknown, or (nested) where windows of three cut it."""
    cuts: list[int] = []
    p, before = 0, None
    while p + width <= len(tokens):
        own = lang(p, p + width) or "en"
        cut = None
        if before is not None and own != before:
            if nested:
                inner = by_window(tokens[p : p + width], counts[p : p + width - 1], lambda a, b, p=p: lang(p + a, p + b), 3)
                if len(inner) > 1:
                    word = inner[0][0].split(" ")[-1]
                    cut = p + list(tokens[p : p + width]).index(word) + 1
            else:
                at = [p + width - 2 - i for i in PREFERENCE[width]]
                least = min(at, key=lambda i: counts[i])
                if counts[least] == 0:
                    cut = least + 1
        if cut is None:
            before, p = own, p + 1
        else:
            cuts.append(cut)
            before, p = None, cut
    return cuts


def tags(tokens: Sequence[str], counts: Sequence[int], detect: Callable[[str], str | None], mode: str) -> Tags:
    memo: dict[tuple[int, int], str | None] = {}

    def lang(a: int, b: int) -> str | None:
        if (a, b) not in memo:
            memo[a, b] = detect(" ".join(tokens[a:b]))
        return memo[a, b]

    if mode == "one_word":
        return by_word(tokens, lang)
    if mode in ("two_word", "three_word"):
        return by_words(tokens, lang, 2 if mode == "two_word" else 3)
    if mode == "base_bigram":
        return by_bigram(tokens, counts, lang)
    if mode == "nested":
        return by_window(tokens, counts, lang, 5, nested=True)
    return by_window(tokens, counts, lang, int(mode.removeprefix("window_")))


def tags_of_all(own: Spans, known: np.ndarray, mode: str) -> Iterator[Tags]:
    """The phrases of each text that `own` has loaded; `known` tells of each of
    its tokens whether it makes a known bigram with the next one."""
    names = [*own.langs, None]
    texts = list(zip([0, *own.ends[:-1].tolist()], own.ends.tolist(), strict=True))
    counts = known.tolist()
    if mode == "base_bigram":
        called = {}
    elif mode == "nested":
        called = {5: own.windows(5)}
        # what lies inside a window is looked at only where the language differs from that of the window before
        lang = np.array([names[i] or "en" for i in called[5]], object)
        changes = np.flatnonzero(lang[1:] != lang[:-1]) + 1
        inside = np.zeros(len(lang) + 5, bool)
        for i in range(5):
            inside[changes + i] = True
        called |= {w: own.windows(w, inside[: len(lang)]) for w in range(1, 5)}
    else:
        width = WIDTHS.get(mode) or int(mode.removeprefix("window_"))
        called = {width: own.windows(width)}

    def lang_from(start: int) -> Detect:
        if len(called) == 1:
            (only,) = called.values()
            return lambda a, b: names[only[start + a]]
        return lambda a, b: names[called[b - a][start + a]]

    if mode in WIDTHS:
        for a, b in texts:
            tokens, lang = own.tokens[a:b], lang_from(a)
            yield by_word(tokens, lang) if mode == "one_word" else by_words(tokens, lang, WIDTHS[mode])
        return
    cuts: list[list[int]] = []
    for a, b in texts:
        if mode == "base_bigram":
            cuts.append(bigram_cuts(counts[a : max(a, b - 1)]))
        else:
            width = 5 if mode == "nested" else int(mode.removeprefix("window_"))
            cuts.append(window_cuts(own.tokens[a:b], counts[a:b], lang_from(a), width, mode == "nested"))
    begin = [a + c for (a, b), own_cuts in zip(texts, cuts, strict=True) if a < b for c in (0, *own_cuts) if a + c < b]
    of_part = dict(zip(begin, own.parts(np.array(begin, np.int64)), strict=True))
    for (a, b), own_cuts in zip(texts, cuts, strict=True):
        yield merged(own.tokens[a:b], own_cuts, lambda x, y, a=a: names[of_part[a + x]])


def bigram_counts(lines: DataFrame) -> DataFrame:
    """(bigram, cnt) of neighbouring words of a text column's lines; never over
    a line's end, all languages together. Added up within a task first."""
    ship_code(lines.sparkSession)

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["bigram", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                w = split_white(t or "")
                counts.update(map(" ".join, zip(w, w[1:], strict=False)))
            if len(counts) > MAX_BIGRAMS:
                yield from rows(counts)
                counts = Counter()
        yield from rows(counts)

    return lines.select("text").mapInArrow(run, "bigram string, cnt long").groupBy("bigram").agg(F.sum("cnt").alias("cnt"))


def bigrams_of(units: DataFrame) -> DataFrame:
    """(id, pos, bigram) of each pair of neighbouring tokens of (id, text)."""
    words = units.select("id", white_tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    pairs = words.select("id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    return pairs.select("id", (F.col("i") - 1).alias("pos"), F.concat_ws(" ", F.element_at("w", F.col("i")), F.element_at("w", F.col("i") + 1)).alias("bigram"))


def tag(units: DataFrame, profiles: list, bigrams: DataFrame, mode: str, sampled: bool = False) -> DataFrame:
    """(id, seg, text, lang): the phrases of each (id, text). Null and empty
    texts have none. `sampled`: the bigrams are those of samples."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    ship_code(units.sparkSession)

    def tagged(own: Spans, ids: list, texts: list[str], known: Known | None) -> Iterator[pa.RecordBatch]:
        for a, b in lex.chunks(texts, LOAD_CHARS):
            own.load(texts[a:b])
            flags = np.zeros(len(own.tokens), bool) if known is None else known.flags(own.tokens, own.ends)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, found in zip(ids[a:b], tags_of_all(own, flags, mode), strict=True):
                for k, (text, lang) in enumerate(found):
                    for column, value in zip(out, (i, k, text, lang), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["id", "seg", "text", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spans(profiles)
        for b in batches:
            yield from tagged(own, b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], None)

    def run_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spans(profiles)
        for ids, texts, known in answered(batches):
            yield from tagged(own, ids, texts, known)

    schema = "id long, seg int, text string, lang string"
    rows = units.select(F.col("id").cast("long").alias("id"), "text")
    if mode in WIDTHS:
        return spread(rows).mapInArrow(run, schema)
    return with_known(rows, bigrams, sampled).mapInArrow(run_known, schema)


def unknown(units: DataFrame, bigrams: DataFrame, sampled: bool = False) -> DataFrame:
    """(id, pos, bigram) of (id, text): the pairs of neighbouring tokens that are
    not among `bigrams`."""
    ship_code(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, known in answered(batches):
            for a, b in lex.chunks(texts, LOAD_CHARS):
                split = [split_white(t) for t in texts[a:b]]
                tokens, ends = [t for s in split for t in s], np.cumsum([len(s) for s in split])
                first = np.repeat(np.append(0, ends[:-1]), [len(s) for s in split])
                owner = np.repeat(np.arange(a, b), [len(s) for s in split])
                at = np.flatnonzero(~known.flags(tokens, ends) & pairs_of(ends))
                pairs = [f"{tokens[i]} {tokens[i + 1]}" for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(owner[at])), pa.array(at - first[at], pa.int64()), pa.array(pairs, pa.string())], names=["id", "pos", "bigram"])

    rows = units.select(F.col("id").cast("long").alias("id"), "text")
    return with_known(rows, bigrams, sampled).mapInArrow(run, "id long, pos long, bigram string")


def merge_lines(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Neighbouring lines of one language joined: (key, seg, lang, text)."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.col("lang").eqNullSafe(F.lag("lang").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = lines.withColumn("change", change).withColumn("seg", F.sum("change").over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), " ")
    return runs.groupBy(key, "seg", "lang").agg(text.alias("text"))
