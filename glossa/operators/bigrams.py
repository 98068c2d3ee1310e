"""Which bigrams of texts are among a table of known ones.

Both sides are too many for one machine, and most pairs of tokens are common. So
texts go in packs, each asks once for its distinct pairs, and these go to
the known ones as digests, sorted in blocks by another digest: a
pack and a block are one row. A pair is known by 64 bits of BLAKE2b of its words
among those of its block, which other 64 bits choose.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.scorer import tokenize, white_tokens
from glossa.session import materialize, ship_code, spread

PACK_CHARS = 1_000_000
#: Distinct digests that a task collects before it hands them on, and words whose digests it keeps.
MAX_DIGESTS, MAX_WORDS = 1_000_000, 300_000
#: Blocks for each shuffle partition.
BLOCKS = 4
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Digests:
    """Digests of pairs of words. With `sampled` a token that is not a word as
    `tokenize` makes it is in no pair."""

    def __init__(self, sampled: bool) -> None:
        self.sampled = sampled
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, 2), np.uint64)
        self.word = np.zeros(1024, bool)

    def numbers(self, words: Sequence[str]) -> np.ndarray:
        """For words of one call of `pairs` only."""
        if len(self.at) > MAX_WORDS:
            self.clear()
        out = list(map(self.at.get, words))
        if None in out:
            for w in dict.fromkeys(w for w, i in zip(words, out, strict=True) if i is None):
                i = self.at[w] = len(self.at)
                if i == len(self.rows):
                    self.rows, self.word = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.word, np.zeros_like(self.word)])
                self.rows[i] = np.frombuffer(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.uint64)
                self.word[i] = not self.sampled or tokenize(w) == [w]
            out = list(map(self.at.get, words))
        return np.array(out, np.int64)

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(digest, block's digest) of numbered words."""
        a, b = self.rows[first], self.rows[second]
        return a[:, 0] * ODD[0] ^ b[:, 0] * ODD[1], (a[:, 1] * ODD[2] ^ b[:, 1] * ODD[3]) >> np.uint64(33)


def pairs_of(ends: np.ndarray) -> np.ndarray:
    """Of each token of texts that end at `ends`, whether one follows in its text."""
    out = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    ends = ends[ends > 0]
    out[ends - 1] = False
    return out


class Known:
    """The digests among a pack's that are known."""

    def __init__(self, found: Sequence[bytes], own: Digests) -> None:
        self.digests = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in found)]))
        self.own = own

    def flags(self, tokens: Sequence[str], ends: np.ndarray) -> np.ndarray:
        """Of each token, whether it makes a known bigram with the next one."""
        out = np.zeros(len(tokens), bool)
        if not len(tokens) or not len(self.digests):
            return out
        n = self.own.numbers(tokens)
        at = np.flatnonzero(pairs_of(ends)[:-1] & self.own.word[n[:-1]] & self.own.word[n[1:]])
        digest, _ = self.own.pairs(n[at], n[at + 1])
        where = np.minimum(np.searchsorted(self.digests, digest), len(self.digests) - 1)
        out[at] = self.digests[where] == digest
        return out


def blocks_of(digest: np.ndarray, other: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """The distinct digests of each block."""
    block = (other % np.uint64(blocks)).astype(np.int64)
    order = np.lexsort((digest, block))
    digest, block = digest[order], block[order]
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (block[1:] != block[:-1])
    digest, block = digest[new], block[new]
    upto = np.searchsorted(block, np.arange(blocks + 1))
    for k in np.unique(block).tolist():
        yield k, digest[upto[k] : upto[k + 1]].tobytes()


def packed(units: DataFrame) -> DataFrame:
    """(pack, ids, texts): the rows of (id, text), some PACK_CHARS characters each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], names=["pack", "ids", "texts"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(t or "") + 1
                if size >= PACK_CHARS:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    return spread(units).mapInArrow(run, "pack string, ids array<long>, texts array<string>")


def with_known(units: DataFrame, bigrams: DataFrame, sampled: bool) -> DataFrame:
    """(ids, texts, found) by packs of (id, text): `found` are the digests of the
    pack's pairs that are among `bigrams` (bigram). `sampled`: these come from
    samples, so no other pairs than those of their kind of words need be asked for."""
    spark = units.sparkSession
    ship_code(spark)
    blocks = BLOCKS * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packs, _ = materialize(packed(units), "packs")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Digests(sampled)
        for b in batches:
            for pack, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                split = [white_tokens(t) for t in texts]
                n = own.numbers([t for s in split for t in s])
                at = np.flatnonzero(pairs_of(np.cumsum([len(s) for s in split]))[:-1] & own.word[n[:-1]] & own.word[n[1:]])
                rows = list(blocks_of(*own.pairs(n[at], n[at + 1]), blocks))
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["pack", "block", "digests"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Digests(sampled=False)
        some: list[tuple[np.ndarray, np.ndarray]] = []

        def handed() -> pa.RecordBatch:
            rows = list(blocks_of(*(np.concatenate(x) for x in zip(*some, strict=True)), blocks)) if some else []
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "digests"])

        for b in batches:
            pairs = [x for x in b.column(0).to_pylist() if x.count(" ") == 1]
            words = " ".join(pairs).split(" ") if pairs else []
            n = own.numbers(words)
            some.append(own.pairs(n[::2], n[1::2]))
            if sum(len(x) for x, _ in some) > MAX_DIGESTS:
                yield handed()
                some = []
        yield handed()

    def met(asked: pa.Table, known: pa.Table) -> pa.Table:
        there = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in known.column("digests").to_pylist())]))
        out = []
        for x in asked.column("digests").to_pylist():
            d = np.frombuffer(x, np.uint64)
            out.append(d[there[np.minimum(np.searchsorted(there, d), len(there) - 1)] == d].tobytes() if len(there) else b"")
        return pa.table([asked.column("pack"), pa.array(out, pa.binary())], names=["pack", "found"])

    asked = packs.select("pack", "texts").mapInArrow(ask, "pack string, block int, digests binary")
    known = bigrams.select("bigram").where("bigram IS NOT NULL").mapInArrow(digests, "block int, digests binary")
    found = asked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(met, "pack string, found binary")
    answers = found.groupBy("pack").agg(F.collect_list("found").alias("found"))
    return packs.join(answers, "pack", "left").select("ids", "texts", "found")


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], Known]]:
    own = Digests(sampled=False)
    for b in batches:
        for ids, texts, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield ids, texts, Known(found or [], own)
