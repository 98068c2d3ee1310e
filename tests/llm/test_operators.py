"""Edge cases and brute-force results of the training-data operators."""

import base64
import collections
import dataclasses
import gzip
import hashlib
import random
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from glossa.llm import archive, bpe, decontaminate, lm, neardup, outliers, quality, sharding, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    shared = words(60, 1)
    base = words(120, 2)
    near = [*base[:60], "changed", *base[61:]]
    long_ = words(8000, 3, 5000)
    return [" ".join(x) for x in (base, base, near, [*words(50, 4), *shared, *words(40, 5)], [*words(30, 6), *shared], ["same"] * 90, long_, words(3, 7))] + ["", None, " \n\t", "a<|endoftext|>b É x"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 3 else i % 11, t, None if i == 1 else "en", None if i == 2 else "s", None, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_repeats(spark, docs, texts):
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(docs).collect())
    split = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = []
    for w in split:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    assert got == sorted(want)
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_near_duplicates(spark, docs):
    rows = {(r.row_id): r for r in neardup.classes(docs).collect()}
    assert len(rows) == 12
    sizes = collections.Counter(r.class_row for r in rows.values())
    # base, its copy and the near copy; the three texts "", null (equal) and white space
    assert sorted(sizes.values())[-2:] == [3, 3]
    assert neardup.classes(docs.limit(0)).count() == 0


def test_probability_jaccard():
    import numpy as np

    a, b = (np.array([1, 2, 3], np.uint64), np.array([1, 1, 2])), (np.array([2, 3, 4], np.uint64), np.array([1, 2, 1]))
    assert neardup.probability_jaccard(a, a) == 1
    assert neardup.probability_jaccard(a, b) == pytest.approx(1 / 5 + 1 / (0.5 + 0.5 + 1 + 0.5))


def test_leaks(spark, docs):
    item = " ".join(words(60, 1)[10:50])
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, " ".join(words(20, 99))), (None, item.upper())], "item_id long, text string")
    rows = docs.withColumn("row_id", F.monotonically_increasing_id())
    got = sorted((str(r.doc_id), str(r.item_id), r.start, r.similarity) for r in decontaminate.leaks(rows, items).collect())
    assert got == [("4", "1", 40, 1.0), ("4", "None", 40, 1.0), ("None", "1", 60, 1.0), ("None", "None", 60, 1.0)]
    assert decontaminate.leaks(rows.limit(0), items).count() == 0 and decontaminate.leaks(rows, items.limit(0)).count() == 0


def test_outliers(spark, docs, texts):
    got = {(r.n_words, r.n_repeat_words, r.base_failed) for r in outliers.verdicts(docs).collect()}
    assert (90, 90, True) in got and (0, 0, True) in got and (120, 0, False) in got
    clean = [(i, " ".join(words(100 + i % 40, 1000 + i, 5000)), "en", "s", None, 0.0, "") for i in range(80)]
    bad = (99, " ".join(w + "***" for w in words(100, 5)), "en", "s", None, 0.0, "")
    kept = {r.doc_id: r.kept for r in outliers.verdicts(spark.createDataFrame([*clean, bad], SCHEMA)).collect()}
    assert not kept.pop(99) and all(kept.values())
    assert outliers.verdicts(docs.limit(0)).count() == 0


def test_outliers_of_small_groups(spark):
    clean = [(i, " ".join(words(100 + i % 40, 1000 + i, 5000)), "en", "s", None, 0.0, "") for i in range(80)]
    junk = " ".join(w + "***" for w in words(100, 5))
    asked = [(900, junk, "en", "t", None, 0.0, ""), (901, junk, None, "s", None, 0.0, ""), (902, clean[3][1], "en", "t", None, 0.0, ""), (903, clean[4][1], "fr", None, None, 0.0, "")]
    kept = {r.doc_id: r.kept for r in outliers.verdicts(spark.createDataFrame([*clean, *asked], SCHEMA)).collect()}
    assert not kept.pop(900) and not kept.pop(901) and len(kept) == 82 and all(kept.values())


def test_sharding(spark, docs):
    from glossa.llm.sharding import rendezvous, with_slots

    ids = spark.range(5000).withColumn("s", rendezvous(F.col("id"), [1.0, 2.0, 1.0])["shard"]).withColumn("t", rendezvous(F.col("id"), [1.0, 2.0, 1.0, 1.0])["shard"])
    rows = with_slots(ids, "s", "slot").collect()
    n = collections.Counter(r.s for r in rows)
    assert 1.8 < n[1] / n[0] < 2.2 and all(sorted(r.slot for r in rows if r.s == k) == list(range(n[k])) for k in n)
    assert {r.t for r in rows if r.s != r.t} == {3}
    assert sharding.BLOCK_BITS > 0


def test_language_model(spark, docs, texts):
    held = [zlib.crc32(str("" if i == 3 else i % 11).encode()) % 5 == 1 for i in range(len(texts))]
    training = docs.where(lm.fold("doc_id", 5) != 1)
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score_documents(docs, training).collect())
    count = collections.Counter()
    split = [(t or "").encode().lower().split() + [b" end"] for t in texts]
    for w, h in zip(split, held, strict=True):
        count.update([] if h else w)
    import math

    d = sum(count.values()) + 0.5 * (len(count) + 1)
    assert got == sorted((len(w), sum(x in count for x in w), round(sum(math.log10((count[x] + 0.5) / d) for x in w), 6)) for w in split)
    assert lm.score_documents(docs.limit(0), docs.limit(0)).count() == 0


def test_language_model_words_are_not_their_form(spark):
    r = random.Random(3)
    pairs = [("xoab", "unab"), ("yuab", "deab")]  # one form, and rarer than 70 other words
    rows = []
    for i in range(3000):
        line = []
        for _ in range(2):
            line += [f"w{r.randrange(70)}" for _ in range(75)] + list(pairs[r.randrange(2)])
        rows.append((i, " ".join(line)))
    training = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    asked = spark.createDataFrame([(1, "w1 xoab unab"), (2, "w1 xoab deab"), (3, "w1 yuab deab"), (4, "w1 yuab unab")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in lm.score_documents(asked, training).collect()}
    assert got[1] > got[2] + 0.3 and got[3] > got[4] + 0.3


def test_word_model_is_normalised():
    import numpy as np

    from glossa.llm import nce

    shape = nce.Shape(np.arange(1, 200))
    own = nce.Learner(shape, shape.start(), 0.1, 1)
    own.learn(iter([nce.contexts(np.random.default_rng(0).integers(1, 199, 5000), np.array([5000]))]))
    assert nce.contexts(np.array([5, 6, 7]), np.array([1, 0, 2])).tolist() == [[0, 0, 5], [0, 5, 0], [0, 0, 0], [0, 0, 6], [0, 6, 7], [6, 7, 0]]
    rows = np.array([(3, 7, w) for w in range(199)])
    assert (10 ** nce.Scorer(shape, own.m).log_probabilities(rows)).sum() == pytest.approx(1, abs=1e-3)
    assert nce.summed(np.array([2, 1, 2]), np.eye(3))[2].tolist() == [1, 2]


def test_bpe(spark, docs, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs).collect()) == sorted(want)
    own = bpe.WordBpe(bpe.default_vocabulary())
    ids = [own.inner[b] for b in b"internationalisation" * 9]
    assert own.merge_short(list(ids)) == own.merge_long(list(ids))


def test_archives(spark, tmp_path):
    rows = [(1, "http://a b", b"x"), (2, "u", b"x"), (None, None, b"x"), (3, "v", None), (4, "w", b""), (5, "y", b"only"), (5, "y", b"only")]
    pages = spark.createDataFrame(rows, "key long, url string, payload binary")
    archive.write_arc(pages, str(tmp_path / "a"))
    archive.convert(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    got = archive.read_archives(spark, str(tmp_path / "w")).collect()
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert sorted((str(r.key), r.record_type, str(r.refers_to), r.payload_digest) for r in got) == sorted(
        [("1", "revisit", "2", digest(b"x")), ("2", "response", "None", digest(b"x")), ("None", "revisit", "2", digest(b"x")), ("3", "revisit", "4", digest(b"")),
         ("4", "response", "None", digest(b"")), ("5", "response", "None", digest(b"only")), ("5", "revisit", "5", digest(b"only"))]
    )
    archive.write_arc(pages.limit(0), str(tmp_path / "e"))
    archive.convert(spark, str(tmp_path / "e"), str(tmp_path / "f"))
    assert archive.read_archives(spark, str(tmp_path / "f")).count() == 0


def test_archive_members():
    rng = random.Random(1)
    sizes = [0, 1, *(4096 * k + d for k in (1, 3, 7) for d in (-30, -18, -1, 0, 1, 18)), 300_000, 0, 5]
    parts = [rng.randbytes(n) for n in sizes]
    zipped = [gzip.compress(x, mtime=0) for x in parts]
    assert list(archive.members(b"".join(zipped))) == [x for x in parts if x]
    assert list(archive.members(b"")) == [] == list(archive.members(archive.NOTHING))
    for cut in (1, 9, len(zipped[3]) // 2, len(zipped[3]) - 1):
        with pytest.raises(ValueError):
            list(archive.members(zipped[1] + zipped[3][:cut]))
    # a member costs its own length, not that of the rest of its file
    many = b"".join(gzip.compress(rng.randbytes(2_000), 1, mtime=0) for _ in range(1_000))
    tracemalloc.start()
    try:
        assert sum(len(x) for x in archive.members(many)) == 2_000_000
        assert tracemalloc.get_traced_memory()[1] < len(many) // 10
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    r = [archive.ArcRecord(version, b"http://x/a b", b"1.2.3.4", b"20010203040506", b"text/html", b"body\n\n"), archive.ArcRecord(version, b"u", b"-", b"1", b"-", b"")]
    back = list(archive.parse_arc(archive.arc_file(version, r)))
    assert [dataclasses.replace(x, offset=0) for x in back[1:]] == r and back[0].url.startswith(b"filedesc:")
    head, body = archive.parse_warc(archive.to_warc(back[1], "x.arc"))
    assert head["warc-date"] == "2001-02-03T04:05:06Z" and body == b"body\n\n" and head["warc-target-uri"] == "http://x/a b" and head["warc-type"] == "resource"
    assert archive.parse_warc(archive.to_warc(back[0], "x.arc"))[0]["warc-type"] == "warcinfo"
    with pytest.raises(ValueError):
        list(archive.parse_arc(archive.arc_file(version, r)[:-14]))


def test_toxicity(spark, docs):
    rows = [(i, " ".join(words(40, i)) + (" vile." if i % 4 == 0 else "")) for i in range(200)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(own, labels)
    got = {r.doc_id: r.score for r in toxicity.score(own, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in got)
    assert toxicity.score(docs, model).count() == 12 and toxicity.filtered(docs, model, 2.0).columns == docs.columns
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).count() == 12


def test_shapes_of_long_words_are_whole():
    head = b"#-" * 16
    assert quality.shape_of(head + b"a") != quality.shape_of(head + b"0")


def test_quality(spark, docs):
    rows = [(i, " ".join(w.upper() + "!!" if i % 4 == 0 else w for w in words(40, i))) for i in range(200)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(own, labels)
    got = {r.doc_id: r.score for r in quality.score(own, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 != 0) for i in got)
    assert quality.score(docs, model).count() == 12
    assert quality.score(docs, quality.train(docs, labels.limit(0))).count() == 12
