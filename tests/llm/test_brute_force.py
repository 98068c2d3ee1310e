"""The registered queries against brute force over small tables."""

import base64
import collections
import hashlib
import math
import random
import zlib
from itertools import combinations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from glossa.llm import registry

SPACE = " \t\n\v\f\r"


def words_of(text):
    return (text or "").encode().split()


def lower(text):
    return [w.lower() for w in words_of(text)]


def bag(words, k=5):
    k = min(k, len(words))
    return collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else collections.Counter()


def probability_jaccard(a, b):
    if not a and not b:
        return 1.0
    total = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    return total


def prose(r, n, vocabulary=3000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(r, words, share):
    out = list(words)
    for i in r.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"x{r.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    r = random.Random(5)
    items = [" ".join(prose(r, n)) for n in (8, 14, 30, 59)] + ["", None, "one two three"]
    shared = [prose(r, n) for n in (40, 52, 70)]
    texts = []
    for i in range(60):
        texts.append(" ".join(prose(r, r.choice([30, 80, 200]))))
    base = [prose(r, n) for n in (120, 300, 9, 10, 60)]
    for b in base:
        texts += [" ".join(b)] * 3
        texts += [" ".join(edited(r, b, s)) for s in (0.01, 0.02, 0.03, 0.05) for _ in range(3)]
        texts.append(" ".join(b).upper())
    for s in shared:
        texts += [" ".join([*prose(r, 20), *s, *prose(r, 25)]) for _ in range(3)]
    for k, item in enumerate(items[:4]):
        w = item.split()
        texts += [" ".join([*prose(r, 15), *w, *prose(r, 40)]), " ".join([*prose(r, 9), *edited(r, w, 0.02), *prose(r, 9)]).upper() if k else item]
    texts += ["", None, " \n\t\v\f", "a\nb\n\na\n b\nb", "#$ || <>&%* " * 30, "same " * 90, "é 漢字  x", "line one here\n" * 40, " ".join(prose(r, 6000, 900)), "w1 w2 w3 w4"]
    toxic = []
    for i in range(150):
        t = i % 3 == 0
        w = prose(r, 50)
        if t:
            a, b = r.sample(range(50), 2)
            w[a], w[b] = "vilest", "scumbag!"
        toxic.append(int(t))
        texts.append(" ".join(w))
    n = len(texts)
    ids = [None if i == 70 else 3 if i == 71 else i for i in range(n)]
    langs = [None if i % 17 == 0 else ("en", "fr")[i % 3 == 0] for i in range(n)]
    d = tmp_path_factory.mktemp("tables")
    put = lambda name, cols: pq.write_table(pa.table(cols), str(d / f"{name}.parquet"))
    put("documents", {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "lang": pa.array(langs), "source": pa.array(["hot" if i % 2 else None for i in range(n)]), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "row_id": pa.array(["clash"] * n), "_block": pa.array([1.5] * n)})
    put("benchmark", {"item_id": pa.array([*range(len(items) - 1), None], pa.int64()), "text": pa.array(items)})
    start = n - 150
    put("labels", {"doc_id": pa.array([*range(n), None, start], pa.int64()), "quality": pa.array([i % 2 for i in range(n)] + [1, None], pa.int32()), "toxic": pa.array([0] * start + [*toxic, 1, None], pa.int32())})
    pages = [(i, f"http://h/{i} x", ["<p>a</p>", "b", "", None, "c" * 5000, "é"][i % 6]) for i in range(40)] + [(None, None, "b"), (7, "again", "b"), (7, "again", "b"), (99, "u", "only\r\n\r\nonce")]
    put("pages", {"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages]), "html": pa.array([p[2] for p in pages])})
    return {"dir": str(d), "ids": ids, "texts": texts, "items": items, "pages": pages, "langs": langs, "toxic": dict(zip(range(start, n), toxic, strict=True))}


def run(spark, tables, n):
    (name,) = [q for q in registry.queries() if q.startswith(f"op{n}_")]
    return [r.asDict() for r in registry.queries()[name](spark, tables["dir"]).collect()]


def test_op4_finds_every_item(spark, tables):
    want = []
    items = [(i if i < len(tables["items"]) - 1 else None, lower(t)) for i, t in enumerate(tables["items"])]
    for doc_id, text in zip(tables["ids"], tables["texts"], strict=True):
        w = lower(text)
        for item, x in items:
            own, best = bag(x), 0.0
            for s in range(len(w) - len(x) + 1) if x else ():
                b = bag(w[s : s + len(x)])
                best = max(best, sum((own & b).values()) / sum((own | b).values()))
            if best >= 0.8 - 1e-12:
                want.append((str(doc_id), str(item), round(best, 9)))
    got = sorted((str(x["doc_id"]), str(x["item_id"]), round(x["similarity"], 9)) for x in run(spark, tables, 4))
    assert got == sorted(want) and len(want) >= 6


def test_op4_index_selects():
    from glossa.llm.decontaminate import BLOCK_RADIUS, BLOCKS, RADIUS, near_values

    assert sum(BLOCKS) == 64 and RADIUS // len(BLOCKS) == BLOCK_RADIUS  # so some block is within its radius
    assert sum(len(near_values(n)) / (1 << n) for n in BLOCKS) < 0.35


def test_op7_classes(spark, tables):
    got = run(spark, tables, 7)
    bags = [bag(lower(t)) for t in tables["texts"]]
    near = {(i, j): probability_jaccard(a, b) for (i, a), (j, b) in combinations(enumerate(bags), 2) if not a and not b or a.keys() & b.keys()}
    linked = [p for p, s in near.items() if s >= 0.8 + 1e-9]
    assert len(got) == len(bags) and len(linked) > 100
    top = list(range(len(bags)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        top[b] = a
    members = collections.defaultdict(list)
    for i in range(len(bags)):
        members[find(i)].append(i)
    rank = lambda i: (tables["ids"][i] is None, tables["ids"][i] or 0)
    want = collections.Counter((str(tables["ids"][i]), str(tables["ids"][min(m, key=rank)]), len(m)) for m in members.values() for i in m)
    have = collections.Counter((str(x["doc_id"]), str(x["class_id"]), x["class_size"]) for x in got)
    assert have == want
    assert sum(x["kept"] for x in got) == len(members)


def test_op1_counts_and_base(spark, tables):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i in tables["ids"]]
    split = [[*lower(t), b" end"] for t in tables["texts"]]
    count = collections.Counter(w for ws, h in zip(split, held, strict=True) if not h for w in ws)
    total, d = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    want = sorted((str(i), h, len(ws), sum(w in count for w in ws), total, round(sum(math.log10((count[w] + 0.5) / d) for w in ws), 6)) for i, h, ws in zip(tables["ids"], held, split, strict=True))
    got = run(spark, tables, 1)
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    assert all(x["score"] < 0 and math.isfinite(x["score"]) for x in got)


def test_op2_statistics(spark, tables):
    got = collections.Counter()
    for x in run(spark, tables, 2):
        got[str(x["doc_id"]), x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]] += 1
        assert not (x["base_failed"] and x["kept"])
    want = collections.Counter()
    for i, t in zip(tables["ids"], tables["texts"], strict=True):
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        lines, dup, seen = t.split("\n"), 0, set()
        for line in lines:
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        rep = len({j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)})
        failed = len(w) < 20 or 100 * rep > 30 * len(w)
        want[str(i), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, rep, failed] += 1
    assert got == want


def test_op3_shards(spark, tables):
    got = run(spark, tables, 3)

    def score(key, shard):
        u = (int(hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return -1.0 / math.log(u)

    want = collections.Counter()
    for i, t in zip(tables["ids"], tables["texts"], strict=True):
        raw, key = (t or "").encode(), "" if i is None else i
        best = max(range(24), key=lambda s: score(key, s))
        want[str(i), len(raw) + 8, zlib.crc32(raw), "key", best, 24 if score(key, 24) > score(key, best) else best] += 1
    assert collections.Counter((str(x["doc_id"]), x["size"], x["text_crc32"], x["law"], x["shard"], x["grown_shard"]) for x in got) == want
    slots = collections.defaultdict(list)
    for x in got:
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def held_out(doc_id, mod, rest):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == rest


def test_op5_held_out(spark, tables):
    got = [x for x in run(spark, tables, 5)]
    assert len(got) == len(tables["texts"]) and all(x["held_out"] == held_out(x["doc_id"], 3, 1) and 0 <= x["score"] <= 1 for x in got)
    known = [x for x in got if x["held_out"] and x["doc_id"] in tables["toxic"]]
    assert len(known) > 20 and sum(x["predicted"] == tables["toxic"][x["doc_id"]] for x in known) >= 0.95 * len(known)


def test_op5_risk_is_of_every_text(spark):
    import numpy as np

    from glossa.llm import toxicity

    r = random.Random(2)
    texts = [" ".join(r.choices(["vile", "scum", "tree", "lake", "sun"], k=r.randrange(6))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(5)
    keys = ["wvile", "wscum", "wsun"]
    assert toxicity.texts_with(docs, keys).sum() == sum(w in t.split() for t in texts for w in ("vile", "scum", "sun"))
    w, bias = np.array([0.5, -1.0, 2.0]), -0.3
    loss, g = toxicity.negative_risk(toxicity.feature_lists(docs.select("text"), keys), w, bias)
    known = toxicity.Known(keys)
    x = np.zeros((301, 3))
    x[known.pairs([t.encode() for t in [*texts, ""]])] = 1
    f = x @ w + bias
    s = 1 / (1 + np.exp(-f))
    assert loss == pytest.approx(np.log1p(np.exp(f)).sum()) and np.append(x.T @ s, s.sum()) == pytest.approx(g)


def test_op6_held_out(spark, tables):
    got = run(spark, tables, 6)
    assert len(got) == len(tables["texts"]) and all(x["held_out"] == held_out(x["doc_id"], 5, 0) and 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in got)


def test_op8_archives(spark, tables):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    payloads = [(p[0], (p[2] or "").encode()) for p in tables["pages"]]
    best = {}
    for key, x in payloads:
        best[x] = max(best.get(x, -1), -1 if key is None else key)
    got = run(spark, tables, 8)
    seen = collections.Counter((str(x["page_id"]), x["payload_bytes"], x["payload_digest"]) for x in got)
    assert seen == collections.Counter((str(key), len(x), digest(x)) for key, x in payloads)
    for x, key in best.items():
        own = [r for r in got if r["payload_digest"] == digest(x)]
        first = [r for r in own if r["record_type"] == "response"]
        assert [r["page_id"] for r in first] == [key] and all(r["refers_to"] is None for r in first)
        assert all(r["record_type"] == "revisit" and r["refers_to"] == key for r in own if r is not first[0])


def test_op8_stored_archives(spark, tables, tmp_path):
    from glossa.llm import archive

    rows = [(i, f"http://h/{i}", b"body" if i % 3 else b"HTTP/1.1 odd\r\n\r\nbody") for i in range(30)] + [(7, "http://h/7", b"body"), (None, None, None)]
    pages = spark.createDataFrame(rows, "key long, url string, payload binary").repartition(3)
    arcs, warcs = str(tmp_path / "arc"), str(tmp_path / "warc")
    archive.write_arc(pages, arcs)
    stored = [archive.parse_arc(archive.unzipped(bytes(r.content))) for r in archive.stored(spark, arcs).collect()]
    assert {next(f).version for f in stored} == {1, 2}
    archive.convert(spark, arcs, warcs, min_bytes=5)
    back = archive.read_archives(spark, warcs).collect()
    assert len({r.record_id for r in back}) == len(rows) == len(back)
    ids = {r.record_id for r in back if r.record_type == "response"}
    assert all(r.refers_to_id in ids and r.payload == b"" for r in back if r.record_type == "revisit")
    assert sum(r.record_type == "revisit" for r in back) == 9  # of the ten long payloads
    assert all(bytes(r.payload) == b"body" for r in back if r.record_type == "response" and r.payload_bytes == 4)
    # a file is a row of gzip members, a record each
    data = bytes(archive.stored(spark, warcs).first().content)
    assert all(m.startswith(b"WARC/1.0") and m.endswith(archive.END) for m in archive.members(data))


def test_op9_library(spark, tables):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    want = collections.Counter()
    for i, x in zip(tables["ids"], tables["texts"], strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter((str(x["doc_id"]), x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in run(spark, tables, 9)) == want


def cut(texts, window=35):
    split = [words_of(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for t, w in zip(texts, split, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        yield t, w, [x for i, x in enumerate(w) if i not in gone]


def test_op10_windows(spark, tables):
    want = collections.Counter((str(i), len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, (_, w, k) in zip(tables["ids"], cut(tables["texts"]), strict=True))
    got = run(spark, tables, 10)
    assert collections.Counter((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == want
    assert sum(x["n_removed"] > 0 for x in got) > 50


def test_row_numbers_do_not_follow_the_cores(spark, tables):
    from glossa.llm.common import with_row_ids

    docs = spark.read.parquet(tables["dir"] + "/documents.parquet").select("doc_id", "text")
    seen = []
    for size in ("1k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append(sorted((r.row_id, str(r.text)) for r in with_row_ids(docs, "rows").collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({x for x, _ in seen[0]}) == len(tables["texts"])


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{tables['dir']}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_op2_estimate(spark):
    """Concentration steps over sorted distances, without bins, give the same verdicts."""
    import numpy as np

    from glossa.llm import outliers

    r = random.Random(8)
    rows = []
    for i in range(900):
        w = prose(r, r.randrange(60, 260))
        junk = i % 30 == 0
        tail = "abcdefgh"[: r.randrange(1, 9)]
        w = [x + tail * (r.random() < 0.5) for x in w]
        for _ in range(len(w) // 2 if junk else r.randrange(12)):
            k = r.randrange(len(w))
            w[k] += "#" * (30 if junk else 1)
        rows.append((i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in outliers.verdicts(docs).collect()}
    stats = outliers.statistics(docs).select("doc_id", *[v.alias(f"x{k}") for k, v in enumerate(outliers.vector())]).toPandas().sort_values("doc_id")
    x = stats[[f"x{k}" for k in range(outliers.DIMS)]].to_numpy()
    floor = np.array(outliers.FLOOR)
    mid = np.median(x, 0)
    z = (x - mid) / np.maximum((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349, floor)
    best = None
    for d in ((z**2).sum(1), np.abs(z).max(1)):
        for _ in range(outliers.STEPS + 1):
            near = x[np.argsort(d, kind="stable")[: int(np.ceil(outliers.SUPPORT * len(x)))]]
            m, c = near.mean(0), np.cov(near.T, bias=True) + np.diag(floor**2)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], d / outliers.CONSISTENCY
    have = np.array([got[i].distance2 for i in range(900)])
    assert np.median(np.abs(have - best[1]) / (1 + best[1])) < 0.05
    sure = np.abs(best[1] - outliers.CUT) > 0.1 * outliers.CUT
    failed = np.array([got[i].base_failed for i in range(900)])
    assert all(got[i].kept == (best[1][i] <= outliers.CUT) for i in np.flatnonzero(sure & ~failed))
    assert sum(not got[i].kept for i in range(0, 900, 30)) >= 25
