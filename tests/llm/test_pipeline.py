"""The pipeline's stages against brute force, each on what the one before kept."""

import collections
import hashlib

import pytest

from tests.llm.test_brute_force import bag, cut, lower, probability_jaccard, tables  # noqa: F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tables):  # noqa: F811
    from glossa.session import materialize

    docs = spark.read.parquet(tables["dir"] + "/documents.parquet").select(*corpus_pipeline.COLUMNS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = materialize(stage(spark, docs, tables["dir"]), name)
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = [r.asDict() for r in docs.collect()]
    start = collections.Counter((str(i), t) for i, t in zip(tables["ids"], tables["texts"], strict=True))
    clean = [(r["doc_id"], r["text"]) for r in kept["toxicity"]]
    toxic = {i for i, t in tables["toxic"].items() if t}
    assert not collections.Counter((str(i), t) for i, t in clean) - start
    gone = {i for i in tables["ids"]} - {i for i, _ in clean}
    assert len(toxic & gone) >= 0.9 * len(toxic) and len(gone - toxic) <= 0.02 * len(clean)
    # near copies: what stays is not linked to one of its class; what goes is linked to something
    bags = [bag(lower(t)) for _, t in clean]
    top = list(range(len(clean)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(clean)):
        for j in range(i):
            if (not bags[i] and not bags[j]) or bags[i].keys() & bags[j].keys() and probability_jaccard(bags[i], bags[j]) >= 0.8 + 1e-9:
                top[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(clean)):
        groups[find(i)].append(i)
    rank = lambda i: (clean[i][0] is None, clean[i][0] or 0)
    want = sorted(str(clean[min(g, key=rank)][0]) for g in groups.values())
    assert sorted(str(r["doc_id"]) for r in kept["near_duplicates"]) == want
    before = kept["near_duplicates"]
    expect = collections.Counter((str(r["doc_id"]), (t or "") if len(w) == len(k) else b" ".join(k).decode()) for r, (t, w, k) in zip(before, cut([r["text"] for r in before]), strict=True))
    assert collections.Counter((str(r["doc_id"]), r["text"]) for r in kept["substring_repeats"]) == expect
    items = [lower(t) for t in tables["items"] if lower(t)]

    def leaks(words):
        for x in items:
            own = bag(x)
            for s in range(len(words) - len(x) + 1):
                b = bag(words[s : s + len(x)])
                if sum((own & b).values()) >= (0.8 - 1e-12) * sum((own | b).values()):
                    return True
        return False

    rest = [r for r in kept["substring_repeats"] if not leaks(lower(r["text"]))]
    assert sorted(str(r["doc_id"]) for r in kept["decontamination"]) == sorted(str(r["doc_id"]) for r in rest) and len(rest) < len(kept["substring_repeats"])
    assert sorted(str(r["doc_id"]) for r in kept["bpe"]) == sorted(str(r["doc_id"]) for r in rest)
    empty = [r for r in kept["bpe"] if r["n_tokens"] == 0]
    assert all(r["ids_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)


def test_empty(spark, tables, tmp_path):  # noqa: F811
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tables['dir']}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
