"""The same queries in DuckDB's SQL, written from the definitions and without
any part of the engine."""

from __future__ import annotations

import re

DELIMITERS = r"""[ \t\n\r\f.()\[\]{}^+=|_*&%#"\x27,\-:;/\\?!@~\x{201C}\x{201D}\x{3000}»«]+"""
ENDS = r"^[\x00-\x20]+|[\x00-\x20]+$"
UNWANTED = r"[\p{Pe}\p{Pd}\p{Ps}\p{Pc}\p{Po}\t\n\x0B\f\r 0-9]"


def words(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({text}), '{DELIMITERS}'), lambda x: regexp_replace(x, '{ENDS}', '', 'g')), lambda x: length(x) BETWEEN 1 AND 199)"


def white(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"


def draw(seed: str, *keys: str) -> str:
    return "('0x' || substr(md5(concat_ws('/', '" + seed + "', " + ", ".join(keys) + ")), 1, 8))::BIGINT"


ITEMS = "units AS (SELECT item_id AS id, text FROM benchmark)"
DOCS = "units AS (SELECT doc_id AS id, text FROM documents)"
UNIT_WORDS = f"utok AS (SELECT id, unnest({words('text')}) AS word FROM units)"
#: n-grams of every word in `dimw`.
DIM = f"""ns AS (SELECT unnest(range(1, 7))::INT AS n),
dim AS (SELECT DISTINCT word, n, g FROM (SELECT word, n, substr('$' || word || '$', i::INT, n) AS g FROM (
  SELECT word, n, unnest(range(1, length(word) + 4 - n)) AS i FROM dimw CROSS JOIN ns)) WHERE NOT regexp_matches(g, '{UNWANTED}') AND (n > 1 OR regexp_matches(g, '^\\p{{L}}$')))"""
MODEL = f"""ctok AS (SELECT lang, unnest({words('text')}) AS word FROM documents WHERE lang IS NOT NULL),
cword AS (SELECT lang, word, count(*) AS c FROM ctok GROUP BY ALL)"""
PROFILES = """cfreq AS (SELECT lang, n, g, sum(c)::DOUBLE AS f FROM cword JOIN dim USING (word) GROUP BY ALL),
crank AS (SELECT *, row_number() OVER (PARTITION BY lang, n ORDER BY f DESC, g DESC) AS r FROM cfreq),
model AS (SELECT lang, n, g AS ngram, round(f / sqrt(sum(f * f) OVER (PARTITION BY lang, n)), 3) AS weight, r::INT AS rnk FROM crank WHERE r <= least(50 * n, 150) + 1)"""
FREQ = """uword AS (SELECT id, word, count(*) * CASE WHEN length(word) > 1 THEN 1.0::DOUBLE / length(word) ELSE 1.0::DOUBLE END AS w FROM utok GROUP BY id, word),
ufreq AS (SELECT id, n, g, sum(w) AS f FROM uword JOIN dim USING (word) GROUP BY ALL)"""
NORM = "unorm AS (SELECT id, n, sqrt(sum(f * f)) AS norm FROM (SELECT id, n, f, row_number() OVER (PARTITION BY id, n ORDER BY f DESC) AS r FROM ufreq) WHERE r <= least(50 * n, 150) + 1 GROUP BY id, n)"
SIM = f"""udot AS (SELECT id, u.n, lang, sum(f * weight) AS d FROM ufreq u JOIN model m ON u.n = m.n AND u.g = m.ngram GROUP BY ALL),
sim AS (SELECT t.id, ns.n, l.lang, CASE WHEN length(regexp_replace(coalesce(t.text, ''), '{ENDS}', '', 'g')) >= ns.n AND norm > 0 THEN coalesce(d, 0.0) / norm * ns.n ELSE 0.0 END AS score
  FROM units t CROSS JOIN ns CROSS JOIN (SELECT DISTINCT lang FROM model) l LEFT JOIN unorm v ON v.id = t.id AND v.n = ns.n LEFT JOIN udot o ON o.id = t.id AND o.n = ns.n AND o.lang = l.lang)"""
MOST = "top AS (SELECT *, max(score) OVER (PARTITION BY id, n) AS most FROM sim)"
PART = "CASE WHEN score > 0 THEN score / (most * 6) ELSE 0.0 END"
LINEAR = {
    "all": f"{MOST}, linear AS (SELECT id, lang, sum({PART}) AS score FROM top GROUP BY ALL)",
    "low": f"{MOST}, linear AS (SELECT id, lang, sum({PART}) AS score FROM top WHERE score <> 0 AND score >= 0.05 GROUP BY ALL)",
}
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, lang)::INT AS rnk FROM linear)"
BEST = "best AS (SELECT d.doc_id, d.lang AS lang_true, r.lang AS lang_pred, round(r.score, 6) AS score FROM documents d LEFT JOIN (SELECT * FROM ranked WHERE rnk = 1) r ON r.id = d.doc_id)"
SAMPLES = f"""dw AS (SELECT doc_id, lang, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
ck AS (SELECT doc_id, lang, w, unnest(range(0, len(w) // 5 + 1)) AS chunk FROM dw),
cl AS (SELECT *, 4 + {draw('samples', 'doc_id', 'chunk')} % 4 AS l FROM ck),
cs AS (SELECT *, coalesce(sum(l + 1) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM cl),
samples AS (SELECT doc_id, lang, chunk, array_to_string(w[s + 1 : s + l], ' ') AS text,
  CASE WHEN s + l < len(w) AND {draw('samples-split', 'doc_id', 'chunk')} % 10 > 0 THEN 'train' ELSE 'test' END AS split FROM cs WHERE s <= len(w))"""
BIGRAMS = f"""lw AS (SELECT {white('text')} AS w FROM samples WHERE split = 'train'),
bigrams AS (SELECT b AS bigram, count(*) AS cnt FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM lw) GROUP BY b)"""
MULTI = f"""multi AS (SELECT (row_number() OVER (ORDER BY r, doc_id, chunk) - 1)::INT AS line_no, text, lang FROM (
  SELECT *, {draw('multi', 'doc_id', 'chunk')} AS r FROM samples WHERE split = 'test' AND text <> '') ORDER BY line_no LIMIT 30000)"""
MERGED = """runs AS (SELECT *, CASE WHEN line_no > 0 AND lang IS NOT DISTINCT FROM lag(lang) OVER (ORDER BY line_no) THEN 0 ELSE 1 END AS c FROM multi),
segs AS (SELECT *, sum(c) OVER (ORDER BY line_no)::BIGINT AS seg FROM runs),
phrases AS (SELECT seg, lang, string_agg(text, ' ' ORDER BY line_no) AS text FROM segs GROUP BY seg, lang)"""
UNION_WORDS = "dimw AS (SELECT word FROM cword UNION SELECT word FROM utok)"
FEATURES = f"""wide AS (SELECT id, lang, {', '.join(f'max(CASE WHEN n = {n} THEN score END) AS f{n}' for n in range(1, 7))} FROM sim GROUP BY id, lang),
feats AS (SELECT id, lang, {', '.join(f'round({"l.score" if i == 0 else f"f{i}"}, 9) AS f{i}' for i in range(7))} FROM wide JOIN linear l USING (id, lang))"""
CUTS = [0.0]
while CUTS[-1] + 0.1 < 1.0:
    CUTS.append(CUTS[-1] + 0.1)
BINNED = "binned AS (SELECT id, f.lang, coalesce((f.lang = d.lang)::BIGINT, 0) AS positive, " + ", ".join("(" + " + ".join(f"(f{i} >= {c!r}::DOUBLE)::INT" for c in CUTS) + f")::INT AS b{i}" for i in range(7)) + " FROM feats f JOIN documents d ON d.doc_id = f.id)"


def entropy(p: str, n: str) -> str:
    return f"CASE WHEN {p} <= 0 OR {p} >= {n} THEN 0.0 ELSE -(({p} / {n}) * log2({p} / {n}) + (1 - {p} / {n}) * log2(1 - {p} / {n})) END"


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def similarity(units: str = DOCS) -> tuple[str, ...]:
    return (units, UNIT_WORDS, MODEL, UNION_WORDS, DIM, PROFILES, FREQ, NORM, SIM)


def second(sql: str) -> str:
    """The same detection over other units: its names end in `_2`."""
    return re.sub(r"\b(units|utok|uword|ufreq|unorm|udot|sim|top|linear|ranked)\b", r"\1_2", sql)


#: Detection of `units` with the dimension `dim` and the profiles given.
DETECT = (UNIT_WORDS, FREQ, NORM, SIM, LINEAR["low"], RANKED)
#: Best language of each unit, for units numbered by two keys.
FAR = 1_000_000
ITEM_TOKENS = f"tok AS (SELECT item_id, {white('text')} AS w FROM benchmark)"
ITEM_WORDS = f"iword AS (SELECT unnest({words('text')}) AS word FROM benchmark)"
ITEM_DIM = "dimw AS (SELECT word FROM cword UNION SELECT word FROM iword)"
KNOWN = f"""pairs AS (SELECT item_id, unnest(range(1, len(w))) AS i, w FROM tok),
known AS MATERIALIZED (SELECT item_id, list(coalesce(cnt, 0) ORDER BY i) AS k FROM (SELECT item_id, i, w[i] || ' ' || w[i + 1] AS bigram FROM pairs) LEFT JOIN bigrams USING (bigram) GROUP BY item_id)"""
PREFERENCE = {2: [0], 3: [1, 0], 4: [1, 2, 0], 5: [2, 1, 3, 0], 6: [2, 3, 1, 4, 0]}


def by_word_tags(width: int) -> str:
    """Phrases by neighbouring windows of `width` tokens."""
    unit = f"{ITEM_TOKENS}, pos AS (SELECT item_id, w, unnest(range(1, len(w) + 2 - {width})) AS i FROM tok)"
    units = f"units AS (SELECT item_id * {FAR} + i AS id, array_to_string(w[i : i + {width - 1}], ' ') AS text FROM pos)"
    lang = f"lang_of AS (SELECT p.item_id, p.i, p.w[p.i] AS t, r.lang FROM pos p LEFT JOIN (SELECT * FROM ranked WHERE rnk = 1) r ON r.id = p.item_id * {FAR} + p.i)"
    cut = "cuts AS (SELECT *, CASE WHEN lang <> lag(lang) OVER (PARTITION BY item_id ORDER BY i) THEN 1 ELSE 0 END AS c FROM lang_of)"
    # with wider windows the broken phrase still holds the token before the last
    over = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if width == 1 else "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    seg = f"segs AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY item_id ORDER BY i {over}), 0)::INT AS seg FROM cuts)"
    if width == 1:
        label = "SELECT item_id, seg, string_agg(t, ' ' ORDER BY i) AS text, arg_max_null(lang, i) AS lang FROM segs GROUP BY item_id, seg"
    else:  # the language of the window before the break
        seg += ", named AS (SELECT *, CASE WHEN c = 1 THEN lag(lang) OVER (PARTITION BY item_id ORDER BY i) ELSE lang END AS own FROM segs)"
        label = "SELECT item_id, seg, string_agg(t, ' ' ORDER BY i) AS text, arg_max_null(own, i) AS lang FROM named GROUP BY item_id, seg"
    return chain(unit, *similarity(units), LINEAR["low"], RANKED, lang, cut, seg) + label


def cut_tags(*cuts: str) -> str:
    """Phrases between the cuts `cut_at` (item_id, cut): each one detected, and
    joined with an equal neighbour. `cut` counts the tokens before it."""
    words_ = "item_tok AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM tok)"
    placed = "placed AS (SELECT t.item_id, t.i, t.w[t.i] AS t, (SELECT count(*) FROM cut_at c WHERE c.item_id = t.item_id AND c.cut < t.i) AS part FROM item_tok t)"
    parts = "phrase AS MATERIALIZED (SELECT item_id, part, string_agg(t, ' ' ORDER BY i) AS text FROM placed GROUP BY item_id, part)"
    units = f"units_2 AS (SELECT item_id * {FAR} + part AS id, text FROM phrase)"
    named = f"named AS (SELECT p.*, coalesce(r.lang, 'en') AS lang FROM phrase p LEFT JOIN (SELECT * FROM ranked_2 WHERE rnk = 1) r ON r.id = p.item_id * {FAR} + p.part)"
    seg = "segs AS (SELECT *, sum(c) OVER (PARTITION BY item_id ORDER BY part) - 1 AS seg FROM (SELECT *, CASE WHEN lang = lag(lang) OVER (PARTITION BY item_id ORDER BY part) THEN 0 ELSE 1 END AS c FROM named))"
    body = ",\n".join((ITEM_TOKENS, ITEM_WORDS, MODEL, ITEM_DIM, DIM, PROFILES, SAMPLES, BIGRAMS, KNOWN, *cuts, words_, placed, parts, units, *map(second, DETECT), named, seg))
    return f"WITH RECURSIVE {body}\nSELECT item_id, seg::INT AS seg, string_agg(text, ' ' ORDER BY part) AS text, any_value(lang) AS lang FROM segs GROUP BY item_id, seg"


def window_tags(width: int) -> str:
    pos = f"pos AS (SELECT item_id, w, unnest(range(1, len(w) + 2 - {width})) AS i FROM tok)"
    units = f"units AS (SELECT item_id * {FAR} + i AS id, array_to_string(w[i : i + {width - 1}], ' ') AS text FROM pos)"
    own = f"own AS MATERIALIZED (SELECT p.item_id, p.i - 1 AS p, coalesce(r.lang, 'en') AS lang FROM pos p LEFT JOIN (SELECT * FROM ranked WHERE rnk = 1) r ON r.id = p.item_id * {FAR} + p.i)"
    pref = PREFERENCE[width]
    counts = "[" + ", ".join(f"k[s.p + {width - 1 - x}]" for x in pref) + "]"  # 1-based: bigram p + width - 2 - x
    cut = f"CASE WHEN prev <> lang AND list_contains({counts}, 0) THEN s.p + {width - 1} - {pref}[list_position({counts}, 0)] END"
    walk = f"""walk AS (SELECT item_id, 0::BIGINT AS p, NULL::VARCHAR AS prev, NULL::BIGINT AS cut FROM tok
UNION ALL SELECT item_id, coalesce(c, p + 1) AS p, CASE WHEN c IS NULL THEN lang END AS prev, c AS cut FROM (SELECT s.item_id, s.p, o.lang, {cut} AS c FROM walk s JOIN own o ON o.item_id = s.item_id AND o.p = s.p LEFT JOIN known n ON n.item_id = s.item_id))"""
    return cut_tags(pos, units, *DETECT, own, walk, "cut_at AS MATERIALIZED (SELECT item_id, cut FROM walk WHERE cut IS NOT NULL)")


def tree() -> tuple[str, ...]:
    """Levels of the tree: rows r0.., nodes n0.. of (lang, node, feature, confidence, n)."""
    out = ["r0 AS MATERIALIZED (SELECT *, '' AS node, '' AS used FROM binned)"]
    bins = ", ".join(f"b{i}" for i in range(7))
    for k in range(8):
        out.append(f"s{k} AS (SELECT lang, node, count(*) AS n, sum(positive)::BIGINT AS p FROM r{k} GROUP BY ALL)")
        if k == 7:
            out.append("n7 AS MATERIALIZED (SELECT lang, node, NULL::INT AS feature, round(p / n, 9) AS confidence, n FROM s7)")
            break
        out.append(f"c{k} AS (SELECT lang, node, f, bin, count(*)::DOUBLE AS n, sum(positive)::DOUBLE AS p FROM (SELECT lang, node, used, positive, unnest(range(0, 7)) AS f, unnest([{bins}]) AS bin FROM r{k}) WHERE NOT contains(used, f || ',') GROUP BY ALL)")
        out.append(f"g{k} AS (SELECT lang, node, f, round({entropy('pos', 'total')} - rest / total, 9) AS gain FROM (SELECT lang, node, f, sum(n) AS total, sum(p) AS pos, sum(n * {entropy('p', 'n')}) AS rest FROM c{k} GROUP BY ALL))")
        out.append(f"t{k} AS (SELECT lang, node, f FROM g{k} QUALIFY row_number() OVER (PARTITION BY lang, node ORDER BY gain DESC, f) = 1)")
        out.append(f"n{k} AS MATERIALIZED (SELECT s.lang, s.node, CASE WHEN p > 0 AND p < n THEN f END::INT AS feature, round(p / n, 9) AS confidence, n FROM s{k} s LEFT JOIN t{k} t ON t.lang = s.lang AND t.node = s.node)")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT r.id, r.lang, r.positive, {', '.join(f'r.b{i}' for i in range(7))}, r.node || n.feature || ':' || ([{', '.join(f'r.b{i}' for i in range(7))}])[n.feature + 1] || '/' AS node, r.used || n.feature || ',' AS used FROM r{k} r JOIN n{k} n ON n.lang = r.lang AND n.node = r.node WHERE n.feature IS NOT NULL)")
    return tuple(out)


NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT * FROM n{k}" for k in range(8)) + ")"
TREE_LINES = """SELECT 0 AS bag, lang, node, repeat('  ', len(path) - 1) || CASE WHEN len(path) > 1 THEN
  CASE WHEN bin > 0 THEN printf('%.1f', (bin - 1) / 10) || ' <= ' ELSE '' END || names[f + 1] || CASE WHEN bin < 11 THEN ' < ' || printf('%.1f', bin / 10) ELSE '' END || ': ' ELSE '' END ||
  CASE WHEN feature IS NULL THEN 'confidence = ' || printf('%.3f', confidence) || ' (' || n || ')' ELSE 'split on ' || names[feature + 1] END AS line
FROM (SELECT *, string_split(path[-2], ':')[1]::INT AS f, string_split(path[-2], ':')[2]::INT AS bin FROM (SELECT *, string_split(node, '/') AS path, ['LINEAR', '1', '2', '3', '4', '5', '6'] AS names FROM nodes))"""
#: Predictions by the given weights.
GIVEN = f"""langs AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS m FROM (SELECT DISTINCT lang FROM model)),
size AS (SELECT count(*) AS l FROM langs),
cells AS (SELECT id, lang, unnest(range(0, 7)) AS f, unnest([{', '.join(f'f{i}' for i in range(7))}]) AS v FROM feats),
given AS (SELECT c.id, t.lang, 1 / (1 + exp(-sum(((5 * (c.f * l + o.m + t.m)) % 7 - 3) / 10 * c.v))) AS confidence FROM cells c JOIN langs o ON o.lang = c.lang CROSS JOIN langs t CROSS JOIN size GROUP BY c.id, t.lang)"""
FOUND = f"""units AS (SELECT line_no AS id, text FROM multi),
{", ".join(DETECT)},
said AS (SELECT m.line_no, m.text, r.lang FROM multi m LEFT JOIN (SELECT * FROM ranked WHERE rnk = 1) r ON r.id = m.line_no),
found AS (SELECT seg, any_value(lang) AS lang, string_agg(text, ' ' ORDER BY line_no) AS text FROM (SELECT *, sum(c) OVER (ORDER BY line_no)::BIGINT AS seg FROM (SELECT *, CASE WHEN line_no > 0 AND lang IS NOT DISTINCT FROM lag(lang) OVER (ORDER BY line_no) THEN 0 ELSE 1 END AS c FROM said)) GROUP BY seg)"""
LINES = chain(SAMPLES, MULTI, MERGED, MODEL, f"lword AS (SELECT unnest({words('text')}) AS word FROM multi)", "dimw AS (SELECT word FROM cword UNION SELECT word FROM lword)", DIM, PROFILES, FOUND)
METRICS = """, truth AS (SELECT text, arg_min(lang, seg) AS true_lang, count(*) AS times FROM phrases WHERE seg < (SELECT max(seg) FROM phrases) GROUP BY text),
n AS (SELECT count(*) AS n_true, coalesce(sum(times - 1), 0)::BIGINT AS n_duplicates FROM truth),
m AS (SELECT count(*) AS n_found, count(*) FILTER (t.text IS NULL) AS not_a_phrase, count(*) FILTER (t.text IS NOT NULL AND f.lang IS DISTINCT FROM true_lang) AS mis_tagged, count(*) FILTER (t.text IS NOT NULL AND f.lang = true_lang) AS correct FROM found f LEFT JOIN truth t ON t.text = f.text),
r AS (SELECT *, correct / nullif(n_true, 0) AS rec, correct / nullif(n_found, 0) AS prec FROM m CROSS JOIN n)
SELECT n_true, n_duplicates, n_found, not_a_phrase, mis_tagged, correct, round(rec, 6) AS recall, round(prec, 6) AS precision, round(2 * rec * prec / nullif(rec + prec, 0), 6) AS f1 FROM r"""


def oracle_sql() -> dict[str, str]:
    low, all_ = (*similarity(), LINEAR["low"]), (*similarity(), LINEAR["all"])
    accuracy = "SELECT coalesce(lang_true, '*') AS lang, count(*) AS total, sum((lang_true IS DISTINCT FROM lang_pred)::INT)::BIGINT AS errors, round((count(*) - sum((lang_true IS DISTINCT FROM lang_pred)::INT)) / count(*), 6) AS accuracy FROM best WHERE lang_true IS NOT NULL GROUP BY ROLLUP (lang_true)"
    model = chain(MODEL, "dimw AS (SELECT DISTINCT word FROM cword)", DIM, PROFILES)
    cross = f"tok AS (SELECT item_id, {words('text')} AS w FROM benchmark), pairs AS (SELECT item_id, unnest(range(1, len(w))) AS pos, w FROM tok), seams AS (SELECT item_id, pos, w[pos] || '$' || w[pos + 1] AS s, unnest([3, 4, 5, 6]) AS n FROM pairs), grams AS (SELECT DISTINCT item_id, pos, n, g FROM (SELECT item_id, pos, n, substr(s, j::INT, n) AS g FROM (SELECT *, unnest(range(1, length(s) + 2 - n)) AS j FROM seams)))"
    gain = "cells AS (" + " UNION ALL ".join(f"SELECT lang, {i} AS feature, b{i} AS bin, positive FROM binned" for i in range(7)) + "), bins AS (SELECT lang, feature, bin, count(*)::DOUBLE AS n, sum(positive)::DOUBLE AS p FROM cells GROUP BY ALL), sums AS (SELECT lang, feature, sum(n) AS total, sum(p) AS pos, sum(n * " + entropy("p", "n") + ") AS rest FROM bins GROUP BY lang, feature)"
    return {
        "tokenize": f"SELECT doc_id, len(w)::BIGINT AS n_tokens, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id, {words('text')} AS w FROM documents)",
        "item_word_ngrams": chain(ITEMS, UNIT_WORDS, "dimw AS (SELECT DISTINCT word FROM utok)", DIM) + "SELECT word, n, g AS ngram FROM dim",
        "item_cross_word_ngrams": chain(cross) + f"SELECT item_id, pos::INT AS pos, n, g AS ngram FROM grams WHERE NOT regexp_matches(g, '{UNWANTED}') AND contains(substr(g, 2, n - 2), '$')",
        "jaccard_docs": chain(f"tok AS (SELECT doc_id, list_distinct({words('text')}) AS w FROM documents)") + "SELECT a.doc_id, round(len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) AS jaccard FROM tok a JOIN tok b ON b.doc_id = a.doc_id + 1",
        "length_status": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 25 THEN 'too short' WHEN length(text) > 100000 THEN 'too long' ELSE 'ok' END AS status FROM documents",
        "doc_ngram_freq": chain(DOCS, UNIT_WORDS, "dimw AS (SELECT DISTINCT word FROM utok)", DIM, FREQ) + "SELECT id AS doc_id, n, g AS ngram, round(f, 6) AS freq FROM ufreq",
        "lang_model": model + "SELECT * FROM model",
        "lang_model_topk": model + "SELECT lang, n, count(*) AS entries, max(weight) AS most, min(weight) AS least FROM model GROUP BY lang, n",
        "model_lines": model + "SELECT lang, n, rnk, ngram || ':' || printf('%.3f', weight) AS line FROM model",
        "doc_norm": chain(DOCS, UNIT_WORDS, "dimw AS (SELECT DISTINCT word FROM utok)", DIM, FREQ, NORM) + "SELECT id AS doc_id, n, round(norm, 6) AS norm FROM unorm",
        "raw_similarity": chain(*similarity()) + "SELECT id AS doc_id, n, lang, round(score, 6) AS score FROM sim",
        "raw_similarity_items": chain(*similarity(ITEMS)) + "SELECT id AS item_id, n, lang, round(score, 6) AS score FROM sim",
        "linear_scores_all": chain(*all_, RANKED) + "SELECT id AS doc_id, lang, round(score, 6) AS score, rnk FROM ranked",
        "linear_scores_filtered": chain(*low, RANKED) + "SELECT id AS doc_id, lang, round(score, 6) AS score, rnk FROM ranked",
        "detect_language": chain(*low, RANKED, BEST) + "SELECT * FROM best",
        "score_breakdown": chain(*similarity()) + "SELECT id AS doc_id, lang, " + ", ".join(f"round(max(CASE WHEN n = {n} THEN score END), 6) AS gram_{n}" for n in range(1, 7)) + " FROM sim GROUP BY id, lang",
        "accuracy_by_lang": chain(*low, RANKED, BEST) + accuracy,
        "confusion": chain(*low, RANKED, BEST) + "SELECT lang_true AS lang, lang_pred, count(*) AS n FROM best WHERE lang_true IS NOT NULL GROUP BY ALL",
        "sample_chunks": chain(SAMPLES) + "SELECT * FROM samples",
        "train_test_split": chain(SAMPLES) + "SELECT lang, split, count(*) AS n FROM samples GROUP BY lang, split",
        "training_sample": chain(SAMPLES) + f"SELECT doc_id, lang, chunk, text FROM samples WHERE split = 'train' AND {draw('take', 'doc_id', 'chunk')} < {int(0.01 * (1 << 32))}",
        "bigram_counts": chain(SAMPLES, BIGRAMS) + "SELECT * FROM bigrams",
        "unseen_bigrams": chain(SAMPLES, BIGRAMS, f"iw AS (SELECT doc_id, {white('text')} AS w FROM documents), ib AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS pos, w FROM iw)") + "SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] AS bigram FROM ib WHERE w[pos + 1] || ' ' || w[pos + 2] NOT IN (SELECT bigram FROM bigrams)",
        "multi_test_lines": chain(SAMPLES, MULTI) + "SELECT * FROM multi",
        "merge_consecutive_lines": chain(SAMPLES, MULTI, MERGED) + "SELECT * FROM phrases",
        "feature_vector": chain(*all_, FEATURES) + "SELECT id AS doc_id, lang, " + ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(7)) + " FROM feats",
        "feature_bins": chain(*all_, FEATURES, BINNED) + "SELECT id AS doc_id, * EXCLUDE (id) FROM binned",
        "info_gain_root": chain(*all_, FEATURES, BINNED, gain) + "SELECT lang, feature, round(" + entropy("pos", "total") + " - rest / total, 6) AS gain FROM sums",
        "ovr_argmax": chain(*all_) + "SELECT doc_id, lang_pred, confidence FROM (SELECT id AS doc_id, CASE WHEN score > 0 THEN lang END AS lang_pred, round(score, 6) AS confidence, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, lang) AS k FROM linear) WHERE k = 1",
        "linear_scores_items": chain(*similarity(ITEMS), LINEAR["low"], RANKED) + "SELECT id AS item_id, lang, round(score, 6) AS score, rnk FROM ranked",
        "model_files": model + "SELECT lang, n, ngram, weight FROM model",
        "language_names": "SELECT d.lang, l.name, count(*) AS n FROM documents d LEFT JOIN (VALUES ('en', 'English'), ('fr', 'French'), ('it', 'Italian'), ('de', 'German'), ('es', 'Spanish'), ('pt', 'Portuguese')) l(lang, name) ON l.lang = d.lang GROUP BY d.lang, l.name",
        "training_first": chain(SAMPLES) + "SELECT doc_id, lang, chunk, text FROM samples WHERE split = 'train' ORDER BY doc_id, chunk LIMIT 100",
        "split_files": chain(SAMPLES) + "SELECT lang, split, count(*) AS n, sum(length(text))::BIGINT AS chars FROM samples GROUP BY lang, split",
        "bigram_lookup": chain(SAMPLES, BIGRAMS, f"iw AS (SELECT item_id, {white('text')} AS w FROM benchmark), ib AS (SELECT item_id, unnest(range(0, len(w) - 1)) AS pos, w FROM iw)") + "SELECT item_id, pos, bigram, coalesce(cnt, 0) AS cnt FROM (SELECT item_id, pos, w[pos + 1] || ' ' || w[pos + 2] AS bigram FROM ib) LEFT JOIN bigrams USING (bigram)",
        "multi_line_files": chain(SAMPLES, MULTI) + "SELECT text, lang FROM multi",
        "run_files": LINES + "SELECT 'found' AS kind, seg, lang, text FROM found UNION ALL SELECT 'expected', seg, lang, text FROM phrases",
        "phrase_metrics_lines": LINES + METRICS,
        "id3_tree": chain(*all_, FEATURES, BINNED, *tree(), NODES) + "SELECT 0 AS bag, lang, node, feature, confidence, n FROM nodes",
        "tree_files": chain(*all_, FEATURES, BINNED, *tree(), NODES) + TREE_LINES,
        "tree_predict": chain(*all_, FEATURES, BINNED, *tree()) + " UNION ALL ".join(f"SELECT r.id AS doc_id, r.lang, round(n.confidence, 6) AS confidence FROM r{k} r JOIN n{k} n ON n.lang = r.lang AND n.node = r.node WHERE n.feature IS NULL" for k in range(8)),
        "logistic_given": chain(*all_, FEATURES, GIVEN) + "SELECT id AS doc_id, lang, round(confidence, 6) AS confidence FROM given",
        "logistic_given_report": chain(*all_, FEATURES, GIVEN) + f"SELECT *, {', '.join(f'round({c} / rows, 6) AS {c}_share' for c in ('mistakes', 'false_positives', 'false_negatives'))} FROM (SELECT lang, count(*) AS rows, count(*) FILTER (said <> truth) AS mistakes, count(*) FILTER (said AND NOT truth) AS false_positives, count(*) FILTER (truth AND NOT said) AS false_negatives FROM (SELECT g.lang, confidence > 0.5 AS said, coalesce(g.lang = d.lang, false) AS truth FROM given g JOIN documents d ON d.doc_id = g.id) GROUP BY lang)",
        "item_tag_one_word": by_word_tags(1),
        "item_tag_two_word": by_word_tags(2),
        "item_tag_three_word": by_word_tags(3),
        "item_tag_base_bigram": cut_tags("cut_at AS (SELECT item_id, i AS cut FROM (SELECT item_id, unnest(range(1, len(k) + 1)) AS i, unnest(k) AS c FROM known) WHERE c = 0)"),
        **{f"item_tag_window_{width}": window_tags(width) for width in PREFERENCE},
    }
