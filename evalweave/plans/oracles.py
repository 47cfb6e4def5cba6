"""Equivalent SQL of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from statistics import NormalDist

WS = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
Z = repr(NormalDist().inv_cdf(0.975))
FRAMEWORKS = ["ir_nDCG@10", "ragas_faithfulness", "ares_composite"]
DIMS = ["context_relevance", "answer_faithfulness", "answer_relevance"]


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def clean(c: str) -> str:
    return f"nullif(lower({strip(c)}), '')"


def toks(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '{WS}+'), lambda x: x <> '')"


def sents(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({strip(f'coalesce({c}, chr(32))')}, '([.!?]){WS}+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: x <> '')"


def numbered(c: str) -> str:
    return f"coalesce(array_to_string(list_transform({c}, lambda x, i: '[' || i || '] ' || coalesce(x, '')), chr(10) || chr(10)), '')"


REFS = f"""
refs AS (
  SELECT 'qrels' AS table_name, 'doc_id' AS ref_column, qrel_id AS row_id, 'c' AS target, dataset, {clean('doc_id')} AS k, judged_at AS ts FROM qrels
  UNION ALL SELECT 'chunks', 'doc_id', chunk_row, 'c', dataset, {clean('doc_id')}, built_at FROM chunks
  UNION ALL SELECT 'qrels', 'query_id', qrel_id, 'q', dataset, {clean('query_id')}, judged_at FROM qrels),
par AS (
  SELECT 'c' AS target, dataset, {clean('doc_id')} AS k, loaded_at AS b, deleted_at AS e FROM corpus
  UNION ALL SELECT 'q', dataset, {clean('query_id')}, added_at, NULL FROM queries),
firsts AS (SELECT target, dataset, k, min(b) AS b FROM par WHERE k IS NOT NULL GROUP BY ALL),
found AS (
  SELECT r.table_name, r.ref_column, r.row_id, CASE WHEN f.b IS NULL THEN 'missing' WHEN f.b > r.ts THEN 'late' ELSE 'deleted' END AS reason, strftime(r.ts, '%Y-%m') AS ref_month
  FROM refs r LEFT JOIN firsts f ON f.target = r.target AND f.dataset = r.dataset AND f.k = r.k
  WHERE r.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM par p WHERE p.target = r.target AND p.dataset = r.dataset AND p.k = r.k AND p.b <= r.ts AND (p.e IS NULL OR r.ts < p.e)))"""

TABLES = f"""
cor AS (
  SELECT dataset, doc_id, title, text, load_id, {strip("coalesce(title, '') || ' ' || coalesce(text, '')")} AS doc_text FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, doc_id ORDER BY loaded_at DESC, load_id DESC) AS r
    FROM (SELECT * REPLACE ({clean('doc_id')} AS doc_id) FROM corpus) WHERE doc_id IS NOT NULL) WHERE r = 1 AND deleted_at IS NULL),
que AS (
  SELECT dataset, query_id, text FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY added_at DESC, text DESC) AS r
    FROM (SELECT * REPLACE ({clean('query_id')} AS query_id) FROM queries) WHERE query_id IS NOT NULL AND text IS NOT NULL) WHERE r = 1),
stated AS (SELECT * FROM que WHERE regexp_extract(query_id, '([0-9]+)$', 1) <> '' AND regexp_extract(query_id, '([0-9]+)$', 1)::BIGINT % 50 = 0),
qre AS (
  SELECT dataset, query_id, doc_id, rel FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, query_id, doc_id ORDER BY judged_at DESC, qrel_id DESC) AS r
    FROM (SELECT * REPLACE ({clean('query_id')} AS query_id, {clean('doc_id')} AS doc_id) FROM qrels) WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND rel IS NOT NULL) WHERE r = 1),
gen AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, config_id, query_id ORDER BY received_at DESC, gen_id DESC) AS r
    FROM (SELECT * REPLACE ({clean('query_id')} AS query_id) FROM generation) WHERE query_id IS NOT NULL) WHERE r = 1)"""


def chunks(name: str, size: int, overlap: int) -> str:
    step = max(1, size - overlap)
    return f"""
{name}_t AS (SELECT dataset, doc_id, {toks('doc_text')} AS t FROM cor),
{name} AS (
  SELECT dataset, doc_id || '::c' || i AS chunk_id, doc_id, i::INT AS chunk_ix, array_to_string(t[i * {step} + 1 : i * {step} + {size}], ' ') AS text
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN len(t) <= {size} THEN 0 ELSE ceil((len(t) - {size}) / {step}::DOUBLE)::BIGINT END)) AS i FROM {name}_t WHERE len(t) > 0))"""


def packed(name: str, size: int) -> str:
    return f"""
{name}_s AS (SELECT dataset, doc_id, i, l[i] AS s, len({toks('l[i]')}) AS t FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM (SELECT dataset, doc_id, {sents('doc_text')} AS l FROM cor))),
{name}_p AS (SELECT dataset, doc_id, i, s, 0 AS c, t AS n FROM {name}_s WHERE i = 1
  UNION ALL SELECT e.dataset, e.doc_id, e.i, e.s, CASE WHEN p.n > 0 AND p.n + e.t > {size} THEN p.c + 1 ELSE p.c END, CASE WHEN p.n > 0 AND p.n + e.t > {size} THEN e.t ELSE p.n + e.t END
  FROM {name}_p p JOIN {name}_s e ON e.dataset = p.dataset AND e.doc_id = p.doc_id AND e.i = p.i + 1),
{name} AS (SELECT dataset, doc_id || '::c' || c AS chunk_id, doc_id, c::INT AS chunk_ix, string_agg(s, ' ' ORDER BY i) AS text FROM {name}_p GROUP BY dataset, doc_id, c)"""


def bm25(k: int) -> str:
    return f"""
post AS (SELECT dataset, chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT dataset, chunk_id, len(l) AS dl, unnest(l) AS term FROM (SELECT dataset, chunk_id, {toks('lower(text)')} AS l FROM ch)) GROUP BY dataset, chunk_id, term),
st AS (SELECT dataset, count(*) AS n, avg(len({toks('lower(text)')})) AS avgdl FROM ch GROUP BY dataset),
dfs AS (SELECT dataset, term, count(*) AS df FROM post GROUP BY dataset, term),
qt AS (SELECT dataset, query_id, l[i] AS term, i AS qpos FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM (SELECT dataset, query_id, {toks('lower(text)')} AS l FROM stated))),
bs AS (
  SELECT q.dataset, q.query_id, p.chunk_id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 1.9 / (p.tf + 0.9 * (1 - 0.4 + 0.4 * p.dl / s.avgdl))), 9) AS score, min(qpos) AS f
  FROM qt q JOIN post p ON p.dataset = q.dataset AND p.term = q.term JOIN dfs d ON d.dataset = q.dataset AND d.term = q.term JOIN st s ON s.dataset = q.dataset GROUP BY q.dataset, q.query_id, p.chunk_id),
bm AS (SELECT dataset, query_id, chunk_id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY score DESC, f, chunk_id) AS r FROM bs) WHERE r <= {k})"""


def _vec(src: str, ids: str) -> str:
    return f"""(SELECT {ids}, b, count(*)::DOUBLE AS c FROM (SELECT {ids}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b FROM (SELECT {ids}, unnest({toks('lower(text)')}) AS w FROM {src})) GROUP BY ALL)"""


def dense(k: int) -> str:
    return f"""
qv AS {_vec('stated', 'dataset, query_id')}, cv AS {_vec('ch', 'dataset, chunk_id')},
qn AS (SELECT dataset, query_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY ALL), cn AS (SELECT dataset, chunk_id, sqrt(sum(c * c)) AS n FROM cv GROUP BY ALL),
allp AS (SELECT q.dataset, q.query_id, c.chunk_id FROM stated q JOIN ch c ON c.dataset = q.dataset),
dots AS (SELECT q.dataset, q.query_id, c.chunk_id, sum(q.c * c.c) AS s FROM qv q JOIN cv c ON c.dataset = q.dataset AND c.b = q.b GROUP BY ALL),
ds AS (SELECT a.dataset, a.query_id, a.chunk_id, round(coalesce(s / (qn.n * cn.n), 0), 9) AS score FROM allp a LEFT JOIN dots d USING (dataset, query_id, chunk_id) LEFT JOIN qn USING (dataset, query_id) LEFT JOIN cn USING (dataset, chunk_id)),
dn AS (SELECT dataset, query_id, chunk_id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY score DESC, chunk_id) AS r FROM ds) WHERE r <= {k})"""


HYBRID = """
fu AS (SELECT dataset, query_id, chunk_id, min(a) AS a, min(b) AS b FROM (SELECT dataset, query_id, chunk_id, rank AS a, NULL AS b FROM bm UNION ALL SELECT dataset, query_id, chunk_id, NULL, rank FROM dn) GROUP BY ALL),
fs AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0), 12) AS score FROM fu),
hy AS (SELECT dataset, query_id, chunk_id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY score DESC, a NULLS LAST, b NULLS LAST, chunk_id) AS r FROM fs) WHERE r <= 100)"""

RERANK = f"""
rr0 AS (SELECT b.dataset, b.query_id, b.chunk_id, b.rank AS old, list_distinct({toks('lower(q.text)')}) AS w, list_distinct({toks('lower(c.text)')}) AS p FROM bm b JOIN stated q USING (dataset, query_id) JOIN ch c USING (dataset, chunk_id) WHERE b.rank <= 50),
rr1 AS (SELECT *, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, p)) / len(w)::DOUBLE ELSE 0 END, 9) AS score FROM rr0),
rr AS (SELECT dataset, query_id, chunk_id, score, row_number() OVER (PARTITION BY dataset, query_id ORDER BY score DESC, old) AS rank FROM rr1)"""

DOCS = """
dr AS (SELECT dataset, query_id, doc_id, row_number() OVER (PARTITION BY dataset, query_id ORDER BY m) AS doc_rank FROM (SELECT dataset, query_id, string_split(chunk_id, '::')[1] AS doc_id, min(rank) AS m FROM bm GROUP BY ALL))"""

IR = """
dj AS (SELECT d.*, coalesce(q.rel, 0) AS rel FROM dr d LEFT JOIN qre q USING (dataset, query_id, doc_id)),
ag AS (SELECT dataset, query_id, count(*) FILTER (rel > 0 AND doc_rank <= 1) / 1.0 AS p1, count(*) FILTER (rel > 0 AND doc_rank <= 3) / 3.0 AS p3, count(*) FILTER (rel > 0 AND doc_rank <= 5) / 5.0 AS p5, count(*) FILTER (rel > 0 AND doc_rank <= 10) / 10.0 AS p10,
  min(CASE WHEN rel > 0 THEN doc_rank END) AS f, sum(CASE WHEN doc_rank <= 10 THEN (pow(2, rel) - 1) / log2(doc_rank + 1) END) AS dcg FROM dj GROUP BY ALL),
idl AS (SELECT dataset, query_id, sum((pow(2, rel) - 1) / log2(i + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY rel DESC) AS i FROM qre) WHERE i <= 10 GROUP BY ALL),
pq AS (SELECT s.dataset, s.query_id, coalesce(p1, 0)::DOUBLE AS "P@1", coalesce(p3, 0)::DOUBLE AS "P@3", coalesce(p5, 0)::DOUBLE AS "P@5", coalesce(p10, 0)::DOUBLE AS "P@10", coalesce(1.0 / f, 0)::DOUBLE AS "MRR", coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0)::DOUBLE AS "nDCG@10"
  FROM stated s LEFT JOIN ag USING (dataset, query_id) LEFT JOIN idl USING (dataset, query_id))"""

METRICS = ["P@1", "P@3", "P@5", "P@10", "MRR", "nDCG@10"]
MARKS = """
mk AS (SELECT dataset, config_id, query_id, coalesce(len(contexts) > 0, false)::INT AS context_relevance, coalesce(length(answer) > 20, false)::INT AS answer_faithfulness, coalesce(tokens_out > 8, false)::INT AS answer_relevance FROM gen),
lb AS (SELECT dataset, query_id, ('0x' || substr(md5(query_id), 1, 1))::INT % 2 AS context_relevance, ('0x' || substr(md5(query_id), 2, 1))::INT % 2 AS answer_faithfulness, ('0x' || substr(md5(query_id), 3, 1))::INT % 2 AS answer_relevance
  FROM que WHERE regexp_extract(query_id, '([0-9]+)$', 1) <> '' AND regexp_extract(query_id, '([0-9]+)$', 1)::BIGINT % 5 = 0),
la AS (SELECT dataset, query_id, ('0x' || substr(md5(query_id), 1, 1))::INT % 2 AS context_relevance, ('0x' || substr(md5(query_id), 2, 1))::INT % 2 AS answer_faithfulness, ('0x' || substr(md5(query_id), 3, 1))::INT % 2 AS answer_relevance FROM que)"""


def ppi(glob: bool) -> str:
    long = " UNION ALL ".join(f"SELECT dataset, config_id, query_id, '{d}' AS dim, {d}::DOUBLE AS m FROM mk" for d in DIMS)
    hum = " UNION ALL ".join(f"SELECT dataset, query_id, '{d}' AS dim, {d}::DOUBLE AS h FROM lb" for d in DIMS)
    rect = "SELECT dataset, dim, avg(h - m) AS r, var_samp(h - m) AS vr, count(h - m) AS k FROM j GROUP BY ALL" if glob else "SELECT dataset, config_id, dim, avg(h - m) AS r, var_samp(h - m) AS vr, count(h - m) AS k FROM j GROUP BY ALL"
    on = "dataset, dim" if glob else "dataset, config_id, dim"
    return f"""WITH {TABLES}, {MARKS}, lo AS ({long}), hu AS ({hum}), j AS (SELECT lo.*, h FROM lo LEFT JOIN hu USING (dataset, query_id, dim)),
      a AS (SELECT dataset, config_id, dim, avg(m) AS m, var_samp(m) AS vm, count(m) AS n FROM j GROUP BY ALL), r AS ({rect}),
      d AS (SELECT dataset, config_id, m, m + r AS p, {Z} * sqrt(vm / n + CASE WHEN k > 0 THEN vr / k END) AS half FROM a JOIN r USING ({on}))
      SELECT dataset, config_id, round(avg(coalesce(p, m)), 9) AS ares_composite, round(avg(p - half), 9) AS ares_ci_lo, round(avg(p + half), 9) AS ares_ci_hi FROM d GROUP BY ALL"""


def pairs(all_pairs: bool) -> str:
    names = [(a, b) for a in FRAMEWORKS for b in FRAMEWORKS] if all_pairs else [(FRAMEWORKS[0], FRAMEWORKS[1]), (FRAMEWORKS[0], FRAMEWORKS[2]), (FRAMEWORKS[1], FRAMEWORKS[2])]
    return " UNION ALL ".join(f"""SELECT dataset, config_id, '{a}' AS framework_a, '{b}' AS framework_b, "{a}" AS x, "{b}" AS y FROM summary""" for a, b in names)


def rho(src: str, by: str) -> str:
    """Spearman of src(by, x, y)."""
    return f"""SELECT {by}, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS spearman_rho, count(*) AS n FROM (
      SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry
      FROM {src} WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY {by}"""


PAIR_KEYS = "dataset, framework_a, framework_b"
BOOT = f"""
pl AS ({pairs(False)}), pt AS ({rho('pl', PAIR_KEYS)}),
rw AS (SELECT {PAIR_KEYS}, x, y, row_number() OVER (PARTITION BY {PAIR_KEYS} ORDER BY config_id) - 1 AS i, count(*) OVER (PARTITION BY {PAIR_KEYS}) AS n FROM pl WHERE x IS NOT NULL AND y IS NOT NULL),
sl AS (SELECT DISTINCT {PAIR_KEYS}, n, it, slot FROM rw, generate_series(0, 9999) g(it), generate_series(0, n - 1) s(slot)),
dw AS (SELECT s.dataset, s.framework_a, s.framework_b, s.it, r.x, r.y FROM sl s JOIN rw r ON r.dataset = s.dataset AND r.framework_a = s.framework_a AND r.framework_b = s.framework_b AND r.i = ('0x' || substr(md5(s.it || '|' || s.slot || '|42'), 1, 8))::BIGINT % s.n),
bo AS ({rho('dw', PAIR_KEYS + ', it')}),
rp AS (SELECT pt.dataset, pt.framework_a, pt.framework_b, pt.spearman_rho, b.n_boot, b.ci_lo, b.ci_hi FROM pt LEFT JOIN (SELECT {PAIR_KEYS}, count(*) AS n_boot, quantile_cont(spearman_rho::DOUBLE, 0.025) AS ci_lo, quantile_cont(spearman_rho::DOUBLE, 0.975) AS ci_hi FROM bo WHERE spearman_rho IS NOT NULL GROUP BY {PAIR_KEYS}) b USING ({PAIR_KEYS}))"""

FACTORS = """
fa AS (SELECT dataset, query_id, string_split(config_id, '__') AS f, round(latency_ms / 10) AS score FROM gen WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms)),
fl AS (SELECT dataset, query_id, 'chunking' AS variable, f[1] AS level, score FROM fa UNION ALL SELECT dataset, query_id, 'retrieval', f[2], score FROM fa UNION ALL SELECT dataset, query_id, 'rerank', f[3], score FROM fa),
fm AS (SELECT dataset, variable, level, query_id, avg(score) AS m FROM fl GROUP BY ALL),
ps AS (SELECT a.dataset, a.variable, a.query_id, a.level AS a, b.level AS b, a.m AS x, b.m AS y FROM fm a JOIN fm b ON a.dataset = b.dataset AND a.variable = b.variable AND a.query_id = b.query_id AND a.level < b.level)"""



def cells(digits: int | None = 9) -> str:
    """Per-query metrics of all twelve configs."""
    out = []
    for chunker, ch in (("fixed", chunks("ch", 256, 0)), ("semantic", packed("ch", 384))):
        for retriever, source in (("bm25", "bm"), ("dense", "dn"), ("hybrid", "hy")):
            for reranker, run in (("none", "base"), ("cross_encoder", "rr")):
                names = ", ".join(f'round("{x}", {digits}) AS "{x}"' if digits else f'"{x}"' for x in METRICS)
                out.append(
                    f"""SELECT * FROM (WITH RECURSIVE {TABLES}, {ch}, {bm25(200)}, {dense(200)}, {HYBRID}, base AS (SELECT * FROM {source} WHERE rank <= 100), {RERANK.replace('FROM bm b', 'FROM base b')},
                    run AS (SELECT dataset, query_id, chunk_id, rank FROM {run}), {DOCS.replace('FROM bm', 'FROM run')}, {IR}
                    SELECT '{chunker}' AS chunking, '{retriever}' AS retrieval, '{reranker}' AS rerank, dataset, query_id, {names}, '{chunker}__{retriever}__{reranker}' AS config_id FROM pq)"""
                )
    return " UNION ALL ".join(out)


SHEET = f"""
sh AS (SELECT dataset, query_id, question, {numbered('contexts')} AS contexts_shown, answer FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || query_id), query_id) AS r FROM gen WHERE config_id = 'fixed__hybrid__cross_encoder') WHERE r <= 200)"""

PROMPT = (
    'Answer the question using ONLY the provided context passages. If the context does not contain the answer, say "I cannot answer from the given context."',
    "Context:",
)


# Fixed value: the judge's prompt; § marks its slots.
JUDGE = """
You are evaluating a retrieval-augmented QA system. Given the
question, retrieved context, and generated answer, score each criterion 0 or 1.

Question: §q
Context: §c
Answer: §a

Criteria:
1. context_relevance: Is the context relevant to answering the question?
2. answer_faithfulness: Is the answer supported by the context (no hallucination)?
3. answer_relevance: Does the answer address the question?

Respond with ONLY a JSON object: {"context_relevance": 0 or 1,
"answer_faithfulness": 0 or 1, "answer_relevance": 0 or 1}
"""


def sql() -> dict[str, str]:
    c64 = chunks("ch", 64, 0)
    run = "SELECT dataset, query_id, chunk_id, score, rank FROM"
    bm = f"WITH {TABLES}, {c64}, {bm25(100)}"
    m = ", ".join(f'round("{x}", 9) AS "{x}"' for x in METRICS)
    s = ", ".join(f'round(avg("{x}"), 9) AS "ir_{x}"' for x in METRICS)
    nl = "chr(10)"
    prompt = f"'{PROMPT[0]}' || {nl} || {nl} || 'Context:' || {nl} || {numbered('contexts')} || {nl} || {nl} || 'Question: ' || coalesce(question, '') || {nl} || {nl} || 'Answer:'"
    judge = "replace(replace(replace('" + JUDGE.strip().replace("'", "''") + "', '§q', coalesce(question, '')), '§c', coalesce(array_to_string(contexts, chr(10)), '')), '§a', coalesce(answer, ''))"
    w = """
      vv AS (SELECT dataset, variable, a, b, abs(d) AS v, count(*) AS t, count(*) FILTER (d > 0) AS pos FROM (SELECT *, round(x - y, 9) AS d FROM ps) WHERE d <> 0 GROUP BY ALL),
      vr AS (SELECT *, sum(t) OVER (PARTITION BY dataset, variable, a, b ORDER BY v) - t + (t + 1) / 2.0 AS rk FROM vv),
      sm AS (SELECT dataset, variable, a, b, sum(rk * pos) AS plus, sum(rk * t) AS al FROM vr GROUP BY ALL),
      tt AS (SELECT dataset, variable, a, b, count(*) AS n, bool_and(abs(x - y) <= 1e-8 + 1e-5 * abs(y)) AS c FROM ps GROUP BY ALL)
      SELECT dataset, variable, a, b, CASE WHEN NOT c AND al IS NOT NULL THEN round(least(plus, al - plus), 9)::DOUBLE END AS "W", CASE WHEN c OR al IS NULL THEN 0.0 ELSE round(2 * plus / al - 1, 9) END::DOUBLE AS effect_r, n FROM tt LEFT JOIN sm USING (dataset, variable, a, b)"""
    # the tail of the normal distribution by Simpson's rule over twelve units
    tail = "0.003 / 3 * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i % 4000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs(z) + 0.003 * i, 2) / 2))) * sqrt(2 / pi())"
    attribution = f"""
      ww AS ({w[w.index('SELECT dataset, variable, a, b, CASE'):]}),
      zz AS (SELECT dataset, variable, a, b, sum(t)::DOUBLE AS m, sum(pow(t::DOUBLE, 3) - t) AS ties FROM vr GROUP BY ALL),
      pz AS (SELECT ww.*, CASE WHEN "W" IS NOT NULL THEN ("W" - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24) END AS z FROM ww LEFT JOIN zz USING (dataset, variable, a, b)),
      pp AS (SELECT dataset, variable, a, b, "W", effect_r, n, CASE WHEN "W" IS NULL THEN 1.0 ELSE {tail} END AS p FROM pz),
      st AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY p, variable, a, b) + 1)) AS s FROM pp),
      ad AS (SELECT dataset, variable, a, b, "W", p, effect_r, n, max(s) OVER (PARTITION BY dataset ORDER BY p, variable, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_adj FROM st)
      SELECT dataset, variable, a, b, "W", round(p, 9) AS p, effect_r, n, round(p_adj, 9) AS p_adj, p_adj < 0.05 AS significant FROM ad"""
    return {
        "p6_found": f"WITH {REFS} SELECT * FROM found",
        "p6_report": f"""WITH {REFS} SELECT r.table_name, r.ref_column, r.ref_month, r.n_references, coalesce(f.m, 0)::BIGINT AS n_missing, coalesce(f.l, 0)::BIGINT AS n_late, coalesce(f.d, 0)::BIGINT AS n_deleted,
              (coalesce(f.m, 0) + coalesce(f.l, 0) + coalesce(f.d, 0)) / r.n_references AS orphan_share
              FROM (SELECT table_name, ref_column, strftime(ts, '%Y-%m') AS ref_month, count(*) AS n_references FROM refs WHERE k IS NOT NULL GROUP BY ALL) r
              LEFT JOIN (SELECT table_name, ref_column, ref_month, count(*) FILTER (reason = 'missing') AS m, count(*) FILTER (reason = 'late') AS l, count(*) FILTER (reason = 'deleted') AS d FROM found GROUP BY ALL) f
              ON f.table_name = r.table_name AND f.ref_column = r.ref_column AND f.ref_month IS NOT DISTINCT FROM r.ref_month""",
        "config_matrix": "SELECT c || '__' || r || '__' || x AS config_id, c AS chunking, r AS retrieval, x AS rerank FROM (VALUES ('fixed'), ('semantic')) a(c), (VALUES ('bm25'), ('dense'), ('hybrid')) b(r), (VALUES ('none'), ('cross_encoder')) d(x)",
        "document_texts": f"WITH {TABLES} SELECT dataset, doc_id, doc_text, len({toks('doc_text')})::INT AS n_tokens FROM cor",
        "query_sample": f"WITH {TABLES} SELECT dataset, query_id, text FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || query_id), query_id) AS r FROM que WHERE EXISTS (SELECT 1 FROM qre WHERE qre.dataset = que.dataset AND qre.query_id = que.query_id)) WHERE r <= 100",
        "corpus_pool": f"""WITH {TABLES}, good AS (SELECT DISTINCT dataset, doc_id FROM qre WHERE rel > 0), re AS (SELECT dataset, doc_id FROM cor SEMI JOIN good USING (dataset, doc_id)),
              di AS (SELECT dataset, doc_id, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || doc_id), doc_id) AS r FROM cor ANTI JOIN good USING (dataset, doc_id)), n AS (SELECT dataset, count(*) AS n FROM re GROUP BY dataset)
              SELECT * FROM re UNION ALL SELECT dataset, doc_id FROM di LEFT JOIN n USING (dataset) WHERE r <= 300 - coalesce(n, 0)""",
        "chunk_fixed": f"WITH {TABLES}, {c64} SELECT * FROM ch",
        "chunk_sliding": f"WITH {TABLES}, {chunks('ch', 64, 16)} SELECT * FROM ch",
        "sentences": f"WITH {TABLES} SELECT dataset, doc_id, (i - 1)::INT AS sentence_no, l[i] AS sentence FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM (SELECT dataset, doc_id, {sents('doc_text')} AS l FROM cor))",
        "chunk_semantic_packed": f"WITH RECURSIVE {TABLES}, {packed('ch', 96)} SELECT * FROM ch",
        "chunk_semantic_embed": f"""WITH RECURSIVE {TABLES}, s0 AS (SELECT dataset, doc_id, i, l[i] AS s FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM (SELECT dataset, doc_id, {sents('doc_text')} AS l FROM cor))),
              s1 AS (SELECT *, len({toks('s')}) AS t, list_transform({toks('lower(s)')}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS bk FROM s0),
              s2 AS (SELECT *, list_transform(range(64), lambda b: len(list_filter(bk, lambda x: x = b))::DOUBLE) AS c FROM s1),
              s3 AS (SELECT *, sqrt(list_dot_product(c, c)) + 1e-9 AS w FROM s2),
              se AS (SELECT dataset, doc_id, i, s, t, list_transform(c, lambda x: x / w) AS v FROM s3),
              pk AS (SELECT dataset, doc_id, i, s, 0 AS c, t AS n, v FROM se WHERE i = 1
                UNION ALL SELECT dataset, doc_id, i, s, CASE WHEN nw THEN c + 1 ELSE c END, CASE WHEN nw THEN t ELSE n + t END, CASE WHEN nw THEN ev ELSE list_transform(list_zip(pv, ev), lambda z: z[1] + z[2]) END
                FROM (SELECT e.dataset, e.doc_id, e.i, e.s, e.t, e.v AS ev, p.c, p.n, p.v AS pv, (p.n + e.t > 384 OR list_dot_product(p.v, e.v) / (sqrt(list_dot_product(p.v, p.v)) + 1e-9) < 0.55) AS nw
                  FROM pk p JOIN se e ON e.dataset = p.dataset AND e.doc_id = p.doc_id AND e.i = p.i + 1))
              SELECT dataset, doc_id || '::c' || c AS chunk_id, doc_id, c::INT AS chunk_ix, string_agg(s, ' ' ORDER BY i) AS text FROM pk GROUP BY dataset, doc_id, c""",
        "bm25_index_stats": f"WITH {TABLES}, {c64} SELECT dataset, count(*) AS n_chunks, round(avg(len({toks('lower(text)')})), 6) AS avgdl FROM ch GROUP BY dataset",
        "bm25_document_frequency": f"WITH {TABLES}, {c64} SELECT dataset, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT dataset, chunk_id, term, count(*) AS tf FROM (SELECT dataset, chunk_id, unnest({toks('lower(text)')}) AS term FROM ch) GROUP BY ALL) GROUP BY ALL",
        "bm25_topk": f"{bm} {run} bm",
        "dense_topk_text": f"WITH {TABLES}, {c64}, {dense(100)} {run} dn",
        "dense_topk": """WITH p AS (SELECT q.vec_id AS query_vec, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
              SELECT query_vec, vec_id, s AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_vec ORDER BY s DESC, vec_id) AS r FROM p) WHERE r <= 20""",
        "hybrid_rrf": f"WITH {TABLES}, {c64}, {bm25(200)}, {dense(200)}, {HYBRID} {run} hy",
        "rerank_topk": f"{bm}, {RERANK} {run} rr",
        "run_to_documents": f"{bm}, {DOCS} SELECT * FROM dr",
        "ir_per_query": f"{bm}, {DOCS}, {IR} SELECT dataset, query_id, {m} FROM pq",
        "ir_summary": f"{bm}, {DOCS}, {IR} SELECT dataset, count(*) AS n_queries, {s} FROM pq GROUP BY dataset",
        "cell_ir_per_query": cells(),
        "cell_ir_summary": f"SELECT dataset, config_id, chunking, retrieval, rerank, count(*) AS n_queries, {s} FROM ({cells(None)}) GROUP BY ALL",
        "contexts_top5": f"{bm} SELECT dataset, query_id, count(*)::INT AS n_contexts, string_agg(c.text, chr(10) ORDER BY b.rank) AS joined FROM bm b JOIN ch c USING (dataset, chunk_id) WHERE b.rank <= 5 GROUP BY dataset, query_id",
        "prompt_build": f"WITH {TABLES} SELECT dataset, config_id, query_id, md5({prompt}) AS prompt_md5 FROM gen",
        "gen_cost_latency": f"WITH {TABLES} SELECT dataset, config_id, round(avg(CASE WHEN NOT isnan(latency_ms) THEN latency_ms END), 6) AS mean_latency_ms, round(avg((tokens_in::DOUBLE * 0.15::DOUBLE + tokens_out::DOUBLE * 0.6::DOUBLE) / 1e6 * 0.92::DOUBLE) * 1000, 9) AS cost_eur_per_1k, count(*) AS n_calls FROM gen GROUP BY ALL",
        "llm_cache_misses": f"WITH {TABLES}, k AS (SELECT sha256('{{\"c\":' || coalesce(to_json(contexts), 'null') || ',\"m\":\"offline\",\"q\":' || coalesce(to_json(question), 'null') || ',\"t\":0.0}}') AS key, cached FROM gen) SELECT DISTINCT key FROM k WHERE NOT cached AND key NOT IN (SELECT key FROM k WHERE cached)",
        "judge_prompts": f"WITH {TABLES} SELECT dataset, config_id, query_id, md5({judge}) AS prompt_md5 FROM gen",
        "judge_parse": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 2) END::INT AS context_relevance, CASE WHEN event_id % 7 <> 0 AND event_id % 3 = 0 THEN 1 ELSE 0 END::INT AS answer_faithfulness, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 2 END::INT AS answer_relevance FROM events",
        "judge_composite": f"WITH {TABLES}, {MARKS} SELECT dataset, config_id, round((avg(context_relevance) + avg(answer_faithfulness) + avg(answer_relevance)) / 3, 9) AS ares_composite, count(*) AS n_judged FROM mk GROUP BY ALL",
        "ppi_by_config": ppi(False),
        "ppi_global": ppi(True),
        "ragas_faithfulness": f"WITH {TABLES} SELECT dataset, query_id, round(avg((rel > 0)::INT), 9) AS ragas_faithfulness FROM qre GROUP BY ALL",
        "ragas_context_precision": f"WITH {TABLES}, v AS (SELECT dataset, query_id, row_number() OVER (PARTITION BY dataset, query_id ORDER BY doc_id) AS rk, (rel > 0)::INT AS v FROM qre), c AS (SELECT *, v * sum(v) OVER (PARTITION BY dataset, query_id ORDER BY rk) / rk AS p FROM v) SELECT dataset, query_id, round(coalesce(sum(p) / nullif(sum(v), 0), 0), 9)::DOUBLE AS ragas_context_relevancy FROM c GROUP BY ALL",
        "ragas_answer_relevancy": f"WITH {TABLES} SELECT dataset, query_id, round(avg((coalesce(tokens_out, 0) % 100) / 100) * CASE WHEN min(CASE WHEN length(answer) > 20 THEN 0 ELSE 1 END) = 1 THEN 0 ELSE 1 END, 9) AS ragas_answer_relevancy FROM gen GROUP BY ALL",
        "spearman_matrix": f"WITH pl AS ({pairs(True)}), r AS ({rho('pl', PAIR_KEYS)}) SELECT {PAIR_KEYS}, round(spearman_rho, 9) AS spearman_rho, n FROM r",
        "bootstrap_spearman_md5": f"WITH {BOOT} SELECT {PAIR_KEYS}, round(spearman_rho, 9) AS spearman_rho, n_boot, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi FROM rp",
        "agreement_pattern_shift": f"""WITH {BOOT} SELECT a.framework_a, a.framework_b, round(a.spearman_rho, 9) AS rho_msmarco, round(b.spearman_rho, 9) AS rho_nq, round(b.spearman_rho - a.spearman_rho, 9) AS delta, NOT (coalesce(a.ci_hi < b.ci_lo, false) OR coalesce(b.ci_hi < a.ci_lo, false)) AS ci_overlap
              FROM rp a LEFT JOIN rp b ON b.dataset = 'nq' AND a.framework_a = b.framework_a AND a.framework_b = b.framework_b WHERE a.dataset = 'msmarco'""",
        "cross_dataset_stability": "WITH pl AS ("
        + " UNION ALL ".join(f"""SELECT '{f}' AS framework, a."{f}" AS x, b."{f}" AS y FROM summary a JOIN summary b ON a.config_id = b.config_id AND a.dataset = 'msmarco' AND b.dataset = 'nq'""" for f in FRAMEWORKS)
        + f"), r AS ({rho('pl', 'framework')}) SELECT framework, round(spearman_rho, 9) AS rho_cross_dataset, n FROM r",
        "paired_factor_scores": f"WITH {TABLES}, {FACTORS} SELECT dataset, variable, query_id, a, b, round(x, 9) AS x, round(y, 9) AS y FROM ps",
        "wilcoxon_w": f"WITH {TABLES}, {FACTORS}, {w}",
        "variable_attribution": f"WITH {TABLES}, {FACTORS}, {w[: w.index('SELECT dataset, variable, a, b, CASE')].rstrip()}, {attribution}",
        "label_inputs": "SELECT event_id, CASE WHEN event_id % 5 > 0 AND event_id % 3 < 2 THEN (event_id % 2)::VARCHAR || (event_id % 3)::VARCHAR || '1' END AS marks FROM events",
        "holm_bonferroni": f"""WITH {TABLES}, t AS (SELECT dataset, config_id, avg((coalesce(tokens_out, 0) > 200)::INT) / 20 AS p FROM gen GROUP BY ALL),
              s AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY p, config_id) + 1)) AS st FROM t),
              h AS (SELECT dataset, config_id, p, max(st) OVER (PARTITION BY dataset ORDER BY p, config_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_adj FROM s) SELECT dataset, config_id, round(p, 9) AS p, round(p_adj, 9) AS p_adj, p_adj < 0.05 AS significant FROM h""",
        "score_cube": 'SELECT chunking, retrieval, rerank, round(avg("ir_nDCG@10"), 9) AS mean_ndcg, round(avg(ragas_faithfulness), 9) AS mean_faithfulness, count(*) AS n_cells FROM summary GROUP BY CUBE (chunking, retrieval, rerank)',
        "latency_summary": f"WITH {TABLES} SELECT dataset, config_id, round(quantile_cont(latency_ms, 0.025), 6) AS lo, round(quantile_cont(latency_ms, 0.5), 6) AS median, round(quantile_cont(latency_ms, 0.975), 6) AS hi FROM gen WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) GROUP BY ALL",
        "annotation_sheet": f"WITH {TABLES}, {SHEET} SELECT dataset, query_id, question, md5(contexts_shown) AS contexts_shown, answer, '' AS context_relevance, '' AS answer_faithfulness, '' AS answer_relevance FROM sh",
        "label_upsert": f"WITH {TABLES}, {MARKS} SELECT dataset, query_id, context_relevance, answer_faithfulness, CASE WHEN context_relevance = 1 THEN 1 - answer_relevance ELSE answer_relevance END AS answer_relevance, CASE WHEN context_relevance = 1 THEN 2 ELSE 1 END::BIGINT AS seq FROM la",
        "labels_remaining": f"WITH {TABLES}, {MARKS}, {SHEET} SELECT dataset, query_id FROM sh WHERE NOT EXISTS (SELECT 1 FROM lb WHERE lb.dataset = sh.dataset AND lb.query_id = sh.query_id)",
    }
