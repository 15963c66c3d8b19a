"""Plain SQL of the queries that SQL can express on whole tables.

The others have none: fingerprints (op2), compression (op3), page parsing (op4), narrowing medians (op5), trained models
(op6, op9), the tokenizer (op7), checksums that choose a document's words (op13) and the pipeline made of them. They are tested against brute force in tests/llm.
"""

from nnfield.llm.audit import MAX_CAPITALS_PERCENT, MIN_DISTINCT_PERCENT, MIN_WORDS, SPECIAL
from nnfield.llm.decontamination import WINDOW as BENCHMARK_WINDOW
from nnfield.llm.minhash import PERCENT, SHINGLE
from nnfield.llm.substrings import WINDOW
from nnfield.llm.topk import EVERY, K

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRINGS = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i : i + {WINDOW - 1}] AS k FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS r(i)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM dup, range({WINDOW}) AS s(j)
), word AS (
  SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS r(i)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), starts AS (
  SELECT doc_id, count(*) AS n_factors FROM (
    SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone
  ) WHERE before IS NULL OR before < i - 1 GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256, CAST(coalesce(n_factors, 0) AS BIGINT) AS n_factors
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN starts USING (doc_id)
"""

TOPK = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM e) AS q JOIN e AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""

# The longest verbatim match of a document is the longest chain of windows that stand side by side in it and in one item.
CONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, i, least(len(w), {BENCHMARK_WINDOW}) AS n, w[i : i + least(len(w), {BENCHMARK_WINDOW}) - 1] AS k
  FROM b, unnest(range(1, greatest(len(w) - {BENCHMARK_WINDOW - 1}, 1) + 1)) AS r(i) WHERE len(w) > 0
), win AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS k FROM d, (SELECT DISTINCT n FROM item) AS l, unnest(range(1, len(w) - n + 2)) AS r(i)
), hit AS (
  SELECT doc_id, win.i, win.n, item, item.i AS place FROM win JOIN item USING (n, k)
), words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + j AS i FROM hit, unnest(range(n)) AS s(j)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
), chain AS (
  SELECT doc_id, n + count(*) - 1 AS long FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, n, i - place ORDER BY i) AS run FROM hit
  ) GROUP BY doc_id, item, n, i - place, run
), longest AS (SELECT doc_id, max(long) AS longest FROM chain GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

AUDIT = rf"""
WITH text AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fail AS (
  SELECT doc_id, part,
         if(len(w) < {MIN_WORDS}, 1, 0) + if(100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w), 2, 0)
         + if(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(t), 4, 0)
         + if(regexp_matches(t, '{SPECIAL}'), 8, 0) + if(coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false), 16, 0) AS bits
  FROM text
), label AS (
  SELECT doc_id, max(if(quality = 1, 1, 0)) AS good, max(if(toxic = 1, 1, 0)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), combination AS (
  SELECT part, bits, count(*) AS docs, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM fail LEFT JOIN label USING (doc_id) GROUP BY part, bits
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter AS a, letter AS b, letter AS c, letter AS d, letter AS e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, 1 << (ascii(filter_order[i]) - 65) AS bit,
         list_sum(list_transform(range(1, i), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS sums
  FROM orders, unnest(range(1, 6)) AS r(i)
), step AS (SELECT filter_order, step, bit, CAST(coalesce(sums, 0) AS INTEGER) AS before FROM steps)
SELECT part, filter_order, step,
       CAST(sum(if(bits & (before | bit) = 0, docs, 0)) AS BIGINT) AS kept,
       CAST(sum(if(bits & bit > 0 AND bits & before = 0, docs, 0)) AS BIGINT) AS removed,
       CAST(sum(if(bits & bit > 0 AND bits & before > 0, docs, 0)) AS BIGINT) AS redundant,
       CAST(sum(if(bits = bit, docs, 0)) AS BIGINT) AS unique_fails,
       CAST(sum(if(bits & bit > 0 AND bits & before = 0, good, 0)) AS BIGINT) AS good_lost,
       CAST(sum(if(bits & bit > 0 AND bits & before = 0, toxic, 0)) AS BIGINT) AS toxic_lost,
       CAST(sum(if(bits & bit > 0, docs * (120 // bit_count(bits)), 0)) AS BIGINT) AS shapley
FROM combination, step GROUP BY part, filter_order, step
"""

# Links are counted on numbers of distinct shingles; reach walks them from every document.
NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(if(len(w) < {SHINGLE}, list_filter([array_to_string(w, ' ')], lambda x: len(w) > 0),
         list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))))) AS s FROM d
), class AS (SELECT s, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s
), item AS (SELECT node, len(s) AS n, unnest(s) AS x FROM class
), pair AS (
  SELECT a.node AS a, b.node AS b FROM item AS a JOIN item AS b ON a.x = b.x AND a.node <> b.node
  GROUP BY a.node, b.node HAVING 100 * count(*) >= {PERCENT} * (max(a.n) + max(b.n) - count(*))
), reach(node, found) AS (
  SELECT node, node FROM class UNION SELECT reach.node, pair.b FROM reach JOIN pair ON reach.found = pair.a
), least AS (SELECT node, min(found) AS component_id FROM reach GROUP BY node)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id,
       sets.doc_id = coalesce(component_id, sets.doc_id) AS kept
FROM sets LEFT JOIN class ON sets.s = class.s LEFT JOIN least USING (node)
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": SUBSTRINGS,
    "op8_exact_topk": TOPK,
    "op10_benchmark_decontamination": CONTAMINATION,
    "op11_minhash_near_dedup": NEAR,
    "op12_filter_audit": AUDIT,
}
