"""SQL that checks the training-data queries."""

_USABLE = """SELECT DISTINCT track_id, dataset, image_id, lower(trim(category)) AS category, lower(trim(tier)) AS tier, p
FROM tracks WHERE track_id IS NOT NULL AND p IS NOT NULL AND NOT isnan(p) AND p BETWEEN 0 AND 1"""

_RANKED = f"""WITH u AS ({_USABLE}), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, category, tier
ORDER BY p DESC, image_id NULLS FIRST, track_id) AS rank FROM u WHERE tier IS NOT NULL)"""

P4_FOUND = f"{_RANKED} SELECT track_id FROM r WHERE rank <= 5"
P4_TOP = f"{_RANKED} SELECT dataset, category, tier, rank, track_id, image_id, p FROM r WHERE rank <= 5"

_CUT = f"""WITH u AS ({_USABLE}), w AS (SELECT DISTINCT dataset, track_id, p FROM u WHERE category = 'weapons'),
h AS (SELECT dataset, arg_max(keep_review_pm, fitted_at) AS review, arg_max(keep_violation_pm, fitted_at) AS violation
      FROM (SELECT DISTINCT dataset, keep_review_pm, keep_violation_pm, fitted_at FROM weapons_heads) GROUP BY dataset),
t AS (SELECT dataset, 'review' AS band, review AS keep_pm FROM h WHERE review IS NOT NULL
      UNION ALL SELECT dataset, 'violation', violation FROM h WHERE violation IS NOT NULL),
c AS (SELECT dataset, p, count(*) AS n FROM w GROUP BY dataset, p),
k AS (SELECT dataset, p, n, sum(n) OVER (PARTITION BY dataset ORDER BY p DESC) AS kept, sum(n) OVER (PARTITION BY dataset) AS n_rows FROM c),
f AS (SELECT t.dataset, t.band, max(p) AS cutoff, min(kept) AS n_kept, arg_max(n, p) AS n_ties
      FROM t JOIN k USING (dataset) WHERE kept * 1000 >= n_rows * keep_pm GROUP BY t.dataset, t.band)"""
P5_FOUND = f"{_CUT} SELECT f.band, w.track_id FROM w JOIN f USING (dataset) WHERE w.p >= f.cutoff"
P5_CUTOFFS = f"""{_CUT} SELECT t.dataset, t.band, t.keep_pm, coalesce((SELECT max(n_rows) FROM k WHERE k.dataset = t.dataset), 0)::BIGINT AS n_rows,
f.cutoff, coalesce(f.n_kept, 0)::BIGINT AS n_kept, coalesce(f.n_ties, 0)::BIGINT AS n_ties FROM t LEFT JOIN f ON f.dataset = t.dataset AND f.band = t.band"""

_B = r"[\s\x1c-\x1f\x85\pZ]"
_STATS = rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(
    regexp_replace(coalesce(text, ''), '<[^<>\r\n]*>|\{{[^{{}}\r\n]*\}}|\x{{FEFF}}', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
    lambda x: regexp_replace(x, '^{_B}+|{_B}+$', '', 'g')),
    lambda x: x <> '' AND NOT contains(x, '-->') AND NOT regexp_matches(x, '^[0-9]+$') AND x <> 'WEBVTT') AS lines FROM documents),
b AS (SELECT doc_id, len(lines) AS n_lines, array_to_string(lines, chr(10)) AS body,
      len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…]["''“”„‘’‚«»‹›]*$'))) AS ended FROM l),
w AS (SELECT *, regexp_extract_all(body, '\pL+') AS words, (SELECT list(DISTINCT lower(word)) FROM common_words) AS known FROM b),
m AS (SELECT doc_id, n_lines, len(words) AS n_words, length(array_to_string(words, '')) AS letters,
      length(regexp_replace(body, '{_B}+', '', 'g')) AS nonblank, ended,
      len(list_filter(words, lambda x: list_contains(known, lower(x)))) AS common FROM w),
s AS (SELECT doc_id, n_lines::INT AS n_lines, n_words::INT AS n_words, CASE WHEN n_words > 0 THEN letters / n_words END AS mean_word_len,
      CASE WHEN nonblank > 0 THEN (nonblank - letters) / nonblank END AS nonletter_share, CASE WHEN n_lines > 0 THEN ended / n_lines END AS end_share,
      CASE WHEN n_words > 0 THEN common / n_words END AS common_share, CASE WHEN n_lines > 0 THEN n_words / n_lines END AS words_per_line FROM m)"""
P8_STATS = f"{_STATS} SELECT * FROM s"
P8_FOUND = f"""{_STATS} SELECT doc_id FROM s WHERE n_words = 0 OR common_share < 0.30 OR nonletter_share > 0.50 OR mean_word_len > 10
OR (words_per_line < 3 AND end_share < 0.20)"""

_SPEECH = r"""WITH t AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '<[^<>\n]*>|\{[^{}\n]*\}|\x{FEFF}', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, regexp_replace(t, '(?m)^(?:[^\S\n]*[0-9]+[^\S\n]*|.*-->.*|[^\S\n]*WEBVTT.*)$', '', 'g') AS t FROM t),
b AS (SELECT doc_id, regexp_replace(t, '\[[^\[\]]*\]|\([^()]*\)', ' ', 'g') AS t FROM n),
k AS (SELECT doc_id, regexp_replace(t, '(?m)^[^\S\n]*(?:[-–—][^\S\n]*)?[A-ZÀ-ÖØ-ÞŒŸ][A-ZÀ-ÖØ-ÞŒŸ0-9 .''’\-]*:', ' ', 'g') AS t FROM b),
w AS (SELECT doc_id, regexp_extract_all(lower(t), '\pL+') AS w FROM k),
i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(item_text, '<[^<>\n]*>|\{[^{}\n]*\}', '', 'g')), '\pL+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM w)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM i))"""
P6_FOUND = f"{_SPEECH} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"

_VEC = """WITH v AS (SELECT rec_id, dataset, commit_id, lower(trim(image_id)) AS key, list_transform(emb, lambda x: x::DOUBLE) AS e FROM images
    WHERE emb IS NOT NULL AND len(emb) = 64 AND NOT list_bool_or(list_transform(emb, lambda x: isnan(x))) AND list_bool_or(list_transform(emb, lambda x: x <> 0)))"""
P3_FOUND = f"""{_VEC}, q AS (SELECT v.* FROM v JOIN (SELECT DISTINCT rec_id FROM sim_probes) USING (rec_id)),
s AS (SELECT q.rec_id AS a, v.rec_id AS b, list_cosine_similarity(q.e, v.e) AS c FROM q JOIN v ON q.key <> v.key),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS rec_a, greatest(a, b) AS rec_b FROM r WHERE k <= 5"""
P3_NEIGHBOURS = f"""{_VEC}, q AS (SELECT * FROM v WHERE rec_id % 20 = 0),
s AS (SELECT q.rec_id AS q_id, v.rec_id, list_cosine_similarity(q.e, v.e) AS c FROM q JOIN v ON q.rec_id <> v.rec_id AND q.key IS DISTINCT FROM v.key),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(c, 12) DESC, rec_id) AS rank FROM s)
SELECT q_id, rec_id, rank::INT AS rank, round(c, 6) AS cosine FROM r WHERE rank <= 5"""

_GROUPS = f"""{_VEC}, e AS (SELECT a.rec_id AS a, b.rec_id AS b FROM v a JOIN v b ON a.dataset IS NOT DISTINCT FROM b.dataset
    WHERE list_cosine_similarity(a.e, b.e) >= 0.73 OR a.rec_id = b.rec_id),
n AS (SELECT a, list(b ORDER BY b) AS near FROM e GROUP BY a),
g AS (SELECT near FROM n GROUP BY near HAVING count(*) = len(near) AND count(*) >= 3)"""
P2_FOUND = f"{_GROUPS} SELECT near[1] AS head_rec_id, unnest(near) AS rec_id FROM g"

P2_CLUSTERS = f"""{_GROUPS}, m AS (SELECT near[1] AS head_rec_id, len(near)::BIGINT AS size, unnest(near) AS rec_id FROM g),
u AS (SELECT m.*, list_transform(v.e, lambda x: x / sqrt(list_dot_product(v.e, v.e))) AS e FROM m JOIN v USING (rec_id)),
d AS (SELECT head_rec_id, i, sum(e[i]) AS s FROM u, range(1, 65) t(i) GROUP BY head_rec_id, i),
c AS (SELECT head_rec_id, list(s ORDER BY i) AS c FROM d GROUP BY head_rec_id),
r AS (SELECT u.head_rec_id, size, rec_id, row_number() OVER (PARTITION BY u.head_rec_id
      ORDER BY round(list_dot_product(u.e, c.c) / sqrt(list_dot_product(c.c, c.c)), 12) DESC, rec_id) AS k FROM u JOIN c USING (head_rec_id))
SELECT head_rec_id, size, string_agg(rec_id::VARCHAR, ',' ORDER BY k) AS typical FROM r WHERE k <= 3 GROUP BY head_rec_id, size"""
