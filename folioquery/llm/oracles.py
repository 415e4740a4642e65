"""DuckDB SQL for the corpus queries that SQL can express on whole tables.

The others (offsets of matches, byte windows, compressors, page trees, hash
thresholds) are held against plain versions in the tests.
"""

_FOLD = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPACED.format(t="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT r, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
rep AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + unnest(generate_series(0, 34)) AS i FROM h WHERE h IN (FROM rep)),
listed AS (SELECT r, list(i) AS g FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_select(w, list_sort(list_filter(generate_series(1, len(w)), lambda x: NOT list_contains(g, x)))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN listed USING (r)"""

OP5 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_SPACED.format(t=_FOLD.format(t="coalesce(text, '')"))} AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT x.r AS x, y.r AS y, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.r < y.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, e.y FROM c JOIN e ON c.b = e.x),
k AS (SELECT x, count(*) AS k FROM e GROUP BY x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id, coalesce(any_value(k.k), 0) AS n_links FROM d LEFT JOIN n USING (r) LEFT JOIN k ON k.x = d.r JOIN c ON c.a = d.r JOIN d o ON o.r = c.b GROUP BY d.r, d.doc_id"""

OP6 = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP7 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPACED.format(t=_FOLD.format(t="coalesce(text, '')"))} AS w,
  CAST(doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS INTEGER) AS mine FROM documents),
t AS (SELECT r, mine, unnest(list_prepend('s', list_transform(w, lambda x: 'w' || x))) AS tok, unnest(generate_series(0, len(w))) AS i FROM d WHERE len(w) > 0),
c AS (SELECT tok, count(*) AS e, sum(mine) AS g FROM t GROUP BY tok),
n AS (SELECT sum(e) AS n_e, sum(g) AS n_g, count(*) FILTER (e >= 3) AS v FROM c),
m AS (SELECT r, i, mine, CASE WHEN e >= 3 THEN tok ELSE 'u' END AS y FROM t JOIN c USING (tok)),
p AS (SELECT r, i, mine, y, lag(y) OVER (PARTITION BY r ORDER BY i) AS x FROM m),
cw AS (SELECT y, count(*) AS e, sum(mine) AS g FROM m GROUP BY y),
ow AS (SELECT r, y, count(*) AS o FROM m GROUP BY r, y),
cp AS (SELECT x, y, count(*) AS e, sum(mine) AS g FROM p WHERE i > 0 GROUP BY x, y),
op AS (SELECT r, x, y, count(*) AS o FROM p WHERE i > 0 GROUP BY r, x, y),
k AS (SELECT p.r, len(d.w) AS n,
  (cp.e - op.o + 4.0 * ((cw.e - ow.o + 0.5) / (n_e - len(d.w) - 1 + 0.5 * (v + 1)))) / (cx.e - ox.o + 4.0) AS b,
  (cp.g - d.mine * op.o + 4.0 * ((cw.g - d.mine * ow.o + 0.5) / (n_g - d.mine * (len(d.w) + 1) + 0.5 * (v + 1)))) / (cx.g - d.mine * ox.o + 4.0) AS a
  FROM p JOIN d USING (r) CROSS JOIN n JOIN cw ON cw.y = p.y JOIN cw cx ON cx.y = p.x JOIN ow ON ow.r = p.r AND ow.y = p.y JOIN ow ox ON ox.r = p.r AND ox.y = p.x
  JOIN cp ON cp.x = p.x AND cp.y = p.y JOIN op ON op.r = p.r AND op.x = p.x AND op.y = p.y WHERE p.i > 0),
l AS (SELECT r, -sum(log2(a)) / any_value(n) AS a, -sum(log2(b)) / any_value(n) AS b FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(a, 0.0), 6) AS loss_target, round(coalesce(b, 0.0), 6) AS loss_background, round(coalesce(a - b, 0.0), 6) AS score FROM d LEFT JOIN l USING (r)"""

OP9 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format(t=_FOLD.format(t="coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format(t=_FOLD.format(t="coalesce(text, '')"))} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM k),
s AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, s.n, i, item_id FROM s JOIN k USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, i + unnest(generate_series(0, n - 1)) AS p FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

OP11 = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_SPACED.format(t="coalesce(text, '')")} AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
g AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
  100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > least, false)] AS f FROM d JOIN m USING (t) LEFT JOIN g ON g.doc_id = d.doc_id),
c AS (SELECT part, f, len(list_filter(f, lambda b: b)) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY part, f),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || l FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(l) WHERE NOT contains(filter_order, l)),
s AS (SELECT filter_order, step, strpos('ABCDE', filter_order[step]) AS i FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
k AS (SELECT part, filter_order, step, i, n, good, toxic, fails, f[i] AS here, len(list_filter(range(1, step), lambda j: f[strpos('ABCDE', filter_order[j])])) > 0 AS before FROM s, c),
a AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, any_value(i) AS i,
  CAST(sum(CASE WHEN here OR before THEN 0 ELSE n END) AS BIGINT) AS kept, CAST(sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN here AND before THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN here AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN here AND NOT before THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM k GROUP BY part, filter_order, step)
SELECT * EXCLUDE (i), CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM a"""

OP12 = f"""WITH u AS (SELECT row_number() OVER () AS r, page_id, {_FOLD.format(t="regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
k(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM u JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (r)"""


def _clusters(rounds: int) -> str:
    """One step of assignment and one of centroids a round, then the last assignment."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM
  (SELECT r, c, list_inner_product(v.e, v.e) + list_inner_product(c{i}.e, c{i}.e) - 2 * list_inner_product(v.e, c{i}.e) AS d FROM v, c{i})) WHERE n = 1)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(len(e))) AS i FROM a{i} JOIN v USING (r)) GROUP BY c, i),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS e FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n".join(steps)


OP13 = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS c, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT 16)),
{_clusters(3)}
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c3.e, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM v JOIN a3 USING (r) JOIN c3 USING (c)"""

ORACLES = {"op1_substring_dedup": OP1, "op5_ngram_jaccard_join": OP5, "op6_exact_topk": OP6, "op7_lm_scoring": OP7, "op9_benchmark_decontamination": OP9, "op11_filter_audit": OP11, "op12_url_filter": OP12, "op13_centroid_clustering": OP13}
