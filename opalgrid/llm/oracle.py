"""DuckDB SQL for the corpus queries that SQL can express."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UP}', '{LOW}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source
), w AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s
), f AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / w::DOUBLE, rk) AS place,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
          - coalesce(CAST(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / CAST(sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM w
), l AS (SELECT arg_min(level, place) AS level FROM f WHERE 2 * source_size > level * w
), t AS (
  SELECT f.source, source_size, coalesce(least(CAST(2 * source_size AS DOUBLE), l.level * w), CAST(2 * source_size AS DOUBLE)) AS target FROM f LEFT JOIN l ON true
), e AS (
  SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target,
         least(CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END, 2.0)::DOUBLE AS x
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(x) AS whole, x - floor(x) AS p FROM e
), r AS (
  SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) ELSE 1.0 END AS place FROM p
), c AS (
  SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS lack,
         sum(CASE WHEN whole < 2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r
), x AS (SELECT *, CASE WHEN whole < 2 AND upto <= greatest(lack, 0) THEN 1 ELSE 0 END AS extra FROM c
), g AS (SELECT *, greatest(lack, 0) - sum(size * extra) OVER (PARTITION BY source) AS left_over FROM x
), z AS (
  SELECT source, arg_min(doc_id, (abs(size - left_over), place, doc_id)) AS closing FROM g
  WHERE whole < 2 AND extra = 0 AND abs(size - left_over) < abs(left_over) GROUP BY source
)
SELECT g.doc_id, g.size, g.source_size, g.target,
       CAST((g.whole + g.extra + CASE WHEN g.extra = 0 AND g.whole < 2 AND g.doc_id IS NOT DISTINCT FROM z.closing THEN 1 ELSE 0 END) * g.size AS BIGINT) AS taken
FROM g LEFT JOIN z ON g.source IS NOT DISTINCT FROM z.source
"""

OP5 = f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UP}', '{LOW}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN EXISTS (
    SELECT 1 FROM (SELECT n || '.example.' || e AS listed
                   FROM unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS a(n), unnest(['com', 'net', 'org']) AS b(e)) AS l
    WHERE host = listed OR ends_with(host, '.' || listed)) THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""

OP11 = """
WITH p AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM p AS a JOIN p AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM pos JOIN s ON pos.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP12 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{UP}234567',
         CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM g
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), e AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') AS s
  FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""

SQL = {"op3_exact_dedup": OP3, "op4_mixing": OP4, "op5_url_filter": OP5, "op11_hard_negatives": OP11, "op12_warc": OP12, "op13_fill_in_middle": OP13}
