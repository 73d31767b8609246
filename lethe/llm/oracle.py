"""DuckDB SQL for those queries of this package that SQL can express."""

_ALNUM = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP9 = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS t FROM documents),
u AS (SELECT *, (CAST(('0x' || substr(md5(concat_ws('|', '17', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), t)), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / w AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM w),
l AS (SELECT arg_min((total - below) / rest, ratio) AS level FROM f WHERE (total - below) / rest <= ratio),
g AS (SELECT source, source_size, least(cap, level * w) AS target FROM f, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM g),
r AS (SELECT *, target - base * source_size AS rem FROM b),
h AS (SELECT d.source, d.size, count(*) AS n, any_value(rem) AS rem, CAST(ceil(sqrt(d.size::DOUBLE)) AS BIGINT) AS g FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source WHERE d.size > 0 GROUP BY d.source, d.size),
c AS (SELECT *, (rem - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(g * size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS c FROM h),
k AS (SELECT source, arg_max(c, size) AS c FROM c WHERE c * g <= 1.0 GROUP BY source),
p AS (SELECT u.*, r.source_size, r.target, r.base, r.rem, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(k.c, 1.0::DOUBLE) * ceil(sqrt(u.size::DOUBLE)))) AS p
      FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source LEFT JOIN k ON u.source IS NOT DISTINCT FROM k.source),
v AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN 1 ELSE ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS v FROM p),
x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, CAST(doc_id AS VARCHAR) NULLS FIRST, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM v)
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN rem > 0 AND upto - size / 2.0::DOUBLE <= rem THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""

OP5 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3, "op5_warc": OP5, "op9_mixing": OP9}
