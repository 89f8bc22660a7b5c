"""Equivalent DuckDB SQL of the pN_ queries that SQL can express, by definition rather than by the operators' method."""

from __future__ import annotations

_SOUND = """
sound AS (
  SELECT DISTINCT vec_id, s.space, list_transform(x, lambda v: v::DOUBLE) AS x
  FROM space_x s JOIN (SELECT DISTINCT space, n_dims FROM labelfree_spaces) d ON s.space = d.space
  WHERE x IS NOT NULL AND len(x) = n_dims
    AND len(list_filter(x, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0
),
unit AS (SELECT vec_id, space, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u FROM sound),
sims AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.space AS space, round(list_dot_product(a.u, b.u), 6) AS sim
  FROM unit a JOIN unit b ON a.space = b.space AND a.vec_id <> b.vec_id
)"""

_P1 = f"""WITH {_SOUND},
best AS (SELECT a, b, space, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sims)
"""

_CODES = """
typed AS (
  SELECT site, left_neighbour AS t FROM strip_map UNION SELECT site, right_neighbour FROM strip_map
  UNION SELECT site, right_neighbour FROM analysis_only
),
known AS (SELECT DISTINCT site FROM strip_map UNION SELECT DISTINCT site FROM analysis_only),
named AS (
  SELECT site, w AS other FROM (SELECT site, unnest(string_split(trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS w FROM typed WHERE t IS NOT NULL)
  WHERE w IN (SELECT site FROM known)
)"""

_REACH = """
e AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
"""

_P5 = """WITH names AS (
  SELECT crop, trim(regexp_replace(lower(split), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k FROM design
),
splits AS (
  SELECT DISTINCT crop AS site, CASE WHEN k IN ('train', 'training') THEN 'train' WHEN k IN ('val', 'validation', 'valid', 'dev') THEN 'val'
    WHEN k IN ('test', 'testing', 'held out', 'heldout', 'holdout') THEN 'test' END AS split FROM names
),
sides AS (
  SELECT site AS l, unnest(regexp_extract_all(lower(right_neighbour), '[a-z0-9]+')) AS r FROM strip_map
  UNION SELECT unnest(regexp_extract_all(lower(left_neighbour), '[a-z0-9]+')), site FROM strip_map
),
firm AS (SELECT DISTINCT site FROM strip_map WHERE NOT isnan(seam_corr_to_right) AND CASE WHEN seam_corr_to_right > 1 THEN seam_corr_to_right / 100 ELSE seam_corr_to_right END >= 0.8),
prof AS (
  SELECT DISTINCT site, list_transform(p, lambda v: (v - list_avg(p)) / sqrt(list_sum(list_transform(p, lambda w: (w - list_avg(p)) ** 2)))) AS z
  FROM (SELECT site, list_transform(profile, lambda v: v::DOUBLE) AS p FROM strip_map)
  WHERE p IS NOT NULL AND len(p) = 64 AND list_count(p) = 64 AND list_min(p) < list_max(p)
),
either AS (
  SELECT l AS a, r AS b FROM sides WHERE l IN (SELECT site FROM firm)
  UNION SELECT x.site, y.site FROM prof x JOIN splits s ON x.site = s.site AND s.split = 'train'
    JOIN prof y ON true JOIN splits t ON y.site = t.site AND t.split IN ('val', 'test') WHERE list_dot_product(x.z, y.z) >= 0.95 - 1e-12
),
pairs AS (
  SELECT DISTINCT least(a, b) AS site_a, greatest(a, b) AS site_b FROM either
  JOIN splits s ON s.site = a JOIN splits t ON t.site = b WHERE a <> b AND s.split IS NOT NULL AND t.split IS NOT NULL AND (s.split = 'train') <> (t.split = 'train')
)
"""

SQL = {
    "p1_found": _P1 + "SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM best WHERE rank <= 5 AND sim >= 0.85",
    "p1_same_crop": _P1 + """, crops AS (SELECT vec_id, min(crop) AS crop FROM space_x GROUP BY vec_id)
SELECT space, count(*) AS n, coalesce(sum((c.crop = o.crop)::BIGINT), 0)::BIGINT AS n_same,
       round(coalesce(sum((c.crop = o.crop)::BIGINT), 0) / count(*), 6) AS rate
FROM best JOIN crops c ON c.vec_id = a JOIN crops o ON o.vec_id = b WHERE rank = 1 AND sim >= 0.85 GROUP BY space""",
    "p2_found": """WITH RECURSIVE imgs AS (
  SELECT crop, try_cast(nullif(regexp_extract(lower(groups), 'img[^0-9a-z]*([0-9]{1,18})', 1), '') AS BIGINT) AS k FROM design
  UNION SELECT spot, try_cast(nullif(regexp_extract(lower(legacy_id), 'img[^0-9a-z]*([0-9]{1,18})', 1), '') AS BIGINT) FROM spots_table
),
keys AS (
  SELECT crop, 'i' || k AS k FROM imgs WHERE k IS NOT NULL
  UNION SELECT spot, 's' || scope || ' ' || session_px FROM spots_table WHERE scope IS NOT NULL AND session_px BETWEEN 1400 AND 2400
),
links AS (SELECT crop AS a, min(crop) OVER (PARTITION BY k) AS b FROM keys),""" + _REACH + """
SELECT a AS crop, least(a, min(b)) AS group_id FROM reach GROUP BY a""",
    "p3_found": "WITH RECURSIVE " + _CODES + """,
chain AS (SELECT DISTINCT site, source_image, chain_order FROM analysis_only WHERE source_image IS NOT NULL AND chain_order IS NOT NULL),
links AS (
  SELECT site AS a, other AS b FROM named
  UNION SELECT x.site, y.site FROM chain x JOIN chain y ON x.source_image = y.source_image AND x.chain_order + 1 = y.chain_order
),""" + _REACH + """
SELECT a AS site, least(a, min(b)) AS group_id FROM reach GROUP BY a""",
    "p4_found": f"""WITH {_SOUND},
near AS (SELECT a, b, sim FROM sims WHERE sim >= 0.9),
stat AS (SELECT a, least(a, min(b)) AS label, count(*) + 1 AS n, round(avg(sim), 6) AS mean FROM near GROUP BY a),
size AS (SELECT label, count(*) AS n FROM stat GROUP BY label)
SELECT a AS vec_id, first_value(a) OVER (PARTITION BY s.label ORDER BY mean DESC, a) AS typical_id
FROM stat s JOIN size z ON s.label = z.label AND s.n = z.n WHERE z.n >= 3""",
    "p5_found": _P5 + "SELECT site_a, site_b FROM pairs",
    "p5_same_records": _P5 + """, texts AS (
  SELECT DISTINCT site, replace(array_to_string(profile, ' '), '-', '') AS t FROM strip_map
  WHERE profile IS NOT NULL AND len(profile) = 64 AND list_count(profile) = 64 AND list_min(profile) < list_max(profile)
), recs AS (
  SELECT DISTINCT t, s.site, s.split, coalesce(try_cast(nullif(regexp_extract(lower(groups), 'img[^0-9a-z]*([0-9]{1,18})', 1), '') AS BIGINT), -1) AS source
  FROM texts JOIN splits s ON s.site = texts.site JOIN (SELECT crop, groups, trim(regexp_replace(lower(split), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k FROM design) d ON d.crop = s.site
   AND s.split = CASE WHEN k IN ('train', 'training') THEN 'train' WHEN k IN ('val', 'validation', 'valid', 'dev') THEN 'val' WHEN k IN ('test', 'testing', 'held out', 'heldout', 'holdout') THEN 'test' END
)
SELECT split, source, count(DISTINCT site) AS n FROM recs WHERE split IN ('val', 'test') AND t IN (SELECT t FROM recs WHERE split = 'train') GROUP BY split, source""",
    "p5_by_source": _P5 + """, imgs AS (
  SELECT DISTINCT d.crop, s.split, coalesce(try_cast(nullif(regexp_extract(lower(groups), 'img[^0-9a-z]*([0-9]{1,18})', 1), '') AS BIGINT), -1) AS image
  FROM design d JOIN splits s ON s.site = d.crop WHERE s.split IN ('val', 'test')
)
SELECT split, image, count(DISTINCT site_a || site_b) AS n_pairs, count(DISTINCT crop) AS n_crops
FROM pairs JOIN imgs ON crop IN (site_a, site_b) GROUP BY split, image""",
}
