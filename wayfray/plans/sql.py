"""The registered queries in SQL, as an independent statement of their results."""

from __future__ import annotations

CENTRES = [(100.0, 100.0), (900.0, 150.0), (450.0, 700.0), (200.0, 1000.0), (1000.0, 1000.0)]

SOURCES = 12

_BITS = "('0x' || substr(md5({}), 1, 13))::BIGINT"
_ROADS = "'S1100','S1200','S1400','S1500','S1630','S1640'"
_CC = """{name}({keys}node, label) USING KEY ({keys}node) AS (
  SELECT DISTINCT {keys}a, a FROM {pairs}
  UNION
  SELECT {bkeys}b.b, min({name}.label) FROM {name} JOIN {pairs} b ON b.a = {name}.node{on1} JOIN recurring.{name} z ON z.node = b.b{on2}
  WHERE {name}.label < z.label GROUP BY ALL)"""


def _cc(name: str, pairs: str, keys: tuple[str, ...] = ()) -> str:
    return _CC.format(
        name=name, pairs=pairs, keys="".join(f"{k}, " for k in keys), bkeys="".join(f"b.{k}, " for k in keys),
        on1="".join(f" AND b.{k} = {name}.{k}" for k in keys), on2="".join(f" AND z.{k} = b.{k}" for k in keys),
    )


_FIT = """{p}tail AS (SELECT xmin, size, n, size / (xmin - 0.5::DOUBLE) AS ratio, sum(n) OVER (PARTITION BY xmin ORDER BY size ROWS UNBOUNDED PRECEDING) AS run FROM {p}cand JOIN hist ON size >= xmin),
{p}al AS (SELECT xmin, sum(n) AS n_tail, 1 + sum(n) / sum(n * ln(ratio)) AS alpha FROM {p}tail GROUP BY xmin HAVING sum(n) >= 20),
{p}ksx AS (
  SELECT t.xmin, n_tail, alpha, max(greatest(abs((run - n) / n_tail - (1 - ratio ** (1 - alpha))), abs((run - 1) / n_tail - (1 - ratio ** (1 - alpha))))) AS ks
  FROM {p}tail t JOIN {p}al ON {p}al.xmin = t.xmin GROUP BY ALL),
{p}best AS (SELECT * FROM {p}ksx ORDER BY ks, xmin LIMIT 1)"""
_BOTH = "{keys}{s} AS a, {t} AS b FROM {e} UNION ALL SELECT {keys}{t}, {s} FROM {e}"
_ZONE_GRID = """
  SELECT '{level}' AS level, CAST(i AS INTEGER) AS idx, format('K{{:04d}}', i) AS zone_id,
         (i % {n}) * s AS zx0, (i // {n}) * s AS zy0, (i % {n} + 1) * s AS zx1, (i // {n} + 1) * s AS zy1
  FROM (SELECT unnest(range({n} * {n})) AS i), (SELECT w * 100.0::DOUBLE / {n} AS s FROM k)"""

_CTES = f"""WITH RECURSIVE
k AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w, count(*) AS cnt FROM customer),
n AS (SELECT c_custkey AS key, c_custkey // w AS i, c_custkey % w AS j, c_acctbal, c_mktsegment, w, cnt FROM customer, k),
e0 AS (SELECT key AS f, key + 1 AS t, c_acctbal, c_mktsegment, w FROM n WHERE j + 1 < w AND key + 1 < cnt UNION ALL SELECT key, key + w, c_acctbal, c_mktsegment, w FROM n WHERE key + w < cnt),
raw AS (
  SELECT f * 100000 + t AS edge_id, f AS src, t AS dst, CASE WHEN c_acctbal < 0 THEN 'N' ELSE 'Y' END AS flag,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'S1100' WHEN 'BUILDING' THEN 'S1200' WHEN 'FURNITURE' THEN 'S1400' WHEN 'HOUSEHOLD' THEN 'S1630' WHEN 'MACHINERY' THEN 'S1730' END AS mtfcc,
         CASE WHEN t = f + 1 THEN 'row ' || (f // w) ELSE 'column ' || (f % w) END AS road, 100.0::DOUBLE * (f % w) AS x0, 100.0::DOUBLE * (f // w) AS y0, 100.0::DOUBLE * (t % w) AS x1, 100.0::DOUBLE * (t // w) AS y1
  FROM e0 WHERE {_BITS.format("'prune|' || (f * 100000 + t)")} >= CAST(0.15 * 4503599627370496 AS BIGINT)),
messy AS (
  SELECT edge_id, CASE WHEN edge_id % 13 = 0 THEN 'x' || src ELSE src::VARCHAR END AS f, CASE WHEN edge_id % 11 = 0 THEN src ELSE dst END AS t FROM raw),
drive AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length_m, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM raw WHERE flag = 'Y' AND mtfcc IN ({_ROADS})),
dpair AS (SELECT {_BOTH.format(keys="", s="src", t="dst", e="drive")}),
{_cc("cc", "dpair")},
giant AS (SELECT label, count(*) AS size FROM cc GROUP BY label ORDER BY size DESC, label LIMIT 1),
net AS (SELECT drive.* FROM drive JOIN cc ON cc.node = src WHERE label = (SELECT label FROM giant)),
m AS (SELECT count(*) AS m FROM net),
ends AS (SELECT edge_id, src AS node, x0 AS x, y0 AS y FROM net UNION ALL SELECT edge_id, dst, x1, y1 FROM net),
xy AS (SELECT node, avg(x) AS x, avg(y) AS y FROM ends GROUP BY node),
zbox AS ({_ZONE_GRID.format(level="coarse", n=4)} UNION ALL {_ZONE_GRID.format(level="medium", n=8)}),
zc AS (SELECT *, zx0 * zy0 - zx1 * zy0 AS c1, zx1 * zy1 - zx1 * zy0 AS c2, zx1 * zy1 - zx0 * zy1 AS c3, zx0 * zy0 - zx0 * zy1 AS c4 FROM zbox),
zone AS (
  SELECT level, idx, zone_id, zx0, zy0, zx1, zy1,
         ((zx0 + zx1) * c1 + (zx1 + zx1) * c2 + (zx1 + zx0) * c3 + (zx0 + zx0) * c4) / (3 * (c1 + c2 + c3 + c4)) AS cx,
         ((zy0 + zy0) * c1 + (zy0 + zy1) * c2 + (zy1 + zy1) * c3 + (zy1 + zy0) * c4) / (3 * (c1 + c2 + c3 + c4)) AS cy FROM zc),
hit AS (SELECT level, edge_id, min(idx) AS idx FROM net JOIN zone ON mx BETWEEN zx0 AND zx1 AND my BETWEEN zy0 AND zy1 GROUP BY ALL),
per AS (SELECT level, idx, count(*) AS n_edges FROM hit GROUP BY ALL),
dist AS (SELECT DISTINCT h.level, h.idx, ends.node FROM hit h JOIN ends USING (edge_id)),
anchor AS (
  SELECT level, idx, node AS anchor_node FROM (
    SELECT d.level, d.idx, d.node, row_number() OVER (PARTITION BY d.level, d.idx ORDER BY round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 6), d.node) AS r
    FROM dist d JOIN xy USING (node) JOIN zone z ON z.level = d.level AND z.idx = d.idx) WHERE r = 1),
zkept AS (
  SELECT z.level, z.idx AS old, CAST(row_number() OVER (PARTITION BY z.level ORDER BY z.idx) - 1 AS INTEGER) AS zone_idx, zone_id, anchor_node, n_edges
  FROM zone z JOIN per p ON p.level = z.level AND p.idx = z.idx JOIN anchor a ON a.level = z.level AND a.idx = z.idx WHERE n_edges >= 5),
lev AS (SELECT DISTINCT level FROM zone),
ez AS (
  SELECT lev.level, net.edge_id, zone_idx FROM net CROSS JOIN lev LEFT JOIN hit h ON h.level = lev.level AND h.edge_id = net.edge_id
  LEFT JOIN zkept q ON q.level = h.level AND q.old = h.idx),
sc AS (SELECT p::DOUBLE AS p, CAST(round(p * 1000) AS INTEGER) AS p_milli, CAST(r AS INTEGER) AS replicate FROM (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS p), (SELECT unnest(range(2)) AS r)),
fit AS (SELECT *, 1 - CASE mtfcc WHEN 'S1100' THEN 0.95 WHEN 'S1200' THEN 0.85 WHEN 'S1400' THEN 0.55 WHEN 'S1500' THEN 0.25 WHEN 'S1630' THEN 0.70 WHEN 'S1640' THEN 0.40 WHEN 'S1730' THEN 0.30 WHEN 'S1740' THEN 0.30 WHEN 'S1780' THEN 0.25 ELSE 0.5 END::DOUBLE AS wt FROM net),
drawn AS (SELECT fit.*, sc.*, round_even(p * m, 0) AS target, {_BITS.format("'0|' || p_milli || '|' || replicate || '|' || edge_id")} AS bits FROM fit, sc, m),
del AS (SELECT *, row_number() OVER (PARTITION BY p_milli, replicate ORDER BY bits, edge_id) <= target AS deleted FROM drawn),
delf AS (SELECT *, row_number() OVER (PARTITION BY p_milli, replicate ORDER BY -ln((bits + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / greatest(wt, 1e-12::DOUBLE), edge_id) <= target AS deleted FROM drawn),
rg AS (
  SELECT p_milli, replicate, road, target, count(*) AS cnt, avg(wt) AS gw, {_BITS.format("'0|' || p_milli || '|' || replicate || '|road|' || road")} AS bits
  FROM drawn GROUP BY p_milli, replicate, road, target),
rrun AS (SELECT *, sum(cnt) OVER o AS run, row_number() OVER o AS i FROM rg WINDOW o AS (PARTITION BY p_milli, replicate ORDER BY bits, road ROWS UNBOUNDED PRECEDING)),
frun AS (SELECT *, sum(cnt) OVER o AS run, row_number() OVER o AS i FROM rg WINDOW o AS (PARTITION BY p_milli, replicate ORDER BY -ln((bits + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / greatest(gw, 1e-12::DOUBLE), road ROWS UNBOUNDED PRECEDING)),
surv AS (SELECT p_milli AS p, replicate AS r, src, dst, edge_id FROM del WHERE NOT deleted),
spair AS (SELECT {_BOTH.format(keys="p, r, ", s="src", t="dst", e="surv")}),
{_cc("lab", "spair", ("p", "r"))},
zsurv AS (SELECT p, r, level, coalesce(zone_idx, 0) AS z, src, dst FROM surv JOIN ez USING (edge_id)),
zpair AS (SELECT {_BOTH.format(keys="p, r, level, z, ", s="src", t="dst", e="zsurv")}),
{_cc("zlab", "zpair", ("p", "r", "level", "z"))},
tsurv AS (SELECT p, r, level, zone_idx AS z, src, dst FROM surv JOIN ez USING (edge_id) WHERE zone_idx IS NOT NULL),
tpair AS (SELECT {_BOTH.format(keys="p, r, level, z, ", s="src", t="dst", e="tsurv")}),
{_cc("tlab", "tpair", ("p", "r", "level", "z"))},
ec AS (
  SELECT d.p AS p, d.p_milli, d.replicate, q.level, q.zone_idx, d.deleted, d.length_m, NOT d.deleted AND NOT coalesce(a.label = h.label, false) AS marooned
  FROM del d JOIN ez USING (edge_id) JOIN zkept q ON q.level = ez.level AND q.zone_idx = ez.zone_idx
  LEFT JOIN lab a ON a.p = d.p_milli AND a.r = d.replicate AND a.node = d.src LEFT JOIN lab h ON h.p = d.p_milli AND h.r = d.replicate AND h.node = q.anchor_node),
ezn AS (
  SELECT d.p AS p, d.p_milli, d.replicate, q.level, q.zone_idx, d.deleted, d.length_m, NOT d.deleted AND NOT coalesce(a.label = h.label, false) AS marooned
  FROM del d JOIN ez USING (edge_id) JOIN zkept q ON q.level = ez.level AND q.zone_idx = ez.zone_idx
  LEFT JOIN zlab a ON a.p = d.p_milli AND a.r = d.replicate AND a.node = d.src AND a.level = q.level AND a.z = q.zone_idx
  LEFT JOIN zlab h ON h.p = d.p_milli AND h.r = d.replicate AND h.node = q.anchor_node AND h.level = q.level AND h.z = q.zone_idx),
ezs AS (
  SELECT d.p AS p, d.p_milli, d.replicate, q.level, q.zone_idx, d.deleted, d.length_m, NOT d.deleted AND NOT coalesce(a.label = h.label, false) AS marooned
  FROM del d JOIN ez USING (edge_id) JOIN zkept q ON q.level = ez.level AND q.zone_idx = ez.zone_idx
  LEFT JOIN tlab a ON a.p = d.p_milli AND a.r = d.replicate AND a.node = d.src AND a.level = q.level AND a.z = q.zone_idx
  LEFT JOIN tlab h ON h.p = d.p_milli AND h.r = d.replicate AND h.node = q.anchor_node AND h.level = q.level AND h.z = q.zone_idx),
pzc AS (SELECT 'county' AS scope, p, p_milli, replicate, level, zone_idx, count(*) AS n_total, count(*) FILTER (deleted) AS n_deleted, count(*) FILTER (marooned) AS n_marooned,
  sum(length_m) / 1000 AS km_total, coalesce(sum(length_m) FILTER (deleted OR marooned), 0) / 1000 AS km_lost FROM ec GROUP BY ALL),
pzn AS (SELECT 'zone' AS scope, p, p_milli, replicate, level, zone_idx, count(*) AS n_total, count(*) FILTER (deleted) AS n_deleted, count(*) FILTER (marooned) AS n_marooned,
  sum(length_m) / 1000 AS km_total, coalesce(sum(length_m) FILTER (deleted OR marooned), 0) / 1000 AS km_lost FROM ezn GROUP BY ALL),
sizes AS (SELECT p, r, label, count(*) AS size FROM lab GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY p, r ORDER BY size DESC, label) AS i FROM sizes),
dg AS (SELECT p AS p_milli, r AS replicate, max(size) / sum(size) AS giant_frac, coalesce(max(size) FILTER (i = 2) / sum(size), 0) AS second_frac, count(*) AS n_components FROM sr GROUP BY ALL),
gt AS (
  SELECT level, scope, 'random' AS protocol, 'edge' AS unit, p, replicate, sum(n_deleted) / greatest(sum(n_total), 1) AS frag_nominal,
         (sum(n_deleted) + sum(n_marooned)) / greatest(sum(n_total), 1) AS frag_effective, sum(n_marooned) / greatest(sum(n_total), 1) AS marooned_frac,
         avg((n_deleted + n_marooned) / greatest(n_total, 1)) AS zone_mean_frag_effective, p_milli
  FROM (SELECT * FROM pzc UNION ALL SELECT * FROM pzn) GROUP BY level, scope, p, p_milli, replicate),
gtab AS (
  SELECT gt.level, gt.scope, gt.protocol, gt.unit, gt.p, gt.replicate, frag_nominal, frag_effective, marooned_frac, zone_mean_frag_effective,
         CASE WHEN scope = 'county' THEN giant_frac END AS giant_frac, CASE WHEN scope = 'county' THEN second_frac END AS second_frac,
         CASE WHEN scope = 'county' THEN n_components END AS n_components, '00000' AS label, '00000' AS fips
  FROM gt JOIN dg ON dg.p_milli = gt.p_milli AND dg.replicate = gt.replicate),
ztab AS (
  SELECT u.level, u.scope, 'random' AS protocol, 'edge' AS unit, u.p, zone_id, max(n_total) AS n_edges, round(avg(n_deleted / greatest(n_total, 1)), 9) AS frag_nominal,
         round(avg(n_marooned / greatest(n_total, 1)), 9) AS frag_marooned, round(avg((n_deleted + n_marooned) / greatest(n_total, 1)), 9) AS frag_effective, '00000' AS label, '00000' AS fips
  FROM (SELECT * FROM pzc UNION ALL SELECT * FROM pzn) u JOIN zkept q ON q.level = u.level AND q.zone_idx = u.zone_idx WHERE p_milli = 200 GROUP BY u.level, u.scope, u.p, zone_id),
curve AS (SELECT *, (row_number() OVER (PARTITION BY level ORDER BY frag_effective, zone_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY level) AS norm_rank FROM ztab WHERE scope = 'county'),
means AS (SELECT level, p, avg(giant_frac) AS giant_frac, avg(second_frac) AS second_frac, avg(frag_effective) AS frag_effective FROM gtab WHERE scope = 'county' GROUP BY ALL),
pc AS (SELECT level, arg_min(p, {{'s': -second_frac, 'p': p}}) AS pc_second_peak, max(second_frac) AS max_second_frac, min(p) FILTER (giant_frac < 0.5) AS pc_giant_half FROM means GROUP BY level),
csum AS (
  SELECT level, count(*) AS n_zones, median(frag_effective) AS median_frag, min(norm_rank) FILTER (frag_effective >= 0.5) AS rank_at_50pct,
         CASE WHEN count(*) FILTER (norm_rank > 0.6) > 5 AND count(*) FILTER (norm_rank > 0.6 AND frag_effective < 1) > 5
              THEN regr_slope(CASE WHEN norm_rank > 0.6 AND frag_effective < 1 THEN ln(1 - frag_effective) END, CASE WHEN norm_rank > 0.6 AND frag_effective < 1 THEN ln(1 - norm_rank) END) END AS tail_slope_ols
  FROM curve GROUP BY level),
deg AS (SELECT node, count(*) AS degree FROM ends GROUP BY node),
summ AS (
  SELECT count(*) AS n_nodes, avg(degree) AS mean_degree, avg((degree = 1)::INT) AS deg_1_frac, avg((degree = 2)::INT) AS deg_2_frac, avg((degree = 3)::INT) AS deg_3_frac,
         avg((degree = 4)::INT) AS deg_4_frac, avg((degree = 5)::INT) AS deg_5_frac, (SELECT count(*) FROM net) AS n_edges, (SELECT sum(length_m) / 1000 FROM net) AS total_km FROM deg),
score AS (
  SELECT level, zone_id, n_edges, frag_marooned * n_edges AS marooned, frag_marooned * 1000 AS score, CAST(row_number() OVER (PARTITION BY level ORDER BY frag_marooned * 1000, zone_id) AS INTEGER) AS rank,
         row_number() OVER (PARTITION BY level ORDER BY frag_marooned * 1000, zone_id) / count(*) OVER (PARTITION BY level) AS norm_rank FROM ztab WHERE scope = 'county'),
pf AS (
  SELECT level, count(*) AS n_zones, regr_slope(ln(score), ln(rank)) FILTER (score > 0) AS b, exp(regr_intercept(ln(score), ln(rank)) FILTER (score > 0)) AS a,
         avg(score) FILTER (score > 0) AS mean, count(*) FILTER (score > 0) AS k, max(rank) AS xmax FROM score GROUP BY level HAVING count(*) FILTER (score > 0) >= 2),
pr AS (SELECT s.level, CASE WHEN sum((score - mean) ** 2) <> 0 THEN 1 - sum((score - a * rank ** b) ** 2) / sum((score - mean) ** 2) END AS r2 FROM score s JOIN pf ON pf.level = s.level WHERE score > 0 GROUP BY s.level),
qdraw AS (SELECT edge_id, src, dst, r, row_number() OVER (PARTITION BY r ORDER BY {_BITS.format("'0|400|' || r || '|7|' || edge_id")}, edge_id) <= round_even(0.4::DOUBLE * m, 0) AS deleted FROM net, m, (SELECT unnest(range(4)) AS r)),
qsurv AS (SELECT r, src, dst FROM qdraw WHERE NOT deleted),
qpair AS (SELECT {_BOTH.format(keys="r, ", s="src", t="dst", e="qsurv")}),
{_cc("qlab", "qpair", ("r",))},
hist AS (SELECT size, count(*) AS n FROM (SELECT r, label, count(*) AS size FROM qlab GROUP BY ALL) GROUP BY size),
cand0 AS (SELECT size AS xmin, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () - 10 AS k FROM hist),
cand AS (SELECT xmin FROM cand0 WHERE i < k AND (k <= 200 OR i IN (SELECT CAST(floor(j * (k - 1) / 199) AS BIGINT) FROM (SELECT unnest(range(200)) AS j)))),
{_FIT.format(p="")},
bn AS (SELECT node, row_number() OVER (ORDER BY {_BITS.format("'betweenness|0|' || node")}, node) AS i, count(*) OVER () AS n FROM deg),
bsrc AS (SELECT node AS s, n / least(n, {SOURCES}) AS scale FROM bn WHERE i <= {SOURCES}),
bway AS (SELECT edge_id, src AS u, dst AS v FROM net UNION ALL SELECT edge_id, dst, src FROM net),
bhop(s, node, d) USING KEY (s, node) AS (
  SELECT s, s, 0 FROM bsrc
  UNION
  SELECT h.s, w.v, min(h.d + 1) FROM bhop h JOIN bway w ON w.u = h.node LEFT JOIN recurring.bhop z ON z.s = h.s AND z.node = w.v WHERE z.d IS NULL GROUP BY ALL),
bpath(s, node, d, paths) AS (
  SELECT s, s, 0, 1.0::DOUBLE FROM bsrc
  UNION ALL
  SELECT b.s, h.node, h.d, sum(b.paths) FROM bpath b JOIN bway w ON w.u = b.node JOIN bhop h ON h.s = b.s AND h.node = w.v AND h.d = b.d + 1 GROUP BY ALL),
bdue(s, node, d, paths, owed) AS (
  SELECT b.s, b.node, b.d, b.paths, 0.0::DOUBLE FROM bpath b JOIN (SELECT s, max(d) AS d FROM bpath GROUP BY s) m ON m.s = b.s AND m.d = b.d
  UNION ALL
  SELECT p.s, p.node, p.d, p.paths, coalesce(sum(p.paths / c.paths * (1 + c.owed)), 0)
  FROM (SELECT DISTINCT s, d FROM bdue) l JOIN bpath p ON p.s = l.s AND p.d = l.d - 1 LEFT JOIN bway w ON w.u = p.node LEFT JOIN bdue c ON c.s = p.s AND c.node = w.v AND c.d = p.d + 1 GROUP BY ALL),
btw AS (
  SELECT net.edge_id, round(coalesce(sum(scale * p.paths / c.paths * (1 + c.owed)), 0), 6) AS betweenness
  FROM net LEFT JOIN (bway w JOIN bdue p ON p.node = w.u JOIN bdue c ON c.s = p.s AND c.node = w.v AND c.d = p.d + 1 JOIN bsrc ON bsrc.s = p.s) ON w.edge_id = net.edge_id GROUP BY net.edge_id),
bdel AS (
  SELECT net.*, p_milli, row_number() OVER (PARTITION BY p_milli ORDER BY betweenness DESC, net.edge_id) <= round_even(p * m, 0) AS deleted
  FROM net JOIN btw USING (edge_id), m, (SELECT p::DOUBLE AS p, CAST(round(p * 1000) AS INTEGER) AS p_milli FROM (SELECT unnest([0.05, 0.1, 0.2]) AS p))),
bpair AS (SELECT p_milli AS p, src AS a, dst AS b FROM bdel WHERE NOT deleted UNION ALL SELECT p_milli, dst, src FROM bdel WHERE NOT deleted),
{_cc("blab", "bpair", ("p",))},
spot AS (SELECT s_suppkey AS id, s_suppkey * 37 % w * 100.0::DOUBLE + 30 AS x, s_suppkey * 53 % w * 100.0::DOUBLE - 20 AS y FROM supplier, k),
pm(round, done, cs) AS (
  SELECT 0, false, (SELECT list({{'i': i - 1, 'x': mx, 'y': my}} ORDER BY i) FROM (SELECT mx, my, row_number() OVER (ORDER BY {_BITS.format("'pmedian|0|' || edge_id")}, edge_id) AS i FROM net) WHERE i <= 5)
  UNION ALL
  SELECT round + 1, bool_and(abs(nx - cs[i + 1].x) <= 1e-8 + 1e-5 * abs(cs[i + 1].x) AND abs(ny - cs[i + 1].y) <= 1e-8 + 1e-5 * abs(cs[i + 1].y)), list({{'i': i, 'x': nx, 'y': ny}} ORDER BY i)
  FROM (SELECT round, cs, near.i AS i, avg(mx) AS nx, avg(my) AS ny FROM (
    SELECT round, cs, mx, my, list_min(list_transform(cs, lambda c: {{'d': sqrt((mx - c.x) ** 2 + (my - c.y) ** 2), 'i': c.i}})) AS near FROM pm, net WHERE NOT done AND round < 60) GROUP BY round, cs, near.i) GROUP BY round),
pcs AS (SELECT unnest(cs, recursive := true) FROM (SELECT cs FROM pm WHERE NOT done ORDER BY round DESC LIMIT 1)),
pml AS (SELECT edge_id, i, x, y FROM (SELECT edge_id, i, x, y, row_number() OVER (PARTITION BY edge_id ORDER BY sqrt((mx - x) ** 2 + (my - y) ** 2), i) AS r FROM net, pcs) WHERE r = 1),
pma AS (
  SELECT i, node FROM (SELECT p.i, ends.node, row_number() OVER (PARTITION BY p.i ORDER BY round(sqrt((xy.x - p.x) ** 2 + (xy.y - p.y) ** 2), 6), ends.node) AS r FROM pml p JOIN ends USING (edge_id) JOIN xy ON xy.node = ends.node) WHERE r = 1),
fac AS (SELECT s_suppkey AS id, s_suppkey * 37 % w * 100.0::DOUBLE + 30 AS x, s_suppkey * 53 % w * 100.0::DOUBLE - 20 AS y FROM supplier, k WHERE s_acctbal > 5000),
snap AS (
  SELECT id, node, gap FROM (
    SELECT id, node, gap, row_number() OVER (PARTITION BY id ORDER BY gap, node) AS i FROM (SELECT id, node, round(sqrt((fac.x - xy.x) ** 2 + (fac.y - xy.y) ** 2), 6) AS gap FROM fac, xy)) WHERE i = 1),
area AS (
  SELECT edge_id, s, CASE WHEN x >= 0 AND y >= 0 THEN 'area ' || CAST(floor(y / 400) AS BIGINT) || '/' || CAST(floor(x / 400) AS BIGINT) END AS zone_id
  FROM (SELECT edge_id, s, CASE WHEN y0 = y1 THEN mx ELSE mx + s END AS x, CASE WHEN y0 = y1 THEN my + s ELSE my END AS y FROM net, (SELECT unnest([-1, 1]) AS s))),
shared AS (SELECT edge_id, zone_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY edge_id) AS share FROM (SELECT DISTINCT edge_id, zone_id FROM area WHERE zone_id IS NOT NULL)),
azone AS (SELECT zone_id, sum(mx * share) / sum(share) AS cx, sum(my * share) / sum(share) AS cy, sum(share) AS n_edges FROM shared JOIN net USING (edge_id) GROUP BY zone_id),
aanchor AS (
  SELECT zone_id, node AS anchor_node FROM (
    SELECT s.zone_id, ends.node, row_number() OVER (PARTITION BY s.zone_id ORDER BY round(sqrt((xy.x - cx) ** 2 + (xy.y - cy) ** 2), 6), ends.node) AS r
    FROM shared s JOIN ends USING (edge_id) JOIN xy ON xy.node = ends.node JOIN azone z ON z.zone_id = s.zone_id) WHERE r = 1),
rated AS (
  SELECT id, edge_id, gap FROM (
    SELECT id, edge_id, gap, row_number() OVER (PARTITION BY id ORDER BY gap, edge_id) AS r FROM (
      SELECT id, edge_id, round(sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2), 6) AS gap
      FROM (SELECT spot.*, net.*, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM spot, net)) WHERE gap <= 40) WHERE r = 1),
mfit AS (SELECT edge_id, avg(greatest(0, least(1, s_acctbal / 10000))) AS f FROM rated JOIN supplier ON s_suppkey = id GROUP BY edge_id),
delm AS (
  SELECT p_milli, replicate, edge_id, row_number() OVER (PARTITION BY p_milli, replicate ORDER BY -ln((bits + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / greatest(coalesce(1 - f, wt), 1e-12::DOUBLE), edge_id) <= target AS deleted
  FROM drawn LEFT JOIN mfit USING (edge_id)),
away(p, r, node, dist) USING KEY (p, r, node) AS (
  SELECT p_milli, replicate, node, 0.0::DOUBLE FROM (SELECT DISTINCT node FROM snap), sc
  UNION
  SELECT b.p, b.r, b.b, min(away.dist + 100.0::DOUBLE) FROM away JOIN spair b ON b.a = away.node AND b.p = away.p AND b.r = away.r
  LEFT JOIN recurring.away z ON z.p = b.p AND z.r = b.r AND z.node = b.b WHERE z.dist IS NULL OR away.dist + 100.0::DOUBLE < z.dist GROUP BY ALL)
"""

_Z6 = "p_milli, replicate, level, zone_idx, n_total, n_deleted, n_marooned"
_NEAR = ", ".join(f"{{'d': sqrt((mx - {x}) ** 2 + (my - {y}) ** 2), 'i': {i}}}" for i, (x, y) in enumerate(CENTRES))

_FINAL = {
    "road_filter": f"SELECT edge_id, mtfcc AS MTFCC FROM raw WHERE flag = 'Y' AND mtfcc IN ({_ROADS})",
    "road_filter_main": "SELECT edge_id, mtfcc AS MTFCC FROM raw WHERE flag = 'Y' AND mtfcc IN ('S1100','S1200','S1400')",
    "try_numeric_nodes": "SELECT edge_id, try_cast(f AS BIGINT) AS src, t AS dst FROM messy WHERE try_cast(f AS BIGINT) IS NOT NULL",
    "self_loop_drop": "SELECT edge_id, try_cast(f AS BIGINT) AS src, t AS dst FROM messy WHERE try_cast(f AS BIGINT) <> t",
    "degree": "SELECT a AS node, count(*) AS degree FROM dpair GROUP BY a",
    "network_summary": "SELECT '00000' AS fips, n_nodes, n_edges, round(mean_degree, 9) AS mean_degree, round(total_km, 9) AS total_km, " + ", ".join(f"round(deg_{k}_frac, 9) AS deg_{k}_frac" for k in range(1, 6)) + " FROM summ",
    "node_coords": "SELECT node, avg(x) AS x, avg(y) AS y FROM (SELECT src AS node, x0 AS x, y0 AS y FROM drive UNION ALL SELECT dst, x1, y1 FROM drive) GROUP BY node",
    "geometric_noding": "SELECT CAST(round_even(x0 / 150, 0) AS BIGINT) * 4294967296 + CAST(round_even(y0 / 150, 0) AS BIGINT) + 2147483648 AS src, CAST(round_even(x1 / 150, 0) AS BIGINT) * 4294967296 + CAST(round_even(y1 / 150, 0) AS BIGINT) + 2147483648 AS dst, count(*) AS n FROM raw GROUP BY ALL",
    "components": "SELECT node, label FROM cc",
    "components_contracted": "SELECT node, label FROM cc",
    "edge_betweenness": "SELECT edge_id, betweenness FROM btw",
    "delete_betweenness_edge": "SELECT p_milli, edge_id FROM bdel WHERE deleted",
    "trial_betweenness": "SELECT d.p_milli, q.level, q.zone_idx, count(*) AS n_total, count(*) FILTER (deleted) AS n_deleted, count(*) FILTER (NOT deleted AND NOT coalesce(a.label = h.label, false)) AS n_marooned "
    "FROM bdel d JOIN ez USING (edge_id) JOIN zkept q ON q.level = ez.level AND q.zone_idx = ez.zone_idx LEFT JOIN blab a ON a.p = d.p_milli AND a.node = d.src LEFT JOIN blab h ON h.p = d.p_milli AND h.node = q.anchor_node GROUP BY ALL",
    "sample_by_thresholds": "SELECT p_milli, replicate, edge_id FROM del WHERE deleted",
    "sample_by_thresholds_fitness": "SELECT p_milli, replicate, edge_id FROM delf WHERE deleted",
    "snap_facilities": "SELECT id, node, gap FROM snap",
    "accessibility": "SELECT p_milli, replicate, count(*) AS n_nodes, count(*) FILTER (dist IS NULL) AS n_unreachable, round(count(*) FILTER (dist IS NULL) / count(*), 6) AS unreachable_frac, round(avg(dist), 6) AS mean_m, round(max(dist), 6) AS max_m "
    "FROM (SELECT p_milli, replicate, deg.node, dist FROM deg CROSS JOIN sc LEFT JOIN away ON away.node = deg.node AND away.p = p_milli AND away.r = replicate) GROUP BY ALL",
    "landed_box": "SELECT edge_id, least(x0, x1) AS box_x0, least(y0, y1) AS box_y0 FROM raw WHERE least(x0, x1) <= 1290 AND greatest(x0, x1) >= 450 AND least(y0, y1) <= 900 AND greatest(y0, y1) >= 320",
    "touching_zones": "SELECT id AS left_id, zone_id AS right_id FROM spot JOIN zone ON level = 'medium' AND greatest(zx0 - x, 0, x - zx1) + greatest(zy0 - y, 0, y - zy1) <= 170",
    "zones_by_sides": "SELECT zone_id, n_edges, round(cx, 5) AS cx, round(cy, 5) AS cy, anchor_node FROM azone JOIN aanchor USING (zone_id)",
    "trial_by_sides": "SELECT d.p_milli, d.replicate, z.zone_id, sum(share) AS n_total, sum(CASE WHEN deleted THEN share ELSE 0 END) AS n_deleted, sum(CASE WHEN NOT deleted AND NOT coalesce(a.label = h.label, false) THEN share ELSE 0 END) AS n_marooned "
    "FROM del d JOIN shared USING (edge_id) JOIN aanchor z ON z.zone_id = shared.zone_id LEFT JOIN lab a ON a.p = d.p_milli AND a.r = d.replicate AND a.node = d.src "
    "LEFT JOIN lab h ON h.p = d.p_milli AND h.r = d.replicate AND h.node = z.anchor_node GROUP BY ALL",
    "conflated_ratings": "SELECT id, edge_id, gap FROM rated",
    "delete_measured_edge": "SELECT p_milli, replicate, edge_id FROM delm WHERE deleted",
    "trial_contracted": f"SELECT {_Z6} FROM pzc",
    "giant_component": "SELECT '00000' AS fips, label, size FROM giant",
    "restrict_giant": "SELECT edge_id, src, dst, length_m FROM net",
    "edge_midpoint": "SELECT edge_id, mx AS mid_x, my AS mid_y FROM drive",
    "point_in_zone_first_match": "SELECT net.edge_id, idx AS zone_idx FROM net LEFT JOIN hit ON hit.edge_id = net.edge_id AND level = 'medium'",
    "edges_per_zone": "SELECT idx AS zone_idx, n_edges FROM per WHERE level = 'medium'",
    "zone_anchor": "SELECT zone_id, cx, cy, anchor_node FROM zone z LEFT JOIN anchor a ON a.level = z.level AND a.idx = z.idx WHERE z.level = 'medium'",
    "drop_small_zones": "SELECT zone_idx, zone_id, n_edges, anchor_node FROM zkept WHERE level = 'medium'",
    "nearest_centre": f"SELECT CAST(c.i AS INTEGER) AS zone_idx, count(*) AS n, round(avg(mx), 6) AS x, round(avg(my), 6) AS y FROM (SELECT mx, my, list_min([{_NEAR}]) AS c FROM net) GROUP BY c.i",
    "nearest_of_many": "SELECT edge_id, CAST(id AS INTEGER) AS zone_idx FROM (SELECT edge_id, id, row_number() OVER (PARTITION BY edge_id ORDER BY round(sqrt((mx - spot.x) ** 2 + (my - spot.y) ** 2), 9), id) AS r FROM net, spot) WHERE r = 1",
    "pmedian": "SELECT CAST(pml.i AS INTEGER) AS zone_idx, count(*) AS n_edges, round(any_value(x), 5) AS cx, round(any_value(y), 5) AS cy, any_value(node) AS anchor_node FROM pml JOIN pma ON pma.i = pml.i GROUP BY pml.i",
    "delete_random_edge": "SELECT p_milli, replicate, edge_id FROM del WHERE deleted",
    "delete_fitness_edge": "SELECT p_milli, replicate, edge_id FROM delf WHERE deleted",
    "delete_random_road": "SELECT d.p_milli, d.replicate, d.edge_id FROM drawn d JOIN rrun USING (p_milli, replicate, road) WHERE d.target > 0 AND (run <= d.target OR rrun.i = 1)",
    "delete_fitness_road": "SELECT d.p_milli, d.replicate, d.edge_id FROM drawn d JOIN frun USING (p_milli, replicate, road) WHERE d.target > 0 AND (run <= d.target OR frun.i = 1)",
    "trial_county": f"SELECT {_Z6} FROM pzc",
    "trial_zone": f"SELECT {_Z6} FROM pzn",
    "trial_zone_strict": "SELECT p_milli, replicate, level, zone_idx, count(*) AS n_total, count(*) FILTER (deleted) AS n_deleted, count(*) FILTER (marooned) AS n_marooned FROM ezs GROUP BY ALL",
    "trial_km": "SELECT p_milli, replicate, level, zone_idx, round(km_total, 6) AS km_total, round(km_lost, 6) AS km_lost FROM pzc",
    "trial_global": "SELECT p_milli, replicate, round(giant_frac, 9) AS giant_frac, round(second_frac, 9) AS second_frac, n_components FROM dg",
    "sweep_global": "SELECT * REPLACE (round(frag_nominal, 9) AS frag_nominal, round(frag_effective, 9) AS frag_effective, round(marooned_frac, 9) AS marooned_frac, round(zone_mean_frag_effective, 9) AS zone_mean_frag_effective, round(giant_frac, 9) AS giant_frac, round(second_frac, 9) AS second_frac) FROM gtab",
    "sweep_zone_detail": "SELECT * FROM ztab",
    "rank_curves": "SELECT level, zone_id, frag_effective, round(norm_rank, 9) AS norm_rank FROM curve",
    "curve_summary": "SELECT level, n_zones, round(median_frag, 9) AS median_frag, round(rank_at_50pct, 9) AS rank_at_50pct, round(tail_slope_ols, 6) AS tail_slope_ols FROM csum",
    "estimate_pc": "SELECT level, pc_second_peak, round(max_second_frac, 9) AS max_second_frac, pc_giant_half FROM pc",
    "county_summary": "SELECT '00000' AS fips, csum.level, n_zones, round(median_frag, 9) AS median_frag, pc_second_peak, pc_giant_half, n_nodes, n_edges, round(mean_degree, 9) AS mean_degree, round(total_km, 9) AS total_km FROM csum LEFT JOIN pc ON pc.level = csum.level, summ",
    "percolation_means": "SELECT level, p, round(giant_frac, 9) AS giant_frac, round(second_frac, 9) AS second_frac, round(frag_effective, 9) AS frag_effective FROM means",
    "cluster_sizes": "SELECT size, n FROM hist",
    "ccdf": "SELECT size, round(sum(n) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS ccdf FROM hist",
    "powerlaw_mle": "SELECT round(alpha, 6) AS alpha, xmin::DOUBLE AS xmin, CAST(n_tail AS BIGINT) AS n_tail, round(ks, 6) AS ks FROM best",
    "fitted_tail": ", wcand AS (SELECT xmin FROM cand0 WHERE i < k),\n" + _FIT.format(p="w")
    + " SELECT h.size, round(n_tail / (SELECT sum(n) FROM hist) * (h.size / xmin) ** (1 - alpha), 6) AS fitted FROM hist h, wbest WHERE h.size >= xmin",
    "critical_exponent": "SELECT round(alpha, 6) AS alpha, xmin::DOUBLE AS xmin, CAST(n_tail AS BIGINT) AS n_tail, round(ks, 6) AS ks, 0.4::DOUBLE AS p, round(187::DOUBLE / 91, 6) AS tau_2d_reference FROM best",
    "marooned_score_rank": "SELECT zone_id, n_edges, round(marooned, 6) AS marooned, round(score, 6) AS score, rank, round(norm_rank, 6) AS norm_rank FROM score WHERE level = 'medium'",
    "score_powerfit": "SELECT '00000' AS fips, pf.level, n_zones, round(a, 6) AS a, round(b, 6) AS b, round(r2, 6) AS r2 FROM pf JOIN pr ON pr.level = pf.level",
    "overlay_rescale": "SELECT '00000' AS fips, level, round(a * xmax ** b, 6) AS a_norm, round(b, 6) AS b FROM pf",
}

_BATCH = f"""WITH RECURSIVE
n AS (
  SELECT c_nationkey, lpad(c_nationkey::VARCHAR, 5, '0') AS fips, c_custkey AS f, c_acctbal, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS q0,
         CAST(ceil(sqrt(count(*) OVER (PARTITION BY c_nationkey))) AS BIGINT) AS w FROM customer),
e0 AS (
  SELECT n.*, t.f AS t, t.q0 AS q1 FROM n JOIN n t ON t.c_nationkey = n.c_nationkey AND (t.q0 = n.q0 + 1 AND n.q0 % n.w + 1 < n.w OR t.q0 = n.q0 + n.w) WHERE n.w > 1),
raw AS (
  SELECT fips, f * 100000 + t AS edge_id, f AS src, t AS dst, 100.0::DOUBLE * (q0 % w + q1 % w) / 2 AS mx, 100.0::DOUBLE * (q0 // w + q1 // w) / 2 AS my, q0, q1, w,
         CASE WHEN c_acctbal < 0 THEN 'N' ELSE 'Y' END AS flag,
         CASE WHEN c_nationkey % 9 = 4 THEN 'S1740' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'S1100' WHEN c_mktsegment = 'BUILDING' THEN 'S1200' WHEN c_mktsegment = 'FURNITURE' THEN 'S1400' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'S1630' WHEN c_mktsegment = 'MACHINERY' THEN 'S1730' END AS mtfcc
  FROM e0 WHERE {_BITS.format("'prune|' || (f * 100000 + t)")} >= CAST(0.15 * 4503599627370496 AS BIGINT)),
past AS (SELECT DISTINCT lpad(s_nationkey::VARCHAR, 5, '0') AS fips FROM supplier WHERE s_acctbal > 9500),
codes AS (SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS fips FROM nation),
mine AS (SELECT raw.* FROM raw JOIN codes USING (fips) ANTI JOIN past USING (fips)),
drive AS (SELECT * FROM mine WHERE flag = 'Y' AND mtfcc IN ({_ROADS})),
dpair AS (SELECT {_BOTH.format(keys="fips, ", s="src", t="dst", e="drive")}),
{_cc("cc", "dpair", ("fips",))},
giant AS (SELECT fips, label FROM (SELECT fips, label, row_number() OVER (PARTITION BY fips ORDER BY count(*) DESC, label) AS i FROM cc GROUP BY fips, label) WHERE i = 1),
net AS (SELECT drive.* FROM drive JOIN cc ON cc.fips = drive.fips AND cc.node = src JOIN giant g ON g.fips = cc.fips AND g.label = cc.label),
m AS (SELECT fips, count(*) AS m FROM net GROUP BY fips),
zone AS (
  SELECT fips, i AS idx, format('K{{:04d}}', i) AS zone_id, (i % 2) * s AS x0, (i // 2) * s AS y0, (i % 2 + 1) * s AS x1, (i // 2 + 1) * s AS y1
  FROM (SELECT fips, c_nationkey, ceil(sqrt(count(*))) * 100.0::DOUBLE / 2 AS s FROM n GROUP BY ALL), (SELECT unnest(range(4)) AS i) WHERE c_nationkey % 7 <> 5),
hit AS (SELECT net.fips, edge_id, min(idx) AS idx FROM net JOIN zone z ON z.fips = net.fips AND mx BETWEEN x0 AND x1 AND my BETWEEN y0 AND y1 GROUP BY ALL),
ends AS (SELECT fips, edge_id, src AS node, 100.0::DOUBLE * (q0 % w) AS x, 100.0::DOUBLE * (q0 // w) AS y FROM net UNION ALL SELECT fips, edge_id, dst, 100.0::DOUBLE * (q1 % w), 100.0::DOUBLE * (q1 // w) FROM net),
anchor AS (
  SELECT fips, idx, node FROM (
    SELECT h.fips, h.idx, node, row_number() OVER (PARTITION BY h.fips, h.idx ORDER BY round(sqrt((x - (x0 + x1) / 2) ** 2 + (y - (y0 + y1) / 2) ** 2), 6), node) AS r
    FROM hit h JOIN ends ON ends.fips = h.fips AND ends.edge_id = h.edge_id JOIN zone z ON z.fips = h.fips AND z.idx = h.idx) WHERE r = 1),
kept AS (SELECT h.fips, h.idx, zone_id, node AS anchor_node, count(*) AS n_edges FROM hit h JOIN zone z USING (fips, idx) JOIN anchor USING (fips, idx) GROUP BY ALL HAVING count(*) >= 5),
del AS (
  SELECT net.*, r, row_number() OVER (PARTITION BY net.fips, r ORDER BY {_BITS.format("'0|200|' || r || '|' || edge_id")}, edge_id) <= round_even(0.2::DOUBLE * m, 0) AS deleted
  FROM net JOIN m USING (fips), (SELECT CAST(unnest(range(2)) AS INTEGER) AS r)),
spair AS (SELECT fips, r, src AS a, dst AS b FROM del WHERE NOT deleted UNION ALL SELECT fips, r, dst, src FROM del WHERE NOT deleted),
{_cc("lab", "spair", ("fips", "r"))},
pz AS (
  SELECT d.fips, d.r, k.idx, k.zone_id, count(*) AS n_total, count(*) FILTER (deleted) AS n_deleted, count(*) FILTER (NOT deleted AND NOT coalesce(a.label = h.label, false)) AS n_marooned
  FROM del d JOIN hit ON hit.fips = d.fips AND hit.edge_id = d.edge_id JOIN kept k ON k.fips = hit.fips AND k.idx = hit.idx
  LEFT JOIN lab a ON a.fips = d.fips AND a.r = d.r AND a.node = d.src LEFT JOIN lab h ON h.fips = d.fips AND h.r = d.r AND h.node = k.anchor_node GROUP BY ALL),
zt AS (
  SELECT fips, zone_id, max(n_total) AS n_edges, avg(n_deleted / n_total) AS frag_nominal, avg(n_marooned / n_total) AS frag_marooned, avg((n_deleted + n_marooned) / n_total) AS frag_effective FROM pz GROUP BY ALL),
sizes AS (SELECT fips, r, label, count(*) AS size, row_number() OVER (PARTITION BY fips, r ORDER BY count(*) DESC, label) AS i FROM lab GROUP BY fips, r, label),
dg AS (SELECT fips, r, max(size) / sum(size) AS giant_frac, coalesce(max(size) FILTER (i = 2) / sum(size), 0) AS second_frac, count(*) AS n_components FROM sizes GROUP BY ALL)
"""

_BATCH_FINAL = {
    "components_keyed": "SELECT fips, node, label FROM cc",
    "giant_of_each": "SELECT fips, edge_id, src, dst FROM net",
    "batch_outcomes": """
SELECT c.fips, 'quarter' AS level, CASE WHEN p.fips IS NOT NULL THEN 'skipped' WHEN coalesce(n_zones, 0) = 0 THEN 'failed' ELSE 'done' END AS outcome,
       CASE WHEN p.fips IS NOT NULL THEN 'done before' WHEN n_raw IS NULL THEN 'no edge layer' WHEN n_edges IS NULL THEN 'no road of the set' WHEN n_zones IS NULL THEN 'no zone with enough edges'
            WHEN coalesce(k, 0) < 2 THEN 'too few points for a fit' END AS reason, coalesce(n_edges, 0) AS n_edges, coalesce(n_zones, 0) AS n_zones
FROM codes c LEFT JOIN past p USING (fips) LEFT JOIN (SELECT fips, count(*) AS n_raw FROM mine GROUP BY fips) USING (fips) LEFT JOIN (SELECT fips, m AS n_edges FROM m) USING (fips)
LEFT JOIN (SELECT fips, count(*) AS n_zones FROM kept GROUP BY fips) USING (fips) LEFT JOIN (SELECT fips, count(*) FILTER (frag_marooned > 0) AS k FROM zt GROUP BY fips) USING (fips)""",
    "batch_zones": "SELECT fips, 'quarter' AS level, zone_id, n_edges, round(frag_nominal, 9) AS frag_nominal, round(frag_marooned, 9) AS frag_marooned, round(frag_effective, 9) AS frag_effective FROM zt",
    "batch_global": """
SELECT g.fips, 'quarter' AS level, 0.2::DOUBLE AS p, g.r AS replicate, round(sum(n_deleted) / sum(n_total), 9) AS frag_nominal, round((sum(n_deleted) + sum(n_marooned)) / sum(n_total), 9) AS frag_effective,
       round(any_value(giant_frac), 9) AS giant_frac, round(any_value(second_frac), 9) AS second_frac, any_value(n_components) AS n_components FROM pz g JOIN dg ON dg.fips = g.fips AND dg.r = g.r GROUP BY g.fips, g.r""",
}

_ALBERS = """
WITH RECURSIVE c AS (SELECT c_custkey, (-125 + (c_custkey % 590) / 10) AS lon, (24 + (c_custkey % 251) / 10) AS lat FROM customer),
k AS (SELECT sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257222101::DOUBLE AS f)),
t AS (SELECT 1 AS i, 29.5 AS d UNION ALL SELECT 2, 45.5 UNION ALL SELECT 0, 23.0),
g AS (SELECT i, cos(radians(d)) / sqrt(1 - (e * sin(radians(d))) ** 2) AS m, (1 - e * e) * (sin(radians(d)) / (1 - (e * sin(radians(d))) ** 2) - ln((1 - e * sin(radians(d))) / (1 + e * sin(radians(d)))) / (2 * e)) AS q FROM t, k),
v AS (SELECT (a.m ** 2 - b.m ** 2) / (b.q - a.q) AS n, a.m, a.q, o.q AS q0 FROM g a, g b, g o WHERE a.i = 1 AND b.i = 2 AND o.i = 0),
w AS (SELECT n, m * m + n * q AS c0, 6378137.0 * sqrt(m * m + n * q - n * q0) / n AS rho0 FROM v),
x AS (SELECT c_custkey, lon, n, rho0, 6378137.0 * sqrt(c0 - n * (1 - e * e) * (sin(radians(lat)) / (1 - (e * sin(radians(lat))) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e))) / n AS rho FROM c, k, w)
SELECT c_custkey, round(rho * sin(n * radians(lon + 96)), 3) AS x, round(rho0 - rho * cos(n * radians(lon + 96)), 3) AS y FROM x"""

_LINES = """
WITH p AS (SELECT o_custkey, o_orderkey, (o_orderkey % 1000)::DOUBLE AS x, (CAST(floor(o_totalprice) AS BIGINT) % 1000)::DOUBLE AS y FROM orders),
s AS (SELECT *, lead(x) OVER o AS bx, lead(y) OVER o AS by_ FROM p WINDOW o AS (PARTITION BY o_custkey ORDER BY o_orderkey, x, y)),
l AS (SELECT *, sqrt((bx - x) ** 2 + (by_ - y) ** 2) AS d FROM s),
r AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(d) OVER (PARTITION BY o_custkey) / 2 AS half, count(*) OVER (PARTITION BY o_custkey) AS n FROM l),
m AS (SELECT o_custkey, arg_max(x + CASE WHEN d > 0 THEN (half - run) / d ELSE 0 END * (bx - x), o_orderkey) AS mx, arg_max(y + CASE WHEN d > 0 THEN (half - run) / d ELSE 0 END * (by_ - y), o_orderkey) AS my FROM r WHERE run <= half AND half <= run + d GROUP BY o_custkey)
SELECT r.o_custkey, CAST(any_value(n) AS INTEGER) AS n, round(2 * any_value(half), 5) AS length, round(any_value(mx), 4) AS mid_x, round(any_value(my), 4) AS mid_y FROM r JOIN m ON m.o_custkey = r.o_custkey WHERE n > 1 GROUP BY r.o_custkey"""

_OTHER = {
    "line_measures": _LINES,
    "projected_points": _ALBERS,
    "restart_antijoin": "SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS fips FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
}


def all_queries() -> dict[str, str]:
    return {**{k: _CTES + v for k, v in _FINAL.items()}, **{k: _BATCH + v for k, v in _BATCH_FINAL.items()}, **_OTHER}
