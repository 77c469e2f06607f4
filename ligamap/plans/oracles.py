"""DuckDB SQL for the named queries, written from the tables' definitions and not from the operators."""

from __future__ import annotations

from ligamap.plans.queries import BAD_AGP

PRELUDE = """
res(res_order, bp) AS (VALUES (0, 0), (1, 10), (2, 40), (3, 160)),
resolution AS (
  SELECT CAST(res_order AS INT) AS res_order, CAST(bp AS BIGINT) AS bp_resolution,
         CASE WHEN res_order > 1 THEN 1.0 / power(bp // 10, 2) ELSE 1.0 END AS quad_scale,
         CASE WHEN res_order > 1 THEN 1.0 / (bp // 10) ELSE 1.0 END AS lin_scale FROM res),
pk AS (SELECT p_partkey AS b, CAST(floor(sqrt(p_partkey)) AS INT) AS k, p_retailprice AS price FROM part),
contig AS (
  SELECT k AS contig_id, 'ctg_' || k AS name, CAST(10 * count(*) - k % 10 AS BIGINT) AS length_bp,
         'ctg_' || k AS source_name, 0 AS source_offset, min(b) AS b0 FROM pk GROUP BY k),
contig_res AS (
  SELECT CAST(res_order AS INT) AS res_order, contig_id,
         CAST(CASE WHEN res_order = 0 THEN length_bp ELSE (length_bp + bp - 1) // bp END AS BIGINT) AS length_bins,
         CASE WHEN res_order = 0 OR length_bp >= bp THEN 1 ELSE 0 END AS shown FROM contig, res),
stored AS (
  SELECT *, CAST(coalesce(sum(length_bins) OVER (PARTITION BY res_order ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c0
  FROM contig_res WHERE res_order > 0),
bins AS (
  SELECT s.res_order, b, price, c0 + ((b - b0) * 10) // bp AS bin
  FROM pk JOIN contig ON k = contig.contig_id JOIN stored s USING (contig_id) JOIN res ON res.res_order = s.res_order),
atu0 AS (
  SELECT res_order, contig_id, c0, unnest(range(c0 // 64, (c0 + length_bins - 1) // 64 + 1)) AS t, length_bins FROM stored),
contig_atu AS (
  SELECT res_order, contig_id, CAST(t - c0 // 64 AS INT) AS seq, CAST(t AS INT) AS stripe_id,
         CAST(greatest(c0, t * 64) - t * 64 AS INT) AS "start", CAST(least(c0 + length_bins, t * 64 + 64) - t * 64 AS INT) AS "end",
         DIRECTION AS dir, CAST(greatest(c0, t * 64) - c0 AS BIGINT) AS off FROM atu0),
weights AS (SELECT res_order, bin, avg(price / 1000) AS weight FROM bins GROUP BY ALL),
pairs AS (SELECT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
contact AS (
  SELECT p.res_order, least(p.bin, q.bin) AS lo, greatest(p.bin, q.bin) AS hi, CAST(count(*) AS BIGINT) AS v
  FROM pairs JOIN bins p ON x = p.b JOIN bins q ON y = q.b AND p.res_order = q.res_order GROUP BY ALL),
layout AS (
  SELECT CAST(row_number() OVER (ORDER BY (contig_id * 7) % 11, contig_id) AS INT) AS ord, contig_id,
         CASE WHEN contig_id % 3 = 0 THEN 0 ELSE 1 END AS dir FROM contig),
len AS (
  SELECT contig_id, res_order, length_bp AS bp, length_bins AS bins, CASE WHEN shown = 1 THEN length_bins ELSE 0 END AS pixels
  FROM contig_res JOIN contig USING (contig_id)),
pos AS (
  SELECT ord, contig_id, dir, res_order, bp, bins, pixels, e_bp - bp AS s_bp, e_bp, e_bins - bins AS s_bins, e_bins, e_px - pixels AS s_px, e_px
  FROM (SELECT *, CAST(sum(bp) OVER w AS BIGINT) AS e_bp, CAST(sum(bins) OVER w AS BIGINT) AS e_bins, CAST(sum(pixels) OVER w AS BIGINT) AS e_px
        FROM layout JOIN len USING (contig_id) WINDOW w AS (PARTITION BY res_order ORDER BY ord))),
atu_bins AS (
  SELECT res_order, contig_id, dir AS adir, off, "start", "end", stripe_id, unnest(range("start", "end")) AS t FROM contig_atu),
bpos AS (
  SELECT res_order, bin, CASE WHEN pixels > 0 THEN s_px + CASE WHEN dir = 1 THEN o ELSE pixels - 1 - o END END AS px,
         s_bins + CASE WHEN dir = 1 THEN o ELSE bins - 1 - o END AS bn
  FROM (SELECT res_order, contig_id, stripe_id * 64 + t AS bin, off + CASE WHEN adir = 1 THEN t - "start" ELSE "end" - 1 - t END AS o FROM atu_bins)
  JOIN pos USING (res_order, contig_id)),
half AS (
  SELECT c.res_order, a.px AS p, b.px AS q, a.bn AS pb, b.bn AS qb, v
  FROM contact c JOIN bpos a ON a.res_order = c.res_order AND a.bin = lo JOIN bpos b ON b.res_order = c.res_order AND b.bin = hi),
cells AS (
  SELECT * FROM half WHERE p IS NOT NULL AND q IS NOT NULL
  UNION ALL SELECT res_order, q, p, qb, pb, v FROM half WHERE p IS NOT NULL AND q IS NOT NULL AND pb <> qb),
cells_bins AS (SELECT * FROM half UNION ALL SELECT res_order, q, p, qb, pb, v FROM half WHERE pb <> qb),
t AS (SELECT max(e_bp) AS t, max(e_bp) // 5 AS lo, max(e_bp) // 2 AS hi FROM pos WHERE res_order = 0),
px1 AS (SELECT max(e_px) AS n FROM pos WHERE res_order = 1),
groups AS (SELECT *, CAST((ord - 1) // 4 AS BIGINT) AS g FROM pos WHERE res_order = 0),
scaffold AS (
  SELECT g AS scaffold_id, 'scaffold_' || g AS name, 500 + g AS spacer, min(s_bp) AS start_bp, max(e_bp) AS end_bp
  FROM groups WHERE g % 2 = 1 GROUP BY g),
ext AS (
  SELECT coalesce((SELECT start_bp FROM scaffold WHERE start_bp <= lo AND end_bp > lo), lo) AS a,
         coalesce((SELECT end_bp FROM scaffold WHERE start_bp < hi AND end_bp > hi), hi) AS b FROM t),
seg AS (SELECT min(ord) AS lo, max(ord) AS hi, min(s_bp) AS s, max(e_bp) AS e FROM pos, ext WHERE res_order = 0 AND s_bp < b AND e_bp > a),
seg0 AS (SELECT min(s_bp) AS s, max(e_bp) AS e FROM pos, t WHERE res_order = 0 AND s_bp < t.hi AND e_bp > t.lo),
snap AS (
  SELECT coalesce((SELECT start_bp FROM scaffold WHERE start_bp <= s AND end_bp > s), s) AS a,
         coalesce((SELECT end_bp FROM scaffold WHERE start_bp < e AND end_bp > e), e) AS b FROM seg0),
outside AS (
  SELECT l.ord, l.contig_id, l.dir, e_bp - CASE WHEN l.ord > seg.hi THEN seg.e - seg.s ELSE 0 END AS e
  FROM layout l JOIN pos ON pos.contig_id = l.contig_id AND res_order = 0, seg WHERE l.ord NOT BETWEEN seg.lo AND seg.hi),
tight AS (
  SELECT coalesce((SELECT max(end_bp) FROM scaffold WHERE start_bp <= lo AND end_bp > lo), lo) AS a,
         coalesce((SELECT min(start_bp) FROM scaffold WHERE start_bp <= hi - 1 AND end_bp > hi - 1), hi - 1) AS b FROM t),
dseg0 AS (SELECT min(s_bp) AS s, max(e_bp) AS e, (SELECT a FROM tight) < (SELECT b FROM tight) AS does FROM pos, tight WHERE res_order = 0 AND s_bp < tight.b AND e_bp > tight.a),
dext AS (
  SELECT does, coalesce((SELECT start_bp FROM scaffold WHERE start_bp <= s AND end_bp > s), s) AS a,
         coalesce((SELECT end_bp FROM scaffold WHERE start_bp < e AND end_bp > e), e) AS b FROM dseg0),
dseg AS (SELECT min(ord) AS lo, max(ord) AS hi, min(s_bp) AS s, max(e_bp) AS e FROM pos, dext WHERE does AND res_order = 0 AND s_bp < b AND e_bp > a),
dscaffold AS (
  SELECT * FROM scaffold WHERE NOT EXISTS (SELECT 1 FROM dext WHERE does AND start_bp < b AND end_bp > a)
  UNION ALL SELECT CAST(1 AS BIGINT), 'scaffold_debris_1', CAST(1000 AS BIGINT), a, b FROM dext WHERE does),
hit AS (SELECT pos.*, t // 3 - s_bp AS d FROM pos, t WHERE res_order = 0 AND s_bp <= t // 3 AND e_bp > t // 3),
top AS (SELECT max(contig_id) AS top FROM contig),
cutat AS (
  SELECT r.res_order, res.bp, length_bins, CASE WHEN r.res_order = 0 THEN d ELSE d // greatest(res.bp, 1) END AS cut,
         CASE WHEN r.res_order = 0 THEN 10 WHEN r.res_order = 1 THEN 1 ELSE 0 END AS lost, hit.dir, hit.bp AS whole, d
  FROM contig_res r JOIN hit USING (contig_id) JOIN res ON res.res_order = r.res_order),
held AS (
  SELECT res_order, bp, top + 1 AS contig_id, d AS bps, CASE WHEN dir = 1 THEN 0 ELSE length_bins - cut END AS f, CASE WHEN dir = 1 THEN cut ELSE length_bins END AS l FROM cutat, top
  UNION ALL
  SELECT res_order, bp, top + 2, whole - d - 10, CASE WHEN dir = 1 THEN cut + lost ELSE 0 END, CASE WHEN dir = 1 THEN length_bins ELSE length_bins - cut - lost END FROM cutat, top),
members AS (
  SELECT *, CAST(sum(CASE WHEN scaffold_id IS NOT NULL AND scaffold_id IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (ORDER BY ord) AS BIGINT) AS group_no
  FROM (SELECT pos.ord, pos.contig_id, pos.dir, pos.bp, scaffold_id, scaffold.name AS sname, coalesce(spacer, 0) AS g, lag(scaffold_id) OVER (ORDER BY ord) AS prev
        FROM pos LEFT JOIN scaffold ON s_bp >= start_bp AND s_bp < end_bp WHERE res_order = 0)),
placed AS (
  SELECT m.*, name, row_number() OVER w AS n, count(*) OVER (PARTITION BY group_no) AS cnt,
         1 + sum(m.bp) OVER w - m.bp + (row_number() OVER w - 1) * g AS b, coalesce(sname, 'unscaffolded_' || name) AS obj
  FROM members m JOIN contig USING (contig_id) WINDOW w AS (PARTITION BY group_no ORDER BY ord)),
agp AS (
  SELECT ord, 0 AS k, obj, CAST(b AS BIGINT) AS beg, CAST(b + bp - 1 AS BIGINT) AS fin, CASE WHEN g > 0 THEN 2 * n - 1 ELSE n END AS part, 'W' AS typ,
         name AS f5, '1' AS f6, CAST(bp AS VARCHAR) AS f7, CASE WHEN dir = 1 THEN '+' ELSE '-' END AS f8 FROM placed
  UNION ALL
  SELECT ord, 1, obj, CAST(b + bp AS BIGINT), CAST(b + bp + g - 1 AS BIGINT), 2 * n, 'N', CAST(g AS VARCHAR), 'scaffold', 'yes', 'proximity_ligation'
  FROM placed WHERE g > 0 AND n < cnt),
agp_lines AS (
  SELECT CAST(row_number() OVER (ORDER BY ord, k) AS INT) AS line_no, concat_ws(chr(9), obj, beg, fin, part, typ, f5, f6, f7, f8) AS line, * FROM agp),
objects AS (
  SELECT obj, min(line_no) AS first, count(*) AS n, CAST(sum(CASE WHEN typ = 'W' THEN fin - beg + 1 ELSE 0 END) AS BIGINT) AS size,
         coalesce(max(CASE WHEN typ = 'N' THEN CAST(f5 AS BIGINT) END), 1000) AS spacer FROM agp_lines GROUP BY obj),
bad(line_no, line) AS (VALUES BAD_LINES),
bad_fields AS (SELECT line_no, string_split(trim(line), chr(9)) AS f FROM bad)
"""

WIN = "p BETWEEN 37 AND 149 AND q BETWEEN 37 AND 149"
LAYOUT_OF = "SELECT CAST(row_number() OVER (ORDER BY place, o) AS INT) AS ord, contig_id, dir FROM ({})"
MOVED = (
    "SELECT CASE WHEN e <= k THEN 0 ELSE 2 END AS place, ord AS o, contig_id, dir FROM outside, (SELECT {target} - CASE WHEN s > {target} THEN 0 ELSE e - s END AS k FROM seg, t) "
    "UNION ALL SELECT 1, l.ord, contig_id, dir FROM layout l, seg WHERE l.ord BETWEEN seg.lo AND seg.hi"
)
MOVED_ALL = f"({LAYOUT_OF.format(MOVED.format(target='(3 * t) // 4'))})"
DEBRIS = (
    "SELECT CASE WHEN coalesce(l.ord BETWEEN dseg.lo AND dseg.hi, false) THEN 1 ELSE 0 END AS place, l.ord AS o, contig_id, dir FROM layout l, dseg"
)
ENDS = "SELECT contig_id, CAST(sum(length_bp) OVER (ORDER BY ord) AS BIGINT) - length_bp AS s2 FROM {} JOIN contig USING (contig_id)"
FOLLOW = (
    "SELECT scaffold_id, c.name, spacer, start_bp + s2 - s_bp AS start_bp, end_bp + s2 - s_bp AS end_bp FROM {scaffold} c JOIN pos ON res_order = 0 AND start_bp >= s_bp AND start_bp < e_bp "
    "JOIN ({ends}) USING (contig_id)"
)


def _signal(order: int, window: str, low: int, expression: str) -> str:
    weight = "JOIN (SELECT px, weight FROM bpos JOIN weights USING (res_order, bin) WHERE res_order = {o}) {w} ON {w}.px = {x}"
    return (
        f"SELECT p - {low} AS i, q - {low} AS j, round({expression}, 6) AS signal FROM cells {weight.format(o=order, w='rw', x='p').replace('weight FROM', 'weight AS r FROM')} "
        f"{weight.format(o=order, w='cw', x='q').replace('weight FROM', 'weight AS c FROM')} WHERE cells.res_order = {order} AND {window}"
    )


_ERROR = """
SELECT CAST(line_no AS INT) AS line_no, error FROM (
  SELECT line_no, CASE
    WHEN len(f) < 9 THEN 'columns'
    WHEN f[5] NOT IN ('W', 'A', 'D', 'F', 'G', 'O', 'P', 'N', 'U') THEN 'component_type'
    WHEN f[5] NOT IN ('N', 'U') AND f[9] NOT IN ('+', '-', '?', '0', 'na') THEN 'orientation'
    WHEN f[5] IN ('N', 'U') AND f[7] NOT IN ('scaffold', 'contig', 'centromere', 'short_arm', 'heterochromatin', 'telomere', 'repeat', 'contamination') THEN 'gap_type'
    WHEN f[5] IN ('N', 'U') AND f[8] NOT IN ('yes', 'no') THEN 'linkage'
    WHEN f[5] IN ('N', 'U') AND f[9] <> 'proximity_ligation' THEN 'evidence'
    WHEN f[5] IN ('N', 'U') THEN NULL
    WHEN length_bp IS NULL THEN 'unknown_contig'
    WHEN CAST(f[3] AS BIGINT) - CAST(f[2] AS BIGINT) <> CAST(f[8] AS BIGINT) - CAST(f[7] AS BIGINT) THEN 'length_mismatch'
    WHEN CAST(f[8] AS BIGINT) - CAST(f[7] AS BIGINT) + 1 > length_bp THEN 'longer_than_contig'
    WHEN CAST(f[8] AS BIGINT) - CAST(f[7] AS BIGINT) + 1 < length_bp THEN 'shorter_than_contig' END AS error
  FROM bad_fields LEFT JOIN contig ON contig.name = f[6]) WHERE error IS NOT NULL"""

_ATUS = """
SELECT CAST(row_number() OVER (ORDER BY p0) AS INT) AS seq, stripe_id,
       CAST(min(t) AS INT) AS "start", CAST(max(t) + 1 AS INT) AS "end", eff AS dir
FROM (SELECT stripe_id, t, CASE WHEN adir = pos.dir THEN 1 ELSE 0 END AS eff, px, min(px) OVER (PARTITION BY a.contig_id, stripe_id, a."start") AS p0, a.contig_id, a."start" AS s0
      FROM atu_bins a JOIN pos USING (res_order, contig_id) JOIN bpos ON bpos.res_order = a.res_order AND bpos.bin = stripe_id * 64 + t
      WHERE a.res_order = {order} AND px >= {a} AND px < {b})
GROUP BY contig_id, stripe_id, s0, eff, p0"""

_PADDED = """
SELECT i, j, coalesce(v, 0) AS v FROM (SELECT i, j FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j))
LEFT JOIN (SELECT p + 8 AS i, q - n + 40 AS j, v FROM cells, px1 WHERE res_order = 1 AND p < 56 AND q >= n - 40) USING (i, j)"""

_SMALL = """
SELECT i, j, coalesce(v, 0) AS v FROM (SELECT i, j FROM (SELECT unnest(range(32)) AS i), (SELECT unnest(range(32)) AS j))
LEFT JOIN (SELECT p - 37 AS i, q - 37 AS j, v FROM cells WHERE res_order = 1 AND p BETWEEN 37 AND 68 AND q BETWEEN 37 AND 68) USING (i, j)"""

_CLIPPED = """
SELECT a.res_order, h.contig_id, a.stripe_id, a.dir, a."start", a."end", greatest(f - off, 0) AS x0, least(l - off, "end" - "start") AS x1, off, f
FROM contig_atu a JOIN hit USING (contig_id) JOIN held h ON h.res_order = a.res_order"""

_BINS = "(SELECT res_order, CAST(sum(length_bins) AS BIGINT) AS bins FROM contig_res GROUP BY res_order)"

BODIES = {
    "resolutions": f"SELECT resolution.*, bins FROM resolution JOIN {_BINS} USING (res_order)",
    "resolution_lower_bound": "SELECT CAST(r AS BIGINT) AS requested_bp, CAST(CASE WHEN r < 1 THEN 0 ELSE (SELECT min(res_order) FROM res WHERE bp >= r) END AS INT) AS res_order FROM (SELECT DISTINCT p_partkey * 7 % 200 AS r FROM part) x",
    "pixel_ratios": f"SELECT CAST(bp AS BIGINT) AS bp_resolution, bins, bp / 10.0::DOUBLE AS ratio FROM res JOIN {_BINS} USING (res_order) WHERE res_order > 0",
    "contig_lengths_units": "SELECT contig_id, res_order, bp, bins, CAST(pixels AS BIGINT) AS pixels FROM len",
    "matrix_sizes": "SELECT res_order, CAST(sum(bins) AS BIGINT) AS bins, CAST(sum(pixels) AS BIGINT) AS pixels, count(*) AS contigs FROM len GROUP BY res_order",
    "initial_layout": "SELECT * FROM layout",
    "layout_positions": "SELECT ord, contig_id, s_bp, e_bp, s_bins, s_px FROM pos WHERE res_order = 1",
    "visible_contigs": "SELECT res_order, contig_id FROM contig_res WHERE res_order > 0 AND shown = 1",
    "edge_contigs": "SELECT res_order, arg_min(contig_id, ord) AS first_id, arg_max(contig_id, ord) AS last_id, arg_min(contig_id, ord) FILTER (shown = 1) AS first_visible, arg_max(contig_id, ord) FILTER (shown = 1) AS last_visible FROM layout JOIN contig_res USING (contig_id) WHERE res_order > 0 GROUP BY res_order",
    "atu_dictionary": 'SELECT res_order, stripe_id, "start", "end", dir FROM contig_atu',
    "atu_prefix_sums": "SELECT res_order, contig_id, seq, off FROM contig_atu",
    "expose_range_bp": "SELECT CASE WHEN s_bp < hi AND e_bp > lo THEN 'seg' WHEN e_bp <= lo THEN 'less' ELSE 'greater' END AS part, contig_id, ord FROM pos, t WHERE res_order = 0",
    "expose_range_px": "SELECT CASE WHEN CASE WHEN pixels > 0 THEN s_px < n // 2 AND e_px > n // 5 ELSE s_px >= n // 5 AND s_px < n // 2 END THEN 'seg' WHEN CASE WHEN pixels > 0 THEN e_px <= n // 5 ELSE s_px < n // 5 END THEN 'less' ELSE 'greater' END AS part, contig_id, ord FROM pos, (SELECT max(e_px) AS n FROM pos WHERE res_order = 3) WHERE res_order = 3",
    "split_by_count": "SELECT CASE WHEN ord <= 7 THEN 'left' ELSE 'right' END AS side, contig_id FROM layout",
    "convert_units": """SELECT pos, "from", "to", CAST(result AS BIGINT) AS result FROM (
  SELECT x.pos, 'bp@0' AS "from", 'bins@1' AS "to", b.s_bins + (x.pos - a.s_bp) // 10 AS result FROM asked x JOIN pos a ON a.res_order = 0 AND x.pos >= a.s_bp AND x.pos < a.e_bp JOIN pos b ON b.res_order = 1 AND b.ord = a.ord
  UNION ALL SELECT x.pos, 'pixels@1', 'bp@0', b.s_bp + (x.pos - a.s_px) * 10 FROM asked x JOIN pos a ON a.res_order = 1 AND x.pos >= a.s_px AND x.pos < a.e_px JOIN pos b ON b.res_order = 0 AND b.ord = a.ord
  UNION ALL SELECT x.pos, 'bins@2', 'pixels@1', b.s_px + ((x.pos - a.s_bins) * 40) // 10 FROM asked x JOIN pos a ON a.res_order = 2 AND x.pos >= a.s_bins AND x.pos < a.e_bins JOIN pos b ON b.res_order = 1 AND b.ord = a.ord)""",
    "atus_for_range": _ATUS.format(order=1, a=37, b=150),
    "block_directory": "SELECT CAST(lo // 64 AS INT) AS row_stripe, CAST(hi // 64 AS INT) AS col_stripe, count(*) AS nnz FROM contact WHERE res_order = 1 GROUP BY ALL",
    "atu_intersection": "SELECT CAST(r AS INT) AS i, CAST(63 - c AS INT) AS j, v FROM (SELECT hi - 64 - 5 AS r, lo AS c, v FROM contact WHERE res_order = 1 AND lo BETWEEN 10 AND 63 AND hi BETWEEN 69 AND 103)",
    "submatrix_symmetric": f"SELECT p - 37 AS i, q - 37 AS j, v FROM cells WHERE res_order = 1 AND {WIN}",
    "submatrix_asymmetric": "SELECT p - n // 10 AS i, q - n // 2 AS j, v FROM cells, px1 WHERE res_order = 1 AND p >= n // 10 AND p < n // 10 + 113 AND q >= n // 2 AND q < n // 2 + 97",
    "submatrix_padded": _PADDED,
    "submatrix_bins_vs_pixels": "SELECT 'pixels' AS mode, p - 3 AS i, q - 3 AS j, v FROM cells WHERE res_order = 3 AND p BETWEEN 3 AND 59 AND q BETWEEN 3 AND 59 UNION ALL SELECT 'bins', pb - 3, qb - 3, v FROM cells_bins WHERE res_order = 3 AND pb BETWEEN 3 AND 59 AND qb BETWEEN 3 AND 59",
    "submatrix_dense_rows": f"SELECT i, string_agg(v, ',' ORDER BY j) AS row FROM ({_SMALL}) GROUP BY i",
    "submatrix_reversed_atu": f"SELECT p - 37 AS i, q - 37 AS j, v FROM cells WHERE res_order = 1 AND {WIN}",
    "range_weights": "SELECT px - 37 AS i, round(weight, 6) AS weight FROM bpos JOIN weights USING (res_order, bin) WHERE res_order = 1 AND px BETWEEN 37 AND 149",
    "tile_prelog": _signal(1, WIN, 37, "ln(1 + v) / ln(10)"),
    "tile_scaled": _signal(2, "p BETWEEN 3 AND 49 AND q BETWEEN 3 AND 49", 3, "ln(1 + v) / ln(10) * (1.0 / 16) * (1.0 / 4)"),
    "tile_weighted": _signal(1, WIN, 37, "ln(1 + v) / ln(10) * r * c"),
    "tile_postlog": _signal(1, WIN, 37, "ln(1 + ln(1 + v) / ln(10)) / ln(2)"),
    "tile_apply_weights": _signal(1, WIN, 37, "v * r * c"),
    "tile_rgba": f"SELECT i, j, CAST(floor(255 + (0 - 255) * s + 0.5) AS INT) AS red, CAST(floor(255 + (96 - 255) * s + 0.5) AS INT) AS green, CAST(floor(255 + (0 - 255) * s + 0.5) AS INT) AS blue, CAST(floor(0 + 255 * s + 0.5) AS INT) AS alpha FROM (SELECT i, j, greatest(0.0, least(1.0, ln(1 + v) / ln(10) / 2.0)) AS s FROM ({_SMALL}))",
    "tile_stats": "SELECT p // 64 AS tile_row, q // 64 AS tile_col, count(*) AS nnz, min(v) AS min, max(v) AS max, CAST(sum(v) AS BIGINT) AS sum FROM cells WHERE res_order = 1 GROUP BY ALL",
    "tile_grid_coarse": "SELECT res_order, p // 64 AS tile_row, q // 64 AS tile_col, CAST(sum(v) AS BIGINT) AS sum FROM cells GROUP BY ALL",
    "append_contig": "SELECT * FROM layout UNION ALL SELECT CAST((SELECT max(ord) + 1 FROM layout) AS INT), 999999, 1",
    "scaffold_list": "SELECT scaffold_id, name, start_bp, end_bp FROM scaffold",
    "scaffold_at_bp": "SELECT bp, scaffold_id, start_bp, end_bp FROM (SELECT unnest([0, lo, hi, t - 1, t]) AS bp FROM t) LEFT JOIN scaffold ON bp >= start_bp AND bp < end_bp",
    "extend_borders": "SELECT a AS start_bp, b AS end_bp FROM ext",
    "scaffolds_in_range": "SELECT count(*) AS n FROM scaffold, t WHERE start_bp < hi AND end_bp > lo",
    "contigs_in_scaffolds": "SELECT group_no, scaffold_id, contig_id FROM members",
    "reverse_range": "SELECT CAST(CASE WHEN l.ord BETWEEN seg.lo AND seg.hi THEN seg.lo + seg.hi - l.ord ELSE l.ord END AS INT) AS ord, contig_id, CASE WHEN l.ord BETWEEN seg.lo AND seg.hi THEN 1 - dir ELSE dir END AS dir FROM layout l, seg",
    "reverse_scaffolds": "SELECT scaffold_id, name, spacer, CASE WHEN start_bp >= s AND end_bp <= e THEN s + e - end_bp ELSE start_bp END AS start_bp, CASE WHEN start_bp >= s AND end_bp <= e THEN s + e - start_bp ELSE end_bp END AS end_bp FROM scaffold, seg",
    "move_range_right": LAYOUT_OF.format(MOVED.format(target="(3 * t) // 4")),
    "move_range_left": LAYOUT_OF.format(MOVED.format(target="t // 10")),
    "move_scaffolds": FOLLOW.format(scaffold="scaffold", ends=ENDS.format(MOVED_ALL)),
    "scaffold_region": "SELECT * FROM scaffold WHERE NOT EXISTS (SELECT 1 FROM snap WHERE start_bp < b AND end_bp > a) UNION ALL SELECT CAST(1 AS BIGINT), 'scaffold_auto_1', CAST(1000 AS BIGINT), a, b FROM snap",
    "unscaffold_region": "SELECT * FROM scaffold WHERE NOT EXISTS (SELECT 1 FROM snap WHERE start_bp < b AND end_bp > a)",
    "clear_scaffolds": "SELECT * FROM scaffold WHERE NOT EXISTS (SELECT 1 FROM ext WHERE start_bp < b AND end_bp > a)",
    "debris_layout": LAYOUT_OF.format(DEBRIS),
    "debris_scaffolds": FOLLOW.format(scaffold="dscaffold", ends=ENDS.format(f"({LAYOUT_OF.format(DEBRIS)})")),
    "split_contig": """SELECT contig_id, name, length_bp, source_name, CAST(source_offset AS INT) AS source_offset FROM contig WHERE contig_id NOT IN (SELECT contig_id FROM hit)
UNION ALL SELECT CAST(top + 1 AS INT), c.name || CASE WHEN dir = 1 THEN '' ELSE '_reversed' END || '_0_' || d, d, source_name, CASE WHEN dir = 1 THEN 0 ELSE 10 END FROM hit JOIN contig c USING (contig_id), top
UNION ALL SELECT CAST(top + 2 AS INT), c.name || CASE WHEN dir = 1 THEN '' ELSE '_reversed' END || '_' || (bp - d - 10) || '_' || bp, bp - d - 10, source_name, CASE WHEN dir = 1 THEN 10 ELSE 0 END FROM hit JOIN contig c USING (contig_id), top""",
    "split_contig_res": "SELECT res_order, contig_id, length_bins, shown FROM contig_res WHERE contig_id NOT IN (SELECT contig_id FROM hit) UNION ALL SELECT res_order, CAST(contig_id AS INT), CAST(l - f AS BIGINT), CASE WHEN res_order = 0 OR bps >= bp THEN 1 ELSE 0 END FROM held",
    "split_contig_atus": f"""SELECT res_order, contig_id, seq, stripe_id, "start", "end", dir, off FROM contig_atu WHERE contig_id NOT IN (SELECT contig_id FROM hit)
UNION ALL SELECT res_order, CAST(contig_id AS INT), CAST(row_number() OVER (PARTITION BY res_order, contig_id ORDER BY off) - 1 AS INT), stripe_id,
  CAST(CASE WHEN dir = 1 THEN "start" + x0 ELSE "end" - x1 END AS INT), CAST(CASE WHEN dir = 1 THEN "start" + x1 ELSE "end" - x0 END AS INT), dir, CAST(off + x0 - f AS BIGINT) FROM ({_CLIPPED}) WHERE x0 < x1""",
    "split_contig_layout": LAYOUT_OF.format("SELECT ord AS place, 0 AS o, contig_id, dir FROM layout WHERE contig_id NOT IN (SELECT contig_id FROM hit) UNION ALL SELECT ord, n, CAST(top + n AS INT), dir FROM hit, top, (VALUES (1), (2)) x(n)"),
    "agp_export": "SELECT line_no, line FROM agp_lines",
    "agp_parse": """SELECT line_no, CASE WHEN typ = 'W' THEN 'W' ELSE 'gap' END AS kind, CAST(NULL AS VARCHAR) AS error, obj AS object, beg AS object_beg, fin AS object_end, CAST(part AS INT) AS part,
  CASE WHEN typ = 'W' THEN f5 END AS component, CASE WHEN typ = 'W' THEN CAST(f6 AS BIGINT) END AS component_beg, CASE WHEN typ = 'W' THEN CAST(f7 AS BIGINT) END AS component_end,
  CASE WHEN f8 = '+' THEN 'plus' WHEN f8 = '-' THEN 'minus' END AS orientation, CASE WHEN typ = 'N' THEN CAST(f5 AS BIGINT) END AS gap_length, CASE WHEN typ = 'N' THEN f6 END AS gap_type,
  CASE WHEN typ = 'N' THEN f7 = 'yes' END AS linkage, CASE WHEN typ = 'N' THEN f8 END AS evidence FROM agp_lines""",
    "agp_validate": _ERROR,
    "agp_import_layout": "SELECT CAST(row_number() OVER (ORDER BY line_no) AS INT) AS ord, contig_id, CASE WHEN f8 = '-' THEN 0 ELSE 1 END AS dir FROM agp_lines JOIN contig ON contig.name = f5 WHERE typ = 'W'",
    "agp_import_scaffolds": "SELECT CAST(1 + row_number() OVER (ORDER BY first) AS BIGINT) AS scaffold_id, obj AS name, spacer, e - size AS start_bp, e AS end_bp FROM (SELECT *, CAST(sum(size) OVER (ORDER BY first) AS BIGINT) AS e FROM objects) WHERE n > 1 OR NOT starts_with(obj, 'unscaffolded')",
    "version_gate": "SELECT event_id, user_id AS version, coalesce(user_id >= max(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM events",
}

_REVERSED = {"submatrix_reversed_atu", "atus_for_range", "imported_atus", "imported_submatrix"}

_MAPS = """SELECT contig_id, '{' || string_agg('"' || bp || '":' || length_bins, ',' ORDER BY bp) || '}' AS bins,
  '{' || string_agg('"' || bp || '":' || shown, ',' ORDER BY bp) || '}' AS shown FROM contig_res JOIN res USING (res_order) WHERE res_order > 0 GROUP BY contig_id"""

BODIES |= {
    "contig_maps": _MAPS,
    "assembly_json": f"""SELECT 'contig' AS kind, CAST(ord AS BIGINT) AS place, '{{"contigId":' || contig_id || ',"contigName":"' || name || '","contigDirection":' || dir || ',"contigLengthBp":' || length_bp
  || ',"contigLengthBins":' || bins || ',"contigPresenceAtResolution":' || shown || '}}' AS json FROM layout JOIN contig USING (contig_id) JOIN ({_MAPS}) USING (contig_id)
UNION ALL SELECT 'scaffold', start_bp, '{{"scaffoldId":' || scaffold_id || ',"scaffoldName":"' || name || '","spacerLength":' || spacer || ',"scaffoldBordersBP":{{"startBP":' || start_bp || ',"endBP":' || end_bp || '}}}}' FROM scaffold""",
    "opened_json": """SELECT '{"resolutions":[' || string_agg(bp, ',' ORDER BY bp DESC) || '],"pixelResolutions":[' || string_agg(CAST(bp / 10.0::DOUBLE AS VARCHAR), ',' ORDER BY bp DESC)
  || '],"tileSize":64,"matrixSizesBins":[' || string_agg(n, ',' ORDER BY bp DESC) || ']}' AS json FROM (SELECT bp, CAST(sum(length_bins) AS BIGINT) AS n FROM contig_res JOIN res USING (res_order) WHERE res_order > 0 GROUP BY bp)""",
    "tile_raster": f"SELECT i, string_agg(printf('%02x%02x%02x%02x', red, green, blue, alpha), '' ORDER BY j) AS pixels FROM ({BODIES['tile_rgba']}) GROUP BY i",
    "resolutions_discovered": "SELECT CAST(row_number() OVER (ORDER BY bp) - 1 AS INT) AS res_order, CAST(bp AS BIGINT) AS bp_resolution FROM (SELECT 0 AS bp UNION SELECT 10 * (1 + p_partkey % 7) FROM part WHERE p_partkey % 4 = 0)",
    "block_edges": "SELECT contig_id % 7 AS dataset, CAST(coalesce(max(CASE WHEN contig_id % 7 < 3 THEN length_bins END), 256) AS INT) AS edge FROM contig_res WHERE res_order = 1 GROUP BY 1",
    "listed_files": """SELECT kind, path FROM (SELECT 'data/' || p_partkey || ['.agp', '.FASTA', '.mcool', '.cool', '.txt', '.AGP.gz'][1 + p_partkey % 6] AS path, p_partkey % 6 AS k FROM part),
  (VALUES ('all', NULL), ('agp', [0]), ('fasta', [1]), ('coolers', [2, 3])) x(kind, ks) WHERE ks IS NULL OR list_contains(ks, k)""",
    "colours_parsed": """SELECT p_partkey AS k, CASE WHEN p_partkey % 10 <> 3 THEN CAST(p_partkey % 256 AS INT) END AS red, CASE WHEN p_partkey % 10 <> 3 THEN CAST(p_partkey % 200 AS INT) END AS green,
  CASE WHEN p_partkey % 10 <> 3 THEN 17 END AS blue, CASE WHEN p_partkey % 10 <> 3 THEN [255, 127, 63, 0][1 + p_partkey % 4] END AS alpha FROM part""",
    "imported_atus": 'SELECT res_order, contig_id, seq, stripe_id, "start", "end", dir, off FROM contig_atu',
    "imported_contacts": "SELECT res_order, CAST(lo // 64 AS INT) AS row_stripe, CAST(hi // 64 AS INT) AS col_stripe, CAST(lo % 64 AS INT) AS r, CAST(hi % 64 AS INT) AS c, v FROM contact WHERE res_order = 1",
    "imported_layout": "SELECT * FROM layout",
    "imported_presence": "SELECT * FROM contig_res",
    "imported_weights": "SELECT res_order, CAST(bin // 64 AS INT) AS stripe_id, CAST(bin % 64 AS INT) AS off, round(weight, 6) AS weight FROM weights",
    "imported_submatrix": BODIES["submatrix_symmetric"],
}

_LINES = """(SELECT *, lo + (q - 1) * (q - 1) AS hi FROM (
  SELECT row_number() OVER () AS line, l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS q, (l_partkey * 7919 + l_suppkey * 31 + l_orderkey) % (t.t + 50) AS lo FROM lineitem, t) x) ask"""
_MET = f"FROM {_LINES} LEFT JOIN (SELECT * FROM pos WHERE res_order = 0) p ON s_bp < ask.hi AND e_bp > ask.lo"
_SEGS = f"(SELECT l_orderkey, l_linenumber, min(s_bp) AS s, max(e_bp) AS e {_MET} GROUP BY line, l_orderkey, l_linenumber) seg1"

BODIES |= {
    "ranges_to_contigs": f"SELECT l_orderkey, l_linenumber, arg_min(contig_id, ord) AS first_id, arg_max(contig_id, ord) AS last_id, count(ord) AS n {_MET} GROUP BY line, l_orderkey, l_linenumber",
    "ranges_over_contigs": f"SELECT contig_id, count(*) AS n, CAST(sum(least(ask.hi, e_bp) - greatest(ask.lo, s_bp)) AS BIGINT) AS bp {_MET} WHERE contig_id IS NOT NULL GROUP BY ALL",
    "points_in_scaffolds": f"SELECT l_orderkey, l_linenumber, scaffold_id, ask.lo - start_bp AS off FROM {_LINES} LEFT JOIN scaffold ON ask.lo >= start_bp AND ask.lo < end_bp",
    "points_converted": f"SELECT DISTINCT ask.lo AS pos, CAST(b.s_px + (ask.lo - a.s_bp) // 40 AS BIGINT) AS result FROM {_LINES} JOIN pos a ON a.res_order = 0 AND ask.lo >= a.s_bp AND ask.lo < a.e_bp JOIN pos b ON b.res_order = 2 AND b.ord = a.ord",
    "ranges_snapped": f"SELECT l_orderkey, l_linenumber, CAST(coalesce(x.start_bp, s) AS BIGINT) AS seg_start, CAST(coalesce(y.end_bp, e) AS BIGINT) AS seg_end FROM {_SEGS} LEFT JOIN scaffold x ON x.start_bp <= s AND x.end_bp > s LEFT JOIN scaffold y ON y.start_bp < e AND y.end_bp > e",
}

BODIES["tiles_encoded"] = """
SELECT tile_row, tile_col, sha256(unhex(string_agg(printf('%02x%02x%02x%02x', CAST(floor(255 - 255 * s + 0.5) AS INT), CAST(floor(255 - 159 * s + 0.5) AS INT), CAST(floor(255 - 255 * s + 0.5) AS INT), CAST(floor(255 * s + 0.5) AS INT)), '' ORDER BY i, j))) AS raster_sha256
FROM (SELECT tile_row, tile_col, i, j, least(1.0, greatest(0.0, coalesce(ln(1 + v) / ln(10), 0) / 2.0)) AS s
  FROM (SELECT DISTINCT p // 64 AS tile_row, q // 64 AS tile_col FROM cells WHERE res_order = 2) CROSS JOIN (SELECT unnest(range(64)) AS i) CROSS JOIN (SELECT unnest(range(64)) AS j)
  LEFT JOIN (SELECT p, q, v FROM cells WHERE res_order = 2) ON p = tile_row * 64 + i AND q = tile_col * 64 + j)
GROUP BY tile_row, tile_col"""
BODIES["agp_read_back"] = BODIES["agp_parse"]
BODIES["version_gate_shared_ids"] = """SELECT request_id, version, coalesce(version >= max(version) OVER (ORDER BY request_id NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), true) AS accepted FROM (
  SELECT CASE WHEN l_linenumber < 7 THEN CASE WHEN l_orderkey % 1000 = 1 THEN l_orderkey * 1000000000 ELSE l_orderkey END END AS request_id,
    CAST(CASE WHEN l_partkey % 50 > 0 THEN l_orderkey // 8 + l_partkey % 97 END AS BIGINT) AS version FROM lineitem)"""

_ENDS = "list_transform(range(1, len({0}) + 1), lambda i: list_sum(list_transform({0}[1:i], lambda x: x.n)))"
BODIES |= {
    "edits_composed": f""", edit AS (
  SELECT 2 * k + 1 AS k, 'reverse' AS op, (k * 7919 + 13) % t.t AS lo, (k * 7919 + 13) % t.t + 1 + k * 104729 % (t.t // 3) AS hi, 0 AS target FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation), t
  UNION ALL SELECT 2 * k + 2, 'move', (k * 15485863 + 7) % t.t, (k * 15485863 + 7) % t.t + 1 + k * 32452843 % (t.t // 4), k * 49979687 % t.t FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation), t),
run AS (
  SELECT CAST(0 AS BIGINT) AS k, (SELECT list({{'c': contig_id, 'd': dir, 'n': CAST(bp AS BIGINT)}} ORDER BY ord) FROM pos WHERE res_order = 0) AS seq
  UNION ALL
  SELECT k, CASE WHEN op = 'reverse' THEN seq[1:f - 1] || list_reverse(list_transform(seq[f:l], lambda x: {{'c': x.c, 'd': 1 - x.d, 'n': x.n}})) || seq[l + 1:]
    ELSE rest[1:n_left] || seq[f:l] || rest[n_left + 1:] END
  FROM (SELECT *, len(list_filter({_ENDS.format("rest")}, lambda e: e <= aim)) AS n_left
    FROM (SELECT *, seq[1:f - 1] || seq[l + 1:] AS rest, target - CASE WHEN coalesce(ends[f - 1], 0) > target THEN 0 ELSE ends[l] - coalesce(ends[f - 1], 0) END AS aim
      FROM (SELECT *, 1 + len(list_filter(ends, lambda e: e <= lo)) AS f, least(len(seq), 1 + len(list_filter(ends, lambda e: e < hi))) AS l
        FROM (SELECT edit.k, op, lo, hi, target, seq, {_ENDS.format("seq")} AS ends FROM run JOIN edit ON edit.k = run.k + 1)))))
SELECT CAST(i AS INT) AS ord, x.c AS contig_id, x.d AS dir FROM (SELECT unnest(seq) AS x, generate_subscripts(seq, 1) AS i FROM run WHERE k = (SELECT max(k) FROM run))""",
    "layout_versions": " UNION ALL ".join(f"SELECT *, {k} AS version FROM ({BODIES[name]})" for k, name in enumerate(("reverse_range", "move_range_right", "split_contig_layout"), 1)),
}

BODIES["edits_from_requests"] = BODIES["edits_composed"]
BODIES["requests_decoded"] = """SELECT request_id, endpoint, CASE WHEN good AND form <> 1 THEN p END AS start, CASE WHEN good THEN p + 10 END AS "end", CASE WHEN good THEN p * 3 END AS target,
  CASE WHEN good AND form <> 1 THEN p % 100 END AS split_px, CASE WHEN good THEN 10 END AS bp_resolution, CASE WHEN good THEN 's' || p % 5 END AS scaffold_name, CAST(NULL AS BIGINT) AS spacer,
  CASE WHEN endpoint = 'close' THEN 'unknown endpoint' WHEN NOT good THEN 'unreadable body' WHEN form = 1 THEN CASE WHEN endpoint = 'split_contig_at_bin' THEN 'missing splitPx' ELSE 'missing startBP' END END AS problem
FROM (SELECT l_orderkey * 10 + l_linenumber AS request_id, CAST(l_partkey AS BIGINT) AS p, l_suppkey % 9 AS form, l_suppkey % 9 NOT IN (0, 2) AS good,
    ['reverse_selection_range', 'move_selection_range', 'split_contig_at_bin', 'group_contigs_into_scaffold', 'ungroup_contigs_from_scaffold', 'move_selection_to_debris', 'close'][1 + l_partkey % 7] AS endpoint FROM lineitem)"""

BODIES["atus_coalesced"] = f"""
SELECT CAST(run AS INT) AS seq, stripe_id, CAST(min("start") AS INT) AS "start", CAST(max("end") AS INT) AS "end", dir FROM (
  SELECT *, sum(new) OVER (ORDER BY seq) AS run FROM (
    SELECT *, CASE WHEN coalesce(lag(stripe_id) OVER (ORDER BY seq) = stripe_id AND lag(dir) OVER (ORDER BY seq) = dir
                AND CASE WHEN dir = 1 THEN lag("end") OVER (ORDER BY seq) = "start" ELSE lag("start") OVER (ORDER BY seq) = "end" END, false) THEN 0 ELSE 1 END AS new
    FROM ({_ATUS.format(order=2, a=0, b=60)})))
GROUP BY run, stripe_id, dir"""


def oracle_sql() -> dict[str, str]:
    lines = ", ".join("({}, '{}')".format(i, line.replace("\t", "' || chr(9) || '")) for i, line in enumerate(BAD_AGP, 1))
    found = {}
    for name, body in BODIES.items():
        direction = "CAST(CASE WHEN (contig_id + t) % 4 = 0 THEN 0 ELSE 1 END AS INT)" if name in _REVERSED else "1"
        prelude = PRELUDE.replace("DIRECTION", direction).replace("BAD_LINES", lines)
        asked = ",\nasked(pos) AS (VALUES (0), (5), (11), (57), (123))" if name == "convert_units" else ""
        found[name] = f"WITH {'RECURSIVE ' * (name in ('edits_composed', 'edits_from_requests'))}{prelude.strip()}{asked}\n{body.strip()}"
    return found
