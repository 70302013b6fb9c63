"""DuckDB statements for geometry, fusion, history, dashboard, exports, search and answers."""

from __future__ import annotations

from declara import catalog as c
from declara.plans import oracle as o
from declara.plans.oracle import ORACLE, add, m, q, strip, words, x
from declara.plans.queries import SCAN_YEAR

__all__ = ["ORACLE"]

KEYS = "image_id, engine, pos, partkey, suppkey"
TIE = "pos, partkey, suppkey, text, confidence, x1, y1"

# ---------------------------------------------------------------------------------------------
# geometry
# ---------------------------------------------------------------------------------------------

_dx, _dy = "(suppkey % 7 - 3)", "(partkey % 5 - 2)"
add("q_box_metrics", f"""
SELECT {KEYS}, x1 > x0 AND y1 > y0 AND x0 >= 0 AND y0 >= 0 AND x1 <= image_width + 5 AND y1 <= image_height + 5 AS valid,
  greatest(0.0, x1 - x0) AS width, greatest(0.0, y1 - y0) AS height, width * height AS area, (x0 + x1) / 2 AS center_x, (y0 + y1) / 2 AS center_y,
  round(greatest(0.0, least(1.0, x0 / image_width)), 4) AS n0, round(greatest(0.0, least(1.0, y0 / image_height)), 4) AS n1,
  round(greatest(0.0, least(1.0, x1 / image_width)), 4) AS n2, round(greatest(0.0, least(1.0, y1 / image_height)), 4) AS n3,
  round(x0 * (CAST(1 AS DOUBLE) / 1.5), 1) AS s0, round(y0 * (CAST(1 AS DOUBLE) / 1.5), 1) AS s1, round(x1 * (CAST(1 AS DOUBLE) / 1.5), 1) AS s2, round(y1 * (CAST(1 AS DOUBLE) / 1.5), 1) AS s3,
  CASE WHEN {_dx} = 0 AND {_dy} = 0 THEN CAST(0 AS DOUBLE) ELSE round((degrees(atan2(CAST({_dy} AS DOUBLE), CAST({_dx} AS DOUBLE))) + 360) % 360, 1) END AS angle,
  (angle >= 45 AND angle < 135) OR (angle >= 225 AND angle < 315) AS vertical
FROM ocr_regions""")

add("q_readability", f"""WITH r AS (SELECT {KEYS}, confidence AS conf, round(greatest(0.0, y1 - y0), 1) AS h, round(greatest(0.0, x1 - x0), 1) AS w,
  CAST(partkey % 90 AS DOUBLE) AS sharp FROM ocr_regions)
SELECT {KEYS}, CASE WHEN conf < 0.5 OR h < 8 THEN 'UNREADABLE' WHEN conf < 0.7 OR h < 12 OR sharp < 20 THEN
    CASE WHEN conf >= CAST(0.7 AS DOUBLE) * CAST(0.9 AS DOUBLE) THEN 'REQUIRES_HUMAN_VERIFICATION' ELSE 'LOW_READABILITY' END ELSE 'READABLE' END AS status,
  h AS text_height, w AS text_width, round(conf, 3) AS confidence, round(sharp, 1) AS sharpness,
  coalesce(nullif(concat_ws('; ',
    CASE WHEN conf < 0.5 THEN 'OCR confidence (' || printf('%.2f', conf) || ') is very low (< 0.5)'
      WHEN conf < 0.7 THEN 'OCR confidence (' || printf('%.2f', conf) || ') is below standard screening threshold (0.7)' END,
    CASE WHEN h < 8 THEN 'Text height (' || printf('%.1f', h) || 'px) is extremely small in image resolution'
      WHEN h < 12 THEN 'Text height (' || printf('%.1f', h) || 'px) is below automated confidence threshold (12.0px)' END,
    CASE WHEN sharp < 20 THEN 'Local text sharpness (' || printf('%.1f', sharp) || ') indicates blurriness' END), ''),
    {q(c.READABLE_REASON)}) AS reason
FROM r""")

POS = """CASE WHEN cx < 0.35 THEN 'LEFT' WHEN cx > 0.65 THEN 'RIGHT' ELSE 'CENTER' END AS horizontal,
  CASE WHEN cy < 0.35 THEN 'TOP' WHEN cy > 0.65 THEN 'BOTTOM' ELSE 'MIDDLE' END AS vertical,
  CASE WHEN cy <= 0.5 THEN 'TOP' ELSE 'BOTTOM' END || '_' || CASE WHEN cx <= 0.5 THEN 'LEFT' ELSE 'RIGHT' END AS quadrant"""
add("q_positions", f"""WITH r AS (SELECT {KEYS}, round((x0 + x1) / 2 / image_width, 3) AS cx, round((y0 + y1) / 2 / image_height, 3) AS cy FROM ocr_regions)
SELECT {KEYS}, {POS}, cx AS center_x, cy AS center_y, 'block_' || lower(quadrant) || '_horiz' AS block FROM r""")


def iou(a: str, b: str) -> str:
    w = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    h = f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    area = f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0) - {w} * {h})"
    return f"CASE WHEN {w} <= 0 OR {h} <= 0 OR {area} <= 0 THEN CAST(0 AS DOUBLE) ELSE {w} * {h} / {area} END"


add("q_iou_pairs", f"""WITH b AS (SELECT image_id, x0, y0, x1, y1, count(*) AS n FROM ocr_regions GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x0, y0, x1, y1) AS k FROM b)
SELECT p.image_id, {', '.join(f"least(p.{n}, s.{n}) AS low_{n}, greatest(p.{n}, s.{n}) AS high_{n}" for n in ("x0", "y0", "x1", "y1"))},
  round({iou('p', 's')}, 6) AS iou, p.n * s.n AS copies
FROM r p JOIN r s ON p.image_id = s.image_id AND p.k < s.k WHERE {iou('p', 's')} > 0.5""")

# ---------------------------------------------------------------------------------------------
# fusion: the greedy assignment replayed region by region
# ---------------------------------------------------------------------------------------------


def greedy(regions: str, key: str, order: str) -> str:
    box = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 't': text, 'c': confidence, 's': source}"
    overlaps = f"list_transform(range(1, k + 1), lambda j: {iou('b[k + 1]', 'b[j]')})"
    pick = ("CASE WHEN list_max(v) > 0.5 THEN list_min(list_transform(list_filter(range(1, k + 1), lambda z: v[z] = list_max(v)), lambda z: a[z])) "
            "ELSE list_max(a) + 1 END")
    return f"""seq AS (SELECT {key}, list({box} ORDER BY {order}) AS b FROM {regions} GROUP BY {key}),
steps AS (SELECT {key}, b, 1 AS k, [1] AS a FROM seq
  UNION ALL SELECT {key}, b, k + 1, list_append(a, {pick}) FROM (SELECT *, {overlaps} AS v FROM steps WHERE k < len(b)) w),
assigned AS (SELECT {key}, j, b[j] AS g, a[j] AS cl FROM (SELECT * FROM steps WHERE k = len(b)) f, unnest(range(1, len(b) + 1)) AS u(j)),
cluster AS (SELECT {key}, cl, min_by(g, {{'c': -g.c, 'j': j}}) AS w, count(DISTINCT g.s) AS source_count, count(*) AS members, min(j) AS start FROM assigned GROUP BY {key}, cl)"""


add("q_region_merge", f"""WITH RECURSIVE src AS (SELECT *, engine AS source FROM ocr_regions), {greedy('src', 'image_id', 'engine, ' + TIE)}
SELECT image_id, w.t AS text, w.c AS confidence, w.x0 AS x0, w.y0 AS y0, w.x1 AS x1, w.y1 AS y1, CAST(source_count AS INTEGER) AS source_count, members FROM cluster""")


def quality(text: str, conf: str) -> str:
    """Columns conf_p, key_p, pat_p, dens_p over an expression; ``raw`` is the stripped text."""
    low = "lower(raw)"
    groups = " + ".join(f"CAST({words(low, g)} AS INTEGER)" for g in c.QUALITY_KEYWORD_GROUPS)
    edge = lambda p: p.replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(").replace(r"\b(?:", r"(?:^|[^\p{L}\p{N}_])(?:")

    def hit(p):
        # word boundaries are Unicode-aware in the operator
        p = edge(p)
        if p.endswith(r"\b"):
            p = p[:-2] + (r"(?:[\p{L}\p{N}_]|$)" if p.endswith(r"/\-\b") else r"(?:[^\p{L}\p{N}_]|$)")
        return m("raw", p)

    pats = " + ".join("CAST((" + " OR ".join(hit(p) for p in ps) + ") AS INTEGER)" for ps in (c.MRP_PATTERNS, c.QUANTITY_PATTERNS, c.DATE_PATTERNS))
    dens = (r"length(regexp_replace(raw, '[^\p{L}\p{N}\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g'))"
            " / CAST(length(raw) AS DOUBLE)")
    n_words = r"len(regexp_extract_all(raw, '[^\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{3000}]+'))"
    return (f"CASE WHEN length(raw) < 3 THEN 0 ELSE {conf} * 25.0 END AS conf_p, CASE WHEN length(raw) < 3 THEN 0 ELSE ({groups}) / CAST(6 AS DOUBLE) * 35.0 END AS key_p, "
            f"CASE WHEN length(raw) < 3 THEN 0 ELSE ({pats}) / CAST(3 AS DOUBLE) * 30.0 END AS pat_p, "
            f"CASE WHEN length(raw) < 3 THEN 0 ELSE ({dens} * CAST(0.6 AS DOUBLE) + least(CAST(1 AS DOUBLE), {n_words} / CAST(8 AS DOUBLE)) * CAST(0.4 AS DOUBLE)) * 10.0 END AS dens_p")


SCORED = f"""raws AS (SELECT doc_id // 3 AS image_id, doc_id % 3 AS engine_no, text, {strip('text')} AS raw, CAST(n_chars % 101 AS DOUBLE) / 100 AS conf FROM documents),
meas AS (SELECT *, {quality('text', 'conf')} FROM raws),
scored AS (SELECT *, round(CAST(conf_p + key_p + pat_p + dens_p AS DOUBLE), 2) AS score FROM meas),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, conf DESC, engine_no) AS rk FROM scored)"""
PARTS = "round(CAST(conf_p AS DOUBLE), 2) AS confidence_score, round(CAST(key_p AS DOUBLE), 2) AS keyword_score, round(CAST(pat_p AS DOUBLE), 2) AS pattern_score, round(CAST(dens_p AS DOUBLE), 2) AS density_score"
add("q_quality_rank", f"""WITH {SCORED} SELECT image_id, engine_no, score, {PARTS}, CAST(rk AS INTEGER) AS variant_rank FROM ranked""")
add("q_best_variant", f"""WITH {SCORED}, sd AS (SELECT image_id, round(stddev_pop(conf), 3) AS confidence_std_dev, count(*) AS n FROM scored GROUP BY image_id)
SELECT r.image_id, engine_no AS selected_variant, score AS best_composite_score, conf AS best_ocr_confidence, confidence_std_dev, n AS total_variants_evaluated,
  {PARTS}, length(text) AS text_length FROM ranked r JOIN sd USING (image_id) WHERE rk = 1""")

ENSEMBLE = f"""res AS (SELECT image_id, engine, string_agg(text, chr(10) ORDER BY {TIE.replace(', text', '').replace('suppkey,', 'suppkey, text,')}) AS raw_text,
    round(CAST(sum(CAST(confidence AS DECIMAL(20,8))) AS DOUBLE) / count(*), 3) AS conf, count(*) AS n FROM ocr_regions GROUP BY 1, 2),
raws AS (SELECT *, {strip('raw_text')} AS raw FROM res),
meas AS (SELECT *, {quality('raw_text', 'conf')} FROM raws),
ranked AS (SELECT *, round(CAST(conf_p + key_p + pat_p + dens_p AS DOUBLE), 2) AS score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, conf DESC, engine) AS rk FROM meas),
act AS (SELECT image_id, count(*) AS active FROM ranked GROUP BY 1),
src AS (SELECT r.*, e.rk, r.engine AS source FROM ocr_regions r JOIN ranked e ON e.image_id = r.image_id AND e.engine = r.engine)"""
add("q_ensemble", f"""WITH RECURSIVE {ENSEMBLE}, {greedy('src', 'image_id', 'rk, ' + TIE)},
fused AS (SELECT image_id, string_agg(w.t, chr(10) ORDER BY round(w.y0, 1), round(w.x0, 1), start) AS txt, round(CAST(sum(CAST(w.c AS DECIMAL(20,8))) AS DOUBLE) / count(*), 3) AS cf,
  count(*) AS n, sum(CAST(source_count > 1 AS INTEGER)) AS agreed, sum(source_count - 1) AS shared FROM cluster GROUP BY 1)
SELECT r.image_id, engine AS winning_engine, score AS winning_score, active AS active_engines, CASE WHEN active = 1 THEN raw_text ELSE txt END AS merged_text,
  CASE WHEN active = 1 THEN conf ELSE cf END AS average_confidence,
  CASE WHEN active = 1 THEN 1.0 ELSE round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(shared AS DOUBLE) / ((active - 1) * f.n))), 4) END AS engine_agreement_score,
  CASE WHEN active = 1 THEN r.n ELSE f.n END AS clusters_count, CAST(CASE WHEN active = 1 THEN r.n ELSE agreed END AS BIGINT) AS agreed_clusters_count
FROM ranked r JOIN act USING (image_id) JOIN fused f USING (image_id) WHERE rk = 1""")


def reading(source: str, key: str, order: str) -> str:
    """CTEs ending in ``placed``: line number and reading position of rows with main, cross, side, block."""
    names = ", ".join(q(b) for b in c.BLOCK_ORDER)
    return f"""hs AS (SELECT {key}, block, list(side ORDER BY side) AS h FROM {source} WHERE side > 0 GROUP BY 1, 2),
sorted AS (SELECT r.*, row_number() OVER (PARTITION BY r.{key}, r.block ORDER BY main, "cross", {order}) AS k,
  greatest(CAST(8 AS DOUBLE), coalesce(h[len(h) // 2 + 1], 20) * CAST(0.5 AS DOUBLE)) AS gap FROM {source} r LEFT JOIN hs ON hs.{key} = r.{key} AND hs.block = r.block),
walk AS (SELECT {key}, block, k, 1 AS line, main AS total, 1 AS n FROM sorted WHERE k = 1
  UNION ALL SELECT s.{key}, s.block, s.k, CASE WHEN abs(s.main - w.total / w.n) <= s.gap THEN w.line ELSE w.line + 1 END,
    CASE WHEN abs(s.main - w.total / w.n) <= s.gap THEN w.total + s.main ELSE s.main END, CASE WHEN abs(s.main - w.total / w.n) <= s.gap THEN w.n + 1 ELSE 1 END
  FROM walk w JOIN sorted s ON s.{key} = w.{key} AND s.block = w.block AND s.k = w.k + 1),
placed AS (SELECT s.*, w.line AS line_no, row_number() OVER (PARTITION BY s.{key} ORDER BY
  CASE WHEN list_position([{names}], s.block) > 0 THEN list_position([{names}], s.block) ELSE 9 END, s.block, w.line, s."cross", s.main, {order}) AS reading_position
  FROM sorted s JOIN walk w ON w.{key} = s.{key} AND w.block = s.block AND w.k = s.k)"""


def blocks(source: str, width: str, height: str, vert: str) -> str:
    return f"""pos0 AS (SELECT *, round((x0 + x1) / 2 / {width}, 3) AS cx, round((y0 + y1) / 2 / {height}, 3) AS cy, {vert} AS vert FROM {source}),
blk AS (SELECT *, 'block_' || lower(CASE WHEN cy <= 0.5 THEN 'TOP' ELSE 'BOTTOM' END || '_' || CASE WHEN cx <= 0.5 THEN 'LEFT' ELSE 'RIGHT' END) || CASE WHEN vert THEN '_vert' ELSE '_horiz' END AS block,
  CASE WHEN vert THEN (x0 + x1) / 2 ELSE (y0 + y1) / 2 END AS main, CASE WHEN vert THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS "cross",
  CASE WHEN vert THEN greatest(0.0, x1 - x0) ELSE greatest(0.0, y1 - y0) END AS side FROM pos0)"""


add("q_reading_order", f"""WITH RECURSIVE {blocks('ocr_regions', 'image_width', 'image_height', 'false')}, {reading('blk', 'image_id', 'engine, ' + TIE)}
SELECT {KEYS}, block AS cluster_id, line_no, CAST(reading_position AS INTEGER) AS reading_position FROM placed""")
add("q_reading_order_rotated", f"""WITH RECURSIVE ext AS (SELECT image_id, greatest(100, CAST(floor(round(max(x1), 1)) AS INTEGER) + 50) AS ew, greatest(100, CAST(floor(round(max(y1), 1)) AS INTEGER) + 50) AS eh FROM ocr_regions GROUP BY 1),
sized AS (SELECT r.*, ew, eh FROM ocr_regions r JOIN ext USING (image_id)), {blocks('sized', 'ew', 'eh', 'suppkey % 3 = 0')}, {reading('blk', 'image_id', 'engine, ' + TIE)}
SELECT {KEYS}, block AS cluster_id, line_no, CAST(reading_position AS INTEGER) AS reading_position FROM placed""")

WORDS = f"""w0 AS (SELECT {KEYS}, CASE WHEN suppkey % 19 = 0 THEN '' ELSE text END AS text,
  CASE WHEN partkey % 13 = 0 THEN -1 WHEN partkey % 17 = 0 THEN NULL ELSE partkey % 120 END AS conf, x0, y0, x0 + (x1 - x0) AS x1, y0 + (y1 - y0) AS y1 FROM ocr_regions),
words AS (SELECT {KEYS}, text, round(least(CAST(1 AS DOUBLE), conf / CAST(100 AS DOUBLE)), 4) AS confidence, x0, y0, x1, y1 FROM w0 WHERE text <> '' AND conf >= 0)"""
add("q_engine_rows", f"WITH {WORDS} SELECT * FROM words")
add("q_engine_results", f"""WITH {WORDS} SELECT image_id, engine, string_agg(text, chr(10) ORDER BY pos, partkey, suppkey, text) AS raw_text,
  round(CAST(sum(CAST(confidence AS DECIMAL(20,8))) AS DOUBLE) / count(*), 3) AS average_confidence, count(*) AS regions_detected FROM words GROUP BY 1, 2""")
add("q_pass_selection", """WITH p AS (SELECT image_id, CAST(substr(engine, 8, 1) AS INTEGER) AS pass_no, count(*) AS n FROM ocr_regions GROUP BY 1, 2),
f AS (SELECT i.image_id, coalesce(z.n, 0) AS n0 FROM (SELECT DISTINCT image_id FROM p) i LEFT JOIN p z ON z.image_id = i.image_id AND z.pass_no = 0),
alt AS (SELECT f.image_id, min(p.pass_no) AS pass_no FROM f JOIN p ON p.image_id = f.image_id AND p.pass_no > 0 AND p.n > f.n0 WHERE f.n0 < 3 GROUP BY 1)
SELECT f.image_id, coalesce(alt.pass_no, 0) AS pass_no, coalesce(p.n, f.n0) AS regions_detected FROM f LEFT JOIN alt ON alt.image_id = f.image_id LEFT JOIN p ON p.image_id = alt.image_id AND p.pass_no = alt.pass_no""")
add("q_visual_statistics", """SELECT image_id, round(CAST(sum(CAST(confidence AS DECIMAL(20,8))) AS DOUBLE) / count(*), 3) AS average_confidence, count(*) AS regions_detected,
  CAST(length(string_agg(text, chr(10))) AS BIGINT) AS raw_text_length, max(image_width) AS image_width, max(image_height) AS image_height, CAST(count(*) AS VARCHAR) AS json_regions FROM ocr_regions GROUP BY 1""")

add("q_keyframes", """WITH s AS (SELECT video_id, frame_index, sharpness, round(frame_index / CAST(6 AS DOUBLE), 2) AS ts, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS i,
  count(*) OVER (PARTITION BY video_id) AS n FROM frames WHERE frame_index % 3 = 0),
b AS (SELECT *, CASE WHEN n <= 5 THEN i ELSE (SELECT max(j) FROM unnest(range(0, 5)) AS u(j) WHERE floor(j * n / CAST(5 AS DOUBLE)) <= i) END AS bucket FROM s)
SELECT video_id, frame_index, ts AS timestamp_seconds, round(sharpness, 2) AS sharpness_score FROM b
QUALIFY row_number() OVER (PARTITION BY video_id, bucket ORDER BY sharpness DESC, frame_index) = 1""")

FRAMES = f"""src AS (SELECT r.*, image_id AS video_id, CAST(suppkey % 3 AS INTEGER) AS frame_index, CAST(suppkey % 3 AS INTEGER) AS source FROM ocr_regions r)"""
add("q_frame_fusion", f"""WITH RECURSIVE {FRAMES}, {greedy('src', 'video_id', 'frame_index, engine, ' + TIE)},
win AS (SELECT video_id, start, w.t AS text, w.c AS confidence, w.x0 AS x0, w.y0 AS y0, w.x1 AS x1, w.y1 AS y1 FROM cluster),
ext AS (SELECT video_id, greatest(100, CAST(floor(round(max(x1), 1)) AS INTEGER) + 50) AS ew, greatest(100, CAST(floor(round(max(y1), 1)) AS INTEGER) + 50) AS eh FROM win GROUP BY 1),
sized AS (SELECT win.*, ew, eh FROM win JOIN ext USING (video_id)), {blocks('sized', 'ew', 'eh', 'false')}, {reading('blk', 'video_id', 'start')}
SELECT video_id, string_agg(text, chr(10) ORDER BY reading_position) AS raw_text, round(CAST(sum(CAST(confidence AS DECIMAL(20,8))) AS DOUBLE) / count(*), 3) AS average_confidence,
  count(*) AS regions_detected FROM placed GROUP BY 1""")

ADDRESS = "field_name IN ('manufacturer_address', 'consumer_care')"
BEST = f"""best AS (SELECT scan_id, field_name, value, confidence, panel FROM panel_fields WHERE value <> ''
  QUALIFY row_number() OVER (PARTITION BY scan_id, field_name ORDER BY confidence DESC, length(trim(value)) DESC, panel) = 1)"""
add("q_panel_merge", f"WITH {BEST} SELECT * FROM best")
add("q_panel_note", f"""WITH {BEST}, n AS (SELECT scan_id, max(panel) + 1 AS images FROM panel_fields GROUP BY 1),
lab AS (SELECT * FROM (VALUES {', '.join(f"({i}, {q(k)}, {q(v)})" for i, (k, v) in enumerate(c.PANEL_NOTE_LABELS.items()))}) AS t(o, field_name, label)),
f AS (SELECT scan_id, string_agg(label || ' found on image ' || CAST(panel + 1 AS VARCHAR), ', ' ORDER BY o) AS s FROM best JOIN lab USING (field_name) GROUP BY 1)
SELECT n.scan_id, 'Analysis based on ' || CAST(images AS VARCHAR) || ' images of the same product.' || coalesce(' (' || s || ')', '') AS note FROM n LEFT JOIN f USING (scan_id)""")

PANELS = f"""{o.lines_cte()},
panels AS (SELECT product_id, pn AS panel, array_to_string(list_filter(ls, lambda l, i: (i - 1) % 2 = pn), chr(10)) AS raw_text,
  len(list_filter(ls, lambda l, i: (i - 1) % 2 = pn)) AS regions_detected, (90 - 10 * pn) / CAST(100 AS DOUBLE) AS average_confidence FROM parts, unnest([0, 1]) AS u(pn))"""
add("q_panel_summary", f"""WITH {PANELS}
SELECT product_id, count(*) AS images_processed, round(CAST(0.85 AS DOUBLE), 4) AS average_confidence, CAST(sum(regions_detected) AS BIGINT) AS regions_count,
  coalesce(string_agg('--- Panel Image ' || CAST(panel + 1 AS VARCHAR) || ' ---' || chr(10) || raw_text, chr(10) || '---' || chr(10) ORDER BY panel) FILTER (WHERE raw_text <> ''), '') AS ocr_text FROM panels GROUP BY 1""")

# ---------------------------------------------------------------------------------------------
# history and dashboard
# ---------------------------------------------------------------------------------------------

YEAR = f"created_at >= TIMESTAMP '{SCAN_YEAR[0]}' AND created_at <= TIMESTAMP '{SCAN_YEAR[1]}'"
ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S')"
add("q_scan_page", f"""SELECT id, product_name, overall_status, compliance_score, {ISO} AS created_at, officer_id FROM (
  SELECT * FROM scan_records WHERE overall_status = 'NON_COMPLIANT' AND product_name ILIKE '%brand 1%' AND {YEAR} ORDER BY created_at DESC, id LIMIT 20 OFFSET 5) t""")
add("q_scan_total", f"SELECT count(*) AS total FROM scan_records WHERE overall_status = 'NON_COMPLIANT' AND officer_id = 5 AND {YEAR}")
add("q_scan_lookup", f"SELECT id, product_name, overall_status, compliance_score, {ISO} AS created_at, officer_id FROM scan_records WHERE id = 1234")
AVG = "round(CAST(sum(CAST(compliance_score AS DECIMAL(20,2))) AS DOUBLE) / count(*), 2)"
GOOD = "count(*) FILTER (WHERE overall_status = 'COMPLIANT')"
add("q_scan_aggregates", f"""SELECT count(*) AS total_scans, {GOOD} AS compliant_count,
  count(*) FILTER (WHERE overall_status IN ('NON_COMPLIANT', 'POTENTIALLY_NON_COMPLIANT')) AS non_compliant_count,
  round(CAST({GOOD} * 100 AS DOUBLE) / count(*), 2) AS compliance_rate, {AVG} AS average_score,
  (SELECT string_agg(overall_status || '=' || CAST(n AS VARCHAR), ',' ORDER BY overall_status) FROM (SELECT overall_status, count(*) AS n FROM scan_records GROUP BY 1) z) AS status_distribution FROM scan_records""")
add("q_scans_deleted", "SELECT id, overall_status, compliance_score FROM scan_records WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)")
add("q_deletion_report", "SELECT DISTINCT o_orderkey * 2 AS id, o_orderkey * 2 IN (SELECT id FROM scan_records) AS deleted FROM orders")
add("q_scans_officers", """SELECT s.id, officer_id, s_name AS officer_username, s_suppkey % 2 = 0 AS officer_is_active, overall_status
FROM scan_records s LEFT JOIN supplier ON s_suppkey = officer_id AND s_suppkey <> 3""")
add("q_shape_scans", """SELECT id, product_name, overall_status, round(compliance_score + 0.004, 2) AS compliance_score, strftime(created_at, '%Y-%m-%d') AS scan_date FROM scan_records""")
SUMMARY = f"""SELECT count(*) AS total_scans, {GOOD} AS compliant_scans, count(*) FILTER (WHERE overall_status IN ('NON_COMPLIANT', 'POTENTIALLY_NON_COMPLIANT')) AS non_compliant_scans,
  coalesce(round(CAST({GOOD} * 100 AS DOUBLE) / count(*), 2), 0) AS compliance_rate, coalesce({AVG}, 0) AS average_compliance_score FROM scan_records"""
add("q_dash_summary", SUMMARY)
add("q_dash_summary_range", SUMMARY + " WHERE created_at BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-06-30 00:00:00'")
SEEDS = ", ".join(f"({i}, {q(f)}, {q(r)}, {q(f.replace('_', ' ').title())})" for i, (r, f) in enumerate(c.EVIDENCE_FIELD.items()))


def fields_cte(rows: str = "rule_results") -> str:
    return f"""seed AS (SELECT * FROM (VALUES {SEEDS}) AS t(fo, field_name, seed_rule, seed_name)),
ev AS (SELECT coalesce(f.field_name, lower(r.rule_id)) AS field_name, r.rule_id, r.status, r.declaration, s.created_at, r.scan_id, r.pos
  FROM {rows} r JOIN scan_records s ON s.id = r.scan_id LEFT JOIN seed f ON f.seed_rule = r.rule_id),
st AS (SELECT field_name, count(*) AS n, count(*) FILTER (WHERE status IN ('FAIL', 'WARNING')) AS v,
  max_by(declaration, {{'a': created_at, 'b': scan_id, 'c': pos, 'd': declaration}}) AS d, max_by(rule_id, {{'a': created_at, 'b': scan_id, 'c': pos, 'd': declaration}}) AS rid FROM ev GROUP BY 1),
rates AS (SELECT coalesce(st.field_name, seed.field_name) AS field_name, coalesce(rid, seed_rule) AS rule_id, coalesce(trim(string_split(d, '(')[1]), seed_name) AS declaration_name,
  coalesce(n, 0) AS total_evaluations, coalesce(v, 0) AS violation_count, CASE WHEN n > 0 THEN round(CAST(v * 100 AS DOUBLE) / n, 2) ELSE 0 END AS violation_rate, coalesce(fo, 10) AS fo
  FROM seed FULL JOIN st ON st.field_name = seed.field_name)"""


add("q_dash_fields", f"WITH {fields_cte()} SELECT field_name, rule_id, declaration_name, total_evaluations, violation_count, CAST(violation_rate AS DOUBLE) AS violation_rate FROM rates")
add("q_stored_fields", f"WITH {fields_cte()} SELECT field_name, rule_id, total_evaluations, violation_count, CAST(violation_rate AS DOUBLE) AS violation_rate FROM rates")
add("q_field_share", f"""WITH {fields_cte()} SELECT field_name, violation_count, CAST(round(CAST(violation_count * 100 AS DOUBLE) / greatest(1, (SELECT sum(violation_count) FROM rates)), 0) AS INTEGER) AS percentage FROM rates""")
add("q_dash_trend", f"""SELECT coalesce(strftime(created_at, '%Y-%m-%d'), 'Unknown') AS date, count(*) AS total_scans, {GOOD} AS compliant_scans, count(*) - {GOOD} AS non_compliant_scans,
  round(CAST({GOOD} * 100 AS DOUBLE) / count(*), 2) AS compliance_rate, {AVG} AS average_score FROM scan_records GROUP BY 1""")


def brands_cte(n: int) -> str:
    return f"""named AS (SELECT *, coalesce(nullif(product_name, ''), 'Unlabeled Commodity') AS brand_name FROM scan_records),
bs AS (SELECT brand_name, count(*) AS total_scans, count(*) FILTER (WHERE overall_status <> 'COMPLIANT') AS non_compliant_scans,
  round(CAST(count(*) FILTER (WHERE overall_status <> 'COMPLIANT') * 100 AS DOUBLE) / count(*), 2) AS non_compliance_rate, {AVG} AS average_compliance_score FROM named GROUP BY 1),
vi AS (SELECT brand_name, trim(string_split(declaration, '(')[1]) AS name, count(*) AS n, min({{'a': created_at, 'b': scan_id, 'c': pos}}) AS f FROM rule_results r JOIN named s ON s.id = r.scan_id
  WHERE status IN ('FAIL', 'WARNING') GROUP BY 1, 2),
mc AS (SELECT brand_name, name FROM vi QUALIFY row_number() OVER (PARTITION BY brand_name ORDER BY n DESC, f, name) = 1),
brands AS (SELECT bs.*, coalesce(name, 'None') AS most_common_violation, row_number() OVER (ORDER BY non_compliant_scans DESC, average_compliance_score, bs.brand_name) AS rk FROM bs LEFT JOIN mc USING (brand_name) QUALIFY rk <= {n})"""


add("q_dash_brands", f"WITH {brands_cte(10)} SELECT brand_name, total_scans, non_compliant_scans, non_compliance_rate, average_compliance_score, most_common_violation FROM brands")
add("q_dash_auth", """SELECT count(*) AS total_scans_evaluated, count(*) FILTER (WHERE verdict = 'GENUINE_LIKELY') AS genuine_count, count(*) FILTER (WHERE verdict = 'SUSPICIOUS') AS suspicious_count,
  count(*) FILTER (WHERE verdict = 'NO_REFERENCE_AVAILABLE') AS no_reference_count, round(CAST(count(*) FILTER (WHERE verdict = 'SUSPICIOUS') * 100 AS DOUBLE) / count(*), 2) AS suspicious_flag_rate,
  round(CAST(sum(CAST(similarity_score AS DECIMAL(20,8))) AS DOUBLE) / count(similarity_score), 4) AS average_similarity_score FROM scan_records WHERE verdict IS NOT NULL OR similarity_score IS NOT NULL""")
add("q_dash_height", """WITH h AS (SELECT coalesce(nullif(pixel_text_height, 0), text_height_pixels) AS h FROM rule_results)
SELECT count(*) FILTER (WHERE h < 8) AS under_8px, count(*) FILTER (WHERE h >= 8 AND h < 12) AS between_8_12px, count(*) FILTER (WHERE h >= 12 AND h < 24) AS between_12_24px,
  count(*) FILTER (WHERE h >= 24) AS over_24px, count(h) AS total_regions_evaluated, round(CAST(sum(CAST(h AS DECIMAL(20,6))) AS DOUBLE) / count(h), 1) AS average_text_height_px,
  round(CAST(count(*) FILTER (WHERE h < 12) * 100 AS DOUBLE) / count(h), 2) AS percentage_below_minimum FROM h""")
add("q_result_counts", """SELECT scan_id, count(*) FILTER (WHERE status = 'PASS') AS pass_count, count(*) FILTER (WHERE status = 'FAIL') AS fail_count, count(*) FILTER (WHERE status = 'WARNING') AS warn_count
FROM rule_results GROUP BY 1""")
add("q_warned_results", "SELECT scan_id, pos, rule_id, partkey, suppkey FROM rule_results WHERE status = 'WARNING'")

# ---------------------------------------------------------------------------------------------
# exports
# ---------------------------------------------------------------------------------------------

META = ", ".join(f"({q(r['rule_id'])}, {q(r['official_legal_reference'])}, {q(r['source_pdf'])})" for r in c.RULES)
EXPORT = f"""meta AS (SELECT * FROM (VALUES {META}) AS t(rule_id, legal, source)),
scans AS (SELECT id, coalesce(nullif(CAST(id AS VARCHAR), '0'), 'N/A') AS scan_id, coalesce(nullif(product_name, ''), 'Pre-Packaged Commodity') AS product_name, overall_status, compliance_score,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' UTC' AS dt, coalesce(nullif(CAST(officer_id AS VARCHAR), '0'), 'N/A') AS officer, verdict FROM scan_records),
rr AS (SELECT r.*, s.scan_id AS sid, s.dt, s.product_name, s.compliance_score,
  CASE WHEN partkey % 5 <> 0 THEN 'value ' || CAST(partkey % 40 AS VARCHAR) END AS val, CASE WHEN suppkey % 4 <> 0 THEN 'reason ' || CAST(suppkey % 9 AS VARCHAR) END AS rsn,
  coalesce(legal, {q(c.PCR)}) AS legal, coalesce(source, {q(c.UNKNOWN_RULE_SOURCE)}) AS source,
  row_number() OVER (PARTITION BY r.scan_id ORDER BY pos, partkey, suppkey, status, pixel_text_height NULLS FIRST, r.rule_id, declaration, val NULLS FIRST, rsn NULLS FIRST, r.severity) AS k
  FROM rule_results r JOIN scans s ON s.id = r.scan_id LEFT JOIN meta m ON m.rule_id = r.rule_id)"""
add("q_violations_log", f"""WITH {EXPORT} SELECT sid AS scan_id, dt AS inspection_date, product_name, rule_id, declaration, status, coalesce(val, 'Not Detected') AS observed_value,
  coalesce(rsn, '') AS reason, legal AS legal_reference, source AS source_document FROM rr WHERE status IN ('FAIL', 'WARNING')""")
add("q_rule_rows", f"""WITH {EXPORT} SELECT sid AS scan_id, pos, rule_id, declaration, status, coalesce(val, 'Not Detected') AS detected_value, coalesce(rsn, '') AS reason,
  legal AS legal_citation, source AS source_document, severity FROM rr""")
add("q_all_scans", f"""WITH {EXPORT}, f AS (SELECT scan_id AS id, string_agg(rule_id, ', ' ORDER BY k) FILTER (WHERE status = 'FAIL') AS ids, count(*) FILTER (WHERE status = 'FAIL') AS n FROM rr GROUP BY 1)
SELECT s.scan_id, dt AS inspection_date, product_name, overall_status, printf('%.1f%%', compliance_score) AS score, CAST(n AS INTEGER) AS violations_count, coalesce(ids, 'None') AS failed_rule_ids,
  coalesce(verdict, 'N/A') AS authenticity_verdict, officer AS officer_id FROM scans s JOIN f USING (id)""")
add("q_show_cause", f"""WITH {EXPORT}, b AS (SELECT *, bool_or(status IN ('FAIL', 'WARNING')) OVER (PARTITION BY scan_id) AS any_bad FROM rr)
SELECT sid AS scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY k) AS INTEGER) AS serial_no, rule_id, declaration,
  coalesce(rsn, 'Mandatory statutory declaration missing or non-conforming on PDP') AS finding, legal AS legal_reference, source AS source_document FROM b
WHERE CASE WHEN any_bad THEN status IN ('FAIL', 'WARNING') ELSE k <= 3 END""")
add("q_overview_rows", f"""WITH {EXPORT}, n AS (SELECT scan_id AS id, count(*) AS n FROM rule_results GROUP BY 1), s AS (SELECT * FROM scans JOIN n USING (id))
SELECT scan_id, u.pos AS pos, u.a AS attribute, u.v AS value FROM s, unnest([
  {{'pos': 1, 'a': 'Scan ID', 'v': scan_id}}, {{'pos': 2, 'a': 'Product Name', 'v': product_name}}, {{'pos': 3, 'a': 'Overall Compliance Status', 'v': overall_status}},
  {{'pos': 4, 'a': 'Compliance Score (%)', 'v': printf('%.1f%%', compliance_score)}}, {{'pos': 5, 'a': 'Inspection Timestamp', 'v': dt}}, {{'pos': 6, 'a': 'Inspecting Officer ID', 'v': officer}},
  {{'pos': 7, 'a': 'Total Rules Checked', 'v': CAST(n AS VARCHAR)}}, {{'pos': 8, 'a': 'Rules Passed', 'v': '0'}}, {{'pos': 9, 'a': 'Rules Failed', 'v': '0'}}, {{'pos': 10, 'a': 'Warnings Issued', 'v': '0'}}]) AS t(u)""")
add("q_kpis", f"""WITH {EXPORT} SELECT sid AS scan_id, CAST(count(*) AS INTEGER) AS total_rules_evaluated, CAST(count(*) FILTER (WHERE status = 'PASS') AS INTEGER) AS declarations_passed,
  CAST(count(*) FILTER (WHERE status = 'FAIL') AS INTEGER) AS violations_detected, CAST(count(*) FILTER (WHERE status = 'WARNING') AS INTEGER) AS warnings,
  printf('%.1f%%', max(compliance_score)) AS compliance_percentage FROM rr GROUP BY scan_id, sid""")
add("q_flattened_fields", f"""WITH {EXPORT}, sc AS (SELECT s.*, r.product_name AS pname FROM scans s JOIN scan_records r USING (id) WHERE id IN (SELECT scan_id FROM rule_results)),
known AS (SELECT id, scan_id, 1 AS o, 0 AS k, 'product_name' AS field_key, 'Product Name' AS label, coalesce(nullif(pname, ''), 'raw') AS value, round(id % 101 / CAST(100 AS DOUBLE) * 100, 1) AS confidence FROM sc
  UNION ALL SELECT id, scan_id, 2, 0, 'mrp', 'Maximum Retail Price (MRP)', '₹5', 50.0 FROM sc WHERE id % 3 = 0
  UNION ALL SELECT id, scan_id, 3, 0, 'category', 'Product Category', 'food', 100.0 FROM sc WHERE id % 2 = 0),
det AS (SELECT scan_id AS id, sid AS scan_id, 4 AS o, k, rule_id AS field_key, declaration AS label, val AS value, 95.0 AS confidence FROM rr WHERE val IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY rr.scan_id, declaration ORDER BY k) = 1),
al AS (SELECT * FROM known UNION ALL SELECT * FROM det)
SELECT scan_id, CAST(row_number() OVER (PARTITION BY id ORDER BY o, k) AS INTEGER) AS pos, field_key, label, value, confidence FROM al""")
add("q_visual_metrics", f"""SELECT coalesce(nullif(CAST(id AS VARCHAR), '0'), 'N/A') AS scan_id, u.pos AS pos, u.metric AS metric, u.value AS value, u.b AS benchmark FROM scan_records, unnest([
  {{'pos': 1, 'metric': 'Principal Display Panel (PDP) Ratio', 'value': CASE WHEN id % 3 <> 0 THEN printf('%.1f%%', id % 90 / CAST(100 AS DOUBLE) * 100) END, 'b': '≥ 30% of packaging face area'}},
  {{'pos': 2, 'metric': 'Mean Text Font Size', 'value': CASE WHEN id % 4 <> 0 THEN printf('%.1f px', id % 30 / CAST(2 AS DOUBLE)) END, 'b': '≥ 12.0 px for standard pack'}},
  {{'pos': 3, 'metric': 'Color Contrast Ratio', 'value': NULL, 'b': '≥ 4.5:1 (WCAG AA standard)'}},
  {{'pos': 4, 'metric': 'Readability & Clarity Index', 'value': NULL, 'b': '≥ 70 / 100 threshold'}},
  {{'pos': 5, 'metric': 'Total Bounding Boxes Detected', 'value': CASE WHEN id % 5 <> 0 THEN CAST(id % 12 AS VARCHAR) END, 'b': 'All mandatory panels'}},
  {{'pos': 6, 'metric': 'Detected Multi-lingual Content', 'value': NULL, 'b': 'Rule 6(1) Language Mandates'}}]) AS t(u)""")

# ---------------------------------------------------------------------------------------------
# brands, documents, search, answers
# ---------------------------------------------------------------------------------------------

add("q_brand_authenticity", """WITH j AS (SELECT s.sample_id, s.brand_id, r.embedding IS NOT NULL AS known,
  CASE WHEN r.embedding IS NULL THEN 0 ELSE round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))), 4) END AS sim
  FROM brand_samples s LEFT JOIN brand_reference r ON r.brand_id = s.brand_id)
SELECT sample_id, 'BRAND ' || CAST(brand_id AS VARCHAR) AS brand_id, sim AS similarity_score, CASE WHEN NOT known THEN 'NO_REFERENCE_AVAILABLE' WHEN sim >= 0.3 THEN 'GENUINE_LIKELY' ELSE 'SUSPICIOUS' END AS verdict,
  CAST(0.3 AS DOUBLE) AS threshold_used, CASE WHEN NOT known THEN 'No verified reference brand embedding found for ''BRAND ' || CAST(brand_id AS VARCHAR) || ''' in catalog.'
    WHEN sim >= 0.3 THEN 'Visual appearance aligns with reference brand catalog (similarity: ' || printf('%.2f%%', sim * 100) || ').'
    ELSE 'Visual appearance diverges from reference brand catalog (similarity ' || printf('%.2f%%', sim * 100) || ' < threshold 30.00%). Possible counterfeit or unauthorized packaging variation.' END AS notes FROM j""")
add("q_brand_registry", """SELECT 'brand_' || CAST(brand_id AS VARCHAR) AS brand_id, 'Name ' || CAST(max(sample_id) AS VARCHAR) AS brand_name, max(sample_id) AS registered_at FROM brand_samples GROUP BY brand_samples.brand_id""")


def _pal(prefix: int) -> str:
    ch = lambda i: f"CAST(floor(abs(CAST(embedding[{i + 1}] AS DOUBLE)) * 1000) AS INTEGER) % 256"
    return "[" + ", ".join("[" + ", ".join(ch(prefix + (3 * k + j) % 32) for j in range(3)) + "]" for k in range(11)) + "]"


def _near(a: str, b: str) -> str:
    return f"list_avg(list_transform({a}, lambda p: list_min(list_transform({b}, lambda r: sqrt(CAST((p[1]-r[1])*(p[1]-r[1]) + (p[2]-r[2])*(p[2]-r[2]) + (p[3]-r[3])*(p[3]-r[3]) AS DOUBLE))))))"


add("q_palette", f"""WITH p AS (SELECT vec_id, {_pal(0)} AS a, {_pal(32)} AS b FROM embeddings)
SELECT vec_id, round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - ({_near('a', 'b')} + {_near('b', 'a')}) / 2 / sqrt(CAST(195075 AS DOUBLE)))), 4) AS color_similarity, CAST(0 AS DOUBLE) AS without_reference FROM p""")

TYPE = "CASE " + " ".join(
    f"WHEN {words('lower(filename)', a)} OR {words('lower(text)', b)} THEN {q(k)}" for k, a, b in c.DOCUMENT_TYPES) + f" ELSE {q(c.DEFAULT_DOCUMENT_TYPE)} END"
FULL_DATE = r"(\d{4}[\.\-_]\d{1,2}[\.\-_]\d{1,2}|\d{1,2}[\.\-_]\d{1,2}[\.\-_]\d{4})"
TEXT_DATE = r"(?:dated|date)[:\s]+(\d{1,2}[\.\/\-]\d{1,2}[\.\/\-]20\d{2})"
TOPICS = "list_filter([" + ", ".join(f"CASE WHEN {words('name_text', ws)} THEN {q(t)} END" for t, ws in c.TOPICS) + "], lambda t: t IS NOT NULL)"
INDEX = f"""docs AS (SELECT *, lower(filename || ' ' || text) AS name_text, {strip(x('text', 'Subject[:' + chr(92) + 's]+([^' + chr(92) + 'n' + chr(92) + 'r]+)', 1))} AS subj,
  length(regexp_replace(text, '[^\\x{{0900}}-\\x{{097F}}]+', '', 'g')) > 20 AS hi, length(regexp_replace(text, '[^a-zA-Z]+', '', 'g')) > 50 AS en, {TOPICS} AS tps FROM legal_documents),
idx AS (SELECT doc_id, filename, text, CASE WHEN length(subj) > 10 THEN subj ELSE trim(replace(replace(regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '_\\d{{8,12}}$', ''), '_', ' '), '-', ' ')) END AS title,
  coalesce(replace(replace({x('filename', FULL_DATE, 1, '')}, '_', '.'), '-', '.'), {x('text', TEXT_DATE, 1)}, {x('filename', '(20' + chr(92) + 'd{2})', 1, '')}, {q(c.DEFAULT_DOCUMENT_DATE)}) AS date,
  {TYPE} AS document_type, CASE WHEN hi AND en THEN 'Bilingual (Hindi-English)' WHEN hi THEN 'Hindi' ELSE 'English' END AS language,
  CASE WHEN len(tps) > 0 THEN tps ELSE [{q(c.DEFAULT_TOPIC)}] END AS topics, length(text) AS char_count FROM docs)"""
add("q_doc_metadata", f"WITH {INDEX} SELECT doc_id, filename, title, date, document_type, language, array_to_string(topics, ',') AS key_topics, char_count FROM idx")
add("q_doc_index_totals", f"WITH {INDEX} SELECT document_type, language, count(*) AS documents, CAST(sum(char_count) AS BIGINT) AS chars FROM idx GROUP BY 1, 2")

TOK = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"


def intent(e: str) -> str:
    low = f"lower({strip(e)})"
    toks = f"list_distinct(regexp_extract_all({low}, {q(TOK)}))"
    n = lambda ws: f"len(list_filter({toks}, lambda t: {isin_('t', ws)}))"
    rule = f"({n(c.RULE_WORDS)} + CASE WHEN {m(low, c.RULE_QUESTION, '')} OR {m(e, '[' + chr(92) + 'x{0900}-' + chr(92) + 'x{097F}]', '')} THEN 2 ELSE 0 END)"
    data = f"({n(c.DATA_WORDS)} + CASE WHEN {m(low, c.DATA_QUESTION, '')} THEN 2 ELSE 0 END)"
    return f"CASE WHEN {low} = '' THEN 'UNKNOWN' WHEN {data} > 0 AND {rule} > 0 THEN 'HYBRID' WHEN {data} > 0 THEN 'DATA_QUERY' WHEN {rule} > 0 THEN 'RULE_LOOKUP' ELSE 'UNKNOWN' END"


def isin_(e: str, options) -> str:
    return o.isin(e, options)


add("q_intent", f"SELECT q_id, {intent('text')} AS intent FROM questions")

RULE_VALUES = ", ".join(
    f"({i}, {q(r['rule_id'])}, {q(r['declaration_name'])}, {q(r['description'])}, {q(r['official_legal_reference'])}, {q(r['english_text'])}, "
    f"{q(r['hindi_text_snippet'])}, {q(r['applicability_notes'])}, {q(r['source_pdf'])}, {q(r['last_amended_date'])})" for i, r in enumerate(c.RULES))
CORPUS = f"""{INDEX},
rl AS (SELECT * FROM (VALUES {RULE_VALUES}) AS t(n, rule_id, decl, descr, legal, eng, hindi, notes, pdf, amended)),
corpus AS (SELECT 'rule' AS entry_type, CAST(n AS BIGINT) AS entry_no, rule_id, decl AS declaration_name, legal AS official_legal_reference, pdf AS source_pdf, eng AS english_text, hindi AS hindi_text_snippet,
  amended AS last_amended_date, notes AS applicability_notes, concat_ws(chr(10), decl, descr, legal, eng, hindi, notes) AS search_text FROM rl
 UNION ALL SELECT 'official_document', doc_id, NULL, title, 'Official DoCA Document: ' || title || ' (' || date || ')', filename, CASE WHEN text <> '' THEN text ELSE title END,
  CASE WHEN regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') THEN text END, date, 'Topics: ' || array_to_string(topics, ' '),
  {strip("title || chr(10) || 'Topics: ' || array_to_string(topics, ' ') || chr(10) || text")} FROM idx)"""
add("q_corpus", f"""WITH {CORPUS} SELECT entry_type, entry_no, rule_id, declaration_name, official_legal_reference, source_pdf, last_amended_date, applicability_notes,
  length(search_text) AS search_chars, length(english_text) AS english_chars, length(hindi_text_snippet) AS hindi_chars FROM corpus""")


def hits(top: int) -> str:
    lad = " ".join([
        "WHEN list_contains(dw, w) THEN 10.0", "WHEN contains(hi_t, w) THEN 10.0", "WHEN contains(ri, w) THEN 8.0", "WHEN contains(lr, w) THEN 4.0", "WHEN contains(st, w) THEN 2.0"])
    return f"""qw AS (SELECT q_id, regexp_extract_all(lower(text), {q(TOK)}) AS ws FROM questions),
qc AS (SELECT q_id, CASE WHEN len(list_filter(ws, lambda w: NOT {o.isin('w', c.STOPWORDS)} AND length(w) > 1)) > 0 THEN list_filter(ws, lambda w: NOT {o.isin('w', c.STOPWORDS)} AND length(w) > 1)
  ELSE list_filter(ws, lambda w: length(w) > 2) END AS cw FROM qw),
bag AS (SELECT DISTINCT list_sort(cw) AS cw FROM qc WHERE len(cw) > 0),
low AS (SELECT *, list_distinct(regexp_extract_all(lower(declaration_name), {q(TOK)})) AS dw, lower(coalesce(hindi_text_snippet, '')) AS hi_t, lower(coalesce(rule_id, '')) AS ri,
  lower(official_legal_reference) AS lr, lower(search_text) AS st FROM corpus),
sc AS (SELECT cw, entry_type, entry_no, list_sum(list_transform(cw, lambda w: CASE {lad} ELSE 0.0 END)) / (len(cw) * 10.0 + 1e-5) AS raw FROM bag, low),
rk AS (SELECT cw, entry_type, entry_no, raw, row_number() OVER (PARTITION BY cw ORDER BY raw DESC, entry_type DESC, entry_no) AS hit_rank FROM sc WHERE raw > 0 QUALIFY hit_rank <= {top}),
hits AS (SELECT q_id, hit_rank, entry_type, entry_no, round(least(CAST(1 AS DOUBLE), CAST(raw AS DOUBLE)), 4) AS score FROM qc JOIN rk ON rk.cw = list_sort(qc.cw))"""


add("q_keyword_search", f"WITH {CORPUS}, {hits(3)} SELECT q_id, CAST(hit_rank AS INTEGER) AS hit_rank, entry_type, entry_no, score FROM hits")

_cite = c.CITATION
add("q_vector_search", f"""WITH rl AS (SELECT * FROM (VALUES {RULE_VALUES}) AS t(n, rule_id, decl, descr, legal, eng, hindi, notes, pdf, amended)),
qs AS (SELECT vec_id AS q_id, ['what is mrp 6(1)(e)', 'manufacturer address rule', 'net quantity', 'date of packing', 'rule 6 (1) (a)'][vec_id % 5 + 1] AS t, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
en AS (SELECT vec_id AS entry_no, CASE WHEN rule_id IS NULL THEN 'official_document' ELSE 'rule' END AS entry_type, lower(coalesce(rule_id, '')) AS ri, lower(coalesce(decl, '')) AS dl, lower(coalesce(legal, '')) AS lr,
  CAST(embedding AS DOUBLE[]) AS e FROM embeddings LEFT JOIN rl ON rl.n = vec_id % 23),
sc AS (SELECT q_id, entry_type, entry_no, list_dot_product(qs.e, en.e) + CASE WHEN entry_type = 'rule' THEN 0.15 ELSE 0 END
  + 0.30 * len(list_filter(regexp_extract_all(t, {q(_cite)}), lambda z: contains(replace(lr, ' ', ''), replace(z, ' ', '')) OR contains(ri, replace(z, ' ', ''))))
  + CASE WHEN contains(t, 'mrp') AND (contains(dl, 'mrp') OR contains(lr, 'mrp') OR contains(ri, '6_1_e')) THEN 0.2 ELSE 0 END
  + CASE WHEN contains(t, 'manufacturer') AND (contains(dl, 'manufacturer') OR contains(ri, '6_1_a')) THEN 0.2 ELSE 0 END
  + CASE WHEN contains(t, 'quantity') AND (contains(dl, 'quantity') OR contains(ri, '6_1_c')) THEN 0.2 ELSE 0 END AS raw FROM qs, en WHERE q_id <> entry_no)
SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY raw DESC, entry_type DESC, entry_no) AS INTEGER) AS hit_rank, entry_type, entry_no, round(CAST(raw AS DOUBLE), 4) AS score FROM sc QUALIFY hit_rank <= 3""")

NL = "chr(10)"
ENGLISH = (f"'According to the **{c.PCR}**:' || {NL} || {NL} || '• **Declaration**: ' || declaration_name || {NL} || '• **Statutory Citation**: ' || official_legal_reference || {NL} || "
           f"'• **Official Requirement**: ' || english_text || {NL} || '• **Official Source Document**: `' || source_pdf || '` (Last amended: ' || last_amended_date || ')'")
HINDI = (f"'विधिक मापविज्ञान (पैकेज्ड कमोडिटीज) नियम, 2011 के अनुसार:' || {NL} || {NL} || '• **प्रावधान**: ' || declaration_name || {NL} || '• **कानूनी संदर्भ**: ' || official_legal_reference || {NL} || "
         f"'• **विवरण**: ' || hindi_text_snippet || {NL} || '• **स्रोत दस्तावेज**: `' || source_pdf || '` (संशोधन तिथि: ' || last_amended_date || ')'")
RULE_ANSWER = f"CASE WHEN score > 0.05 THEN CASE WHEN regexp_matches(question, '[\\x{{0900}}-\\x{{097F}}]') AND hindi_text_snippet <> '' THEN {HINDI} ELSE {ENGLISH} END ELSE {q(c.REFUSAL)} END"
V = "CAST({} AS VARCHAR)".format
DATA_ANSWER = f"""CASE WHEN contains(lower(question), 'top') OR contains(lower(question), 'brand') THEN 'Based on ' || {V('tot.total_scans')} || ' persistent audit scans, the top non-compliant brands are:' || {NL}
   || '1. **' || b1.brand_name || '**: ' || {V('b1.non_compliant_scans')} || ' violations (' || {V('b1.non_compliance_rate')} || '% non-compliance, most common issue: ' || b1.most_common_violation || ')' || {NL}
   || '2. **' || b2.brand_name || '**: ' || {V('b2.non_compliant_scans')} || ' violations'
  WHEN contains(lower(question), 'violation') OR contains(lower(question), 'field') THEN 'The most frequently violated statutory declarations are: ' || worst || '.'
  ELSE '**Legal Metrology Inspection Analytics Summary**:' || {NL} || {NL} || '• **Total Scans Recorded**: ' || {V('tot.total_scans')} || {NL} || '• **Overall Compliance Rate**: ' || printf('%.1f', tot.compliance_rate) || '%' || {NL}
   || '• **Compliant Packages**: ' || {V('tot.compliant_scans')} || {NL} || '• **Non-Compliant / Violations**: ' || {V('tot.non_compliant_scans')} || {NL} || '• **Average Compliance Score**: ' || printf('%.1f', tot.average_compliance_score) || '%' END"""
HYBRID = f"""CASE WHEN hr.rule_id IS NOT NULL THEN {NL} || {NL} || '**Empirical Repository Statistics**:' || {NL} || '• **Field Violation Rate**: ' || {V('hr.violation_rate')} || '%' || {NL} || '• **Total Evaluations**: '
  || {V('hr.total_evaluations')} || ' scans (' || {V('hr.violation_count')} || ' violations observed).' ELSE {NL} || {NL} || '**Repository Metrics**: Total ' || {V('tot.total_scans')} || ' scans recorded in the database.' END"""
add("q_answers", f"""WITH {CORPUS}, {hits(2)}, {fields_cte()}, {brands_cte(2)}, tot AS ({SUMMARY}),
fr AS (SELECT *, CAST(violation_rate AS DOUBLE) AS vr FROM rates),
w3 AS (SELECT string_agg('**' || declaration_name || '** (' || {V('violation_count')} || ' violations, ' || {V('vr')} || '%)', ', ' ORDER BY violation_count DESC, violation_rate DESC, fo, field_name) AS worst
  FROM (SELECT * FROM fr WHERE violation_count > 0 ORDER BY violation_count DESC, violation_rate DESC, fo, field_name LIMIT 3) z),
nh AS (SELECT q_id, count(*) AS nhits FROM hits GROUP BY 1),
asked AS (SELECT z.q_id, {strip('z.text')} AS question, {intent('z.text')} AS kind, coalesce(h.score, 0) AS score, k.* EXCLUDE (search_text), coalesce(nhits, 0) AS nhits FROM questions z
  LEFT JOIN hits h ON h.q_id = z.q_id AND h.hit_rank = 1 LEFT JOIN corpus k ON k.entry_type = h.entry_type AND k.entry_no = h.entry_no LEFT JOIN nh ON nh.q_id = z.q_id)
SELECT a.q_id, CASE WHEN kind = 'UNKNOWN' AND question <> '' AND score >= 0.35 THEN 'RULE_LOOKUP' ELSE kind END AS intent,
  CASE WHEN kind = 'RULE_LOOKUP' OR (kind = 'UNKNOWN' AND question <> '' AND score >= 0.35) THEN {RULE_ANSWER} WHEN kind = 'DATA_QUERY' THEN {DATA_ANSWER}
    WHEN kind = 'HYBRID' THEN {RULE_ANSWER} || {HYBRID} ELSE {q(c.REFUSAL)} END AS reply,
  CASE WHEN kind = 'RULE_LOOKUP' OR (kind = 'UNKNOWN' AND question <> '' AND score >= 0.35) THEN CASE WHEN score > 0.05 THEN least(CAST(1 AS DOUBLE), round(score + 0.1, 4)) ELSE 0 END
    WHEN kind = 'DATA_QUERY' THEN 1.0 WHEN kind = 'HYBRID' THEN 0.95 ELSE 0 END AS confidence,
  CAST(CASE WHEN score > 0.05 AND (kind IN ('RULE_LOOKUP', 'HYBRID') OR (kind = 'UNKNOWN' AND question <> '' AND score >= 0.35)) THEN nhits ELSE 0 END AS INTEGER) AS citations
FROM asked a, tot, w3, (SELECT * FROM brands WHERE rk = 1) b1, (SELECT * FROM brands WHERE rk = 2) b2 LEFT JOIN (SELECT rule_id, vr AS violation_rate, total_evaluations, violation_count FROM fr) hr ON hr.rule_id = a.rule_id AND a.score > 0.05""")

add("q_stream_trend", f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS total_scans, {GOOD} AS compliant_scans, count(*) - {GOOD} AS non_compliant_scans,
  round(CAST({GOOD} * 100 AS DOUBLE) / count(*), 2) AS compliance_rate, {AVG} AS average_score FROM scan_records
  WHERE CAST(created_at AS DATE) + INTERVAL 1 DAY <= (SELECT max(created_at) - INTERVAL 2 DAY FROM scan_records) GROUP BY 1""")
add("q_stream_scores", f"""WITH {o.rule_ctes('product_input', 'product_id')}, {o.score_cte('product_id')}
SELECT s.product_id, overall_status, compliance_score, passed, failed, {o.GUIDE} AS guidance_note FROM scored s JOIN product_input p ON p.product_id = s.product_id""")
add("q_stream_first_deliveries", "SELECT DISTINCT id // 2 AS id FROM scan_records")


# a scan comes with the delivery of its two years, every tenth one delivery later; marks are the greatest time before a delivery
_ARRIVALS = """a AS (SELECT id, created_at, overall_status, compliance_score, (year(created_at) - 1992) // 2 + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS arrival FROM scan_records),
m AS (SELECT n.arrival, max(a.created_at) - INTERVAL 2 DAY AS mark FROM (SELECT DISTINCT arrival FROM a) n JOIN a ON a.arrival < n.arrival GROUP BY 1)"""
add("q_stream_corrected", f"""SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS total_scans, {GOOD} AS compliant_scans, count(*) - {GOOD} AS non_compliant_scans,
  round(CAST({GOOD} * 100 AS DOUBLE) / count(*), 2) AS compliance_rate, {AVG} AS average_score FROM scan_records GROUP BY 1""")
add("q_stream_late", f"""WITH {_ARRIVALS}
SELECT id, strftime(created_at, '%Y-%m-%d') AS date FROM a JOIN m USING (arrival) WHERE CAST(created_at AS DATE) + INTERVAL 1 DAY <= mark""")
add("q_stream_redeliveries", """WITH f AS (SELECT id, CAST(created_at AS TIMESTAMP) AS t, (year(created_at) - 1992) // 2 AS arrival FROM scan_records),
l AS (SELECT id, t AS t0, arrival AS arrival0, t + INTERVAL 90 DAY AS t, (year(t + INTERVAL 90 DAY) - 1992) // 2 AS arrival FROM f WHERE id % 7 = 0),
e AS (SELECT t, arrival FROM f UNION ALL SELECT t, arrival FROM l),
m AS (SELECT n.arrival, max(e.t) - INTERVAL 2 DAY AS mark FROM (SELECT DISTINCT arrival FROM e) n JOIN e ON e.arrival < n.arrival GROUP BY 1)
SELECT id, strftime(t, '%Y-%m-%d') AS date FROM f
UNION ALL SELECT id, strftime(l.t, '%Y-%m-%d') FROM l JOIN m USING (arrival) WHERE arrival > arrival0 AND t0 + INTERVAL 2 DAY <= mark""")

_N = len(c.RULES)
_DATED = ", ".join(str(i) for i, r in enumerate(c.RULES) if r["validation_type"] in ("DATE_VALIDATION", "BEST_BEFORE_VALIDATION"))
_IMPORTERS = ", ".join(str(i) for i, r in enumerate(c.RULES) if "IMPORTER" in r["rule_id"])
_CUSTOM = f"""{o.rule_ctes('product_input', 'product_id')},
l AS (SELECT n_nationkey AS k, n_nationkey % {_N + 2} AS n, 'Declaration of ' || n_name AS declaration, 'Local rule ' || n_name AS legal,
  CASE n_nationkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS sev FROM nation),
custom AS (SELECT product_id, n AS rule_no, rule_id, declaration, status, detected_value, reason, legal_reference, severity FROM checked
UNION ALL SELECT product_id, k + {_N}, 'LOCAL_' || CASE WHEN l.n IN ({_IMPORTERS}) THEN 'IMPORTER_' ELSE '' END || k, l.declaration, status, detected_value,
  replace(reason, legal_reference, legal), legal,
  CASE WHEN (status = 'PASS' AND l.n IN ({_DATED})) OR reason = 'Rule is not applicable to this commodity category or configuration.' THEN sev ELSE severity END
  FROM l JOIN checked c ON c.n = l.n
UNION ALL SELECT product_id, k + {_N}, 'LOCAL_' || k, l.declaration,
  CASE WHEN l.n = {_N + 1} THEN 'REQUIRES_HUMAN_VERIFICATION' WHEN length(coalesce(product_name, '')) >= CASE WHEN sev = 'HIGH' THEN 30 ELSE 20 END THEN 'PASS' ELSE 'WARNING' END,
  CASE WHEN l.n = {_N} THEN product_name END,
  CASE WHEN l.n = {_N} THEN 'Name of ' || length(coalesce(product_name, '')) || ' characters.' ELSE 'No automated validator registered for ''UNHEARD_OF''.' END, legal, sev
  FROM l, product_input WHERE l.n >= {_N})"""
add("q_custom_rules", f"""WITH {_CUSTOM}
SELECT product_id, CAST(rule_no AS BIGINT) AS rule_no, rule_id, declaration, status, detected_value, reason, legal_reference, severity FROM custom""")
add("q_custom_scores", f"""WITH {_CUSTOM}, {o.score_cte('product_id', 'custom')}
SELECT product_id, total_checks, passed, failed, warnings, human_verification_required, not_applicable, compliance_score,
  overall_status FROM scored""")

# ---------------------------------------------------------------------------------------------
# repair of noisy labels: patterns on ASCII text; looks around a letter are looks at its neighbours
# ---------------------------------------------------------------------------------------------


def _repaired(e: str, repairs: list[tuple[str, str]]) -> str:
    for pattern, text in repairs:
        if "(?!" in pattern:  # a word that no dot follows: the character after it stands for the look ahead
            pattern, text = pattern.replace(r"(?!\.)\b", r"\b([^.]|$)"), text + "$1"
        e = f"regexp_replace({e}, {q(pattern)}, {q(text.replace('$1', chr(92) + '1'))}, 'gi')"
    return e


def _digit_passes(source: str) -> str:
    """CTEs s1 to s5: letters between digits or word ends, one repair after the other on all characters at once."""
    before, after = "CASE WHEN i > 1 THEN substr(t, i - 1, 1) ELSE '' END", "substr(t, i + 1, 1)"

    def digit(ch):
        return f"regexp_matches({ch}, '[0-9]')"

    def no_word(ch):
        return f"NOT regexp_matches({ch}, '[A-Za-z0-9_]')"

    tests = [("'o', 'O'", "0", f"{digit(before)} AND ({digit(after)} OR {no_word(after)})"), ("'o', 'O'", "0", f"{no_word(before)} AND {digit(after)}"),
             ("'l', 'I'", "1", f"{digit(before)} AND ({digit(after)} OR {no_word(after)})"), ("'l', 'I'", "1", f"{no_word(before)} AND {digit(after)}"),
             ("'s', 'S'", "5", f"{digit(before)} AND {digit(after)}")]
    return ",\n".join(
        f"s{n + 1} AS (SELECT product_id, pos, k, t0, array_to_string(list_transform(string_split(t, ''), lambda ch, i: CASE WHEN ch IN ({letters}) AND {test} THEN '{to}' ELSE ch END), '') AS t "
        f"FROM {source if n == 0 else f's{n}'})" for n, (letters, to, test) in enumerate(tests))


_NUMERIC = f"(regexp_matches(t0, '[0-9]') OR {words('lower(t0)', c.NUMERIC_LINE_WORDS)})"
_CLEANED = f"""n AS (SELECT product_id, CAST(i - 1 AS INTEGER) AS pos, ls[i] AS line FROM (SELECT product_id, string_split(raw_text, chr(10)) AS ls FROM noisy_labels) z, unnest(range(1, len(ls) + 1)) AS u(i)),
a AS (SELECT product_id, pos, line, {_repaired('line', c.TEXT_REPAIRS)} AS words, {_repaired(strip('line'), c.TEXT_REPAIRS)} AS sw FROM n),
s0 AS (SELECT product_id, pos, 'd' AS k, line AS t0, line AS t FROM a UNION ALL SELECT product_id, pos, 'c', sw, sw FROM a),
{_digit_passes('s0')},
f AS (SELECT product_id, pos, k, CASE WHEN {_NUMERIC} THEN t ELSE t0 END AS t FROM s5),
cl AS (SELECT a.product_id, a.pos, words, d.t AS digits, CASE WHEN {o.blank('line')} THEN '' ELSE {strip(f"regexp_replace({o._units('e.t')}, '[ ' || chr(9) || ']+', ' ', 'g')")} END AS cleaned
  FROM a JOIN f d ON d.product_id = a.product_id AND d.pos = a.pos AND d.k = 'd' JOIN f e ON e.product_id = a.product_id AND e.pos = a.pos AND e.k = 'c')"""
add("q_label_repair", f"WITH {_CLEANED}\nSELECT product_id, pos, words, digits, cleaned FROM cl")
add("q_result_repair", f"""WITH {_CLEANED},
r AS (SELECT product_id, string_agg(cleaned, chr(10) ORDER BY pos) FILTER (WHERE cleaned <> '' AND (pos + product_id) % 5 <> 0) AS kept,
  count(*) FILTER (WHERE cleaned <> '' AND (pos + product_id) % 5 <> 0) AS k, string_agg(cleaned, chr(10) ORDER BY pos) FILTER (WHERE cleaned <> '') AS full_text, count(*) AS n FROM cl GROUP BY 1)
SELECT product_id, coalesce(kept, full_text, '') AS cleaned, CAST(CASE WHEN k > 0 THEN k ELSE n END AS INTEGER) AS regions, 'gray,{c.REPAIR_MARKER}' AS steps FROM r""")

# ---------------------------------------------------------------------------------------------
# evidence: lines are regions, 18 px apart; a declaration is shown by the lines that hold its text or lie in it
# ---------------------------------------------------------------------------------------------

_ENTITY_QUERY = ",\n".join(f"{n}_q AS (SELECT t.product_id, kw FROM (SELECT * FROM {n}_t WHERE raw <> '' QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY i, k) = 1) t JOIN {n}_k USING (k))"
                            for n in ("manufacturer", "packer", "importer"))
_ASKED = [  # field, detected value, text that is looked for, condition under which the confidence is given and no record made, that confidence, whether its boxes stay
    *[(f, "product_name", "product_name", "false", "0", "true") for f in ("product_name", "commodity_name")],
    *[(f"{n}_{part}", f"{n}_{part}", f"(SELECT kw FROM {n}_q z WHERE z.product_id = x.product_id)", "addr_moved" if f"{n}_{part}" == "manufacturer_address" else "false", "0.85", "false")
      for n in ("manufacturer", "packer", "importer") for part in ("name", "address")],
    ("net_quantity", "net_quantity", "qty_raw0", "qty_conf IN (0.95, 0.92)", "qty_conf", "true"), ("mrp", "mrp", "mrp_raw", "false", "0", "true"),
    ("unit_sale_price", "unit_sale_price", "unit_sale_price", "false", "0", "true"), ("date_declaration", "date_declaration", "made_raw", "false", "0", "true"),
    ("best_before", "best_before", "best_raw", "false", "0", "true"), ("consumer_care_email", "consumer_care_email", "consumer_care_email", "false", "0", "true"),
    ("consumer_care_phone", "consumer_care_phone", "consumer_care_phone", "false", "0", "true"),
    ("consumer_care", "CASE WHEN cared THEN consumer_care END", "'care'", "false", "0", "true"),
    ("consumer_care", "CASE WHEN NOT cared THEN consumer_care_email END", "consumer_care_email", "false", "0", "true"),
    ("consumer_care", "CASE WHEN NOT cared THEN phone0 END", "phone0", "false", "0", "true"),
    ("country_of_origin", "country_of_origin", "origin_raw", "origin_fix <> ''", "origin_conf", "origin_fix = 'place'"),
]
_EVIDENCE = f"""{o.EXTRACT},
{_ENTITY_QUERY},
x0 AS (SELECT e.*, EXISTS (SELECT 1 FROM care_b b WHERE b.product_id = e.product_id) AS cared, (100 - (product_id % 7) * 8) / CAST(100 AS DOUBLE) AS seen FROM extracted e),
x AS (SELECT * FROM x0),
ask AS ({' UNION ALL '.join(f"SELECT product_id, {q(f)} AS field_name, {k} AS part, seen, {query} AS query, {given} AS given, CAST({conf} AS DOUBLE) AS conf, {keeps} AS keeps FROM x WHERE {value} IS NOT NULL" for k, (f, value, query, given, conf, keeps) in enumerate(_ASKED))}),
hit AS (SELECT a.*, l.i - 1 AS j, length(l.ln) AS w FROM ask a JOIN lines l ON l.product_id = a.product_id AND a.query <> '' AND (contains(lower(l.ln), lower(a.query)) OR contains(lower(a.query), lower(l.ln)))),
per AS (SELECT a.product_id, a.field_name, a.part, any_value(a.given) AS given, any_value(a.conf) AS conf, any_value(a.keeps) AS keeps, any_value(a.seen) AS seen,
  coalesce(any_value(a.query), '') = '' AS unasked, count(h.j) AS n, min(h.j) AS lo, max(h.j) AS hi, max(h.w) AS w
  FROM ask a LEFT JOIN hit h ON h.product_id = a.product_id AND h.field_name = a.field_name AND h.part = a.part GROUP BY 1, 2, 3),
field AS (SELECT product_id, field_name, bool_or(given) AS given,
  max(CASE WHEN given THEN conf WHEN unasked THEN 0.85 WHEN n > 0 THEN seen ELSE 0.8 END) AS confidence,
  CAST(sum(CASE WHEN given AND NOT keeps THEN 0 ELSE n END) AS INTEGER) AS regions, min(lo) AS lo, max(hi) AS hi, max(w) AS w FROM per GROUP BY 1, 2),
box AS (SELECT *, NOT given AND regions > 0 AS has, CASE WHEN NOT given AND regions > 0 THEN CAST(10 AS DOUBLE) END AS x0, CASE WHEN has THEN CAST(18 * lo AS DOUBLE) END AS y0,
  CASE WHEN has THEN CAST(10 + 6 * w AS DOUBLE) END AS x1, CASE WHEN has THEN CAST(18 * hi + 6 + product_id % 11 AS DOUBLE) END AS y1 FROM field)"""
add("q_region_evidence", f"""WITH {_EVIDENCE}
SELECT product_id, field_name, round(confidence, 4) AS confidence, regions, x0, y0, x1, y1,
  CASE WHEN given THEN NULL WHEN has THEN round(y1 - y0, 1) ELSE 0 END AS text_height,
  CASE WHEN given THEN NULL WHEN NOT has OR confidence < {c.WARN_CONFIDENCE} OR y1 - y0 < {c.WARN_HEIGHT_PX} THEN 'UNREADABLE'
    WHEN confidence < {c.MIN_CONFIDENCE} OR y1 - y0 < {c.MIN_HEIGHT_PX} THEN CASE WHEN confidence >= CAST({c.MIN_CONFIDENCE} AS DOUBLE) * CAST(0.9 AS DOUBLE) THEN 'REQUIRES_HUMAN_VERIFICATION' ELSE 'LOW_READABILITY' END
    ELSE 'READABLE' END AS readability,
  CASE WHEN given THEN NULL WHEN has THEN CASE WHEN round((y0 + y1) / 2 / 180, 3) <= 0.5 THEN 'TOP' ELSE 'BOTTOM' END || '_' || CASE WHEN round((x0 + x1) / 2 / 640, 3) <= 0.5 THEN 'LEFT' ELSE 'RIGHT' END ELSE 'UNKNOWN' END AS quadrant,
  CASE WHEN NOT given THEN has END AS has_evidence FROM box""")
add("q_rule_evidence", f"""WITH {_EVIDENCE}, {o.PRODUCTS_OF_LABELS}, {o.rule_ctes('products', 'product_id')},
rf AS (SELECT * FROM (VALUES {', '.join(f'({q(r)}, {q(f)})' for r, f in c.EVIDENCE_FIELD.items())}) AS t(rule_id, field_name))
SELECT product_id, trim(string_split(declaration, '(')[1]) AS label, status, x0, y0, x1, y1 FROM checked JOIN rf USING (rule_id) JOIN box USING (product_id, field_name) WHERE has""")

# ---------------------------------------------------------------------------------------------
# sinks and sources: what was written is what the views hold
# ---------------------------------------------------------------------------------------------

add("q_scan_page_deep", f"""SELECT id, product_name, overall_status, compliance_score, {ISO} AS created_at FROM (SELECT * FROM scan_records ORDER BY created_at DESC, id LIMIT 50 OFFSET 1000) t""")
add("q_scans_rewritten", """SELECT id, CASE WHEN id % 11 = 0 THEN 'corrected' ELSE product_name END AS product_name, CASE WHEN id % 11 = 0 THEN 'REVIEWED' ELSE overall_status END AS overall_status,
  round(compliance_score + 0.004, 2) AS compliance_score, strftime(created_at, '%Y-%m-%d') AS scan_date FROM scan_records
WHERE id % 11 = 0 OR id NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)""")
add("q_stored_range", f"""SELECT id, officer_id, overall_status, round(compliance_score + 0.004, 2) AS compliance_score, strftime(created_at, '%Y-%m-%d') AS scan_date FROM scan_records WHERE {YEAR}""")
add("q_csv_overview", "SELECT scan_id, CAST(pos AS VARCHAR) AS pos, attribute, value FROM (" + ORACLE["q_overview_rows"] + ") t")
add("q_index_file", "SELECT * FROM (" + ORACLE["q_doc_metadata"] + ") t")
add("q_rules_file", f"""WITH b AS (SELECT * FROM (VALUES {', '.join(f"({i}, {q(r['rule_id'])}, {q(r['declaration_name'])}, {q(r['legal_reference'])}, {q(r['severity'])}, {r['mandatory']}, {r['conditional']})" for i, r in enumerate(c.RULES))}) AS t(n, rule_id, declaration_name, legal_reference, severity, mandatory, conditional))
SELECT CAST(n AS BIGINT) AS rule_no, rule_id, declaration_name, legal_reference, severity, mandatory, conditional FROM b
UNION ALL SELECT CAST(n_nationkey + {_N} AS BIGINT), 'LOCAL_' || CASE WHEN n_nationkey % {_N + 2} IN ({_IMPORTERS}) THEN 'IMPORTER_' ELSE '' END || n_nationkey, 'Declaration of ' || n_name, 'Local rule ' || n_name,
  CASE n_nationkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END, coalesce(b.mandatory, true), coalesce(b.conditional, false) FROM nation LEFT JOIN b ON b.n = n_nationkey % {_N + 2}""")
add("q_regions_file", "SELECT image_id, engine, pos, text, confidence, x0, y0, x1, y1, CAST(CASE WHEN partkey % 2 = 0 THEN 2 ELSE 4 END AS INTEGER) AS points FROM ocr_regions")

# ---------------------------------------------------------------------------------------------
# inspections: fusion or panels, extraction, rules and insight in one statement
# ---------------------------------------------------------------------------------------------

add("q_ensemble_images", "SELECT o_orderkey AS image_id, coalesce(winning_engine, 'None') AS winning_engine, coalesce(winning_score, 0) AS winning_score, coalesce(active_engines, 0) AS active_engines, "
    "coalesce(merged_text, '') AS merged_text, coalesce(average_confidence, 0) AS average_confidence, coalesce(engine_agreement_score, 0) AS engine_agreement_score, "
    "coalesce(clusters_count, 0) AS clusters_count, coalesce(agreed_clusters_count, 0) AS agreed_clusters_count FROM orders LEFT JOIN (" + ORACLE["q_ensemble"] + ") t ON image_id = o_orderkey")


def _coverage(images: str) -> str:
    found = " + ".join(f"CAST({e} IS NOT NULL AS INTEGER)" for e in o._found.values())
    return f"'Extracted ' || CAST({found} AS VARCHAR) || ' of 8 statutory declarations across {images}.'"


add("q_video_inspection", f"""WITH RECURSIVE fr AS (SELECT r.*, image_id AS video_id, CAST(suppkey % 3 AS INTEGER) AS frame_index, CAST(suppkey % 3 AS INTEGER) AS source,
  text || CASE WHEN partkey % 3 = 0 THEN chr(10) || 'MRP Rs. ' || CAST(partkey % 500 + 1 AS VARCHAR) || ' incl. of all taxes' ELSE '' END AS said FROM ocr_regions r),
sh AS (SELECT v.video_id, v.f AS frame_index, coalesce(max(y1), 0) AS s FROM (SELECT DISTINCT video_id, f FROM fr, unnest([0, 1, 2]) AS u(f)) v LEFT JOIN fr ON fr.video_id = v.video_id AND fr.frame_index = v.f GROUP BY 1, 2),
ch AS (SELECT video_id, 0 AS frame_index FROM sh WHERE frame_index = 0
  UNION ALL SELECT video_id, CASE WHEN max(s) FILTER (WHERE frame_index = 2) > max(s) FILTER (WHERE frame_index = 1) THEN 2 ELSE 1 END FROM sh GROUP BY 1),
pr AS (SELECT video_id, min_by(frame_index, {{'s': -s, 'f': frame_index}}) AS primary_frame, count(*) AS frames_analyzed FROM ch JOIN sh USING (video_id, frame_index) GROUP BY 1),
src AS (SELECT fr.* EXCLUDE (text, said), said AS text FROM fr JOIN ch USING (video_id, frame_index)), {greedy('src', 'video_id', 'frame_index, engine, ' + TIE)},
win AS (SELECT video_id, start, w.t AS text, w.c AS confidence, w.x0 AS x0, w.y0 AS y0, w.x1 AS x1, w.y1 AS y1 FROM cluster),
ext AS (SELECT video_id, greatest(100, CAST(floor(round(max(x1), 1)) AS INTEGER) + 50) AS ew, greatest(100, CAST(floor(round(max(y1), 1)) AS INTEGER) + 50) AS eh FROM win GROUP BY 1),
sized AS (SELECT win.*, ew, eh FROM win JOIN ext USING (video_id)), {blocks('sized', 'ew', 'eh', 'false')}, {reading('blk', 'video_id', 'start')},
fused_text AS (SELECT video_id AS product_id, string_agg(text, chr(10) ORDER BY reading_position) AS raw_text, count(*) AS regions_detected FROM placed GROUP BY 1),
{o.EXTRACT.replace('FROM label_text', 'FROM fused_text')}, {o.PRODUCTS_OF_LABELS}, {o.rule_ctes('products', 'product_id')}, {o.score_cte('product_id')}
SELECT s.product_id AS video_id, primary_frame, frames_analyzed, regions_detected, overall_status, compliance_score, {_coverage('1 package image')} AS coverage_note
FROM scored s JOIN extracted USING (product_id) JOIN fused_text USING (product_id) JOIN pr ON pr.video_id = s.product_id""")

_FIELDS = list(dict.fromkeys(n for n, *_ in o._ROWS))
add("q_panel_inspection", f"""WITH panel_text AS (WITH {o.lines_cte()} SELECT product_id * 2 + pn AS product_id, array_to_string(list_filter(ls, lambda l, i: (i - 1) % 2 = pn), chr(10)) AS raw_text FROM parts, unnest([0, 1]) AS u(pn)),
{o.EXTRACT.replace('FROM label_text', 'FROM panel_text').replace('extracted AS (', 'read AS (')},
pf AS ({' UNION ALL '.join(f"SELECT product_id // 2 AS pid, product_id % 2 AS panel, {q(n)} AS field_name, {v} AS value, CAST({k} AS DOUBLE) AS confidence FROM read WHERE {v} <> ''" for n, v, _, k in o._ROWS)}),
pick AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY pid, field_name ORDER BY confidence DESC, length({strip('value')}) DESC, panel) = 1),
flags AS (SELECT product_id // 2 AS pid, coalesce(min_by(category, product_id % 2) FILTER (WHERE category NOT IN ('general', '')), 'general') AS category, bool_or(is_imported) AS is_imported FROM read GROUP BY 1),
extracted AS (SELECT f.pid AS product_id, any_value(f.category) AS category, any_value(f.is_imported) AS is_imported,
  {', '.join(f"max(value) FILTER (WHERE field_name = {q(n)}) AS {n}" for n in _FIELDS)} FROM flags f LEFT JOIN pick USING (pid) GROUP BY 1),
{o.PRODUCTS_OF_LABELS.replace('product_name AS generic_name', 'coalesce(commodity_name, product_name) AS generic_name')}, {o.rule_ctes('products', 'product_id')}, {o.score_cte('product_id')},
lab AS (SELECT * FROM (VALUES {', '.join(f"({i}, {q(k)}, {q(v)})" for i, (k, v) in enumerate(c.PANEL_NOTE_LABELS.items()))}) AS t(ord, field_name, label)),
noted AS (SELECT pid AS product_id, string_agg(label || ' found on image ' || CAST(panel + 1 AS VARCHAR), ', ' ORDER BY ord) AS found FROM pick JOIN lab USING (field_name) GROUP BY 1),
guided AS (SELECT product_id, {o.GUIDE} AS note FROM products), covered AS (SELECT product_id, category, {_coverage('2 package images')} AS coverage_note FROM extracted)
SELECT s.product_id, overall_status, compliance_score, passed, failed,
  {q(c.DEFAULT_SUMMARY)} || chr(10) || chr(10) || '[MULTI-PANEL AUDIT] Analysis based on 2 images of the same product.' || coalesce(' (' || found || ')', '') || coalesce(chr(10) || chr(10) || '[INSPECTOR GUIDANCE] ' || note, '') AS summary,
  coverage_note, category
FROM scored s JOIN guided USING (product_id) JOIN covered USING (product_id) LEFT JOIN noted USING (product_id)""")
