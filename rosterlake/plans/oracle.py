"""DuckDB SQL for the registered estimation queries, as chained CTEs."""

from __future__ import annotations

import re

START, END, AS_OF = "DATE '1995-01-01'", "DATE '2001-11-01'", "DATE '2001-11-01'"


def coverage(age: str) -> str:
    a = f"greatest(0, {age})"
    return (
        f"greatest(0.15::DOUBLE, least(1.0::DOUBLE, CASE WHEN {a} <= 0 THEN 0.55::DOUBLE WHEN {a} < 6 THEN 0.55::DOUBLE + (0.85::DOUBLE - 0.55::DOUBLE) * ({a} / 6::DOUBLE)"
        f" WHEN {a} <= 36 THEN 0.85::DOUBLE WHEN {a} < 96 THEN 0.85::DOUBLE + (0.35::DOUBLE - 0.85::DOUBLE) * (({a} - 36) / 60::DOUBLE) ELSE 0.35::DOUBLE END))"
    )


def ord_(c: str) -> str:
    return f"(year({c}) * 12 + month({c}) - 1)"


def from_ord(n: str) -> str:
    return f"make_date(({n})::INT // 12, ({n})::INT % 12 + 1, 1)"


BASE = """
lin AS (
  SELECT *, md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::INT, round(l_extendedprice * 100)::INT, round(l_discount * 100)::INT, round(l_tax * 100)::INT, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS id,
    date_trunc('month', l_shipdate)::DATE AS ship_month FROM lineitem
), company AS (
  SELECT s_suppkey AS company_id, s_name AS name, 'P' || (s_nationkey % 3) AS tier FROM supplier
), employment AS (
  SELECT l_suppkey AS company_id, o_custkey AS person_id, date_trunc('month', o_orderdate)::DATE AS start_month, CASE WHEN l_shipdate >= o_orderdate THEN ship_month END AS end_month,
    (l_shipdate < o_orderdate AND l_linestatus = 'O') AS is_current
  FROM lin JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 4 <> 0
), anchors0 AS (
  SELECT l_suppkey AS company_id, id AS anchor_id, ship_month AS anchor_month,
    CASE WHEN l_returnflag = 'A' THEN l_quantity * 10 ELSE l_quantity * 10 * (1 - l_discount) END AS value_min, l_quantity * 10 AS value_point,
    CASE WHEN l_returnflag = 'A' THEN l_quantity * 10 ELSE l_quantity * 10 * (1 + l_tax) END AS value_max,
    CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'range' ELSE 'bucket' END AS kind,
    CASE WHEN l_quantity >= 48 THEN 'manual_anchor' WHEN l_linestatus = 'F' THEN 'historical_statement' ELSE 'current_headcount_anchor' END AS anchor_type,
    0.4::DOUBLE + 5::DOUBLE * l_discount AS confidence, l_returnflag AS source_name
  FROM lin WHERE l_linenumber = 1
), events0 AS (
  SELECT l_suppkey AS company_id, id AS event_id, CASE l_returnflag WHEN 'A' THEN 'acquisition' WHEN 'N' THEN 'rebrand' ELSE 'layoff' END AS event_type, ship_month AS event_month,
    CASE WHEN l_linestatus = 'O' THEN 'first_party' ELSE 'press' END AS source_class, l_discount * 10 AS confidence, CASE WHEN l_tax > 0.03 THEN 'note ' || id END AS description, l_shipdate AS created_at
  FROM lin WHERE l_linenumber = 7 AND l_quantity >= 49
), benchmark_rows AS (
  SELECT l_suppkey AS company_id, id AS benchmark_id, CASE l_returnflag WHEN 'A' THEN 'primary' WHEN 'N' THEN 'secondary' ELSE 'tertiary' END AS provider,
    (['headcount_current', 'headcount_6m_ago', 'headcount_1y_ago', 'headcount_2y_ago', 'growth_6m_pct', 'growth_1y_pct', 'growth_2y_pct'])[(l_quantity::INT % 7) + 1] AS metric, DATE '2001-11-01' AS as_of_month,
    CASE WHEN l_quantity::INT % 7 >= 4 THEN l_quantity - 25 WHEN l_returnflag = 'A' THEN l_quantity * 10 ELSE l_quantity * 10 * (1 - l_discount) END AS value_min,
    CASE WHEN l_quantity::INT % 7 >= 4 THEN l_quantity - 25 ELSE l_quantity * 10 END AS value_point,
    CASE WHEN l_quantity::INT % 7 >= 4 THEN l_quantity - 25 WHEN l_returnflag = 'A' THEN l_quantity * 10 ELSE l_quantity * 10 * (1 + l_tax) END AS value_max, l_partkey AS row_index
  FROM lin WHERE l_linenumber = 2
), ov AS (
  SELECT *, 'r' || l_partkey AS reason FROM lin WHERE l_linenumber = 3 AND l_quantity = 50 AND l_discount <> 0.1
), pins AS (
  SELECT l_suppkey AS company_id, id AS anchor_id, ship_month AS anchor_month, l_quantity * 10 * 0.9::DOUBLE AS value_min, l_quantity * 10 AS value_point, l_quantity * 10 * 1.1::DOUBLE AS value_max,
    'exact' AS kind, 'manual_anchor' AS anchor_type, 0.9::DOUBLE AS confidence, 'manual_override' AS source_name
  FROM ov WHERE l_returnflag = 'A'
), windows AS (
  SELECT l_suppkey AS company_id, ship_month AS start_month, (ship_month + INTERVAL 2 MONTH)::DATE AS end_month, reason, l_shipdate AS created_at, id FROM ov WHERE l_returnflag = 'N'
), synthetic AS (
  SELECT l_suppkey AS company_id, ship_month AS event_month, 'merger' AS event_type FROM ov WHERE l_returnflag = 'R'
), anchors AS (
  SELECT * FROM anchors0 UNION ALL SELECT * FROM pins
), events AS (
  SELECT company_id, event_month, event_type FROM events0 UNION ALL SELECT * FROM synthetic
)"""

SPINE = f"""
spine AS (
  SELECT company_id, unnest(generate_series({START}, {END}, INTERVAL 1 MONTH))::DATE AS month FROM company
), counts AS (
  SELECT s.company_id, s.month, count(DISTINCT e.person_id) AS profiles
  FROM spine AS s LEFT JOIN employment AS e ON e.company_id = s.company_id AND s.month >= e.start_month
    AND s.month <= coalesce(e.end_month, CASE WHEN e.is_current THEN {AS_OF} ELSE e.start_month END) AND s.month <= {AS_OF}
  GROUP BY ALL
)"""

SEGMENTS = f"""
breaks0 AS (
  SELECT DISTINCT company_id, event_month AS segment_start, event_type FROM events
  WHERE event_type IN ('acquisition', 'merger', 'spinout', 'layoff', 'parent_sub_reassignment') AND event_month BETWEEN {START} AND {END}
), starts AS (
  SELECT company_id, segment_start, list(event_type ORDER BY event_type) FILTER (WHERE event_type IS NOT NULL) AS opening_types
  FROM (SELECT * FROM breaks0 UNION ALL SELECT company_id, {START}, NULL FROM company) GROUP BY ALL
), segments AS (
  SELECT company_id, row_number() OVER w AS segment_no, segment_start, coalesce((lead(segment_start) OVER w - INTERVAL 1 MONTH)::DATE, {END}) AS segment_end, coalesce(opening_types, []) AS opening_types
  FROM starts WINDOW w AS (PARTITION BY company_id ORDER BY segment_start)
)"""

RECONCILED = f"""
placed AS (
  SELECT a.*, g.segment_no, g.segment_start, g.segment_end,
    CASE anchor_type WHEN 'manual_anchor' THEN 5 WHEN 'historical_statement' THEN 3 WHEN 'current_headcount_anchor' THEN 2 ELSE 0 END AS tier
  FROM anchors AS a JOIN segments AS g ON a.company_id = g.company_id AND a.anchor_month BETWEEN g.segment_start AND g.segment_end
), top AS (
  SELECT *, max((kind <> 'bucket')::INT) OVER (PARTITION BY company_id, segment_no) = 1 AS precise
  FROM (SELECT *, max(tier) OVER (PARTITION BY company_id, segment_no) AS best FROM placed) WHERE tier = best
), pool AS (
  SELECT company_id, segment_no, segment_start, segment_end, precise, min(value_min) AS tier_min, max(value_max) AS tier_max, count(*) AS n_top,
    count(*) FILTER (WHERE NOT precise OR kind <> 'bucket') AS n_point,
    list(confidence ORDER BY anchor_month, anchor_id) FILTER (WHERE NOT precise OR kind <> 'bucket') AS w,
    list(value_point * confidence ORDER BY anchor_month, anchor_id) FILTER (WHERE NOT precise OR kind <> 'bucket') AS pw,
    list({ord_('anchor_month')} * confidence ORDER BY anchor_month, anchor_id) FILTER (WHERE NOT precise OR kind <> 'bucket') AS mw
  FROM top GROUP BY ALL
), folded AS (
  SELECT *, list_reduce(w, lambda a, b: a + b) AS sw, list_reduce(pw, lambda a, b: a + b) AS sp, list_reduce(mw, lambda a, b: a + b) AS sm FROM pool
), reconciled AS (
  SELECT company_id, segment_no, least(greatest({from_ord('round_even(sm / sw, 0)')}, segment_start), segment_end) AS anchor_month,
    least(tier_min, sp / sw) AS value_min, sp / sw AS value_point, greatest(tier_max, sp / sw) AS value_max, n_top, n_point, precise
  FROM folded
)"""

SERIES = f"""
best AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY company_id, segment_no, anchor_month ORDER BY confidence DESC, tier DESC, anchor_id) = 1
), dense AS (
  SELECT company_id, segment_no, unnest(generate_series(segment_start, segment_end, INTERVAL 1 MONTH))::DATE AS month FROM segments
), span AS (
  SELECT company_id, segment_no, min(anchor_month) AS lo, max(anchor_month) AS hi, count(DISTINCT anchor_month) AS anchor_months FROM placed GROUP BY ALL
), flank0 AS (
  SELECT d.company_id, d.segment_no, d.month, s.lo, s.hi, s.anchor_months, coalesce(c.profiles, 0) AS profiles,
    max(coalesce(c.profiles, 0)) OVER (PARTITION BY d.company_id, d.segment_no) >= 5 AS signal,
    (SELECT max(b.anchor_month) FROM best b WHERE b.company_id = d.company_id AND b.segment_no = d.segment_no AND b.anchor_month <= d.month) AS back0,
    (SELECT min(b.anchor_month) FROM best b WHERE b.company_id = d.company_id AND b.segment_no = d.segment_no AND b.anchor_month > d.month) AS ahead0
  FROM dense d LEFT JOIN span s USING (company_id, segment_no) LEFT JOIN counts c USING (company_id, month)
), flank AS (
  SELECT *, CASE WHEN month <= lo THEN lo WHEN month >= hi THEN hi ELSE back0 END AS l_month, CASE WHEN month > lo AND month < hi THEN ahead0 END AS r_month FROM flank0
), inter AS (
  SELECT f.*, x.value_min AS l_min, x.value_point AS l_point, x.value_max AS l_max, y.value_min AS r_min, y.value_point AS r_point, y.value_max AS r_max,
    ({ord_('f.month')} - {ord_('f.l_month')}) / ({ord_('f.r_month')} - {ord_('f.l_month')})::DOUBLE AS t,
    CASE WHEN f.r_month IS NULL THEN abs({ord_('f.month')} - {ord_('f.l_month')}) ELSE least({ord_('f.month')} - {ord_('f.l_month')}, {ord_('f.r_month')} - {ord_('f.month')}) END AS distance
  FROM flank f LEFT JOIN best x ON x.company_id = f.company_id AND x.segment_no = f.segment_no AND x.anchor_month = f.l_month
    LEFT JOIN best y ON y.company_id = f.company_id AND y.segment_no = f.segment_no AND y.anchor_month = f.r_month
), interpolated AS (
  SELECT *, CASE WHEN r_month IS NULL THEN l_point ELSE l_point + (r_point - l_point) * t END AS i_point,
    CASE WHEN r_month IS NULL THEN l_min ELSE least(l_min + (r_min - l_min) * t, l_point + (r_point - l_point) * t) END AS i_min,
    CASE WHEN r_month IS NULL THEN l_max ELSE greatest(l_max + (r_max - l_max) * t, l_point + (r_point - l_point) * t) END AS i_max
  FROM inter
), cased AS (
  SELECT i.company_id, i.segment_no, i.month, i.profiles, i.i_min, i.i_point, i.i_max, i.distance, i.lo, i.hi, r.anchor_month AS r_anchor, r.value_min AS a_min, r.value_point AS a_point, r.value_max AS a_max,
    coalesce(c.profiles, 0) AS anchor_profiles, i.l_month, i.r_month,
    1::DOUBLE / {coverage("datediff('month', i.month, " + AS_OF + ")")} AS factor,
    CASE WHEN coalesce(c.profiles, 0) > 0 THEN i.profiles * (1::DOUBLE / {coverage("datediff('month', i.month, " + AS_OF + ")")}) / (c.profiles / {coverage("datediff('month', r.anchor_month, " + AS_OF + ")")}) END AS scale,
    CASE WHEN NOT signal AND coalesce(anchor_months, 0) >= 2 THEN 'i' WHEN r.value_point IS NULL THEN 'none' WHEN coalesce(c.profiles, 0) <= 0 THEN 'flat' WHEN i.profiles < 5 THEN 'few' ELSE 'scaled' END AS kase
  FROM interpolated i LEFT JOIN reconciled r USING (company_id, segment_no) LEFT JOIN counts c ON c.company_id = i.company_id AND c.month = r.anchor_month
), raw0 AS (
  SELECT *, CASE kase WHEN 'i' THEN i_min WHEN 'none' THEN 0 WHEN 'scaled' THEN a_min * scale ELSE a_min END AS value_min,
    CASE kase WHEN 'i' THEN i_point WHEN 'none' THEN 0 WHEN 'scaled' THEN a_point * scale ELSE a_point END AS value_point,
    CASE kase WHEN 'i' THEN i_max WHEN 'none' THEN 0 WHEN 'scaled' THEN a_max * scale ELSE a_max END AS value_max,
    CASE WHEN distance <= 1 THEN 'medium' WHEN distance <= 6 THEN 'low' ELSE 'manual_review_required' END AS i_band, (month < lo OR month > hi) AS beyond
  FROM cased
), raw AS (
  SELECT company_id, segment_no, month, value_min, value_point, value_max, CASE kase WHEN 'i' THEN 0 ELSE profiles END AS profiles,
    CASE kase WHEN 'i' THEN i_point WHEN 'none' THEN 0 ELSE a_point END AS anchor_value,
    CASE kase WHEN 'i' THEN 'interpolated_multi_anchor' WHEN 'flat' THEN 'degraded_current_only' WHEN 'scaled' THEN 'scaled_ratio_coverage_corrected' ELSE 'suppressed_low_sample' END AS method,
    CASE kase WHEN 'i' THEN i_band WHEN 'flat' THEN 'low' WHEN 'scaled' THEN CASE WHEN value_point <= 0 THEN 'manual_review_required'
      WHEN greatest(0, value_max - value_min) / greatest(1, value_point) < 0.15 THEN 'high' WHEN greatest(0, value_max - value_min) / greatest(1, value_point) < 0.35 THEN 'medium'
      WHEN greatest(0, value_max - value_min) / greatest(1, value_point) < 0.75 THEN 'low' ELSE 'manual_review_required' END ELSE 'manual_review_required' END AS band,
    CASE kase WHEN 'i' THEN beyond OR i_band = 'manual_review_required' ELSE kase <> 'scaled' END AS needs_review,
    CASE WHEN kase = 'i' AND beyond THEN 'extrapolated_beyond_anchor_range' WHEN kase = 'none' THEN 'no_anchor_in_segment' WHEN kase = 'flat' THEN 'anchor_month_has_no_profiles' WHEN kase = 'few' THEN 'profiles_below_floor(' || profiles || '<5)' END AS suppression_reason,
    CASE WHEN kase IN ('i', 'none') THEN 1.0 ELSE factor END AS coverage_factor, CASE kase WHEN 'scaled' THEN scale ELSE 1.0 END AS ratio,
    CASE kase WHEN 'i' THEN CASE WHEN r_month IS NULL OR {ord_('month')} - {ord_('l_month')} <= {ord_('r_month')} - {ord_('month')} THEN l_month ELSE r_month END ELSE r_anchor END AS anchor_month
  FROM raw0
), hits AS (
  SELECT r.company_id, r.month, arg_min(w.reason, (w.created_at, w.id)) AS hit FROM raw r JOIN windows w ON w.company_id = r.company_id AND r.month BETWEEN w.start_month AND w.end_month GROUP BY ALL
), series AS (
  SELECT r.* REPLACE (CASE WHEN hit IS NULL THEN method ELSE 'suppressed_low_sample' END AS method, CASE WHEN hit IS NULL THEN band ELSE 'manual_review_required' END AS band,
    needs_review OR hit IS NOT NULL AS needs_review, CASE WHEN hit IS NULL THEN suppression_reason ELSE 'manual_suppress(' || hit || ')' END AS suppression_reason), hit AS suppressed_by
  FROM raw r LEFT JOIN hits USING (company_id, month)
)"""

SCORED = f"""
brk AS (
  SELECT company_id, list({ord_('segment_start')}) FILTER (WHERE segment_no > 1) AS breaks FROM segments GROUP BY ALL
), flags0 AS (
  SELECT s.*, lag(value_point) OVER (PARTITION BY s.company_id, segment_no ORDER BY month) AS prev, breaks FROM series s LEFT JOIN brk USING (company_id)
), flags AS (
  SELECT * EXCLUDE (prev), CASE WHEN value_point > 0 THEN greatest(0, value_max - value_min) / value_point > 0.75 ELSE false END AS interval_too_wide,
    coalesce(starts_with(suppression_reason, 'profiles_below_floor'), false) AS sample_floor_violation,
    coalesce(prev > 0 AND NOT coalesce(list_contains(breaks, {ord_('month')}), false) AND abs(value_point - prev) / prev > 0.3, false) AS mom_jump,
    NOT (value_min <= value_point AND value_point <= value_max) AS non_monotonic_interval, coverage_factor >= 1 / 0.15::DOUBLE - 1e-9 AS coverage_floor_hit
  FROM flags0
), proof AS (
  SELECT company_id, segment_no, max(CASE anchor_type WHEN 'manual_anchor' THEN 1.0 WHEN 'historical_statement' THEN 0.75 ELSE 0.5 END)::DOUBLE AS quality,
    list(DISTINCT {ord_('anchor_month')}) AS months, count(DISTINCT source_name) AS sources FROM placed GROUP BY ALL
), parts AS (
  SELECT f.*, coalesce(quality, 0) AS anchor_source_quality,
    CASE WHEN months IS NULL THEN 0 ELSE pow(0.5::DOUBLE, list_min(list_transform(months, lambda m: abs(m - {ord_('month')}))) / 18::DOUBLE) END AS anchor_recency,
    greatest(0, 1 - least(1, greatest(0, value_max - value_min) / greatest(1, value_point))) AS anchor_agreement,
    CASE WHEN profiles <= 0 THEN 0 ELSE least(1, profiles / greatest(1, 5::DOUBLE / {coverage("datediff('month', month, " + AS_OF + ")")})) END AS sample_coverage,
    CASE WHEN coalesce(len(breaks), 0) = 0 THEN 1 ELSE 1 - exp(-list_min(list_transform(breaks, lambda m: abs(m - {ord_('month')}))) / 6::DOUBLE) END AS event_proximity,
    CASE WHEN sources >= 2 THEN 1.0 WHEN sources = 1 THEN 0.4 ELSE 0.0 END AS multi_source_corroboration
  FROM flags f LEFT JOIN proof USING (company_id, segment_no)
), score0 AS (
  SELECT *, greatest(0, least(1, 0.25::DOUBLE * anchor_source_quality + 0.2::DOUBLE * anchor_recency + 0.2::DOUBLE * anchor_agreement + 0.15::DOUBLE * sample_coverage + 0.1::DOUBLE * event_proximity + 0.1::DOUBLE * multi_source_corroboration)) AS score FROM parts
), score1 AS (
  SELECT *, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.55 THEN 'medium' WHEN score >= 0.3 THEN 'low' ELSE 'manual_review_required' END AS b0 FROM score0
), scored AS (
  SELECT * EXCLUDE (b0), CASE WHEN method = 'suppressed_low_sample' THEN 'manual_review_required' WHEN method = 'degraded_current_only' AND b0 IN ('high', 'medium') THEN 'low'
    WHEN method = 'interpolated_multi_anchor' AND needs_review AND b0 IN ('high', 'medium') THEN 'low' WHEN method = 'interpolated_multi_anchor' AND b0 = 'high' THEN 'medium' ELSE b0 END AS score_band
  FROM score1
), stored AS (
  SELECT company_id, segment_no, month, value_min, value_point, value_max, profiles, method, score, score_band AS band,
    needs_review OR interval_too_wide OR sample_floor_violation OR mom_jump OR non_monotonic_interval OR coverage_floor_hit OR score_band = 'manual_review_required' AS needs_review
  FROM scored
)"""

GROWTH = """
usable AS (
  SELECT * FROM stored WHERE method NOT IN ('suppressed_low_sample', 'degraded_current_only') AND value_point > 0
), growth AS (
  SELECT e.company_id, e.month, s.month AS prev_month, h.label AS horizon, e.value_min / greatest(s.value_max, 1e-9) - 1 AS growth_min, e.value_point / s.value_point - 1 AS growth_point,
    e.value_max / greatest(s.value_min, 1e-9) - 1 AS growth_max, e.value_point - s.value_point AS delta
  FROM usable e, (VALUES (6, '6m'), (12, '1y'), (24, '2y')) AS h(n, label), usable s
  WHERE s.company_id = e.company_id AND (s.month + to_months(h.n))::DATE = e.month
), last_month AS (
  SELECT company_id, max(month) AS month FROM stored GROUP BY ALL
), latest AS (
  SELECT growth.* FROM growth SEMI JOIN last_month USING (company_id, month)
)"""

CHAIN = (BASE, SPINE, SEGMENTS, RECONCILED, SERIES, SCORED, GROWTH)


_ROUND = re.compile(r"round\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*), 4\)")


def near(expression: str) -> str:
    """Four digits, with ties far from where exact results fall; as `queries.near`."""
    return f"(floor(({expression}) * 10000::DOUBLE + 0.50001::DOUBLE) / 10000::DOUBLE)"


def sql(select: str, upto: int = len(CHAIN), *more: str, dates: tuple[str, ...] = ()) -> str:
    """A query over the first `upto` groups of CTEs and any more; `dates` come out as ISO text."""
    body = "WITH " + ",\n".join(x.strip() for x in (*CHAIN[:upto], *more)) + "\n" + _ROUND.sub(lambda m: near(m[1]), select)
    if not dates:
        return body
    return "SELECT * REPLACE (" + ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates) + f") FROM ({body})"
