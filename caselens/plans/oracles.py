"""DuckDB SQL over the star-schema tables for the queries of the catalogue."""

from __future__ import annotations

from .catalogue import FAST, UNIFORM
from .projection import LEFT_OUT, STRAINED_ASSET, STRAINED_DAY

_BASE = """
WITH RECURSIVE cs AS (
  SELECT c_mktsegment AS cse_id, CAST(o_orderkey AS VARCHAR) AS case_id, o_orderdate AS opened, o_orderstatus AS status,
    'AN-' || c_nationkey AS analyst, 'Q-' || n_regionkey AS queue,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ln AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag, l_linestatus) AS k,
    CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'REASSIGN' WHEN 'RO' THEN 'INVESTIGATE' WHEN 'NO' THEN 'ENRICH' WHEN 'NF' THEN 'ESCALATE' WHEN 'AF' THEN 'EVIDENCE_COLLECT' WHEN 'AO' THEN 'CLOSE' END AS type
  FROM lineitem),
ev AS (
  SELECT cse_id, case_id, type || '::' || case_id || '::' || k AS event_id, type, l_shipdate AS ts, 'AN-' || s_nationkey AS actor, l_discount >= 0.05 AS shift, l_partkey
  FROM ln JOIN cs ON CAST(l_orderkey AS VARCHAR) = case_id JOIN supplier ON l_suppkey = s_suppkey WHERE type IS NOT NULL),
asset_of AS (SELECT cse_id, case_id, min(l_partkey) AS p FROM ev GROUP BY ALL),
assets AS (
  SELECT DISTINCT cse_id, 'AS-' || p AS asset_id, CASE WHEN p_size <= 12 THEN 'LOW' WHEN p_size <= 25 THEN 'MEDIUM' WHEN p_size <= 38 THEN 'HIGH' ELSE 'CRITICAL' END AS criticality
  FROM asset_of JOIN part ON p = p_partkey),
analysts AS (SELECT cse_id, analyst FROM cs UNION SELECT cse_id, actor FROM ev WHERE type IN ('REASSIGN', 'INVESTIGATE')),
ctx AS (SELECT cse_id, case_id, severity AS alert_severity, criticality AS asset_criticality FROM cs JOIN asset_of USING (cse_id, case_id) JOIN assets USING (cse_id) WHERE asset_id = 'AS-' || p),
loops AS (
  SELECT cse_id, case_id, count(*) AS n_reassign, count(DISTINCT actor) AS n_analysts, bool_and(shift) AS justified,
    count(*) > count(DISTINCT actor) AND count(DISTINCT actor) <= 2 AS is_loop,
    count(*) > count(DISTINCT actor) AND count(DISTINCT actor) <= 2 AND NOT bool_and(shift) AS flagged
  FROM ev WHERE type = 'REASSIGN' GROUP BY ALL HAVING count(*) >= 3),
resp AS (
  SELECT cse_id, case_id, CASE WHEN answered IS NULL THEN 'never' ELSE 'late' END AS detail, m AS measure FROM (
    SELECT cse_id, case_id, min(ts) FILTER (type = 'ESCALATE') AS answered, (epoch_us(min(ts) FILTER (type = 'ESCALATE')) - epoch_us(min(ts))) / 6e7 AS m
    FROM ev SEMI JOIN (SELECT cse_id, case_id FROM ctx WHERE alert_severity = 'CRITICAL' AND asset_criticality IN ('HIGH', 'CRITICAL')) x USING (cse_id, case_id) GROUP BY ALL)
  WHERE answered IS NULL OR NOT m <= 30),
prec AS (
  SELECT cse_id, case_id, event_id FROM (SELECT *, min(ts) FILTER (type = 'ENRICH') OVER (PARTITION BY cse_id, case_id) AS f FROM ev)
  WHERE type = 'INVESTIGATE' AND (f IS NULL OR f > ts)),
closed AS (
  SELECT cse_id, case_id, (epoch_us(max(ts) FILTER (type = 'CLOSE')) - epoch_us(min(ts))) / 6e7 AS minutes FROM ev GROUP BY ALL HAVING count(*) FILTER (type = 'CLOSE') > 0),
recur AS (
  SELECT cse_id, 'AS-' || p AS asset_id, count(*) AS n_alerts, count(*) AS n_cases, bool_or(deep) AS remediated FROM asset_of
  JOIN (SELECT cse_id, case_id, bool_or(type IN ('INVESTIGATE', 'EVIDENCE_COLLECT')) AS deep FROM ev GROUP BY ALL) USING (cse_id, case_id) GROUP BY ALL),
alerts_of AS (SELECT cse_id, asset_id, criticality, coalesce(n_alerts, 0) AS n_alerts FROM assets LEFT JOIN recur USING (cse_id, asset_id)),
took AS (
  SELECT cse_id, actor, (epoch_us(c) - epoch_us(ts)) / 6e7 AS m FROM ev JOIN (SELECT cse_id, case_id, max(ts) AS c FROM ev WHERE type = 'CLOSE' GROUP BY ALL) USING (cse_id, case_id) WHERE type = 'INVESTIGATE' AND c >= ts),
uniform AS (
  SELECT cse_id, actor AS analyst_id, count(*) AS n_durations, avg(m) AS mean_minutes, CASE WHEN count(*) >= 5 AND avg(m) > 0 THEN stddev_samp(m) / avg(m) END AS cov FROM took GROUP BY ALL),
work AS (
  SELECT cse_id, analyst AS analyst_id, coalesce(n_assigned, 0) AS n_assigned, coalesce(n_investigated, 0) AS n_investigated FROM analysts
  LEFT JOIN (SELECT cse_id, analyst, count(*) AS n_assigned FROM cs GROUP BY ALL) USING (cse_id, analyst)
  LEFT JOIN (SELECT cse_id, actor AS analyst, count(*) AS n_investigated FROM ev WHERE type = 'INVESTIGATE' GROUP BY ALL) USING (cse_id, analyst)),
queues AS (
  SELECT cse_id, queue AS queue_id, count(*) AS n_routed, CAST(coalesce(sum(u), 0) AS BIGINT) AS n_escalated FROM cs
  LEFT JOIN (SELECT cse_id, case_id, count(*) AS u FROM ev WHERE type = 'ESCALATE' GROUP BY ALL) USING (cse_id, case_id) GROUP BY ALL)
"""


def _peers(obs: str, keys: str) -> str:
    """CTEs peer_obs, peer_pool and peers over a query with keys, group_id, exposure, observed."""
    return f""",
peer_obs AS ({obs}),
peer_pool AS (
  SELECT {keys}, count(*) FILTER (exposure > 0) AS n, sum(observed) FILTER (exposure > 0) AS o, sum(exposure) FILTER (exposure > 0) AS e,
    avg(observed / exposure) FILTER (exposure > 0) AS m, coalesce(var_samp(observed / exposure) FILTER (exposure > 0), 0) AS v FROM peer_obs GROUP BY ALL),
peer_fit AS (
  SELECT {keys}, group_id, exposure, observed, n < 2 OR coalesce(o, 0) <= 0 AS fails, o, e,
    CASE WHEN exposure >= 10 THEN o / e WHEN v <= 0 THEN m ELSE (m / v * m + observed) / (m / v + exposure) END AS rate
  FROM peer_obs JOIN peer_pool USING ({keys})),
peers AS (
  SELECT {keys}, group_id, exposure, observed, CASE WHEN fails THEN 'INSUFFICIENT_EVIDENCE' WHEN exposure = 0 THEN 'INSUFFICIENT_EXPOSURE' END AS abstain,
    CASE WHEN fails THEN NULL WHEN exposure = 0 THEN 0 ELSE rate * exposure END AS expected,
    CASE WHEN NOT fails THEN o / e / exp(1.959963984540054 / sqrt(o)) * exposure END AS ci_low, CASE WHEN NOT fails THEN o / e * exp(1.959963984540054 / sqrt(o)) * exposure END AS ci_high,
    CASE WHEN NOT fails AND exposure > 0 AND rate > 0 THEN (observed - rate * exposure) / sqrt(rate * exposure) END AS z FROM peer_fit)
"""


def _show(keys: str) -> str:
    return f"SELECT {keys}, group_id, exposure, observed, abstain, round(expected, 6) AS expected, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(z, 6) AS z, coalesce(z <= -2, false) AS flagged FROM peers"


_PACE = f"SELECT cse_id, severity AS group_id, count(*) AS exposure, count(*) FILTER (NOT minutes < {{fast}}) AS observed FROM closed JOIN cs USING (cse_id, case_id) GROUP BY ALL"
_TELEMETRY = "SELECT cse_id, criticality AS tier, asset_id AS group_id, 1 AS exposure, n_alerts AS observed FROM alerts_of WHERE criticality IN ('HIGH', 'CRITICAL')"
_ANALYST = "SELECT cse_id, analyst_id AS group_id, n_assigned AS exposure, n_investigated AS observed FROM work"
_QUEUE = "SELECT cse_id, queue_id AS group_id, n_routed AS exposure, n_escalated AS observed FROM queues"


def _named(sql: str, name: str) -> str:
    """Peer CTEs under names of their own, as a query may need several."""
    for part in ("peer_obs", "peer_pool", "peer_fit", "peers"):
        sql = sql.replace(part, f"{part}_{name}")
    return sql


_CONCERNS = (
    _BASE
    + _named(_peers(_PACE.format(fast=30.0), "cse_id"), "pace")
    + _named(_peers(_TELEMETRY, "cse_id, tier"), "tele")
    + _named(_peers(_ANALYST, "cse_id"), "people")
    + _named(_peers(_QUEUE, "cse_id"), "queue")
    + """,
hits AS (
  SELECT cse_id, 'REASSIGNMENT_LOOP' AS finding_type, case_id AS primary_id, 'Operational Discipline' AS capability, 'EXPECTED' AS authority, 'REASSIGN' AS et FROM loops WHERE flagged
  UNION ALL SELECT cse_id, 'ESCALATION_SLA_VIOLATION', case_id, 'Escalation', 'MANDATORY', 'ESCALATE' FROM resp
  UNION ALL SELECT DISTINCT cse_id, 'MISSING_ENRICHMENT', case_id, 'Investigation', 'EXPECTED', 'INVESTIGATE' FROM prec
  UNION ALL SELECT cse_id, 'FAST_CLOSE_OUTLIER', case_id, 'Investigation', 'PEER_NORMAL', 'CLOSE' FROM closed JOIN cs USING (cse_id, case_id) JOIN peers_pace USING (cse_id) WHERE group_id = severity AND z <= -2 AND minutes < 30
  UNION ALL SELECT cse_id, 'REPEATED_ALERT_NO_REMEDIATION', asset_id, 'Incident Response', 'PEER_NORMAL', NULL FROM recur WHERE n_alerts >= 3 AND NOT remediated
  UNION ALL SELECT cse_id, 'LOW_TELEMETRY_CRITICAL_ASSET', group_id, 'Threat Detection', 'PEER_NORMAL', NULL FROM peers_tele WHERE z <= -2
  UNION ALL SELECT cse_id, 'REPETITIVE_INVESTIGATION_PATTERN', analyst_id, 'Investigation', 'PEER_NORMAL', NULL FROM uniform WHERE cov < 0.15
  UNION ALL SELECT cse_id, 'INVESTIGATION_WORKLOAD_INCONSISTENT', group_id, 'Investigation', 'PEER_NORMAL', NULL FROM peers_people WHERE abstain IS NULL AND abs(z) >= 2
  UNION ALL SELECT cse_id, 'ESCALATION_WORKLOAD_INCONSISTENT', group_id, 'Escalation', 'PEER_NORMAL', NULL FROM peers_queue WHERE abstain IS NULL AND abs(z) >= 2),
con AS (
  SELECT cse_id, finding_type, primary_id, capability, authority, coalesce(n, 0) AS n_events,
    CASE capability WHEN 'Escalation' THEN 1.0 WHEN 'Investigation' THEN 0.8 WHEN 'Operational Discipline' THEN 0.5 ELSE 0.9 END * CASE authority WHEN 'MANDATORY' THEN 1.0 WHEN 'EXPECTED' THEN 0.7 ELSE 0.5 END AS concern_score,
    (20 + 2 * coalesce(n, 0)) * CASE authority WHEN 'MANDATORY' THEN 1.5 WHEN 'EXPECTED' THEN 1.2 ELSE 1.0 END AS minutes
  FROM hits LEFT JOIN (SELECT cse_id, case_id AS primary_id, type AS et, count(*) AS n FROM ev GROUP BY ALL) USING (cse_id, primary_id, et))
"""
)
_CORE_OBS = """SELECT finding_type, cse_id AS group_id, n_cases AS exposure, n_cases - coalesce(f, 0) AS observed
  FROM (SELECT cse_id, count(*) AS n_cases FROM cs GROUP BY ALL) CROSS JOIN (SELECT unnest(['REASSIGNMENT_LOOP', 'ESCALATION_SLA_VIOLATION', 'MISSING_ENRICHMENT']) AS finding_type)
  LEFT JOIN (SELECT cse_id, finding_type, count(DISTINCT primary_id) AS f FROM con GROUP BY ALL) USING (cse_id, finding_type)"""
_CORE = _CONCERNS + _peers(_CORE_OBS, "finding_type")
_OUTCOME = _BASE + ", oc AS (SELECT cse_id, case_id, CASE WHEN CAST(split_part(analyst, '-', 2) AS INT) % 2 = 0 THEN 1 ELSE 0 END AS t, CASE WHEN flagged THEN 0 ELSE 1 END AS y FROM cs LEFT JOIN (SELECT cse_id, case_id, flagged FROM loops WHERE flagged) USING (cse_id, case_id))"
_OLS = _OUTCOME + """, g AS (SELECT cse_id, count(*) AS n, regr_sxx(y, t) AS sxx, regr_sxy(y, t) AS sxy, regr_syy(y, t) AS syy, count(DISTINCT t) AS nt, count(DISTINCT y) AS ny FROM oc GROUP BY ALL),
en AS (SELECT *, n >= 6 AND nt > 1 AND ny > 1 AS sufficient FROM g),
ols AS (SELECT cse_id, n, sufficient, CASE WHEN sufficient THEN sxy / sxx END AS effect, CASE WHEN sufficient THEN sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2) / sxx) END AS se, CASE WHEN sufficient THEN n - 2 END AS df FROM en)"""
_VERDICTS = _CONCERNS + """, judged AS (
  SELECT *, capability || '|' || finding_type AS bucket, CASE WHEN d % 5 = 0 THEN 'FALSE_POSITIVE' WHEN d % 5 = 1 THEN 'INCONCLUSIVE' WHEN d % 5 = 2 THEN 'OUT_OF_SCOPE' ELSE 'TRUE_SUPERVISORY_FINDING' END AS verdict,
    CASE WHEN d % 2 = 0 THEN 'risk_selected' ELSE 'random_calibration' END AS sample FROM (SELECT *, CAST(regexp_extract(primary_id, '(\\d+)$', 1) AS BIGINT) AS d FROM con)),
post AS (SELECT bucket, sample, 1 + count(*) FILTER (verdict = 'TRUE_SUPERVISORY_FINDING') AS alpha, 1 + count(*) FILTER (verdict IN ('FALSE_POSITIVE', 'OUT_OF_SCOPE')) AS beta, count(*) FILTER (verdict = 'INCONCLUSIVE') AS n_logged FROM judged GROUP BY ALL)"""
_DAILY = "WITH RECURSIVE daily AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n_events, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL), num AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM daily)"


def _cusum(col: str, name: str, k: float, h: float) -> str:
    return f""", st_{name} AS (SELECT avg({col}) AS m, CASE WHEN stddev_pop({col}) = 0 THEN 1 ELSE stddev_pop({col}) END AS s FROM num),
z_{name} AS (SELECT i, ({col} - m) / s AS z FROM num, st_{name}),
c_{name} AS (
  SELECT CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS lo, false AS up, false AS down
  UNION ALL SELECT i, CASE WHEN a > {h} THEN 0 ELSE a END, CASE WHEN b < -{h} THEN 0 ELSE b END, a > {h}, b < -{h}
  FROM (SELECT z.i, greatest(0, c.hi + z.z - {k}) AS a, least(0, c.lo + z.z + {k}) AS b FROM c_{name} c JOIN z_{name} z ON z.i = c.i + 1))"""


_CUSUM = _DAILY + _cusum("mean_value", "v", 0.25, 1.0) + _cusum("n_events", "e", 0.25, 1.0)

_REFS = """, refs AS (
  SELECT cse_id, finding_type, primary_id, 'object' AS kind, primary_id AS ref_id FROM con
  UNION ALL SELECT cse_id, finding_type, primary_id, 'case', primary_id FROM hits WHERE et IS NOT NULL
  UNION ALL SELECT cse_id, finding_type, primary_id, 'event', event_id FROM hits JOIN (SELECT cse_id, case_id AS primary_id, type AS et, event_id FROM ev) USING (cse_id, primary_id, et)
  UNION ALL SELECT cse_id, finding_type, primary_id, 'case', case_id FROM con JOIN asset_of USING (cse_id) WHERE finding_type = 'REPEATED_ALERT_NO_REMEDIATION' AND primary_id = 'AS-' || p
  UNION ALL SELECT cse_id, finding_type, primary_id, 'case', case_id FROM con JOIN cs USING (cse_id) WHERE finding_type = 'INVESTIGATION_WORKLOAD_INCONSISTENT' AND primary_id = analyst
  UNION ALL SELECT cse_id, finding_type, primary_id, 'case', case_id FROM con JOIN cs USING (cse_id) SEMI JOIN (SELECT cse_id, case_id FROM ev WHERE type = 'ESCALATE') x USING (cse_id, case_id) WHERE finding_type = 'ESCALATION_WORKLOAD_INCONSISTENT' AND primary_id = queue)
SELECT * FROM refs"""


def _strain(sql: str) -> str:
    """The same query over the strained log: its lines, its thresholds, and two reassignments as too many."""
    sql = sql.replace("l_shipdate AS ts, 'AN-' || s_nationkey AS actor, l_discount >= 0.05 AS shift, l_partkey", f"CAST(opened AS TIMESTAMP) + to_seconds(date_diff('day', CAST(opened AS DATE), CAST(l_shipdate AS DATE)) * {STRAINED_DAY}) AS ts, 'AN-' || s_nationkey AS actor, l_discount >= 0.05 AS shift, {STRAINED_ASSET} AS l_partkey")
    sql = sql.replace("WHERE type IS NOT NULL),", f"WHERE type IS NOT NULL AND NOT ({LEFT_OUT})),").replace("cov < 0.15", f"cov < {UNIFORM}")
    return sql.replace("hits AS (\n", """hits AS (
  SELECT cse_id, 'EXCESSIVE_REASSIGNMENT_CARDINALITY' AS finding_type, case_id AS primary_id, 'Operational Discipline' AS capability, 'OPTIONAL' AS authority, 'REASSIGN' AS et FROM ev WHERE type = 'REASSIGN' GROUP BY ALL HAVING count(*) = 2 UNION ALL
""").replace("WHEN 'EXPECTED' THEN 0.7 ELSE 0.5 END AS concern_score", "WHEN 'EXPECTED' THEN 0.7 WHEN 'OPTIONAL' THEN 0.3 ELSE 0.5 END AS concern_score").replace("WHEN 'EXPECTED' THEN 1.2 ELSE 1.0 END AS minutes", "WHEN 'EXPECTED' THEN 1.2 WHEN 'OPTIONAL' THEN 0.8 ELSE 1.0 END AS minutes")


_MISSED = "(SELECT DISTINCT cse_id, case_id, true AS flagged FROM prec)"

SQL: dict[str, str] = {
    "evidence": _CONCERNS + _REFS,
    "case_events": _BASE + "SELECT cse_id, case_id, event_id, type, ts AS time FROM ev",
    "case_context": _BASE + "SELECT * FROM ctx",
    "case_trace": _BASE
    + """, rel AS (SELECT cse_id, event_id, type, ts, case_id AS object_id, CASE WHEN type = 'REASSIGN' THEN 'reassigned_to->' || actor WHEN type = 'INVESTIGATE' THEN 'investigated_by->' || actor ELSE '' END AS others FROM ev
      UNION ALL SELECT cse_id, event_id, type, ts, actor, CASE WHEN type = 'REASSIGN' THEN 'reassignment_for_case->' ELSE 'investigate_for_case->' END || case_id FROM ev WHERE type IN ('REASSIGN', 'INVESTIGATE'))
    SELECT cse_id, object_id, event_id, type, ts AS time, others FROM rel""",
    "attr_snapshot": _BASE
    + """SELECT cse_id, case_id AS object_id, NULL AS severity, NULL AS criticality, status, NULL AS tier FROM cs UNION ALL SELECT cse_id, 'AL-' || case_id, severity, NULL, NULL, NULL FROM cs
    UNION ALL SELECT cse_id, asset_id, NULL, criticality, NULL, NULL FROM assets UNION ALL SELECT cse_id, analyst, NULL, NULL, NULL, CASE WHEN CAST(split_part(analyst, '-', 2) AS INT) % 2 = 0 THEN 'SENIOR' ELSE 'JUNIOR' END FROM analysts""",
    "rule_response": _BASE + "SELECT 'ESC-CRIT-001' AS rule_id, cse_id, case_id, 'Escalation' AS capability, 'MANDATORY' AS authority, detail, round(measure, 6) AS measure FROM resp",
    "rule_precedence": _BASE + "SELECT 'ENR-PREC-001' AS rule_id, cse_id, case_id, 'Investigation' AS capability, 'EXPECTED' AS authority, event_id AS detail FROM prec",
    "rule_cardinality": _BASE + "SELECT 'REASSIGN-CARD-001' AS rule_id, cse_id, case_id, 'Operational Discipline' AS capability, 'OPTIONAL' AS authority, 'count' AS detail, CAST(count(*) AS DOUBLE) AS measure FROM ev WHERE type = 'REASSIGN' GROUP BY ALL HAVING count(*) > 2",
    "rule_not_coexist": _BASE + "SELECT DISTINCT 'COEX-001' AS rule_id, a.cse_id, a.case_id, 'Operational Discipline' AS capability, 'OPTIONAL' AS authority, 'both' AS detail FROM ev a JOIN ev b USING (cse_id, case_id) WHERE a.type = 'ESCALATE' AND b.type = 'EVIDENCE_COLLECT'",
    "reassignment_loops": _BASE + "SELECT cse_id, case_id, n_reassign, n_analysts, is_loop, justified, flagged FROM loops",
    "fast_close": _BASE + f"SELECT cse_id, case_id, round(minutes, 6) AS minutes, minutes < {FAST} AS is_fast FROM closed",
    "asset_recurrence": _BASE + "SELECT *, n_alerts >= 3 AND NOT remediated AS flagged FROM recur",
    "asset_telemetry": _BASE + "SELECT * FROM alerts_of",
    "investigation_uniformity": _BASE + f"SELECT cse_id, analyst_id, n_durations, round(mean_minutes, 6) AS mean_minutes, round(cov, 6) AS cov, coalesce(cov < {UNIFORM}, false) AS flagged FROM uniform",
    "analyst_workload": _BASE + "SELECT * FROM work",
    "queue_escalation": _BASE + "SELECT * FROM queues",
    "negspace_severity": _BASE + _peers(_PACE.format(fast=FAST), "cse_id") + _show("cse_id"),
    "negspace_telemetry": _BASE + _peers(_TELEMETRY, "cse_id, tier") + _show("cse_id, tier"),
    "negspace_analyst": _BASE + _peers(_ANALYST, "cse_id") + _show("cse_id"),
    "negspace_queue": _BASE + _peers(_QUEUE, "cse_id") + _show("cse_id"),
    "ewma_daily": _DAILY + ", e AS (SELECT i, day, mean_value AS ewma FROM num WHERE i = 0 UNION ALL SELECT n.i, n.day, 0.3 * n.mean_value + 0.7 * e.ewma FROM e JOIN num n ON n.i = e.i + 1) SELECT CAST(day AS VARCHAR) AS day, round(ewma, 6) AS ewma FROM e",
    "cusum_daily": _CUSUM + "SELECT CAST(i AS INT) AS at, 'up' AS side FROM c_v WHERE up UNION ALL SELECT CAST(i AS INT), 'down' FROM c_v WHERE down",
    "displacement_daily": _CUSUM + "SELECT CAST(v.i AS INT) AS at, CASE WHEN EXISTS (SELECT 1 FROM c_e e WHERE e.up AND abs(e.i - v.i) <= 1) THEN 'POTENTIAL_DISPLACEMENT' ELSE 'POTENTIAL_EXECUTION_GAP' END AS signal FROM c_v v WHERE v.down",
    "concerns": _CONCERNS + "SELECT cse_id, finding_type, primary_id, capability, authority, n_events, round(CAST(concern_score AS DOUBLE), 6) AS concern_score, round(CAST(minutes AS DOUBLE), 6) AS minutes FROM con",
    "suppressed": _BASE + "SELECT cse_id, case_id, 'EXCESSIVE_REASSIGNMENT_CARDINALITY' AS finding_type, CASE WHEN flagged THEN 'flagged as a loop' WHEN is_loop THEN 'every handover is a shift change' ELSE 'no analyst comes back' END AS reason FROM loops UNION ALL SELECT cse_id, case_id, 'REASSIGNMENT_LOOP', 'every handover is a shift change' FROM loops WHERE is_loop AND justified",
    "concern_costs": _CONCERNS + "SELECT cse_id, finding_type, count(*) AS n, round(CAST(sum(minutes) AS DOUBLE), 6) AS minutes, CAST(sum(n_events) AS BIGINT) AS n_events FROM con GROUP BY ALL",
    "concerns_by_capability": _CONCERNS + "SELECT cse_id, capability, count(*) AS n, round(CAST(sum(concern_score) AS DOUBLE), 6) AS score FROM con GROUP BY ALL",
    "topk_concerns": _CONCERNS + "SELECT * FROM (SELECT cse_id, finding_type, primary_id, round(CAST(concern_score AS DOUBLE), 6) AS concern_score, CAST(row_number() OVER (PARTITION BY cse_id ORDER BY concern_score DESC, finding_type, primary_id) AS INT) AS rank FROM con) WHERE rank <= 5",
    "interleaved_findings": _CONCERNS + """SELECT cse_id, finding_type, primary_id, turn, CAST(row_number() OVER (PARTITION BY cse_id ORDER BY turn, top DESC, capability) AS INT) AS position FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY cse_id, capability ORDER BY concern_score DESC, finding_type, primary_id) AS INT) AS turn, max(concern_score) OVER (PARTITION BY cse_id, capability) AS top FROM con)""",
    "findings_search": _CONCERNS + "SELECT cse_id, finding_type, primary_id FROM con WHERE cse_id = 'BUILDING' AND lower(cse_id || ' ' || finding_type || ' ' || primary_id || ' ' || capability || ' ' || authority) LIKE '%loop%'",
    "page": _CONCERNS + "SELECT cse_id, finding_type, primary_id FROM con ORDER BY concern_score DESC, cse_id, finding_type, primary_id LIMIT 25 OFFSET 25",
    "peer_comparison": _CORE + _show("finding_type"),
    "entity_risk": _CORE + """, r AS (SELECT group_id AS cse_id, coalesce(sum(CASE WHEN z <= -2 THEN abs(z) * CASE finding_type WHEN 'REASSIGNMENT_LOOP' THEN 0.35 WHEN 'ESCALATION_SLA_VIOLATION' THEN 1.0 ELSE 0.56 END END), 0) AS risk, count(*) FILTER (z <= -2) AS n_flagged_types FROM peers GROUP BY ALL)
      SELECT cse_id, round(risk, 6) AS risk, n_flagged_types, CASE WHEN risk < 0.7 THEN 'LOW' WHEN risk < 1.5 THEN 'MEDIUM' ELSE 'CRITICAL' END AS tier FROM r""",
    "trend_classification": _BASE + """, cy AS (SELECT cse_id, CAST(year(opened) AS INT) AS year, count(*) AS exposure, count(*) FILTER (flagged IS NULL) AS observed FROM cs LEFT JOIN (SELECT * FROM loops WHERE flagged) USING (cse_id, case_id) GROUP BY ALL),
    lg AS (SELECT *, coalesce(lag(exposure) OVER w, 0) AS prior_exposure, coalesce(lag(observed) OVER w, 0) AS prior_observed, row_number() OVER (PARTITION BY cse_id ORDER BY year DESC) AS rn FROM cy WINDOW w AS (PARTITION BY cse_id ORDER BY year)),
    zz AS (SELECT *, CASE WHEN prior_exposure >= 10 AND exposure >= 10 AND observed + prior_observed > 0 THEN (observed - exposure * (observed + prior_observed) / (exposure + prior_exposure)) / sqrt(exposure * (observed + prior_observed) / (exposure + prior_exposure)) END AS z FROM lg WHERE rn = 1)
    SELECT cse_id, year, exposure, observed, prior_exposure, prior_observed, round(z, 6) AS z, CASE WHEN z IS NULL OR abs(z) < 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN z < 0 THEN 'REGRESSED' ELSE 'VERIFIED_IMPROVEMENT' END AS trend FROM zz""",
    "causal_outcome": _OUTCOME + "SELECT cse_id, case_id, t, y FROM oc",
    "ols_effect": _OLS + "SELECT cse_id, n, sufficient, round(effect, 6) AS effect, round(se, 6) AS se, df, round(effect / nullif(se, 0), 6) AS t_stat FROM ols",
    "robustness_decision": _OLS + """, f AS (SELECT *, abs(effect / se) / sqrt(df) AS f FROM ols), rv AS (SELECT *, 2 * f * f / (sqrt(pow(f, 4) + 4 * f * f) + f * f) AS robustness FROM f)
      SELECT cse_id, round(robustness, 6) AS robustness, CASE WHEN (effect - 1.96 * se > 0 OR effect + 1.96 * se < 0) AND robustness >= 0.3 THEN 'ACT' ELSE 'INVESTIGATE_MORE' END AS decision FROM rv""",
    "beta_feedback": _VERDICTS + "SELECT *, round(alpha / (alpha + beta), 6) AS mean FROM post",
    "debiased_rates": _VERDICTS + """, p AS (SELECT bucket, max(alpha / (alpha + beta)) FILTER (sample = 'random_calibration') AS c, max(alpha + beta - 2) FILTER (sample = 'random_calibration') AS n, max(alpha / (alpha + beta)) FILTER (sample = 'risk_selected') AS r FROM post GROUP BY ALL)
      SELECT bucket, round(CASE WHEN n >= 5 THEN c ELSE coalesce(r, 0.5) END, 6) AS rate, CASE WHEN n >= 5 THEN 'random_calibration' ELSE 'risk_selected' END AS source FROM p""",
    "agreement_grouping_sets": _VERDICTS + "SELECT finding_type, authority, count(*) AS n_verdicts, count(*) FILTER (verdict = 'TRUE_SUPERVISORY_FINDING') AS n_confirmed, round(count(*) FILTER (verdict = 'TRUE_SUPERVISORY_FINDING') / count(*), 6) AS rate FROM judged GROUP BY GROUPING SETS ((finding_type), (authority), ())",
    "quality_orphans": "SELECT CAST(user_id AS VARCHAR) AS case_id, event_id FROM events ANTI JOIN (SELECT c_custkey * 2 AS user_id FROM customer) USING (user_id)",
    "unrecognised_events": "SELECT DISTINCT event_type AS event, CAST(user_id AS VARCHAR) AS case_id FROM events",
    "recognised_events": "SELECT CASE l_returnflag WHEN 'R' THEN 'REASSIGN' WHEN 'A' THEN 'CLOSE' END AS type, CAST(month(l_shipdate) AS INT) AS month, count(*) AS n FROM lineitem GROUP BY ALL",
    "standin_objects": "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS asset_id FROM lineitem ANTI JOIN (SELECT p_partkey AS l_partkey FROM part WHERE p_size <= 25) USING (l_partkey)",
    "portfolio_totals": _CORE + """SELECT (SELECT count(*) FROM con) AS n_findings, (SELECT count(DISTINCT group_id) FROM peers) AS n_entities,
      (SELECT count(*) FROM (SELECT group_id, sum(CASE WHEN z <= -2 THEN abs(z) * CASE finding_type WHEN 'REASSIGNMENT_LOOP' THEN 0.35 WHEN 'ESCALATION_SLA_VIOLATION' THEN 1.0 ELSE 0.56 END ELSE 0 END) AS r FROM peers GROUP BY ALL) WHERE r >= 1.5) AS n_high,
      (SELECT count(*) * 2 FROM cs) + (SELECT count(*) FROM assets) + (SELECT count(*) FROM analysts) + (SELECT count(*) FROM (SELECT DISTINCT cse_id, queue FROM cs)) AS n_objects, (SELECT count(*) FROM ev) AS n_events""",
}

SQL |= {
    "strained_concerns": _strain(SQL["concerns"]),
    "strained_evidence": _strain(SQL["evidence"]),
    "strained_risk": _strain(SQL["entity_risk"]),
    "strained_trend": _strain(SQL["trend_classification"].replace("(SELECT * FROM loops WHERE flagged)", _MISSED)),
    "strained_decision": _strain(_OLS.replace("(SELECT cse_id, case_id, flagged FROM loops WHERE flagged)", _MISSED))
    + """, f AS (SELECT *, abs(effect / se) / sqrt(df) AS f FROM ols), rv AS (SELECT *, 2 * f * f / (sqrt(pow(f, 4) + 4 * f * f) + f * f) AS robustness, 1.959963984540054 + 2.3722712358 / df + 2.8225 / (df * df) AS q FROM f)
      SELECT cse_id, n, round(effect, 6) AS effect, round(se, 6) AS se, round(robustness, 6) AS robustness, CASE WHEN (effect - q * se > 0 OR effect + q * se < 0) AND robustness >= 0.3 THEN 'ACT' ELSE 'INVESTIGATE_MORE' END AS decision FROM rv""",
}

SQL |= {
    "log_validation": _BASE
    + """, n AS (SELECT unnest(['event without id, type or time', 'object without id or type', 'duplicate event id', 'duplicate object id', 'duplicate attribute change', 'event edge without qualifier', 'object edge without qualifier', 'event edge to no object', 'object edge to no object', 'attribute of no object']) AS "check",
      unnest([(SELECT count(*) FROM ev WHERE event_id IS NULL OR event_id = '' OR type IS NULL OR ts IS NULL), (SELECT count(*) FROM cs WHERE case_id IS NULL OR case_id = ''),
        (SELECT count(*) FROM (SELECT 1 FROM ev GROUP BY cse_id, event_id HAVING count(*) > 1)), (SELECT count(*) FROM (SELECT 1 FROM (SELECT cse_id, case_id AS o FROM cs UNION ALL SELECT cse_id, 'AL-' || case_id FROM cs UNION ALL SELECT cse_id, asset_id FROM assets UNION ALL SELECT cse_id, analyst FROM analysts UNION ALL SELECT DISTINCT cse_id, queue FROM cs) GROUP BY cse_id, o HAVING count(*) > 1)),
        (SELECT count(*) FROM (SELECT 1 FROM cs GROUP BY cse_id, case_id HAVING count(*) > 1)), 0, 0, (SELECT count(*) FROM ev ANTI JOIN cs USING (cse_id, case_id)) + (SELECT count(*) FROM (SELECT cse_id, actor AS analyst FROM ev WHERE type IN ('REASSIGN', 'INVESTIGATE')) ANTI JOIN analysts USING (cse_id, analyst)),
        (SELECT count(*) FROM (SELECT cse_id, 'AS-' || p AS asset_id FROM asset_of) ANTI JOIN assets USING (cse_id, asset_id)) + (SELECT count(*) FROM cs ANTI JOIN analysts USING (cse_id, analyst)), 0]) AS n) SELECT * FROM n""",
    "baseline_top_score": _CONCERNS
    + """, cls AS (SELECT *, row_number() OVER (PARTITION BY cse_id ORDER BY score DESC, cost, bucket) AS i FROM (
        SELECT cse_id, finding_type, capability || '|' || finding_type AS bucket, CAST(minutes AS DOUBLE) AS cost, CAST(concern_score AS DOUBLE) AS score, count(*) AS n FROM con GROUP BY ALL)),
    fill AS (
      SELECT cse_id, CAST(0 AS BIGINT) AS i, 0.3 * sum(CAST(minutes AS DOUBLE)) AS spare, CAST(0 AS BIGINT) AS k FROM con GROUP BY cse_id
      UNION ALL SELECT f.cse_id, c.i, spare - least(n, floor((spare + 1e-9) / cost)) * cost, CAST(least(n, floor((spare + 1e-9) / cost)) AS BIGINT) FROM fill f JOIN cls c ON c.cse_id = f.cse_id AND c.i = f.i + 1)
    SELECT cse_id, finding_type, CAST(sum(k) AS BIGINT) AS n FROM fill JOIN cls USING (cse_id, i) GROUP BY ALL HAVING sum(k) > 0""",
    "intervention_report": _CONCERNS
    + """, kind AS (SELECT DISTINCT cse_id, finding_type FROM con WHERE finding_type IN ('REASSIGNMENT_LOOP', 'ESCALATION_SLA_VIOLATION', 'MISSING_ENRICHMENT', 'EXCESSIVE_REASSIGNMENT_CARDINALITY')),
    oc AS (SELECT cse_id, finding_type, CASE WHEN CAST(split_part(analyst, '-', 2) AS INT) % 2 = 0 THEN 1 ELSE 0 END AS t, CASE WHEN f THEN 0 ELSE 1 END AS y
      FROM cs JOIN kind USING (cse_id) LEFT JOIN (SELECT cse_id, finding_type, primary_id AS case_id, true AS f FROM con) USING (cse_id, finding_type, case_id)),
    g AS (SELECT cse_id, finding_type, count(*) AS n, regr_sxx(y, t) AS sxx, regr_sxy(y, t) AS sxy, regr_syy(y, t) AS syy, count(DISTINCT t) AS nt, count(DISTINCT y) AS ny FROM oc GROUP BY ALL),
    en AS (SELECT *, n >= 6 AND nt > 1 AND ny > 1 AS sufficient FROM g),
    ols AS (SELECT cse_id, finding_type, n, sufficient, CASE WHEN sufficient THEN sxy / sxx END AS effect, CASE WHEN sufficient THEN sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2) / sxx) END AS se, CASE WHEN sufficient THEN n - 2 END AS df FROM en),
    f AS (SELECT *, effect / nullif(se, 0) AS t_stat, abs(effect / nullif(se, 0)) / sqrt(df) AS f, 1.959963984540054 + 2.3722712358 / df + 2.8225 / (df * df) AS q FROM ols),
    rv AS (SELECT *, effect - q * se AS ci_low, effect + q * se AS ci_high, CASE WHEN f = 0 THEN 0 ELSE 2 * f * f / (sqrt(pow(f, 4) + 4 * f * f) + f * f) END AS robustness FROM f)
    SELECT cse_id, finding_type, n, sufficient, round(effect, 6) AS effect, round(se, 6) AS se, df, round(t_stat, 6) AS t_stat, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(robustness, 6) AS robustness,
      CASE WHEN sufficient THEN CASE WHEN (ci_low > 0 OR ci_high < 0) AND robustness >= 0.3 THEN 'ACT' ELSE 'INVESTIGATE_MORE' END END AS decision, 'preliminary' AS level FROM rv""",
}

SQL |= {
    "raw_objects": _BASE + "SELECT DISTINCT cse_id, asset_id AS object_id, 'Asset' AS type, criticality, p_type AS asset_type FROM assets JOIN part ON asset_id = 'AS-' || p_partkey",
    "raw_events": _BASE + "SELECT cse_id, event_id, type, ts AS time, 'investigate_for_case->' || case_id || ', investigated_by->' || actor AS relationships FROM ev WHERE type = 'INVESTIGATE'",
    "weekly_rates": _BASE
    + """, pr AS (SELECT cse_id, case_id, min(ts) FILTER (type = 'INVESTIGATE') AS a, min(ts) FILTER (type = 'ESCALATE') AS e, bool_or(type = 'ENRICH') AS enriched FROM ev GROUP BY ALL),
    wk AS (SELECT *, CAST(floor((epoch_us(a) - min(epoch_us(a)) OVER (PARTITION BY cse_id)) / 6e7 / 10080) AS INT) AS week, coalesce((epoch_us(e) - epoch_us(a)) / 6e7 <= 43200, false) AS soon FROM pr WHERE a IS NOT NULL),
    dy AS (SELECT wk.*, d.case_id IS NOT NULL AS due FROM wk LEFT JOIN (SELECT DISTINCT cse_id, case_id FROM ctx WHERE alert_severity = 'CRITICAL' AND asset_criticality IN ('HIGH', 'CRITICAL')) d ON wk.cse_id = d.cse_id AND wk.case_id = d.case_id)
    SELECT cse_id, week, round(coalesce(count(*) FILTER (due AND soon) / nullif(count(*) FILTER (due), 0), 0), 6) AS in_time, round(avg(CASE WHEN enriched THEN 1.0 ELSE 0.0 END), 6) AS enriched FROM dy GROUP BY ALL""",
}

SQL |= {
    # Rounds over finding types, by id within a type; a round starts only if the one before it took something.
    "baseline_stratified": _CONCERNS
    + """, ranks AS (SELECT cse_id, finding_type, primary_id, CAST(minutes AS DOUBLE) AS m, row_number() OVER (PARTITION BY cse_id, finding_type ORDER BY sha256(cse_id || '|' || finding_type || '|' || primary_id)) AS r FROM con),
    o AS (SELECT *, row_number() OVER (PARTITION BY cse_id ORDER BY r, finding_type) AS i FROM ranks),
    w AS (SELECT cse_id, CAST(0 AS BIGINT) AS i, 0.3 * sum(m) AS spare, CAST(0 AS BIGINT) AS r, true AS took, false AS hit FROM o GROUP BY cse_id
      UNION ALL SELECT w.cse_id, o.i, CASE WHEN m <= spare THEN spare - m ELSE spare END, o.r, m <= spare OR (o.r = w.r AND took), m <= spare FROM w JOIN o ON o.cse_id = w.cse_id AND o.i = w.i + 1 WHERE o.r = w.r OR took)
    SELECT cse_id, finding_type, primary_id FROM w JOIN o USING (cse_id, i) WHERE hit""",
    "drift_events": """WITH RECURSIVE s AS (SELECT event_type, event_id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS sd FROM events WHERE value IS NOT NULL),
    z AS (SELECT *, (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS d FROM s),
    e AS (SELECT event_type, CAST(-1 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS ewma, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo FROM z GROUP BY event_type
      UNION ALL SELECT e.event_type, z.i, coalesce(0.3 * x + 0.7 * ewma, x), greatest(0, CASE WHEN hi > 3 THEN 0 ELSE hi END + d - 0.25), least(0, CASE WHEN lo < -3 THEN 0 ELSE lo END + d + 0.25) FROM e JOIN z ON z.event_type = e.event_type AND z.i = e.i + 1)
    SELECT event_type, event_id, i AS "at", round(ewma, 6) AS ewma, hi > 3 AS up, lo < -3 AS down FROM e JOIN z USING (event_type, i)""",
}

SQL |= {
    "rule_book": _BASE
    + """, op AS (SELECT cse_id, case_id, min(ts) AS o, min(ts) FILTER (type = 'ESCALATE') AS a, count(*) FILTER (type = 'REASSIGN') AS n, bool_or(type = 'ESCALATE') AND bool_or(type = 'EVIDENCE_COLLECT') AS two FROM ev GROUP BY ALL),
    due AS (SELECT *, (epoch_us(a) - epoch_us(o)) / 6e7 AS m, o < TIMESTAMP '1998-01-01' AS old FROM op SEMI JOIN (SELECT cse_id, case_id FROM ctx WHERE alert_severity = 'CRITICAL' AND asset_criticality IN ('HIGH', 'CRITICAL')) x USING (cse_id, case_id))
    SELECT 'ESC-CRIT-001' AS rule_id, CASE WHEN old THEN '1.0' ELSE '2.0' END AS version, cse_id, case_id, 'Escalation' AS capability, 'MANDATORY' AS authority, CASE WHEN a IS NULL THEN 'never' ELSE 'late' END AS detail, round(m, 6) AS measure FROM due WHERE a IS NULL OR m > CASE WHEN old THEN 43200 ELSE 86400 END
    UNION ALL SELECT 'ENR-PREC-001', '1.0', cse_id, case_id, 'Investigation', 'EXPECTED', event_id, NULL FROM prec
    UNION ALL SELECT 'REASSIGN-CARD-001', '1.0', cse_id, case_id, 'Operational Discipline', 'OPTIONAL', 'count', n FROM op WHERE n > 2 AND o < TIMESTAMP '2000-06-15'
    UNION ALL SELECT 'COEX-001', '1.0', cse_id, case_id, 'Operational Discipline', 'OPTIONAL', 'both', NULL FROM op WHERE two""",
    # The inverse of the three columns' centred products, written out.
    "ols_adjusted": _OUTCOME
    + """, x AS (SELECT cse_id, t, y, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 1 ELSE 0 END AS u, year(opened) AS v FROM oc JOIN cs USING (cse_id, case_id)),
    s AS (SELECT cse_id, count(*) AS n, count(*) * var_pop(t) AS a, count(*) * covar_pop(t, u) AS b, count(*) * covar_pop(t, v) AS c, count(*) * var_pop(u) AS d, count(*) * covar_pop(u, v) AS e, count(*) * var_pop(v) AS f,
      count(*) * covar_pop(t, y) AS p, count(*) * covar_pop(u, y) AS q, count(*) * covar_pop(v, y) AS r, count(*) * var_pop(y) AS yy FROM x GROUP BY ALL),
    i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s),
    w AS (SELECT *, ((d * f - e * e) * p + (c * e - b * f) * q + (b * e - c * d) * r) / det AS b1, ((c * e - b * f) * p + (a * f - c * c) * q + (b * c - a * e) * r) / det AS b2, ((b * e - c * d) * p + (b * c - a * e) * q + (a * d - b * b) * r) / det AS b3 FROM i),
    o AS (SELECT *, sqrt((yy - b1 * p - b2 * q - b3 * r) / (n - 4) * (d * f - e * e) / det) AS se FROM w)
    SELECT cse_id, n, true AS sufficient, round(b1, 6) AS effect, round(se, 6) AS se, n - 4 AS df, round(b1 / se, 6) AS t_stat FROM o""",
}

SQL |= {
    "page_by_key": SQL["page"],
    "indexed_search": SQL["findings_search"].replace("cse_id = 'BUILDING' AND ", "").replace("'%loop%'", "'%escalation\\_sla%' ESCAPE '\\'"),
}
