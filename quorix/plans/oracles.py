"""SQL that gives the rows of the registered queries, from the tables alone."""

from __future__ import annotations

from quorix.functions.features import DIMS, MCC_RISK, STORED

ORACLES: dict[str, str] = {}

_REQ = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
kinds AS (SELECT event_type, floor(avg(value) * 1000e0 + 0.5e0) / 100e0 AS merch_avg FROM ev GROUP BY event_type),
wi AS (SELECT ev.*, lag(sec) OVER o AS prev_sec, lag(event_type) OVER o AS prev_type,
    floor(avg(value) OVER (PARTITION BY user_id) * 1000e0 + 0.5e0) / 100e0 AS cust_avg,
    CAST(count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS INTEGER) AS tx
  FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY sec, event_id)),
req AS (SELECT event_id AS request_id, wi.event_type, value, value * 10e0 AS amount, k % 12 + 1 AS installments, sec, prev_sec, cust_avg, tx, prev_type, merch_avg,
    CASE wi.event_type WHEN 'purchase' THEN '5411' WHEN 'view' THEN '5812' WHEN 'click' THEN '5944' WHEN 'error' THEN '7801' ELSE '0000' END AS mcc,
    k % 2 = 0 AS online, k % 3 = 0 AS card, NOT coalesce(prev_type = wi.event_type, false) AS unknown,
    CAST(event_id * 7919 % 1000 AS DOUBLE) AS km_home, prev_sec IS NOT NULL AND k % 7 <> 0 AS has_last, CAST(event_id * 104729 % 1000 AS DOUBLE) AS last_km,
    (event_id * 31 + k) % 100 < 35 AS fraud
  FROM wi JOIN kinds ON wi.event_type = kinds.event_type)"""

_RISK = "CASE mcc " + " ".join(f"WHEN '{c}' THEN {r}e0" for c, r in MCC_RISK.items()) + " ELSE 0.5e0 END"
_CLAMP = "least(1e0, greatest(0e0, {}))"
_V = [
    _CLAMP.format("amount / 10000e0"), _CLAMP.format("installments / 12e0"), _CLAMP.format("amount / (CASE WHEN cust_avg <> 0 THEN cust_avg ELSE 1e-9 END) / 10e0"),
    "(sec % 86400 // 3600) / 23e0", "((sec // 86400 + 3) % 7) / 6e0",
    "CASE WHEN has_last THEN " + _CLAMP.format("(sec - prev_sec) / 60e0 / 1440e0") + " ELSE -1e0 END", "CASE WHEN has_last THEN " + _CLAMP.format("last_km / 1000e0") + " ELSE -1e0 END",
    _CLAMP.format("km_home / 1000e0"), _CLAMP.format("tx / 20e0"), "CAST(CAST(online AS INTEGER) AS DOUBLE)", "CAST(CAST(card AS INTEGER) AS DOUBLE)", "CAST(CAST(unknown AS INTEGER) AS DOUBLE)",
    _RISK, _CLAMP.format("merch_avg / 10000e0"),
]
_Q = [f"CAST(round(({v}) * 10000e0) AS INTEGER) AS q{i}" for i, v in enumerate(_V)]
_BUCKET = "CAST(online AS INTEGER) + 2 * CAST(card AS INTEGER) + 4 * CAST(unknown AS INTEGER) + 8 * CAST(has_last AS INTEGER)"
_E = [f"CAST(greatest(-127, least(127, round(q{i} * 127e0 / 10000e0))) AS INTEGER) AS e{i}" for i in STORED]
_VEC = _REQ + f""",
vec0 AS (SELECT request_id AS ref_id, fraud, {_BUCKET} AS bucket, {', '.join(_Q)} FROM req),
vec AS (SELECT *, {', '.join(_E)} FROM vec0),
qs AS (SELECT * FROM vec WHERE ref_id % 20 = 0)"""
_STORED_Q = ", ".join(f"q{i}" for i in STORED)


def _distance(prefix: str, dims, a: str = "q", b: str = "r") -> str:
    return "CAST(" + " + ".join(f"CAST({a}.{prefix}{i} - {b}.{prefix}{i} AS BIGINT) * ({a}.{prefix}{i} - {b}.{prefix}{i})" for i in dims) + " AS BIGINT)"


def _top(name: str, source: str, k: int, order: str = "d, ref_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT * EXCLUDE (rn0), CAST(rn0 AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rn0 FROM {source})) WHERE rn <= {k})"


def _vote(source: str, queries: str = "qs") -> str:
    return f"""SELECT ref_id AS query_id, frauds, found, frauds < 3 AS approved, frauds / 5e0 AS score FROM (
  SELECT qs.ref_id, CAST(coalesce(sum(CAST(n.fraud AS INTEGER)), 0) AS BIGINT) AS frauds, count(n.ref_id) AS found
  FROM {queries} qs LEFT JOIN {source} n ON n.query_id = qs.ref_id GROUP BY qs.ref_id)"""


_FULL = _VEC + f""",
pf AS (SELECT q.ref_id AS query_id, r.ref_id, r.fraud, {_distance('q', DIMS)} AS d FROM qs q JOIN vec r ON r.ref_id <> q.ref_id),
{_top('nf', 'pf', 5)}"""
_SAME = _VEC + f""",
pb AS (SELECT q.ref_id AS query_id, r.ref_id, r.fraud, {_distance('q', STORED)} AS d FROM qs q JOIN vec r ON r.bucket = q.bucket AND r.ref_id <> q.ref_id),
{_top('nb', 'pb', 5)}"""


def _coarse(k: int) -> str:
    return _VEC + f""",
pc AS (SELECT q.ref_id AS query_id, r.ref_id, r.fraud, {_distance('e', STORED)} AS d, {_distance('q', STORED)} AS d2 FROM qs q JOIN vec r ON r.bucket = q.bucket AND r.ref_id <> q.ref_id),
{_top('nc', 'pc', k)},
{_top('nr', '(SELECT * EXCLUDE (rn) FROM nc)', 5, 'd2, ref_id')}"""


_SIZES = _VEC + """,
sizes AS (SELECT bucket, cnt, greatest(1, least(cnt, (cnt + 37) // 75)) AS clusters FROM (SELECT bucket, count(*) AS cnt FROM vec GROUP BY bucket))"""
_SEEDS = _SIZES + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ref_id) - 1 AS rk FROM vec),
slots AS (SELECT bucket, cnt, clusters, unnest(range(clusters)) AS cluster_id FROM sizes),
seeds AS (SELECT s.bucket, s.cluster_id, r.ref_id, {', '.join(f'r.q{i}' for i in STORED)} FROM slots s JOIN ranked r ON r.bucket = s.bucket AND r.rk = s.cluster_id * s.cnt // s.clusters)"""


def _assigned(name: str, centres: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q.*, r.cluster_id, row_number() OVER (PARTITION BY q.ref_id ORDER BY {_distance('q', STORED)}, r.cluster_id) AS rn
  FROM vec q JOIN {centres} r ON r.bucket = q.bucket) WHERE rn = 1)"""


_MEANS = _SEEDS + f""",
{_assigned('a1', 'seeds')},
means AS (SELECT bucket, cluster_id, count(*) AS n_points, {', '.join(f'CAST(round(CAST(sum(q{i}) AS DOUBLE) / count(*)) AS INTEGER) AS q{i}' for i in STORED)} FROM a1 GROUP BY bucket, cluster_id)"""
_CENTRES = _MEANS + f""",
cents0 AS (SELECT s.bucket, s.cluster_id, coalesce(m.n_points, 0) AS n_points, {', '.join(f'coalesce(m.q{i}, s.q{i}) AS q{i}' for i in STORED)} FROM seeds s LEFT JOIN means m ON m.bucket = s.bucket AND m.cluster_id = s.cluster_id),
cents AS (SELECT *, {', '.join(_E)} FROM cents0)"""
_INDEX = _CENTRES + f""",
{_assigned('pts0', 'cents')},
pts AS (SELECT * EXCLUDE (rn) FROM pts0),
pp AS (SELECT q.ref_id AS query_id, r.bucket, r.cluster_id AS ref_id, {_distance('e', STORED)} AS d FROM qs q JOIN cents r ON r.bucket = q.bucket),
{_top('probe_all', 'pp', 192)}"""


def _clusters(name: str, nprobe: int, queries: str) -> str:
    return f"""p_{name} AS (SELECT q.ref_id AS query_id, r.ref_id, r.fraud, {_distance('e', STORED)} AS d, {_distance('q', STORED)} AS d2
  FROM {queries} q JOIN probe_all p ON p.query_id = q.ref_id AND p.rn <= {nprobe} JOIN pts r ON r.bucket = p.bucket AND r.cluster_id = p.ref_id AND r.ref_id <> q.ref_id),
{_top('s_' + name, 'p_' + name, 16)},
{_top('n_' + name, f'(SELECT * EXCLUDE (rn) FROM s_{name})', 5, 'd2, ref_id')}"""


_IVF = _INDEX + ",\n" + _clusters("six", 6, "qs")
_ISO = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_EXTREME = """bucket IN (13, 14) AND has_last AND merch_avg <= 90 AND mcc IN ('7801', '7802', '7995') AND installments BETWEEN 6 AND 10
  AND amount BETWEEN 2000 AND 5000 AND cust_avg BETWEEN 110 AND 300 AND tx BETWEEN 8 AND 15 AND km_home BETWEEN 180 AND 500 AND last_km BETWEEN 180 AND 600"""
_JUDGED = _SAME + f""",
votes AS ({_vote('nb')}),
judged AS (SELECT NOT qs.fraud AS expected, v.approved, v.query_id % 97 = 0 AS failed FROM votes v JOIN qs ON qs.ref_id = v.query_id),
conf AS (SELECT count(*) FILTER (NOT failed AND NOT expected AND NOT approved) AS tp, count(*) FILTER (NOT failed AND expected AND approved) AS tn,
  count(*) FILTER (NOT failed AND expected AND NOT approved) AS fp, count(*) FILTER (NOT failed AND NOT expected AND approved) AS fn, count(*) FILTER (failed) AS err FROM judged),
wei AS (SELECT *, tp + tn + fp + fn + err AS n, fp + fn + err AS failures, fp + 3 * fn + 5 * err AS e FROM conf),
wgt AS (SELECT *, CASE WHEN n > 0 THEN e / CAST(n AS DOUBLE) ELSE 0e0 END AS epsilon, round(CASE WHEN n > 0 THEN failures / CAST(n AS DOUBLE) ELSE 0e0 END * 1000000e0) / 1000000e0 AS failure_rate FROM wei),
det AS (SELECT CASE WHEN n > 0 AND failures / CAST(n AS DOUBLE) > 0.15e0 THEN -3000e0 ELSE 1000e0 * log10(1e0 / greatest(epsilon, 0.001e0)) - 300e0 * log10(1e0 + e) END AS x FROM wgt)"""
_LAT = """
lat AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS rn, count(*) OVER () AS n FROM events)"""
_P99 = _LAT + """,
p99 AS (SELECT min(x) FILTER (rn = CAST(floor(n * 0.99e0) AS BIGINT)) AS p99 FROM lat),
ps AS (SELECT p99, CASE WHEN p99 <= 0 THEN 0e0 WHEN p99 > 2000e0 THEN -3000e0 ELSE 1000e0 * log10(1000e0 / greatest(p99, 1e0)) END AS x FROM p99)"""


def _six(x: str) -> str:
    return f"round(({x}) * 1000000e0) / 1000000e0"


def _add(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes.strip()}\n{select}" if ctes else select


_add("feature_vector_q14", _VEC, f"SELECT ref_id AS request_id, bucket, {', '.join(f'q{i}' for i in DIMS)} FROM vec")
_add("feature_double_round4", _REQ, f"SELECT request_id, {', '.join(f'round(({v}) * 10000e0) / 10000e0 AS v{i}' for i, v in enumerate(_V))} FROM req")
_add("bucket_key", _VEC, "SELECT ref_id AS request_id, bucket FROM vec")
_add("bucket_key_from_vector", _VEC, "SELECT ref_id AS request_id, CAST(q9 = 10000 AS INTEGER) + 2 * CAST(q10 = 10000 AS INTEGER) + 4 * CAST(q11 = 10000 AS INTEGER) + 8 * CAST(q5 <> -10000 AS INTEGER) AS bucket FROM vec")
_add("bucket_counts_offsets", _VEC, "SELECT bucket, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT bucket, count(*) AS cnt FROM vec GROUP BY bucket)")
_EMB = "emb0 AS (SELECT vec_id AS ref_id, label, " + ", ".join(f"CAST(round(CAST(embedding[{i + 1}] AS DOUBLE) * 10000e0) AS INTEGER) AS q{i}" for i in range(64)) + """ FROM embeddings),
emb AS (SELECT *, CAST(q0 >= 0 AS INTEGER) + 2 * CAST(q1 >= 0 AS INTEGER) + 4 * CAST(q2 >= 0 AS INTEGER) + 8 * CAST(q3 >= 0 AS INTEGER) AS bucket FROM emb0)"""
_add("quantize_int16", _EMB, f"SELECT ref_id, bucket, {', '.join(f'q{i}' for i in range(64))} FROM emb")
_add("quantize_int8", _EMB, f"SELECT ref_id, {', '.join(f'CAST(greatest(-127, least(127, round(q{i} * 127e0 / 10000e0))) AS INTEGER) AS e{i}' for i in range(64))} FROM emb")
_add("knn_embeddings", _EMB + f""",
pe AS (SELECT q.ref_id AS query_id, r.ref_id, {_distance('q', range(64))} AS d FROM emb q JOIN emb r ON r.ref_id <> q.ref_id WHERE q.ref_id % 20 = 0),
{_top('ne', 'pe', 5)}""", "SELECT query_id, ref_id, d, rn FROM ne")
_add("mcc_risk_lookup", _REQ, f"SELECT request_id, mcc, {_RISK} AS risk FROM req")
_add("timestamp_parts", _REQ, "SELECT request_id, CAST(sec % 86400 // 3600 AS INTEGER) AS hour, CAST((sec // 86400 + 3) % 7 AS INTEGER) AS weekday, sec AS epoch FROM req")
_add("minutes_since_last", _REQ, "SELECT request_id, (sec - prev_sec) / 60e0 AS minutes FROM req")
_add("timestamp_fallback", _REQ, "SELECT request_id, 0 AS hour, 3 AS weekday, (sec - prev_sec) / 60e0 AS minutes FROM req")
_add("unknown_merchant", _REQ, "SELECT request_id, unknown AS unknown_merchant FROM req")
_add("unknown_merchant_anti_join", _REQ, "SELECT request_id FROM req WHERE unknown")
_add("parse_payload", _REQ, f"""SELECT request_id, false AS malformed, amount, installments, {_ISO.format('sec')} AS requested_at, cust_avg, tx AS tx_count_24h, online AS is_online, card AS card_present,
  unknown AS unknown_merchant, km_home, mcc, merch_avg, has_last, CASE WHEN has_last THEN {_ISO.format('prev_sec')} ELSE '' END AS last_ts, CASE WHEN has_last THEN last_km ELSE 0e0 END AS last_km FROM req""")
_add("parse_malformed_failopen", "", "SELECT event_id AS request_id, 0 AS frauds, true AS approved, 0e0 AS score FROM events WHERE event_id % 5 IN (1, 2, 3)")
_add("knn_full_exact", _FULL, _vote("nf"))
_add("knn_bucket_exact", _SAME, _vote("nb"))
_add("knn_neighbors", _FULL, "SELECT query_id, ref_id, d, rn FROM nf")
_add("bucket_xor_distance", "", "SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(bit_count(xor(a, b) & 7) AS BIGINT) * 100000000 AS gap FROM range(16) x(a), range(16) y(b)")
_add("knn_coarse_shortlist", _coarse(16), "SELECT query_id, ref_id, d, rn FROM nc")
_add("knn_coarse_rerank", _coarse(16), _vote("nr"))
_add("knn_rerank_cap64", _coarse(64), _vote("nr"))
_add("cluster_sizes", _SIZES, "SELECT bucket, cnt, clusters FROM sizes")
_add("kmeans_strided_seed", _SEEDS, "SELECT bucket, cluster_id, ref_id FROM seeds")
_add("kmeans_lloyd_step", _CENTRES, f"SELECT bucket, cluster_id, n_points, {_STORED_Q} FROM cents0")
_add("centroid_mean", _MEANS, f"SELECT bucket, cluster_id, n_points, {_STORED_Q} FROM means")
_add("index_roundtrip", _INDEX, "SELECT p.*, c.clusters FROM (SELECT bucket, count(*) AS cnt, count(*) FILTER (fraud) AS frauds FROM pts GROUP BY bucket) p JOIN (SELECT bucket, count(*) AS clusters FROM cents GROUP BY bucket) c ON c.bucket = p.bucket")
_add("ivf_probe_list", _INDEX, "SELECT query_id, bucket, ref_id AS cluster_id, d, rn FROM probe_all WHERE rn <= 6")
_add("ivf_knn", _IVF, _vote("n_six"))
_add("ivf_scan_counters", _INDEX, """SELECT (SELECT count(*) FROM qs) AS queries, (SELECT CAST(count(*) AS BIGINT) FROM pp) AS centroids,
  (SELECT CAST(coalesce(sum(z.n), 0) AS BIGINT) FROM probe_all p JOIN (SELECT bucket, cluster_id, count(*) AS n FROM pts GROUP BY bucket, cluster_id) z ON z.bucket = p.bucket AND z.cluster_id = p.ref_id WHERE p.rn <= 6) AS points""")
_add("confirm_extreme", _VEC, f"SELECT v.ref_id AS request_id, coalesce({_EXTREME}, false) AS extreme FROM vec v JOIN req r ON r.request_id = v.ref_id UNION ALL SELECT -1, true UNION ALL SELECT -2, false")
_add("adaptive_policy", _IVF + f""",
v1 AS ({_vote('n_six')}),
ext AS (SELECT v.ref_id, coalesce({_EXTREME}, false) AS extreme FROM vec v JOIN req r ON r.request_id = v.ref_id),
flagged AS (SELECT qs.* FROM qs JOIN v1 ON v1.query_id = qs.ref_id JOIN ext ON ext.ref_id = qs.ref_id WHERE v1.frauds BETWEEN 1 AND 4 OR (v1.frauds = 5 AND ext.extreme)),
{_clusters('wide', 192, 'flagged')},
v2 AS ({_vote('n_wide', 'flagged')})""", "SELECT *, false AS confirmed FROM v1 WHERE query_id NOT IN (SELECT query_id FROM v2) UNION ALL SELECT *, true FROM v2")
_add("decision_reply", _SAME, f"""SELECT query_id, '{{"approved":' || CASE WHEN approved THEN 'true' ELSE 'false' END || ',"fraud_score":' ||
  CASE frauds WHEN 0 THEN '0' WHEN 1 THEN '0.2' WHEN 2 THEN '0.4' WHEN 3 THEN '0.6' WHEN 4 THEN '0.8' ELSE '1' END || '}}' AS reply FROM ({_vote('nb')})""")
_add("confusion_matrix", _JUDGED, "SELECT tp, tn, fp, fn, err FROM conf")
_add("weighted_errors", _JUDGED, "SELECT * FROM wgt")
_add("detection_score", _JUDGED, f"SELECT {_six('x')} AS detection_score FROM det")
_add("p99_score", _P99, f"SELECT p99, {_six('x')} AS p99_score FROM ps")
_add("final_score", _JUDGED + ",\n" + _P99, f"SELECT {_six(_six('det.x') + ' + ' + _six('ps.x'))} AS final_score FROM det, ps")
_add("parity_bucket_vs_full", _FULL + f""",
pb AS (SELECT q.ref_id AS query_id, r.ref_id, r.fraud, {_distance('q', STORED)} AS d FROM qs q JOIN vec r ON r.bucket = q.bucket AND r.ref_id <> q.ref_id),
{_top('nb', 'pb', 5)},
v0 AS ({_vote('nf')}), v1 AS ({_vote('nb')})""", "SELECT count(*) AS total, count(*) FILTER (v0.frauds <> v1.frauds) AS count_mismatch, count(*) FILTER (v0.approved <> v1.approved) AS approved_mismatch FROM v0 JOIN v1 ON v0.query_id = v1.query_id")
_add("recall_ivf", _IVF + f""",
pf AS (SELECT q.ref_id AS query_id, r.ref_id, r.fraud, {_distance('q', DIMS)} AS d FROM qs q JOIN vec r ON r.ref_id <> q.ref_id),
{_top('nf', 'pf', 5)}""", "SELECT count(*) AS wanted, count(n.ref_id) AS found FROM nf f LEFT JOIN n_six n ON n.query_id = f.query_id AND n.ref_id = f.ref_id")
_RANKS = ", ".join(f"min(x) FILTER (rn = CAST(floor(n * {p}e0) AS BIGINT)) AS {c}" for p, c in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (0.999, "p99_9")))
_add("latency_rank_percentiles", _LAT, f"SELECT min(n) AS n, max(x) AS max, {_RANKS} FROM lat")
_add("latency_interp_percentiles", _LAT, f"SELECT min(n) AS n, max(x) AS max, {_six('avg(x)')} AS avg, " + ", ".join(f"{_six(f'quantile_cont(x, {p})')} AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM lat")
_add("per_bucket_stats", _REQ, f"SELECT {_BUCKET} AS bucket, count(*) AS n, max(value) AS max_ms, {_six('avg(value)')} AS avg_ms FROM req GROUP BY 1")
_add("dataset_stats", _REQ, "SELECT count(*) AS total, count(*) FILTER (fraud) AS fraud_count, count(*) FILTER (NOT fraud) AS legit_count, count(*) FILTER (fraud) / CAST(count(*) AS DOUBLE) AS fraud_rate, count(*) FILTER (NOT fraud) / CAST(count(*) AS DOUBLE) AS legit_rate FROM req")
_add("topn_limit", "", "SELECT event_id AS request_id, value * 10e0 AS amount FROM events ORDER BY amount DESC, request_id LIMIT 100")
_add("round_robin_assign", "", "SELECT event_id AS request_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 2 AS INTEGER) AS backend FROM events")
_add("stream_score", _SAME, f"SELECT query_id AS request_id, false AS malformed, frauds, approved, score FROM ({_vote('nb')})")
_add("verify_policy", _FULL + f""",
pb AS (SELECT q.ref_id AS query_id, r.ref_id, r.fraud, {_distance('q', STORED)} AS d FROM qs q JOIN vec r ON r.bucket = q.bucket AND r.ref_id <> q.ref_id),
{_top('nb', 'pb', 5)},
v0 AS ({_vote('nf')}), v1 AS ({_vote('nb')}),
vp AS (SELECT qs.ref_id % 100 <> 0 AS good, qs.ref_id % 60 <> 0 AS labelled, NOT qs.fraud AS expected, v1.approved, v1.frauds, v0.frauds AS ff FROM qs JOIN v0 ON v0.query_id = qs.ref_id JOIN v1 ON v1.query_id = qs.ref_id),
vc AS (SELECT count(*) AS entries, count(*) FILTER (NOT good) AS parse_fail, count(*) FILTER (good AND labelled AND approved <> expected) AS approved_mismatch, count(*) FILTER (good AND frauds <> ff) AS full_mismatch FROM vp)""",
"SELECT entries, parse_fail, approved_mismatch, round(1e2 * approved_mismatch / entries * 1e4) / 1e4 AS approved_mismatch_pct, full_mismatch FROM vc")
ORACLES["replay_with_wrap"] = """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, count(*) OVER () AS n FROM events)
SELECT r.i AS request_no, e.event_id AS entry_id FROM range(0, (SELECT count(*) + 500 FROM events)) r(i) JOIN e ON r.i % e.n = e.place"""
ORACLES["scan_throughput"] = """WITH t AS (SELECT count(*) AS queries, sum(value) / 1e3 AS s FROM events)
SELECT queries, round(s * 1e3) / 1e3 AS seconds, round(s / queries * 1e6 * 1e3) / 1e3 AS us_per_query, round(queries / s * 1e3) / 1e3 AS per_second FROM t"""
_add("metrics_by_name", _JUDGED, "SELECT CAST(row_number() OVER (ORDER BY metric) - 1 AS INTEGER) AS place, metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT tp, tn, fp, fn, err FROM conf) ON tp, tn, fp, fn, err INTO NAME metric VALUE value)")
_add("result_report", _JUDGED, """SELECT '{"err":' || err || ',"fn":' || fn || ',"fp":' || fp || ',"tn":' || tn || ',"tp":' || tp || '}' AS result FROM conf""")
ORACLES["stream_score_index"] = f"SELECT query_id AS request_id, false AS malformed, frauds, approved, score FROM ({ORACLES['adaptive_policy']})"
