"""Each registered query in plain SQL, written against the benchmark tables.

The SQL follows the textbook form of the rules (a second pass for the MAD, one
statement per metric), not the plans of the library.
"""

from __future__ import annotations

FLOWS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
risky AS (
  SELECT *,
    CASE WHEN k % 20 < 10 THEN
      (CAST(1 AS BIGINT) << ([5, 6, 9, 24, 29, 43, 46, 50, 51, 55])[k % 20 + 1])
      | (CASE WHEN k % 4 = 0 THEN CAST(32 AS BIGINT) WHEN k % 3 = 0 THEN CAST(536870912 AS BIGINT)
              WHEN k % 7 = 0 THEN CAST(2251799813685248 AS BIGINT) ELSE CAST(0 AS BIGINT) END)
    ELSE CAST(0 AS BIGINT) END AS risk,
    CASE WHEN k = 13 THEN CAST(0 AS BIGINT) WHEN k = 17 THEN 3405803776 + user_id % 256
         ELSE 167772160 + user_id END AS src
  FROM ev
),
flows AS (
  SELECT event_id AS flow_id, ts AS first_seen, src,
    CASE WHEN k % 5 = 0 THEN 3232235776 + k WHEN k % 25 = 1 THEN 2886991872 + k
         ELSE 134744072 + k END AS dst,
    CAST(floor(value * 1048576) AS BIGINT) AS bytes,
    CASE WHEN event_type = 'error' THEN 0 ELSE 5 END AS answers,
    risk, k % 37 = 0 AS srv_bl, k % 41 = 0 AS cli_bl, risk <> 0 AS alerted,
    concat(src >> 24, '.', (src >> 16) & 255, '.', (src >> 8) & 255, '.', src & 255) AS src_ip, k,
    CASE WHEN k = 13 THEN 'fd00::' || user_id
         ELSE concat(src >> 24, '.', (src >> 16) & 255, '.', (src >> 8) & 255, '.', src & 255) END AS cli_ip,
    1000 + k AS srv_port,
    CASE WHEN k % 40 = 0 THEN '{}' ELSE '{"alerts":{"30":{"proto.ndpi":"'
         || (['TLS', 'SSH', 'HTTP', 'IRC'])[(k // 4) % 4 + 1] || '"}}}' END AS json
  FROM risky
),
host_alerts AS (
  SELECT CASE WHEN k = 17 THEN '203.0.113.' || (user_id % 256)
              ELSE concat('10.', (user_id >> 16) & 255, '.', (user_id >> 8) & 255, '.', user_id & 255) END AS ip,
    ts AS tstamp,
    CASE WHEN event_type = 'signup' THEN 15 ELSE 29 END AS alert_id,
    CASE WHEN event_type = 'signup' THEN
      CASE WHEN k % 11 = 0 THEN '{}' WHEN k % 3 = 0 THEN concat('{"alerts":[', k % 5, ',', k % 7, ']}')
           ELSE concat('{"alerts":[', k % 5, ']}') END
    ELSE CASE WHEN k % 13 = 0 THEN '{"port":"n/a"}' ELSE concat('{"port":', k, '}') END END AS json
  FROM ev WHERE event_type IN ('signup', 'view')
)"""

LAN = ("({0} // 65536 = 49320 OR {0} // 16777216 = 10 OR {0} // 1048576 = 2753 OR {0} // 65536 = 37664)")
EXTERNAL = ("NOT ({0} // 65536 IN (49320, 37664, 43518) OR {0} // 16777216 IN (10, 127) "
            "OR {0} // 1048576 = 2753)")
LAN_TEXT = (r"regexp_matches({0}, '^(192\.168|10\.[0-9]+|172\.(1[6-9]|2[0-9]|3[01])|147\.32)"
            r"\.[0-9]+\.[0-9]+$')")
FAILED = ("(answers = 0 OR (risk >> 43) & 1 = 1 OR (risk >> 46) & 1 = 1 OR (risk >> 50) & 1 = 1 "
          "OR (risk >> 51) & 1 = 1 OR (risk >> 55) & 1 = 1)")
CATEGORY = ("CASE WHEN isodow({0}) IN (6, 7) THEN 'weekend' WHEN hour({0}) BETWEEN 9 AND 17 "
            "THEN 'feriale_lavorativo' ELSE 'feriale_fuoriorario' END")
CAUSES = {"dst2src_zero": "answers = 0", "error_code": "(risk >> 43) & 1 = 1",
          "unidirectional": "(risk >> 46) & 1 = 1", "tcp_issues": "(risk >> 50) & 1 = 1",
          "unresolved": "(risk >> 51) & 1 = 1", "probing": "(risk >> 55) & 1 = 1"}
CAUSE_TEXT = {
    "dst2src_zero": "SERVER MAI HA RISPOSTO (timeout)",
    "error_code": "ERRORE PROTOCOLLO (NXDOMAIN/HTTP 4xx-5xx)",
    "unidirectional": "TRAFFICO UNIDIREZIONALE",
    "tcp_issues": "TCP ISSUES (connection refused / scan)",
    "unresolved": "HOSTNAME NON RISOLTO (sospetto DGA)",
    "probing": "PROBING ATTEMPT (sondaggio silenzioso)",
}
LABEL = ("CASE {0} WHEN 0 THEN 'Incomplete Flows' WHEN 1 THEN 'RX-only (vittima)' WHEN 2 THEN 'SYN Scan' "
         "WHEN 3 THEN 'FIN Scan' WHEN 4 THEN 'RST Scan' ELSE concat('Codice sconosciuto (', {0}, ')') END")


def deterministic(ref: str, limit: int = 10, servers: int = 3, clients: int = 11) -> str:
    """M_rep .. M_scan over the day before ref; `limit` items in a list, tiers from `servers` and `clients` hits."""
    in_day = "{0} >= r.ref - INTERVAL 1440 MINUTE AND {0} < r.ref"
    return f"""
r AS (SELECT TIMESTAMP '{ref}' AS ref),
rep_counts AS (
  SELECT src_ip AS host_ip, count(*) FILTER (WHERE srv_bl) AS hits_srv, count(*) FILTER (WHERE cli_bl) AS hits_cli
  FROM flows, r WHERE {in_day.format('first_seen')} AND src <> 0 AND {LAN.format('src')} GROUP BY src_ip
),
m_rep AS (
  SELECT host_ip, hits_srv, hits_cli, hits_srv + hits_cli AS hits_totali,
    CASE WHEN hits_srv >= {servers} THEN 'COMPROMISSIONE PERSISTENTE (C2 attivo - hits ripetuti)'
         WHEN hits_srv >= 1 THEN 'CONTATTO ISOLATO a server BL (possibile beacon iniziale)'
         WHEN hits_cli >= {clients} THEN 'SCANSIONE MIRATA (target persistente)'
         ELSE 'SCANSIONE RARA (rumore di fondo Internet)' END AS scenario,
    CASE WHEN hits_srv >= {servers} THEN 50 WHEN hits_srv >= 1 THEN 30 WHEN hits_cli >= {clients} THEN 15 ELSE 5 END AS penalita
  FROM rep_counts WHERE hits_srv + hits_cli > 0
),
day_alerts AS (
  SELECT cli_ip AS host_ip, risk, srv_port, json FROM flows, r
  WHERE alerted AND {in_day.format('first_seen')} AND {LAN_TEXT.format('cli_ip')}
),
m_cert AS (
  SELECT host_ip, count(*) FILTER (WHERE (risk >> 6) & 1 = 1) AS hits_self_signed,
    count(*) FILTER (WHERE (risk >> 29) & 1 = 1) AS hits_sha1,
    count(*) FILTER (WHERE (risk >> 6) & 1 = 1) + count(*) FILTER (WHERE (risk >> 29) & 1 = 1) AS hits_totali,
    40 AS penalita
  FROM day_alerts WHERE (risk >> 6) & 1 = 1 OR (risk >> 29) & 1 = 1 GROUP BY host_ip
),
m_sni AS (
  SELECT host_ip, count(*) AS hits_missing, 50 AS penalita
  FROM day_alerts WHERE (risk >> 24) & 1 = 1 GROUP BY host_ip
),
day_host_alerts AS (
  SELECT ip AS host_ip, alert_id, json FROM host_alerts, r
  WHERE {in_day.format('tstamp')} AND {LAN_TEXT.format('ip')}
),
srv_pairs AS (
  SELECT host_ip, coalesce(TRY_CAST(json_extract_string(json, '$.port') AS INTEGER), 0) AS port, count(*) AS hits
  FROM day_host_alerts WHERE alert_id = 29 GROUP BY ALL
),
srv_top AS (SELECT *, row_number() OVER (PARTITION BY host_ip ORDER BY hits DESC, port) AS rn FROM srv_pairs),
m_srv AS (
  SELECT host_ip, CAST(sum(hits) AS BIGINT) AS hits_totali, count(*) AS porte_distinte,
    list_sort(list(port) FILTER (WHERE rn <= {limit})) AS lista_porte, 20 AS penalita
  FROM srv_top GROUP BY host_ip
),
proto_pairs AS (
  SELECT host_ip, coalesce(json_extract_string(json, '$.alerts."30"."proto.ndpi"'), '') AS proto, srv_port,
    count(*) AS hits
  FROM day_alerts WHERE (risk >> 5) & 1 = 1 GROUP BY ALL
),
proto_top AS (
  SELECT *, row_number() OVER (PARTITION BY host_ip ORDER BY hits DESC, proto, srv_port) AS rn FROM proto_pairs
),
m_proto AS (
  SELECT host_ip, CAST(sum(hits) AS BIGINT) AS hits_totali, count(*) AS combinazioni_distinte,
    list(concat(proto, ' su porta ', srv_port) ORDER BY proto, srv_port) FILTER (WHERE rn <= {limit}) AS lista_mismatch,
    25 AS penalita
  FROM proto_top GROUP BY host_ip
),
scan_rows AS (
  SELECT host_ip, coalesce(CAST(json_extract(json, '$.alerts') AS INTEGER[]), CAST([] AS INTEGER[])) AS codes
  FROM day_host_alerts WHERE alert_id = 15
),
scan_rated AS (
  SELECT *,
    CASE WHEN list_contains(codes, 1) THEN 0
         WHEN list_contains(codes, 3) OR list_contains(codes, 4) THEN 50
         WHEN list_contains(codes, 2) THEN 40 ELSE 30 END AS pen,
    CASE WHEN list_contains(codes, 1) THEN 'VITTIMA (rx_only_scan) - esclusa'
         WHEN list_contains(codes, 3) OR list_contains(codes, 4) THEN 'EVASIONE FIREWALL (FIN/RST scan)'
         WHEN list_contains(codes, 2) THEN 'SYN SCAN CLASSICO' ELSE 'INCOMPLETE FLOWS (scan base)' END AS cat
  FROM scan_rows
),
scan_codes AS (
  SELECT host_ip, code, count(*) AS hits
  FROM (SELECT host_ip, unnest(list_distinct(codes)) AS code FROM scan_rated WHERE pen > 0) GROUP BY ALL
),
scan_top AS (SELECT *, row_number() OVER (PARTITION BY host_ip ORDER BY hits DESC, code) AS rn FROM scan_codes),
scan_hosts AS (
  SELECT r.host_ip, count(*) AS hits_totali,
    coalesce((SELECT list_sort(list(code)) FROM scan_top t WHERE t.host_ip = r.host_ip AND rn <= {limit}),
             CAST([] AS INTEGER[])) AS codici_rilevati,
    arg_max(cat, pen) AS categoria_dominante, max(pen) AS penalita
  FROM scan_rated r WHERE pen > 0 GROUP BY r.host_ip
),
m_scan AS (
  SELECT host_ip, hits_totali, codici_rilevati,
    list_transform(codici_rilevati, lambda c: {LABEL.format('c')}) AS codici_descritti,
    categoria_dominante, penalita
  FROM scan_hosts
)"""


def statistical(ref: str) -> str:
    """M_vol and M_fail: current day against the four weeks before it."""
    ours = f"src <> 0 AND {LAN.format('src')} AND {EXTERNAL.format('dst')}"
    causes = ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{n}" for n, c in CAUSES.items())
    carried = ", ".join(f"n_{n}" for n in CAUSES)
    return f"""
s AS (SELECT TIMESTAMP '{ref}' AS ref),
host_hour AS (
  SELECT src, date_trunc('hour', first_seen) AS bucket, CAST(sum(bytes) AS BIGINT) AS v, count(*) AS n,
    count(*) FILTER (WHERE {FAILED}) AS nf
  FROM flows, s
  WHERE first_seen >= s.ref - INTERVAL 28 DAY AND first_seen < s.ref - INTERVAL 24 HOUR
    AND {CATEGORY.format('first_seen')} = {CATEGORY.format('s.ref')} AND {ours}
  GROUP BY src, date_trunc('hour', first_seen)
),
medians AS (
  SELECT src, count(*) AS buckets, median(v) AS v_med, median(CAST(nf AS DOUBLE) / n) AS r_med
  FROM host_hour GROUP BY src HAVING count(*) >= 3
),
base AS (
  SELECT h.src, any_value(buckets) AS buckets, any_value(v_med) AS v_med, any_value(r_med) AS r_med,
    median(abs(v - v_med)) AS v_mad, median(abs(CAST(nf AS DOUBLE) / n - r_med)) AS r_mad
  FROM host_hour h JOIN medians m ON h.src = m.src GROUP BY h.src
),
cur AS (
  SELECT src, any_value(src_ip) AS host_ip, CAST(sum(bytes) AS BIGINT) AS v_out, count(*) AS n_totali,
    count(*) FILTER (WHERE {FAILED}) AS n_falliti, {causes}
  FROM flows, s
  WHERE first_seen >= s.ref - INTERVAL 24 HOUR AND first_seen < s.ref AND {ours} GROUP BY src
),
vol_all AS (
  SELECT host_ip, v_out, v_med, v_mad, greatest(v_mad, v_med * 0.10, 1048576.0::DOUBLE) AS eff,
    (v_out - v_med) / greatest(v_mad, v_med * 0.10, 1048576.0::DOUBLE) AS z, buckets
  FROM cur JOIN base ON cur.src = base.src
),
vol_judged AS (
  SELECT host_ip, CASE WHEN v_out > 52428800 AND v_out > v_med AND z > 3 THEN 1 ELSE 0 END AS M_vol, v_out,
    CAST(trunc(v_med) AS BIGINT) AS v_mediana, CAST(trunc(v_mad) AS BIGINT) AS mad,
    CAST(trunc(eff) AS BIGINT) AS mad_eff, z AS z_modified,
    (SELECT {CATEGORY.format('ref')} FROM s) AS categoria_temporale, buckets AS bucket_baseline
  FROM vol_all
),
m_vol AS (SELECT *, 20 AS penalita FROM vol_judged WHERE M_vol = 1),
fail_all AS (
  SELECT host_ip, n_totali, n_falliti, CAST(n_falliti AS DOUBLE) / n_totali AS r, r_med, r_mad,
    greatest(r_mad, 0.05::DOUBLE) AS eff,
    (CAST(n_falliti AS DOUBLE) / n_totali - r_med) / greatest(r_mad, 0.05::DOUBLE) AS z, buckets, {carried}
  FROM cur JOIN base ON cur.src = base.src WHERE n_totali >= 3
),
fail_judged AS (
  SELECT host_ip, CASE WHEN r > 0.30::DOUBLE AND r > r_med AND z > 3 THEN 1 ELSE 0 END AS M_fail, n_totali, n_falliti,
    r AS r_corrente, r_med AS r_mediana, r_mad AS mad, eff AS mad_eff, z AS z_modified,
    buckets AS bucket_count, (SELECT {CATEGORY.format('ref')} FROM s) AS categoria_temporale, {carried}
  FROM fail_all
),
m_fail AS (SELECT *, 30 AS penalita FROM fail_judged WHERE M_fail = 1)"""


LABELS = {"M_rep": "Destination reputation", "M_cert": "TLS certificate anomalies", "M_sni": "SNI evasion",
          "M_srv": "Server port detected", "M_proto": "Non-standard port/protocol", "M_scan": "Network discovery",
          "M_vol": "Asimmetria volumetrica", "M_fail": "Connection failure rate"}
KEYS = ("M_rep", "M_cert", "M_sni", "M_srv", "M_proto", "M_scan", "M_vol", "M_fail")


def scores() -> str:
    union = " UNION ALL ".join(
        f"SELECT host_ip, {i} AS pos, '{k}' AS metrica, penalita FROM {k.lower()}" for i, k in enumerate(KEYS))
    return f"""
fired AS ({union}),
sums AS (
  SELECT host_ip, CAST(sum(penalita) AS INTEGER) AS penalita_totale, CAST(least(100, sum(penalita)) AS INTEGER) AS score,
    string_agg(metrica, ', ' ORDER BY pos) AS metriche
  FROM fired GROUP BY host_ip
),
hosts AS (
  SELECT *, CASE WHEN score >= 60 THEN 'ROSSO' WHEN score >= 30 THEN 'GIALLO' ELSE 'VERDE' END AS fascia FROM sums
),
net AS (
  SELECT coalesce(max(score), 0) AS score_max,
    CASE WHEN coalesce(max(score), 0) >= 60 THEN 'ROSSO' WHEN coalesce(max(score), 0) >= 30 THEN 'GIALLO'
         ELSE 'VERDE' END AS fascia_globale,
    count(*) FILTER (WHERE fascia = 'VERDE') AS host_verde, count(*) FILTER (WHERE fascia = 'GIALLO') AS host_giallo,
    count(*) FILTER (WHERE fascia = 'ROSSO') AS host_rosso, count(*) AS host_totali_visti
  FROM hosts
)"""


def replayed(ref: str) -> str:
    """M_vol and M_fail at every hour of the week up to ref: each instant joined with its four weeks before the last day."""
    ours = f"src <> 0 AND {LAN.format('src')} AND {EXTERNAL.format('dst')}"
    causes = ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{n}" for n, c in CAUSES.items())
    carried = ", ".join(f"n_{n}" for n in CAUSES)
    total = ", ".join(f"CAST(sum(n_{n}) AS BIGINT) AS n_{n}" for n in CAUSES)
    return f"""
refs AS (SELECT unnest(generate_series(TIMESTAMP '{ref}' - INTERVAL 7 DAY, TIMESTAMP '{ref}', INTERVAL 1 HOUR)) AS ref),
hours AS (
  SELECT src, any_value(src_ip) AS host_ip, date_trunc('hour', first_seen) AS bucket, CAST(sum(bytes) AS BIGINT) AS v,
    count(*) AS n, count(*) FILTER (WHERE {FAILED}) AS nf, {causes}
  FROM flows WHERE {ours} GROUP BY src, date_trunc('hour', first_seen)),
past AS (
  SELECT ref, src, v, CAST(nf AS DOUBLE) / n AS r FROM hours, refs
  WHERE bucket >= ref - INTERVAL 28 DAY AND bucket < ref - INTERVAL 24 HOUR
    AND {CATEGORY.format('bucket')} = {CATEGORY.format('ref')}),
middle AS (
  SELECT ref, src, count(*) AS buckets, median(v) AS v_med, median(r) AS r_med FROM past GROUP BY ALL HAVING count(*) >= 3),
base AS (
  SELECT past.ref, past.src, any_value(buckets) AS buckets, any_value(v_med) AS v_med, any_value(r_med) AS r_med,
    median(abs(v - v_med)) AS v_mad, median(abs(r - r_med)) AS r_mad
  FROM past JOIN middle m ON m.ref = past.ref AND m.src = past.src GROUP BY past.ref, past.src),
cur AS (
  SELECT ref, src, any_value(host_ip) AS host_ip, CAST(sum(v) AS BIGINT) AS v_out, CAST(sum(n) AS BIGINT) AS n_totali,
    CAST(sum(nf) AS BIGINT) AS n_falliti, {total}
  FROM hours, refs WHERE bucket >= ref - INTERVAL 24 HOUR AND bucket < ref GROUP BY ref, src),
judged AS (
  SELECT cur.ref, host_ip, v_out, n_totali, n_falliti, {carried}, buckets, v_med, v_mad, r_med, r_mad,
    {CATEGORY.format('cur.ref')} AS categoria_temporale, CAST(n_falliti AS DOUBLE) / n_totali AS r,
    greatest(v_mad, v_med * 0.10, 1048576.0::DOUBLE) AS v_eff, greatest(r_mad, 0.05::DOUBLE) AS r_eff
  FROM cur JOIN base ON base.ref = cur.ref AND base.src = cur.src)"""


def hourly_metrics() -> str:
    """M_rep .. M_scan of every hour; an hour is closed once a row that counts is two hours later than its end."""
    hour = "date_trunc('hour', {0}) + INTERVAL 1 HOUR AS ref"
    closed = "ref <= (SELECT max({1}) - INTERVAL 2 HOUR FROM {0})"
    wanted = "((risk >> 6) & 1 = 1 OR (risk >> 29) & 1 = 1 OR (risk >> 24) & 1 = 1 OR (risk >> 5) & 1 = 1)"
    return f"""
listed AS (SELECT *, {hour.format('first_seen')} FROM flows WHERE src <> 0 AND {LAN.format('src')} AND (srv_bl OR cli_bl)),
rep AS (
  SELECT ref, src_ip AS host_ip, count(*) FILTER (WHERE srv_bl) AS srv, count(*) FILTER (WHERE cli_bl) AS cli
  FROM listed WHERE {closed.format('listed', 'first_seen')} GROUP BY ALL),
risky_flows AS (
  SELECT *, {hour.format('first_seen')} FROM flows WHERE alerted AND {wanted} AND {LAN_TEXT.format('cli_ip')}),
shown AS (SELECT * FROM risky_flows WHERE {closed.format('risky_flows', 'first_seen')}),
pairs AS (
  SELECT ref, cli_ip AS host_ip, coalesce(json_extract_string(json, '$.alerts."30"."proto.ndpi"'), '') AS proto, srv_port,
    count(*) AS hits FROM shown WHERE (risk >> 5) & 1 = 1 GROUP BY ALL),
top_pairs AS (
  SELECT *, row_number() OVER (PARTITION BY ref, host_ip ORDER BY hits DESC, proto, srv_port) AS rn FROM pairs),
raised AS (
  SELECT *, {hour.format('tstamp')} FROM host_alerts WHERE alert_id IN (15, 29) AND {LAN_TEXT.format('ip')}),
heard AS (SELECT * FROM raised WHERE {closed.format('raised', 'tstamp')}),
ports AS (
  SELECT ref, ip AS host_ip, coalesce(TRY_CAST(json_extract_string(json, '$.port') AS INTEGER), 0) AS port, count(*) AS hits
  FROM heard WHERE alert_id = 29 GROUP BY ALL),
top_ports AS (SELECT *, row_number() OVER (PARTITION BY ref, host_ip ORDER BY hits DESC, port) AS rn FROM ports),
scan_alerts AS (
  SELECT ref, ip AS host_ip, coalesce(CAST(json_extract(json, '$.alerts') AS INTEGER[]), CAST([] AS INTEGER[])) AS codes
  FROM heard WHERE alert_id = 15),
rated AS (
  SELECT *, CASE WHEN list_contains(codes, 1) THEN 0 WHEN list_contains(codes, 3) OR list_contains(codes, 4) THEN 50
                 WHEN list_contains(codes, 2) THEN 40 ELSE 30 END AS pen FROM scan_alerts),
code_counts AS (
  SELECT ref, host_ip, code, count(*) AS hits
  FROM (SELECT ref, host_ip, unnest(list_distinct(codes)) AS code FROM rated WHERE pen > 0) GROUP BY ALL),
top_codes AS (SELECT *, row_number() OVER (PARTITION BY ref, host_ip ORDER BY hits DESC, code) AS rn FROM code_counts),
code_lists AS (
  SELECT ref, host_ip, array_to_string(list_sort(list(code)), '|') AS codes FROM top_codes WHERE rn <= 10 GROUP BY ALL),
worst AS (SELECT ref, host_ip, count(*) AS hits, max(pen) AS pen FROM rated WHERE pen > 0 GROUP BY ALL),
hourly AS (
  SELECT 'M_rep' AS metric, ref, host_ip, srv + cli AS hits,
    CASE WHEN srv >= 3 THEN 'COMPROMISSIONE PERSISTENTE (C2 attivo - hits ripetuti)'
         WHEN srv >= 1 THEN 'CONTATTO ISOLATO a server BL (possibile beacon iniziale)'
         WHEN cli >= 11 THEN 'SCANSIONE MIRATA (target persistente)'
         ELSE 'SCANSIONE RARA (rumore di fondo Internet)' END AS dettaglio,
    CASE WHEN srv >= 3 THEN 50 WHEN srv >= 1 THEN 30 WHEN cli >= 11 THEN 15 ELSE 5 END AS penalita FROM rep
  UNION ALL SELECT 'M_cert', ref, cli_ip, count(*) FILTER (WHERE (risk >> 6) & 1 = 1) + count(*) FILTER (WHERE (risk >> 29) & 1 = 1),
    CAST(count(*) FILTER (WHERE (risk >> 29) & 1 = 1) AS VARCHAR), 40
    FROM shown WHERE (risk >> 6) & 1 = 1 OR (risk >> 29) & 1 = 1 GROUP BY ref, cli_ip
  UNION ALL SELECT 'M_sni', ref, cli_ip, count(*), '', 50 FROM shown WHERE (risk >> 24) & 1 = 1 GROUP BY ref, cli_ip
  UNION ALL SELECT 'M_proto', ref, host_ip, CAST(sum(hits) AS BIGINT),
    array_to_string(list(concat(proto, ' su porta ', srv_port) ORDER BY proto, srv_port) FILTER (WHERE rn <= 10), '|'), 25
    FROM top_pairs GROUP BY ref, host_ip
  UNION ALL SELECT 'M_srv', ref, host_ip, CAST(sum(hits) AS BIGINT),
    array_to_string(list_sort(list(port) FILTER (WHERE rn <= 10)), '|'), 20 FROM top_ports GROUP BY ref, host_ip
  UNION ALL SELECT 'M_scan', w.ref, w.host_ip, hits, concat(
      CASE pen WHEN 50 THEN 'EVASIONE FIREWALL (FIN/RST scan)' WHEN 40 THEN 'SYN SCAN CLASSICO'
               ELSE 'INCOMPLETE FLOWS (scan base)' END, '|', coalesce(c.codes, '')), pen
    FROM worst w LEFT JOIN code_lists c ON c.ref = w.ref AND c.host_ip = w.host_ip)"""


NIGHT = "2024-01-30 00:00:00"
WORKDAY = "2024-01-29 15:00:00"
SATURDAY = "2024-01-27 15:00:00"
ODD_MINUTE = "2024-01-29 15:20:00"


def _with(*parts: str) -> str:
    return "WITH " + ",".join((FLOWS, *parts)) + "\n"


BEST = "greatest(" + ", ".join(f"n_{c}" for c in CAUSES) + ")"
CAUSE = "CASE " + " ".join(f"WHEN n_{c} = {BEST} THEN '{t}'" for c, t in CAUSE_TEXT.items()) + " END"


def _details() -> str:
    """Long-form details: one SELECT per (metric, field), in report order."""
    text = "list_transform({0}, lambda x: concat('''', x, ''''))"
    fields = {
        "M_rep": ["hits_srv", "hits_cli", "hits_totali", "scenario"],
        "M_cert": ["hits_self_signed", "hits_sha1", "hits_totali"],
        "M_sni": ["hits_missing"],
        "M_srv": ["hits_totali", "porte_distinte", ("lista_porte", "concat('[', array_to_string(lista_porte, ', '), ']')")],
        "M_proto": ["hits_totali", "combinazioni_distinte",
                    ("lista_mismatch", f"concat('[', array_to_string({text.format('lista_mismatch')}, ', '), ']')")],
        "M_scan": ["hits_totali", ("codici_rilevati", "concat('[', array_to_string(codici_rilevati, ', '), ']')"),
                   ("codici_descritti", f"concat('[', array_to_string({text.format('codici_descritti')}, ', '), ']')"),
                   "categoria_dominante"],
        "M_vol": ["v_out", "v_mediana", "mad", "mad_eff", ("z_modified", "printf('%.4f', z_modified)"),
                  "categoria_temporale", "bucket_baseline"],
        "M_fail": ["n_totali", "n_falliti", *[(f, f"printf('%.4f', {f})") for f in
                   ("r_corrente", "r_mediana", "mad", "mad_eff", "z_modified")], "bucket_count",
                   "categoria_temporale", *[(f"breakdown.{c}", f"n_{c}") for c in CAUSES],
                   ("causa_dominante", CAUSE)],
    }
    selects = []
    for order, (key, columns) in enumerate(fields.items()):
        for pos, column in enumerate(columns):
            name, expression = column if isinstance(column, tuple) else (column, column)
            selects.append(
                f"SELECT host_ip, '{key}' AS metrica, {order} AS ordine_metrica, penalita, {pos} AS posizione, '{name}' AS campo, "
                f"CAST({expression} AS VARCHAR) AS valore FROM {key.lower()}")
    return "details AS (" + " UNION ALL ".join(selects) + ")"


def oracle_sql() -> dict[str, str]:
    night = _with(deterministic(NIGHT), statistical(NIGHT))
    scored = _with(deterministic(NIGHT), statistical(NIGHT), scores())
    host_scores = "SELECT host_ip, score, fascia, metriche AS metriche_attive, penalita_totale FROM hosts"
    fail_columns = ("host_ip, M_fail, n_totali, n_falliti, r_corrente, r_mediana, mad, mad_eff, z_modified, "
                    "bucket_count, categoria_temporale, " + ", ".join(f"n_{c} AS breakdown_{c}" for c in CAUSES) + f", {CAUSE} AS causa_dominante")
    counts = " UNION ALL ".join(
        f"SELECT '{k}' AS metric, '{LABELS[k]}' AS label, true AS ok, count(*) AS n_hosts FROM {k.lower()}" for k in KEYS)
    short = _with(deterministic(NIGHT, limit=1, servers=2, clients=1), statistical(NIGHT))
    stamp = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
    items = """
            SELECT host_ip, 'M_srv' AS metric, CAST(port AS VARCHAR) AS item, hits FROM srv_pairs
            UNION ALL SELECT host_ip, 'M_proto', concat(proto, ' su porta ', srv_port), hits FROM proto_pairs
            UNION ALL SELECT host_ip, 'M_scan', CAST(code AS VARCHAR), hits FROM scan_codes"""
    novelty = _with() + f"""
            , ours AS (SELECT src_ip AS host_ip, srv_port, first_seen FROM flows
                       WHERE src <> 0 AND {LAN.format('src')}
                         AND first_seen >= TIMESTAMP '{NIGHT}' - INTERVAL 28 DAY AND first_seen < TIMESTAMP '{NIGHT}'),
            today AS (SELECT DISTINCT host_ip, srv_port FROM ours WHERE first_seen >= TIMESTAMP '{NIGHT}' - INTERVAL 24 HOUR),
            history AS (SELECT DISTINCT host_ip, srv_port FROM ours WHERE first_seen < TIMESTAMP '{NIGHT}' - INTERVAL 24 HOUR)
            SELECT * FROM today WHERE NOT EXISTS (
                SELECT 1 FROM history h WHERE h.host_ip = today.host_ip AND h.srv_port = today.srv_port)
              AND host_ip IN (SELECT host_ip FROM ours GROUP BY host_ip
                              HAVING min(first_seen) <= TIMESTAMP '{NIGHT}' - INTERVAL 48 HOUR)"""
    return {
        "m_rep": night + "SELECT host_ip, 1 AS M_rep, hits_srv, hits_cli, hits_totali, scenario, penalita FROM m_rep",
        "m_cert": night + "SELECT host_ip, 1 AS M_cert, hits_self_signed, hits_sha1, hits_totali, penalita FROM m_cert",
        "m_sni": night + "SELECT host_ip, 1 AS M_sni, hits_missing, penalita FROM m_sni",
        "m_srv": night + "SELECT host_ip, 1 AS M_srv, hits_totali, porte_distinte, "
                         "array_to_string(lista_porte, '|') AS lista_porte, penalita FROM m_srv",
        "m_proto": night + "SELECT host_ip, 1 AS M_proto, hits_totali, combinazioni_distinte, "
                           "array_to_string(lista_mismatch, '|') AS lista_mismatch, penalita FROM m_proto",
        "m_scan": night + "SELECT host_ip, 1 AS M_scan, hits_totali, array_to_string(codici_rilevati, '|') AS codici_rilevati, "
                          "array_to_string(codici_descritti, '|') AS codici_descritti, categoria_dominante, penalita FROM m_scan",
        "m_vol": night + "SELECT * FROM m_vol",
        "m_vol_working_hours": _with(statistical(WORKDAY)) + "SELECT * FROM m_vol",
        "m_vol_weekend": _with(statistical(SATURDAY)) + "SELECT * FROM m_vol",
        "m_vol_diagnostic": night + "SELECT *, 20 * M_vol AS penalita FROM vol_judged",
        "m_fail": night + f"SELECT {fail_columns}, penalita FROM m_fail",
        "m_fail_working_hours": _with(statistical(WORKDAY)) + f"SELECT {fail_columns}, penalita FROM m_fail",
        "m_fail_weekend": _with(statistical(SATURDAY)) + f"SELECT {fail_columns}, penalita FROM m_fail",
        "m_fail_diagnostic": night + f"SELECT {fail_columns}, 30 * M_fail AS penalita FROM fail_judged",
        "m_vol_replay": _with(replayed(NIGHT)) + f"""SELECT {stamp.format('ref')} AS ref, host_ip, 1 AS M_vol, v_out,
            CAST(trunc(v_med) AS BIGINT) AS v_mediana, CAST(trunc(v_mad) AS BIGINT) AS mad, CAST(trunc(v_eff) AS BIGINT) AS mad_eff,
            (v_out - v_med) / v_eff AS z_modified, categoria_temporale, buckets AS bucket_baseline, 20 AS penalita
            FROM judged WHERE v_out > 52428800 AND v_out > v_med AND (v_out - v_med) / v_eff > 3""",
        "m_fail_replay": _with(replayed(NIGHT)) + f"""SELECT {stamp.format('ref')} AS ref, host_ip, 1 AS M_fail, n_totali,
            n_falliti, r AS r_corrente, r_med AS r_mediana, r_mad AS mad, r_eff AS mad_eff, (r - r_med) / r_eff AS z_modified,
            buckets AS bucket_count, categoria_temporale, {", ".join(f"n_{c} AS breakdown_{c}" for c in CAUSES)},
            {CAUSE} AS causa_dominante, 30 AS penalita
            FROM judged WHERE n_totali >= 3 AND r > 0.30::DOUBLE AND r > r_med AND (r - r_med) / r_eff > 3""",
        "dominant_cause": night + f"SELECT host_ip, {CAUSE} AS causa, {BEST} AS conteggio FROM fail_judged",
        "scan_code_labels": _with() + f"""
            SELECT code, {LABEL.format('code')} AS label, count(*) AS alerts
            FROM (SELECT unnest(CAST(json_extract(json, '$.alerts') AS INTEGER[])) AS code
                  FROM host_alerts WHERE alert_id = 15) GROUP BY ALL""",
        "host_scores": scored + host_scores,
        "host_scores_by_metric": scored + host_scores,
        "host_scores_from_profile":
            _with(deterministic(ODD_MINUTE), statistical(ODD_MINUTE), scores()) + host_scores,
        "risk_bands": scored + "SELECT fascia, score, count(*) AS hosts FROM hosts GROUP BY ALL",
        "network_index": scored + "SELECT * FROM net",
        "network_state": scored + """SELECT score_max, fascia_globale, host_rosso AS host_critici,
            CASE WHEN host_rosso = 0 THEN 'rete sicura' WHEN host_rosso >= 2 THEN 'diffusione sistemica'
                 ELSE 'anomalia localizzata' END AS stato FROM net""",
        "suspect_ranking": scored + """SELECT host_ip, score, fascia,
            CASE WHEN length(metriche) > 40 THEN metriche[1:37] || '...' ELSE metriche END AS metriche,
              replace(metriche, ', ', '|') AS metriche_attive
            FROM hosts WHERE fascia <> 'VERDE' ORDER BY score DESC, host_ip""",
        "suspect_details": _with(deterministic(NIGHT), statistical(NIGHT), scores(), _details()) + """
            SELECT h.host_ip, score, fascia,
              CASE WHEN penalita_totale > 100 THEN penalita_totale END AS penalita_grezza,
              metrica, ordine_metrica, penalita, posizione, campo, valore
            FROM hosts h JOIN details d ON h.host_ip = d.host_ip WHERE fascia <> 'VERDE'""",
        "metric_status": night + counts,
        "metric_status_one_failing": night + counts.replace(
            "true AS ok, count(*) AS n_hosts FROM m_scan", "false AS ok, CAST(0 AS BIGINT) AS n_hosts"),
        "host_items": night + items,
        "host_items_stored": _with(deterministic(ODD_MINUTE)) + f"SELECT host_ip, metric, item FROM ({items})",
        "distinct_items_stored": _with(deterministic(ODD_MINUTE)) + f"""SELECT i.host_ip, i.metric, count(*) AS "distinct",
            CAST(sum(hits) AS BIGINT) AS hits FROM ({items}) AS i GROUP BY ALL""",
        "m_rep_low_tiers": short + "SELECT host_ip, 1 AS M_rep, hits_srv, hits_cli, hits_totali, scenario, penalita FROM m_rep",
        "m_srv_short": short + "SELECT host_ip, 1 AS M_srv, hits_totali, porte_distinte, "
                               "array_to_string(lista_porte, '|') AS lista_porte, penalita FROM m_srv",
        "m_proto_short": short + "SELECT host_ip, 1 AS M_proto, hits_totali, combinazioni_distinte, "
                                 "array_to_string(lista_mismatch, '|') AS lista_mismatch, penalita FROM m_proto",
        "m_scan_short": short + "SELECT host_ip, 1 AS M_scan, hits_totali, array_to_string(codici_rilevati, '|') AS codici_rilevati, "
                                "array_to_string(codici_descritti, '|') AS codici_descritti, categoria_dominante, penalita FROM m_scan",
        "scores_isolated_from_profile":
            _with(deterministic(ODD_MINUTE), statistical(ODD_MINUTE), scores()) + host_scores,
        "scores_of_foreign_tables": scored + host_scores,
        "score_run_stored": scored + host_scores,
        "score_run_stored_from_profile": scored + host_scores,
        "score_run_committed": scored + host_scores,
        "score_run_streamed_profile": _with(deterministic(WORKDAY), statistical(WORKDAY), scores()).replace(
            "FROM events)", "FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-22 10:00:00' "
            "AND ts < TIMESTAMP '2024-01-22 11:00:00'))") + host_scores,
        "profile_rewritten": _with() + f"""SELECT src AS host, {stamp.format("date_trunc('hour', first_seen)")} AS bucket,
            CAST(sum(bytes) AS BIGINT) AS bytes_out, count(*) AS flows, count(*) FILTER (WHERE {FAILED}) AS failed
            FROM flows WHERE src <> 0 AND {LAN.format('src')} AND {EXTERNAL.format('dst')} AND {FAILED}
              AND first_seen >= TIMESTAMP '{NIGHT}' - INTERVAL 28 DAY AND first_seen < TIMESTAMP '{NIGHT}' - INTERVAL 24 HOUR
            GROUP BY ALL""",
        "stream_restarted": _with() + f"""SELECT src AS host, {stamp.format("date_trunc('hour', first_seen)")} AS bucket,
            CAST(sum(bytes) AS BIGINT) AS bytes_out, count(*) AS flows, count(*) FILTER (WHERE {FAILED}) AS failed
            FROM flows WHERE src <> 0 AND {LAN.format('src')} AND {EXTERNAL.format('dst')} GROUP BY ALL""",
        "flagged_hosts": night + f"SELECT metric, n_hosts FROM ({counts})",
        "service_novelty": novelty,
        "service_novelty_stored": novelty,
        "flows_scan": _with() + f"""SELECT flow_id AS FLOW_ID, {stamp.format('first_seen')} AS FIRST_SEEN,
            {stamp.format("first_seen + INTERVAL 5 SECOND")} AS LAST_SEEN, src AS IPV4_SRC_ADDR, dst AS IPV4_DST_ADDR,
            bytes AS SRC2DST_BYTES, CAST(1 AS BIGINT) AS SRC2DST_PACKETS, CAST(answers AS BIGINT) AS DST2SRC_PACKETS,
            risk AS FLOW_RISK, CAST(srv_bl AS INTEGER) AS IS_SRV_BLACKLISTED, CAST(cli_bl AS INTEGER) AS IS_CLI_BLACKLISTED,
            CAST(alerted AS INTEGER) AS STATUS, 4 AS IP_PROTOCOL_VERSION, cli_ip AS CLI_IP, srv_port AS SRV_PORT, json AS JSON
            FROM flows""",
        "flow_alerts_view": _with() + f"""SELECT cli_ip, {stamp.format('first_seen')} AS tstamp, risk AS flow_risk_bitmap,
            srv_port, json FROM flows WHERE alerted""",
        "host_alerts_scan": _with() + f"SELECT ip, {stamp.format('tstamp')} AS tstamp, alert_id, json FROM host_alerts",
        "network_membership": _with() + f"""SELECT src <> 0 AND {LAN.format('src')} AS subject,
            {EXTERNAL.format('dst')} AS outside, coalesce({LAN_TEXT.format('cli_ip')}, false) AS local_text,
            count(*) AS flows FROM flows GROUP BY ALL""",
        "network_table": _with() + """, nets AS (SELECT DISTINCT 20 + c_custkey % 13 AS bits,
              (CAST(167772160 + c_custkey AS BIGINT) >> (12 - c_custkey % 13)) << (12 - c_custkey % 13) AS lo FROM customer),
            hosts AS (SELECT src, count(*) AS n FROM flows GROUP BY src),
            tagged AS (SELECT h.src, any_value(h.n) AS n, arg_max(concat(lo >> 24, '.', (lo >> 16) & 255, '.',
              (lo >> 8) & 255, '.', lo & 255, '/', bits), bits) FILTER (lo IS NOT NULL) AS network
              FROM hosts h LEFT JOIN nets ON h.src BETWEEN lo AND lo + (1 << (32 - bits)) - 1 GROUP BY h.src)
            SELECT network, count(*) AS hosts, CAST(sum(n) AS BIGINT) AS flows FROM tagged GROUP BY network""",
        "address_conversion": _with() + """SELECT src AS address, src_ip AS text,
            CASE WHEN cli_ip LIKE '%:%' THEN NULL ELSE src END AS parsed, count(*) AS flows FROM flows GROUP BY ALL""",
        "time_categories": _with() + f"""SELECT isodow(first_seen)::INTEGER AS giorno, hour(first_seen)::INTEGER AS ora,
            {CATEGORY.format('first_seen')} AS categoria, count(*) AS flows,
            count(DISTINCT date_trunc('hour', first_seen)) AS buckets FROM flows GROUP BY ALL""",
        "time_windows": _with() + f"""SELECT
            count(*) FILTER (WHERE first_seen >= t - INTERVAL 24 HOUR AND first_seen < t) AS correnti,
            count(*) FILTER (WHERE first_seen >= t - INTERVAL 28 DAY AND first_seen < t - INTERVAL 24 HOUR) AS storici,
            count(*) FILTER (WHERE first_seen >= t - INTERVAL 60 MINUTE AND first_seen < t) AS ultima_ora,
            count(*) FILTER (WHERE first_seen >= t - INTERVAL 60 MINUTE) AS senza_limite
            FROM flows, (SELECT TIMESTAMP '{ODD_MINUTE}' AS t)""",
        "risk_bits": _with() + f"""SELECT risk AS bitmap, (risk >> 5) & 1 = 1 AS nonstandard_port,
            (risk >> 24) & 1 = 1 AS missing_sni, (risk >> 6) & 1 = 1 OR (risk >> 29) & 1 = 1 AS certificate,
            {FAILED} AS failed, count(*) AS flows FROM flows GROUP BY ALL""",
        "alert_payloads": _with() + """
            SELECT 'codes' AS kind, array_to_string(coalesce(CAST(json_extract(json, '$.alerts') AS INTEGER[]),
              CAST([] AS INTEGER[])), '|') AS valore, count(*) AS alerts FROM host_alerts WHERE alert_id = 15 GROUP BY ALL
            UNION ALL SELECT 'port', CAST(coalesce(TRY_CAST(json_extract_string(json, '$.port') AS INTEGER), 0) AS VARCHAR),
              count(*) FROM host_alerts WHERE alert_id = 29 GROUP BY ALL
            UNION ALL SELECT 'proto', coalesce(json_extract_string(json, '$.alerts."30"."proto.ndpi"'), ''),
              count(*) FROM flows WHERE alerted GROUP BY ALL""",
        "scan_severity": night + """SELECT array_to_string(codes, '|') AS codici, pen AS penalita, cat AS categoria,
            count(*) AS alerts FROM scan_rated GROUP BY ALL""",
        "host_hour": night + f"""SELECT src AS host, {stamp.format('bucket')} AS bucket, v AS bytes_out, n AS flows,
            nf AS failed FROM host_hour""",
        "hourly_profile": _with() + f"""SELECT src AS host, {stamp.format("date_trunc('hour', first_seen)")} AS bucket,
            CAST(sum(bytes) AS BIGINT) AS bytes_out, count(*) AS flows, count(*) FILTER (WHERE {FAILED}) AS failed
            FROM flows WHERE src <> 0 AND {LAN.format('src')} AND {EXTERNAL.format('dst')} GROUP BY ALL""",
        "streamed_profile": _with() + f"""SELECT src AS host, {stamp.format("date_trunc('hour', first_seen)")} AS bucket,
            CAST(sum(bytes) AS BIGINT) AS bytes_out, count(*) AS flows, count(*) FILTER (WHERE {FAILED}) AS failed
            FROM flows WHERE src <> 0 AND {LAN.format('src')} AND {EXTERNAL.format('dst')} GROUP BY ALL""",
        "streamed_metrics": _with(hourly_metrics())
            + f"SELECT metric, {stamp.format('ref')} AS ref, host_ip, hits, dettaglio, penalita FROM hourly",
        "contextual_baseline": night + """SELECT src AS host, buckets AS bucket_count, v_med AS volume_mediana,
            v_mad AS volume_mad, r_med AS rate_mediana, r_mad AS rate_mad FROM base""",
        "byte_labels": _with() + """SELECT src_ip AS host_ip, CAST(sum(bytes) AS BIGINT) AS bytes,
            CASE WHEN sum(bytes) >= 1073741824 THEN printf('%.2f GB', sum(bytes)::DOUBLE / 1073741824)
                 WHEN sum(bytes) >= 1048576 THEN printf('%.2f MB', sum(bytes)::DOUBLE / 1048576)
                 WHEN sum(bytes) >= 1024 THEN printf('%.2f KB', sum(bytes)::DOUBLE / 1024)
                 ELSE concat(sum(bytes), ' B') END AS label
            FROM flows GROUP BY src_ip""",
    }
