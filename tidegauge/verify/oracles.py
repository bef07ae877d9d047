"""DuckDB SQL that gives the same rows as the queries, over the same tables."""

VIEWS = {}
ORDER = []
MATERIALIZED = {"points", "following", "alerts"}


def view(name, sql):
    VIEWS[name] = sql
    ORDER.append(name)


def sql(body):
    """``body`` with the named views, and the views those use, in front of it."""
    need = set()

    def add(text):
        for v in ORDER:
            if v not in need and f"@{v}" in text:
                need.add(v)
                add(VIEWS[v])
    add(body)
    parts = [f"{v} AS {'MATERIALIZED ' if v in MATERIALIZED else ''}({VIEWS[v].replace('@', '')})" for v in ORDER if v in need]
    recursive = "RECURSIVE " if "UNION ALL" in "".join(parts) + body else ""
    body = body.replace("@", "")
    if not parts:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + body.lstrip()[5:]
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


view("packets", """
SELECT 'link' || CAST(user_id % 2 AS VARCHAR) AS link_id, ts, event_id AS seq, user_id AS src_ip,
       CAST(json_extract(props, '$.k') AS BIGINT) % 8 AS dst_ip,
       CAST(1024 + event_id % 60000 AS INTEGER) AS src_port,
       CASE WHEN event_type IN ('click','view') THEN 443 WHEN event_type = 'purchase' THEN 53 ELSE 0 END AS dst_port,
       CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'purchase' THEN 17 WHEN 'signup' THEN 1 ELSE 47 END AS protocol,
       CASE WHEN event_type IN ('click','view') THEN CAST(event_id % 64 AS INTEGER) ELSE 0 END AS tcp_flags,
       64 + CAST(floor(value * 10) AS BIGINT) AS bytes,
       CASE WHEN event_id % 50 = 0 THEN 34525 ELSE 2048 END AS ethertype,
       event_id % 97 <> 0 AS l3_ok, event_id % 89 <> 0 AS l4_ok
FROM events""")
view("blacklist", """
SELECT DISTINCT 'link' || CAST(user_id % 2 AS VARCHAR) AS link_id, user_id AS src_ip,
       TIMESTAMP '2024-01-10 00:00:00' AS added_at,
       CASE WHEN user_id % 20 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END AS removed_at
FROM events WHERE user_id % 10 = 0""")
view("signatures", "SELECT * FROM (VALUES (1,1,7), (2,2,53), (3,3,1)) AS t(sig_id, signature_type, match_value)")
view("counters", """
SELECT link_id, cpu, ts, CAST(SUM(n) OVER w AS BIGINT) AS packets, CAST(SUM(b) OVER w AS BIGINT) AS bytes,
       CAST(SUM(t) OVER w AS BIGINT) AS tcp_packets, CAST(SUM(u) OVER w AS BIGINT) AS udp_packets,
       CAST(SUM(i) OVER w AS BIGINT) AS icmp_packets
FROM (SELECT link_id, seq % 4 AS cpu, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS ts,
             COUNT(*) AS n, SUM(bytes) AS b, COUNT(*) FILTER (protocol = 6) AS t,
             COUNT(*) FILTER (protocol = 17) AS u, COUNT(*) FILTER (protocol = 1) AS i
      FROM @packets GROUP BY 1,2,3)
WINDOW w AS (PARTITION BY link_id, cpu ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
view("merged", """
SELECT link_id, ts, CAST(SUM(packets) AS BIGINT) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes,
       CAST(SUM(tcp_packets) AS BIGINT) AS tcp_packets, CAST(SUM(udp_packets) AS BIGINT) AS udp_packets,
       CAST(SUM(icmp_packets) AS BIGINT) AS icmp_packets FROM @counters GROUP BY 1, 2""")
view("flows", """
SELECT CAST((l_orderkey % 1000) * 1000 AS DOUBLE) AS "Flow Duration", l_quantity AS "Total Fwd Packets",
       l_quantity * l_discount AS "Total Backward Packets", l_extendedprice AS "Total Length of Fwd Packets",
       l_extendedprice * l_tax AS "Total Length of Bwd Packets", l_extendedprice / l_quantity AS "Flow Bytes/s",
       CAST(l_partkey % 500 AS DOUBLE) AS "SYN Flag Count", CAST(l_suppkey % 50 AS DOUBLE) AS "ACK Flag Count",
       CASE l_returnflag WHEN 'N' THEN ' benign ' WHEN 'A' THEN 'Syn' ELSE 'DrDoS_UDP' END AS label,
       'file' || CAST(l_linenumber AS VARCHAR) AS source_file
FROM lineitem""")
view("predictions", """
SELECT doc_id, quality AS label, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS prediction FROM labels""")
view("host_metrics", """
SELECT 'link' || CAST(user_id % 2 AS VARCHAR) AS link_id, ts, event_id AS seq, LEAST(value, 100) AS cpu_percent,
       CAST(event_id % 100 AS DOUBLE) AS memory_percent, CAST(1000 + event_id % 3000 AS DOUBLE) AS memory_mb FROM events""")
view("candidates", """
SELECT 'link' || CAST(user_id % 2 AS VARCHAR) AS link_id, event_type AS type, ts, event_id AS seq FROM events""")
view("adm", """
SELECT link_id, ts, seq, src_ip, dst_ip, protocol, bytes, time_bucket(INTERVAL 6 HOUR, ts) AS tick,
       CASE WHEN l4_ok AND protocol IN (6, 17) THEN src_port ELSE 0 END AS src_port,
       CASE WHEN l4_ok AND protocol IN (6, 17) THEN dst_port ELSE 0 END AS dst_port,
       CASE WHEN l4_ok AND protocol = 6 THEN tcp_flags ELSE 0 END AS tcp_flags
FROM @packets WHERE l3_ok AND ethertype = 2048""")
view("verdicts", """
SELECT *, CASE WHEN blacklisted OR (syn AND before > 5) THEN 'drop' ELSE 'pass' END AS verdict
FROM (SELECT *, COALESCE(SUM(CASE WHEN syn AND NOT blacklisted THEN 1 ELSE 0 END)
                OVER (PARTITION BY link_id, src_ip ORDER BY ts, seq
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT a.*, protocol = 6 AND (tcp_flags & 2) <> 0 AS syn,
                   EXISTS (SELECT 1 FROM @blacklist b WHERE b.link_id = a.link_id AND b.src_ip = a.src_ip
                           AND a.ts >= b.added_at AND (b.removed_at IS NULL OR a.ts < b.removed_at)) AS blacklisted
            FROM @adm a))""")


def _source_rows(table, where="TRUE"):
    return f"""
SELECT link_id, tick, src_ip, COUNT(*) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes, MAX(ts) AS last_seen,
       COUNT(*) FILTER (protocol = 6 AND (tcp_flags & 2) <> 0) AS syn_count,
       COUNT(*) FILTER (protocol = 17) AS udp_count
FROM @{table} WHERE {where} GROUP BY 1, 2, 3"""


view("sources", _source_rows("adm"))
view("vsources", _source_rows("verdicts", "NOT blacklisted"))

_COUNTERS = """
       COUNT(*) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes,
       COUNT(*) FILTER (protocol = 6) AS tcp_packets, COUNT(*) FILTER (protocol = 17) AS udp_packets,
       COUNT(*) FILTER (protocol = 1) AS icmp_packets, COUNT(*) FILTER (protocol NOT IN (6, 17, 1)) AS other_packets"""
view("counts", f"SELECT link_id, tick, {_COUNTERS} FROM @adm GROUP BY 1, 2")
view("vcounts", f"""SELECT link_id, tick, {_COUNTERS},
       COUNT(*) FILTER (verdict = 'drop') AS dropped_packets,
       CAST(COALESCE(SUM(bytes) FILTER (verdict = 'drop'), 0) AS BIGINT) AS dropped_bytes,
       COUNT(*) FILTER (verdict = 'pass') AS passed_packets,
       CAST(COALESCE(SUM(bytes) FILTER (verdict = 'pass'), 0) AS BIGINT) AS passed_bytes
FROM @verdicts GROUP BY 1, 2""")


def _concentration(sources, heavy):
    return f"""
SELECT link_id, tick, COUNT(*) AS sources,
       GREATEST(0, -SUM((packets / total) * log2(packets / total))) AS ip_entropy,
       SUM(CASE WHEN rn <= 10 THEN packets ELSE 0 END) / MAX(total) AS top_ratio,
       COUNT(*) FILTER (syn_count > {heavy}) AS syn_heavy
FROM (SELECT *, SUM(packets) OVER (PARTITION BY link_id, tick) AS total,
             ROW_NUMBER() OVER (PARTITION BY link_id, tick ORDER BY packets DESC, src_ip) AS rn FROM @{sources})
GROUP BY 1, 2"""


view("conc", _concentration("sources", 2))
view("vconc", _concentration("vsources", 2))


def _cumulative(sources, counts):
    return f"""
SELECT t.link_id, t.tick, s.src_ip, SUM(s.packets) AS packets, SUM(s.syn_count) AS syn_count
FROM @{counts} t JOIN @{sources} s ON s.link_id = t.link_id AND s.tick <= t.tick GROUP BY 1, 2, 3"""


view("cumsources", _cumulative("sources", "counts"))
view("vcumsources", _cumulative("vsources", "vcounts"))
view("cumconc10", _concentration("cumsources", 10))
view("vcumconc", _concentration("vcumsources", 2))

_RATIOS = """CASE WHEN {s} > 0 THEN {t} / {s} ELSE 0 END AS tcp_ratio,
       CASE WHEN {s} > 0 THEN {u} / {s} ELSE 0 END AS udp_ratio,
       CASE WHEN {s} > 0 THEN {i} / {s} ELSE 0 END AS icmp_ratio"""


def _ratios(prefix=""):
    t, u, i = (f"{prefix}{p}_packets" for p in ("tcp", "udp", "icmp"))
    return _RATIOS.format(s=f"({t} + {u} + {i})", t=t, u=u, i=i)


def _tickrows(counts, conc, cumulative=False):
    run = """(SELECT *, SUM(tcp_packets) OVER w AS c_tcp_packets, SUM(udp_packets) OVER w AS c_udp_packets,
              SUM(icmp_packets) OVER w AS c_icmp_packets FROM @{0}
              WINDOW w AS (PARTITION BY link_id ORDER BY tick ROWS UNBOUNDED PRECEDING))""".format(counts)
    source = run if cumulative else f"@{counts}"
    p = "c_" if cumulative else ""
    return f"""
SELECT c.*, packets / 21600.0::DOUBLE AS pps, bytes / 21600.0::DOUBLE AS bps,
       {p}tcp_packets + {p}udp_packets + {p}icmp_packets AS proto_packets, {_ratios(p)},
       COALESCE(k.sources, 0) AS sources, COALESCE(k.ip_entropy, 0) AS ip_entropy,
       COALESCE(k.top_ratio, 0) AS top_ratio, COALESCE(k.syn_heavy, 0) AS syn_heavy,
       ROW_NUMBER() OVER (PARTITION BY c.link_id ORDER BY c.tick) AS n
FROM {source} c LEFT JOIN @{conc} k ON k.link_id = c.link_id AND k.tick = c.tick"""


view("ticks", _tickrows("counts", "conc"))
view("vticks", _tickrows("vcounts", "vconc"))
view("vcumticks", _tickrows("vcounts", "vcumconc", True))


def _baseline(ticks, frame):
    return f"""
SELECT *, CASE WHEN std_pps > 0 THEN (pps - mean_pps) / std_pps END AS pps_sigma,
       CASE WHEN prev_pps > 0 THEN pps / prev_pps END AS change_rate
FROM (SELECT *, CASE WHEN history >= 10 THEN history END AS samples,
             CASE WHEN history >= 10 THEN m1 END AS mean_pps, CASE WHEN history >= 10 THEN s1 END AS std_pps,
             CASE WHEN history >= 10 THEN m2 END AS mean_bps, CASE WHEN history >= 10 THEN s2 END AS std_bps,
             CASE WHEN history >= 10 THEN r1 END AS mean_tcp_ratio, CASE WHEN history >= 10 THEN r2 END AS mean_udp_ratio,
             CASE WHEN history >= 10 THEN r3 END AS mean_icmp_ratio
      FROM (SELECT *, LAG(pps) OVER (PARTITION BY link_id ORDER BY tick) AS prev_pps, COUNT(*) OVER w AS history,
                   AVG(pps) OVER w AS m1, STDDEV_POP(pps) OVER w AS s1, AVG(bps) OVER w AS m2, STDDEV_POP(bps) OVER w AS s2,
                   AVG(tcp_ratio) OVER w AS r1, AVG(udp_ratio) OVER w AS r2, AVG(icmp_ratio) OVER w AS r3
            FROM @{ticks} WINDOW w AS (PARTITION BY link_id ORDER BY tick ROWS BETWEEN {frame})))"""


view("prior", _baseline("ticks", "40 PRECEDING AND 1 PRECEDING"))
view("inclusive", _baseline("ticks", "39 PRECEDING AND CURRENT ROW"))
view("vprior", _baseline("vticks", "40 PRECEDING AND 1 PRECEDING"))
view("vcumprior", _baseline("vcumticks", "40 PRECEDING AND 1 PRECEDING"))


def _scores(base):
    return f"""
SELECT *, score >= 50 AS is_anomaly FROM (
SELECT *, CASE WHEN n = 1 THEN 0.0::DOUBLE ELSE CAST(
         CASE WHEN packets > 52 THEN 50 WHEN packets > 45 THEN 25 ELSE 0 END
       + CASE WHEN ABS(pps_sigma) > 2 THEN 30 ELSE 0 END + CASE WHEN change_rate > 1.5 THEN 20 ELSE 0 END
       + CASE WHEN f_tcp THEN 15 ELSE 0 END + CASE WHEN f_udp THEN 15 ELSE 0 END + CASE WHEN f_icmp THEN 15 ELSE 0 END
       + CASE WHEN f_ent THEN 20 ELSE 0 END + CASE WHEN f_top THEN 10 ELSE 0 END
       + CASE WHEN syn_heavy > 0 THEN 25 ELSE 0 END AS DOUBLE) END AS score,
       CASE WHEN n = 1 THEN '' ELSE concat_ws('|',
         CASE WHEN packets > 52 THEN 'Very high packet rate: ' || printf('%.0f', pps) || ' pps (threshold: 0.00240741)'
              WHEN packets > 45 THEN 'High packet rate: ' || printf('%.0f', pps) || ' pps (threshold: 0.00208333)' END,
         CASE WHEN ABS(pps_sigma) > 2 THEN 'Packet rate deviation: ' || printf('%.1f', pps_sigma) || ' sigma from baseline' END,
         CASE WHEN change_rate > 1.5 THEN 'Rapid traffic increase: ' || printf('%.1f', change_rate) || 'x' END,
         CASE WHEN f_tcp THEN 'Abnormal TCP ratio: ' || printf('%.2f', tcp_ratio) || ' (expected: 0.50)' END,
         CASE WHEN f_udp THEN 'High UDP ratio: ' || printf('%.2f', udp_ratio) || ' (normal: 0.25) - possible UDP flood' END,
         CASE WHEN f_icmp THEN 'High ICMP ratio: ' || printf('%.2f', icmp_ratio) || ' (normal: 0.25) - possible ICMP flood' END,
         CASE WHEN f_ent THEN 'Low source IP entropy: ' || printf('%.2f', ip_entropy) || ' (threshold: 4.6) - concentrated sources' END,
         CASE WHEN f_top THEN 'Traffic concentrated in few IPs: top 10 = ' || printf('%.1f', top_ratio * 100) || '%' END,
         CASE WHEN syn_heavy > 0 THEN 'Detected ' || CAST(syn_heavy AS VARCHAR) || ' IPs with excessive SYN packets - possible SYN flood' END
       ) END AS reasons
FROM (SELECT *, proto_packets > 0 AND ABS(tcp_ratio - 0.5::DOUBLE) > 0.1::DOUBLE AS f_tcp,
             proto_packets > 0 AND udp_ratio > 0.25::DOUBLE + 0.1::DOUBLE AS f_udp,
             proto_packets > 0 AND icmp_ratio > 0.25::DOUBLE + 0.1::DOUBLE AS f_icmp,
             sources > 0 AND ip_entropy < 4.6::DOUBLE AS f_ent,
             sources > 0 AND top_ratio > 0.5::DOUBLE AS f_top FROM @{base}))"""


view("scores", _scores("prior"))
view("vscores", _scores("vprior"))
view("vcumscores", _scores("vcumprior"))
view("alerts", """
SELECT link_id, tick AS ts, 'ddos_attack' AS type, CASE WHEN score >= 75 THEN 'high' ELSE 'medium' END AS severity,
       'DDoS attack detected (score: ' || printf('%.1f', score) || ')' AS message, pps AS current_pps,
       COALESCE(mean_pps, 0) AS baseline_pps, length(reasons) - length(replace(reasons, '|', '')) + 1 AS reasons,
       2 + (pps_sigma IS NOT NULL)::INT + (change_rate IS NOT NULL)::INT + 3 * (proto_packets > 0)::INT
         + 2 * (sources > 0)::INT AS metrics
FROM @scores WHERE is_anomaly""")
view("kept_alerts", """
SELECT link_id, MIN(ts) AS ts FROM @alerts GROUP BY 1
UNION ALL
SELECT k.link_id, (SELECT MIN(a.ts) FROM @alerts a WHERE a.link_id = k.link_id AND a.ts >= k.ts + INTERVAL 1 DAY)
FROM kept_alerts k WHERE k.ts IS NOT NULL""")
view("kept_minute", """
SELECT link_id, MIN(ts) AS ts FROM @alerts GROUP BY 1
UNION ALL
SELECT k.link_id, (SELECT MIN(a.ts) FROM @alerts a WHERE a.link_id = k.link_id AND a.ts >= k.ts + INTERVAL 1 MINUTE)
FROM kept_minute k WHERE k.ts IS NOT NULL""")
view("points", "SELECT link_id, type, ts, MIN(seq) AS seq FROM @candidates GROUP BY 1, 2, 3")
view("following", """
SELECT a.link_id, a.type, a.ts, MIN(b.ts) AS next_ts FROM @points a
LEFT JOIN @points b ON a.link_id = b.link_id AND a.type = b.type AND a.ts + INTERVAL 1 HOUR <= b.ts GROUP BY 1, 2, 3""")
view("kept", """
SELECT link_id, type, MIN(ts) AS ts FROM @points GROUP BY 1, 2
UNION ALL
SELECT k.link_id, k.type, f.next_ts FROM kept k
JOIN @following f ON f.link_id = k.link_id AND f.type = k.type AND f.ts = k.ts WHERE f.next_ts IS NOT NULL""")

_KNOWN = ["BENIGN", "DrDoS_DNS", "DrDoS_LDAP", "DrDoS_MSSQL", "DrDoS_NTP", "DrDoS_NetBIOS", "DrDoS_SNMP", "DrDoS_SSDP",
          "DrDoS_UDP", "Syn", "TFTP", "UDP-lag", "WebDDoS", "Portmap", "NetBIOS", "LDAP", "MSSQL", "UDP"]
_LABEL_ID = "CASE trim(label) " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_KNOWN)) + " END"



def _two(x):
    return f"printf('%.2f', CASE WHEN ABS(({x}) * 8) % 2 = 1 THEN ({x}) + 0.001 ELSE {x} END)"


SQL = {}


def query(name, body):
    SQL[name] = sql(body)


_BINARY = "CASE WHEN upper(trim(label)) = 'BENIGN' THEN 0 ELSE 1 END"
query("b1_admission", """SELECT CASE WHEN NOT l3_ok THEN 'drop' WHEN ethertype <> 2048 THEN 'pass' ELSE 'count' END AS admission,
       COUNT(*) AS packets FROM @packets GROUP BY 1""")
query("b2_protocol_class", """SELECT CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'other' END AS protocol_class,
       COUNT(*) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes FROM @packets GROUP BY 1""")
query("b3_is_syn", "SELECT seq, protocol = 6 AND (tcp_flags & 2) <> 0 AS syn FROM @packets")
query("b4_flow_ports", "SELECT seq, src_port, dst_port, tcp_flags FROM @adm")
query("b5_ip_text", """SELECT seq, (a // 16777216) || '.' || (a // 65536 % 256) || '.' || (a // 256 % 256) || '.' || (a % 256) AS ip, a AS back
FROM (SELECT seq, src_ip * 65537 + 167772160 AS a FROM @packets)""")
query("b6_norm_label", "SELECT upper(trim(label)) AS label, COUNT(*) AS flows FROM @flows GROUP BY 1")
query("b7_encode_binary", f"SELECT label, {_BINARY} AS code, COUNT(*) AS flows FROM @flows GROUP BY 1, 2")
query("b9_decode_label", f"""SELECT CASE WHEN {_BINARY} = 0 THEN 'BENIGN' ELSE 'ATTACK' END AS name,
       CASE WHEN {_LABEL_ID} IS NULL THEN 'UNKNOWN' ELSE trim(label) END AS known, COUNT(*) AS flows FROM @flows GROUP BY 1, 2""")
query("b10_label_id", f"SELECT label, {_LABEL_ID} AS label_id, COUNT(*) AS flows FROM @flows GROUP BY 1, 2")
query("b11_to_number", "SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END, 6) AS number FROM events")
_ODD = """(SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE
       WHEN event_id % 17 = 0 THEN '-inf'::DOUBLE WHEN event_id % 19 = 0 THEN value * 1e12 ELSE value END AS x FROM events)"""
query("b12_clean_number", f"""SELECT event_id, round(CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE GREATEST(-1e10, LEAST(1e10, x)) END, 6) AS cleaned
FROM {_ODD}""")
query("b13_nan_to_num", f"""SELECT event_id, round(CASE WHEN isnan(x) THEN 0 WHEN x = 'inf'::DOUBLE THEN 1e10
       WHEN x = '-inf'::DOUBLE THEN -1e10 ELSE x END, 6) AS cleaned FROM {_ODD}""")
query("b15_ratio", "SELECT event_id, round(CASE WHEN event_id % 5 > 0 THEN value / (event_id % 5) ELSE 0 END, 6) AS ratio FROM events")
query("b18_severity", """SELECT CASE WHEN s >= 75 THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN s >= 85 THEN 'critical' WHEN s >= 75 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS severity4, COUNT(*) AS rows
FROM (SELECT event_id % 101 AS s FROM events) GROUP BY 1, 2""")
query("b19_human_units", f"""SELECT o_orderkey,
       CASE WHEN n >= 1000000 THEN {_two('n / 1000000')} || 'M' WHEN n >= 1000 THEN {_two('n / 1000')} || 'K'
            ELSE printf('%.0f', n) END AS count_text,
       CASE WHEN n >= 1073741824 THEN {_two('n / 1073741824')} || ' GB' WHEN n >= 1048576 THEN {_two('n / 1048576')} || ' MB'
            WHEN n >= 1024 THEN {_two('n / 1024')} || ' KB' ELSE CAST(n AS BIGINT) || ' B' END AS bytes_text
FROM (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 40 + 1)) AS n FROM orders)""")
query("b20_intensity_band", """SELECT CASE WHEN p < 50000 THEN 'small' WHEN p < 500000 THEN 'medium' WHEN p < 2000000 THEN 'large' ELSE 'hyper' END AS band,
       COUNT(*) AS rows FROM (SELECT o_totalprice * (o_orderkey % 40) AS p FROM orders) GROUP BY 1""")
query("b21_baseline_status", """SELECT link_id, CASE WHEN samples > 10 THEN 'Learned' ELSE 'Learning' END AS status, COUNT(*) AS ticks
FROM @prior GROUP BY 1, 2""")
query("b24_gbps_band", """SELECT CASE WHEN g >= 10 AND g < 50 THEN 'small' WHEN g >= 50 AND g < 200 THEN 'medium'
       WHEN g >= 200 AND g <= 800 THEN 'large' END AS band, COUNT(*) AS rows FROM (SELECT o_orderkey % 1000 AS g FROM orders) GROUP BY 1""")

_LISTED = "EXISTS (SELECT 1 FROM @blacklist b WHERE b.link_id = a.link_id AND b.src_ip = a.src_ip)"
query("c1_apply_blacklist", f"SELECT seq, {_LISTED} AS listed FROM @adm a")
query("c2_apply_blacklist_asof", "SELECT seq FROM @verdicts WHERE NOT blacklisted")
query("c4_match_signatures", """SELECT sig_id, signature_type, CAST(match_value AS BIGINT) AS match_value, COUNT(seq) AS blocked_packets,
       CAST(COALESCE(SUM(bytes), 0) AS BIGINT) AS blocked_bytes
FROM @signatures LEFT JOIN @adm ON (signature_type = 1 AND src_ip = match_value) OR (signature_type = 2 AND dst_port = match_value)
     OR (signature_type = 3 AND protocol = match_value) GROUP BY 1, 2, 3""")
query("g3_blacklist_add", """SELECT link_id, src_ip, epoch_us(MAX(added_at)) AS added_at_us, epoch_us(arg_max(removed_at, added_at)) AS removed_at_us
FROM (SELECT link_id, src_ip, added_at, COALESCE(removed_at, TIMESTAMP '1900-01-01') AS removed_at FROM @blacklist
      UNION SELECT link_id, src_ip, tick, TIMESTAMP '1900-01-01' FROM @sources WHERE packets > 3) GROUP BY 1, 2""".replace(
    "epoch_us(arg_max(removed_at, added_at))",
    "epoch_us(CASE WHEN arg_max(removed_at, added_at) > TIMESTAMP '1900-01-01' THEN arg_max(removed_at, added_at) END)"))
query("g4_blacklist_remove", """SELECT b.link_id, b.src_ip, epoch_us(added_at) AS added_at_us, epoch_us(COALESCE(removed_at, gone)) AS removed_at_us
FROM @blacklist b LEFT JOIN (SELECT link_id, src_ip, MAX(tick) AS gone FROM @sources WHERE packets = 1 GROUP BY 1, 2) g
  ON g.link_id = b.link_id AND g.src_ip = b.src_ip""")
query("g5_blacklist_active", "SELECT link_id, src_ip FROM @blacklist WHERE removed_at IS NULL OR removed_at > TIMESTAMP '2024-01-25'")

query("d1_tick_counters", """SELECT link_id, epoch_us(tick) AS tick_start_us, packets, bytes, dropped_packets, dropped_bytes, passed_packets,
       passed_bytes, tcp_packets, udp_packets, icmp_packets, other_packets FROM @vcounts""")
query("d2_merge_counters", "SELECT link_id, epoch_us(ts) AS ts_us, packets, bytes, tcp_packets, udp_packets, icmp_packets FROM @merged")
query("d3_ip_stats", """SELECT link_id, src_ip, CAST(SUM(packets) AS BIGINT) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes,
       epoch_us(MAX(last_seen)) AS last_seen_us, CAST(SUM(syn_count) AS BIGINT) AS syn_count, CAST(SUM(udp_count) AS BIGINT) AS udp_count
FROM @vsources GROUP BY 1, 2""")
query("d3_ip_stats_cumulative", """SELECT link_id, epoch_us(tick) AS tick_start_us, src_ip, CAST(SUM(packets) OVER w AS BIGINT) AS packets,
       CAST(SUM(bytes) OVER w AS BIGINT) AS bytes, CAST(SUM(syn_count) OVER w AS BIGINT) AS syn_count,
       CAST(SUM(udp_count) OVER w AS BIGINT) AS udp_count
FROM @vsources WINDOW w AS (PARTITION BY link_id, src_ip ORDER BY tick)""")
query("d4_flow_stats", """SELECT link_id, src_ip, dst_ip, src_port, dst_port, protocol, COUNT(*) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes,
       epoch_us(MIN(ts)) AS first_seen_us, epoch_us(MAX(ts)) AS last_seen_us, bit_or(tcp_flags) AS flags FROM @adm GROUP BY 1, 2, 3, 4, 5, 6""")
query("d5_flow_count", """SELECT link_id, src_ip, COUNT(*) AS flow_count
FROM (SELECT DISTINCT link_id, src_ip, dst_ip, src_port, dst_port, protocol FROM @adm) GROUP BY 1, 2""")
_MINUTE = "SELECT link_id, time_bucket(INTERVAL 1 MINUTE, ts) AS m, COUNT(DISTINCT src_ip) AS u FROM @adm GROUP BY 1, 2"
query("d6_unique_ips", f"SELECT link_id, epoch_us(m) AS minute_start_us, u AS unique_ips FROM ({_MINUTE})")
query("d6_mean_unique_ips", f"SELECT link_id, round(AVG(u), 6) AS unique_ips_per_minute FROM ({_MINUTE}) GROUP BY 1")
query("d7_ip_entropy", "SELECT link_id, epoch_us(tick) AS tick_start_us, round(ip_entropy, 6) AS ip_entropy FROM @conc")
query("d8_topk_share", "SELECT link_id, epoch_us(tick) AS tick_start_us, round(top_ratio, 6) AS top_ratio FROM @conc")
query("d9_syn_heavy", "SELECT link_id, epoch_us(tick) AS tick_start_us, syn_heavy FROM @conc")
query("d7_d9_cumulative", """SELECT link_id, epoch_us(tick) AS tick_start_us, sources, round(ip_entropy, 6) AS ip_entropy,
       round(top_ratio, 6) AS top_ratio, syn_heavy FROM @cumconc10""")
query("d10_protocol_ratios", f"""SELECT link_id, epoch_us(tick) AS tick_start_us, round(tcp_ratio, 6) AS tcp_ratio, round(udp_ratio, 6) AS udp_ratio,
       round(icmp_ratio, 6) AS icmp_ratio FROM @ticks""")
query("d18_throughput", """SELECT link_id, CAST(SUM(packets) AS BIGINT) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes,
       round(SUM(packets) / (COUNT(*) * 21600.0::DOUBLE), 6) AS pps,
       round(SUM(bytes) * 8.0::DOUBLE / (COUNT(*) * 21600.0::DOUBLE) / 1000000, 6) AS mbps FROM @counts GROUP BY 1""")

query("e1_counter_rates", """SELECT link_id, epoch_us(ts) AS ts_us, round(s, 6) AS seconds, round(dp / s, 6) AS pps, round(db / s, 6) AS bps
FROM (SELECT link_id, ts, packets - LAG(packets) OVER w AS dp, bytes - LAG(bytes) OVER w AS db,
             (epoch_us(ts) - epoch_us(LAG(ts) OVER w)) / 1000000.0::DOUBLE AS s
      FROM @merged WINDOW w AS (PARTITION BY link_id ORDER BY ts))""")
query("e1_counter_rates_since", """SELECT link_id, epoch_us(ts) AS ts_us, round(s, 6) AS seconds, round(dp / s, 6) AS pps, round(db / s, 6) AS bps
FROM (SELECT link_id, ts, packets - LAG(packets, 1, 0) OVER w AS dp, bytes - LAG(bytes, 1, 0) OVER w AS db,
             (epoch_us(ts) - epoch_us(LAG(ts, 1, TIMESTAMP '2023-12-31 18:00:00') OVER w)) / 1000000.0::DOUBLE AS s
      FROM @merged WINDOW w AS (PARTITION BY link_id ORDER BY ts))""")
query("e2_tick_rates", "SELECT link_id, epoch_us(tick) AS tick_start_us, round(pps, 6) AS pps, round(bps, 6) AS bps FROM @ticks")
_BASE = """SELECT link_id, epoch_us(tick) AS tick_start_us, history, samples, round(mean_pps, 6) AS mean_pps, round(std_pps, 6) AS std_pps,
       round(mean_bps, 6) AS mean_bps, round(std_bps, 6) AS std_bps, round(mean_tcp_ratio, 6) AS mean_tcp_ratio,
       round(mean_udp_ratio, 6) AS mean_udp_ratio, round(mean_icmp_ratio, 6) AS mean_icmp_ratio,
       round(pps_sigma, 6) AS pps_sigma, round(change_rate, 6) AS change_rate FROM """
query("e3_baseline_prior", _BASE + "@prior")
query("e3_baseline_inclusive", _BASE + "@inclusive")
query("e9_syn_excess", """SELECT seq, syn AND before > 5 AS syn_dropped
FROM (SELECT *, COALESCE(SUM(CASE WHEN syn THEN 1 ELSE 0 END) OVER (PARTITION BY link_id, src_ip ORDER BY ts, seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT *, protocol = 6 AND (tcp_flags & 2) <> 0 AS syn FROM @adm))""")
query("e10_packet_verdict", "SELECT seq, blacklisted, verdict FROM @verdicts")
query("e11_inter_arrival", """SELECT link_id, epoch_us(t) AS tick_start_us,
       round((epoch_us(t) - epoch_us(LAG(t) OVER (PARTITION BY link_id ORDER BY t))) / 1000.0::DOUBLE, 6) AS iat_ms
FROM (SELECT DISTINCT link_id, time_bucket(INTERVAL 10 MINUTE, ts) AS t FROM @adm)""")
query("e13_cumulate", """SELECT link_id, epoch_us(tick) AS tick_start_us, CAST(SUM(packets) OVER w AS BIGINT) AS cum_packets,
       CAST(SUM(bytes) OVER w AS BIGINT) AS cum_bytes, CAST(SUM(tcp_packets) OVER w AS BIGINT) AS cum_tcp_packets
FROM @counts WINDOW w AS (PARTITION BY link_id ORDER BY tick)""")
query("e14_host_summary", """SELECT link_id, round(AVG(cpu_percent) FILTER (i <= 60), 6) AS avg_cpu_percent,
       round(AVG(memory_percent) FILTER (i <= 60), 6) AS avg_memory_percent,
       round(MAX(memory_mb) FILTER (i = 1), 6) AS current_memory_mb, COUNT(*) AS samples
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY link_id ORDER BY ts DESC, seq DESC) AS i FROM @host_metrics) GROUP BY 1""")
query("e15_cooldown", """SELECT k.link_id, k.type, p.seq, epoch_us(k.ts) AS ts_us FROM @kept k
JOIN @points p ON p.link_id = k.link_id AND p.type = k.type AND p.ts = k.ts""")
query("e16_rate_limit", """SELECT seq, ROW_NUMBER() OVER (PARTITION BY link_id, src_ip, date_trunc('hour', ts) ORDER BY seq) > 1 AS over_limit FROM @adm""")

query("f1_top_sources", """SELECT link_id, src_ip, packets, CAST(r AS INTEGER) AS rank FROM (
SELECT link_id, src_ip, packets, ROW_NUMBER() OVER (PARTITION BY link_id ORDER BY packets DESC, src_ip) AS r
FROM (SELECT link_id, src_ip, COUNT(*) AS packets FROM @adm GROUP BY 1, 2)) WHERE r <= 20""")
query("f1_top_sources_all", "SELECT link_id, src_ip, COUNT(*) AS packets FROM @adm GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 100")
query("f2_top_flows", """SELECT link_id, src_ip, dst_ip, dst_port, protocol, packets, CAST(r AS INTEGER) AS rank FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY link_id ORDER BY packets DESC, src_ip, dst_ip, dst_port, protocol) AS r
FROM (SELECT link_id, src_ip, dst_ip, dst_port, protocol, COUNT(*) AS packets FROM @adm GROUP BY 1, 2, 3, 4, 5)) WHERE r <= 20""")

_SCORE = """SELECT link_id, epoch_us(tick) AS tick_start_us, score, is_anomaly, round(pps, 6) AS pps, round(pps_sigma, 6) AS pps_sigma,
       round(change_rate, 6) AS change_rate, round(tcp_ratio, 6) AS tcp_ratio, round(udp_ratio, 6) AS udp_ratio,
       round(icmp_ratio, 6) AS icmp_ratio, round(ip_entropy, 6) AS ip_entropy, round(top_ratio, 6) AS top_ratio, syn_heavy, reasons FROM """
query("score_ticks", _SCORE + "@vscores")
query("score_ticks_cumulative", _SCORE + "@vcumscores")
_ALERTS = """SELECT link_id, epoch_us(ts) AS timestamp_us, type, severity, message, reasons, CAST(metrics AS BIGINT) AS metrics,
       round(current_pps, 6) AS current_pps, round(baseline_pps, 6) AS baseline_pps FROM @alerts"""
query("i13_alerts", _ALERTS)
query("a10_a11_alerts", _ALERTS)
query("e15_kept_alerts", """SELECT a.link_id, epoch_us(a.ts) AS timestamp_us, a.severity FROM @kept_alerts k
JOIN @alerts a ON a.link_id = k.link_id AND a.ts = k.ts""")
query("f3_block_candidates", """SELECT link_id, epoch_us(tick) AS tick_start_us, src_ip, packets, CAST(r AS INTEGER) AS rank FROM (
SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.link_id, s.tick ORDER BY s.packets DESC, s.src_ip) AS r FROM @sources s
JOIN @kept_minute k ON k.link_id = s.link_id AND k.ts = s.tick) WHERE r <= 5 AND packets > 3""")
query("f3_block_candidates_since", """SELECT link_id, epoch_us(tick) AS tick_start_us, src_ip, CAST(packets AS BIGINT) AS packets, CAST(r AS INTEGER) AS rank FROM (
SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.link_id, s.tick ORDER BY s.packets DESC, s.src_ip) AS r FROM @cumsources s
JOIN @kept_minute k ON k.link_id = s.link_id AND k.ts = s.tick) WHERE r <= 5 AND packets > 40""")
query("f4_recent_alerts", "SELECT link_id, epoch_us(ts) AS timestamp_us, severity FROM @alerts ORDER BY ts DESC, link_id LIMIT 10")
query("d20_alert_rollup", """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS span_start_us, type, severity, COUNT(*) AS alerts FROM @alerts GROUP BY 1, 2, 3""")

# -- merge, tally, decisions -----------------------------------------------------------------------

_ML = """SELECT s.*, CASE WHEN n % 5 <> 0 THEN n % 3 = 0 END AS ml, CASE WHEN n % 5 <> 0 THEN {conf} END AS conf FROM @scores s"""
view("mlscores", _ML.format(conf="50 + (packets * 7) % 51"))
query("i11_combine_scores", """SELECT link_id, epoch_us(tick) AS tick_start_us,
       round(CASE WHEN ml IS NULL THEN score ELSE LEAST(100, comb) END, 6) AS score,
       CASE WHEN ml IS NULL THEN is_anomaly WHEN ml AND conf >= 85 OR is_anomaly AND ml OR is_anomaly AND score >= 70
              OR ml AND conf >= 70 OR comb >= 60 THEN TRUE ELSE is_anomaly END AS is_anomaly,
       ml AS ml_prediction, round(COALESCE(conf, 0)::DOUBLE, 6) AS ml_confidence,
       CASE WHEN ml IS NULL THEN 'UNKNOWN' WHEN ml THEN 'SYN_Flood' ELSE 'BENIGN' END AS attack_type,
       CASE WHEN ml IS NULL THEN 'statistical' WHEN ml AND conf >= 85 THEN 'ml' WHEN is_anomaly AND ml THEN 'hybrid'
            WHEN is_anomaly AND score >= 70 THEN 'statistical' WHEN ml AND conf >= 70 THEN 'ml'
            WHEN comb >= 60 THEN 'hybrid' ELSE 'statistical' END AS detection_source,
       CAST(CASE WHEN reasons = '' THEN 0 ELSE length(reasons) - length(replace(reasons, '|', '')) + 1 END
            + COALESCE(ml, FALSE)::INT AS BIGINT) AS reasons,
       CAST(CASE WHEN n = 1 THEN 0 ELSE 2 + (pps_sigma IS NOT NULL)::INT + (change_rate IS NOT NULL)::INT
              + 3 * (proto_packets > 0)::INT + 2 * (sources > 0)::INT END + 2 * (ml IS NOT NULL)::INT AS BIGINT) AS metrics
FROM (SELECT *, score + CASE WHEN ml THEN conf * 0.3::DOUBLE ELSE 0 END AS comb FROM @mlscores)""")
query("i14_decision_matrix", """SELECT CASE WHEN s >= 70 AND m >= 85 THEN 'HIGH CONFIDENCE ATTACK' WHEN s >= 70 OR m >= 85 THEN 'MEDIUM CONFIDENCE'
       WHEN c >= 60 THEN 'PROBABLE ATTACK' ELSE 'BENIGN' END AS decision, COUNT(*) AS rows
FROM (SELECT event_id % 101 AS s, event_id % 97 + 4 AS m, event_id % 89 AS c FROM events) GROUP BY 1""")
query("d17_scoring_tally", """SELECT link_id, COUNT(ml) AS ml_predictions, COUNT(*) FILTER (ml) AS ml_attacks,
       COUNT(*) FILTER (CASE WHEN ml IS NULL THEN is_anomaly WHEN ml THEN TRUE WHEN is_anomaly AND score >= 70 THEN TRUE
                             WHEN score >= 60 THEN TRUE ELSE is_anomaly END) AS anomalies
FROM @mlscores GROUP BY 1""")

# -- profile ---------------------------------------------------------------------------------------


def _learned(since):
    return f"""
SELECT link_id, AVG(pps) AS avg_pps, MAX(pps) AS peak_pps, AVG(bps) AS avg_bps, MAX(bps) AS peak_bps,
       arg_max(tcp_ratio, tick) AS tcp_ratio, arg_max(udp_ratio, tick) AS udp_ratio, arg_max(icmp_ratio, tick) AS icmp_ratio,
       COUNT(*) AS learning_samples, MIN(t0) AS learn_start
FROM (SELECT *, MIN(tick) OVER (PARTITION BY link_id) AS t0 FROM @ticks WHERE tick >= TIMESTAMP '{since}')
WHERE tick < t0 + INTERVAL 7 DAY GROUP BY 1"""


view("learned", _learned("1970-01-01"))
view("relearned", _learned("2024-01-15 03:00:00"))
_PROFILE = """SELECT link_id, round(avg_pps, 6) AS avg_pps, round(peak_pps, 6) AS peak_pps, round(avg_bps, 6) AS avg_bps,
       round(peak_bps, 6) AS peak_bps, round(tcp_ratio, 6) AS tcp_ratio, round(udp_ratio, 6) AS udp_ratio,
       round(icmp_ratio, 6) AS icmp_ratio, learning_samples"""
query("d11_learn_profile", _PROFILE + " FROM @learned")
query("a8_a9_profile", _PROFILE + ", epoch_us(learn_start) AS learn_start_us FROM @learned")
query("d21_relearn_profile", _PROFILE + ", epoch_us(learn_start) AS learn_start_us FROM @relearned")
view("later", """
SELECT link_id, tick, pps, bps, i, p0, b0, pk, bk
FROM (SELECT t.link_id, t.tick, t.pps, t.bps, l.avg_pps AS p0, l.avg_bps AS b0, l.peak_pps AS pk, l.peak_bps AS bk,
             ROW_NUMBER() OVER (PARTITION BY t.link_id ORDER BY t.tick) - 1 AS i
      FROM @ticks t JOIN @learned l ON l.link_id = t.link_id AND t.tick >= l.learn_start + INTERVAL 7 DAY)""")
MATERIALIZED.add("later")
view("ema", """
SELECT link_id, tick, i, p0 AS ap, b0 AS ab, pk, bk FROM @later WHERE i = 0
UNION ALL
SELECT l.link_id, l.tick, l.i, 0.95::DOUBLE * e.ap + 0.05::DOUBLE * l.pps, 0.95::DOUBLE * e.ab + 0.05::DOUBLE * l.bps,
       GREATEST(e.pk, l.pps), GREATEST(e.bk, l.bps)
FROM ema e JOIN @later l ON l.link_id = e.link_id AND l.i = e.i + 1""")
_EMA = "round(ap, 6) AS avg_pps, round(ab, 6) AS avg_bps, round(pk, 6) AS peak_pps, round(bk, 6) AS peak_bps"
query("e7_adapt_profile", f"SELECT link_id, epoch_us(tick) AS tick_start_us, {_EMA} FROM @ema WHERE i > 0")
query("e7_current_profile", f"""SELECT link_id, {_EMA}, epoch_us(tick) AS last_updated_us FROM @ema
WHERE (link_id, i) IN (SELECT link_id, MAX(i) FROM @ema GROUP BY 1)""")
_METRIC_ROWS = [
    ("ddos_total_packets", "counter", "Total packets processed", "p"), ("ddos_total_bytes", "counter", "Total bytes processed", "b"),
    ("ddos_dropped_packets", "counter", "Packets dropped", "0"), ("ddos_tcp_packets", "counter", "TCP packets", "t"),
    ("ddos_udp_packets", "counter", "UDP packets", "u"), ("ddos_cpu_percent", "gauge", "CPU usage percentage", "c"),
    ("ddos_memory_percent", "gauge", "Memory usage percentage", "m"), ("ddos_uptime_seconds", "counter", "System uptime in seconds", "s")]
query("a13_metric_rows", """WITH t AS (SELECT k.*, h.c, h.m FROM
 (SELECT link_id, SUM(packets) AS p, SUM(bytes) AS b, SUM(tcp_packets) AS t, SUM(udp_packets) AS u,
         (epoch_us(MAX(tick)) - epoch_us(MIN(tick))) / 1000000.0::DOUBLE AS s FROM @counts GROUP BY 1) k
 JOIN (SELECT link_id, AVG(cpu_percent) AS c, AVG(memory_percent) AS m FROM
       (SELECT *, ROW_NUMBER() OVER (PARTITION BY link_id ORDER BY ts DESC, seq DESC) AS i FROM @host_metrics) WHERE i <= 60 GROUP BY 1) h
   ON h.link_id = k.link_id)
""" + " UNION ".join(f"SELECT link_id, '{n}' AS name, '{k}' AS type, '{h}' AS help, round(CAST({c} AS DOUBLE), 6) AS value FROM t"
                      for n, k, h, c in _METRIC_ROWS))

# -- features --------------------------------------------------------------------------------------

_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}
view("fticks", "SELECT link_id, tick, COUNT(*) AS packets, SUM(bytes) AS bytes, COUNT(*) FILTER (protocol = 6) AS tcp, "
     + ", ".join(f"COUNT(*) FILTER ((tcp_flags & {b}) <> 0) AS {f}" for f, b in _FLAGS.items()) + " FROM @adm GROUP BY 1, 2")
view("resets", """SELECT DISTINCT 'link' || CAST(user_id % 2 AS VARCHAR) AS link_id, date_trunc('day', ts) AS reset_at
FROM events WHERE user_id < 2""")
view("epticks", """SELECT *, (SELECT COUNT(*) FROM @resets r WHERE r.link_id = t.link_id AND r.reset_at <= t.tick) AS epoch_id FROM @fticks t""")


def _moments(table, frame, key="link_id"):
    series = "".join(
        f", SUM({c}) OVER w AS {n}_sum, MAX({c}) OVER w AS {n}_max, MIN({c}) OVER w AS {n}_min, AVG({c}) OVER w AS {n}_mean, "
        f"STDDEV_POP({c}) OVER w AS {n}_std, VAR_POP({c}) OVER w AS {n}_var"
        for n, c in (("bf", "fb"), ("bb", "bb"), ("iat", "iat"), ("pf", "fp"), ("pb", "bp")))
    flags = "".join(f", SUM({f}) OVER e AS c_{f}" for f in _FLAGS)
    return f"""
SELECT *, GREATEST(d / 1000000.0::DOUBLE, 0.001) AS s,
       (bf_sum + bb_sum) / (2.0::DOUBLE * ws) AS pmean,
       (bf_var + bb_var) / 2 + ((bf_mean - bb_mean) / 2) * ((bf_mean - bb_mean) / 2) AS pvar
FROM (SELECT *{series}{flags}, COUNT(*) OVER w AS ws,
             (epoch_us(tick) - epoch_us(MIN(tick) OVER (PARTITION BY {key}))) + 21600000000.0::DOUBLE AS d
      FROM (SELECT *, CAST(trunc(packets * r) AS BIGINT) AS fp, packets - CAST(trunc(packets * r) AS BIGINT) AS bp,
                   CAST(trunc(bytes * r) AS BIGINT) AS fb, bytes - CAST(trunc(bytes * r) AS BIGINT) AS bb,
                   (epoch_us(tick) - epoch_us(LAG(tick) OVER (PARTITION BY {key} ORDER BY tick))) / 1000.0::DOUBLE AS iat
            FROM (SELECT *, CASE WHEN SUM(tcp) OVER k / SUM(packets) OVER k > 0.5 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS r
                  FROM @{table} WINDOW k AS (PARTITION BY {key} ORDER BY tick)))
      WINDOW w AS (PARTITION BY {key} ORDER BY tick ROWS BETWEEN {frame} PRECEDING AND CURRENT ROW),
             e AS (PARTITION BY {key} ORDER BY tick))"""


view("frame40", _moments("fticks", 39))
view("frame1000", _moments("fticks", 999))
view("epframe", _moments("epticks", 39, "link_id, epoch_id"))

_FEATURE_SQL = {
    "Flow Duration": "d", "Total Fwd Packets": "pf_sum", "Total Backward Packets": "pb_sum",
    "Total Length of Fwd Packets": "bf_sum", "Total Length of Bwd Packets": "bb_sum",
    "Flow Bytes/s": "(bf_sum + bb_sum) / s", "Flow Packets/s": "(pf_sum + pb_sum) / s",
    "Fwd Header Length": "pf_sum * 40", "Bwd Header Length": "pb_sum * 40", "Fwd Packets/s": "pf_sum / s",
    "Bwd Packets/s": "pb_sum / s", "Min Packet Length": "LEAST(bf_min, bb_min)",
    "Max Packet Length": "GREATEST(bf_max, bb_max)", "Packet Length Mean": "pmean", "Packet Length Std": "sqrt(pvar)",
    "Packet Length Variance": "pvar", "Down/Up Ratio": "CASE WHEN pf_sum > 0 THEN pb_sum / pf_sum ELSE 0 END",
    "Average Packet Size": "CASE WHEN pf_sum + pb_sum > 0 THEN (bf_sum + bb_sum) / (pf_sum + pb_sum) ELSE 0 END",
    "Avg Fwd Segment Size": "CASE WHEN pf_sum > 0 THEN bf_sum / pf_sum ELSE 0 END",
    "Avg Bwd Segment Size": "CASE WHEN pb_sum > 0 THEN bb_sum / pb_sum ELSE 0 END",
    "Fwd PSH Flags": "0", "Bwd PSH Flags": "0", "Fwd URG Flags": "0", "Bwd URG Flags": "0", "CWE Flag Count": "0",
    "ECE Flag Count": "0", "Init_Win_bytes_forward": "65535", "Init_Win_bytes_backward": "65535",
    "Active Mean": "100", "Active Std": "50", "Active Max": "500", "Active Min": "10",
    "Idle Mean": "1000", "Idle Std": "500", "Idle Max": "5000", "Idle Min": "100",
    **{f"{side} Packet Length {m}": f"{c}_{m.lower()}" for side, c in (("Fwd", "bf"), ("Bwd", "bb")) for m in ("Max", "Min", "Mean", "Std")},
    **{f"{part} IAT {m}": f"iat_{m.lower()}" for part in ("Flow", "Fwd", "Bwd") for m in ("Mean", "Std", "Max", "Min")},
    "Fwd IAT Total": "iat_sum", "Bwd IAT Total": "iat_sum",
    **{f"{f.upper()} Flag Count": f"c_{f}" for f in _FLAGS},
}


def _pick(names):
    plain = {"Flow Duration": 'd AS "Flow Duration"'}
    return ", ".join(plain.get(n) or f'round(COALESCE(CAST({_FEATURE_SQL[n]} AS DOUBLE), 0), 6) AS "{n}"' for n in names)


query("b16_split_fwd_bwd", """SELECT link_id, epoch_us(tick) AS tick_start_us, fp AS fwd_packets, CAST(bp AS BIGINT) AS bwd_packets, fb AS fwd_bytes,
       CAST(bb AS BIGINT) AS bwd_bytes FROM @frame40""")
query("e12_feature_frame", """SELECT link_id, epoch_us(tick) AS tick_start_us, bf_max, bf_min, round(bf_mean, 6) AS bf_mean, round(bf_std, 6) AS bf_std,
       round(iat_mean, 6) AS iat_mean, ws AS window_samples FROM @frame40""")
_ALL = _pick(_FEATURE_SQL)
query("h1_h19_flow_features", f"SELECT link_id, epoch_us(tick) AS tick_start_us, {_ALL} FROM @frame40")
query("h1_h19_flow_features_default", f"SELECT link_id, epoch_us(tick) AS tick_start_us, {_ALL} FROM @frame1000")
query("h20_source_windows", """SELECT link_id, epoch_us(tick) AS tick_start_us, src_ip, CAST(SUM(packets) OVER w AS BIGINT) AS window_packets,
       CAST(SUM(bytes) OVER w AS BIGINT) AS window_bytes, COUNT(*) OVER w AS window_ticks,
       ROW_NUMBER() OVER (PARTITION BY link_id, src_ip ORDER BY tick) = 1 AS first_seen
FROM @sources WINDOW w AS (PARTITION BY link_id, src_ip ORDER BY tick ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
_SEEN = """(SELECT c.link_id, c.tick, COUNT(f.src_ip) AS flow_count FROM @counts c
 JOIN (SELECT link_id, src_ip, MIN(tick) AS first FROM @sources GROUP BY 1, 2) f ON f.link_id = c.link_id AND f.first <= c.tick GROUP BY 1, 2)"""
query("h20_flow_counts", f"SELECT link_id, epoch_us(tick) AS tick_start_us, flow_count FROM {_SEEN}")
query("h21_feature_summary", f"""SELECT f.link_id, epoch_us(f.tick) AS tick_start_us, CAST(SUM(fp) OVER e AS BIGINT) AS total_fwd_packets,
       CAST(SUM(bp) OVER e AS BIGINT) AS total_bwd_packets, CAST(SUM(fb) OVER e AS BIGINT) AS total_fwd_bytes,
       CAST(SUM(bb) OVER e AS BIGINT) AS total_bwd_bytes, ws AS window_samples, flow_count AS unique_flows,
       {_pick(["Flow Bytes/s", "Flow Packets/s", "SYN Flag Count", "ACK Flag Count"])}
FROM @frame40 f JOIN {_SEEN} u ON u.link_id = f.link_id AND u.tick = f.tick WINDOW e AS (PARTITION BY f.link_id ORDER BY f.tick)""")
query("h22_feature_epochs", f"""SELECT link_id, CAST(epoch_id AS INTEGER) AS epoch_id, epoch_us(tick) AS tick_start_us,
       {_pick(["Flow Duration", "Total Fwd Packets", "SYN Flag Count", "Flow IAT Mean"])} FROM @epframe""")
query("h_flow_features_true", """SELECT link_id, low_ip, low_port, high_ip, high_port, protocol,
       CAST(MAX(us) - MIN(us) AS DOUBLE) AS "Flow Duration",
       round(CAST(COUNT(*) FILTER (fwd) AS DOUBLE), 6) AS "Total Fwd Packets",
       round(CAST(COUNT(*) FILTER (NOT fwd) AS DOUBLE), 6) AS "Total Backward Packets",
       round(CAST(COALESCE(SUM(bytes) FILTER (fwd), 0) AS DOUBLE), 6) AS "Total Length of Fwd Packets",
       round(COALESCE(MAX(iat), 0), 3) AS flow_iat_max, round(COALESCE(SUM(siat) FILTER (fwd), 0), 3) AS fwd_iat_total,
       round(AVG(bytes), 6) AS "Packet Length Mean", round(STDDEV_POP(bytes), 6) AS "Packet Length Std",
       round(CAST(COUNT(*) FILTER ((tcp_flags & 2) <> 0) AS DOUBLE), 6) AS "SYN Flag Count",
       round(CAST(COUNT(*) FILTER (fwd AND (tcp_flags & 8) <> 0) AS DOUBLE), 6) AS "Fwd PSH Flags"
FROM (SELECT *, from_low = first_value(from_low) OVER f AS fwd, (us - LAG(us) OVER f) / 1000.0::DOUBLE AS iat,
             (us - LAG(us) OVER (PARTITION BY link_id, low_ip, low_port, high_ip, high_port, protocol, from_low ORDER BY us, seq)) / 1000.0::DOUBLE AS siat
      FROM (SELECT *, epoch_us(ts) AS us, CASE WHEN from_low THEN src_ip ELSE dst_ip END AS low_ip, CASE WHEN from_low THEN 0 ELSE dst_port END AS low_port,
                   CASE WHEN from_low THEN dst_ip ELSE src_ip END AS high_ip, CASE WHEN from_low THEN dst_port ELSE 0 END AS high_port
            FROM (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND 0 <= dst_port) AS from_low FROM @adm))
      WINDOW f AS (PARTITION BY link_id, low_ip, low_port, high_ip, high_port, protocol ORDER BY us, seq))
GROUP BY 1, 2, 3, 4, 5, 6""")

# -- prediction scores -----------------------------------------------------------------------------

query("d12_label_counts", "SELECT label, COUNT(*) AS rows FROM @flows GROUP BY 1")
query("d13_confusion", "SELECT label, prediction, COUNT(*) AS rows FROM @predictions GROUP BY 1, 2")
query("d13_confusion_matrix", """SELECT label, COUNT(*) FILTER (prediction = 0) AS predicted_0, COUNT(*) FILTER (prediction = 1) AS predicted_1
FROM @predictions GROUP BY 1""")
query("d14_accuracy", "SELECT round(AVG(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM @predictions")
view("report", """
SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r, support
FROM (SELECT c.class, COUNT(*) FILTER (label = class AND prediction = class) AS tp, COUNT(*) FILTER (prediction = class) AS predicted,
             COUNT(*) FILTER (label = class) AS support
      FROM @predictions, (SELECT label AS class FROM @predictions UNION SELECT prediction FROM @predictions) c GROUP BY 1)""")
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
query("d15_weighted_scores", f"""SELECT round(SUM(p * support) / SUM(support), 6) AS precision, round(SUM(r * support) / SUM(support), 6) AS recall,
       round(SUM({_F1} * support) / SUM(support), 6) AS f1 FROM @report""")
query("d16_class_report", f"SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round({_F1}, 6) AS f1, support FROM @report")
query("d19_binary_rates", """SELECT round(tp / (tp + fn), 6) AS tpr, round(tn / (tn + fp), 6) AS tnr, round(fp / (tn + fp), 6) AS fpr,
       round(tp / (tp + fp), 6) AS precision, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1
FROM (SELECT COUNT(*) FILTER (label = 1 AND prediction = 1) AS tp, COUNT(*) FILTER (label = 0 AND prediction = 1) AS fp,
             COUNT(*) FILTER (label = 1 AND prediction = 0) AS fn, COUNT(*) FILTER (label = 0 AND prediction = 0) AS tn FROM @predictions)""")

# -- learning --------------------------------------------------------------------------------------

query("a6_sample_per_group", "SELECT source_file, LEAST(COUNT(*), 500) AS rows FROM @flows GROUP BY 1")
query("b8_encode_multiclass", """SELECT label, CAST(dense_rank() OVER (ORDER BY trim(label)) - 1 AS DOUBLE) AS code, trim(label) AS name, rows
FROM (SELECT label, COUNT(*) AS rows FROM @flows GROUP BY 1)""")
query("b17_attack_type", f"""SELECT CASE WHEN {_BINARY} = 0 THEN 'BENIGN' WHEN "SYN Flag Count" > 100 AND "ACK Flag Count" < 10 THEN 'SYN_Flood'
       WHEN "Total Fwd Packets" * 300 > 10000 AND "Flow Bytes/s" * 100 > 1000000 THEN 'UDP_Flood'
       WHEN "Total Fwd Packets" * 300 > 5000 THEN 'DrDoS_UDP' ELSE 'DDoS_Generic' END AS attack_type, COUNT(*) AS flows FROM @flows GROUP BY 1""")
query("f6_shuffle", """SELECT *, ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', label, source_file, syns, acks, 42)), label, source_file, syns, acks) AS position
FROM (SELECT label, source_file, CAST("SYN Flag Count" AS BIGINT) AS syns, CAST("ACK Flag Count" AS BIGINT) AS acks FROM @flows)""")
query("g1_union_flows", "SELECT source_file, 2 * COUNT(*) AS rows, COUNT(*) AS acks FROM @flows GROUP BY 1")
query("g6_dedupe_flows", 'SELECT DISTINCT "Flow Duration", "SYN Flag Count", label FROM @flows')
_FLOW_COLUMNS = ["Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
                 "Total Length of Bwd Packets", "Flow Bytes/s", "SYN Flag Count", "ACK Flag Count"]
query("j1_prepare_flows", "SELECT " + ", ".join(
    f'{c} AS "{n}"' for n, c in [(n, f'"{n}"') for n in _FLOW_COLUMNS if n != "Flow Bytes/s"] + [
        ("Flow Bytes/s", """CASE WHEN "SYN Flag Count" % 7 = 0 OR "SYN Flag Count" % 11 = 0 THEN 0 ELSE "Flow Bytes/s" END""")])
    + ", trim(label) AS label, source_file FROM @flows")
query("j2_balance", f"""WITH c AS (SELECT COUNT(*) FILTER ({_BINARY} = 1) AS a, COUNT(*) FILTER ({_BINARY} = 0) AS b FROM @flows)
SELECT trim(label) AS label, CAST(CASE WHEN {_BINARY} = 1 THEN COUNT(*) ELSE MIN(LEAST(b, CAST(trunc(a * 0.3::DOUBLE / (1 - 0.3::DOUBLE)) AS BIGINT))) END AS BIGINT) AS rows
FROM @flows, c GROUP BY label""")


def _split(a, b):
    return f"""WITH c AS (SELECT trim(label) AS label, COUNT(*) AS n FROM @flows GROUP BY 1)
SELECT label, 'train' AS split, CAST(round(n * {a}) AS BIGINT) AS rows FROM c
UNION SELECT label, 'val', CAST(round(n * {b}) - round(n * {a}) AS BIGINT) FROM c
UNION SELECT label, 'test', CAST(n - round(n * {b}) AS BIGINT) FROM c"""


query("j3_split", _split("0.7", "0.8"))
query("j4_split", _split("0.7", "0.85"))
# Trained models: how many rows there are is known, and on all of them the node table has to agree with the model.
_PARTS = f"({_split('0.7', '0.8')})"
for _name in ("j6_forest_nodes", "j7_boosting_nodes", "j17_tree_nodes"):
    query(_name, f"SELECT split, label, rows, rows AS same_prediction, rows AS same_probability FROM {_PARTS}")
query("j17_tree_leaves", f"SELECT CAST(SUM(rows) AS BIGINT) AS rows, 0::BIGINT AS leaves_apart FROM {_PARTS} WHERE split = 'train'")
query("j12_metrics_nodes", """SELECT part, metric, TRUE AS same FROM (VALUES ('val'), ('test')) p(part),
       (VALUES ('accuracy'), ('precision'), ('recall'), ('f1')) m(metric)""")
query("j9_predict_nodes", f"""SELECT label, rows, rows AS same_verdict, rows AS same_probability, rows AS same_confidence, rows AS typed
FROM {_PARTS} WHERE split = 'test'""")
query("j14_train_job_parts", f"""SELECT code, CAST(COUNT(*) - round(COUNT(*) * 0.8) AS BIGINT) AS rows, 8 AS features
FROM (SELECT {_BINARY} AS code FROM @flows) GROUP BY 1""")
query("j15_model_info", "SELECT TRUE AS is_trained, 'random_forest' AS model_type, 8 AS features, 100 AS trees")
query("f5_importance_nodes", "SELECT model, feature, TRUE AS same FROM (VALUES ('random_forest'), ('gradient_boosting'), ('tree')) m(model), (VALUES "
      + ", ".join(f"('{c}')" for c in _FLOW_COLUMNS) + ") f(feature)")
SQL["j10_predict_batch"] = SQL["j9_predict_nodes"].replace("WHERE split = 'test'", "WHERE split = 'val'")
query("j18_folds", f"""SELECT code, CAST(fold AS INTEGER) AS fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS rows
FROM (SELECT {_BINARY} AS code, COUNT(*) AS n FROM @flows GROUP BY 1), range(5) f(fold)""")


def _anova(table, columns, label):
    parts = " UNION ALL ".join(f"""SELECT '{c}' AS feature, AVG("{c}") OVER () AS a, AVG("{c}") OVER (PARTITION BY {label}) AS m,
       "{c}"::DOUBLE AS x, {label} AS class FROM {table}""" for c in columns)
    return f"""SELECT feature, COUNT(*) AS n, COUNT(DISTINCT class) AS k, SUM((m - a) * (m - a)) AS b, SUM((x - m) * (x - m)) AS w FROM ({parts}) GROUP BY 1"""


_F = """SELECT feature, round(CASE WHEN w > 0 THEN (b / (k - 1)) / (w / (n - k)) WHEN b > 0 THEN 'inf'::DOUBLE END, 6) AS f FROM ({})"""
view("features40", "SELECT epoch_us(tick) // 21600000000 % 3 AS class, "
     + ", ".join(f'COALESCE(CAST({e} AS DOUBLE), 0) AS "{n}"' for n, e in _FEATURE_SQL.items()) + " FROM @frame40")
MATERIALIZED.add("features40")
query("j16_anova", _F.format(_anova("@features40", list(_FEATURE_SQL), "class")))
query("j16_anova_flows", _F.format(_anova("@flows", _FLOW_COLUMNS, "trim(label)")))
query("j16_select_by_anova", "SELECT feature FROM (" + _anova("@flows", _FLOW_COLUMNS, _BINARY)
      + ") ORDER BY (b / (k - 1)) / (w / (n - k)) DESC, feature LIMIT 3")
query("j19_quantile_signatures", f"""WITH f AS (SELECT *, CASE WHEN {_BINARY} = 0 THEN 'BENIGN' ELSE trim(label) END AS t FROM @flows),
r AS (SELECT *, COUNT(*) OVER (PARTITION BY t) AS n, """ + ", ".join(
    f'ROW_NUMBER() OVER (PARTITION BY t ORDER BY "{c}") AS r{i}' for i, c in enumerate(["Total Fwd Packets", "Total Length of Fwd Packets", "SYN Flag Count"]))
      + """ FROM f WHERE t <> 'BENIGN' AND "ACK Flag Count" * 2 > 90),
b AS (SELECT t, """ + ", ".join(
    f'MAX("{c}") FILTER (r{i} = ceil(n * {q} - 1e-9)) AS {s}{i}' for i, c in enumerate(["Total Fwd Packets", "Total Length of Fwd Packets", "SYN Flag Count"])
    for s, q in (("l", "0.05"), ("h", "0.95"))) + """ FROM r GROUP BY t),
m AS (SELECT b.t, ANY_VALUE(l0) AS l0, ANY_VALUE(h0) AS h0, ANY_VALUE(l1) AS l1, ANY_VALUE(h1) AS h1, ANY_VALUE(h2) AS h2,
       COUNT(*) FILTER (f.t = b.t) AS mine, COUNT(*) FILTER (f.t = 'BENIGN') AS good,
       COUNT(*) FILTER (f.t = b.t AND hit) AS hit, COUNT(*) FILTER (f.t = 'BENIGN' AND hit) AS bad
      FROM b, LATERAL (SELECT f.t, "Total Fwd Packets" BETWEEN l0 AND h0 AND "Total Length of Fwd Packets" BETWEEN l1 AND h1
        AND "SYN Flag Count" BETWEEN l2 AND h2 AS hit FROM f) f GROUP BY 1)
SELECT t AS attack_type, round(hit / mine, 6) AS matched, round(bad / good, 6) AS false_rate, hit / mine >= 0.7 AND bad / good < 0.9 AS keep,
       round(l0, 6) AS low_0, round(h0, 6) AS high_0, round(l1, 6) AS low_1, round(h1, 6) AS high_1, round(h2, 6) AS high_2 FROM m""")
query("a3_labelled_flows", """SELECT trim(label) AS label, source_file AS file, COUNT(*) AS rows, SUM("SYN Flag Count") AS syns,
       SUM(CASE WHEN source_file < 'file5' THEN "ACK Flag Count" END) AS acks FROM @flows GROUP BY 1, 2""")
query("a5_capped_files", "SELECT source_file AS file, COUNT(*) AS rows FROM @flows WHERE source_file <= 'file3' GROUP BY 1")
query("a7_left_out_files", "SELECT * FROM (SELECT 'read' AS reason, COUNT(DISTINCT source_file) AS files FROM @flows) UNION SELECT 'empty', 1 UNION SELECT 'no label', 1")
query("a4_trimmed_columns", "SELECT c AS name, COUNT(*) AS files FROM (SELECT DISTINCT source_file FROM @flows), (VALUES "
      + ", ".join(f"('{c}')" for c in [*_FLOW_COLUMNS, "label"]) + ") n(c) WHERE c <> 'ACK Flag Count' OR source_file < 'file5' GROUP BY 1")
query("a1_packets_source", """SELECT link_id, protocol, COUNT(*) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes, COUNT(DISTINCT src_ip) AS sources,
       COUNT(*) FILTER (l4_ok) AS complete FROM @packets GROUP BY 1, 2""")
query("a2_counters_source", """SELECT link_id, CAST(cpu AS INTEGER) AS cpu, CAST(SUM(packets) AS BIGINT) AS packets, CAST(SUM(tcp_packets) AS BIGINT) AS tcp_packets,
       CAST(SUM(CASE WHEN link_id = 'link0' THEN icmp_packets ELSE 0 END) AS BIGINT) AS icmp_packets, 0::BIGINT AS dropped_packets
FROM @counters GROUP BY 1, 2""")
query("a12_saved_model", f"""SELECT 'tree' AS model_type, 'DecisionTreeClassificationModel' AS kind, 3 AS stages, CAST(SUM(rows) AS BIGINT) AS rows
FROM {_PARTS} WHERE split = 'train'""")
query("j5_scale_pop", "SELECT " + ", ".join(
    f'round(("{n}" - AVG("{n}") OVER ()) / STDDEV_POP("{n}") OVER (), 6) AS "{n}"' for n in _FLOW_COLUMNS)
    + ", trim(label) AS label FROM @flows")
query("j8_class_weights", f"""SELECT code, rows, round(SUM(rows) OVER () / (2.0::DOUBLE * rows), 6) AS weight
FROM (SELECT {_BINARY} AS code, COUNT(*) AS rows FROM @flows GROUP BY 1)""")
query("j11_predict_untrained", "SELECT FALSE AS is_attack, 'UNKNOWN' AS attack_type, 0.0::DOUBLE AS confidence, COUNT(*) AS rows FROM @flows")
query("j19_mine_signatures", f"""WITH f AS (SELECT *, CASE WHEN {_BINARY} = 0 THEN 'BENIGN' ELSE trim(label) END AS t FROM @flows),
b AS (SELECT t, MIN("Total Fwd Packets") AS l0, MAX("Total Fwd Packets") AS h0, MIN("SYN Flag Count") AS l1, MAX("SYN Flag Count") AS h1
      FROM f WHERE t <> 'BENIGN' AND "ACK Flag Count" * 2 > 90 GROUP BY 1),
m AS (SELECT b.t, l0, h1, COUNT(*) FILTER (f.t = b.t) AS mine, COUNT(*) FILTER (f.t = 'BENIGN') AS good,
             COUNT(*) FILTER (f.t = b.t AND "Total Fwd Packets" BETWEEN l0 AND h0 AND "SYN Flag Count" BETWEEN l1 AND h1) AS hit,
             COUNT(*) FILTER (f.t = 'BENIGN' AND "Total Fwd Packets" BETWEEN l0 AND h0 AND "SYN Flag Count" BETWEEN l1 AND h1) AS bad
      FROM f, b GROUP BY 1, 2, 3)
SELECT t AS attack_type, round(hit / mine, 6) AS matched, round(bad / good, 6) AS false_rate, hit / mine >= 0.9 AND bad / good < 0.001 AS keep,
       round(l0, 6) AS low_0, round(h1, 6) AS high_1 FROM m""")
query("j20_apply_rules", """SELECT CASE WHEN p > 200 AND b / p * 5 < 0.05::DOUBLE AND s > 100 AND a < 10 THEN 'udp_flood' ELSE '' END AS matched_rules, COUNT(*) AS flows
FROM (SELECT "Total Fwd Packets" * 10 AS p, "Total Backward Packets" AS b, "SYN Flag Count" AS s, "ACK Flag Count" AS a FROM @flows) GROUP BY 1""")
query("j21_token_bucket", """SELECT seq, ROW_NUMBER() OVER (PARTITION BY link_id, src_ip, date_trunc('day', ts) ORDER BY seq)
       > CASE src_ip % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS shaped FROM @adm""")

# -- status ----------------------------------------------------------------------------------------

query("l2_baseline_info", """SELECT link_id, round(mean_pps, 6) AS mean_pps, round(std_pps, 6) AS std_pps, round(mean_bps, 6) AS mean_bps,
       round(std_bps, 6) AS std_bps, round(mean_tcp_ratio, 6) AS mean_tcp_ratio, round(mean_udp_ratio, 6) AS mean_udp_ratio,
       round(mean_icmp_ratio, 6) AS mean_icmp_ratio, samples, epoch_us(tick) AS last_updated_us
FROM @prior WHERE (link_id, n) IN (SELECT link_id, MAX(n) FROM @prior GROUP BY 1)""")
query("l4_status_lines", """SELECT link_id, epoch_us(tick) AS tick_start_us, 'Status: ' || printf('%.0f', pps) || ' pps | Baseline: '
       || printf('%.0f', COALESCE(mean_pps, 0)) || ' pps | IPs: ' || sources || ' | Drop rate: 0' AS line FROM @prior WHERE n % 10 = 0""")
query("l5_uptime", """SELECT link_id, round((epoch_us(MAX(tick)) - epoch_us(MIN(tick))) / 1000000.0::DOUBLE, 6) AS uptime_seconds FROM @counts GROUP BY 1""")
query("l3_ml_stats", """SELECT link_id, COUNT(*) AS total_ml_predictions, COUNT(*) FILTER (n % 2 = 0) AS ml_attacks_detected, FALSE AS ml_enabled
FROM @scores GROUP BY 1""")
query("k13_attack_episodes", """SELECT link_id, CAST(episode AS BIGINT) AS episode, epoch_us(MIN(tick)) AS started_us, epoch_us(MAX(tick)) AS ended_us, COUNT(*) AS ticks,
       MAX(score) AS max_score
FROM (SELECT *, SUM(new) OVER (PARTITION BY link_id ORDER BY tick) AS episode
      FROM (SELECT link_id, tick, score, CASE WHEN tick - LAG(tick) OVER (PARTITION BY link_id ORDER BY tick) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new
            FROM @scores WHERE is_anomaly)) GROUP BY 1, 2""")
query("l1_status_snapshot", """SELECT s.link_id, epoch_us(s.tick) AS as_of_us, round(s.pps, 6) AS current_pps, round(s.bps, 6) AS current_bps,
       (SELECT COUNT(*) FROM @adm a WHERE a.link_id = s.link_id) AS packets, round(s.mean_pps, 6) AS mean_pps,
       (SELECT round(avg_pps, 6) FROM @learned l WHERE l.link_id = s.link_id) AS avg_pps,
       (SELECT COUNT(*) FROM @blacklist b WHERE b.link_id = s.link_id AND (removed_at IS NULL OR removed_at > TIMESTAMP '2024-01-25')) AS blocked,
       (SELECT LEAST(10, COUNT(*)) FROM @alerts a WHERE a.link_id = s.link_id) AS alerts,
       (SELECT string_agg(CAST(src_ip AS VARCHAR), ',' ORDER BY p DESC, src_ip) FROM (SELECT link_id, src_ip, COUNT(*) AS p,
          ROW_NUMBER() OVER (PARTITION BY link_id ORDER BY COUNT(*) DESC, src_ip) AS r FROM @adm GROUP BY 1, 2) t WHERE t.link_id = s.link_id AND r <= 10) AS top,
       (SELECT string_agg(severity, ',' ORDER BY ts DESC) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY link_id ORDER BY ts DESC) AS r FROM @alerts) a
          WHERE a.link_id = s.link_id AND r <= 10) AS severities
FROM @scores s WHERE (s.link_id, s.n) IN (SELECT link_id, MAX(n) FROM @scores GROUP BY 1)""")

# -- streams: what has closed by the last packet ---------------------------------------------------

_CLOSED = "tick + INTERVAL 6 HOUR <= (SELECT MAX(date_trunc('millisecond', ts)) FROM @adm)"
query("k1_stream_ticks", f"""SELECT link_id, epoch_us(tick) AS tick_start_us, packets, bytes, 0::BIGINT AS dropped_packets, 0::BIGINT AS dropped_bytes,
       packets AS passed_packets, bytes AS passed_bytes, tcp_packets, udp_packets, icmp_packets, other_packets FROM @counts WHERE {_CLOSED}""")
query("k2_stream_ip_stats", f"""SELECT link_id, epoch_us(tick) AS tick_start_us, src_ip, packets, bytes, syn_count, udp_count FROM @sources WHERE {_CLOSED}""")
query("k3_stream_baseline", f"""SELECT link_id, epoch_us(tick) AS tick_start_us, history AS samples, round(mean_pps, 6) AS mean_pps, round(std_pps, 6) AS std_pps,
       round(pps_sigma, 6) AS pps_sigma, round(change_rate, 6) AS change_rate FROM @prior WHERE {_CLOSED}""")
query("k4_stream_scores", _SCORE + f"@scores WHERE {_CLOSED}")
query("k5_stream_cooldown", SQL["e15_cooldown"].replace("AS ts_us", "AS timestamp_us"))
# The loop takes five slices of six days. A tick is judged in the batch after the first slice whose last packet closes it.
view("slices", """
SELECT *, MAX(m) OVER (ORDER BY k) AS reached FROM (
  SELECT LEAST(GREATEST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // (6 * 86400 * 1000000::BIGINT), 0), 4) AS k,
         MAX(date_trunc('millisecond', ts)) AS m FROM @adm GROUP BY 1)""")
view("judged", "SELECT c.*, (SELECT MIN(k) FROM @slices s WHERE s.reached >= c.tick + INTERVAL 6 HOUR) AS batch FROM @counts c")
view("loop0_list", "SELECT NULL::VARCHAR AS link_id, NULL::BIGINT AS src_ip, NULL::TIMESTAMP AS added_at WHERE FALSE")
for _k in range(5):
    _l = f"loop{_k}"
    view(f"{_l}_sources", f"""
SELECT s.*, l.src_ip IS NOT NULL AS listed, CASE WHEN l.src_ip IS NULL THEN s.packets ELSE 0 END AS seen
FROM @sources s JOIN @judged j ON j.link_id = s.link_id AND j.tick = s.tick AND j.batch = {_k}
LEFT JOIN @{_l}_list l ON l.link_id = s.link_id AND l.src_ip = s.src_ip""")
    view(f"{_l}_left", f"SELECT link_id, tick, src_ip, packets, syn_count FROM @{_l}_sources WHERE NOT listed")
    view(f"{_l}_conc", _concentration(f"{_l}_left", 2))
    view(f"{_l}_ticks", f"""
SELECT p.* EXCLUDE (sources, ip_entropy, top_ratio, syn_heavy), COALESCE(k.sources, 0) AS sources,
       COALESCE(k.ip_entropy, 0) AS ip_entropy, COALESCE(k.top_ratio, 0) AS top_ratio, COALESCE(k.syn_heavy, 0) AS syn_heavy,
       (SELECT COALESCE(SUM(packets), 0) FROM @{_l}_sources s WHERE s.listed AND s.link_id = p.link_id AND s.tick = p.tick) AS dropped_packets,
       (SELECT COALESCE(SUM(bytes), 0) FROM @{_l}_sources s WHERE s.listed AND s.link_id = p.link_id AND s.tick = p.tick) AS dropped_bytes
FROM @prior p JOIN @judged j ON j.link_id = p.link_id AND j.tick = p.tick AND j.batch = {_k}
LEFT JOIN @{_l}_conc k ON k.link_id = p.link_id AND k.tick = p.tick""")
    view(f"{_l}_scores", _scores(f"{_l}_ticks"))
    view(f"loop{_k + 1}_list", f"""
SELECT * FROM @{_l}_list UNION ALL
SELECT link_id, src_ip, MAX(tick + INTERVAL 6 HOUR) FROM (
  SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.link_id, s.tick ORDER BY s.packets DESC, s.src_ip) AS place
  FROM @{_l}_left s JOIN @{_l}_scores a ON a.link_id = s.link_id AND a.tick = s.tick WHERE a.is_anomaly AND s.packets > 3)
WHERE place <= 5 GROUP BY 1, 2""")
    MATERIALIZED.update({f"{_l}_list", f"{_l}_sources", f"{_l}_scores"})
MATERIALIZED.add("judged")
view("loop", " UNION ALL ".join(f"SELECT * FROM @loop{_k}_scores" for _k in range(5)))
query("k6_closed_loop", """SELECT epoch_us(tick) AS timestamp_us, 'ddos_attack' AS type, CASE WHEN score >= 75 THEN 'high' ELSE 'medium' END AS severity,
       'DDoS attack detected (score: ' || printf('%.1f', score) || ')' AS message FROM @loop WHERE is_anomaly""")
query("k6_loop_ticks", """SELECT link_id, epoch_us(tick) AS tick_start_us, packets, CAST(dropped_packets AS BIGINT) AS dropped_packets,
       CAST(dropped_bytes AS BIGINT) AS dropped_bytes, CAST(packets - dropped_packets AS BIGINT) AS passed_packets, sources,
       round(ip_entropy, 6) AS ip_entropy, round(top_ratio, 6) AS top_ratio, syn_heavy, score, is_anomaly, reasons FROM @loop""")
query("k7_stream_profile", f"""SELECT e.link_id, epoch_us(tick) AS tick_start_us, {_EMA}, learning_samples
FROM @ema e JOIN @learned l ON l.link_id = e.link_id WHERE {_CLOSED}""")
query("k8_stream_features", f"SELECT link_id, epoch_us(tick) AS tick_start_us, {_ALL} FROM @frame40 WHERE {_CLOSED}")
query("k2_running_totals", """
WITH p AS (SELECT *, SUM(new) OVER (PARTITION BY link_id, src_ip ORDER BY ts, seq) AS run FROM (
  SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY link_id, src_ip ORDER BY ts, seq) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM @adm))
SELECT link_id, src_ip, epoch_us(MIN(ts)) AS first_us, epoch_us(MAX(ts)) AS last_us, COUNT(*) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes,
       COUNT(*) FILTER (protocol = 6 AND (tcp_flags & 2) <> 0) AS syn_count, COUNT(*) FILTER (protocol = 17) AS udp_count
FROM p WHERE (link_id, src_ip, run) IN (SELECT link_id, src_ip, MAX(run) FROM p GROUP BY 1, 2) GROUP BY link_id, src_ip""")
# An entry is evicted by the tenth other key of its shard after its last packet; a packet begins an entry when its key has
# none, was silent for a day, or met ten other keys since.
view("shards", """
SELECT *, ROW_NUMBER() OVER w AS i, LAG(ts) OVER k AS prev_ts FROM (
  SELECT link_id, CAST('0x' || substr(md5(CAST(src_ip AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS shard, CAST(src_ip AS VARCHAR) AS entry, ts, seq, bytes
  FROM @adm) WINDOW w AS (PARTITION BY link_id, shard ORDER BY ts, seq), k AS (PARTITION BY link_id, entry ORDER BY ts, seq)""")
view("places", "SELECT *, LAG(i) OVER (PARTITION BY link_id, entry ORDER BY i) AS prev_i, LEAD(i) OVER (PARTITION BY link_id, entry ORDER BY i) AS next_i FROM @shards")
view("pushed", """
SELECT p.link_id, p.shard, p.i, MIN(q.ts) AS out_ts FROM @places p JOIN (
  SELECT p.link_id, p.shard, p.i, q.ts, ROW_NUMBER() OVER (PARTITION BY p.link_id, p.shard, p.i ORDER BY q.i) AS nth
  FROM @places p JOIN @places q ON q.link_id = p.link_id AND q.shard = p.shard AND q.i > p.i AND COALESCE(q.prev_i, 0) < p.i
    AND q.i < COALESCE(p.next_i, 1000000000) AND q.entry <> p.entry) q
  ON q.link_id = p.link_id AND q.shard = p.shard AND q.i = p.i WHERE nth = 10 GROUP BY 1, 2, 3""")
view("entries", """
SELECT link_id, shard, entry, MIN(ts) AS first_ts, MAX(ts) AS last_ts, COUNT(*) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes,
       last(out_ts ORDER BY i) AS out_ts, last(next_ts ORDER BY i) AS next_ts
FROM (SELECT *, SUM(new) OVER (PARTITION BY link_id, entry ORDER BY i) AS run, LEAD(ts) OVER (PARTITION BY link_id, entry ORDER BY i) AS next_ts
  FROM (SELECT s.*, o.out_ts, CASE WHEN prev_ts IS NULL OR s.ts - prev_ts >= INTERVAL 1 DAY
          OR LAG(o.out_ts) OVER (PARTITION BY s.link_id, s.entry ORDER BY s.i) IS NOT NULL THEN 1 ELSE 0 END AS new
        FROM @shards s LEFT JOIN @pushed o ON o.link_id = s.link_id AND o.shard = s.shard AND o.i = s.i))
GROUP BY link_id, shard, entry, run""")
MATERIALIZED.update({"shards", "places", "pushed"})
_ENTRY = """SELECT link_id, entry, epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us, packets, bytes,
       CASE WHEN out_ts - last_ts < INTERVAL 1 DAY THEN 'evicted' WHEN out_ts IS NOT NULL OR next_ts IS NOT NULL {} THEN 'idle' END AS ended FROM @entries"""
query("k9_bounded_table", _ENTRY.format(""))
query("k9_stream_bounded_table", "SELECT * FROM (" + _ENTRY.format(
    "OR last_ts + INTERVAL 1 DAY <= (SELECT MAX(date_trunc('millisecond', ts)) FROM @adm)") + ") WHERE ended IS NOT NULL")
query("k14_late_packets", """
WITH p AS (SELECT *, LEAST(GREATEST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // (216000 * 1000000::BIGINT), 0)
    + CASE WHEN seq % 50 = 7 THEN 2 ELSE 0 END, 11) AS batch FROM @packets),
m AS (SELECT batch, MAX(MAX(date_trunc('millisecond', ts))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM p GROUP BY batch)
SELECT batch, link_id, seq, bytes FROM p JOIN m USING (batch)
WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= reached - INTERVAL 6 HOUR""")
query("k10_profile_restart", f"""SELECT e.link_id, epoch_us(tick) AS tick_start_us, {_EMA}, learning_samples, TRUE AS is_learned
FROM @ema e JOIN @learned l ON l.link_id = e.link_id WHERE {_CLOSED}
QUALIFY ROW_NUMBER() OVER (PARTITION BY e.link_id ORDER BY tick DESC) = 1""")
query("k3_baseline_batches", SQL["k3_stream_baseline"])
query("k5_cooldown_batches", SQL["k5_stream_cooldown"])
query("k11_alert_sink", "SELECT epoch_us(ts) AS timestamp_us, type, 'medium' AS severity, link_id || ' ' || seq AS message FROM @candidates")
query("k12_sliding_counters", """SELECT link_id, epoch_us(w) AS window_start_us, COUNT(*) AS packets, CAST(SUM(bytes) AS BIGINT) AS bytes
FROM (SELECT link_id, bytes, tick - to_hours(6 * k) AS w FROM @adm, range(4) r(k))
WHERE w + INTERVAL 1 DAY <= (SELECT MAX(date_trunc('millisecond', ts)) FROM @adm) GROUP BY 1, 2""")
query("k13_stream_episodes", """SELECT link_id, epoch_us(MIN(ts)) AS started_us, epoch_us(MAX(ts) + INTERVAL 1 HOUR) AS closed_us, COUNT(*) AS ticks
FROM (SELECT *, SUM(new) OVER (PARTITION BY link_id ORDER BY ts, seq) AS g
      FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY link_id ORDER BY ts, seq) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new
            FROM @candidates WHERE type = 'error'))
GROUP BY link_id, g HAVING MAX(ts) + INTERVAL 1 HOUR <= (SELECT MAX(date_trunc('millisecond', ts)) FROM @candidates WHERE type = 'error')""")
query("c3_attach_baseline", """SELECT t.link_id, epoch_us(t.tick) AS tick_start_us, epoch_us(b.tick + INTERVAL 3 HOUR) AS valid_from_us,
       round(b.mean_pps, 6) AS mean_pps, round(b.std_pps, 6) AS std_pps, b.history
FROM @ticks t LEFT JOIN @prior b ON b.link_id = t.link_id AND b.n = (SELECT MAX(p.n) FROM @prior p
     WHERE p.link_id = t.link_id AND p.n % 8 = 0 AND p.tick + INTERVAL 3 HOUR <= t.tick)""")
query("i12_rules_alone", """SELECT link_id, epoch_us(tick) AS tick_start_us, score, is_anomaly, 0.0::DOUBLE AS ml_confidence, 'UNKNOWN' AS attack_type,
       'statistical' AS detection_source FROM @scores""")
