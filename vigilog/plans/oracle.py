"""The same results in plain SQL, for a second engine to check.

Fixtures are spelled out again here and the deviation logic is its closed form:
first batch per value, smallest of those per profiler, joins.
"""

from __future__ import annotations

# --- fixtures ----------------------------------------------------------------

EVENT = """
ev AS (
  SELECT event_id, event_id // 50 AS batch_id, event_type, user_id, ts,
    'AIDA' || user_id AS principal,
    'arn:aws:iam::' || (100000000000 + user_id % 5) || ':user/u' || user_id AS arn,
    CASE WHEN user_id % 37 = 0 THEN 'AIDA' || user_id
         ELSE CAST(100000000000 + user_id % 5 AS VARCHAR) END AS account,
    CASE WHEN event_id % 4 = 0 THEN 'ASIA' || event_id ELSE 'AKIA' || (user_id % 97) END AS access_key,
    CASE WHEN event_id % 50 = 7 THEN 'ec2.amazonaws.com'
         ELSE (11 + least(user_id % 30, event_id // 300)) || '.' || (user_id % 256) || '.' ||
              (event_id % 4) || '.' || (1 + user_id % 200) END AS ip,
    CASE WHEN event_id % 50 <> 7 THEN 11 + least(user_id % 30, event_id // 300) END AS octet
  FROM events)
"""

EVENT_TEXT = """
texts AS (
  SELECT event_id, '{"eventVersion":"1.02","userIdentity":{"type":"IAMUser","principalId":"' || principal ||
    '","arn":"' || arn || '","accountId":"' || account || '","accessKeyId":"' || access_key ||
    '"},"eventTime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","eventSource":"' || event_type ||
    '.amazonaws.com","eventName":"' || event_type || '","awsRegion":"us-west-2","sourceIPAddress":"' || ip ||
    '","eventID":"e' || event_id || '"}' AS event_json
  FROM ev)
"""

GEO = """
geo AS (
  SELECT 11 + n_nationkey AS octet, r_name AS country,
    CASE WHEN n_nationkey % 9 = 4 THEN NULL ELSE n_name END AS city
  FROM nation JOIN region ON n_regionkey = r_regionkey)
"""

EXITS = """
exits AS (
  SELECT DISTINCT (11 + s_suppkey % 30) || '.' || (s_suppkey % 256) || '.' || (s_suppkey % 4) || '.' ||
    (1 + s_suppkey % 200) AS ip
  FROM supplier WHERE s_suppkey % 3 = 0)
"""

PLACES = """
places AS (
  SELECT DISTINCT ip,
    CASE WHEN g.octet IS NULL THEN 'Unknown' ELSE g.city END AS city,
    CASE WHEN g.octet IS NULL THEN 'Unknown' ELSE g.country END AS country
  FROM ev LEFT JOIN geo g ON g.octet = ev.octet)
"""


def observations(batch: str = "batch_id") -> str:
    return f"""
obs AS (
  SELECT DISTINCT {batch} AS batch_id, f.field, f.value FROM ev,
    LATERAL (VALUES ('sourceIPAddress', ip), ('accessKeyId', access_key),
                    ('arn', arn), ('principalId', principal)) f(field, value))
"""


SEEN = """
seen AS (
  SELECT DISTINCT * FROM (
    SELECT 'accessKeyId' AS profiler, 'deviation' AS kind, batch_id, value FROM obs
      WHERE field = 'accessKeyId' AND NOT starts_with(value, 'ASIA')
    UNION ALL SELECT field, 'deviation', batch_id, value FROM obs
      WHERE field IN ('arn', 'principalId', 'sourceIPAddress')
    UNION ALL SELECT 'SourceIP-City', 'deviation', batch_id, city
      FROM obs JOIN places ON ip = value WHERE field = 'sourceIPAddress'
    UNION ALL SELECT 'SourceIP-Country', 'deviation', batch_id, country
      FROM obs JOIN places ON ip = value WHERE field = 'sourceIPAddress'
    UNION ALL SELECT 'SourceIP-Network', 'deviation', batch_id,
        split_part(value, '.', 1) || '.' || split_part(value, '.', 2)
      FROM obs WHERE field = 'sourceIPAddress' AND regexp_full_match(value, '[0-9.]+')
    UNION ALL SELECT 'SourceIP-TorExitNode', 'tor', batch_id, value
      FROM obs JOIN exits ON ip = value WHERE field = 'sourceIPAddress')
  WHERE profiler IN ({profilers}))
"""

FIRST = """
first_seen AS (
  SELECT profiler, value, min(batch_id) AS first_batch FROM seen WHERE kind = 'deviation' GROUP BY 1, 2),
base AS (SELECT profiler, min(first_batch) AS baseline FROM first_seen GROUP BY 1),
fresh AS (
  SELECT profiler, first_batch AS batch_id, value FROM first_seen JOIN base USING (profiler)
  WHERE first_batch > baseline),
judged AS (
  SELECT s.profiler, s.batch_id, s.value, f.first_batch = s.batch_id AS is_new
  FROM seen s JOIN first_seen f ON f.profiler = s.profiler AND f.value IS NOT DISTINCT FROM s.value
  WHERE s.kind = 'deviation'),
counts AS (
  SELECT profiler, batch_id, count(*) AS n_current,
    CAST(count(*) FILTER (WHERE is_new) AS BIGINT) AS n_new FROM judged GROUP BY 1, 2),
dev AS (
  SELECT c.profiler, c.batch_id, n_new, n_current, n_current - n_new AS n_intersection,
    (SELECT count(*) FROM first_seen f WHERE f.profiler = c.profiler AND f.first_batch < c.batch_id) AS n_profile
  FROM counts c JOIN base USING (profiler) WHERE n_new > 0 AND c.batch_id > baseline),
sent AS (
  SELECT profiler, batch_id, CAST(1 AS BIGINT) AS messages FROM dev
  UNION ALL SELECT profiler, batch_id, count(*) FROM seen WHERE kind = 'tor' GROUP BY 1, 2)
"""

LISTED = "string_agg(coalesce({v}, 'null'), ',' ORDER BY coalesce({v}, 'null'))"

FIELDS = {
    "accessKeyId": "accessKeyId",
    "arn": "arn",
    "SourceIP-City": "sourceIPAddress",
    "SourceIP-Country": "sourceIPAddress",
    "SourceIP-TorExitNode": "sourceIPAddress",
    "principalId": "principalId",
    "sourceIPAddress": "sourceIPAddress",
}
DEFAULT_NAMES = list(FIELDS)


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + select.strip()


def profiled(select: str, names: list[str] | None = None, batch: str = "batch_id") -> str:
    quoted = ", ".join(f"'{n}'" for n in names or DEFAULT_NAMES)
    return _with(
        EVENT, GEO, EXITS, PLACES, observations(batch), SEEN.format(profilers=quoted), FIRST,
        select=select,
    )


# --- queries -----------------------------------------------------------------

MIXED = """
mixed AS (SELECT event_id FROM events)
"""


def _mixed_rejects() -> str:
    return """
SELECT 'audit' AS source, '{"version":"' || event_id || '"}' AS line, 'no Records list' AS reason
FROM events WHERE event_id % 5 = 2
UNION ALL SELECT 'audit', '{"Records":[{"id":' || event_id, 'not JSON' FROM events WHERE event_id % 5 = 3
"""


def _mixed_children() -> str:
    return """
SELECT '{"id":' || event_id || '}' AS event_json FROM events WHERE event_id % 5 = 0
UNION ALL SELECT '{"id":' || (CASE WHEN event_id = 0 THEN '0' ELSE '-' || event_id END) || '}' FROM events WHERE event_id % 5 = 0
UNION ALL SELECT '"x' || event_id || '"' FROM events WHERE event_id % 5 = 1
UNION ALL SELECT CAST(event_id AS VARCHAR) FROM events WHERE event_id % 5 = 1
"""


ACCESS = """
acc AS (
  SELECT o_orderkey, 'cust' || o_custkey AS "bucketOwner", 'bucket-' || o_orderstatus AS bucket,
    '[' || strftime(o_orderdate, '%d/%b/%Y:%H:%M:%S') || ' +0000]' AS date,
    '10.' || (o_custkey % 256) || '.' || (o_custkey % 7) || '.' || (1 + o_custkey % 200) AS ip,
    'user' || (o_custkey % 50) AS requester, 'REST.' || replace(o_orderpriority, ' ', '-') AS operation,
    'key/' || o_orderkey AS key
  FROM orders)
"""

ADDRESSES = """
addr AS (
  SELECT DISTINCT event_id % 8 AS form, event_id, user_id,
    CASE event_id % 8
      WHEN 0 THEN (event_id % 300) || '.' || (user_id % 256) || '.' || (event_id % 4) || '.7'
      WHEN 1 THEN '::ffff:10.' || (user_id % 256) || '.0.' || (event_id % 256)
      WHEN 2 THEN 'fd00::' || lower(to_hex(event_id % 65536))
      WHEN 3 THEN '[2001:db8:0:0:0:0:' || lower(to_hex(user_id % 65536)) || ':1]'
      WHEN 4 THEN 'host-' || event_id || '.example.com'
      WHEN 5 THEN (event_id % 256) || '.' || user_id
      WHEN 6 THEN '1::2::' || (event_id % 10)
      ELSE '' END AS ip
  FROM events),
longs AS (
  SELECT *, CASE
      WHEN form = 0 AND event_id % 300 < 256
        THEN (event_id % 300) * 16777216 + (user_id % 256) * 65536 + (event_id % 4) * 256 + 7
      WHEN form = 1 THEN 167772160 + (user_id % 256) * 65536 + event_id % 256
      WHEN form = 5 AND user_id < 16777216 AND length(ip) <= 15 THEN (event_id % 256) * 16777216 + user_id
    END AS ip_long
  FROM addr)
"""

NOTICE = """
notes AS (
  SELECT event_id, event_type, event_id % 17 = 0 AS bad, (event_id // 17) % 8 AS kind,
    CASE
      WHEN event_id % 17 <> 0 THEN '{"s3Bucket":"' || event_type || '","s3ObjectKey":["k' || event_id || '"' ||
        CASE WHEN event_id % 3 > 0 THEN ',"l' || event_id || '"' ELSE '' END ||
        CASE WHEN event_id % 3 > 1 THEN ',"k' || event_id || '"' ELSE '' END || ']}'
      WHEN (event_id // 17) % 8 = 2 THEN '{"s3Bucket":"' || event_type || '","x":{"s3Bucket":"' || event_type ||
        '"},"s3ObjectKey":["k"]}'
      WHEN (event_id // 17) % 8 = 3 THEN '{"s3Bucket":"' || event_type || '","s3ObjectKey":[]}'
      WHEN (event_id // 17) % 8 = 4 THEN '{"s3Bucket":"' || event_type || '","s3ObjectKey":[' || event_id ||
        ',"m' || event_id || '"]}'
      WHEN (event_id // 17) % 8 = 5 THEN '{"s3Bucket":"' || event_type || '"}'
      WHEN (event_id // 17) % 8 = 6 THEN '{"s3Bucket":"' || event_type || '","s3ObjectKey":[""]}'
      ELSE 'plain words' END AS message
  FROM events),
bodies AS (
  SELECT *, CASE
      WHEN bad AND kind = 0 THEN '{broken'
      WHEN bad AND kind = 1 THEN '{"Type":"Notification"}'
      ELSE '{"Type":"Notification","Message":"' || replace(message, '"', '\\"') || '"}' END AS line
  FROM notes)
"""

# One text per row; members under a matched member of the same name do not count.
DEEP = """
deep AS (
  SELECT event_id, CAST(CASE event_id % 9
      WHEN 0 THEN '{"arn":"a' || (event_id % 11) || '"}'
      WHEN 1 THEN '{"userIdentity":{"arn":"u' || user_id || '","sessionContext":{"sessionIssuer":{"arn":"i' ||
        (user_id % 7) || '"}},"accessKeyId":"AKIA' || user_id || '"}}'
      WHEN 2 THEN '{"resources":[{"arn":"r1"},{"arn":"r' || (event_id % 5) || '"},{"arn":"r1"}]}'
      WHEN 3 THEN '{"x":{"arn":null},"y":[]}'
      WHEN 4 THEN '{"arn":' || event_id || ',"q":{"w":[[{"accessKeyId":"deep' || user_id || '"}]]}}'
      WHEN 5 THEN '{"arn":{"arn":"inner","accessKeyId":"in' || user_id || '"},"z":{"arn":"o"}}'
      WHEN 6 THEN '{"note":"{\\"arn\\":\\"no\\"}","ARN":"no","list":["arn"]}'
      WHEN 7 THEN '{"arn":true,"accessKeyId":["' || user_id || '"]}'
      ELSE '{"arn":"say \\"' || user_id || '\\" \\u00e9"}' END AS JSON) AS doc
  FROM events)
SELECT DISTINCT event_id, t.key AS field,
  CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN '' WHEN t.type = 'NULL' THEN 'null'
       ELSE t.value ->> '$' END AS value
FROM deep, json_tree(deep.doc) t
WHERE t.key IN ('arn', 'accessKeyId')
  AND NOT list_contains(string_split(replace(t.path, '[', '.['), '.'), t.key)
"""

ALERT = """
SELECT d.batch_id, d.profiler, 'CloudTrail Profile Mismatch for ' || d.profiler AS subject,
  n_new, n_current, n_profile, n_intersection, CAST(1 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
  l.new_values
FROM dev d JOIN (SELECT profiler, batch_id, {listed} AS new_values FROM fresh GROUP BY 1, 2) l
  ON l.profiler = d.profiler AND l.batch_id = d.batch_id
""".format(listed=LISTED.format(v="value"))

BODY = """
bodies AS (
  SELECT d.profiler, d.batch_id, CAST(1 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
    'CloudTrail Profile Mismatch for ' || d.profiler AS subject,
    'New activity which doesn''t fit current profile: ' || j.new_list || chr(13) || chr(10) ||
    chr(13) || chr(10) || 'Current activity (including compliant activity): ' || j.all_list || chr(13) || chr(10) ||
    'Current profile (which was not matched): ' ||
      (SELECT {held} FROM first_seen f WHERE f.profiler = d.profiler AND f.first_batch < d.batch_id)
      || chr(13) || chr(10) ||
    'The following is the intersection between the existing profile and new activity: ' ||
      coalesce(j.known_list, '') || chr(13) || chr(10) ||
    chr(13) || chr(10) || 'The profile will be updated (to avoid duplicate alarms)' AS body
  FROM dev d JOIN (
    SELECT profiler, batch_id, {all} AS all_list,
      {all} FILTER (WHERE is_new) AS new_list, {all} FILTER (WHERE NOT is_new) AS known_list
    FROM judged GROUP BY 1, 2) j ON j.profiler = d.profiler AND j.batch_id = d.batch_id)
""".format(held=LISTED.format(v="f.value"), all=LISTED.format(v="value"))

_TOR_TEXT = (
    "'Anonymizing proxy in use with your AWS account' AS subject, "
    "'Activity on your AWS resources has been seen from ' || value || ' which is a Tor exit node.' AS body"
)

ARRIVAL = "event_id * 6 // (SELECT max(event_id) + 1 FROM events)"


def _status(batches: str, extra: str = "") -> str:
    grid = ", ".join(f"('{p}', '{f}')" for p, f in FIELDS.items())
    return f"""
SELECT g.batch_id, g.profiler, g.field, g.alert_count, g.messages, g.update_count{extra},
  'The ' || g.profiler || ' profiler for the field ' || g.field || ' has issued ' || g.alert_count || ' alerts.' AS line
FROM (
  SELECT b.batch_id, p.profiler, p.field,
    count(s.profiler) OVER w AS alert_count,
    CAST(coalesce(sum(s.messages) OVER w, 0) AS BIGINT) AS messages,
    count(*) OVER w AS update_count
  FROM (SELECT DISTINCT {batches} AS batch_id FROM ev) b
  CROSS JOIN (VALUES {grid}) p(profiler, field)
  LEFT JOIN sent s ON s.profiler = p.profiler AND s.batch_id = b.batch_id
  WINDOW w AS (PARTITION BY p.profiler ORDER BY b.batch_id)) g
"""


NETWORKS = """
four AS (
  SELECT ((c_custkey % 256) * 16777216 + (c_custkey * 7 % 256) * 65536 + (c_custkey % 4) * 64 * 256)
      >> (17 - c_custkey % 10) AS bits, 15 + c_custkey % 10 AS plen,
    CASE WHEN c_custkey % 9 > 0 THEN 'city ' || c_custkey END AS city, n_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_nationkey * 9, 8, 'all ' || n_name, n_name FROM nation),
six AS (
  SELECT (n_nationkey * 2048) >> (16 - n_nationkey % 6) AS bits, 112 + n_nationkey % 6 AS plen,
    'all ' || n_name AS city, n_name AS country FROM nation),
under AS (
  SELECT ip, plen, city, country FROM longs
    JOIN four ON ip_long >> (32 - plen) = bits AND ip_long IS NOT NULL
  UNION ALL SELECT ip, plen, city, country FROM longs
    JOIN six ON (event_id % 65536) >> (128 - plen) = bits AND form = 2),
best AS (
  SELECT DISTINCT ON (ip) ip, city, country FROM under
  ORDER BY ip, plen DESC, city DESC NULLS LAST, country DESC NULLS LAST)
"""


ORACLE: dict[str, str] = {
    "audit_distinct_principals": _with(
        EVENT,
        select="""SELECT DISTINCT principal AS "principalId", ip AS "sourceIPAddress",
        access_key AS "accessKeyId" FROM ev ORDER BY "accessKeyId" NULLS FIRST""",
    ),
    "audit_root_usage": _with(
        EVENT,
        select="""SELECT DISTINCT event_type || '.amazonaws.com' AS "eventSource",
        event_type AS "eventName", principal AS "principalId" FROM ev WHERE principal = account""",
    ),
    "audit_geo_lookup": _with(
        EVENT, GEO, PLACES, select='SELECT ip AS "sourceIPAddress", city, country FROM places'
    ),
    "audit_geo_sql_functions": _with(
        EVENT, GEO, PLACES, select='SELECT ip AS "sourceIpAddress", city, country FROM places'
    ),
    "audit_source_catalogue": """
        SELECT DISTINCT event_type AS bucket,
          CASE WHEN user_id % 5 > 0 THEN 'p' || (user_id % 5) END AS prefix FROM events""",
    "audit_object_listing": """
        SELECT DISTINCT event_type AS bucket, 'p' || (event_id % 7) || '/o' || event_id || '.json.gz' AS key
        FROM events e WHERE event_id % 3 = 0 AND EXISTS (
          SELECT 1 FROM events s WHERE s.event_type = e.event_type
            AND (s.user_id % 5 = 0 OR s.user_id % 5 = e.event_id % 7))""",
    "audit_unnest_records": _with(EVENT, EVENT_TEXT, select="SELECT event_json FROM texts"),
    "audit_unnest_all_fields": _mixed_children(),
    "audit_line_rejects": _mixed_rejects(),
    "access_parse": _with(
        ACCESS,
        select="""SELECT "bucketOwner", bucket, date, ip, requester, operation, key FROM acc
        WHERE o_orderkey % 11 <> 0""",
    ),
    "access_rejects": _with(
        ACCESS,
        select="""SELECT 'access' AS source, "bucketOwner" || ' ' || bucket || ' ' || date || ' ' || ip || ' ' ||
        requester || ' REQ' || o_orderkey || ' ' || operation ||
        CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE '' END AS line,
        'expected at least 9 tokens, found 8' AS reason FROM acc WHERE o_orderkey % 11 = 0""",
    ),
    "access_distinct_ip": _with(
        ACCESS, select="SELECT DISTINCT ip FROM acc WHERE o_orderkey % 11 <> 0"
    ),
    "net_geo_networks": _with(
        ADDRESSES,
        NETWORKS,
        select="""SELECT DISTINCT l.ip, CASE WHEN b.ip IS NULL THEN 'Unknown' ELSE b.city END AS city,
        CASE WHEN b.ip IS NULL THEN 'Unknown' ELSE b.country END AS country
        FROM longs l LEFT JOIN best b ON b.ip = l.ip""",
    ),
    "net_ip_to_long": _with(ADDRESSES, select="SELECT DISTINCT ip, ip_long FROM longs"),
    "net_parse_address": _with(
        ADDRESSES,
        select="""SELECT DISTINCT ip,
        CASE WHEN ip_long IS NOT NULL THEN 0
             WHEN form = 2 THEN -216172782113783808 WHEN form = 3 THEN 2306139568115548160 END AS hi,
        CASE WHEN ip_long IS NOT NULL THEN ip_long + 281470681743360
             WHEN form = 2 THEN event_id % 65536
             WHEN form = 3 THEN (user_id % 65536) * 65536 + 1 END AS lo FROM longs""",
    ),
    "net_tor_nodes": _with(EXITS, select="SELECT ip FROM exits"),
    "net_tor_rejects": """
        SELECT 'exit list' AS source, 'ExitAddress' AS line, 'no address' AS reason
        FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 15 = 1
        UNION ALL SELECT 'exit list', 'ExitAddress 300.1.2.' || (s_suppkey % 256) || ' x', 'not an address'
        FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 15 = 2""",
    "net_tor_events": _with(
        EVENT, EXITS, select='SELECT event_id, ip AS "sourceIPAddress" FROM ev SEMI JOIN exits USING (ip)'
    ),
    "net_tor_flags": _with(
        EVENT,
        EXITS,
        select="""SELECT DISTINCT ip AS "sourceIPAddress", ip IN (SELECT ip FROM exits) AS is_exit FROM ev""",
    ),
    "notify_unwrap": _with(
        NOTICE,
        select="""SELECT event_type AS bucket, 'k' || event_id AS key FROM bodies WHERE NOT bad
        UNION ALL SELECT event_type, 'l' || event_id FROM bodies WHERE NOT bad AND event_id % 3 > 0
        UNION ALL SELECT event_type, 'm' || event_id FROM bodies WHERE bad AND kind = 4""",
    ),
    "notify_rejects": _with(
        NOTICE,
        select="""SELECT 'notification' AS source, line, CASE kind WHEN 0 THEN 'not JSON'
        WHEN 1 THEN 'no Message' WHEN 2 THEN 'expected one s3Bucket, found 2'
        WHEN 3 THEN 'empty s3ObjectKey' WHEN 4 THEN 'key is not text' WHEN 5 THEN 'no s3ObjectKey'
        WHEN 6 THEN 'empty key' ELSE 'Message is not JSON' END AS reason FROM bodies WHERE bad""",
    ),
    "json_deep_values": "WITH " + DEEP.strip(),
    "obs_field_values": _with(EVENT, observations(), select="SELECT batch_id, field, value FROM obs"),
    "obs_profiler_expand": profiled("SELECT profiler, kind, batch_id, value FROM seen"),
    "profile_first_seen": profiled("SELECT profiler, value, first_batch FROM first_seen"),
    "profile_state": profiled(
        f"""SELECT profiler, count(*) AS n, CAST(1 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts,
        {LISTED.format(v='value')} AS listed FROM first_seen GROUP BY 1"""
    ),
    "profile_new_values": profiled("SELECT profiler, batch_id, value FROM fresh"),
    "profile_known_values": profiled(
        "SELECT profiler, batch_id, value FROM judged WHERE NOT is_new"
    ),
    "profile_compliance": profiled(
        "SELECT profiler, batch_id, n_current, n_new = 0 AS compliant FROM counts"
    ),
    "alerts_access_key": profiled(ALERT, ["accessKeyId"]),
    "alerts_arn": profiled(ALERT, ["arn"]),
    "alerts_principal": profiled(ALERT, ["principalId"]),
    "alerts_source_ip": profiled(ALERT, ["sourceIPAddress"]),
    "alerts_city": profiled(ALERT, ["SourceIP-City"]),
    "alerts_country": profiled(ALERT, ["SourceIP-Country"]),
    "alerts_custom_network": profiled(ALERT, ["SourceIP-Network"]),
    "alerts_tor": profiled(
        f"SELECT profiler, batch_id, value AS address, {_TOR_TEXT} FROM seen",
        ["SourceIP-TorExitNode"],
    ),
    "alert_values": profiled(
        """SELECT j.profiler, j.batch_id, unnest(['current',
          CASE WHEN is_new THEN 'new' ELSE 'intersection' END]) AS section, j.value
        FROM judged j JOIN dev ON dev.profiler = j.profiler AND dev.batch_id = j.batch_id"""
    ),
    "alert_bodies": profiled(f", {BODY.strip()} SELECT * FROM bodies"),
    "alert_counts_running": profiled(
        """SELECT profiler, batch_id,
        count(*) OVER (PARTITION BY profiler ORDER BY batch_id) AS alert_count FROM sent"""
    ),
    "profile_status": profiled(_status("batch_id")),
    "stream_alerts": profiled(
        "SELECT profiler, batch_id, n_new, n_current, n_profile, n_intersection FROM dev",
        batch=ARRIVAL,
    ),
    "stream_alert_messages": profiled(
        f""", {BODY.strip()}
        SELECT profiler, batch_id, NULL AS address, part, parts, subject, body FROM bodies
        UNION ALL SELECT profiler, batch_id, value, 1, 1, {_TOR_TEXT} FROM seen WHERE kind = 'tor'""",
        batch=ARRIVAL,
    ),
    "stream_status": profiled(
        _status(
            ARRIVAL,
            """, (SELECT count(*) FROM first_seen f
            WHERE f.profiler = g.profiler AND f.first_batch <= g.batch_id) AS profile_size""",
        ),
        batch=ARRIVAL,
    ),
    "stream_notified_events": "SELECT 'e' || event_id AS event_id FROM events",
}
ORACLE["audit_saved_table"] = ORACLE["audit_root_usage"]
ORACLE["access_saved_table"] = ORACLE["access_distinct_ip"]
ORACLE["stream_both_inputs"] = ORACLE["stream_notified_events"]
ORACLE["stream_rejects"] = ORACLE["audit_line_rejects"]
ORACLE["audit_place_function"] = ORACLE["audit_geo_sql_functions"]

_DEEP_FIELDS = """
    CASE WHEN event_id % 9 = 1 THEN 'u' || user_id END AS identity_arn,
    CASE WHEN event_id % 9 = 4 THEN 'deep' || user_id END AS deep_key,
    CASE WHEN event_id % 9 = 5 THEN 'o' END AS z_arn,
    CASE WHEN event_id % 9 = 6 THEN 'arn' END AS listed,
    CASE WHEN event_id % 9 = 6 THEN '{"arn":"no"}' END AS note"""
ORACLE["audit_variant_fields"] = f"""
SELECT event_id, {_DEEP_FIELDS},
    CASE WHEN event_id % 9 IN (0, 8) THEN 'STRING' WHEN event_id % 9 = 4 THEN 'BIGINT' WHEN event_id % 9 = 7 THEN 'BOOLEAN'
         WHEN event_id % 9 = 5 THEN 'OBJECT<accessKeyId: STRING, arn: STRING>' END AS arn_type
FROM events"""
ORACLE["audit_inferred_columns"] = f"""
SELECT {_DEEP_FIELDS}, CASE WHEN event_id % 9 = 2 THEN 'r' || (event_id % 5) END AS second_resource FROM events"""

# Objects of 500 events: whole, cut after the even ones, missing, empty, or no gzip.
_FAULT = "CASE k % 5 WHEN 1 THEN 'cut after 1 lines' WHEN 2 THEN 'missing' WHEN 3 THEN 'empty' WHEN 4 THEN 'not gzip' END"
ORACLE["stream_object_rejects"] = f"""
WITH o AS (SELECT event_id, event_id // 500 AS k FROM events)
SELECT k AS object, 'e' || event_id AS event_id, NULL AS reason FROM o WHERE k % 5 = 0 OR (k % 5 = 1 AND event_id % 2 = 0)
UNION ALL SELECT DISTINCT k, NULL, {_FAULT} FROM o WHERE k % 5 > 0"""
ORACLE["stream_replay_rejects"] = f"""
SELECT DISTINCT 'object' AS source, event_id // 500 AS object, {_FAULT.replace("k %", "event_id // 500 %")} AS reason
FROM events WHERE (event_id // 500) % 5 IN (1, 3, 4)"""
ORACLE["stream_ingested_counts"] = f"SELECT {ARRIVAL} AS batch_id, count(*) AS events FROM events GROUP BY 1"
ORACLE["alerts_frequency"] = _with(
    EVENT, GEO, PLACES, """
each AS (
  SELECT 'accessKeyId' AS profiler, batch_id, access_key AS value FROM ev WHERE NOT starts_with(access_key, 'ASIA')
  UNION ALL SELECT 'arn', batch_id, arn FROM ev
  UNION ALL SELECT 'principalId', batch_id, principal FROM ev
  UNION ALL SELECT 'sourceIPAddress', batch_id, ip FROM ev
  UNION ALL SELECT 'SourceIP-City', batch_id, city FROM ev JOIN places USING (ip)
  UNION ALL SELECT 'SourceIP-Country', batch_id, country FROM ev JOIN places USING (ip)),
shown AS (SELECT profiler, batch_id, value, count(*) AS n FROM each GROUP BY ALL),
history AS (
  SELECT *, count(*) OVER w AS batches, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS events,
    CAST(coalesce(sum(n * n) OVER w, 0) AS BIGINT) AS squares
  FROM shown WINDOW w AS (PARTITION BY profiler, value ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    select="""SELECT *, batches * n > events AS more FROM history
    WHERE batches >= 5 AND (batches * n - events) ** 2 > 9 * (batches * squares - events * events)""",
)
ORACLE["stream_exit_reload"] = _with(
    EVENT, f"""
shown AS (SELECT DISTINCT {ARRIVAL} AS batch_id, ip FROM ev),
batches AS (SELECT DISTINCT batch_id FROM shown),
versions AS (
  SELECT DISTINCT batch_id, (11 + s_suppkey % 30) || '.' || (s_suppkey % 256) || '.' || (s_suppkey % 4) || '.' ||
    (1 + s_suppkey % 200) AS ip
  FROM supplier, batches WHERE s_suppkey % 3 = 0 AND (batch_id IN (1, 4, 5) OR (batch_id = 2 AND s_suppkey % 2 = 0))),
sizes AS (SELECT batch_id, count(*) AS entries FROM versions GROUP BY 1),
sent AS (SELECT batch_id, count(*) AS sightings FROM shown JOIN versions USING (batch_id, ip) GROUP BY 1)""",
    select="""SELECT batch_id, coalesce(entries, 0) AS entries, entries IS NOT NULL AS is_dated,
      CASE WHEN entries IS NULL THEN 'missing or empty' END AS reason, coalesce(sightings, 0) AS sightings
    FROM batches LEFT JOIN sizes USING (batch_id) LEFT JOIN sent USING (batch_id)""",
)

_LATE = "o_orderkey % 7 IN (4, 5, 6)"
_MID = "o_orderkey % 7 IN (2, 4, 5, 6)"
ORACLE["access_full"] = _with(
    ACCESS,
    select=f"""
    SELECT a."bucketOwner", a.bucket, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS time, a.ip, a.requester,
      'REQ' || o_orderkey AS "requestId", a.operation, a.key,
      CASE WHEN {_MID} THEN 'GET /key/' || o_orderkey || ' HTTP/1.1' END AS "requestUri",
      CAST(CASE WHEN {_MID} THEN 200 + o_custkey % 5 END AS INTEGER) AS "httpStatus", CAST(NULL AS VARCHAR) AS "errorCode",
      CAST(CASE WHEN {_MID} THEN o_orderkey * 3 END AS BIGINT) AS "bytesSent",
      CAST(CASE WHEN {_MID} THEN o_orderkey END AS BIGINT) AS "objectSize",
      CAST(CASE WHEN {_LATE} THEN o_custkey END AS BIGINT) AS "totalTime",
      CAST(CASE WHEN {_LATE} THEN 7 END AS BIGINT) AS "turnAroundTime",
      CASE WHEN {_LATE} THEN 'http://r/' || o_custkey END AS referrer,
      CASE WHEN o_orderkey % 7 = 4 THEN 'say "hi" [1]' WHEN {_LATE} THEN 'Agent/1 [x]' END AS "userAgent",
      CAST(NULL AS VARCHAR) AS "versionId", CASE WHEN {_LATE} THEN 'host=' END AS "hostId",
      CASE WHEN {_LATE} THEN 'SigV4' END AS "signatureVersion", CASE WHEN {_LATE} THEN 'AES' END AS "cipherSuite",
      CASE WHEN {_LATE} THEN 'AuthHeader' END AS "authenticationType",
      CASE WHEN {_LATE} THEN 'b.example.com' END AS "hostHeader", CASE WHEN {_LATE} THEN 'TLSv1.2' END AS "tlsVersion",
      CAST(NULL AS VARCHAR) AS "accessPointArn", CASE WHEN {_LATE} THEN 'Yes' END AS "aclRequired",
      CASE WHEN o_orderkey % 7 = 6 THEN 'new "two words"' END AS extra
    FROM acc a JOIN orders o USING (o_orderkey) WHERE o_orderkey % 7 > 0""",
)
ORACLE["access_full_rejects"] = _with(
    ACCESS,
    select="""SELECT 'access' AS source, "bucketOwner" || ' ' || bucket || ' ' || date || ' ' || ip || ' ' || requester ||
      ' REQ' || o_orderkey || ' ' || operation AS line, 'expected at least 8 fields, found 7' AS reason
    FROM acc WHERE o_orderkey % 7 = 0""",
)

_AWAY = """, shown AS (
  SELECT profiler, batch_id, value, lag(batch_id) OVER w AS previous, lead(batch_id) OVER w AS following
  FROM seen WHERE kind = 'deviation' WINDOW w AS (PARTITION BY profiler, value ORDER BY batch_id))"""
ORACLE["profile_expired"] = profiled(
    f"""{_AWAY} SELECT profiler, value, batch_id AS last_batch, batch_id + 22 AS expired_at, following AS returned_at
    FROM shown WHERE coalesce(following, (SELECT max(batch_id) FROM shown)) > batch_id + 21"""
)
ORACLE["alerts_expiring"] = profiled(
    f"""{_AWAY}, n AS (SELECT profiler, batch_id, count(*) AS n_current, count(*) FILTER (WHERE previous IS NULL) AS n_new,
      count(*) FILTER (WHERE batch_id > previous + 21) AS n_returned FROM shown GROUP BY 1, 2)
    SELECT n.*, n_new + n_returned > 0 AND batch_id > baseline AS alerts FROM n JOIN base USING (profiler)"""
)
_ACTORS = "SELECT min({b}) AS batch_id, principal AS actor, ip AS address FROM ev JOIN exits USING (ip) GROUP BY 2, 3"
_ROOT = """SELECT {b} AS batch_id, 'e' || event_id AS event_id, event_type || '.amazonaws.com' AS event_source,
  event_type AS event_name, account FROM ev WHERE principal = account"""
for _name, _select, _batch in (
    ("alerts_tor_actor", _ACTORS, "batch_id"),
    ("stream_tor_actor", _ACTORS, ARRIVAL),
    ("alerts_root", _ROOT, "batch_id"),
    ("stream_root_alerts", _ROOT, ARRIVAL),
):
    ORACLE[_name] = _with(EVENT, EXITS, select=_select.format(b=_batch))
ORACLE["stream_expired"] = profiled(
    f"""{_AWAY} SELECT profiler, value, batch_id AS last_batch
    FROM shown WHERE coalesce(following, (SELECT max(batch_id) FROM shown)) > batch_id + 21""",
    ["accessKeyId", "arn", "principalId", "sourceIPAddress"],
)
