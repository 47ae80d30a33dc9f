"""DuckDB SQL with the same result as each named query."""

from __future__ import annotations

from tidemart.plans.mapping import AS_OF, EVENT_NAMES, RECEIVED_FROM

_LOGS = """logs AS (
  SELECT regexp_extract(props, '"k": *([0-9]+)', 1) AS mid, CAST(user_id AS VARCHAR) AS uid,
         CASE WHEN event_type = 'signup' THEN 'startup' ELSE 'event' END AS type,
         epoch_us(ts) // 1000 AS ts, event_id,
         strftime(ts, '%Y-%m-%d') AS log_date, strftime(ts, '%H') AS log_hour
  FROM events)"""

_FIRST = _LOGS + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mid, log_date ORDER BY ts, event_id) AS rn FROM logs
), first AS (SELECT * FROM ranked WHERE rn = 1)"""

_NEW = _FIRST + """, lifetimes AS (
  SELECT *, row_number() OVER (PARTITION BY mid ORDER BY ts, event_id) AS seen FROM first
), fresh AS (SELECT * FROM lifetimes WHERE seen = 1)"""

_MONEY = "CAST(sum(CAST({} AS DECIMAL(24,4))) AS DOUBLE)"

_PURCHASES = """purchases AS (
  SELECT strftime(ts, '%Y-%m-%d') AS create_date, strftime(ts, '%H') AS create_hour,
         value AS total_amount
  FROM events WHERE event_type = 'purchase')"""

_ORDERS = f"""order_base AS (
  SELECT *, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS created,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL
              WHEN o_orderstatus = 'P' THEN CAST(o_custkey % 1000 AS VARCHAR)
              ELSE '138' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS tel,
         ({RECEIVED_FROM} + o_orderkey % 86400) * 1000 AS rt
  FROM orders
), ord AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id,
         o_totalprice AS total_amount, o_orderstatus AS order_status,
         substr(tel, 1, 4) || '*******' AS consignee_tel,
         strftime(created, '%Y-%m-%d %H:%M:%S') AS create_time,
         strftime(created, '%Y-%m-%d') AS create_date, strftime(created, '%H') AS create_hour,
         rt, o_orderpriority
  FROM order_base)"""

_DETAILS = f"""det AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(l_quantity AS INTEGER)) AS id,
         CAST(l_orderkey AS VARCHAR) AS order_id, p_name AS sku_name,
         CAST(l_partkey AS VARCHAR) AS sku_id, l_extendedprice AS sku_price,
         ({RECEIVED_FROM} + l_orderkey % 86400
          + (l_orderkey * 7 + l_linenumber * 61) % 400 - 200) * 1000 AS rt
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""

_USERS = f"""usr AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS login_name, c_mktsegment AS user_level,
         strftime(DATE '1960-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER), '%Y-%m-%d')
           AS birthday,
         CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
         CAST(trunc(CAST(date_diff('day',
           CAST(DATE '1960-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) AS DATE),
           DATE '{AS_OF}') AS DOUBLE) / 365) AS INTEGER) AS age
  FROM customer WHERE c_acctbal >= 0)"""

_SALES = f"""{_ORDERS}, {_DETAILS}, {_USERS}, sales AS (
  SELECT d.id AS order_detail_id, o.id AS order_id, o.order_status, o.create_time, o.user_id,
         d.sku_id, u.gender AS user_gender, coalesce(u.age, 0) AS user_age, u.user_level,
         d.sku_price, d.sku_name, u.age IS NOT NULL AS age_known, o.create_date AS dt
  FROM det d JOIN ord o ON d.order_id = o.id LEFT JOIN usr u ON o.user_id = u.id)"""

_HITS = _SALES + ", hits AS (SELECT * FROM sales WHERE contains(lower(sku_name), 'ring'))"

_EVID = " ".join(f"WHEN '{kind}' THEN '{evid}'" for kind, evid in EVENT_NAMES.items())
_ALERTS = f"""ev AS (
  SELECT 'mid_' || CAST(user_id % 10 AS VARCHAR) AS mid, CAST(user_id AS VARCHAR) AS uid,
         CASE event_type {_EVID} END AS evid, CAST(event_id AS VARCHAR) AS itemid,
         epoch_us(ts) // 1000 AS ms
  FROM events
), win AS (
  SELECT ev.*, (ms // 1800000 - g.i) * 1800000 AS start_ms
  FROM ev, generate_series(0, 3) AS g(i)
), alert AS (
  SELECT mid, start_ms, start_ms + 7200000 AS end_ms,
         count(DISTINCT CASE WHEN evid = 'coupon' THEN uid END) AS n_users,
         count(DISTINCT CASE WHEN evid = 'coupon' THEN itemid END) AS n_items,
         count(evid) AS n_events
  FROM win GROUP BY mid, start_ms
  HAVING count(DISTINCT CASE WHEN evid = 'coupon' THEN uid END) >= 3
     AND count(CASE WHEN evid = 'clickItem' THEN 1 END) = 0)"""
_ALERT_DOCS = f"""WITH {_ALERTS}
  SELECT mid || '-' || CAST(end_ms // 60000 AS VARCHAR) AS doc_id, mid,
         n_users, n_items, n_events, end_ms AS ts,
         strftime(make_timestamp(end_ms * 1000), '%Y-%m-%d') AS index_day
  FROM alert"""

_ALERT_MEMBERS = f"""WITH {_ALERTS}, listed AS (
    SELECT win.*, end_ms FROM win JOIN alert USING (mid, start_ms)), kinds AS (
    SELECT mid, end_ms, 'user' AS kind, uid AS value FROM listed WHERE evid = 'coupon'
    UNION ALL SELECT mid, end_ms, 'item', itemid FROM listed WHERE evid = 'coupon'
    UNION ALL SELECT mid, end_ms, 'event', evid FROM listed)
  SELECT mid || '-' || CAST(end_ms // 60000 AS VARCHAR) AS doc_id, kind, value, count(*) AS n
  FROM kinds WHERE value IS NOT NULL GROUP BY mid, end_ms, kind, value"""
_ALERTS_FINE = f"""WITH dense AS (
    SELECT 'mid_' || CAST(user_id % 10 AS VARCHAR) AS mid, CAST(user_id AS VARCHAR) AS uid,
           CASE event_type {_EVID} END AS evid, CAST(event_id AS VARCHAR) AS itemid,
           epoch_us(ts) // 1000 // 100 AS ms
    FROM events), win AS (
    SELECT dense.*, (ms // 5000 - g.i) * 5000 AS start_ms FROM dense, generate_series(0, 59) AS g(i))
  SELECT mid, start_ms + 300000 AS end_ms,
         count(DISTINCT CASE WHEN evid = 'coupon' THEN uid END) AS n_users,
         count(DISTINCT CASE WHEN evid = 'coupon' THEN itemid END) AS n_items, count(evid) AS n_events
  FROM win GROUP BY mid, start_ms
  HAVING count(DISTINCT CASE WHEN evid = 'coupon' THEN uid END) >= 3
     AND count(CASE WHEN evid = 'clickItem' THEN 1 END) = 0"""

_HOURS = "SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS hour FROM generate_series(0, 23) AS g(i)"


def _compare(with_sql: str, rows: str, date: str, hour: str, measure: str,
             before: str, day: str) -> str:
    def side(which: str) -> str:
        return f"""coalesce((SELECT {measure} FROM {rows} r
                   WHERE r.{date} = '{which}' AND r.{hour} = h.hour), 0)"""

    return f"""WITH {with_sql}
      SELECT h.hour, CAST({side(before)} AS DOUBLE) AS yesterday,
             CAST({side(day)} AS DOUBLE) AS today
      FROM ({_HOURS}) h"""


def _side_map(date: str) -> str:
    return f"""(SELECT '{{' || string_agg('"' || log_hour || '":' || CAST(ct AS VARCHAR), ','
                ORDER BY log_hour) || '}}' FROM per_hour WHERE log_date = '{date}')"""


_CARD = f"""WITH {_NEW}, {_PURCHASES}
  SELECT 'dau' AS id, '新增日活' AS name,
         CAST((SELECT count(*) FROM first WHERE log_date = '2024-01-15') AS DOUBLE) AS value
  UNION ALL
  SELECT 'new_mid', '新增设备',
         CAST((SELECT count(*) FROM fresh WHERE log_date = '2024-01-15') AS DOUBLE)
  UNION ALL
  SELECT 'order_amount', '新增交易额',
         (SELECT {_MONEY.format('total_amount')} FROM purchases
          WHERE create_date = '2024-01-15')"""

_GENDER = """CASE user_gender WHEN 'M' THEN '男' WHEN 'F' THEN '女' ELSE 'unknown' END"""
_AGE = """CASE WHEN NOT age_known THEN 'unknown' WHEN user_age < 20 THEN '20岁以下'
          WHEN user_age <= 30 THEN '20-30岁' ELSE '30岁以上' END"""


def _facet(label: str) -> str:
    return f"""WITH {_SALES}
      SELECT {label} AS name, count(*) AS value,
             CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM sales) AS share_pct
      FROM sales GROUP BY 1"""


_PAIRS = f"""{_ORDERS}, {_DETAILS}, pairs AS (
  SELECT o.id AS order_id, d.id AS order_detail_id, o.user_id, o.order_status, o.create_time,
         o.create_date, d.sku_id, d.sku_name, d.sku_price, greatest(o.rt, d.rt) AS joined_ms
  FROM ord o JOIN det d ON o.id = d.order_id AND abs(o.rt - d.rt) <= 100000)"""

_LATEST_USERS = """SELECT id, login_name,
  CASE WHEN user_level = 'HOUSEHOLD' THEN 'VIP' ELSE user_level END AS user_level,
  birthday, gender FROM usr"""

_RAW_START = _LOGS + """, raw AS (
  SELECT *, '{"mid":"' || mid || '","uid":"' || uid || '","type":"' || type || '","ts":'
         || CAST(ts AS VARCHAR) || '}' AS value FROM logs)"""


def _user_json(level: str) -> str:
    return f"""'{{"id":"' || id || '","user_level":"' || {level} || '","birthday":"'
             || birthday || '","gender":"' || gender || '"}}'"""


_GMV_HOURS = f"""WITH {_ORDERS}
  SELECT create_date, create_hour, {_MONEY.format('total_amount')} AS sum_amount
  FROM ord GROUP BY create_date, create_hour"""

_NEW_BUYERS = f"""WITH {_ORDERS}, firsts AS (SELECT user_id, min(create_date) AS log_date FROM ord GROUP BY user_id)
  SELECT log_date, count(*) AS new_devices FROM firsts GROUP BY log_date"""


def _options(part: str, label: str) -> str:
    return f"""SELECT '{part}' AS part, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS pos,
        name || '|' || n AS name, CAST(n AS DOUBLE) * 100 / (SELECT count(*) FROM hits) AS value
      FROM (SELECT {label} AS name, count(*) AS n FROM hits GROUP BY 1)"""


_RESPONSE = f"""WITH {_HITS}, page AS (
    SELECT *, row_number() OVER (ORDER BY dt, order_id, order_detail_id) AS n FROM hits)
  SELECT 'total' AS part, 0 AS pos, NULL AS name, CAST((SELECT count(*) FROM hits) AS DOUBLE) AS value
  UNION ALL {_options('age', _AGE)} UNION ALL {_options('gender', _GENDER)}
  UNION ALL SELECT 'detail', CAST(n - 51 AS INTEGER), concat_ws('|', order_detail_id, order_id, order_status,
    create_time, user_id, sku_id, coalesce(user_gender, '-'), user_age, coalesce(user_level, '-'), sku_name,
    age_known, dt), sku_price
  FROM page WHERE n BETWEEN 51 AND 100"""

ORACLE: dict[str, str] = {
    "dau_first_of_day": f"""WITH {_FIRST}
      SELECT mid, log_date, log_hour, uid, type, ts, event_id FROM first""",
    "dau_anti_seen": f"""WITH {_FIRST}
      SELECT mid, log_date, log_hour, uid, event_id FROM first f
      WHERE NOT EXISTS (SELECT 1 FROM logs l WHERE l.mid = f.mid AND l.log_date = f.log_date
                        AND l.log_hour < '12')""",
    "dau_total": f"""WITH {_FIRST}
      SELECT count(*) AS dau FROM first WHERE log_date = '2024-01-15'""",
    "dau_by_day": f"""WITH {_FIRST}
      SELECT log_date, count(*) AS dau FROM first GROUP BY log_date""",
    "dau_by_hour": f"""WITH {_FIRST}
      SELECT log_date, log_hour, count(*) AS ct FROM first GROUP BY log_date, log_hour""",
    "dau_hours_compare": _compare(_FIRST, "first", "log_date", "log_hour", "count(*)",
                                  "2024-01-14", "2024-01-15"),
    "new_devices_by_day": f"""WITH {_NEW}
      SELECT log_date, count(*) AS new_devices FROM fresh GROUP BY log_date""",
    "new_buyers_by_day": _NEW_BUYERS,
    "stream_new_buyers": _NEW_BUYERS,
    "new_mid_hours_compare": _compare(_NEW, "fresh", "log_date", "log_hour", "count(*)",
                                      "2024-01-01", "2024-01-02"),
    "dau_hours_payload": f"""WITH {_FIRST}, per_hour AS (
        SELECT log_date, log_hour, CAST(count(*) AS DOUBLE) AS ct FROM first
        GROUP BY log_date, log_hour)
      SELECT '{{"yesterday":' || {_side_map('2024-01-14')} || ',"today":'
             || {_side_map('2024-01-15')} || '}}' AS value""",
    "gmv_clean_rows": f"""WITH {_ORDERS}
      SELECT id, user_id, total_amount, consignee_tel, create_date, create_hour FROM ord""",
    "gmv_total_by_day": f"""WITH {_ORDERS}
      SELECT create_date, {_MONEY.format('total_amount')} AS sum_amount
      FROM ord GROUP BY create_date""",
    "gmv_total_one_day": f"""WITH {_ORDERS}
      SELECT {_MONEY.format('total_amount')} AS sum_amount
      FROM ord WHERE create_date = '1998-03-02'""",
    "gmv_by_hour": _GMV_HOURS,
    "purchase_gmv_by_hour": f"""WITH {_PURCHASES}
      SELECT create_date, create_hour, {_MONEY.format('total_amount')} AS sum_amount
      FROM purchases GROUP BY create_date, create_hour""",
    "gmv_hours_compare": _compare(_PURCHASES, "purchases", "create_date", "create_hour",
                                  _MONEY.format("total_amount"), "2024-01-14", "2024-01-15"),
    "totals_card": _CARD,
    "totals_payload": f"""SELECT '[' || string_agg('{{"id":"' || id || '","name":"' || name
        || '","value":' || CAST(value AS VARCHAR) || '}}', ','
        ORDER BY id = 'order_amount', id) || ']' AS value FROM ({_CARD})""",
    "order_upsert_last": f"""WITH {_ORDERS}
      SELECT id, CASE WHEN order_status = 'P' THEN 'F' ELSE order_status END AS order_status,
             CASE WHEN order_status = 'P' THEN total_amount + 1 ELSE total_amount END
               AS total_amount, create_time FROM ord""",
    "sales_by_province": f"""SELECT n_nationkey AS province_id, n_name AS province_name,
        count(*) AS order_count, {_MONEY.format('o_totalprice')} AS sales_amount,
        least(count(*) // 100 + 1, 6) AS value_class
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      GROUP BY n_nationkey, n_name""",
    "sale_detail_full_outer": f"""WITH {_ORDERS}, {_DETAILS}
      SELECT coalesce(o.id, d.order_id) AS order_id, o.order_status, o.create_time, o.user_id,
             o.create_date AS dt, d.id AS order_detail_id, d.sku_id, d.sku_price, d.sku_name,
             CASE WHEN o.id IS NULL THEN 'detail_only' WHEN d.id IS NULL THEN 'order_only'
                  ELSE 'both' END AS side
      FROM ord o FULL JOIN det d ON o.id = d.order_id""",
    "sale_detail_inner": f"""WITH {_ORDERS}, {_DETAILS}
      SELECT o.id AS order_id, o.order_status, o.create_time, o.user_id, o.create_date AS dt,
             d.id AS order_detail_id, d.sku_id, d.sku_price, d.sku_name
      FROM ord o JOIN det d ON o.id = d.order_id""",
    "sale_detail_enriched": f"WITH {_SALES} SELECT * FROM sales",
    "sale_detail_interval": f"""WITH {_PAIRS}
      SELECT order_id, order_detail_id, user_id, sku_name, sku_price, joined_ms FROM pairs""",
    "user_latest": f"WITH {_USERS} {_LATEST_USERS}",
    "user_age": f"WITH {_USERS} SELECT id, birthday, age FROM usr",
    "search_page": f"""WITH {_HITS} SELECT * FROM hits
      ORDER BY dt, order_id, order_detail_id LIMIT 20 OFFSET 20""",
    "search_response_rows": _RESPONSE,
    "search_page_directory": f"""WITH {_SALES} SELECT * FROM sales
      ORDER BY dt, order_id, order_detail_id LIMIT 20 OFFSET 4980""",
    "search_page_after": f"""WITH {_HITS} SELECT * FROM hits
      ORDER BY dt, order_id, order_detail_id LIMIT 20 OFFSET 40""",
    "search_total": f"WITH {_HITS} SELECT count(*) AS total FROM hits",
    "search_totals_indexed": f"""WITH {_SALES}, words(keyword) AS (VALUES ('g'), ('In'), ('rin'), ('RING'),
        ('t r'), ('ed ring'), ('ringring'))
      SELECT keyword, count(sku_name) AS total
      FROM words LEFT JOIN sales ON contains(lower(sku_name), lower(keyword)) GROUP BY 1""",
    "search_by_level": f"""WITH {_HITS}
      SELECT count(*) AS total FROM hits WHERE user_level = 'BUILDING'""",
    "search_by_day": f"WITH {_SALES} SELECT * FROM sales WHERE dt = '1998-03-02'",
    "facet_gender": _facet(_GENDER),
    "facet_age": _facet(_AGE),
    "search_response_total": f"""WITH {_HITS}, page AS (
        SELECT order_detail_id, row_number() OVER (ORDER BY dt, order_id, order_detail_id) AS n
        FROM hits)
      SELECT (SELECT count(*) FROM hits) AS total,
             (SELECT count(*) FROM hits WHERE user_gender IS NULL) AS first_gender,
             (SELECT order_detail_id FROM page WHERE n = 1) AS first_row,
             (SELECT order_detail_id FROM page WHERE n = 5) AS fifth_row""",
    "coupon_alert": f"WITH {_ALERTS} SELECT mid, start_ms, end_ms, n_users FROM alert",
    "alert_docs": _ALERT_DOCS,
    "alert_members": _ALERT_MEMBERS,
    "alert_events": f"""WITH {_ALERTS}
      SELECT mid || '-' || CAST(end_ms // 60000 AS VARCHAR) AS doc_id,
             row_number() OVER (PARTITION BY mid, end_ms ORDER BY ms, CAST(itemid AS BIGINT)) AS seq, ms AS ts, evid
      FROM win JOIN alert USING (mid, start_ms) WHERE evid IS NOT NULL""",
    "coupon_alert_fine": _ALERTS_FINE,
    "stream_alerts_late": _ALERT_MEMBERS,
    "stream_dau_late": f"WITH {_FIRST} SELECT mid, log_date, log_hour, ts FROM first",
    "change_quarantine": f"""WITH {_ORDERS}, {_DETAILS}, {_USERS}
      SELECT 'malformed' AS kind, count(*) AS n FROM ord
      UNION ALL SELECT 'TOPIC_ORDER_DETAIL', count(*) FROM det
      UNION ALL SELECT 'TOPIC_USER_INFO', count(*) + count(*) FILTER (user_level = 'HOUSEHOLD')
      FROM usr""",
    "alert_index": f"""SELECT 'coupon_alert_' || index_day AS index_name,
        count(DISTINCT doc_id) AS docs FROM ({_ALERT_DOCS}) GROUP BY 1""",
    "parse_start_log": f"""WITH {_LOGS}
      SELECT mid, uid, type, ts, log_date, log_hour FROM logs WHERE mid <> '13'""",
    "parse_quarantine": f"""WITH {_RAW_START}
      SELECT log_date AS day, 'malformed' AS error, count(*) AS n,
             CAST(sum(length(value) // 2) AS BIGINT) AS chars
      FROM raw WHERE mid = '13' GROUP BY log_date""",
    "parse_orders": f"""WITH {_ORDERS}
      SELECT id, user_id, order_status, total_amount, consignee_tel, create_date, create_hour
      FROM ord""",
    "log_routing_counts": f"""WITH {_LOGS}
      SELECT CASE WHEN type = 'startup' THEN 'Topic_Start' ELSE 'Topic_Event' END AS topic,
             count(*) AS n, CAST(sum(ts) AS BIGINT) AS ts_sum
      FROM logs GROUP BY 1""",
    "cdc_routing": f"""WITH {_ORDERS}, {_DETAILS}, {_USERS}
      SELECT 'TOPIC_ORDER_INFO' AS topic,
             '{{"id":"' || id || '","user_id":"' || user_id || '","total_amount":"'
             || CAST(CAST(total_amount AS DECIMAL(18,2)) AS VARCHAR) || '","create_time":"'
             || create_time || '"}}' AS value
      FROM ord WHERE order_status = 'O' AND o_orderpriority <> '1-URGENT'
      UNION ALL
      SELECT 'TOPIC_ORDER_DETAIL',
             '{{"id":"' || id || '","order_id":"' || order_id || '","sku_id":"' || sku_id
             || '","order_price":"' || CAST(CAST(sku_price AS DECIMAL(18,2)) AS VARCHAR) || '"}}'
      FROM det
      UNION ALL
      SELECT 'TOPIC_USER_INFO', {_user_json('user_level')} FROM usr
      UNION ALL
      SELECT 'TOPIC_USER_INFO', {_user_json("'VIP'")} FROM usr WHERE user_level = 'HOUSEHOLD'""",
    "stream_dau": f"WITH {_FIRST} SELECT mid, log_date, log_hour, ts FROM first",
    "stream_dau_state": f"WITH {_FIRST} SELECT mid, log_date, log_hour, ts FROM first",
    "stream_gmv": _GMV_HOURS,
    "stream_users": f"WITH {_USERS} {_LATEST_USERS}",
    "stream_sale_details": f"""WITH {_PAIRS}, {_USERS}, latest AS (
        SELECT l.*, usr.age FROM ({_LATEST_USERS}) l JOIN usr USING (id))
      SELECT p.order_detail_id, p.order_id, p.order_status, p.create_time, p.user_id, p.sku_id,
             u.gender AS user_gender, coalesce(u.age, 0) AS user_age, u.user_level, p.sku_price,
             p.sku_name, u.age IS NOT NULL AS age_known, p.create_date AS dt,
             strftime(make_timestamp(p.joined_ms * 1000), '%Y-%m-%d') AS index_day
      FROM pairs p LEFT JOIN latest u ON p.user_id = u.id""",
    "stream_facet_cells": f"""WITH {_PAIRS}, {_USERS}, latest AS (
        SELECT l.*, usr.age FROM ({_LATEST_USERS}) l JOIN usr USING (id)), whole AS (
        SELECT u.user_level, u.gender AS user_gender, coalesce(u.age, 0) AS user_age,
               u.age IS NOT NULL AS age_known
        FROM pairs p LEFT JOIN latest u ON p.user_id = u.id)
      SELECT user_level, {_GENDER} AS gender, {_AGE} AS age, count(*) AS n FROM whole GROUP BY 1, 2, 3""",
    "stream_alerts": _ALERT_DOCS,
    "stream_log_router": f"""WITH {_LOGS}, texts AS (
      SELECT *, '{{"mid":"' || mid || '","uid":"' || uid || '","type":"' || type || '"' AS text FROM logs)
      SELECT CASE WHEN type = 'startup' THEN 'Topic_Start' ELSE 'Topic_Event' END AS topic,
             count(*) AS n,
             CAST(sum(CAST('0x' || md5(text || ',"ts":' || ts || '}}')[1:8] AS BIGINT)) AS BIGINT) AS texts
      FROM texts GROUP BY 1
      UNION ALL
      SELECT 'archive ' || log_date, count(*),
             CAST(sum(CAST('0x' || md5(text || ',"ts":' || ts || '}}')[1:8] AS BIGINT)) AS BIGINT)
      FROM texts GROUP BY log_date""",
    "stream_change_router": f"""WITH {_ORDERS}, {_DETAILS}, {_USERS}
      SELECT 'TOPIC_ORDER_INFO' AS topic, id, total_amount AS amount, NULL AS level FROM ord
      WHERE order_status = 'O' AND o_orderpriority <> '1-URGENT'
      UNION ALL
      SELECT 'TOPIC_ORDER_DETAIL', id, sku_price, NULL FROM det
      UNION ALL
      SELECT 'TOPIC_USER_INFO', id, NULL, user_level FROM usr
      UNION ALL
      SELECT 'TOPIC_USER_INFO', id, NULL, 'VIP' FROM usr WHERE user_level = 'HOUSEHOLD'""",
}
#: The order in which records come changes nothing.
ORACLE["stream_sales_late"] = ORACLE["stream_sales_replayed"] = ORACLE["stream_sale_details"]
ORACLE["stream_gmv_folded"] = ORACLE["stream_gmv"]
ORACLE["stream_dau_restarts"] = ORACLE["stream_dau_cadence"] = ORACLE["stream_dau"]
ORACLE["stream_change_files"] = ORACLE["stream_change_router"]
ORACLE["search_page_indexed"] = ORACLE["search_page"]
