"""DuckDB statements giving the same results as the registered queries, from the same tables."""

from __future__ import annotations

_ID = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
_PRICE = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_NUM = "CAST(round(l_quantity) AS BIGINT)"


def _remainder(factor: int, prime: int) -> str:
    total = "0"
    for part in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _NUM, _PRICE):
        total = f"(({total} * {factor} + {part}) % {prime})"
    return total


_DETAIL_ID = f"CAST({_remainder(728191213, 1073741789)} * 1073741824 + {_remainder(523481377, 1073741783)} AS BIGINT)"

DETAILS = f"""details AS (
  SELECT {_DETAIL_ID} AS id, l_orderkey AS order_id, l_partkey AS sku_id, {_PRICE} AS price_c, {_NUM} AS sku_num,
         'sku-' || l_partkey AS sku_name, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS create_time, l_linenumber
  FROM lineitem)"""

HEADS = """heads AS (
  SELECT o_orderkey AS id, o_custkey % 25 AS province_id, o_orderstatus AS order_status, o_custkey AS user_id,
         o_orderdate + to_seconds(o_orderkey % 86400) AS created,
         strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS create_time
  FROM orders)"""

TOTALS = f"""totals AS (
  SELECT l_orderkey, CAST(sum({_NUM} * {_PRICE}) AS BIGINT) AS original_c,
         CAST(sum(({_NUM} * {_PRICE} * CAST(round(l_discount * 100) AS BIGINT)) // 100) AS BIGINT) AS benefit_c,
         CAST(sum(({_NUM} * {_PRICE} * CAST(round(l_tax * 100) AS BIGINT)) // 100) AS BIGINT) AS freight_c
  FROM lineitem GROUP BY l_orderkey),
infos AS (
  SELECT heads.*, coalesce(original_c, 0) AS original_c, coalesce(benefit_c, 0) AS benefit_c, coalesce(freight_c, 0) AS freight_c,
         coalesce(original_c - benefit_c + freight_c, 0) AS final_c
  FROM heads LEFT JOIN totals ON id = l_orderkey)"""

USERS = """users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS user_level,
         CAST(DATE '1950-01-01' + CAST(c_custkey * 97 % 23000 AS INTEGER) AS VARCHAR) AS birthday,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, c_custkey,
         (DATE '2021-01-01' - (DATE '1950-01-01' + CAST(c_custkey * 97 % 23000 AS INTEGER))) // 365 AS age
  FROM customer),
typed_users AS (
  SELECT id, user_level, birthday, gender, c_custkey,
         CASE WHEN age <= 20 THEN '20岁及以下' WHEN age <= 30 THEN '21岁到 30 岁' ELSE '30岁及以上' END AS age_group,
         CASE WHEN gender = 'F' THEN '女' ELSE '男' END AS gender_name
  FROM users)"""

SKUS = f"""skus AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, {_ID.format('p_name')} AS spu_id,
         printf('%d.%02d', CAST(round(p_retailprice * 100) AS BIGINT) // 100, CAST(round(p_retailprice * 100) AS BIGINT) % 100) AS price,
         'sku-' || p_partkey AS sku_name, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS tm_id,
         {_ID.format('p_type')} AS category3_id, p_type AS category3_name, p_name AS spu_name, p_brand AS tm_name, p_partkey
  FROM part WHERE CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) % 13 <> 0)"""

FLAGS = """ranked AS (
  SELECT id AS ranked_id, row_number() OVER (PARTITION BY user_id ORDER BY create_time, id) = 1 AND user_id % 7 <> 0 AS is_first_order
  FROM heads)"""

SKUS_ALL = SKUS.replace(" WHERE CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) % 13 <> 0", "")

ENRICHED = f"""{HEADS}, {FLAGS}, {USERS},
enriched AS (
  SELECT h.id, h.user_id, h.province_id, h.order_status, h.create_time, substr(h.create_time, 1, 10) AS create_date,
         substr(h.create_time, 12, 2) AS create_hour, is_first_order, n_name AS province_name,
         CAST(n_regionkey AS VARCHAR) AS province_area_code, 'CN-' || n_nationkey AS province_iso_code,
         age_group AS user_age_group, gender_name AS user_gender
  FROM heads h JOIN ranked ON h.id = ranked_id
  JOIN nation ON province_id = n_nationkey AND n_nationkey % 13 <> 0
  JOIN typed_users u ON user_id = c_custkey AND c_custkey % 13 <> 0)"""

ENRICHED_ALL = ENRICHED.replace(" AND n_nationkey % 13 <> 0", "").replace(" AND c_custkey % 13 <> 0", "")

SHARES = """priced AS (
  SELECT w.*, sku_num * price_c AS cur,
         coalesce(sum(sku_num * price_c) OVER earlier, 0) AS before_c
  FROM wide w WINDOW earlier AS (PARTITION BY order_id ORDER BY order_detail_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
parts AS (
  SELECT *, before_c + cur = original_c AND (cur > 0 OR original_c = 0) AS is_last,
         CASE WHEN original_c > 0 THEN CAST((CAST(cur AS HUGEINT) * final_c) // original_c AS BIGINT)
           + CASE WHEN 2 * ((CAST(cur AS HUGEINT) * final_c) % original_c) > original_c
                    OR (2 * ((CAST(cur AS HUGEINT) * final_c) % original_c) = original_c
                        AND ((CAST(cur AS HUGEINT) * final_c) // original_c) % 2 = 1) THEN 1 ELSE 0 END END AS part_c
  FROM priced),
shares AS (
  SELECT *, CASE WHEN is_last THEN final_c - coalesce(sum(part_c) OVER (
              PARTITION BY order_id ORDER BY order_detail_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            ELSE part_c END AS share_c
  FROM parts)"""

WIDE_PLAIN = f"""{HEADS}, {TOTALS}, {DETAILS},
wide AS (SELECT i.id AS order_id, d.id AS order_detail_id, price_c, sku_num, original_c, final_c, i.create_time, i.created, sku_id
         FROM infos i JOIN details d ON i.id = d.order_id)"""

ORDER_WIDE = f"""
WITH {ENRICHED_ALL}, {TOTALS}, {DETAILS}, {SKUS_ALL}
SELECT e.id AS order_id, e.province_id, e.order_status, e.user_id, CAST(final_c AS DOUBLE) / 100 AS final_total_amount,
       CAST(benefit_c AS DOUBLE) / 100 AS benefit_reduce_amount, CAST(original_c AS DOUBLE) / 100 AS original_total_amount,
       CAST(freight_c AS DOUBLE) / 100 AS feight_fee, e.create_time, '1970-01-01 00:00:00' AS operate_time, create_date,
       create_hour, is_first_order, province_name, province_area_code, province_iso_code, user_age_group, user_gender,
       d.id AS order_detail_id, d.sku_id, CAST(price_c AS DOUBLE) / 100 AS sku_price, d.sku_num, d.sku_name, spu_id, tm_id,
       category3_id, spu_name, tm_name, category3_name
FROM enriched e JOIN infos i ON e.id = i.id JOIN details d ON d.order_id = e.id JOIN skus s ON s.p_partkey = d.sku_id"""

ORDER_SHARE = f"""
WITH {WIDE_PLAIN}, {SHARES}
SELECT order_id, order_detail_id, CAST(final_c AS DOUBLE) / 100 AS final_total_amount,
       CAST(original_c AS DOUBLE) / 100 AS original_total_amount, CAST(price_c AS DOUBLE) / 100 AS sku_price, sku_num, is_last,
       CAST(share_c AS DOUBLE) / 100 AS final_detail_amount
FROM shares"""

FIRST_START = """
WITH logs AS (
  SELECT 'm' || user_id AS mid, CAST(user_id AS VARCHAR) AS uid, json_extract_string(props, '$.k') AS ar, event_type AS ba,
         'store' AS ch, 'model' AS md, 'Android 11' AS os, 'v2.1' AS vc, epoch_us(ts) // 1000 AS ts,
         strftime(ts, '%Y-%m-%d') AS log_date, strftime(ts, '%H') AS log_hour
  FROM events)
SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY log_date, mid ORDER BY ts, uid, ar, ba) = 1"""

ORACLES = {
    "cdc_array_route": f"""
WITH {DETAILS}, kept AS (
  SELECT * FROM details WHERE order_id % 19 <> 0 AND order_id % 17 <> 0 AND order_id % 13 <> 0 AND order_id % 7 <> 0)
SELECT 'ods_order_detail' AS topic, id, order_id, sku_num, CAST(price_c AS DOUBLE) / 100 AS price FROM kept
UNION ALL
SELECT 'ods_order_detail', id + 1, order_id, sku_num, 0.0 FROM kept""",
    "cdc_object_route": f"""
WITH {HEADS}, {TOTALS}
SELECT 'ods_order_info' AS topic, id, user_id, CAST(final_c AS DOUBLE) / 100 AS amount
FROM infos WHERE id % 7 <> 0 AND id % 5 <> 0 AND id % 11 <> 0
UNION ALL
SELECT 'ods_user_info', c_custkey, NULL, NULL FROM customer""",
    "cdc_malformed": f"""
WITH {DETAILS}
SELECT substr('{{"table":"' || CASE WHEN order_id % 13 = 0 THEN 'cart_info' WHEN sku_id % 2 = 0 THEN 'Order_Detail' ELSE 'order_detail' END
              || '","type":"', 1, 20) AS value
FROM details WHERE order_id % 19 = 0""",
    "cdc_exact_numbers": f"""
WITH {DETAILS}
SELECT 'ods_order_detail' AS topic, id, order_id, CAST(CAST(price_c + 9999999900000000 AS DECIMAL(18,0)) * CAST('0.01' AS DECIMAL(3,2)) AS VARCHAR) AS order_price
FROM details""",
    "order_info_typed": f"""
WITH {HEADS}, {TOTALS}
SELECT id, province_id, order_status, user_id, CAST(final_c AS DOUBLE) / 100 AS final_total_amount,
       CAST(original_c AS DOUBLE) / 100 AS original_total_amount, create_time, '1970-01-01 00:00:00' AS operate_time,
       substr(create_time, 1, 10) AS create_date, substr(create_time, 12, 2) AS create_hour, false AS is_first_order
FROM infos""",
    "order_detail_typed": f"""
WITH {DETAILS}
SELECT id, order_id, sku_id, CAST(price_c AS DOUBLE) / 100 AS order_price, sku_num, sku_name, create_time,
       CAST(0 AS BIGINT) AS spu_id, CAST(0 AS BIGINT) AS tm_id, CAST(0 AS BIGINT) AS category3_id FROM details""",
    "dim_user": f"WITH {USERS} SELECT id, user_level, birthday, gender, age_group, gender_name FROM typed_users",
    "dim_sku": f"""
WITH {SKUS}
SELECT id, CAST(spu_id AS VARCHAR) AS spu_id, price, sku_name, CAST(tm_id AS VARCHAR) AS tm_id,
       CAST(category3_id AS VARCHAR) AS category3_id, '2020-01-01 00:00:00' AS create_time, category3_name, spu_name, tm_name FROM skus""",
    "dim_upsert_latest": """
WITH versions AS (
  SELECT c_custkey, c_mktsegment AS user_level, v AS version FROM customer, (VALUES (1), (2), (3)) t(v)
  UNION ALL SELECT c_custkey, lower(c_mktsegment), 4 FROM customer WHERE c_custkey % 3 = 0)
SELECT CAST(c_custkey AS VARCHAR) AS id, user_level, CAST(version AS INTEGER) AS version FROM versions
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY version DESC) = 1""",
    "order_detail_sku": f"""
WITH {DETAILS}, {SKUS}
SELECT d.id, order_id, sku_id, CAST(price_c AS DOUBLE) / 100 AS order_price, sku_num, d.sku_name, create_time, spu_id, tm_id,
       category3_id, spu_name, tm_name, category3_name FROM details d JOIN skus ON p_partkey = sku_id""",
    "order_first_flag": f"""
WITH {HEADS}, {FLAGS}
SELECT id, user_id, create_time, is_first_order FROM heads JOIN ranked ON id = ranked_id""",
    "order_enriched": f"""
WITH {ENRICHED}
SELECT id, user_id, province_id, order_status, create_date, create_hour, is_first_order, province_name, province_area_code,
       province_iso_code, user_age_group, user_gender FROM enriched""",
    "user_status": f"""
WITH {ENRICHED_ALL}
SELECT CAST(user_id AS VARCHAR) AS user_id, bool_or(is_first_order) AS is_first_order FROM enriched GROUP BY user_id
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_custkey % 2 = 0 FROM customer
WHERE c_custkey % 7 = 0 AND c_custkey NOT IN (SELECT user_id FROM enriched)""",
    "order_wide": ORDER_WIDE,
    "wide_rows_clustered": f"""
WITH {HEADS}, {DETAILS}
SELECT d.id AS order_detail_id, order_id, province_id, h.create_time, sku_id, sku_num FROM heads h JOIN details d ON h.id = d.order_id""",
    "order_wide_windowed": f"""
WITH {HEADS}, {DETAILS}
SELECT DISTINCT h.id AS order_id, d.id AS order_detail_id, user_id, sku_id, sku_num
FROM heads h JOIN details d ON h.id = d.order_id
WHERE abs((epoch_ms(created) // 1000) // 5 - (epoch_ms(created) // 1000 + l_linenumber * 5 - 5) // 5) <= 3""",
    "order_wide_share": ORDER_SHARE,
    "trademark_amount": f"""
WITH {ENRICHED_ALL}, {TOTALS}, {DETAILS}, {SKUS_ALL},
wide AS (SELECT i.id AS order_id, d.id AS order_detail_id, price_c, sku_num, original_c, final_c, tm_id, tm_name
         FROM enriched e JOIN infos i ON e.id = i.id JOIN details d ON i.id = d.order_id JOIN skus ON p_partkey = sku_id),
{SHARES}
SELECT '2021-01-01 00:00:00' AS stat_time, tm_id, tm_name, CAST(sum(share_c) AS DOUBLE) / 100 AS amount
FROM shares GROUP BY tm_id, tm_name""",
    "trademark_amount_windows": f"""
WITH {HEADS}, {TOTALS}, {DETAILS}, {SKUS_ALL},
wide AS (SELECT i.id AS order_id, d.id AS order_detail_id, price_c, sku_num, original_c, final_c, created, tm_id, tm_name
         FROM infos i JOIN details d ON i.id = d.order_id JOIN skus ON p_partkey = sku_id),
{SHARES}
SELECT strftime(time_bucket(INTERVAL 5 SECONDS, created, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, tm_id, tm_name,
       CAST(sum(share_c) AS DOUBLE) / 100 AS amount
FROM shares GROUP BY ALL""",
    "trademark_amount_committed": f"""
WITH {DETAILS}, {SKUS_ALL}, sums AS (
  SELECT tm_id, order_id % 2 = 1 AND tm_id % 3 <> 0 AS second, CAST(sum(price_c * sku_num) AS DOUBLE) / 100 AS value
  FROM details JOIN skus ON p_partkey = sku_id GROUP BY 1, 2)
SELECT '2021-01-01 00:00:00' AS row, tm_id AS key, value FROM sums QUALIFY row_number() OVER (PARTITION BY tm_id ORDER BY second DESC) = 1
UNION ALL SELECT 'ads', CAST(0 AS BIGINT), CAST(1 AS DOUBLE)""",
    "dau_first_start": FIRST_START,
    "dau_index_upsert": """
WITH logs AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT 'dau_' || day AS index_name, 'm' || user_id AS doc_id, epoch_us(ts) // 1000 AS ts, event_id FROM logs
QUALIFY row_number() OVER (PARTITION BY day, user_id ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) = 1""",
    "offset_ledger": """
WITH ends AS (
  SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition_id, day(ts) > 15 AS later, max(event_id) + 1 AS partition_offset
  FROM events GROUP BY ALL)
SELECT 'dau' AS group_id, topic, partition_id, partition_offset FROM ends
QUALIFY row_number() OVER (PARTITION BY topic, partition_id ORDER BY later DESC) = 1""",
    "order_wide_stream": f"""
WITH {HEADS}, {DETAILS}
SELECT h.id AS order_id, d.id AS order_detail_id, user_id, sku_id, sku_num FROM heads h JOIN details d ON h.id = d.order_id""",
    "order_wide_share_stream": f"""
WITH {WIDE_PLAIN}, {SHARES}
SELECT order_id, order_detail_id, CAST(final_c AS DOUBLE) / 100 AS final_total_amount,
       CAST(original_c AS DOUBLE) / 100 AS original_total_amount, CAST(price_c AS DOUBLE) / 100 AS sku_price, sku_num,
       CAST(share_c AS DOUBLE) / 100 AS final_detail_amount
FROM shares""",
    "dau_first_start_stream": "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS log_date, 'm' || user_id AS mid FROM events",
}
ORACLES["order_wide_windowed_stream"] = ORACLES["order_wide_windowed"]
ORACLES["order_wide_share_chunked"] = f"SELECT order_id, order_detail_id, sku_num, is_last, final_detail_amount FROM ({ORDER_SHARE})"
ORACLES["order_index_upsert"] = f"""
WITH {HEADS}
SELECT 'order_' || substr(create_time, 1, 10) AS index_name, CAST(id AS VARCHAR) AS doc_id,
       CASE WHEN id % 4 = 0 THEN 'changed' ELSE order_status END AS order_status, user_id FROM heads"""
ORACLES["cdc_route_stream"] = ORACLES["cdc_array_route"]
ORACLES["cdc_quarantine"] = ORACLES["cdc_malformed"]
ORACLES["dim_sync_stream"] = ORACLES["dim_sku"]
ORACLES["order_enriched_stream"] = f"""
WITH {ENRICHED}, waves AS (SELECT *, id % 3 AS wave FROM heads),
known AS (SELECT user_id AS known_id, min(id % 3) AS first_wave FROM enriched GROUP BY 1),
firsts AS (
  SELECT id AS first_id, row_number() OVER (PARTITION BY user_id, wave ORDER BY create_time, id) = 1
    AND NOT coalesce(first_wave < wave, false) AS first_of_user
  FROM waves LEFT JOIN known ON user_id = known_id)
SELECT id, user_id, province_id, create_date, create_hour, first_of_user AS is_first_order, province_name, user_age_group, user_gender
FROM enriched JOIN firsts ON id = first_id"""
ORACLES["unmatched_details"] = f"""
WITH {DETAILS}
SELECT id, order_id, sku_id, sku_num, CAST(price_c AS DOUBLE) / 100 AS order_price FROM details WHERE order_id % 13 = 0"""
ORACLES["trademark_amount_stream"] = f"""
WITH {DETAILS}, waves AS (
  SELECT sku_id % 25 AS tm_id, CASE WHEN order_id % 3 = 1 AND sku_id % 25 % 2 = 1 THEN 2 ELSE order_id % 3 END AS wave, price_c * sku_num AS c FROM details),
sums AS (SELECT tm_id, wave, sum(c) AS c FROM waves GROUP BY ALL)
SELECT '2021-01-01 00:00:0' || (wave // 2) AS stat_time, tm_id, 'tm-' || tm_id AS tm_name, CAST(c AS DOUBLE) / 100 AS amount FROM sums
QUALIFY row_number() OVER (PARTITION BY tm_id, wave // 2 ORDER BY wave DESC) = 1"""
ORACLES["dau_index_stream"] = "SELECT 'm' || user_id AS doc_id, max(strftime(ts, '%Y-%m-%d')) AS log_date FROM events GROUP BY 1"
ORACLES["trademark_amount_windows_stream"] = ORACLES["trademark_amount_windows"]
ORACLES["order_wide_outer_stream"] = f"""
WITH {DETAILS}, {HEADS},
lines AS (SELECT id AS order_detail_id, order_id FROM details WHERE order_id % 11 <> 0),
came AS (SELECT id AS order_id FROM heads WHERE id % 13 <> 0)
SELECT 'pair' AS kind, order_id, order_detail_id FROM lines JOIN came USING (order_id) WHERE order_id % 5 <> 0
UNION ALL
SELECT 'detail', order_id, order_detail_id FROM lines WHERE order_id % 5 = 0 OR order_id NOT IN (SELECT order_id FROM came)
UNION ALL
SELECT 'order', order_id, NULL FROM came WHERE order_id % 5 = 0 OR order_id NOT IN (SELECT order_id FROM lines)"""
ORACLES["dau_bitmap_counts"] = """
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events),
spans AS (SELECT 'day' AS span, day AS start, user_id, day + 1 AS later FROM days
          UNION SELECT 'week', CAST(date_trunc('week', day) AS DATE), user_id, CAST(date_trunc('week', day) AS DATE) + 7 FROM days)
SELECT s.span, strftime(s.start, '%Y-%m-%d') AS start, count(*) AS devices, count(p.user_id) AS returned
FROM spans s LEFT JOIN spans p ON s.span = p.span AND s.start = p.later AND s.user_id = p.user_id GROUP BY ALL"""
ORACLES["waiting_in_state"] = f"""
WITH {DETAILS}, {HEADS},
lines AS (SELECT id AS order_detail_id, order_id FROM details WHERE order_id // 3 % 3 < 2),
came AS (SELECT id AS order_id FROM heads WHERE id % 3 < 2)
SELECT 'order' AS kind, order_id, NULL AS order_detail_id FROM came WHERE order_id NOT IN (SELECT order_id FROM lines)
UNION ALL
SELECT 'detail', order_id, order_detail_id FROM lines WHERE order_id NOT IN (SELECT order_id FROM came)"""
ORACLES["trademark_amount_once_stream"] = f"""
WITH {DETAILS}
SELECT '2021-01-01 00:00:0' || (id % 3) AS stat_time, sku_id % 25 AS tm_id, 'tm-' || (sku_id % 25) AS tm_name,
       CAST(sum(price_c * sku_num) AS DOUBLE) / 100 AS amount
FROM details GROUP BY ALL"""
