"""DuckDB oracle SQL for the registered queries (tables are pre-registered views).

Written from the operator semantics, not generated from the Spark plans. Views shared by many
oracles are CTEs: ``txn`` (orders as flat transactions), ``ev`` (events as decoded messages),
``tr`` (line items as transfers).
"""

TXN = """txn AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS transaction_id,
         CAST(o.o_orderdate AS TIMESTAMP) AS transactiondate,
         c.c_name AS sender_name,
         'street ' || (c.c_custkey % 90) AS sender_address,
         CAST(c.c_custkey AS VARCHAR) AS sender_account_number,
         'BANK_' || c.c_nationkey AS sender_bank_name,
         CASE WHEN c.c_custkey % 3 > 0 THEN 'SW' || c.c_nationkey END AS sender_swift_code,
         'receiver ' || (o.o_orderkey % 500) AS receiver_name,
         CASE WHEN o.o_orderkey % 500 % 4 > 0 THEN 'road ' || (o.o_orderkey % 500) END AS receiver_address,
         CAST(o.o_orderkey % 500 AS VARCHAR) AS receiver_account_number,
         'BANK_' || rn.n_nationkey AS receiver_bank_name,
         'SW' || rn.n_nationkey AS receiver_swift_code,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount_usd,
         sn.n_name AS sender_country,
         rn.n_name AS receiver_country,
         o.o_orderpriority AS transaction_type,
         o.o_orderstatus AS status,
         CAST(ROUND(LEAST(5 + CAST(o.o_totalprice AS DECIMAL(18,2)) * 0.01, 50), 2) AS DECIMAL(18,2)) AS fee_usd,
         'REF-' || o.o_orderkey AS reference,
         CAST(o.o_orderdate AS TIMESTAMP) AS processing_time,
         '10.0.0.' || (c.c_custkey % 250) AS ip_address,
         CASE WHEN o.o_orderkey % 5 > 0 THEN 'dev-' || (c.c_custkey % 40) END AS device_id,
         CAST(NULL AS VARCHAR) AS user_agent,
         CASE o.o_orderkey % 4 WHEN 0 THEN 'MOBILE_APP' WHEN 1 THEN 'WEB' WHEN 2 THEN 'BRANCH' ELSE 'API' END AS channel
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation sn ON c.c_nationkey = sn.n_nationkey
  JOIN nation rn ON rn.n_nationkey = o.o_orderkey % 25)"""

FAULT = """CASE WHEN event_id % 97 = 0 THEN 'cut' WHEN event_id % 89 = 0 THEN 'text' WHEN event_id % 83 = 0 THEN 'none'
              WHEN event_id % 79 = 0 THEN 'twice' WHEN event_id % 73 = 0 THEN 'nan' WHEN event_id % 71 = 0 THEN 'empty' END"""
# of faulty messages only one with a wrong type gives its other fields
READABLE = "(fault IS NULL OR fault = 'text')"

EV = f"""ev AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
         CAST(ts AS TIMESTAMP) AS transactiondate,
         'user_' || CAST(user_id AS VARCHAR) AS sender_name,
         'street ' || (user_id % 90) AS sender_address,
         CAST(user_id AS VARCHAR) AS sender_account_number,
         'BANK_' || (user_id % 7) AS sender_bank_name,
         CASE WHEN user_id % 3 > 0 THEN 'SW' || (user_id % 7) END AS sender_swift_code,
         'user_' || (event_id % 1000) AS receiver_name,
         CAST(event_id % 1000 AS VARCHAR) AS receiver_account_number,
         CASE WHEN event_id % 10 > 0 THEN 'OK' ELSE 'FAILED' END AS status,
         CAST(event_id % 50 AS DOUBLE) AS fee_usd,
         CASE WHEN event_id % 2 > 0 THEN 'REF-' || event_id END AS reference,
         '10.0.0.' || (user_id % 250) AS ip_address,
         CASE event_id % 4 WHEN 0 THEN 'MOBILE_APP' WHEN 1 THEN 'WEB' WHEN 2 THEN 'BRANCH' ELSE 'API' END AS channel,
         {FAULT} AS fault,
         CAST(value AS DECIMAL(18,2)) AS amount_usd,
         value AS amount_double,
         'NATION_' || CAST(user_id % 25 AS VARCHAR) AS sender_country,
         'NATION_' || CAST(event_id % 25 AS VARCHAR) AS receiver_country,
         event_type AS transaction_type,
         json_extract_string(props, '$.k') AS device_id,
         CAST(ts AS TIMESTAMP) AS processing_time,
         event_id, user_id, value, ts
  FROM events)"""

TR = """tr AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
         l_extendedprice AS amount, CAST(l_shipdate AS TIMESTAMP) AS ts, l_suppkey AS account,
         l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount
  FROM lineitem)"""

TEST_COUNTRIES = "('NATION_3', 'NATION_7', 'NATION_11', 'NATION_19')"


def susp(threshold: str) -> str:
    return (f"(COALESCE(CAST(amount_usd AS DOUBLE), 0) >= {threshold}"
            f" OR COALESCE(sender_country IN {TEST_COUNTRIES}, FALSE)"
            f" OR COALESCE(receiver_country IN {TEST_COUNTRIES}, FALSE))")


SUSP_TXN = susp("450000")
SUSP_EV = susp("200")

ORACLE: dict[str, str] = {}

ORACLE["a2_summarize_events"] = f"""
WITH {EV}
SELECT transaction_type, COUNT(*) AS n_transactions,
       CAST(SUM(amount_usd) AS DOUBLE) AS total_amount,
       CAST(SUM(amount_usd) AS DOUBLE) / COUNT(amount_usd) AS avg_amount,
       CAST(MIN(amount_usd) AS DOUBLE) AS min_amount,
       CAST(MAX(amount_usd) AS DOUBLE) AS max_amount,
       COUNT(*) FILTER (WHERE {SUSP_EV}) AS n_suspicious
FROM ev GROUP BY transaction_type"""

PERSON_TEXT = """'{"name":"' || sender_name || '","address":"' || sender_address || '","account_number":"' || sender_account_number
       || '","bank_name":"' || sender_bank_name || '"' || coalesce(',"swift_code":"' || sender_swift_code || '"', '') || '}'"""
RECEIVER_TEXT = """'{"name":"' || receiver_name || '","account_number":"' || receiver_account_number || '"}'"""
METADATA_TEXT = """'{"ip_address":"' || ip_address || '"' || coalesce(',"device_id":"' || device_id || '"', '') || ',"channel":"' || channel || '"}'"""
ISO_TS = """CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"""
# the message as the bus carries it; the amount's digits are the engine's own text of a double
MESSAGE = f"""'{{"transaction_id":"' || transaction_id || '","timestamp":"' || {ISO_TS} || '","sender":' || {PERSON_TEXT}
       || ',"receiver":' || {RECEIVER_TEXT} || ',"amount_usd":' || CASE WHEN fault = 'text' THEN '"' ELSE '' END
       || CASE WHEN fault = 'nan' THEN 'NaN' ELSE CAST(amount_double AS VARCHAR) END || CASE WHEN fault = 'text' THEN '"' ELSE '' END || ',"sender_country":"' || sender_country || '","receiver_country":"' || receiver_country
       || '","transaction_type":"' || transaction_type || '","status":"' || status || '","fee_usd":' || CAST(fee_usd AS VARCHAR)
       || coalesce(',"reference":"' || reference || '"', '') || ',"metadata":' || {METADATA_TEXT} || CASE WHEN fault = 'cut' THEN '' ELSE '}}' END
       || CASE WHEN fault = 'twice' THEN '{{"transaction_id":"again"}}' ELSE '' END"""
MESSAGE = f"CASE fault WHEN 'none' THEN '(no message body)' WHEN 'empty' THEN '{{}}' ELSE {MESSAGE} END"


def unless_cut(c: str, name: str | None = None) -> str:
    return f"CASE WHEN {READABLE} THEN {c} END AS {name or c}"


ORACLE["s2_decode_events"] = f"""
WITH {EV}
SELECT {unless_cut('transaction_id')}, {unless_cut(ISO_TS, '"timestamp"')}, {unless_cut('sender_name')},
       CASE WHEN fault IS NULL THEN amount_double END AS amount_usd, {unless_cut('sender_country')}, {unless_cut('receiver_country')},
       {unless_cut('transaction_type')}, {unless_cut('device_id')}, fault IS NOT NULL AS is_corrupt,
       CASE WHEN fault IS NOT NULL THEN {MESSAGE} END AS decode_error
FROM ev"""

ORACLE["p1_project_stream"] = f"""
WITH {EV}
SELECT transaction_id, transactiondate, {PERSON_TEXT} AS sender, {RECEIVER_TEXT} AS receiver,
       amount_double AS amount_usd, sender_country, receiver_country, transaction_type, status, fee_usd, reference,
       {METADATA_TEXT} AS metadata, processing_time AS "Processingtime"
FROM ev"""

EV_FLAT = """transaction_id, transactiondate, sender_name, sender_address, sender_account_number, sender_bank_name, sender_swift_code,
       receiver_name, CAST(NULL AS VARCHAR) AS receiver_address, receiver_account_number, CAST(NULL AS VARCHAR) AS receiver_bank_name,
       CAST(NULL AS VARCHAR) AS receiver_swift_code, {amount} AS amount_usd, sender_country, receiver_country, transaction_type, status,
       fee_usd, reference, processing_time, ip_address, device_id, CAST(NULL AS VARCHAR) AS user_agent, channel"""

ORACLE["p2_flatten"] = f"WITH {EV} SELECT {EV_FLAT.format(amount='amount_double')} FROM ev"

ORACLE["p3_conform_flat"] = f"WITH {EV} SELECT {EV_FLAT.format(amount='CAST(amount_usd AS DOUBLE)')} FROM ev"

ORACLE["v1_validate"] = f"""
WITH {TXN}, r AS (
  SELECT transaction_id, CAST(transaction_id AS BIGINT) % 23 = 0 AS long_country, CAST(transaction_id AS BIGINT) % 19 = 0 AS long_address FROM txn)
SELECT transaction_id, concat_ws(',', CASE WHEN long_address THEN 'too_long:sender_address' END,
                                 CASE WHEN long_country THEN 'too_long:receiver_country' END) AS reasons
FROM r WHERE long_address OR long_country"""

ORACLE["f1_is_high_amount"] = f"""
WITH {TXN} SELECT transaction_id, COALESCE(amount_usd >= 450000, FALSE) AS is_high_amount FROM txn"""

ORACLE["f2_is_sanctioned"] = f"""
WITH {TXN}
SELECT transaction_id, (COALESCE(sender_country IN {TEST_COUNTRIES}, FALSE)
                        OR COALESCE(receiver_country IN {TEST_COUNTRIES}, FALSE)) AS is_sanctioned
FROM txn"""

ORACLE["f3_flag_suspicious"] = f"""
WITH {TXN} SELECT transaction_id, {SUSP_TXN} AS is_suspicious FROM txn"""

ORACLE["f4_flag_reasons"] = f"""
WITH {TXN}
SELECT transaction_id,
       concat_ws(',', CASE WHEN amount_usd >= 450000 THEN 'HIGH_AMOUNT' END,
                      CASE WHEN sender_country IN {TEST_COUNTRIES} THEN 'SANCTIONED_SENDER_COUNTRY' END,
                      CASE WHEN receiver_country IN {TEST_COUNTRIES} THEN 'SANCTIONED_RECEIVER_COUNTRY' END) AS reasons
FROM txn"""

ORACLE["f5_route"] = f"""
WITH {TXN}
SELECT CASE WHEN {SUSP_TXN} THEN 'suspicious' ELSE 'normal' END AS route, transaction_type,
       COUNT(*) AS n, CAST(SUM(amount_usd) AS DOUBLE) AS total_amount
FROM txn GROUP BY 1, 2"""

ORACLE["f6_flag_dormant"] = f"""
WITH {TXN},
p AS (SELECT *, LAG(transactiondate) OVER (PARTITION BY sender_account_number
                                           ORDER BY transactiondate, transaction_id) AS prev_ts
      FROM txn)
SELECT transaction_id, sender_account_number, prev_ts,
       (epoch_us(transactiondate) - epoch_us(prev_ts)) / 1e6 AS gap_seconds
FROM p
WHERE prev_ts IS NOT NULL AND epoch_us(transactiondate) - epoch_us(prev_ts) >= 15552000000000
  AND amount_usd >= 400000"""

ORACLE["f7_expected_fee"] = """
SELECT event_id,
       CAST(ROUND(LEAST(5 + CAST(value AS DECIMAL(18,2)) * 0.01, 50), 2) AS DOUBLE) AS expected_fee
FROM events"""

ORACLE["f8_fee_audit"] = f"""
WITH {TR},
a AS (SELECT id, l_orderkey, l_linenumber, amount,
             ROUND(5 + CAST(amount AS DECIMAL(18,2)) * 0.01, 2) AS fee,
             ROUND(LEAST(5 + CAST(amount AS DECIMAL(18,2)) * 0.01, 50), 2) AS expected_fee
      FROM tr)
SELECT id, l_orderkey, l_linenumber, amount, CAST(fee AS DOUBLE) AS fee,
       CAST(expected_fee AS DOUBLE) AS expected_fee, CAST(fee - expected_fee AS DOUBLE) AS fee_diff
FROM a WHERE abs(fee - expected_fee) > 0.01"""

ORACLE["j1_sanction_table"] = f"""
WITH {TXN},
s AS (SELECT DISTINCT n_name FROM nation WHERE n_regionkey = 2)
SELECT transaction_id,
       sender_country IN (SELECT n_name FROM s) AS sanctioned_sender,
       receiver_country IN (SELECT n_name FROM s) AS sanctioned_receiver,
       (sender_country IN (SELECT n_name FROM s) OR receiver_country IN (SELECT n_name FROM s)) AS is_sanctioned
FROM txn"""

ORACLE["l1_preview"] = f"""
WITH {TXN}
SELECT transaction_id, transactiondate, sender_name, CAST(amount_usd AS DOUBLE) AS amount_usd, channel
FROM txn ORDER BY transaction_id LIMIT 1000"""

ORACLE["l2_bounded_sample"] = f"""
WITH {TXN},
n AS (SELECT COUNT(*) AS total_rows FROM txn)
SELECT t.transaction_id, CAST(t.amount_usd AS DOUBLE) AS amount_usd, t.transaction_type,
       n.total_rows, n.total_rows > 50 AS is_partial, LEAST(n.total_rows, 50) >= 40 AS needs_caveat
FROM (SELECT * FROM txn ORDER BY amount_usd DESC, transaction_id LIMIT 50) t, n"""

ORACLE["l3_top_n"] = f"""
WITH {TXN}
SELECT transaction_id, sender_name, CAST(amount_usd AS DOUBLE) AS amount_usd
FROM txn ORDER BY amount_usd DESC NULLS LAST, transaction_id LIMIT 10"""

ORACLE["l4_latest"] = f"""
WITH {TXN}
SELECT transaction_id, transactiondate, CAST(amount_usd AS DOUBLE) AS amount_usd
FROM txn ORDER BY transactiondate DESC NULLS LAST, transaction_id LIMIT 5"""

ORACLE["l5_limit_categories"] = f"""
WITH {TXN},
k AS (SELECT COUNT(DISTINCT sender_country) AS n_distinct FROM txn)
SELECT * FROM (
  SELECT transaction_id, sender_country, CAST(amount_usd AS DOUBLE) AS amount_usd, k.n_distinct
  FROM txn, k WHERE k.n_distinct < 10
  UNION ALL
  SELECT t.transaction_id, t.sender_country, CAST(t.amount_usd AS DOUBLE), k.n_distinct
  FROM (SELECT * FROM txn ORDER BY amount_usd DESC NULLS LAST, transaction_id LIMIT 10) t, k
  WHERE k.n_distinct >= 10)"""

ORACLE["l5_limit_categories_bar"] = (ORACLE["l5_limit_categories"].replace("n_distinct < 10", "n_distinct <= 25")
                                     .replace("LIMIT 10)", "LIMIT 20)").replace("n_distinct >= 10", "n_distinct > 25"))

ORACLE["w4_top_n_per_group"] = f"""
WITH {TXN}
SELECT transaction_type, rank, transaction_id, CAST(amount_usd AS DOUBLE) AS amount_usd FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY transaction_type
                                    ORDER BY amount_usd DESC NULLS LAST, transaction_id) AS INTEGER) AS rank
  FROM txn) WHERE rank <= 3"""

ORACLE["a1_row_count"] = f"WITH {TXN} SELECT COUNT(*) AS n_rows FROM txn"

ORACLE["a2_summarize"] = f"""
WITH {TXN}
SELECT transaction_type, COUNT(*) AS n_transactions,
       CAST(SUM(amount_usd) AS DOUBLE) AS total_amount,
       CAST(SUM(amount_usd) AS DOUBLE) / COUNT(amount_usd) AS avg_amount,
       CAST(MIN(amount_usd) AS DOUBLE) AS min_amount,
       CAST(MAX(amount_usd) AS DOUBLE) AS max_amount,
       CAST(SUM(fee_usd) AS DOUBLE) AS total_fee,
       COUNT(*) FILTER (WHERE {SUSP_TXN}) AS n_suspicious
FROM txn GROUP BY transaction_type"""

ORACLE["a3_radar_data"] = f"""
WITH {TXN} SELECT channel, CAST(SUM(amount_usd) AS DOUBLE) AS total_amount FROM txn GROUP BY channel"""

ORACLE["a4_bar_data"] = "SELECT l_returnflag, SUM(l_quantity) AS sum_qty FROM lineitem GROUP BY l_returnflag"

ORACLE["a5_bar_mean_data"] = f"""
WITH {TXN},
k AS (SELECT COUNT(DISTINCT sender_country) AS n FROM txn),
rows_used AS (
  SELECT sender_country, amount_usd FROM txn, k WHERE k.n <= 20
  UNION ALL
  SELECT t.sender_country, t.amount_usd
  FROM (SELECT * FROM txn ORDER BY amount_usd DESC NULLS LAST, transaction_id LIMIT 20) t, k WHERE k.n > 20)
SELECT sender_country, CAST(SUM(amount_usd) AS DOUBLE) / COUNT(amount_usd) AS mean_amount_usd,
       COUNT(*) AS n_rows, (SELECT n FROM k) > 20 AS showing_only
FROM rows_used GROUP BY sender_country"""

ORACLE["a5_bar_mean_data_few"] = f"""
WITH {TXN}
SELECT transaction_type, CAST(SUM(amount_usd) AS DOUBLE) / COUNT(amount_usd) AS mean_amount_usd,
       COUNT(*) AS n_rows, FALSE AS showing_only
FROM txn GROUP BY transaction_type"""

ORACLE["a6_pie_data"] = f"""
WITH {TXN}
SELECT transaction_type, CAST(SUM(amount_usd) AS DOUBLE) AS value,
       CAST(SUM(amount_usd) AS DOUBLE) / CAST((SELECT SUM(amount_usd) FROM txn) AS DOUBLE) AS share,
       'pie' AS chart
FROM txn GROUP BY transaction_type"""

ORACLE["a6_pie_data_many"] = f"""
WITH {TXN}
SELECT receiver_country, CAST(amount_usd AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS share, 'hbar' AS chart
FROM txn ORDER BY amount_usd DESC NULLS LAST, transaction_id LIMIT 10"""

ORACLE["a7_hbar_data"] = f"""
WITH {TXN}
SELECT sender_name, CAST(amount_usd AS DOUBLE) AS amount_usd
FROM txn ORDER BY amount_usd DESC NULLS LAST, transaction_id LIMIT 10"""

ORACLE["a8_value_counts"] = f"""
WITH {TXN}
SELECT status, COUNT(*) AS count,
       ROUND(COUNT(*) * 100.0 / (SELECT COUNT(status) FROM txn), 1) AS pct
FROM txn WHERE status IS NOT NULL GROUP BY status"""

ORACLE["a9_line_mean_data"] = f"""
WITH {TXN},
g AS (SELECT CAST(year(transactiondate) AS INTEGER) AS order_year,
             CAST(SUM(amount_usd) AS DOUBLE) / COUNT(amount_usd) AS mean,
             stddev_samp(CAST(amount_usd AS DOUBLE)) AS sd, COUNT(amount_usd) AS n
      FROM txn GROUP BY 1)
SELECT order_year, ROUND(mean, 4) AS mean, ROUND(sd, 4) AS sd, n,
       ROUND(mean - 1.96 * sd / sqrt(n), 4) AS ci_low, ROUND(mean + 1.96 * sd / sqrt(n), 4) AS ci_high
FROM g"""

# a row's weight in a replicate: how many Poisson(1) thresholds 16 bits of a digest reach
REACHED = "[24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535]"
ORACLE["a9_line_mean_bootstrap"] = f"""
WITH {TXN},
y AS (SELECT year(transactiondate) AS order_year, transaction_id, amount_usd FROM txn),
d AS (SELECT order_year, amount_usd, b.block, md5(transaction_id || ':0:' || b.block) AS h FROM y, (SELECT unnest(range(125)) AS block) b),
w AS (SELECT order_year, block * 8 + i.i AS replicate, amount_usd,
             len(list_filter({REACHED}, lambda t: t <= ('0x' || substr(h, CAST(4 * i.i + 1 AS BIGINT), 4))::INTEGER)) AS w
      FROM d, (SELECT unnest(range(8)) AS i) i),
m AS (SELECT order_year, replicate, CAST(SUM(amount_usd * w) AS DOUBLE) / SUM(w) AS mean FROM w GROUP BY 1, 2 HAVING SUM(w) > 0),
e AS (SELECT order_year, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM m GROUP BY 1)
SELECT CAST(order_year AS INTEGER) AS order_year, ROUND(CAST(SUM(amount_usd) AS DOUBLE) / COUNT(*), 4) AS mean, COUNT(*) AS n,
       ROUND(any_value(lo), 4) AS ci_low, ROUND(any_value(hi), 4) AS ci_high
FROM y JOIN e USING (order_year) GROUP BY 1"""

ORACLE["a23_stored_distinct"] = f"WITH {TXN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(3 AS BIGINT) AS n_loads, COUNT(*) AS n_rows, COUNT(DISTINCT {c}) AS exact, TRUE AS near FROM txn"
    for c in ("transaction_id", "sender_account_number", "sender_swift_code"))

ORACLE["a23_distinct_count"] = f"WITH {TXN} SELECT COUNT(DISTINCT sender_account_number) AS n_distinct FROM txn"

ORACLE["a25_corridors"] = f"""
WITH {TXN}
SELECT sender_country, receiver_country, COUNT(*) AS n_transactions,
       CAST(SUM(amount_usd) AS DOUBLE) AS total_amount,
       COUNT(*) FILTER (WHERE {SUSP_TXN}) AS n_suspicious,
       GROUPING(sender_country, receiver_country) AS level
FROM txn GROUP BY CUBE (sender_country, receiver_country)"""

ORACLE["a10_points"] = f"""
WITH {TXN} SELECT transaction_id, transactiondate, CAST(amount_usd AS DOUBLE) AS amount_usd FROM txn"""


def hist_sql(src: str, col: str, bins: int) -> str:
    return f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CASE WHEN b.hi - b.lo = 0 THEN 0
                  ELSE LEAST(CAST(floor((v.x - b.lo) * {float(bins)} / (b.hi - b.lo)) AS BIGINT), {bins - 1}) END AS bin,
             COUNT(*) AS count
      FROM v, b GROUP BY 1),
s AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT s.bin, ROUND(b.lo + s.bin * ((b.hi - b.lo) / {float(bins)}), 6) AS bin_lo,
       ROUND(b.lo + (s.bin + 1) * ((b.hi - b.lo) / {float(bins)}), 6) AS bin_hi,
       CAST(COALESCE(c.count, 0) AS BIGINT) AS count
FROM s CROSS JOIN b LEFT JOIN c ON s.bin = c.bin"""


ORACLE["a11_histogram"] = hist_sql("events", "value", 10)
ORACLE["a11_histogram_amount"] = f"WITH {TXN} " + hist_sql("txn", "amount_usd", 20).replace("WITH v AS", ", v AS", 1).lstrip()
ORACLE["a11_histogram_amount"] = ORACLE["a11_histogram_amount"].replace(f"WITH {TXN} , v AS", f"WITH {TXN}, v AS")

ORACLE["a12_density_heatmap"] = """
WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM v),
k AS (SELECT CASE WHEN hx - lx = 0 THEN 0 ELSE LEAST(CAST(floor((x - lx) * 10.0 / (hx - lx)) AS INTEGER), 9) END AS x_bin,
             CASE WHEN hy - ly = 0 THEN 0 ELSE LEAST(CAST(floor((y - ly) * 12.0 / (hy - ly)) AS INTEGER), 11) END AS y_bin
      FROM v, b)
SELECT x_bin, y_bin, COUNT(*) AS count, GROUPING(x_bin, y_bin) AS level
FROM k GROUP BY GROUPING SETS ((x_bin, y_bin), (x_bin), (y_bin))"""


def box_sql(src: str, g: str, y: str) -> str:
    return f"""
SELECT {g},
       ROUND(CAST(min(CAST({y} AS DOUBLE)) AS DOUBLE), 4) AS min, ROUND(max(CAST({y} AS DOUBLE)), 4) AS max,
       COUNT({y}) AS n,
       ROUND(quantile_cont(CAST({y} AS DOUBLE), 0.25), 4) AS q1,
       ROUND(quantile_cont(CAST({y} AS DOUBLE), 0.5), 4) AS median,
       ROUND(quantile_cont(CAST({y} AS DOUBLE), 0.75), 4) AS q3,
       ROUND(quantile_cont(CAST({y} AS DOUBLE), 0.75) - quantile_cont(CAST({y} AS DOUBLE), 0.25), 4) AS iqr
FROM {src} GROUP BY {g}"""


ORACLE["a13_box_stats"] = f"WITH {TXN} " + box_sql("txn", "transaction_type", "amount_usd")
ORACLE["a13_box_stats_skewed"] = box_sql(
    "(SELECT CASE WHEN l_linenumber > 0 THEN 'all' END AS grp, l_extendedprice FROM lineitem)", "grp", "l_extendedprice")

ORACLE["a14_violin_stats"] = """
WITH li AS (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem)
SELECT l_returnflag, l_linestatus,
       ROUND(CAST(SUM(price) AS DOUBLE) / COUNT(price), 4) AS mean, COUNT(price) AS n,
       ROUND(quantile_cont(CAST(price AS DOUBLE), 0.25), 4) AS q1,
       ROUND(quantile_cont(CAST(price AS DOUBLE), 0.5), 4) AS median,
       ROUND(quantile_cont(CAST(price AS DOUBLE), 0.75), 4) AS q3
FROM li GROUP BY l_returnflag, l_linestatus"""

ORACLE["a15_kde"] = """
WITH v AS (SELECT event_type, CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL),
tot AS (SELECT COUNT(*) AS total FROM v),
st AS (SELECT event_type, COUNT(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v GROUP BY 1),
p AS (SELECT event_type, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, mn, mx FROM st),
q AS (SELECT event_type, n, bw, mn - 3.0 * bw AS glo, (mx + 3.0 * bw - (mn - 3.0 * bw)) / 199.0 AS step FROM p),
g AS (SELECT q.*, CAST(r.range AS INTEGER) AS grid_index FROM q, range(200) r),
d AS (SELECT g.event_type, g.grid_index, g.glo + g.grid_index * g.step AS x,
             SUM(exp(-0.5 * pow((g.glo + g.grid_index * g.step - v.x) / g.bw, 2))) AS ksum,
             any_value(g.n) AS n, any_value(g.bw) AS bw
      FROM g JOIN v ON g.event_type = v.event_type GROUP BY 1, 2, 3)
SELECT event_type, grid_index, ROUND(x, 6) AS x,
       ROUND(ksum / (n * bw * sqrt(2 * pi())) * (n / (SELECT total FROM tot)) * 1e6, 4) AS density_e6
FROM d"""

ORACLE["a15_kde_binned"] = """
WITH v AS (SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL),
st AS (SELECT COUNT(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v),
q AS (SELECT n, mn, mx, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st),
q2 AS (SELECT n, mn, mx, bw, mn - 3.0 * bw AS glo, (mx + 3.0 * bw - (mn - 3.0 * bw)) / 199.0 AS step FROM q),
b AS (SELECT CASE WHEN q2.mx = q2.mn THEN 0
                  ELSE LEAST(CAST(floor((v.x - q2.mn) * 1000.0 / (q2.mx - q2.mn)) AS BIGINT), 999) END AS bin,
             COUNT(*) AS w
      FROM v, q2 GROUP BY 1),
c AS (SELECT q2.mn + (b.bin + 0.5) * ((q2.mx - q2.mn) / 1000.0) AS cx, CAST(b.w AS DOUBLE) AS w FROM b, q2),
g AS (SELECT q2.*, CAST(r.range AS INTEGER) AS grid_index FROM q2, range(200) r),
d AS (SELECT g.grid_index, g.glo + g.grid_index * g.step AS x,
             SUM(c.w * exp(-0.5 * pow((g.glo + g.grid_index * g.step - c.cx) / g.bw, 2))) AS ksum,
             any_value(g.n) AS n, any_value(g.bw) AS bw
      FROM g, c GROUP BY 1, 2)
SELECT grid_index, ROUND(x, 6) AS x, ROUND(ksum / (n * bw * sqrt(2 * pi())) * 1e6, 4) AS density_e6
FROM d"""

def curve_sql(src: str, by: str, grid: int, cut: float) -> str:
    """Exact kernel density per group, every area 1."""
    return f"""
WITH v AS ({src}),
st AS (SELECT {by}, COUNT(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v GROUP BY 1),
p AS (SELECT {by}, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, mn, mx FROM st),
q AS (SELECT {by}, n, bw, mn - {cut} * bw AS glo, (mx + {cut} * bw - (mn - {cut} * bw)) / {grid - 1}.0 AS step FROM p),
g AS (SELECT q.*, CAST(r.range AS INTEGER) AS grid_index FROM q, range({grid}) r),
c AS (SELECT {by}, x, COUNT(*) AS w FROM v GROUP BY 1, 2),
d AS (SELECT g.{by}, g.grid_index, g.glo + g.grid_index * g.step AS x,
             SUM(c.w * exp(-0.5 * pow((g.glo + g.grid_index * g.step - c.x) / g.bw, 2))) AS ksum,
             any_value(g.n) AS n, any_value(g.bw) AS bw
      FROM g JOIN c ON g.{by} = c.{by} GROUP BY 1, 2, 3)
SELECT {by}, grid_index, ROUND(x, 6) AS x, ROUND(ksum / (n * bw * sqrt(2 * pi())) * 1e6, 4) AS density_e6 FROM d"""


ORACLE["a14_violin_grid"] = curve_sql("SELECT event_type, CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL", "event_type", 50, 2.0)
ORACLE["a15_kde_columns"] = curve_sql(
    "SELECT 'l_quantity' AS series, CAST(l_quantity AS DOUBLE) AS x FROM lineitem UNION ALL SELECT 'l_discount', CAST(l_discount AS DOUBLE) FROM lineitem",
    "series", 100, 3.0)
ORACLE["a15_density_histogram"] = f"""
SELECT h.*, ROUND(count / ((SELECT COUNT(value) FROM events) * ((SELECT max(value) - min(value) FROM events) / 10.0)), 6) AS density
FROM ({hist_sql("events", "value", 10)}) h"""

ORACLE["a16_corr_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM lineitem"
    for a in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])

ORACLE["a17_pivot_heatmap"] = f"""
WITH {TXN},
top AS (SELECT sender_country, transaction_type, CAST(amount_usd AS DOUBLE) AS v FROM txn
        ORDER BY amount_usd DESC NULLS LAST, transaction_id LIMIT 10),
xs AS (SELECT DISTINCT sender_country FROM top),
ys AS (SELECT DISTINCT transaction_type FROM top),
m AS (SELECT sender_country, transaction_type, avg(v) AS v FROM top GROUP BY 1, 2)
SELECT xs.sender_country, ys.transaction_type, ROUND(COALESCE(m.v, 0.0), 4) AS value
FROM xs CROSS JOIN ys
LEFT JOIN m ON m.sender_country = xs.sender_country AND m.transaction_type = ys.transaction_type"""

GEO = """geo AS (SELECT r.r_name, n.n_name, c.c_mktsegment, CAST(c.c_acctbal AS DECIMAL(18,2)) AS acctbal
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

ORACLE["a18_sunburst"] = f"""
WITH {GEO},
g AS (SELECT r_name, n_name, c_mktsegment, CAST(SUM(acctbal) AS DOUBLE) AS value,
             CAST(3 - GROUPING(r_name) - GROUPING(n_name) - GROUPING(c_mktsegment) AS INTEGER) AS depth
      FROM geo GROUP BY ROLLUP (r_name, n_name, c_mktsegment))
SELECT r_name, n_name, c_mktsegment, value, depth,
       concat_ws('/', r_name, n_name, c_mktsegment) AS node_id,
       CASE depth WHEN 1 THEN '' WHEN 2 THEN r_name ELSE r_name || '/' || n_name END AS parent_id
FROM g WHERE depth > 0"""

ORACLE["a19_treemap"] = """
WITH g AS (SELECT p_type, p_brand, SUM(p_size) AS value,
                  SUM(CAST(p_retailprice AS DOUBLE) * CAST(p_size AS DOUBLE)) / SUM(CAST(p_size AS DOUBLE)) AS color,
                  CAST(2 - GROUPING(p_type) - GROUPING(p_brand) AS INTEGER) AS depth
           FROM part GROUP BY ROLLUP (p_type, p_brand))
SELECT p_type, p_brand, value, ROUND(color, 6) AS color, depth,
       concat_ws('/', p_type, p_brand) AS node_id,
       CASE depth WHEN 1 THEN '' ELSE p_type END AS parent_id
FROM g WHERE depth > 0"""

ORACLE["a20_funnel"] = """
WITH g AS (SELECT event_type, SUM(CAST(value AS DECIMAL(18,2))) AS value, min(event_type) AS pos
           FROM events GROUP BY event_type)
SELECT event_type, CAST(value AS DOUBLE) AS value, pos,
       ROUND(CAST(value AS DOUBLE) / CAST((SELECT value FROM g ORDER BY pos NULLS LAST, event_type LIMIT 1) AS DOUBLE), 6)
         AS share_of_first
FROM g"""

ORACLE["a21_choropleth"] = f"""
WITH {TXN}
SELECT receiver_country, CAST(SUM(amount_usd) AS DOUBLE) AS value, min(sender_name) AS hover_name
FROM txn GROUP BY receiver_country"""

STOP = ("a about above after again against all am an and any are as at be because been before being "
        "below between both but by can could did do does doing down during each few for from further "
        "had has have having he her here hers herself him himself his how i if in into is it its itself "
        "just me more most my myself no nor not of off on once only or other our ours ourselves out over "
        "own same she should so some such than that the their theirs them themselves then there these they "
        "this those through to too under until up very was we were what when where which while who whom "
        "why will with would you your yours yourself yourselves").split()
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)

ORACLE["a22_word_counts"] = f"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']+')) AS word
           FROM documents)
SELECT word, COUNT(*) AS count FROM w WHERE word NOT IN ({STOP_SQL})
GROUP BY word ORDER BY count DESC, word LIMIT 200"""

ORACLE["w1_cumulative"] = f"""
WITH {TXN}
SELECT transaction_id, transaction_type, CAST(amount_usd AS DOUBLE) AS amount_usd,
       CAST(SUM(amount_usd) OVER (PARTITION BY transaction_type ORDER BY transactiondate, transaction_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative_sum
FROM txn"""

ORACLE["w2_activity_gap"] = """
WITH p AS (SELECT event_id, user_id, ts,
                  LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts FROM events)
SELECT event_id, user_id, prev_ts, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 AS gap_seconds FROM p"""

ORACLE["w3_share_of_total"] = f"""
WITH {TXN},
s AS (SELECT channel, SUM(amount_usd) AS total_amount FROM txn GROUP BY channel)
SELECT channel, CAST(total_amount AS DOUBLE) AS total_amount,
       ROUND(CAST(total_amount AS DOUBLE) / CAST((SELECT SUM(total_amount) FROM s) AS DOUBLE), 9) AS share
FROM s"""

ORACLE["u1_union_routes"] = f"""
WITH {TXN}
SELECT transaction_id, CASE WHEN {SUSP_TXN} THEN 'suspicious' ELSE 'normal' END AS route,
       CASE WHEN {SUSP_TXN} THEN channel END AS channel
FROM txn"""

ORACLE["u2_dedup_earliest"] = f"""
WITH {TR},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ts, amount, account, l_orderkey, l_partkey,
                                                            l_linenumber, l_quantity, l_discount) AS rn,
             COUNT(*) OVER (PARTITION BY id) AS n_copies
      FROM tr)
SELECT id, ts, amount, account, l_partkey, n_copies FROM r WHERE rn = 1"""

ORACLE["u3_reconcile"] = f"""
WITH {TR},
landed AS (SELECT id FROM tr WHERE l_linenumber <> 3
           UNION ALL SELECT id FROM tr WHERE l_linenumber = 1
           UNION ALL SELECT id || '-x' FROM tr WHERE l_linenumber = 2),
s AS (SELECT id, COUNT(*) AS n_source FROM tr GROUP BY id),
l AS (SELECT id, COUNT(*) AS n_landed FROM landed GROUP BY id),
j AS (SELECT COALESCE(s.id, l.id) AS id, COALESCE(n_source, 0) AS n_source, COALESCE(n_landed, 0) AS n_landed
      FROM s FULL OUTER JOIN l ON s.id = l.id)
SELECT id, n_source, n_landed,
       CASE WHEN n_landed = 0 THEN 'missing' WHEN n_source = 0 THEN 'extra'
            WHEN n_landed > n_source THEN 'duplicated' ELSE 'matched' END AS status
FROM j"""

# ---------------------------------------------------------------- streams, sinks, reports
EVS = f"""evs AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, event_id, user_id, ts, value, event_type,
         'NATION_' || CAST(user_id % 25 AS VARCHAR) AS sc, 'NATION_' || CAST(event_id % 25 AS VARCHAR) AS rc,
         {FAULT} AS fault
  FROM events)"""
EV_HIGH = "value >= 200"
EV_SS = f"sc IN {TEST_COUNTRIES}"
EV_RS = f"rc IN {TEST_COUNTRIES}"
EV_SUSP = f"({EV_HIGH} OR {EV_SS} OR {EV_RS})"
EV_REASONS = (f"""'[' || concat_ws(',', CASE WHEN {EV_HIGH} THEN '"HIGH_AMOUNT"' END,
                                  CASE WHEN {EV_SS} THEN '"SANCTIONED_SENDER_COUNTRY"' END,
                                  CASE WHEN {EV_RS} THEN '"SANCTIONED_RECEIVER_COUNTRY"' END) || ']'""")

EV_ROUTE = f"CASE WHEN fault IS NOT NULL THEN 'quarantine' WHEN {EV_SUSP} THEN 'suspicious' ELSE 'normal' END"
# a text amount gives only no amount, every other fault no field at all
EV_SEEN = f"""seen AS (
  SELECT CASE WHEN {READABLE} THEN transaction_id END AS transaction_id, {EV_ROUTE} AS route, ts,
         CASE WHEN fault IS NULL THEN value END AS amount_usd, fault,
         CASE WHEN NOT {READABLE} THEN '[]'
              WHEN fault = 'text' THEN {EV_REASONS.replace("WHEN value >= 200", "WHEN FALSE")}
              ELSE {EV_REASONS} END AS flag_reasons
  FROM evs)"""

ORACLE["t1_monitor_stream"] = f"""
WITH {EVS}, {EV_SEEN}
SELECT transaction_id, route, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
       amount_usd, flag_reasons, fault IS NOT NULL AS is_corrupt
FROM seen"""

ORACLE["t3_run_available"] = f"""
WITH {EVS}, {EV_SEEN}
SELECT route, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, COUNT(*) AS n,
       CAST(SUM(CAST(amount_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM seen GROUP BY 1, 2, 3"""

ORACLE["a24_run_metrics"] = f"""
WITH {EVS}, {EV_SEEN}
SELECT route || '/' || strftime(ts, '%Y/%m/%d') AS folder, COUNT(*) AS n_rows,
       COUNT(*) FILTER (WHERE fault IS NOT NULL) AS n_errors, COUNT(*) FILTER (WHERE fault IS NULL) AS n_processed,
       COUNT(*) FILTER (WHERE route = 'suspicious') AS n_suspicious, COUNT(*) FILTER (WHERE route <> 'suspicious') AS n_normal
FROM seen GROUP BY 1"""

SLICE = """CAST(CASE WHEN (SELECT max(epoch(ts)) > min(epoch(ts)) FROM events)
                THEN LEAST(floor((epoch(ts) - (SELECT min(epoch(ts)) FROM events)) * 4.0
                                 / ((SELECT max(epoch(ts)) FROM events) - (SELECT min(epoch(ts)) FROM events))), 3) ELSE 0 END AS INTEGER)"""

ORACLE["t2_batch_sizing"] = f"SELECT {SLICE} AS batch_id, COUNT(*) AS n_rows FROM events GROUP BY 1"

ORACLE["s9_resume"] = """
WITH m AS (SELECT min(epoch_us(ts)) + max(epoch_us(ts)) AS twice FROM events)
SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(1 AS BIGINT) AS n_landed,
       CASE WHEN epoch_us(ts) * 2 <= twice THEN 0 ELSE 1 END AS batch_id
FROM events, m"""

ORACLE["t10_late_data"] = f"""
SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end,
       event_type, COUNT(*) AS n
FROM events WHERE {SLICE} > 0 GROUP BY 1, 2, 3"""

ORACLE["t10_late_rows"] = f"SELECT * FROM events WHERE {SLICE} = 0"

ORACLE["t10_window_parts"] = ORACLE["t10_late_data"]

ORACLE["t4_dormant_stream"] = """
WITH p AS (SELECT user_id, event_id, ts, value,
                  LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS prev_ts
           FROM events)
SELECT CAST(user_id AS VARCHAR) AS account, CAST(event_id AS VARCHAR) AS id, ts, prev_ts,
       (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 AS gap_seconds, value AS amount
FROM p WHERE prev_ts IS NOT NULL AND epoch_us(ts) - epoch_us(prev_ts) >= 86400000000 AND value >= 100"""

NL = " || chr(10) || "


def iso(ts: str) -> str:
    return (f"CASE WHEN microsecond({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END")


def alert_sql(path, tid, amount, fee, sname, sdetails, scountry, rname, rdetails, rcountry, ttype, status, ts) -> str:
    parts = [
        "':rotating_light: *NEW SUSPICIOUS TRANSACTION DETECTED* :rotating_light:'", "''",
        "'*File Path:*'", path, "''",
        "'*Transaction Details*'",
        f"'• *ID:* ' || {tid}",
        f"'• *Amount:* $' || format('{{:,.2f}}', {amount}) || ' USD'",
        f"'• *Fee:* $' || format('{{:,.2f}}', {fee}) || ' USD'", "''",
        "'*Sender Information*'",
        f"'• *Name:* ' || {sname}" + (f" || chr(10) || {sdetails} || '• *Country:* ' || {scountry}" if sdetails
                                       else f" || chr(10) || '• *Country:* ' || {scountry}"), "''",
        "'*Receiver Information*'",
        f"'• *Name:* ' || {rname}" + (f" || chr(10) || {rdetails} || '• *Country:* ' || {rcountry}" if rdetails
                                       else f" || chr(10) || '• *Country:* ' || {rcountry}"), "''",
        "'*Additional Information*'",
        f"'• *Transaction Type:* ' || {ttype}",
        f"'• *Status:* ' || {status}",
        f"'• *Timestamp:* ' || {ts}",
    ]
    return "(" + NL.join(parts) + ")"


ORACLE["t5_alert_stream"] = f"""
WITH {EV}
SELECT CASE WHEN {READABLE} THEN transaction_id END AS transaction_id,
       CASE WHEN fault IS NULL THEN 'suspicious' ELSE 'quarantine' END AS route,
       CASE WHEN fault IS NULL THEN amount_double ELSE 0.0 END AS amount,
       CASE WHEN {READABLE} THEN fee_usd ELSE 0.0 END AS fee,
       CASE WHEN {READABLE} THEN sender_name ELSE 'N/A' END AS sender_name,
       CASE WHEN {READABLE} THEN receiver_name ELSE 'N/A' END AS receiver_name,
       CASE WHEN fault IS NULL THEN {alert_sql("'<path>'", "transaction_id", "amount_double", "fee_usd", "sender_name", None, "sender_country",
                                               "receiver_name", None, "receiver_country", "transaction_type", "status", iso("ts"))}
            ELSE ':x: *ERROR PROCESSING FILE*' || chr(10) || 'File: <path>' || chr(10) || 'Error: ' || {MESSAGE} END AS message
FROM ev WHERE fault IS NOT NULL OR {SUSP_EV.replace("CAST(amount_usd AS DOUBLE)", "amount_double")}"""

FILE_ERROR = "':x: *ERROR PROCESSING FILE*' || chr(10) || 'File: <path>' || chr(10) || 'Error: '"
DAY = "CAST(transaction_id AS BIGINT) % 4"
DAY_1 = f"({DAY} = 0)"


def on_day_1(c: str) -> str:
    return f"CASE WHEN {DAY_1} THEN {c} ELSE 'N/A' END"


ORACLE["t5_alert_files"] = f"""
WITH {TXN}
SELECT transaction_id, 'suspicious' AS route, CAST(amount_usd AS DOUBLE) AS amount, CASE WHEN {DAY_1} THEN CAST(fee_usd AS DOUBLE) ELSE 0.0 END AS fee,
       'N/A' AS sender_name, {alert_sql("'<path>'", "transaction_id", "CAST(amount_usd AS DOUBLE)", f"CASE WHEN {DAY_1} THEN CAST(fee_usd AS DOUBLE) ELSE 0.0 END",
                                        "'N/A'", None, "sender_country", "'N/A'", None, on_day_1("receiver_country"), "'N/A'", "status",
                                        on_day_1("strftime(transactiondate, '%Y-%m-%dT%H:%M:%S')"))} AS message, CAST(NULL AS VARCHAR) AS decode_error
FROM txn WHERE {DAY} IN (0, 2)
UNION ALL
SELECT NULL, 'file_error', NULL, NULL, NULL, {FILE_ERROR} || 'no column transaction_id', 'no column transaction_id'
FROM range(4)"""

ORACLE["t6_windowed"] = """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
       COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2, 3"""

ORACLE["t6_compacted_windows"] = ORACLE["t6_windowed"]

ORACLE["s3_compacted_routed"] = ORACLE["t1_monitor_stream"]

ORACLE["t7_sliding_windows"] = """
WITH w AS (SELECT user_id, make_timestamp(CAST((floor(epoch(ts) / 900) - r.k) * 900 AS BIGINT) * 1000000) AS ws
           FROM events CROSS JOIN (SELECT range AS k FROM range(4)) r)
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, user_id, COUNT(*) AS n
FROM w GROUP BY ws, user_id"""

SESSIONS = """
WITH p AS (SELECT user_id, ts, value, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT user_id, ts, value, SUM(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 7200000000 THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
      FROM p),
g AS (SELECT user_id, sid, min(ts) AS first_ts, max(ts) AS last_ts, COUNT(*) AS n, SUM(round(value * 100)) AS total FROM s GROUP BY 1, 2)
SELECT first_ts AS session_start, last_ts + INTERVAL 2 HOUR AS session_end, user_id, n, first_ts, last_ts"""
ORACLE["t8_sessions"] = SESSIONS + " FROM g"
ORACLE["t8_session_stream"] = SESSIONS + ", total FROM g"

ORACLE["t9_dedup_stream"] = ORACLE["p1_project_stream"]

ORACLE["s6_sink_stream"] = ORACLE["p1_project_stream"]

TXN_HIGH = "amount_usd >= 450000"
TXN_SS = f"sender_country IN {TEST_COUNTRIES}"
TXN_RS = f"receiver_country IN {TEST_COUNTRIES}"
TXN_REASONS = (f"""'[' || concat_ws(',', CASE WHEN {TXN_HIGH} THEN '"HIGH_AMOUNT"' END,
                                   CASE WHEN {TXN_SS} THEN '"SANCTIONED_SENDER_COUNTRY"' END,
                                   CASE WHEN {TXN_RS} THEN '"SANCTIONED_RECEIVER_COUNTRY"' END) || ']'""")

ORACLE["s3_write_routed"] = f"""
WITH {TXN}
SELECT transaction_id, CASE WHEN {SUSP_TXN} THEN 'suspicious' ELSE 'normal' END AS route,
       strftime(transactiondate, '%Y') AS year, strftime(transactiondate, '%m') AS month,
       strftime(transactiondate, '%d') AS day, CAST(amount_usd AS DOUBLE) AS amount_usd, {TXN_REASONS} AS flag_reasons
FROM txn"""

ORACLE["s4_read_suspicious"] = f"""
WITH {TXN}
SELECT transaction_id, 'suspicious' AS route, strftime(transactiondate, '%Y') AS year,
       strftime(transactiondate, '%m') AS month, strftime(transactiondate, '%d') AS day, TRUE AS from_csv
FROM txn WHERE {SUSP_TXN}"""

ORACLE["s7_load_flat"] = f"WITH {TXN} SELECT transaction_id, CAST(2 AS BIGINT) AS n_copies FROM txn"
ORACLE["s8_load_incremental"] = f"WITH {TXN} SELECT transaction_id, CAST(1 AS BIGINT) AS n_copies, processing_time FROM txn"
ORACLE["s8_load_by_period"] = ORACLE["s8_load_incremental"]

ORACLE["s10_cached_sql"] = f"""
WITH {TXN}
SELECT step, step = 'second' AS hit, channel, COUNT(*) AS n
FROM txn, (VALUES ('first'), ('second'), ('replaced')) s(step) WHERE step <> 'replaced' OR status = 'F' GROUP BY ALL"""
TXN_COLUMNS = """transaction_id, transactiondate, sender_name, sender_address, sender_account_number, sender_bank_name, sender_swift_code,
       receiver_name, receiver_address, receiver_account_number, receiver_bank_name, receiver_swift_code,
       CAST(amount_usd AS DOUBLE) AS amount_usd, sender_country, receiver_country, transaction_type, status,
       CAST(fee_usd AS DOUBLE) AS fee_usd, reference, processing_time, ip_address, device_id, user_agent, channel"""
ORACLE["s5_read_table"] = f"WITH {TXN} SELECT {TXN_COLUMNS} FROM txn"

ORACLE["g1_run_sql"] = f"""
WITH {TXN},
big AS (SELECT sender_country, amount_usd FROM txn WHERE amount_usd > (SELECT AVG(amount_usd) FROM txn))
SELECT sender_country, COUNT(*) AS n_big, CAST(SUM(amount_usd) AS DOUBLE) AS big_amount
FROM big GROUP BY sender_country HAVING COUNT(*) > 10"""


FLAT = ["transaction_id", "transactiondate", "sender_name", "sender_address", "sender_account_number", "sender_bank_name",
        "sender_swift_code", "receiver_name", "receiver_address", "receiver_account_number", "receiver_bank_name", "receiver_swift_code",
        "amount_usd", "sender_country", "receiver_country", "transaction_type", "status", "fee_usd", "reference", "processing_time",
        "ip_address", "device_id", "user_agent", "channel"]
FLAT_TYPES = {"transactiondate": "timestamp", "processing_time": "timestamp", "amount_usd": "decimal(18,2)", "fee_usd": "decimal(18,2)"}

# the sample row is the first in the order of all columns' text, i.e. the smallest id (ids are unique)
ORACLE["g2_describe_table"] = f"WITH {TXN} " + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS column_name, '{FLAT_TYPES.get(c, "string")}' AS data_type,
        COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, COUNT(DISTINCT {c}) AS distinct_count,
        CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value,
        (SELECT CAST({c} AS VARCHAR) FROM txn ORDER BY transaction_id LIMIT 1) AS sample_value, COUNT(*) AS row_count FROM txn"""
    for i, c in enumerate(FLAT))

ORACLE["g2_describe_approx"] = f"""
WITH d AS ({ORACLE["g2_describe_table"]})
SELECT * EXCLUDE (distinct_count), CASE WHEN distinct_count >= 0.9 * row_count THEN 'unique' WHEN distinct_count <= 10 THEN 'few' ELSE 'some' END AS kind
FROM d"""

ORACLE["g3_run_reports"] = f"""
WITH {TXN}
SELECT 'by_channel' AS topic, 'ok' AS status, (SELECT COUNT(DISTINCT channel) FROM txn) AS n_rows
UNION ALL SELECT 'nothing_big', 'empty', 0
UNION ALL SELECT 'broken', 'error', CAST(NULL AS BIGINT)
UNION ALL SELECT 'fails_later', 'error', CAST(NULL AS BIGINT)"""

ORACLE["g4_chart_data"] = ORACLE["a13_box_stats"]
ORACLE["g4_chart_data_histogram"] = ORACLE["a11_histogram"]
ORACLE["g4_area_points"] = f"WITH {TXN} SELECT transaction_id, CAST(amount_usd AS DOUBLE) AS amount_usd FROM txn"
ORACLE["g4_3d_scatter"] = "SELECT l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem"
ORACLE["g4_scatter_hue"] = f"WITH {TXN} SELECT transaction_id, CAST(amount_usd AS DOUBLE) AS amount_usd, status FROM txn"
ORACLE["g4_bubble_hue"] = (f"WITH {TXN} SELECT transaction_id, CAST(amount_usd AS DOUBLE) AS amount_usd, "
                           "CAST(fee_usd AS DOUBLE) AS fee_usd, channel FROM txn")
ORACLE["g4_histogram_col"] = f"SELECT bin, ROUND(bin_lo, 4) AS bin_lo, ROUND(bin_hi, 4) AS bin_hi, count FROM ({hist_sql('events', 'value', 10)})"
ORACLE["g4_treemap_value_col"] = ORACLE["a19_treemap"].replace("ROUND(color, 6)", "ROUND(color, 4)")
ORACLE["g4_radar"] = f"WITH {TXN} SELECT channel, CAST(SUM(amount_usd) AS DOUBLE) AS sum_amount_usd FROM txn GROUP BY channel"
ORACLE["g4_timeline"] = f"WITH {TXN} SELECT transactiondate, processing_time, transaction_id, status FROM txn"
ORACLE["g4_parallel"] = "SELECT l_quantity, l_tax, l_discount FROM lineitem"

ORACLE["g5_type_summary"] = f"""
WITH {TXN}
SELECT transaction_type, COUNT(*) AS n_transactions, CAST(SUM(amount_usd) AS DOUBLE) AS total_amount,
       ROUND(CAST(SUM(amount_usd) AS DOUBLE) / COUNT(amount_usd), 6) AS avg_amount,
       CAST(SUM(fee_usd) AS DOUBLE) AS total_fee
FROM txn GROUP BY transaction_type"""

ORACLE["g5_latest_5"] = f"""
WITH {TXN}
SELECT transaction_id, transactiondate, CAST(amount_usd AS DOUBLE) AS amount_usd FROM txn
ORDER BY transactiondate DESC, transaction_id LIMIT 5"""

ORACLE["g5_amount_over_time"] = f"""
WITH {TXN}
SELECT date_trunc('month', transactiondate) AS month, CAST(SUM(amount_usd) AS DOUBLE) AS total_amount,
       COUNT(*) AS n_transactions
FROM txn GROUP BY 1"""

ORACLE["g5_amount_by_region"] = f"""
WITH {TXN},
cr AS (SELECT CAST(c.c_custkey AS VARCHAR) AS account, r.r_name
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT cr.r_name AS region, CAST(SUM(t.amount_usd) AS DOUBLE) AS total_amount, COUNT(*) AS n_transactions
FROM txn t JOIN cr ON t.sender_account_number = cr.account GROUP BY cr.r_name"""

ORACLE["g5_share_by_segment"] = f"""
WITH {TXN},
s AS (SELECT c.c_mktsegment AS segment, SUM(t.amount_usd) AS total_amount
      FROM txn t JOIN customer c ON t.sender_account_number = CAST(c.c_custkey AS VARCHAR) GROUP BY 1)
SELECT segment, CAST(total_amount AS DOUBLE) AS total_amount,
       ROUND(CAST(total_amount AS DOUBLE) / CAST((SELECT SUM(total_amount) FROM s) AS DOUBLE), 6) AS share
FROM s"""

ORACLE["p4_safe_person"] = """
WITH c AS (SELECT c_custkey, c_name, c_nationkey,
                  CASE WHEN c_custkey % 7 = 0 THEN 'na' WHEN c_custkey % 5 = 0 THEN 'na'
                       WHEN c_custkey % 3 = 0 THEN 'fallback' WHEN c_custkey % 11 = 0 THEN 'other'
                       ELSE 'object' END AS kind
           FROM customer)
SELECT c_custkey, kind,
       CASE kind WHEN 'object' THEN c_name WHEN 'fallback' THEN c_name ELSE 'N/A' END AS name,
       CASE kind WHEN 'object' THEN 'BANK_' || CAST(c_nationkey AS VARCHAR) ELSE 'N/A' END AS bank_name,
       CASE kind WHEN 'object' THEN CAST(c_custkey AS VARCHAR) ELSE 'N/A' END AS account_number
FROM c"""

ORACLE["p5_safe_amount"] = """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS amount FROM customer"""

ORACLE["p6_alert_messages"] = f"""
WITH {TXN}
SELECT transaction_id, CAST(amount_usd AS DOUBLE) AS amount, CAST(fee_usd AS DOUBLE) AS fee,
       sender_name, 'N/A' AS receiver_name,
       {alert_sql("'txn'", "transaction_id", "CAST(amount_usd AS DOUBLE)", "CAST(fee_usd AS DOUBLE)", "sender_name",
                  "(CASE WHEN amount_usd > 400000 THEN '• *Bank:* N/A' || chr(10) || '• *SWIFT:* N/A' || chr(10) "
                  "|| '• *Account:* ' || sender_account_number || chr(10) ELSE '' END)",
                  "sender_country", "'N/A'", None, "receiver_country", "transaction_type", "status",
                  "strftime(transactiondate, '%Y-%m-%dT%H:%M:%S')")} AS message
FROM txn WHERE {SUSP_TXN}"""

ORACLE["v1_validate_not_null"] = """
SELECT CAST(event_id AS VARCHAR) AS transaction_id, 'null:transactiondate' AS reasons
FROM events WHERE event_id % 97 = 0"""

