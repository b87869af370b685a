"""The same results in plain SQL over the test tables, for an independent engine.

Statements are kept as named common table expressions; `statement` collects the
ones a query needs. Decimal figures are computed on whole numbers (cents), so both
engines round the same exact value.
"""

from __future__ import annotations

import re


def half_away(num: str, den: str, scale: int = 0) -> str:
    """num / den rounded half away from zero to `scale` decimals, from whole numbers."""
    n, d = f"(({num})::HUGEINT * {10 ** scale})", f"(nullif({den}, 0)::HUGEINT)"
    whole = f"(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})))::DOUBLE"
    return f"({whole} / {10 ** scale}.0)" if scale else whole


def key(col: str) -> str:
    return f"upper(regexp_replace(trim({col}), '[-_ ]', '', 'g'))"


def number(col: str) -> str:
    return f"try_cast(nullif(trim({col}), '') AS DOUBLE)"


def whole(col: str) -> str:
    return f"round({number(col)})::BIGINT"


def cents(col: str) -> str:
    return f"round({number(col)} * 100)::BIGINT"


def money(c: str) -> str:
    return f"(({c}) // 100)::VARCHAR || '.' || lpad((({c}) % 100)::VARCHAR, 2, '0')"


def loc(n: str) -> str:
    return f"'LOC-' || lpad(({n})::VARCHAR, 2, '0')"


def spelled(i: str, n: str) -> str:
    return f"['SKU-', 'SKU', 'sku_', 'Sku-', 'SKU '][({i}) + 1] || lpad(({n})::VARCHAR, 3, '0')"


def even(e: str, scale: int = 2) -> str:
    f = 10.0**scale
    return f"(round_even(({e}) * {f}, 0) / {f})"


PLAIN_NUMBER = "'[0-9]+(\\.[0-9]+)?'"
WORD = "4294967296.0"
ORDER_KEY = "l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR"
LINE_SEQ = "{'a': l_shipdate, 'b': l_partkey, 'c': l_suppkey, 'd': l_quantity, 'e': l_extendedprice}"
LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
PRICE = "((round(l_extendedprice * 100)::BIGINT * 2 + l_quantity::BIGINT) // (l_quantity::BIGINT * 2))"
LONGEST_PRICE = 9_999_999_999
FREIGHT = "(round(l_extendedprice * 100)::BIGINT * 3 // 100)"


def last(keys: str, order: str = "seq DESC") -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


CTES: dict[str, str] = {}

CTES["sku_raw"] = f"""
SELECT CASE WHEN p_partkey % 43 = 11 THEN 'ABC' || lpad((p_partkey % 40)::VARCHAR, 3, '0')
    ELSE {spelled('p_partkey // 40 % 5', 'p_partkey % 40')} END AS sku_id, p_name AS sku_name,
  CASE WHEN p_partkey % 3 = 0 THEN ' ' || lower(p_type) ELSE p_type END AS category,
  CASE p_partkey % 50 WHEN 7 THEN '' WHEN 8 THEN 'abc' WHEN 9 THEN '123456789012'
    ELSE {money('round(p_retailprice * 100)::BIGINT')} END AS unit_cost_usd,
  CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 8 = 1 THEN '' WHEN p_partkey % 64 = 2 THEN 'n/a'
    ELSE p_size::VARCHAR || '.0' END AS lead_time_days,
  'SUP' || lpad((p_partkey % 25)::VARCHAR, 3, '0') AS supplier_id,
  CASE WHEN p_partkey % 9 <> 0 THEN p_size::VARCHAR || '.5' ELSE '' END AS unit_weight_lbs,
  (p_partkey * 7 % 500)::VARCHAR || '.5' AS reorder_point,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE
    CASE WHEN p_partkey % 2 = 1 THEN lower(s) ELSE s END END AS segment,
  ['Y', 'YES', 'y', '1', 'true', 'N'][p_partkey % 6 + 1] AS active, p_partkey AS seq
FROM (SELECT *, CASE p_partkey % 40 % 5 WHEN 0 THEN 'PREMIUM' WHEN 4 THEN 'BUDGET' ELSE 'STANDARD' END AS s FROM part)"""

CTES["location_raw"] = f"""
SELECT CASE WHEN c_custkey % 47 = 13 THEN 'DC-' || n_nationkey
    ELSE CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END || {loc('n_nationkey')} END AS location_id,
  n_name || ' hub ' AS location_name, r_name AS region,
  CASE WHEN c_custkey % 2 = 0 THEN lower(t) || ' ' ELSE t END AS location_type,
  CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * 13 % 900 * 1000)::VARCHAR ELSE '' END AS capacity_units,
  (c_custkey * 37 % 5000)::VARCHAR || '.25' AS operating_cost_per_day, c_custkey AS seq
FROM (SELECT *, CASE WHEN n_nationkey < 6 THEN 'DC' WHEN n_nationkey < 16 THEN 'RDC'
        WHEN n_nationkey < 24 THEN 'STORE' ELSE 'HUB' END AS t
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CTES["policy_raw"] = """
SELECT k, v, [' premium', 'Standard', 'BUDGET ', 'trial'][k + 1] AS segment,
  CASE WHEN v < 2 THEN [99.5, 97.0, 92.0, 50.0][k + 1]::DOUBLE END AS fill_pct, [2, 5, 10, 30][k + 1] AS backorder_days,
  [2.33, 1.65, 1.28, 0.5][k + 1]::DOUBLE AS z, [1, 7, 14, 30][k + 1] + 1 - v AS review_days,
  [0.25, 0.2, 0.18, 0.1][k + 1]::DOUBLE AS holding, [85, 35, 12, 1][k + 1] AS penalty
FROM (SELECT DISTINCT c_custkey % 4 AS k, c_custkey // 4 % 3 AS v FROM customer)"""

CTES["lane_raw"] = f"""
SELECT 'LANE-' || s || '-' || c_nationkey || '-' || h AS lane_id,
  {loc('s')} || ' ' AS origin, {loc('c_nationkey')} AS dest,
  (s * 97 + c_nationkey * 31) % 2500 + 50 AS distance_miles, CASE WHEN c_custkey % 31 <> 5 THEN (s + c_nationkey + h) % 4 + 1 END AS transit_days,
  ((s * 7 + c_nationkey * 3 + h * 11) % 20 + 1) * 10000 + c_custkey % 10000 AS unit_e4,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 1000 END AS lb_e3,
  ['TL', 'ltl', 'Parcel', 'INTERMODAL', 'Air'][(s + c_nationkey + h) % 5 + 1] AS carrier_mode, c_custkey AS seq
FROM (SELECT *, c_custkey % 25 AS s, c_custkey // 25 % 2 AS h FROM customer)"""

CTES["order_raw"] = f"""
SELECT CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE '' END || {ORDER_KEY} AS order_id,
  CASE WHEN l_partkey % 59 <> 0 THEN o_orderdate::DATE END AS order_date,
  'C' || c_custkey AS customer_id, {spelled('l_suppkey % 5', 'l_partkey % 42')} AS sku_id,
  {loc('c_nationkey')} AS location_id,
  CASE WHEN l_suppkey % 29 = 0 THEN '0' WHEN l_partkey % 53 = 0 THEN ''
    WHEN l_partkey % 61 = 0 THEN '0.4' ELSE l_quantity::VARCHAR END AS quantity,
  CASE WHEN l_partkey % 67 = 0 THEN 12345678901200 ELSE {PRICE} END AS price_cents,
  CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'O' THEN ' cancelled'
    WHEN l_returnflag = 'N' AND o_orderstatus = 'F' THEN NULL ELSE 'SHIPPED' END AS order_status,
  o_orderpriority AS channel, {LINE_SEQ} AS seq
FROM {LINES}"""

CTES["shipment_raw"] = f"""
SELECT 'SH' || {ORDER_KEY} || '-' || l_suppkey % 3 AS shipment_id,
  CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE {ORDER_KEY} END AS order_id,
  {loc('s_nationkey')} AS origin, ' ' || {loc('c_nationkey')} AS dest,
  {spelled('l_suppkey % 5', 'l_partkey % 42')} AS sku_id,
  CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE (l_quantity - l_orderkey % 3)::BIGINT END AS qty,
  l_shipdate::DATE AS ship_date,
  CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_shipdate::DATE + (l_partkey % 9 - 1)::INTEGER END AS arrival_date,
  CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 101 = 0 THEN 'N/A'
    WHEN l_orderkey % 307 = 0 THEN '200000000000000'
    WHEN l_orderkey % 211 = 0 THEN {money(FREIGHT + ' * 100')} ELSE {money(FREIGHT)} END AS freight,
  'CR' || l_suppkey % 7 AS carrier, CASE WHEN l_orderkey % 5 = 0 THEN 'delayed' ELSE 'DELIVERED' END AS status,
  {LINE_SEQ} AS seq
FROM {LINES} JOIN supplier ON l_suppkey = s_suppkey"""

CTES["snapshot_raw"] = f"""
SELECT CASE WHEN event_id % 211 <> 0 AND event_id % 223 <> 0 THEN ts::DATE END AS snapshot_date, event_id % 211 <> 0 AS sent,
  CASE WHEN event_id % 211 = 0 THEN '' WHEN event_id % 223 = 0 THEN 'yesterday' ELSE ts::DATE::VARCHAR END AS day_text, {loc('user_id % 25')} AS location_id,
  {spelled('event_id % 5', 'event_id // 3 % 42')} AS sku_id,
  CASE WHEN event_id % 37 <> 0 THEN floor(value)::BIGINT - 20 END AS on_hand,
  CASE WHEN event_id % 13 <> 0 THEN event_id % 100 END AS on_order, event_id AS seq
FROM events"""

CTES["location"] = f"""
SELECT trim(location_id) AS location_id, trim(location_name) AS location_name, upper(trim(location_type)) AS location_type,
  region, list_position(['DC', 'RDC', 'STORE'], upper(trim(location_type)))::BIGINT AS echelon,
  {whole('capacity_units')} AS capacity_units, {number('operating_cost_per_day')} AS fixed_operating_cost
FROM location_raw WHERE upper(trim(location_type)) <> 'HUB' {last('trim(location_id)')}"""

CTES["category_mean"] = f"""
SELECT upper(trim(category)) AS category, {half_away('sum(lead_time_days::DOUBLE)', 'count(*)')}::BIGINT AS group_mean
FROM sku_raw WHERE regexp_full_match(lead_time_days, {PLAIN_NUMBER}) GROUP BY 1"""

CTES["sku"] = f"""
SELECT {key('sku_id')} AS sku_id, sku_name AS description, category_mean.category, {cents('unit_cost_usd')} AS cost_cents,
  {number('unit_weight_lbs')} AS unit_weight_lbs, supplier_id,
  coalesce({whole('lead_time_days')}, group_mean, 7) AS lead_time_days,
  {whole('reorder_point')} AS reorder_point, upper(active) <> 'N' AS active
FROM sku_raw LEFT JOIN category_mean ON upper(trim(sku_raw.category)) = category_mean.category
WHERE {number('unit_cost_usd')} < 1e8 {last(key('sku_id'))}"""

CTES["policy"] = """
SELECT upper(trim(segment)) AS customer_segment, fill_pct / 100 AS target_fill_rate, z AS z_score, penalty,
  CASE upper(trim(segment)) WHEN 'PREMIUM' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 3 END::BIGINT AS priority_rank,
  backorder_days::BIGINT AS max_backorder_days, review_days::BIGINT AS review_period_days, holding AS holding_cost_rate
FROM policy_raw WHERE segment <> 'trial' AND fill_pct IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1"""

CTES["lane"] = f"""
SELECT lane_id, trim(origin) AS from_location, dest AS to_location,
  CASE upper(carrier_mode) WHEN 'INTERMODAL' THEN 'RAIL' ELSE 'TRUCK' END AS transport_mode,
  distance_miles, transit_days, unit_e4, lb_e3
FROM lane_raw WHERE carrier_mode <> 'Air' AND transit_days IS NOT NULL AND trim(origin) IN (SELECT location_id FROM location)
  AND dest IN (SELECT location_id FROM location) {last('lane_id')}"""

CTES["sku_segment"] = f"""
SELECT {key('sku_id')} AS sku_id, upper(segment) AS segment FROM sku_raw WHERE segment IS NOT NULL {last(key('sku_id'))}"""

CTES["sales"] = f"""
SELECT trim(order_id) AS order_id, order_date, sku_segment.sku_id, customer_id, location_id AS ship_to_location,
  segment AS customer_segment, {whole('quantity')} AS qty_ordered, price_cents, channel
FROM order_raw JOIN sku_segment ON {key('order_raw.sku_id')} = sku_segment.sku_id
WHERE order_status IS DISTINCT FROM ' cancelled' AND {whole('quantity')} > 0 AND price_cents BETWEEN 1 AND {LONGEST_PRICE}
  AND order_date IS NOT NULL
  AND sku_segment.sku_id IN (SELECT sku_id FROM sku) AND location_id IN (SELECT location_id FROM location)
{last('trim(order_id)')}"""

CTES["lane_best"] = """
SELECT from_location, to_location, transport_mode, transit_days FROM lane
QUALIFY row_number() OVER (PARTITION BY from_location, to_location ORDER BY transit_days, unit_e4, lane_id) = 1"""

CTES["ship_ready"] = f"""
SELECT r.*, {key('r.sku_id')} AS sku, trim(r.dest) AS to_location, b.transport_mode, b.transit_days,
  CASE WHEN arrival_date >= ship_date THEN arrival_date END AS delivery_date,
  CASE WHEN regexp_full_match(freight, {PLAIN_NUMBER}) THEN {cents('freight')} END AS fc
FROM shipment_raw r LEFT JOIN lane_best b ON r.origin = b.from_location AND trim(r.dest) = b.to_location"""

CTES["freight_rank"] = """
SELECT transport_mode, fc, row_number() OVER (PARTITION BY transport_mode ORDER BY fc) - 1 AS r,
  count(*) OVER (PARTITION BY transport_mode) AS n
FROM ship_ready WHERE transport_mode IS NOT NULL AND fc IS NOT NULL"""

CTES["freight_cap"] = """
SELECT transport_mode, lo * 100 + (hi - lo) * part AS cap_e4
FROM (SELECT transport_mode, max(fc) FILTER (r = 99 * (n - 1) // 100) AS lo,
        max(fc) FILTER (r = (99 * (n - 1) + 99) // 100) AS hi, max(99 * (n - 1) % 100) AS part
      FROM freight_rank GROUP BY 1)"""

CTES["freight_stat"] = """
SELECT transport_mode, max(cap_e4) AS cap_e4, sum(least(fc * 100, cap_e4)) AS capped_sum, count(*) AS n
FROM freight_rank JOIN freight_cap USING (transport_mode) GROUP BY 1"""

REPAIRED = f"""CASE WHEN fc IS NULL THEN {half_away('capped_sum', 'n * 100')}
    WHEN fc * 100 > cap_e4 THEN {half_away('cap_e4', '100')} WHEN fc <= {LONGEST_PRICE} THEN fc::DOUBLE END"""

CTES["shipment"] = f"""
SELECT shipment_id, s.order_id, ship_date, delivery_date, origin AS from_location, s.to_location, sku AS sku_id, qty AS qty_shipped,
  s.transport_mode, ({REPAIRED})::BIGINT AS freight_cents, carrier,
  CASE WHEN delivery_date IS NOT NULL AND transit_days IS NOT NULL THEN delivery_date - ship_date <= transit_days
    WHEN status = 'delayed' THEN FALSE END AS on_time_flag
FROM (SELECT * REPLACE (CASE WHEN order_id IN (SELECT order_id FROM sales) THEN order_id END AS order_id)
      FROM ship_ready
      WHERE qty >= 0 AND origin IN (SELECT location_id FROM location)
        AND to_location IN (SELECT location_id FROM location) AND sku IN (SELECT sku_id FROM sku)
      {last('shipment_id')}) s
LEFT JOIN freight_stat f ON s.transport_mode = f.transport_mode"""

CTES["stock"] = f"""
SELECT snapshot_date, location_id, {key('sku_id')} AS sku_id, greatest(coalesce(on_hand, 0), 0) AS on_hand_qty,
  coalesce(on_order, 0) AS on_order_qty, seq
FROM snapshot_raw
WHERE snapshot_date IS NOT NULL AND location_id IN (SELECT location_id FROM location)
  AND {key('sku_id')} IN (SELECT sku_id FROM sku)
{last('snapshot_date, location_id, ' + key('sku_id'))}"""

CTES["day"] = """
SELECT order_date, sku_id, ship_to_location AS location_id, customer_segment, sum(qty_ordered)::BIGINT AS q,
  count(*) AS num_orders, sum(price_cents) AS price_sum
FROM sales GROUP BY ALL"""

CTES["demand_all"] = f"""
SELECT sku_id, location_id, customer_segment, category, lead_time_days, z_score, target_fill_rate, n AS observation_days,
  mean AS avg_demand_per_day, sd AS std_demand_per_day, hi AS max_demand_per_day, lo AS min_demand_per_day,
  p50 AS p50_demand, p90 AS p90_demand, p95 AS p95_demand, sd / mean AS coefficient_of_variation,
  round_even(z_score * sd * sqrt(lead_time_days), 0) AS safety_stock_units,
  round_even(mean * lead_time_days + z_score * sd * sqrt(lead_time_days), 0) AS reorder_point_units,
  {half_away('total * 365', 'n')} AS annual_demand_estimate
FROM (SELECT sku_id, location_id, customer_segment, count(*) AS n, sum(q)::BIGINT AS total,
        sum(q)::DOUBLE / count(*) AS mean, coalesce(stddev_samp(q), 0) AS sd, max(q) AS hi, min(q) AS lo,
        quantile_cont(q::DOUBLE, 0.5) AS p50, quantile_cont(q::DOUBLE, 0.9) AS p90, quantile_cont(q::DOUBLE, 0.95) AS p95
      FROM day GROUP BY ALL)
JOIN sku USING (sku_id) JOIN policy USING (customer_segment)"""

CTES["demand"] = "SELECT * FROM demand_all WHERE observation_days >= 30"

CTES["stock_latest"] = """
SELECT * FROM stock QUALIFY row_number() OVER (PARTITION BY location_id, sku_id ORDER BY snapshot_date DESC) = 1"""

CTES["order_line"] = """
SELECT o.order_id, o.sku_id, o.customer_segment, o.ship_to_location, a.region AS ship_to_region,
  b.location_type AS fulfilled_from_type, qty_ordered, price_cents, qty_ordered * price_cents AS revenue_c,
  qty_ordered * cost_cents AS product_c, coalesce(freight_cents, 0) AS freight_c, qty_ordered * 50 AS handling_c,
  cost_cents * lead_time_days * qty_ordered AS held_c,
  coalesce((qty_ordered - qty_shipped) * penalty * 100, 0) AS stockout_c
FROM sales o JOIN sku USING (sku_id) JOIN policy USING (customer_segment)
LEFT JOIN shipment sh ON o.order_id = sh.order_id
LEFT JOIN location a ON o.ship_to_location = a.location_id LEFT JOIN location b ON sh.from_location = b.location_id"""

CTES["served"] = """
SELECT customer_segment, ship_to_region, sku_id, count(DISTINCT order_id) AS num_orders, sum(qty_ordered)::BIGINT AS units,
  sum(revenue_c)::HUGEINT AS rev, sum(product_c)::HUGEINT AS prod, sum(freight_c)::HUGEINT AS frt,
  sum(handling_c)::HUGEINT AS hnd, sum(held_c)::HUGEINT AS held, sum(stockout_c)::HUGEINT AS sto, count(*) * 250 AS prc
FROM order_line GROUP BY ALL"""

# Carrying cost is held / 1460 cents, so totals are whole numbers of 1/1460 cents.
CTES["served_total"] = "SELECT *, (prod + frt + hnd + sto + prc) * 1460 + held AS tot, rev * 1460 AS rev_x FROM served"

CTES["flow"] = f"""
SELECT sh.from_location, a.location_name AS from_location_name, a.location_type AS from_type, sh.to_location,
  b.location_name AS to_location_name, b.location_type AS to_type, sh.transport_mode, sh.sku_id, category,
  count(DISTINCT shipment_id) AS num_shipments, sum(qty_shipped)::BIGINT AS total_units_shipped,
  sum(freight_cents)::DOUBLE / 100 AS total_freight_cost,
  {half_away('sum(freight_cents)', 'count(freight_cents) * 100', 4)} AS avg_freight_per_shipment,
  {half_away('sum(freight_cents)', 'sum(qty_shipped) * 100', 4)} AS freight_cost_per_unit,
  {half_away('sum(delivery_date - ship_date)', 'count(delivery_date - ship_date)', 2)} AS avg_actual_lead_time_days,
  round(stddev_samp(delivery_date - ship_date), 4) AS std_actual_lead_time_days,
  {half_away('count(*) FILTER (on_time_flag) * 100', 'count(*)', 2)} AS on_time_pct,
  unit_e4 / 10000.0 AS contracted_cost_per_unit,
  {half_away('sum(freight_cents) * 100 - unit_e4 * sum(qty_shipped)', 'sum(qty_shipped) * 10000', 4)}
    AS freight_variance_per_unit
FROM shipment sh JOIN location a ON sh.from_location = a.location_id JOIN location b ON sh.to_location = b.location_id
JOIN sku USING (sku_id)
LEFT JOIN lane lc ON sh.from_location = lc.from_location AND sh.to_location = lc.to_location
  AND sh.transport_mode = lc.transport_mode
GROUP BY sh.from_location, a.location_name, a.location_type, sh.to_location, b.location_name, b.location_type,
  sh.transport_mode, sh.sku_id, category, unit_e4"""

CTES["lead"] = """
SELECT sku_id, location_id, (3 + ('0x' || substr(md5(sku_id || '|' || location_id || '|42'), 1, 8))::BIGINT % 7)::DOUBLE AS days
FROM (SELECT DISTINCT sku_id, to_location AS location_id FROM flow)"""

CTES["measured"] = """
SELECT sku_id, location_id, coalesce(mean, days) AS days FROM lead LEFT JOIN (
  SELECT sku_id, to_location AS location_id, avg((delivery_date - ship_date)::DOUBLE) AS mean FROM shipment GROUP BY ALL)
USING (sku_id, location_id)"""

CTES["rejected"] = f"""
SELECT 'dim_sku' AS table_name, 'unit_cost' AS column_name, {key('sku_id')} AS key
FROM sku_raw WHERE unit_cost_usd <> '' AND NOT coalesce({number('unit_cost_usd')} < 1e8, FALSE)
UNION ALL SELECT 'dim_service_policy', 'target_fill_rate', upper(trim(segment)) FROM policy_raw WHERE segment <> 'trial' AND fill_pct IS NULL
UNION ALL SELECT 'dim_lane_cost', 'transit_days_mean', lane_id
FROM lane_raw WHERE carrier_mode <> 'Air' AND transit_days IS NULL AND trim(origin) IN (SELECT location_id FROM location)
  AND dest IN (SELECT location_id FROM location)
UNION ALL SELECT 'fact_sales_orders', CASE WHEN order_date IS NULL THEN 'order_date'
    WHEN {whole('quantity')} <= 0 THEN 'qty_ordered' ELSE 'price_per_unit' END, trim(order_id)
FROM order_raw JOIN sku_segment ON {key('order_raw.sku_id')} = sku_segment.sku_id
WHERE order_status IS DISTINCT FROM ' cancelled' AND {number('quantity')} > 0 AND price_cents > 0
  AND sku_segment.sku_id IN (SELECT sku_id FROM sku) AND location_id IN (SELECT location_id FROM location)
  AND (order_date IS NULL OR {whole('quantity')} <= 0 OR price_cents > {LONGEST_PRICE})
UNION ALL SELECT 'fact_inventory_snapshot', 'snapshot_date', concat_ws('|', snapshot_date::VARCHAR, location_id, {key('sku_id')})
FROM snapshot_raw WHERE snapshot_date IS NULL AND sent AND location_id IN (SELECT location_id FROM location)
  AND {key('sku_id')} IN (SELECT sku_id FROM sku)"""

CTES["sim_base"] = """
SELECT sku_id, location_id, customer_segment, avg_demand_per_day AS mean,
  greatest(std_demand_per_day, 0.3::DOUBLE * avg_demand_per_day) AS sd, days
FROM demand JOIN lead USING (sku_id, location_id)"""

CTES["sim_block"] = """
SELECT *, md5(sku_id || '|' || location_id || '|' || customer_segment || '|' || sim || '|' || block || '|42') AS h
FROM (SELECT *, unnest(range(0, (days::BIGINT - 1) // 4 + 1)) AS block
      FROM (SELECT *, unnest(range(1, 2001)) AS sim FROM sim_base))"""


def _w(i: int) -> str:
    return f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT::DOUBLE"


def _z(pair: int, fn: str) -> str:
    return (
        f"(sqrt(ln(({_w(pair)} + 1.0::DOUBLE) / ({WORD}::DOUBLE + 1.0::DOUBLE)) * -2.0::DOUBLE)"
        f" * {fn}({_w(pair + 1)} / {WORD}::DOUBLE * 6.283185307179586::DOUBLE))"
    )


_DRAWS = [_z(0, "cos"), _z(0, "sin"), _z(2, "cos"), _z(2, "sin")]
_BLOCK_SUM = " + ".join(
    f"CASE WHEN block * 4 + {i} < days THEN greatest(mean + sd * {z}, 0.0::DOUBLE) ELSE 0.0::DOUBLE END"
    for i, z in enumerate(_DRAWS)
)
CTES["sim_total"] = f"""
SELECT sku_id, location_id, customer_segment, mean, sd, days, sim, sum({_BLOCK_SUM}) AS total
FROM sim_block GROUP BY ALL"""

CTES["simulated"] = f"""
SELECT sku_id, location_id, customer_segment, {even('mean')} AS avg_demand, {even('sd')} AS std_demand,
  days AS lead_time, {even('rop')} AS reorder_point, {even('rop - mean * days')} AS safety_stock
FROM (SELECT sku_id, location_id, customer_segment, mean, sd, days, quantile_cont(total, 0.95) AS rop
      FROM sim_total GROUP BY ALL)"""


def scenario_ctes(z: float = 1.65, holding: float = 2.0, stockout: float = 10.0, where: str = "TRUE") -> str:
    return f"""
SELECT *, CASE WHEN calc_safety_stock > safety_stock THEN 'Increase buffer'
    WHEN calc_safety_stock < safety_stock THEN 'Reduce buffer' ELSE 'Keep current policy' END AS recommendation
FROM (SELECT *, {even('holding_cost_total + risk_cost')} AS total_cost
  FROM (SELECT *, {even('avg_demand * lead_time + calc_safety_stock')} AS calc_reorder_point,
      {even(f'calc_safety_stock * {holding}::DOUBLE')} AS holding_cost_total,
      {even(f'std_demand * {stockout}::DOUBLE')} AS risk_cost
    FROM (SELECT *, {even(f'{z}::DOUBLE * std_demand * sqrt(lead_time)')} AS calc_safety_stock
      FROM simulated WHERE {where})))"""


CTES["what_if"] = scenario_ctes()
CTES["what_if_85"] = scenario_ctes(z=1.04)
CTES["what_if_place"] = scenario_ctes(where="location_id = 'LOC-07'")
CTES["what_if_99"] = scenario_ctes(z=2.33, holding=3.5, stockout=25.0, where="sku_id = 'SKU007'")


def statement(final: str) -> str:
    """Prefix `final` with the expressions it depends on, in definition order."""
    needed, todo = set(), [final]
    while todo:
        words = set(re.findall(r"\b[a-z_0-9]+\b", todo.pop()))
        for name in CTES.keys() & words - needed:
            needed.add(name)
            todo.append(CTES[name])
    parts = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + final
